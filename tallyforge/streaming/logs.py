"""Structured Streaming: windows over events, last-wins merges, replay of status logs, monitors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def timed(df: DataFrame, column: str, late: str) -> DataFrame:
    """Event time as a zoned timestamp with a watermark (zone-less times cannot carry one)."""
    out = df.withColumn(column, F.col(column).cast("timestamp"))
    return out.withWatermark(column, late) if df.isStreaming else out


def tumbling(df: DataFrame, column: str, size: str, *keys: str, late: str = "1 hour") -> DataFrame:
    return timed(df, column, late).groupBy(F.window(column, size).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sliding(df: DataFrame, column: str, size: str, step: str, *keys: str, late: str = "1 hour") -> DataFrame:
    return timed(df, column, late).groupBy(F.window(column, size, step).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(df: DataFrame, column: str, gap: str, *keys: str, late: str = "1 hour") -> DataFrame:
    return timed(df, column, late).groupBy(F.session_window(column, gap).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def replayed(df: DataFrame, entity: str, sequence: str, status: str, edges: set[tuple[str | None, str]]) -> DataFrame:
    """Running state of each entity of a log stream: (entity, status, revision, violations).

    The state is one row per entity; records of a micro-batch are applied in
    the order of their sequence. A record at or below the last sequence is a
    repetition and ignored; a step that is not permitted counts as a violation
    and leaves the state as it is.
    """
    schema = f"{entity} {dict(df.dtypes)[entity]}, status string, revision long, violations long"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, revision, bad, last = state.get if state.exists else (None, 0, 0, -1)
        rows = pd.concat(list(batches)).sort_values(sequence)
        for s, to in zip(rows[sequence].tolist(), rows[status].tolist(), strict=True):
            if s <= last:
                continue
            last = s
            if (now, to) in edges:
                now, revision = to, revision + 1
            else:
                bad += 1
        state.update((now, revision, bad, last))
        yield pd.DataFrame({entity: [key[0]], "status": [now], "revision": [revision], "violations": [bad]})

    return df.groupBy(entity).applyInPandasWithState(step, schema, "status string, revision long, violations long, last long", "update", GroupStateTimeout.NoTimeout)


def merge_batches(path: str, keys: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that appends deliveries; readers take the last of each key with :func:`latest`."""

    def write(batch: DataFrame, number: int) -> None:
        w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
        batch.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k").withColumn("_batch", F.lit(number)).write.mode("append").parquet(path)

    return write


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    from tallyforge.operators.curate import last_wins

    return last_wins(df.dropDuplicates(), keys, [*order, "_batch"])


def monitor(df: DataFrame, column: str, flag: Column, size: str, step: str, warn: float, halt: float, late: str = "10 minutes") -> DataFrame:
    """Share of flagged events per sliding window with its level."""
    rate = F.avg(flag.cast("double"))
    return timed(df, column, late).groupBy(F.window(column, size, step).alias("w")).agg(F.count("*").alias("n"), rate.alias("rate"), F.when(rate >= halt, "halt").when(rate >= warn, "warn").otherwise("ok").alias("level"))
