"""Session helpers shared by every operator: tables, checkpoints, bounded collects."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Scan one parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder named by ``spark.checkpoint.dir``.

    The folder is only invented where the session names none and runs in local
    mode (tests); on a cluster that is an error.
    """
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = os.path.join(tempfile.gettempdir(), f"tallyforge-checkpoints-{os.getuid()}")
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def bounded_rows(df: DataFrame, most: int, what: str) -> list[Row]:
    """Collect a table that must be small; raise instead of collecting more than ``most`` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what} has more than {most} rows; raise the bound")
    return rows


def hash_sample(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """At most ``n`` rows, chosen by a hash of the keys: the same rows whatever the partitioning.

    Rows are first thinned by a hash range that keeps about twice ``n``, so
    that no task sends many more rows to the driver than are wanted.
    """
    total = df.count()
    h = F.xxhash64(*keys)
    thin = df.where(F.pmod(h, F.lit(1 << 20)) < int(min(1.0, (2.0 * n + 50) / max(1, total)) * (1 << 20)) + 1)
    return thin.orderBy(F.xxhash64(h), *keys).limit(n)
