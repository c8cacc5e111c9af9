"""Second look at failed samples: what can be recovered, and what rates become when it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import extract as X
from tallyforge.functions import verdict as V
from tallyforge.functions.text import bound


def diagnosis(raw: Column, old: Column, passed: Column, missing: Column) -> Column:
    """What becomes of a sample: no_result, passed, empty, truncated, recoverable or clean."""
    again = lambda found: V.ladder((found["status"] == "empty", "empty"), (found["status"] == "truncated", "truncated"), (X.recoverable(found["code"], found["status"], old), "recoverable"), otherwise="clean")
    # samples without a result or with a pass are not looked at again
    return F.when(missing, "no_result").when(V.truthy(passed), "passed").otherwise(bound(X.picked_module(raw), again))


def flipped_rate(items: DataFrame, flips: DataFrame, item: str, n_samples: str, rate: str) -> DataFrame:
    """(n_items, pass_rate): every flipped sample of an item raises its rate by one sample, up to 1; mean in percent.

    ``flips`` has a row per flipped sample; a sample flipped twice counts once.
    """
    n = flips.select(item, "sample").distinct().groupBy(item).agg(F.count("*").alias("_flips"))
    new = F.least(F.lit(1.0), F.col(rate) + F.coalesce("_flips", F.lit(0)) / F.col(n_samples))
    return items.join(n, item, "left").agg(F.count("*").alias("n_items"), F.round(100 * F.avg(new), 2).alias("pass_rate"))


def corrected_rate(df: DataFrame, keys: list[str], correct: Column, infra: Column, flipped: Column) -> DataFrame:
    """(keys, n, n_skipped, old_rate, new_rate) in percent over rows that are no infrastructure failure; a flipped row counts as correct."""
    n = F.count_if(~infra)
    rate = lambda ok: F.round(F.coalesce(100 * F.count_if(ok & ~infra) / F.nullif(n, F.lit(0)), F.lit(0.0)), 2)
    return df.groupBy(*keys).agg(n.alias("n"), F.count_if(infra).alias("n_skipped"), rate(correct).alias("old_rate"), rate(correct | flipped).alias("new_rate"))
