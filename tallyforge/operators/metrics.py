"""Sampling metrics with explicit denominator policies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.curate import ranked


def per_item(df: DataFrame, item: str, passed: Column, infra: Column) -> DataFrame:
    """(item, n, n_infra, n_pass, n_scored) by one partial and one final aggregation."""
    clean = passed & ~infra
    return df.groupBy(item).agg(F.count("*").alias("n"), F.count_if(infra).alias("n_infra"), F.count_if(clean).alias("n_pass"), F.count_if(~infra).alias("n_scored"))


def clean_pass_rate(df: DataFrame, item: str, passed: Column, infra: Column, policy: str = "drop") -> DataFrame:
    """Mean of the items' pass shares outside infrastructure failures, in percent.

    An item of nothing but infrastructure failures leaves the mean ("drop"),
    counts as 0 ("zero"), or the shares are pooled over all samples ("pool").
    """
    own = per_item(df, item, passed, infra)
    share = F.when(F.col("n_scored") > 0, F.col("n_pass") / F.col("n_scored"))
    rate = {"drop": F.avg(share), "zero": F.avg(F.coalesce(share, F.lit(0.0))), "pool": F.sum("n_pass") / F.nullif(F.sum("n_scored"), F.lit(0))}[policy]
    return own.agg(F.count("*").alias("n_items"), F.count_if(F.col("n_scored") == 0).alias("n_fully_infra"), F.sum("n_infra").alias("n_infra"), F.round(rate * 100, 6).alias("clean_rate"))


def clean_pass_rates(df: DataFrame, item: str, passed: Column, infra: Column) -> DataFrame:
    """The rates of :func:`clean_pass_rate` under all three policies, from one aggregation."""
    own = per_item(df, item, passed, infra)
    share = F.when(F.col("n_scored") > 0, F.col("n_pass") / F.col("n_scored"))
    every = own.agg(F.count("*").alias("n_items"), F.count_if(F.col("n_scored") == 0).alias("n_fully_infra"), F.sum("n_infra").alias("n_infra"), F.avg(share).alias("drop"), F.avg(F.coalesce(share, F.lit(0.0))).alias("zero"), (F.sum("n_pass") / F.nullif(F.sum("n_scored"), F.lit(0))).alias("pool"))
    rates = F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), F.round(F.col(p) * 100, 6).alias("clean_rate")) for p in ("drop", "zero", "pool")]))
    return every.select("n_items", "n_fully_infra", "n_infra", rates.alias("r")).select("r.policy", "n_items", "n_fully_infra", "n_infra", "r.clean_rate")


def average_at_k(df: DataFrame, item: str, sample_no: str, passed: Column, infra: Column, k: int) -> DataFrame:
    """(n_items, n_infra, avg, avg_clean, pass_at_1) in percent: shares per item rounded to 4 places, items of nothing but infrastructure failures count as 0."""
    ok = passed & ~infra
    own = df.groupBy(item).agg(F.count_if(ok).alias("p"), F.count_if(infra).alias("x"), F.max(F.when((F.col(sample_no) == 0) & ok, 1).otherwise(0)).alias("first"))
    scored = F.lit(k) - F.col("x")
    clean = F.when(scored > 0, F.round(F.col("p") / scored, 4)).otherwise(0.0)
    return own.agg(F.count("*").alias("n_items"), F.sum("x").alias("n_infra"), F.round(100 * F.avg(F.round(F.col("p") / k, 4)), 2).alias("avg"), F.round(100 * F.avg(clean), 2).alias("avg_clean"), F.round(100 * F.avg("first"), 2).alias("pass_at_1"))


def best_of_k(df: DataFrame, item: str, compiled: Column, score: Column, infra: Column, k: int) -> DataFrame:
    """(n_items, n, t, n_clean, t_clean): compiled samples and best score per item; clean: compiled over scored samples pooled, best scores of items with any scored one."""
    own = df.groupBy(item).agg(F.count_if(compiled & ~infra).alias("n"), F.coalesce(F.max(F.when(compiled & ~infra, score)), F.lit(0.0)).alias("t"), F.count_if(infra).alias("x"))
    scored = F.lit(k) * F.count("*") - F.sum("x")
    return own.agg(F.count("*").alias("n_items"), F.round(F.avg("n"), 2).alias("n"), F.round(F.avg(F.round("t", 2)), 2).alias("t"), F.round(F.when(scored > 0, F.sum("n") / scored).otherwise(0.0), 4).alias("n_clean"), F.round(F.coalesce(F.avg(F.when(F.col("x") < k, F.round("t", 2))), F.lit(0.0)), 2).alias("t_clean"))


def scored_summary(df: DataFrame, keys: list[str], infra: Column, **flags: Column) -> DataFrame:
    """(keys, n, n_skipped, and count and percent of every flag), counted over rows that are no infrastructure failure only."""
    n = F.count_if(~infra)
    each = [c for name, flag in flags.items() for c in (F.count_if(flag & ~infra).alias(name), F.round(F.coalesce(100 * F.count_if(flag & ~infra) / F.nullif(n, F.lit(0)), F.lit(0.0)), 2).alias(f"{name}_rate"))]
    return df.groupBy(*keys).agg(n.alias("n"), F.count_if(infra).alias("n_skipped"), *each)


def totals(df: DataFrame, item: str, *columns: str) -> DataFrame:
    """Totals of columns and their mean per item; null values are none."""
    own = df.groupBy(item).agg(*[F.sum(c).alias(c) for c in columns])
    return own.agg(F.count("*").alias("n_items"), *[x for c in columns for x in (F.round(F.sum(c), 4).alias(f"total_{c}"), F.round(F.coalesce(F.sum(c), F.lit(0)) / F.count("*"), 6).alias(f"mean_{c}"))])


def code_table(df: DataFrame, code: Column, column: Column, codes: list[str], columns: list[str]) -> DataFrame:
    """A row per code, the pass code first and r, R and T last, and a count per column; both lists are given, so that codes not met have a row of zeros."""
    counts = df.groupBy(code.alias("code")).agg(*[F.count_if(column == c).alias(c) for c in columns])
    last = {"r": 1, "R": 2, "T": 3}
    order = sorted(codes, key=lambda c: (c != ".", last.get(c, 0), c))
    listed = df.sparkSession.createDataFrame([(c, i) for i, c in enumerate(order)], "code string, place int")
    return F.broadcast(listed).join(counts, "code", "left").select("place", "code", *[F.coalesce(c, F.lit(0)).alias(c) for c in columns]).orderBy("place")


def truncated_rate(df: DataFrame, item: str, sample_no: str, passed: Column) -> DataFrame:
    """Mean over items of whole percents; the number of samples is the largest index, holes count as failures."""
    own = df.groupBy(item).agg(F.max(sample_no).alias("n"), F.count_if(passed).alias("n_pass"))
    return own.agg(F.count("*").alias("n_items"), F.round(F.avg(F.floor(F.col("n_pass") * 100 / F.col("n"))), 6).alias("pass_rate"))


def gini_simpson(df: DataFrame, item: str, outcome: Column) -> DataFrame:
    """Diversity of outcomes per item: 1 minus the sum of squared shares."""
    counts = df.groupBy(item, outcome.alias("_outcome")).count()
    total = F.sum("count")
    return counts.groupBy(item).agg(total.alias("n"), F.round(1 - F.sum(F.col("count") * F.col("count")) / (total * total), 6).alias("gini_simpson"))


def exact_quantile(df: DataFrame, keys: list[str], value: str, q: float = 0.5, name: str = "quantile") -> DataFrame:
    """(keys, name): the exact quantile of the values of every key, interpolated; null values do not count.

    Values are ranked by ranges, so that the values of a frequent key do not
    meet in one task; only the two around the quantile are looked up.
    """
    own = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null")
    rows = ranked(own, keys, ["_v"], "_r")
    n = own.groupBy(*keys).agg(((F.count("*") - 1) * q).alias("_at"))
    same = reduce(Column.__and__, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    near = rows.alias("a").join(n.alias("b"), same).select(*[F.col(f"a.{k}") for k in keys], "_v", "_r", "_at").where((F.col("_r") - 1 == F.floor("_at")) | (F.col("_r") - 1 == F.ceil("_at")))
    low, high = F.min("_v"), F.max("_v")
    return near.groupBy(*keys).agg((low + (high - low) * F.max(F.col("_at") - F.floor("_at"))).alias(name))


def fast_share(df: DataFrame, keys: list[str], correct: Column, speedup: Column, *, thresholds: tuple[float, ...] = (1.0, 2.0)) -> DataFrame:
    """Counts, shares above strict speed-up thresholds, exact median and mean; rows without a reference keep their place in n."""
    rows = df.select(*keys, correct.alias("_ok"), "_ref", F.when(correct, speedup).alias("_fast"))
    own = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("_ok").alias("n_correct"), F.count("_ref").alias("n_with_ref"), *[F.count_if(F.col("_fast") > t).alias(f"fast_{t:g}x") for t in thresholds], F.round(F.avg("_fast"), 6).alias("mean_speedup"))
    return own.join(exact_quantile(rows, keys, "_fast", name="_median"), keys, "left").withColumn("median_speedup", F.round("_median", 6)).drop("_median")


def histogram(df: DataFrame, keys: list[str], status: Column, values: list[str]) -> DataFrame:
    """One column per status value; the list is given, so that no extra job looks for it."""
    return df.withColumn("_status", status).groupBy(*keys).agg(*[F.count_if(F.col("_status") == v).alias(v) for v in values])


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """Unbiased estimate of passing at least once in ``k`` of ``n`` samples with ``c`` passes."""
    miss = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda p, i: p * (n - c - i) / (n - i))
    return F.when(n < k, F.lit(None).cast("double")).when(n - c < k, 1.0).otherwise(1 - miss)


def allclose(reference: Column, candidate: Column, atol: float = 1e-4, rtol: float = 1e-4) -> Column:
    """Whether two arrays have the same length and every element lies within atol + rtol * |candidate|; NaN equals NaN, a null only a null."""

    def near(x: Column, y: Column) -> Column:
        apart = F.abs(x - y) <= F.lit(atol) + F.lit(rtol) * F.abs(y)
        return F.when(x.isNull() | y.isNull(), x.isNull() & y.isNull()).when(F.isnan(x) | F.isnan(y), F.isnan(x) & F.isnan(y)).otherwise((x == y) | apart)

    same_size = F.size(reference) == F.size(candidate)
    return F.when(reference.isNull() | candidate.isNull(), reference.isNull() & candidate.isNull()).when(~same_size, False).otherwise(F.forall(F.zip_with(reference, candidate, near), lambda x: x))


def consistency(df: DataFrame, item: str, passed: Column) -> DataFrame:
    """(n_items, capable, reliable): shares of items with any and with only passing samples."""
    own = df.groupBy(item).agg(F.bool_or(passed).alias("any"), F.bool_and(passed).alias("all"))
    return own.agg(F.count("*").alias("n_items"), F.round(F.avg(F.col("any").cast("double")), 6).alias("capable"), F.round(F.avg(F.col("all").cast("double")), 6).alias("reliable"))


def ratio_drift(df: DataFrame, keys: list[str], log_ratio: Column, clip: float) -> DataFrame:
    """(keys, n, mean_log_ratio, clipped, max_ratio): how far two policies are apart; clipped is the share of ratios outside 1 -/+ clip."""
    ratio = F.exp(log_ratio)
    return df.groupBy(*keys).agg(F.count(log_ratio).alias("n"), F.round(F.avg(log_ratio), 6).alias("mean_log_ratio"), F.round(F.avg((F.abs(ratio - 1) > clip).cast("double")), 6).alias("clipped"), F.round(F.max(ratio), 6).alias("max_ratio"))
