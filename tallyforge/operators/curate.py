"""Curation: merging shards, gates, planning, greedy near-duplicate rejection, capped selection."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.runtime import checkpointed


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of every key. Kept by an aggregation, which combines before the exchange, not by a window."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def first_failing(gates: Column, passed: str = "passed") -> Column:
    """First element of an ordered gate list that did not pass."""
    return F.try_element_at(F.filter(gates, lambda g: ~F.coalesce(g[passed], F.lit(False))), F.lit(1))


def mutation_score(mutants: Column, least_valid: int = 5, least_score: float = 0.8) -> dict[str, Column]:
    """Valid mutants, killed ones, their share, surviving core mutants and the verdict."""
    valid = F.filter(mutants, lambda m: m["status"] == "valid")
    killed = F.filter(valid, lambda m: F.coalesce(m["killed"], F.lit(False)))
    core = F.transform(F.filter(valid, lambda m: F.coalesce(m["core"], F.lit(False)) & ~F.coalesce(m["killed"], F.lit(False))), lambda m: m["name"])
    score = F.try_divide(F.size(killed), F.size(valid))
    return {"n_valid": F.size(valid), "n_killed": F.size(killed), "score": F.round(score, 6), "core_survivors": F.array_join(F.array_sort(core), ","), "passed": F.coalesce((F.size(valid) >= least_valid) & (score >= least_score) & (F.size(core) == 0), F.lit(False))}


def mixed_radix(ordinal: Column, sizes: list[int]) -> list[Column]:
    """Digits of an ordinal, the last place running fastest."""
    out, stride = [], 1
    for n in reversed(sizes):
        out.append((F.floor(ordinal / stride) % n).cast("int"))
        stride *= n
    return out[::-1]


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Rows with their number ``i`` in the order of columns: sorted by ranges, each range starting where the ones before end."""
    parts = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    sizes = parts.groupBy("_p").agg(F.count("*").alias("n"), F.min("_i").alias("first"))
    # a row per partition
    starts = sizes.withColumn("start", F.sum("n").over(Window.orderBy("_p")) - F.col("n")).select("_p", (F.col("start") - F.col("first")).alias("shift"))
    return parts.join(F.broadcast(starts), "_p").withColumn("i", F.col("_i") + F.col("shift")).drop("_p", "_i", "shift")


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """Rows with their number, from 1, within their key: as ``row_number``, but a key of many rows is spread over as many tasks as it needs."""
    rows = numbered(df, *keys, *order)
    first = rows.groupBy(*keys).agg(F.min("i").alias("_first"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    joined = rows.alias("a").join(first.alias("b"), reduce(Column.__and__, same))
    return joined.select(*[F.col(f"a.{c}") for c in df.columns], (F.col("i") - F.col("_first") + 1).alias(name))


def interleaved(df: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Rows with their turn when the groups take turns."""
    return ranked(df, [by], order, "turn")


def shard_union(shards: list[DataFrame]) -> DataFrame:
    """All rows of all shards, columns by name, missing ones null; without a shard there is nothing to merge, an error."""
    if not shards:
        raise ValueError("there are no shards to merge")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), shards)


def capped_selection(df: DataFrame, root: str, operator: str, rank: list[Column], *, target: int, per_root: int = 8, per_pair: int = 3, operator_share: float = 0.4, min_roots: int = 0, exact: bool = True) -> DataFrame:
    """Round-robin over roots by rank, under caps per root, per root and operator, and per operator.

    In each round a root gives its best row that no cap forbids; a row whose
    operator is full is passed over for the root's next one in the same round,
    and the cap of a root counts picks. The caps within a root are windows.
    Only when the global operator cap binds does each pick depend on the
    earlier ones; then the roots, with at most ``per_pair`` rows an operator,
    are read in order until the target is met, and only those that gave a row
    are kept, so what the driver holds follows the target and not the table.
    ``turn`` is the round of the pick.
    Fewer than ``target`` rows or ``min_roots`` roots raise, unless not ``exact``.
    """
    pairs = df.withColumn("_k", F.row_number().over(Window.partitionBy(root, operator).orderBy(*rank))).where(F.col("_k") <= per_pair).drop("_k")
    placed = pairs.withColumn("turn", F.row_number().over(Window.partitionBy(root).orderBy(*rank)))
    chosen = placed.where(F.col("turn") <= per_root).orderBy("turn", root).limit(target)
    cap = int(target * operator_share)
    if not chosen.groupBy(operator).count().where(F.col("count") > cap).isEmpty():
        rows = placed.select(root, "turn", operator).orderBy(root, "turn").toLocalIterator()
        picks = df.sparkSession.createDataFrame(_walked(rows, target, per_root, cap), placed.select(F.col(root).alias("_root"), F.col("turn").alias("_place"), "turn").schema)
        chosen = placed.withColumnRenamed("turn", "_place").alias("a").join(picks.alias("b"), F.col(f"a.{root}").eqNullSafe(F.col("b._root")) & (F.col("a._place") == F.col("b._place"))).select(*df.columns, "turn")
    if exact:
        n = chosen.groupBy(root).count().agg(F.coalesce(F.sum("count"), F.lit(0)).alias("rows"), F.count("*").alias("roots")).first()
        if n.rows < target or n.roots < min_roots:
            raise ValueError(f"selection constraints exhausted at {n.rows}/{target}, roots {n.roots}/{min_roots}")
    return chosen


def _walked(rows: Iterable[Row], target: int, per_root: int, cap: int) -> list[tuple]:
    """(root, place, round) of the picks; ``rows`` are (root, place, operator) by root and place, the caps of pairs applied.

    The first round is made while reading and ends it when the target is met.
    A root without an eligible row never has one again, as operators do not
    become free.
    """
    used: Counter = Counter()
    out: list[tuple] = []
    left: dict = {}

    def pick(root: object, own: list[tuple], turn: int) -> None:
        at = next((k for k, (_, o) in enumerate(own) if used[o] < cap), None)
        if at is not None:
            place, operator = own[at]
            used[operator] += 1
            out.append((root, place, turn))
            left[root] = own[at + 1 :]
        else:
            left.pop(root, None)

    for root, own in groupby(rows, key=lambda r: r[0]):
        if len(out) == target:
            return out
        pick(root, [(place, operator) for _, place, operator in own], 1)
    for turn in range(2, per_root + 1):
        for root in list(left):
            if len(out) == target:
                return out
            pick(root, left[root], turn)
    return out


def greedy_near_duplicates(df: DataFrame, key: str, order: str, interface: str, text: str | dict[str, float], *, threshold: float = 0.8, n: int = 5, across: bool = False) -> DataFrame:
    """(key, kept, duplicate_of): scanning in order, a row is rejected when an accepted one is equal or nearly so.

    ``text`` is one column, or several with the threshold of each; one alike
    text makes two rows alike. Texts are compared within an interface; with
    ``across`` equal normalised texts count whatever the interfaces.

    Rows alike in all texts are one class, and classes meet in groups: those
    of a text (of an interface, or of all) and, by verified near pairs of the
    distinct texts, those of its neighbours; so copies are never paired.
    Round by round a class is decided by the first one not rejected in its
    groups: itself, and it is accepted, or an accepted one, and it is
    rejected, or an open one, and it waits; this equals the sequential scan.
    Texts are compared by digests, shingles and groups by 64-bit hashes. Texts of less than ``n`` tokens
    have no shingle and are all alike within an interface. Null texts and interfaces count as empty ones.
    """
    limits = {text: threshold} if isinstance(text, str) else text
    base = df.select(F.col(key).alias("key"), F.col(order).alias("ord"), F.unhex(F.md5(F.coalesce(F.col(interface), F.lit("")))).alias("i"), *[T.normalised(F.coalesce(F.col(t), F.lit(""))).alias(f"t{k}") for k, t in enumerate(limits)])
    base = base.select("key", "ord", "i", *[c for k in range(len(limits)) for c in (F.transform(T.ngrams(F.split(f"t{k}", " "), n), lambda g: F.xxhash64(g)).alias(f"g{k}"), F.unhex(F.md5(f"t{k}")).alias(f"d{k}"))])
    alike = [F.when(F.size(f"g{k}") == 0, F.unhex(F.md5(F.lit("")))).otherwise(F.col(f"d{k}")).alias(f"c{k}") for k in range(len(limits))]
    base = checkpointed(base.select("*", *alike))
    # short texts are alike within an interface, but only equal ones across
    same = ["i", *[f"c{k}" for k in range(len(limits))], *([f"d{k}" for k in range(len(limits))] if across else [])]
    rest = [c for c in base.columns if c not in ("key", "ord", *same)]
    classes = checkpointed(base.groupBy(*same).agg(F.min(F.struct("ord", "key")).alias("r"), *[F.any_value(c).alias(c) for c in rest]).select(*same, F.col("r.key").alias("key"), F.col("r.ord").alias("ord"), *rest))
    member, pairs = [], []
    for k, least in enumerate(limits.values()):
        within = F.xxhash64(F.lit(f"i{k}"), "i", f"c{k}").alias("group")
        member.append(classes.select("key", "ord", within))
        if across:
            member.append(classes.select("key", "ord", F.xxhash64(F.lit(f"d{k}"), f"d{k}").alias("group")))
        values = classes.where(F.size(f"g{k}") > 0).groupBy("i", within).agg(F.any_value(f"g{k}").alias("g"))
        pairs.append(_near_pairs(values, least))
    member = checkpointed(reduce(DataFrame.unionByName, member))
    pairs = checkpointed(reduce(DataFrame.unionByName, pairs))
    linked = pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y")))
    state = checkpointed(classes.select("key", F.lit(None).cast("string").alias("s"), F.lit(None).cast(classes.schema["key"].dataType).alias("of")))
    while not state.where("s is null").isEmpty():
        live = member.join(state.where("s is null or s = 'kept'").select("key", "s"), "key").groupBy("group").agg(F.min(F.struct("ord", "key", "s")).alias("first"))
        near = linked.join(live.withColumnRenamed("group", "x"), "x").select(F.col("y").alias("group"), "first")
        waiting = member.join(state.where("s is null").select("key"), "key").select("key", "group")
        seen = waiting.join(live.unionByName(near), "group").groupBy("key").agg(F.min("first").alias("first"))
        decided = F.when(F.col("first.key") == F.col("key"), "kept").when(F.col("first.s") == "kept", "near")
        state = checkpointed(state.join(seen, "key", "left").select("key", F.coalesce("s", decided).alias("s"), F.coalesce("of", F.when(F.col("s").isNull() & (decided == "near"), F.col("first.key"))).alias("of")))
    final = base.select("key", *same).join(classes.select(*same, F.col("key").alias("rep")), same).join(state.toDF("rep", "s", "of"), "rep")
    kept = (F.col("key") == F.col("rep")) & (F.col("s") == "kept")
    return final.select(F.col("key"), kept.alias("kept"), F.when(~kept, F.coalesce("of", F.col("rep"))).alias("duplicate_of"))


def _near_pairs(values: DataFrame, threshold: float) -> DataFrame:
    """(x, y) of the groups of one interface whose shingles reach the threshold; ``values`` are (i, group, g).

    Two sets that reach it share a shingle within a prefix of each in the
    order of the hashes, which needs no count over all rows, and of the first
    one they share the places bound how many there can be.
    """
    n = F.size("g")
    need = F.ceil(F.lit(threshold) * n - 1e-9).cast("int")
    prefix = values.select("i", "group", n.alias("n"), F.posexplode(F.slice(F.array_sort("g"), F.lit(1), n - need + 1)).alias("p", "s"))
    a, b = prefix.alias("a"), prefix.alias("b")
    most = F.lit(1) + F.least(F.col("a.n") - F.col("a.p"), F.col("b.n") - F.col("b.p")) - 1
    alike = (F.col("a.n") >= threshold * F.col("b.n") - 1e-9) & (F.col("b.n") >= threshold * F.col("a.n") - 1e-9) & (most >= F.lit(threshold / (1 + threshold)) * (F.col("a.n") + F.col("b.n")) - 1e-9)
    near = a.join(b, (F.col("a.i") == F.col("b.i")) & (F.col("a.s") == F.col("b.s")) & (F.col("a.group") < F.col("b.group")) & alike).select(F.col("a.group").alias("x"), F.col("b.group").alias("y")).distinct()
    sets = values.select("group", "g")
    return near.join(sets.toDF("x", "xg"), "x").join(sets.toDF("y", "yg"), "y").where(T.jaccard(F.col("xg"), F.col("yg")) >= threshold).select("x", "y")
