"""Plans of candidates from roots and contracts, gates on what comes of them, and shards of work."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.operators.curate import mixed_radix

#: A contract: its name, the task classes it applies to, and its parameters with their values.
Contract = tuple[str, list[str], dict[str, list[str]]]
#: Turns after which a root is given up.
TURNS = 256


def planned(roots: DataFrame, root: str, task_class: str, contracts: list[Contract], wave: int) -> DataFrame:
    """(root, turn, operator, signature): the first ``wave`` different combinations of every root.

    The contracts that apply take turns, beginning at one that a hash of the
    root chooses; each counts through its parameters, the first one fastest. A
    root with fewer combinations than ``wave`` gets what there is. Nothing is
    shuffled: a root's turns are a sequence in its own row.
    """
    applies = F.filter(F.array(*[F.struct(F.lit(i).alias("at"), F.lit(name).alias("operator"), F.array(*map(F.lit, classes)).alias("classes"), F.lit(reduce(int.__mul__, map(len, p.values()), 1)).alias("n")) for i, (name, classes, p) in enumerate(contracts)]), lambda c: F.array_contains(c["classes"], F.col(task_class)))
    own = roots.select(F.col(root).alias("root"), applies.alias("c")).where(F.size("c") > 0)
    size = F.size("c")
    rotation = T.hash64_mod_by(F.col("root"), size)
    turns = F.transform(F.sequence(F.lit(0), F.lit(TURNS)), lambda i: F.struct(F.element_at("c", (F.pmod(i + rotation, size) + 1).cast("int")).alias("c"), F.floor(i / size).alias("k"), i.alias("i")))
    # a contract counts each of its combinations once
    fresh = F.slice(F.filter(turns, lambda x: x["k"] < x["c"]["n"]), 1, wave)
    flat = own.select("root", F.posexplode(fresh).alias("turn", "x")).select("root", "turn", F.col("x.c.operator").alias("operator"), "x.k")
    signature = F.lit(None).cast("string")
    for name, _, parameters in contracts:
        places = mixed_radix(F.col("k"), [len(v) for v in parameters.values()][::-1])[::-1]
        by_key = sorted(zip(parameters, places, strict=True), key=lambda x: x[0])
        parts = [F.concat(F.lit(f"{key}="), F.element_at(F.array(*map(F.lit, parameters[key])), place + 1)) for key, place in by_key]
        signature = F.when(F.col("operator") == name, F.array_join(F.array(*parts), ",")).otherwise(signature)
    return flat.select("root", "turn", "operator", signature.alias("signature"))


def plan_summary(plan: DataFrame) -> DataFrame:
    """(operator, n_tasks, n_roots, fingerprint) and a row with a null operator for the whole plan.

    The fingerprint adds up a hash of every task, so it does not depend on
    their order and nothing is gathered in one place.
    """
    h = F.sum(F.conv(F.substring(T.digest(F.concat_ws("|", "root", "operator", "signature")), 1, 10), 16, 10).cast("decimal(20,0)"))
    return plan.rollup("operator").agg(F.count("*").alias("n_tasks"), F.count_distinct("root").alias("n_roots"), h.cast("string").alias("fingerprint"))


def sample_grid(items: DataFrame, item: str, k: int) -> DataFrame:
    """Every item with the numbers of its ``k`` samples."""
    return items.select(item, F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("sample"))


def difficulty(attempts: DataFrame, item: str, role: str, passed: Column, teacher: str = "teacher_child", parent: str = "panel_parent", child: str = "panel_child") -> DataFrame:
    """(item, teacher_passes, parent, child, solver_delta, passed): hard enough when a teacher passes and the child falls at least one below its parent."""
    n = lambda who: F.count_if((F.col(role) == who) & passed)
    own = attempts.groupBy(item).agg(n(teacher).alias("teacher_passes"), F.least(n(parent), F.lit(1)).alias("parent"), F.least(n(child), F.lit(1)).alias("child"))
    return own.withColumn("solver_delta", F.col("parent") - F.col("child")).withColumn("passed", (F.col("teacher_passes") >= 1) & (F.col("child") <= F.col("parent") - 1))


def contract_gate(expected: Column, judged: Column) -> Column:
    """(passed, missing): all that is expected is covered, no issue is raised, and the judge says so; ``judged`` as of ``extract.judged_json``."""
    missing = F.array_sort(F.array_except(expected, F.coalesce(judged["covered"], F.array().cast("array<string>"))))
    passed = judged["problem"].isNull() & F.coalesce(judged["passed"], F.lit(False)) & (F.size(F.coalesce(judged["issues"], F.array().cast("array<string>"))) == 0) & (F.size(missing) == 0)
    return F.struct(F.coalesce(passed, F.lit(False)).alias("passed"), missing.alias("missing"))


def interface_gate(module: Column, golden: Column, tests: Column, expected: Column) -> Column:
    """First reason why a file does not have the expected interface, the ports in order; null when it has."""
    actual = F.transform(T.port_list(golden), lambda p: p["name"])
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return F.when(blank(golden) | blank(tests), "empty golden or test").when(~F.contains(golden, F.concat(F.lit("module "), module)), "module not declared").when(expected.isNotNull() & (actual != expected), "interface mismatch")


def contiguous_shard(index: Column, total: Column | int, shards: int) -> Column:
    """Shard of a row when each takes the same number of consecutive rows, the last one what is left."""
    return F.floor(index / F.ceil((F.lit(total) if isinstance(total, int) else total) / shards))


def round_robin_shard(index: Column, shards: int) -> Column:
    return F.pmod(index, F.lit(shards))


def upper_bound(share: float, n: Column) -> Column:
    """A share of a number, rounded half up, 1 at least."""
    return F.greatest(F.lit(1), F.floor(F.lit(share) * n + 0.5))


def leased(expires: Column, now: Column) -> Column:
    return F.coalesce(expires > now, F.lit(False))


def decontaminated(df: DataFrame, held_out: DataFrame, axes: dict[str, Column], held_axes: dict[str, Column]) -> DataFrame:
    """Rows of ``df`` with ``axis``, the first axis (in order) on which they equal a held-out row, or null; empty values equal nothing.

    Held-out digests are made distinct before the join, and one join serves
    all axes, so a row is exploded to at most one row per axis.
    """
    digests = lambda a: F.array(*[F.struct(F.lit(i).alias("at"), F.lit(name).alias("axis"), T.digest(c).alias("d")) for i, (name, c) in enumerate(a.items())])
    held = held_out.select(F.explode(digests(held_axes)).alias("x")).select("x.axis", "x.d").where(F.col("d") != T.digest(F.lit(""))).distinct()
    keyed = df.withColumn("_row", F.monotonically_increasing_id()) if "_row" not in df.columns else df
    hits = keyed.select("_row", F.explode(digests(axes)).alias("x")).select("_row", "x.at", "x.axis", "x.d").join(held, ["axis", "d"], "left_semi").groupBy("_row").agg(F.min_by("axis", "at").alias("axis"))
    return keyed.join(hits, "_row", "left").drop("_row")


def composed(df: DataFrame, root: str, rank: list[Column], per_root: int, target: int) -> DataFrame:
    """Coverage first: every root's best row, then second ones and so on up to the cap, until there are ``target``."""
    turn = F.row_number().over(Window.partitionBy(root).orderBy(*rank))
    return df.withColumn("turn", turn).where(F.col("turn") <= per_root).orderBy("turn", root).limit(target)
