"""Append-only logs: integrity checks, replay, visibility at a cutoff, dependencies, supersession."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.runtime import checkpointed


def chain_digest(payload: Column, previous: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.coalesce(previous, F.lit("")), payload), 256)


def chain_violations(df: DataFrame, log: str, sequence: str, digest: str, previous: str, key: str) -> DataFrame:
    """Records whose previous digest, order or idempotency key breaks the chain, with the first reason."""
    w = Window.partitionBy(log).orderBy(sequence)
    before = F.lag(digest).over(w)
    again = F.count("*").over(Window.partitionBy(log, key))
    reason = F.when(~F.col(previous).eqNullSafe(before), "broken_chain").when(F.lag(sequence).over(w) == F.col(sequence), "repeated_sequence").when(again > 1, "repeated_key")
    return df.withColumn("reason", reason).where("reason is not null")


def edge_check(df: DataFrame, entity: str, order: list[str], status: str, edges: list[tuple[str | None, str]]) -> DataFrame:
    """Every event with the status before it, its revision, and whether the step is a permitted one."""
    w = Window.partitionBy(entity).orderBy(*order)
    before = F.lag(status).over(w)
    legal = F.lit(False)
    for a, b in edges:
        legal = legal | (before.eqNullSafe(F.lit(a)) & (F.col(status) == b))
    return df.withColumn("from_status", before).withColumn("revision", F.row_number().over(w) - 1).withColumn("legal", legal)


def replay(df: DataFrame, entity: str, order: list[str], status: str) -> DataFrame:
    """Materialised state: last status and number of events of each entity, by one combining aggregation."""
    return df.groupBy(entity).agg(F.max_by(status, F.struct(*order)).alias("status"), F.count("*").alias("revision"), F.min_by(status, F.struct(*order)).alias("first_status"))


def visible(df: DataFrame, cutoffs: DataFrame, log: str, sequence: str) -> DataFrame:
    """Records at or before the inclusive cutoff of their log; a log without cutoff is not visible."""
    return df.join(cutoffs.withColumnRenamed("max_sequence", "_max"), log).where(F.col(sequence) <= F.col("_max")).drop("_max")


def ready(tasks: DataFrame, edges: DataFrame, task: str, needs: str, done: DataFrame) -> DataFrame:
    """(task, n_needs, n_done, ready): a task is ready when all it needs is done, or it needs nothing."""
    got = edges.join(done.select(F.col(task).alias(needs), F.lit(1).alias("_d")), needs, "left").groupBy(task).agg(F.count("*").alias("n_needs"), F.count("_d").alias("n_done"))
    return tasks.select(task).join(got, task, "left").select(task, F.coalesce("n_needs", F.lit(0)).alias("n_needs"), F.coalesce("n_done", F.lit(0)).alias("n_done"), (F.coalesce("n_needs", F.lit(0)) == F.coalesce("n_done", F.lit(0))).alias("ready"))


def trailing_rate(df: DataFrame, by: str, order: list[str], flag: Column, rows: int, warn: float, halt: float) -> DataFrame:
    """Share of flagged rows among the last ``rows``, with its level."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(1 - rows, 0)
    rate = F.avg(flag.cast("double")).over(w)
    return df.withColumn("rate", F.round(rate, 6)).withColumn("level", F.when(rate >= halt, "halt").when(rate >= warn, "warn").otherwise("ok"))


def supersession_tips(df: DataFrame, key: str, successor: str) -> DataFrame:
    """(start, tip, depth): the last record of every record's chain of successors, and the steps to it.

    Pointers are doubled until none changes, so a chain of n records takes
    about log2(n) rounds. A null successor, or one that is no record, ends the
    chain. A repeated key or a cycle raises.
    """
    rows = checkpointed(df.select(F.col(key).alias("start"), F.col(successor).alias("next")))
    if not rows.groupBy("start").count().where("count > 1").isEmpty():
        raise ValueError(f"{key} is not unique")
    ends = rows.select(F.col("start").alias("next"), F.lit(True).alias("_is"))
    state = checkpointed(rows.join(ends, "next", "left").select("start", F.when(F.col("_is"), F.col("next")).alias("next")).select("start", F.coalesce("next", "start").alias("tip"), F.col("next").isNotNull().cast("int").alias("depth"), F.col("next").isNull().alias("done")))
    # after k rounds a pointer spans 2**k steps, more than there are records only in a cycle
    most, span = state.count(), 1
    while not state.where("not done").isEmpty():
        if span > most:
            raise ValueError(f"the successors of {successor} form a cycle")
        further = state.select(F.col("start").alias("tip"), F.col("tip").alias("_tip"), F.col("depth").alias("_depth"), F.col("done").alias("_done"))
        state = checkpointed(state.join(further, "tip").select("start", F.col("_tip").alias("tip"), (F.col("depth") + F.col("_depth")).alias("depth"), F.col("_done").alias("done")))
        span *= 2
    return state.select("start", "tip", "depth")


def committed(df: DataFrame, transition: str, kind: str) -> DataFrame:
    """Prepared records of transitions that were committed and not aborted; others are not visible."""
    ends = df.where(F.col(kind).isin("commit", "abort")).groupBy(transition).agg(F.bool_or(F.col(kind) == "commit").alias("_c"), F.bool_or(F.col(kind) == "abort").alias("_a"))
    return df.where(F.col(kind) == "prepare").join(ends.where("_c and not _a").select(transition), transition, "left_semi")


def in_force(decisions: DataFrame, key: str, successor: str, expires: str, at: Column) -> DataFrame:
    """(key, tip, valid): the decision that stands for each one at a time; a tip that has expired is none."""
    tips = supersession_tips(decisions, key, successor)
    until = decisions.select(F.col(key).alias("tip"), F.col(expires).alias("_until"))
    return tips.join(until, "tip").select(F.col("start").alias(key), "tip", (F.col("_until").isNull() | (F.col("_until") > at)).alias("valid"))


def invalidated(edges: DataFrame, node: str, needs: str, broken: DataFrame) -> DataFrame:
    """(node, distance) of all that depends on a broken node, over any number of steps, and of the broken ones (0).

    Only the nodes reached last are joined with the edges again, so a round
    costs as much as the frontier; a cycle ends when nothing new is reached.
    """
    seen = checkpointed(broken.select(F.col(node).alias("node"), F.lit(0).alias("distance")).distinct())
    frontier, step = seen, 0
    pairs = edges.select(F.col(node).alias("_to"), F.col(needs).alias("node"))
    while not frontier.isEmpty():
        step += 1
        reached = pairs.join(frontier.select("node"), "node").select(F.col("_to").alias("node")).distinct()
        frontier = checkpointed(reached.join(seen.select("node"), "node", "left_anti").select("node", F.lit(step).alias("distance")))
        seen = seen.unionByName(frontier)
    return seen


def reconciled(tasks: DataFrame, attempts: DataFrame, task: str, status: str, attempt_status: str, rules: dict[tuple[str | None, str | None], str]) -> DataFrame:
    """(task, task_status, attempt_status, action) of tasks and their current attempts, either of which may be missing; a pair without a rule is a conflict."""
    both = tasks.select(task, F.col(status).alias("task_status")).join(attempts.select(task, F.col(attempt_status).alias("attempt_status")), task, "full")
    action = F.lit("conflict")
    for (a, b), name in rules.items():
        action = F.when(F.col("task_status").eqNullSafe(F.lit(a)) & F.col("attempt_status").eqNullSafe(F.lit(b)), name).otherwise(action)
    return both.withColumn("action", action)


def replay_strict(df: DataFrame, entity: str, order: list[str], status: str, edges: list[tuple[str | None, str]], revision: str | None = None) -> DataFrame:
    """As :func:`replay`, but a step that is not permitted, or a revision that is not the number of events before, is an error."""
    checked = edge_check(df, entity, order, status, edges)
    fine = F.col("legal") if revision is None else F.col("legal") & (F.col(revision) == F.row_number().over(Window.partitionBy(entity).orderBy(*order)) - 1)
    named = F.concat(F.lit(f"illegal event of {entity} "), F.col(entity).cast("string"))
    return replay(checked.where(F.assert_true(F.coalesce(fine, F.lit(False)), named).isNull()), entity, order, status)
