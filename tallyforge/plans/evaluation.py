"""Queries of the metrics, verdict and log operators over the driver tables, with their SQL twins.

The tables hold no verifier output, so a verdict surface is derived: in
``events`` an item is a user, ``error`` an infrastructure failure and
``purchase`` a pass; in ``lineitem`` a sample is a line of an order and
return flag ``R`` a failure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.functions import verdict as V
from tallyforge.operators import curate, eventlog, metrics
from tallyforge.plans.catalogue import query
from tallyforge.runtime import table

_INFRA = "event_type = 'error'"
_PASS = "event_type = 'purchase'"


@query("""
with i as (select user_id, count(*) n, count(*) filter (event_type = 'error') n_infra, count(*) filter (event_type = 'purchase') n_pass from events group by user_id)
select count(*) n_items, count(*) filter (n = n_infra) n_fully_infra, cast(sum(n_infra) as bigint) n_infra, round(avg(case when n > n_infra then n_pass / (n - n_infra) end) * 100, 6) clean_rate from i
""")
def clean_pass_rate(spark: SparkSession, d: str) -> DataFrame:
    return metrics.clean_pass_rate(table(spark, d, "events"), "user_id", F.expr(_PASS), F.expr(_INFRA))


@query("""
with i as (select user_id, count(*) n, count(*) filter (event_type = 'error') x, count(*) filter (event_type = 'purchase') p from events group by user_id),
a as (select count(*) n_items, count(*) filter (n = x) n_fully_infra, cast(sum(x) as bigint) n_infra, avg(case when n > x then p / (n - x) end) d, avg(case when n > x then p / (n - x) else 0 end) z, sum(p) / sum(n - x) o from i)
select 'drop' policy, n_items, n_fully_infra, n_infra, round(d * 100, 6) clean_rate from a union all select 'zero', n_items, n_fully_infra, n_infra, round(z * 100, 6) from a union all select 'pool', n_items, n_fully_infra, n_infra, round(o * 100, 6) from a
""")
def clean_rate_policies(spark: SparkSession, d: str) -> DataFrame:
    return metrics.clean_pass_rates(table(spark, d, "events"), "user_id", F.expr(_PASS), F.expr(_INFRA))


@query("""
with i as (select l_orderkey, max(l_linenumber) n, count(*) filter (l_returnflag <> 'R') p from lineitem group by l_orderkey)
select count(*) n_items, round(avg(floor(p * 100 / n)), 6) pass_rate from i
""")
def truncated_pass_rate(spark: SparkSession, d: str) -> DataFrame:
    return metrics.truncated_rate(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", F.col("l_returnflag") != "R")


@query("""
with i as (select l_orderkey, count(*) filter (l_linestatus = 'O') compiled, count(*) filter (l_returnflag <> 'R') scored, max(case when l_linestatus = 'O' then l_discount end) best, max(case when l_linenumber = 1 and l_returnflag = 'N' then 1 else 0 end) first from lineitem group by l_orderkey)
select count(*) n_items, cast(sum(compiled) as bigint) n_compiled, round(avg(best), 6) best_of_k, round(sum(compiled) / sum(scored), 6) pooled_rate, round(avg(first) * 100, 6) pass_at_1 from i
""")
def best_of_k_and_pooled(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_linestatus") == "O").alias("compiled"), F.count_if(F.col("l_returnflag") != "R").alias("scored"), F.max(F.when(F.col("l_linestatus") == "O", F.col("l_discount"))).alias("best"), F.max(F.when((F.col("l_linenumber") == 1) & (F.col("l_returnflag") == "N"), 1).otherwise(0)).alias("first"))
    return own.agg(F.count("*").alias("n_items"), F.sum("compiled").alias("n_compiled"), F.round(F.avg("best"), 6).alias("best_of_k"), F.round(F.sum("compiled") / F.sum("scored"), 6).alias("pooled_rate"), F.round(F.avg("first") * 100, 6).alias("pass_at_1"))


@query("""
with c as (select user_id, event_type, count(*) c from events group by all)
select user_id, cast(sum(c) as bigint) n, round(1 - sum(c * c) / (sum(c) * sum(c)), 6) gini_simpson from c group by user_id
""")
def gini_simpson(spark: SparkSession, d: str) -> DataFrame:
    return metrics.gini_simpson(table(spark, d, "events"), "user_id", F.col("event_type"))


@query("""
with r as (select p_partkey, case when p_retailprice > 0 then p_retailprice end ref, p_brand from part),
j as (select p_brand, l_returnflag <> 'R' ok, ref, ref * l_quantity / l_extendedprice s from lineitem left join r on l_partkey = p_partkey)
select p_brand, count(*) n, count(*) filter (ok) n_correct, count(ref) n_with_ref, count(*) filter (ok and s > 1) fast_1x, count(*) filter (ok and s > 2) fast_2x, round(median(case when ok then s end), 6) median_speedup, round(avg(case when ok then s end), 6) mean_speedup from j group by p_brand
""")
def speedup_shares(spark: SparkSession, d: str) -> DataFrame:
    ref = table(spark, d, "part").select("p_partkey", "p_brand", F.when(F.col("p_retailprice") > 0, F.col("p_retailprice")).alias("_ref"))
    joined = table(spark, d, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice", "l_returnflag").join(ref, F.col("l_partkey") == F.col("p_partkey"), "left")
    return metrics.fast_share(joined, ["p_brand"], F.col("l_returnflag") != "R", F.col("_ref") * F.col("l_quantity") / F.col("l_extendedprice"))


@query("""
select month(ts) m, count(*) filter (event_type = 'purchase') correct, count(*) filter (event_type = 'error') timeout, count(*) filter (event_type = 'signup') compiled, count(*) filter (event_type not in ('purchase', 'error', 'signup')) compile_error from events group by 1
""")
def status_histogram(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("m", F.month("ts").cast("long"))
    status = V.ladder((F.col("event_type") == "purchase", "correct"), (F.col("event_type") == "error", "timeout"), (F.col("event_type") == "signup", "compiled"), otherwise="compile_error")
    return metrics.histogram(e, ["m"], status, ["correct", "timeout", "compiled", "compile_error"])


@query("""
select o_orderpriority, count(*) n, count(*) filter (p) n_passed from (select o_orderpriority, coalesce(bool_and(l_returnflag <> 'R'), false) p from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey, o_orderpriority) group by 1
""")
def all_tests_pass(spark: SparkSession, d: str) -> DataFrame:
    tests = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_and(F.col("l_returnflag") != "R").alias("p"))
    passed = F.coalesce("p", F.lit(False))
    return table(spark, d, "orders").join(tests, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(passed).alias("n_passed"))


@query("""
with e as (select event_type = 'error' claim, case user_id % 3 when 0 then 'worker_start' when 1 then 'made_up' end code, case when event_id % 2 = 0 then 'trusted_control_plane' else 'stdout' end channel from events),
g as (select claim, case when not claim then 'no_claim' when channel <> 'trusted_control_plane' then 'untrusted_channel' when code = 'worker_start' then 'accepted' else 'unknown_code' end reason, code from e)
select reason classification_reason, case when reason = 'accepted' then 'infrastructure' when claim then 'model' end failure_origin, case when claim and reason <> 'accepted' then code end original_code, count(*) n from g group by all
""")
def verdict_gate(spark: SparkSession, d: str) -> DataFrame:
    code = F.when(F.col("user_id") % 3 == 0, "worker_start").when(F.col("user_id") % 3 == 1, "made_up")
    channel = F.when(F.col("event_id") % 2 == 0, "trusted_control_plane").otherwise("stdout")
    return table(spark, d, "events").select(*[c.alias(k) for k, c in V.gate(F.expr(_INFRA), code, channel).items()]).groupBy("classification_reason", "failure_origin", "original_code").agg(F.count("*").alias("n"))


@query("""
select user_id, count(*) n, round(sum(case when event_type = 'error' then null when event_type = 'purchase' then 1.0 when event_type = 'signup' then 0.1 else 0.0 end), 4)::double total_reward from events group by user_id
""")
def reward_ladder(spark: SparkSession, d: str) -> DataFrame:
    r = V.reward(F.expr(_PASS), F.col("event_type") == "signup", F.expr(_INFRA))
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum(r), 4).alias("total_reward"))


@query("""
with s as (select 400 + cast(event_id % 130 as int) status, case event_id % 7 when 0 then 'Quota reached' when 1 then 'no membership' else event_type end m, event_id % 6 attempt from events)
select case when lower(m) like '%quota%' then 'quota' when lower(m) like '%membership%' then 'membership' when status in (408, 425, 429) or status >= 500 then 'transient' when status < 500 then 'client' else 'other' end kind, count(*) n, max(least(3 * pow(2, attempt), 60.0)) longest from s group by 1
""")
def error_classes(spark: SparkSession, d: str) -> DataFrame:
    m = F.when(F.col("event_id") % 7 == 0, "Quota reached").when(F.col("event_id") % 7 == 1, "no membership").otherwise(F.col("event_type"))
    kind = V.error_class((F.lit(400) + F.col("event_id") % 130), m)
    return table(spark, d, "events").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.max(V.backoff(F.col("event_id") % 6)).alias("longest"))


@query("""
select id, arg_max(record_no, (ingested_at, record_no)) record_no, count(*) deliveries from expanded group by id
""")
def last_delivery(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "expanded").select("id", "record_no", "ingested_at")
    return curate.last_wins(e, ["id"], ["ingested_at", "record_no"]).select("id", "record_no").join(e.groupBy("id").agg(F.count("*").alias("deliveries")), "id")


@query("select o_orderkey, o_custkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')")
def resume_anti_join(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(done, "o_orderkey", "left_anti").select("o_orderkey", "o_custkey")


@query("select c_custkey, c_mktsegment from customer where c_custkey in (select o_custkey from orders where o_orderstatus = 'O')")
def allow_list_semi_join(spark: SparkSession, d: str) -> DataFrame:
    allowed = table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(allowed, "c_custkey", "left_semi").select("c_custkey", "c_mktsegment")


@query("""
select s.id, coalesce(r.golden, s.reference_solution) is not null has_reference, case when r.golden is not null then 'root' else 'seed' end provenance, length(coalesce(r.golden, s.reference_solution)) n_chars from seeds s left join root_tasks r on s.id = r.id
""")
def override_join(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "root_tasks").select("id", "golden")
    best = F.coalesce("golden", "reference_solution")
    return table(spark, d, "seeds").select("id", "reference_solution").join(r, "id", "left").select("id", best.isNotNull().alias("has_reference"), F.when(F.col("golden").isNotNull(), "root").otherwise("seed").alias("provenance"), F.length(best).cast("long").alias("n_chars"))


@query("""
select event_type, count(*) n, max(event_id) last_id from events join (values ('click', 500), ('view', 3000), ('error', 100000)) c(t, m) on event_type = t and event_id <= m group by event_type
""")
def visible_at_cutoff(spark: SparkSession, d: str) -> DataFrame:
    cut = F.broadcast(spark.createDataFrame([("click", 500), ("view", 3000), ("error", 100000)], "event_type string, max_sequence long"))
    return eventlog.visible(table(spark, d, "events"), cut, "event_type", "event_id").groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))


@query("""
with g as (select candidate_no, list_filter(gates, lambda x: not coalesce(x.passed, false)) f from candidates)
select f[1].gate gate, f[1].reason reason, count(*) n from g where len(f) > 0 group by all
""")
def first_failing_gate(spark: SparkSession, d: str) -> DataFrame:
    f = curate.first_failing(F.col("gates"))
    return table(spark, d, "candidates").select(f.alias("f")).where("f is not null").groupBy(F.col("f.gate").alias("gate"), F.col("f.reason").alias("reason")).agg(F.count("*").alias("n"))


_EDGES = [(None, "view"), (None, "click"), ("view", "click"), ("click", "purchase"), ("view", "view"), ("click", "view"), ("purchase", "view"), ("click", "click")]


@query("""
with e as (select user_id, event_id, event_type, lag(event_type) over w f, row_number() over w - 1 revision from events window w as (partition by user_id order by ts, event_id))
select f from_status, event_type to_status, (coalesce(f, '-'), event_type) in (('-', 'view'), ('-', 'click'), ('view', 'click'), ('click', 'purchase'), ('view', 'view'), ('click', 'view'), ('purchase', 'view'), ('click', 'click')) legal, count(*) n, max(revision) last_revision from e group by all
""")
def legal_edges(spark: SparkSession, d: str) -> DataFrame:
    e = eventlog.edge_check(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", _EDGES)
    return e.groupBy("from_status", F.col("event_type").alias("to_status"), "legal").agg(F.count("*").alias("n"), F.max("revision").cast("long").alias("last_revision"))


@query("""
with e as (select user_id, event_id, sha256(event_type || event_id) d from events), w as (select *, case when event_id % 97 = 0 then 'broken' else lag(d) over (partition by user_id order by event_id) end p, lag(d) over (partition by user_id order by event_id) before from e)
select user_id, event_id, 'broken_chain' reason from w where p is distinct from before
""")
def chain_violations(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", F.sha2(F.concat("event_type", F.col("event_id").cast("string")), 256).alias("digest"))
    before = F.lag("digest").over(Window.partitionBy("user_id").orderBy("event_id"))
    log = e.withColumn("previous", F.when(F.col("event_id") % 97 == 0, "broken").otherwise(before)).withColumn("key", F.col("event_id"))
    return eventlog.chain_violations(log, "user_id", "event_id", "digest", "previous", "key").select("user_id", "event_id", "reason")


@query("""
select user_id, arg_max(event_type, (ts, event_id)) status, count(*) revision, arg_min(event_type, (ts, event_id)) first_status from events group by user_id
""")
def replay_state(spark: SparkSession, d: str) -> DataFrame:
    return eventlog.replay(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("""
with r as (select user_id, event_id, avg(case when event_type = 'error' then 1.0 else 0.0 end) over (partition by user_id order by ts, event_id rows between 19 preceding and current row) r from events)
select case when r >= 0.5 then 'halt' when r >= 0.3 then 'warn' else 'ok' end as level, count(*) n, round(max(r), 6) top from r group by 1
""")
def trailing_unresolved_rate(spark: SparkSession, d: str) -> DataFrame:
    return eventlog.trailing_rate(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.expr(_INFRA), 20, 0.3, 0.5).groupBy("level").agg(F.count("*").alias("n"), F.max("rate").alias("top"))


@query("""
with t as (select n_nationkey task, n_regionkey needs from nation), done as (select r_regionkey x from region where r_regionkey % 2 = 0)
select t.task, count(*) n_needs, count(x) n_done, count(*) = count(x) ready from t left join done on needs = x group by t.task
""")
def dependency_ready(spark: SparkSession, d: str) -> DataFrame:
    tasks = table(spark, d, "nation").select(F.col("n_nationkey").alias("task"), F.col("n_regionkey").alias("needs"))
    done = table(spark, d, "region").where("r_regionkey % 2 = 0").select(F.col("r_regionkey").alias("task"))
    return eventlog.ready(tasks, tasks, "task", "needs", done)


_TIP = """
with recursive chain(start, node, depth) as (
  select n_nationkey, n_nationkey, 0 from nation
  union all
  select c.start, c.node + 5, c.depth + 1 from chain c join nation n on n.n_nationkey = c.node + 5 where c.depth < 100
)
select start, max(node) as tip, max(depth) as depth from chain group by start
"""


@query(_TIP)
def supersession_tip(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    return eventlog.supersession_tips(n.select("n_nationkey", (F.col("n_nationkey") + 5).alias("successor")), "n_nationkey", "successor")


@query("""
select min(o_orderkey) filter (o_orderstatus = 'O') any_open, arg_min(o_orderkey, (o_orderpriority, o_orderdate, o_orderkey)) next_task from orders where o_orderstatus = 'O'
""")
def next_ready_task(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where("o_orderstatus = 'O'").agg(F.min("o_orderkey").alias("any_open"), F.min_by("o_orderkey", F.struct("o_orderpriority", "o_orderdate", "o_orderkey")).alias("next_task"))


@query("""
with r as (select user_id, event_type, value, avg(value) over (partition by event_type) m from events where event_type <> 'error')
select event_type, user_id, round(sum(value - m), 4) advantage from r group by all
""")
def group_advantage(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "events").where("event_type <> 'error'")
    # a row per type and user before anything is exchanged, a row per type to compare with
    sums = own.groupBy("event_type", "user_id").agg(F.sum("value").alias("s"), F.count("value").alias("n"))
    mean = F.sum("s").over(Window.partitionBy("event_type")) / F.sum("n").over(Window.partitionBy("event_type"))
    return sums.select("event_type", "user_id", F.round(F.col("s") - F.col("n") * mean, 4).alias("advantage"))


@query("select user_id, count(*) n, count(distinct event_type) = 1 degenerate from events group by user_id")
def degenerate_groups(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), (F.count_distinct("event_type") == 1).alias("degenerate"))


@query("""
select source, cast(floor(length(text) / 500) as bigint) bucket, count(*) n, round(avg(case when lang = 'en' then 1.0 else 0.0 end), 6) english from documents where text is not null group by all
""")
def length_buckets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").groupBy("source", F.floor(F.length("text") / 500).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("lang") == "en", 1.0).otherwise(0.0)), 6).alias("english"))


@query("""
with m as (select event_type, median(value) med from events group by 1), a as (select e.event_type, median(abs(value - med)) mad, any_value(med) med from events e join m using (event_type) group by 1)
select event_type, round(med, 6) med, round(mad, 6) mad, (select count(*) from events e where e.event_type = a.event_type and abs(e.value - med) > 3 * mad) outliers from a
""")
def mad_normalised(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", "value")
    # as many rows as there are types
    med = metrics.exact_quantile(e, ["event_type"], "value", name="med")
    off = e.join(med, "event_type").select("event_type", "med", F.abs(F.col("value") - F.col("med")).alias("off"))
    mad = metrics.exact_quantile(off, ["event_type"], "off", name="mad")
    far = off.join(mad, "event_type")
    return far.groupBy("event_type").agg(F.round(F.max("med"), 6).alias("med"), F.round(F.max("mad"), 6).alias("mad"), F.count_if(F.col("off") > 3 * F.col("mad")).alias("outliers"))


@query("""
select l_orderkey, count(*) filter (l_suppkey % 2 = 0 and l_returnflag <> 'R') student, count(*) filter (l_suppkey % 2 = 1 and l_returnflag <> 'R') teacher from lineitem group by 1 having student = 0 and teacher >= 1
""")
def capability_gap(spark: SparkSession, d: str) -> DataFrame:
    ok, even = F.col("l_returnflag") != "R", F.col("l_suppkey") % 2 == 0
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(ok & even).alias("student"), F.count_if(ok & ~even).alias("teacher")).where("student = 0 and teacher >= 1")


@query("""
select o_orderpriority, arg_min(l_suppkey, (l_orderkey, l_linenumber)) first_target, count(distinct l_orderkey) n_solved from lineitem join orders on l_orderkey = o_orderkey where l_returnflag = 'A' group by 1
""")
def first_verified_target(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "lineitem").where("l_returnflag = 'A'").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("o_orderpriority").agg(F.min_by("l_suppkey", F.struct("l_orderkey", "l_linenumber")).alias("first_target"), F.count_distinct("l_orderkey").alias("n_solved"))


@query("""
select case user_id % 2 when 0 then 'a' else 'b' end ckpt, event_type, count(*) n, round(count(*) / sum(count(*)) over (partition by user_id % 2), 6) share from events group by user_id % 2, event_type
""")
def failure_composition(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "events").groupBy(F.when(F.col("user_id") % 2 == 0, "a").otherwise("b").alias("ckpt"), "event_type").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("ckpt")), 6))


@query("""
select user_id, count(*) n, count(*) filter (event_type = 'purchase') c, case when n < 3 then null when n - c < 3 then 1.0 else round(1 - (n - c) / n * (n - c - 1) / (n - 1) * (n - c - 2) / (n - 2), 6) end pass_at_3 from events group by user_id
""")
def pass_at_k(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.expr(_PASS)).alias("c"))
    return own.withColumn("pass_at_3", F.round(metrics.pass_at_k(F.col("n").cast("double"), F.col("c").cast("double"), 3), 6))


@query("""
select cast(hour(ts) as bigint) h, count(*) n, round(exp(avg(ln(value + 1))), 6) geo, count(*) filter (value > 50) clipped, round(max(value), 6) top from events group by 1
""")
def drift_statistics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.hour("ts").cast("long").alias("h")).agg(F.count("*").alias("n"), F.round(F.exp(F.avg(F.log(F.col("value") + 1))), 6).alias("geo"), F.count_if(F.col("value") > 50).alias("clipped"), F.round(F.max("value"), 6).alias("top"))


@query("""
with e as (select vec_id, embedding x, label from embeddings), j as (select a.vec_id, list_sum(list_transform(list_zip(a.x, b.x), lambda p: case when abs(p[1] - p[2]) <= 0.01 + 0.5 * abs(p[2]) then 0 else 1 end)) n_diff from e a join e b on b.vec_id = a.vec_id + 1)
select vec_id, cast(n_diff as bigint) n_diff, n_diff = 0 allclose from j
""")
def allclose_neighbours(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    off = F.zip_with("embedding", "other", lambda x, y: F.when(F.abs(x - y) <= F.lit(0.01) + F.lit(0.5) * F.abs(y), 0).otherwise(1))
    return e.join(nxt, "vec_id").select("vec_id", F.aggregate(off, F.lit(0), lambda a, x: a + x).cast("long").alias("n_diff")).withColumn("allclose", F.col("n_diff") == 0)


@query("""
select coalesce(a.k, b.k) event_type, a.n is null only_late, b.n is null only_early, coalesce(a.n, 0) early, coalesce(b.n, 0) late from (select event_type k, count(*) n from events where event_id % 2 = 0 group by 1) a full join (select event_type k, count(*) n from events where event_id % 2 = 1 group by 1) b on a.k = b.k
""")
def key_difference(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    a = e.where("event_id % 2 = 0").groupBy("event_type").agg(F.count("*").alias("x"))
    b = e.where("event_id % 2 = 1").groupBy("event_type").agg(F.count("*").alias("y"))
    return a.join(b, "event_type", "full").select("event_type", F.isnull("x").alias("only_late"), F.isnull("y").alias("only_early"), F.coalesce("x", F.lit(0)).alias("early"), F.coalesce("y", F.lit(0)).alias("late"))


@query("""
select time_bucket(interval 1 day, ts) start, event_type, count(*) n, round(sum(value), 4) total from events group by all
""")
def tumbling_windows(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("""
with s as (select event_id, value, time_bucket(interval 6 hour, ts) - interval 6 hour * k start from events, range(2) t(k))
select start, count(*) n, round(sum(value), 4) total from s group by 1
""")
def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "events").groupBy(F.window("ts", "12 hours", "6 hours").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "total")


@query("""
with l as (select user_id, ts, case when ts >= lag(ts) over (partition by user_id order by ts) + interval 6 hour then 1 else 0 end fresh from events), g as (select *, sum(fresh) over (partition by user_id order by ts) s from l)
select user_id, min(ts) start, count(*) n from g group by user_id, s
""")
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("""
with e as (select vec_id, embedding x from embeddings),
j as (select a.vec_id, list_transform(a.x, lambda v, i: case when i = 2 and a.vec_id % 3 = 0 then 'nan'::double else v::double end) x, case when a.vec_id % 5 = 0 then list_transform(a.x, lambda v: v::double)[1:3] else list_transform(a.x, lambda v, i: case when i = 2 and a.vec_id % 3 <> 1 then 'nan'::double when a.vec_id % 7 = 0 then v::double + 0.5 else v::double end) end y from e a)
select vec_id, len(x) = len(y) and len(list_filter(list_zip(x, y), lambda p: not (case when isnan(p[1]) or isnan(p[2]) then isnan(p[1]) and isnan(p[2]) else abs(p[1] - p[2]) <= 0.0001 + 0.0001 * abs(p[2]) end))) = 0 allclose from j
""")
def allclose_with_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Arrays against copies that are shorter, shifted, or hold NaN in some places."""
    e = table(spark, d, "embeddings").select("vec_id", F.expr("transform(embedding, x -> cast(x as double))").alias("v"))
    nan = F.lit(float("nan"))
    k = F.col("vec_id")
    x = F.transform("v", lambda v, i: F.when((i == 1) & (k % 3 == 0), nan).otherwise(v))
    y = F.when(k % 5 == 0, F.slice("v", 1, 3)).otherwise(F.transform("v", lambda v, i: F.when((i == 1) & (k % 3 != 1), nan).when(k % 7 == 0, v + 0.5).otherwise(v)))
    return e.select("vec_id", metrics.allclose(x, y).alias("allclose"))


@query("""
with i as (select l_orderkey, bool_or(l_returnflag <> 'R') a, bool_and(l_returnflag <> 'R') b from lineitem group by 1)
select count(*) n_items, round(avg(a::int), 6) capable, round(avg(b::int), 6) reliable from i
""")
def capability_and_reliability(spark: SparkSession, d: str) -> DataFrame:
    return metrics.consistency(table(spark, d, "lineitem"), "l_orderkey", F.col("l_returnflag") != "R")


@query("""
with e as (select event_type, (value - 50) / 200 r from events)
select event_type, count(r) n, round(avg(r), 6) mean_log_ratio, round(avg((abs(exp(r) - 1) > 0.2)::int), 6) clipped, round(max(exp(r)), 6) max_ratio from e group by 1
""")
def ratio_drift(spark: SparkSession, d: str) -> DataFrame:
    return metrics.ratio_drift(table(spark, d, "events"), ["event_type"], (F.col("value") - 50) / 200, 0.2)
