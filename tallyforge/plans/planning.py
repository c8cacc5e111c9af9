"""Queries of plans, gates, shards, composition and logs of transitions and decisions, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import extract as X
from tallyforge.functions import text as T
from tallyforge.operators import curate, eventlog, planning
from tallyforge.plans.catalogue import query
from tallyforge.runtime import table

_ALL = ["combinational_arithmetic", "sequential_counter", "fsm_protocol", "stream", "memory_shared_resource"]
_STATEFUL = ["stream", "fsm_protocol", "memory_shared_resource"]
#: Contracts with the classes they apply to and their parameters (fixed values).
CONTRACTS = [
    ("controllerize_datapath", _ALL, {"latency": ["2", "4", "8"], "start_mode": ["pulse", "level_until_accept"], "result_mode": ["done_pulse", "done_until_ack"]}),
    ("add_handshake_backpressure", _ALL, {"capacity": ["1", "2", "4"], "latency": ["1", "2", "4"], "flow": ["registered", "elastic"]}),
    ("add_buffer_fifo", _STATEFUL, {"depth": ["2", "4", "8"]}),
    ("add_timeout_retry_recovery", _STATEFUL, {"timeout": ["3", "5", "8"], "retries": ["1", "2", "3"]}),
    ("add_arbitration_or_burst", _STATEFUL, {"mode": ["fixed-2", "rr-2", "rr-4", "burst-2", "burst-4", "burst-8"]}),
]
WAVE = 12

_PLAN = """
with c(pos, op, n, few) as (values (0, 'controllerize_datapath', 12, true), (1, 'add_handshake_backpressure', 18, true), (2, 'add_buffer_fifo', 3, false), (3, 'add_timeout_retry_recovery', 9, false), (4, 'add_arbitration_or_burst', 6, false)),
r as (select id, case when task_class in ('stream', 'fsm_protocol', 'memory_shared_resource') then 5 else 2 end m, cast('0x' || substr(sha256(id), 1, 16) as ubigint) h from root_tasks where task_class in ('combinational_arithmetic', 'sequential_counter', 'fsm_protocol', 'stream', 'memory_shared_resource')),
t as (select id, i, i // m k, cast((i + h % m) % m as int) pos from r, range(257) x(i)),
f as (select id, row_number() over (partition by id order by i) - 1 turn, op, k from t join c using (pos) where k < n qualify turn < 12),
p as (select id root, turn, op as operator, case op
 when 'controllerize_datapath' then 'latency=' || ['2', '4', '8'][k % 3 + 1] || ',result_mode=' || ['done_pulse', 'done_until_ack'][k // 6 % 2 + 1] || ',start_mode=' || ['pulse', 'level_until_accept'][k // 3 % 2 + 1]
 when 'add_handshake_backpressure' then 'capacity=' || ['1', '2', '4'][k % 3 + 1] || ',flow=' || ['registered', 'elastic'][k // 9 % 2 + 1] || ',latency=' || ['1', '2', '4'][k // 3 % 3 + 1]
 when 'add_buffer_fifo' then 'depth=' || ['2', '4', '8'][k % 3 + 1]
 when 'add_timeout_retry_recovery' then 'retries=' || ['1', '2', '3'][k // 3 % 3 + 1] || ',timeout=' || ['3', '5', '8'][k % 3 + 1]
 else 'mode=' || ['fixed-2', 'rr-2', 'rr-4', 'burst-2', 'burst-4', 'burst-8'][k % 6 + 1] end signature from f)
"""


def _plan(spark: SparkSession, d: str) -> DataFrame:
    return planning.planned(table(spark, d, "root_tasks"), "id", "task_class", CONTRACTS, WAVE)


@query(_PLAN + "select root, turn, operator, signature from p")
def candidate_plan(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d).select("root", F.col("turn").cast("long").alias("turn"), "operator", "signature")


@query(_PLAN + "select operator, count(*) n_tasks, count(distinct root) n_roots, sum(cast('0x' || substr(sha256(root || '|' || operator || '|' || signature), 1, 10) as bigint))::varchar fingerprint from p group by rollup (operator)")
def plan_summary(spark: SparkSession, d: str) -> DataFrame:
    return planning.plan_summary(_plan(spark, d))


@query("select id, k::int sample from root_tasks, range(5) x(k) where task_class = 'stream'")
def sample_grid(spark: SparkSession, d: str) -> DataFrame:
    return planning.sample_grid(table(spark, d, "root_tasks").where("task_class = 'stream'"), "id", 5)


@query("""
with a as (select user_id, count(*) filter (event_id % 4 < 2 and value > 40) t, least(count(*) filter (event_id % 4 = 2 and value > 20), 1) p, least(count(*) filter (event_id % 4 = 3 and value > 220), 1) c from events group by 1)
select user_id, t teacher_passes, p parent, c child, p - c solver_delta, t >= 1 and c <= p - 1 passed from a
""")
def difficulty_gate(spark: SparkSession, d: str) -> DataFrame:
    role = F.element_at(F.array(*map(F.lit, ["teacher_child", "teacher_child", "panel_parent", "panel_child"])), (F.col("event_id") % 4 + 1).cast("int"))
    e = table(spark, d, "events").withColumn("role", role)
    least = F.when(F.col("role") == "teacher_child", 40).when(F.col("role") == "panel_parent", 20).otherwise(220)
    return planning.difficulty(e, "user_id", "role", F.col("value") > least)


@query("""
with c as (select candidate_no n, list_sort(list_distinct(task.test_obligations)) o, candidate_no % 5 k from candidates where task.test_obligations is not null),
j as (select n, o, k, case when k = 1 then o[2:] else o end v from c)
select n candidate_no, k not in (2, 3, 4) and len(list_filter(o, lambda x: not list_contains(v, x))) = 0 passed, case when k = 2 then array_to_string(o, ',') else array_to_string(list_filter(o, lambda x: not list_contains(v, x)), ',') end missing, case k when 2 then 'no_object' when 4 then 'no_passed' end problem from j
""")
def contract_judgements(spark: SparkSession, d: str) -> DataFrame:
    """Judgements in prose: the covered obligations as JSON, sometimes one too few, no object, an issue, or no verdict."""
    own = F.array_sort(F.array_distinct("task.test_obligations"))
    c = table(spark, d, "candidates").where("task.test_obligations is not null").select("candidate_no", F.col("task.test_obligations").alias("expected"), own.alias("o"), (F.col("candidate_no") % 5).alias("k"))
    covered = F.when(F.col("k") == 1, F.slice("o", F.lit(2), F.greatest(F.size("o"), F.lit(1)))).otherwise(F.col("o"))
    body = F.concat(F.when(F.col("k") == 4, '{"passed": "yes", ').otherwise('{"passed": true, '), F.when(F.col("k") == 3, '"issues": ["x"], ').otherwise('"issues": [], '), F.lit('"covered_obligations": '), F.to_json(covered), F.lit("}"))
    text = F.when(F.col("k") == 2, "I cannot tell.").otherwise(F.concat(F.lit("Here is my verdict:\n"), body, F.lit("\nDone.")))
    judged = c.select("candidate_no", "expected", X.judged_json(text).alias("j"))
    gate = planning.contract_gate(F.col("expected"), F.col("j"))
    return judged.select("candidate_no", gate["passed"].alias("passed"), F.array_join(gate["missing"], ",").alias("missing"), "j.problem")


@query(r"""
with r as (select root_no, module_name m, coalesce(golden, '') g, coalesce(tests, '') t, list_transform(ports, lambda p: p.name) e, regexp_extract(coalesce(golden, ''), '(?is)\bmodule\s+[a-z_]\w*\s*\((.*?)\)\s*;', 1) h from root_tasks),
a as (select *, list_filter(list_transform(regexp_extract_all(case when h = '' then g else h end, '(?i)\b(?:input|output|inout)\b[^,;()]*'), lambda d: regexp_extract(d, '(?i)^(?:input|output|inout)\s*(?:wire|reg|logic)?\s*(?:signed\b|unsigned\b)?\s*(?:\[[^\]]*\])?\s*([a-z_]\w*)', 1)), lambda n: n <> '') p from r)
select root_no, case when trim(g) = '' or trim(t) = '' then 'empty golden or test' when not contains(g, 'module ' || m) then 'module not declared' when e is not null and list_distinct(p) is not null and array_to_string(list_filter(p, lambda x, i: list_position(p, x) = i), ',') <> array_to_string(e, ',') then 'interface mismatch' end problem from a
""")
def interface_gate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "root_tasks").select("root_no", planning.interface_gate(F.col("module_name"), F.col("golden"), F.col("tests"), F.transform("ports", lambda p: p["name"])).alias("problem"))


@query("""
with n as (select count(*) n from orders), o as (select o_orderkey k, row_number() over (order by o_orderkey) - 1 i from orders)
select cast(floor(i / ceil(n / 7)) as bigint) shard, count(*) n_rows, min(k) first_key, max(k) last_key, count(*) filter (i % 7 = 3) n_third, cast(greatest(1, floor(0.4 * count(*) + 0.5)) as bigint) as bound from o, n group by 1
""")
def contiguous_shards(spark: SparkSession, d: str) -> DataFrame:
    """Seven shards of consecutive keys; rows are numbered by range-partitioned offsets, not in one task."""
    o = curate.numbered(table(spark, d, "orders").select("o_orderkey"), "o_orderkey")
    return o.groupBy(planning.contiguous_shard(F.col("i"), o.count(), 7).alias("shard")).agg(F.count("*").alias("n_rows"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"), F.count_if(planning.round_robin_shard(F.col("i"), 7) == 3).alias("n_third")).withColumn("bound", planning.upper_bound(0.4, F.col("n_rows")))


@query("""
select event_type, count(*) n, count(*) filter (ts + interval 6 hour > timestamp '2024-01-15 00:00:00') n_leased from events group by 1
""")
def live_leases(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(planning.leased(F.expr("ts + interval 6 hours"), now)).alias("n_leased"))


@query("""
with h as (select s.original_prompt p, r.golden g, list_transform(r.ports, lambda x: x.direction || ':' || x.name || ':' || x.width) i from seeds s join root_tasks r using (id) where s.split = 'heldout'),
c as (select candidate_no, prompt p, golden g, list_transform(task.ports, lambda x: x.direction || ':' || x.name || ':' || x.width) i from candidates)
select candidate_no, case when coalesce(c.p, '') <> '' and c.p in (select p from h where p is not null) then 'prompt' when coalesce(c.g, '') <> '' and c.g in (select g from h where g is not null) then 'reference' when len(c.i) > 0 and array_to_string(c.i, '|') in (select array_to_string(i, '|') from h where i is not null) then 'interface' end axis from c
""")
def decontamination(spark: SparkSession, d: str) -> DataFrame:
    """The first axis on which a candidate equals a held-out root."""
    port = lambda c: F.array_join(F.transform(c, lambda p: F.concat_ws(":", p["direction"], p["name"], p["width"])), "|")
    axes = lambda prompt, golden, ports: {"prompt": F.coalesce(prompt, F.lit("")), "reference": F.coalesce(golden, F.lit("")), "interface": F.coalesce(port(ports), F.lit(""))}
    held = table(spark, d, "seeds").where("split = 'heldout'").select("id", "original_prompt").join(table(spark, d, "root_tasks").select("id", "golden", "ports"), "id")
    c = table(spark, d, "candidates").withColumnRenamed("candidate_no", "_row")
    out = planning.decontaminated(c.select("_row", F.col("_row").alias("candidate_no"), "prompt", "golden", "task"), held, axes(F.col("prompt"), F.col("golden"), F.col("task.ports")), axes(F.col("original_prompt"), F.col("golden"), F.col("ports")))
    return out.select("candidate_no", "axis")


@query("""
select candidate_no, root, turn from (select candidate_no, task.root_id root, row_number() over (partition by task.root_id order by candidate_no desc) turn from candidates) where turn <= 4 order by turn, root limit 400
""")
def coverage_first(spark: SparkSession, d: str) -> DataFrame:
    """Top-k report: 400 candidates, every root's last one first."""
    c = table(spark, d, "candidates").select("candidate_no", F.col("task.root_id").alias("root"))
    return planning.composed(c, "root", [F.col("candidate_no").desc()], 4, 400).withColumn("turn", F.col("turn").cast("long"))


@query("""
with t as (select user_id x, event_id, case when event_type = 'purchase' then 'commit' when event_type = 'error' then 'abort' else 'prepare' end k from events)
select event_id, x user_id from t where k = 'prepare' and x in (select x from t where k = 'commit') and x not in (select x from t where k = 'abort')
""")
def committed_records(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "commit").when(F.col("event_type") == "error", "abort").otherwise("prepare")
    return eventlog.committed(table(spark, d, "events").withColumn("kind", kind), "user_id", "kind").select("event_id", "user_id")


_CHAIN = "case when {k} % 5 < 4 then {k} + 1 end"


@query("""
with t as (select c_custkey k, least(c_custkey + 4 - c_custkey % 5, (select max(c_custkey) from customer)) tip from customer)
select t.k c_custkey, tip, (c_acctbal < 0 or c_acctbal > 4000) valid from t join customer c on c.c_custkey = tip
""")
def decisions_in_force(spark: SparkSession, d: str) -> DataFrame:
    """Customers superseded in runs of five; a decision with a balance from 0 to 4000 has expired."""
    c = table(spark, d, "customer").select("c_custkey", F.expr(_CHAIN.format(k="c_custkey")).alias("successor"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("until"))
    return eventlog.in_force(c, "c_custkey", "successor", "until", F.lit(4000.0))


@query("""
with recursive e as (select s_suppkey n, s_suppkey // 3 needs from supplier where s_suppkey > 0), c(n, d) as (select s_suppkey, 0 from supplier where s_suppkey in (1, 4, 5) union all select e.n, c.d + 1 from c join e on e.needs = c.n where e.n <> c.n)
select n node, min(d)::int distance from c group by 1
""")
def invalidation_cascade(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    edges = s.where("s_suppkey > 0").select(F.col("s_suppkey").alias("node"), F.floor(F.col("s_suppkey") / 3).alias("needs"))
    return eventlog.invalidated(edges, "node", "needs", s.where("s_suppkey in (1, 4, 5)").select(F.col("s_suppkey").alias("node")))


_RULES = {("O", "A"): "keep", ("O", "N"): "wait", ("F", None): "restart", (None, "R"): "orphan", ("P", "R"): "review"}


@query("""
with t as (select o_orderkey k, o_orderstatus s from orders where o_orderkey % 4 > 0), a as (select l_orderkey k, arg_max(l_returnflag, (l_linenumber, l_returnflag)) s from lineitem where l_orderkey % 5 > 0 group by 1), j as (select t.s x, a.s y from t full join a using (k))
select x task_status, y attempt_status, case when x = 'O' and y = 'A' then 'keep' when x = 'O' and y = 'N' then 'wait' when x = 'F' and y is null then 'restart' when x is null and y = 'R' then 'orphan' when x = 'P' and y = 'R' then 'review' else 'conflict' end as action, count(*) n from j group by all
""")
def reconciliation(spark: SparkSession, d: str) -> DataFrame:
    tasks = table(spark, d, "orders").where("o_orderkey % 4 > 0").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    attempts = table(spark, d, "lineitem").where("l_orderkey % 5 > 0").groupBy(F.col("l_orderkey").alias("k")).agg(F.max_by("l_returnflag", F.struct("l_linenumber", "l_returnflag")).alias("a"))
    return eventlog.reconciled(tasks, attempts, "k", "s", "a", _RULES).groupBy("task_status", "attempt_status", "action").agg(F.count("*").alias("n"))


@query("""
select user_id, arg_max(event_type, (ts, event_id)) status, count(*) revision, arg_min(event_type, (ts, event_id)) first_status from events group by user_id
""")
def strict_replay(spark: SparkSession, d: str) -> DataFrame:
    """A replay in which every step is permitted; an illegal one would be an error."""
    kinds = ["view", "click", "purchase", "error", "signup"]
    return eventlog.replay_strict(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", [(a, b) for a in [None, *kinds] for b in kinds])


@query("""
select record_no, source_dataset from expanded where reference_solution is not null and length(trim(expanded_prompt)) > 0 and metadata.repo is not null order by record_no limit 50
""")
def limit_after_filters(spark: SparkSession, d: str) -> DataFrame:
    """Top-k report: the first 50 records that pass the filters of a loader."""
    return table(spark, d, "expanded").where("reference_solution is not null and length(trim(expanded_prompt)) > 0 and metadata.repo is not null").select("record_no", "source_dataset").orderBy("record_no").limit(50)


@query("""
select source, arg_min(repo || '/' || doc_id, (length(repo || '/' || doc_id), repo || '/' || doc_id)) file, count(*) n from documents where repo is not null group by 1
""")
def smallest_name(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat_ws("/", "repo", F.col("doc_id").cast("string"))
    return table(spark, d, "documents").where("repo is not null").groupBy("source").agg(F.min_by(name, F.struct(F.length(name), name)).alias("file"), F.count("*").alias("n"))


@query("""
with u as (select o_orderkey k, 1 shard, o_totalprice v from orders where o_orderkey % 3 < 2 union all select o_orderkey, 2, o_totalprice + 1 from orders where o_orderkey % 3 > 0)
select k, arg_max(v, shard) v, count(*) n_shards from u group by 1
""")
def shard_union(spark: SparkSession, d: str) -> DataFrame:
    """Shards that overlap: the later one wins; no shard at all is refused."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    shards = [o.where("k % 3 < 2").withColumn("shard", F.lit(1)), o.where("k % 3 > 0").select("k", (F.col("v") + 1).alias("v"), F.lit(2).alias("shard"))]
    return curate.shard_union(shards).groupBy("k").agg(F.max_by("v", "shard").alias("v"), F.count("*").alias("n_shards"))


@query("""
with i as (select user_id, count(*) x from events where event_type = 'error' group by 1)
select p.p_partkey, coalesce(x, 0) n_infra, p_size - coalesce(x, 0) n_scored from part p left join i on user_id = p_partkey
""")
def infra_counts(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events").where("event_type = 'error'").groupBy(F.col("user_id").alias("p_partkey")).agg(F.count("*").alias("x"))
    return table(spark, d, "part").select("p_partkey", "p_size").join(x, "p_partkey", "left").select("p_partkey", F.coalesce("x", F.lit(0)).alias("n_infra"), (F.col("p_size") - F.coalesce("x", F.lit(0))).alias("n_scored"))


@query("""
select candidate_no, coalesce(task.parameters['mode'], 'none') as mode, coalesce(try_cast(task.parameters['latency'] as bigint), 1) latency, len(map_keys(task.parameters)) + case when task.parameters['origin'] is null then 1 else 0 end n_keys from candidates where task.parameters is not null
""")
def parameter_defaults(spark: SparkSession, d: str) -> DataFrame:
    """Look-ups with defaults, and a merge in which the parameters win over a default map."""
    p = F.col("task.parameters")
    merged = T.merged_map(F.create_map(F.lit("origin"), F.lit("plan")), p)
    return table(spark, d, "candidates").where("task.parameters is not null").select("candidate_no", F.coalesce(F.try_element_at(p, F.lit("mode")), F.lit("none")).alias("mode"), F.coalesce(F.try_element_at(p, F.lit("latency")).try_cast("long"), F.lit(1)).alias("latency"), F.size(F.map_keys(merged)).cast("long").alias("n_keys"))


@query("""
select root_no, task_class, module_name from root_tasks where root_no between 10 and 200 and task_class in ('stream', 'fsm_protocol') and coalesce(tests, '') <> '' and len(functional_contract) > 0
""")
def subset_filters(spark: SparkSession, d: str) -> DataFrame:
    """A range and a list of problems, without those that lack a plan or tests."""
    return table(spark, d, "root_tasks").where(F.col("root_no").between(10, 200) & F.col("task_class").isin("stream", "fsm_protocol") & (F.coalesce("tests", F.lit("")) != "") & (F.size("functional_contract") > 0)).select("root_no", "task_class", "module_name")
