"""Queries of the curation and text operators, and of the relational surface, with their SQL twins."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions import code as C
from tallyforge.functions import text as T
from tallyforge.functions import verdict as V
from tallyforge.operators import curate, metrics
from tallyforge.plans.catalogue import query
from tallyforge.runtime import table


@query("""
with m as (select candidate_no, list_filter(mutants, lambda x: x.status = 'valid') v from candidates),
s as (select candidate_no, len(v) n_valid, len(list_filter(v, lambda x: coalesce(x.killed, false))) n_killed, list_sort(list_transform(list_filter(v, lambda x: coalesce(x.core, false) and not coalesce(x.killed, false)), lambda x: x.name)) c from m)
select candidate_no, cast(n_valid as int) n_valid, cast(n_killed as int) n_killed, round(case when n_valid > 0 then n_killed / n_valid end, 6) score, array_to_string(c, ',') core_survivors, coalesce(n_valid >= 5 and n_killed / n_valid >= 0.8 and len(c) = 0, false) passed from s
""")
def mutation_score(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "candidates").select("candidate_no", *[c.alias(k) for k, c in curate.mutation_score(F.col("mutants")).items()])


@query("""
select task.operator as operator, state, count(*) n, grouping(task.operator) + grouping(state) as depth from candidates group by rollup (task.operator, state)
""")
def funnel_rollup(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "candidates").select(F.col("task.operator").alias("operator"), "state")
    return c.rollup("operator", "state").agg(F.count("*").alias("n"), (F.grouping("operator") + F.grouping("state")).cast("long").alias("depth"))


@query("""
select source, count(*) n, round(count(*) / sum(count(*)) over (), 6) share, cast(quantile_cont(length(text), 0.5) as double) median_length from documents where text is not null group by source
""")
def mixture_share(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "documents").where("text is not null").select("source", F.length("text").alias("length"))
    n = own.groupBy("source").agg(F.count("*").alias("n")).join(metrics.exact_quantile(own, ["source"], "length", name="median_length"), "source")
    return n.select("source", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"), "median_length")


@query("""
with f as (select root_no, golden g, coalesce(prompt, '') p, ports from root_tasks)
select root_no, array_to_string(list_filter([case when g is null then 'missing_golden' end, case when length(p) < 200 then 'short_prompt' end, case when coalesce(len(ports), 0) = 0 then 'no_ports' end, case when g is not null and not regexp_matches(g, '\\bendmodule\\b') then 'no_endmodule' end], lambda x: x is not null), ',') issues,
 case when regexp_matches(coalesce(g, ''), '\\bcase\\b') and regexp_matches(coalesce(g, ''), 'posedge') then 'fsm' when regexp_matches(coalesce(g, ''), 'posedge') then 'sequential' when g is null then 'unknown' else 'combinational' end class,
 cast(len(regexp_extract_all(coalesce(g, ''), '\\balways')) as int) n_always from f
""".replace("\\\\", "\\"))
def seed_audit(spark: SparkSession, d: str) -> DataFrame:
    g, p = F.col("golden"), F.coalesce("prompt", F.lit(""))
    issues = F.array_compact(F.array(F.when(g.isNull(), "missing_golden"), F.when(F.length(p) < 200, "short_prompt"), F.when(F.coalesce(F.size("ports"), F.lit(0)) <= 0, "no_ports"), F.when(g.isNotNull() & ~g.rlike(r"\bendmodule\b"), "no_endmodule")))
    text = F.coalesce(g, F.lit(""))
    kind = V.ladder((text.rlike(r"\bcase\b") & text.rlike("posedge"), "fsm"), (text.rlike("posedge"), "sequential"), (g.isNull(), "unknown"), otherwise="combinational")
    return table(spark, d, "root_tasks").select("root_no", F.array_join(issues, ",").alias("issues"), kind.alias("class"), F.regexp_count(text, F.lit(r"\balways")).alias("n_always"))


@query(r"""
with n as (select doc_id, sha256(array_to_string(regexp_extract_all(regexp_replace(lower(text), '/\*(?:[^*]|\*+[^*/])*\*+/|//.*', ' ', 'g'), '[a-z_][_\pL\pM\p{Nd}\p{Pc}]*|\p{Nd}+''[bdho][xz_0-9a-f]+|\p{Nd}+|[^\s\pZ\x0b\x1c-\x1f\x{85}]'), ' ')) h from documents where text is not null)
select h digest, min(doc_id) kept, count(*) n from n group by h
""")
def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "documents").where("text is not null").select("doc_id", T.digest(T.normalised(F.col("text"))).alias("digest"))
    return n.groupBy("digest").agg(F.min("doc_id").alias("kept"), F.count("*").alias("n"))


@query("""
select sha256(array_to_string(list_transform(task.ports, lambda p: p.direction || ':' || p.name || ':' || p.width), '|')) interface, count(*) n, count(distinct task.root_id) n_roots from candidates group by 1
""")
def interface_digests(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "candidates").select(T.interface_digest(F.col("task.ports")).alias("interface"), F.col("task.root_id").alias("root"))
    return c.groupBy("interface").agg(F.count("*").alias("n"), F.count_distinct("root").alias("n_roots"))


@query("""
select candidate_no, array_to_string(list_sort(list_transform(map_entries(task.parameters), lambda e: e.key || '=' || e.value)), ',') signature from candidates
""")
def parameter_signature(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "candidates").select("candidate_no", T.signature(F.col("task.parameters")).alias("signature"))


@query("""
select p_partkey, cast(cast('0x' || substr(sha256(p_name), 1, 16) as ubigint) % 7 as bigint) shard, cast('0x' || substr(md5(p_name), 1, 8) as bigint) % 5 rotation, cast(p_partkey / 6 as bigint) * 0 + cast((p_partkey // 6) % 4 as bigint) digit_a, cast((p_partkey // 2) % 3 as bigint) digit_b, p_partkey % 2 digit_c from part
""")
def hash_shards_and_radix(spark: SparkSession, d: str) -> DataFrame:
    a, b, c = curate.mixed_radix(F.col("p_partkey"), [4, 3, 2])
    return table(spark, d, "part").select("p_partkey", T.hash64_mod(F.col("p_name"), 7).alias("shard"), T.hash32_mod(F.col("p_name"), 5).alias("rotation"), a.cast("long").alias("digit_a"), b.cast("long").alias("digit_b"), c.cast("long").alias("digit_c"))


@query("""
select response_no, trim(regexp_replace(regexp_replace(content, '<think>.*?</think>', '', 'gs'), '^.*</think>', '', 's')) answer, case when contains(content, '<think>') and not contains(content, '</think>') then 'open_think' when contains(content, '<answer>') and not contains(content, '</answer>') then 'open_answer' else 'ok' end state from llm_responses where content is not null
""")
def strip_reasoning(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("content")
    return table(spark, d, "llm_responses").where("content is not null").select("response_no", T.strip_think(c).alias("answer"), T.think_state(c).alias("state"))


@query("""
with b as (select response_no, regexp_extract_all(content, '(?s)```(?:[a-zA-Z]*)[ ]*\\n(.*?)```', 1) x from llm_responses where content is not null)
select response_no, len(x) n_blocks, x[-1] last_block, list_reduce(list_transform(x, lambda y: cast(length(y) as bigint)), lambda p, q: greatest(p, q)) longest from b where len(x) > 0
""")
def fenced_blocks(spark: SparkSession, d: str) -> DataFrame:
    blocks = T.fenced(F.col("content"))
    out = table(spark, d, "llm_responses").where("content is not null").select("response_no", F.size(blocks).cast("long").alias("n_blocks"), T.last_fenced(F.col("content")).alias("last_block"), F.length(T.largest(blocks)).cast("long").alias("longest"))
    return out.where("n_blocks > 0")


@query(r"""
with s as (select record_no, reference_solution t, regexp_extract(reference_solution, '(?is)\bmodule\s+[a-z_]\w*\s*\((.*?)\)\s*;', 1) h from expanded where reference_solution is not null),
c as (select record_no, len(regexp_extract_all(t, '(?s)\bmodule\b.*?\bendmodule\b')) n_modules, unnest(list_prepend('', regexp_extract_all(case when h = '' then t else h end, '(?i)\b(?:input|output|inout)\b[^,;()]*'))) d, generate_subscripts(list_prepend('', regexp_extract_all(case when h = '' then t else h end, '(?i)\b(?:input|output|inout)\b[^,;()]*')), 1) i from s),
p as (select record_no, n_modules, i, regexp_extract(d, '(?i)^(?:input|output|inout)\s*(?:wire|reg|logic)?\s*(?:signed\b|unsigned\b)?\s*(?:\[[^\]]*\])?\s*([a-z_]\w*)', 1) n, regexp_extract(d, '\[\s*([^:\]]+)\s*:', 1) msb from c),
u as (select *, row_number() over (partition by record_no, n order by i) k from p)
select record_no, any_value(n_modules) n_modules, count(*) filter (n <> '' and k = 1) n_ports, arg_min(n, i) filter (n <> '') first_port, count(*) filter (n <> '' and k = 1 and msb <> '') n_vectors from u group by record_no
""")
def module_ports(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("reference_solution")
    ports = table(spark, d, "expanded").where("reference_solution is not null").select("record_no", F.size(T.modules(s)).cast("long").alias("n_modules"), T.port_list(s).alias("p"))
    return ports.select("record_no", "n_modules", F.size("p").cast("long").alias("n_ports"), F.try_element_at("p", F.lit(1))["name"].alias("first_port"), F.size(F.filter("p", lambda x: x["width"] != "1")).cast("long").alias("n_vectors"))


@query("""
with w as (select root_no, list_filter(list_distinct(regexp_extract_all(golden, '[A-Za-z_][A-Za-z0-9_]*')), lambda x: length(x) > 2) g, list_distinct(regexp_extract_all(prompt, '[A-Za-z_][A-Za-z0-9_]*')) p, list_transform(ports, lambda x: x.name) o from root_tasks where golden is not null and prompt is not null)
select root_no, array_to_string(list_sort(list_filter(g, lambda x: list_contains(p, x) and not list_contains(o, x))), ',') leaked from w
""")
def leaked_identifiers(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "root_tasks").where("golden is not null and prompt is not null")
    return r.select("root_no", F.array_join(T.leaked_identifiers(F.col("golden"), F.col("prompt"), F.coalesce(F.transform("ports", lambda p: p["name"]), F.array().cast("array<string>"))), ",").alias("leaked"))


@query("""
select record_no, case when coalesce(trim(id), '') = '' then 'id' when coalesce(trim(expanded_prompt), '') = '' then 'expanded_prompt' when coalesce(trim(reference_solution), '') = '' then 'reference_solution' when metadata.repo is null then 'repo' end missing from expanded
""")
def required_fields(spark: SparkSession, d: str) -> DataFrame:
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    first = F.when(blank("id"), "id").when(blank("expanded_prompt"), "expanded_prompt").when(blank("reference_solution"), "reference_solution").when(F.col("metadata.repo").isNull(), "repo")
    return table(spark, d, "expanded").select("record_no", first.alias("missing"))


@query("""
with c as (select r.id, task.operator op, count(*) n, count(*) filter (state = 'accepted') ok from candidates c join root_tasks r on c.task.root_id = r.id group by all)
select op as operator, count(*) n_roots, cast(sum(n) as bigint) n, cast(sum(ok) as bigint) n_accepted, count(*) filter (ok = 0) roots_without from c group by op
""")
def yield_per_operator(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "candidates").select(F.col("task.root_id").alias("id"), F.col("task.operator").alias("operator"), "state")
    own = c.join(F.broadcast(table(spark, d, "root_tasks").select("id")), "id").groupBy("id", "operator").agg(F.count("*").alias("n"), F.count_if(F.col("state") == "accepted").alias("ok"))
    return own.groupBy("operator").agg(F.count("*").alias("n_roots"), F.sum("n").alias("n"), F.sum("ok").alias("n_accepted"), F.count_if(F.col("ok") == 0).alias("roots_without"))


@query("""
select candidate_no, array_to_string(list_sort(list_filter(list_distinct(task.test_obligations), lambda x: not list_contains(coalesce(task.forbidden_mutations, []), x))), ',') uncovered from candidates where task.test_obligations is not null
""")
def uncovered_obligations(spark: SparkSession, d: str) -> DataFrame:
    left = F.array_except("task.test_obligations", F.coalesce("task.forbidden_mutations", F.array().cast("array<string>")))
    return table(spark, d, "candidates").where("task.test_obligations is not null").select("candidate_no", F.array_join(F.array_sort(left), ",").alias("uncovered"))


@query("""
with p as (select *, row_number() over (partition by task.root_id, task.operator order by coalesce(updated_at, timestamptz '1970-01-01') desc, candidate_no desc) k from candidates), t as (select *, row_number() over (partition by task.root_id order by coalesce(updated_at, timestamptz '1970-01-01') desc, candidate_no desc) turn from p where k <= 3)
select task.root_id root, turn, candidate_no from t where turn <= 8
""")
def capped_turns(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "candidates").select("candidate_no", F.col("task.root_id").alias("root"), F.col("task.operator").alias("operator"), F.coalesce("updated_at", F.lit("1970-01-01").cast("timestamp")).alias("at"))
    out = curate.capped_selection(c, "root", "operator", [F.col("at").desc(), F.col("candidate_no").desc()], target=2_000_000_000, operator_share=1.0, exact=False)
    return out.select("root", F.col("turn").cast("long").alias("turn"), "candidate_no")


@query("""
with p as (select candidate_no, task.root_id root, task.operator op, row_number() over (partition by task.root_id, task.operator order by candidate_no desc) k from candidates), t as (select *, row_number() over (partition by root order by candidate_no desc) turn from p where k <= 3)
select candidate_no, root, op as operator, turn from t where turn <= 8 order by turn, root limit 1000
""")
def capped_round_robin(spark: SparkSession, d: str) -> DataFrame:
    """Top-k report: the selection of 1 000 candidates under all caps; a table of fewer gives what the caps allow, a larger one that yields fewer raises.

    The twin holds while no operator reaches 40 % of the target, as on small tables; beyond that a test compares with the loop.
    """
    c = table(spark, d, "candidates").select("candidate_no", F.col("task.root_id").alias("root"), F.col("task.operator").alias("operator"))
    out = curate.capped_selection(c, "root", "operator", [F.col("candidate_no").desc()], target=1000, exact=c.count() >= 1000)
    return out.withColumn("turn", F.col("turn").cast("long"))


_WORDS = r"regexp_extract_all(regexp_replace(lower(coalesce({c}, '')), '/\*(?:[^*]|\*+[^*/])*\*+/|//.*', ' ', 'g'), '[a-z_][_\pL\pM\p{{Nd}}\p{{Pc}}]*|\p{{Nd}}+''[bdho][xz_0-9a-f]+|\p{{Nd}}+|[^\s\pZ\x0b\x1c-\x1f\x{{85}}]')"


@query(rf"""
with recursive t as (select candidate_no id, coalesce(array_to_string(list_transform(task.ports, lambda p: coalesce(p.direction, 'None') || ':' || coalesce(p.name, 'None') || ':' || coalesce(p.width, 'None')), '|'), '') i, {_WORDS.format(c='prompt')} p, {_WORDS.format(c='golden')} g from candidates),
f as (select id, i, array_to_string(p, ' ') tp, array_to_string(g, ' ') tg, case when len(p) > 4 then list_distinct(list_transform(range(1, len(p) - 3), lambda k: array_to_string(p[k : k + 4], ' '))) else [] end sp, case when len(g) > 4 then list_distinct(list_transform(range(1, len(g) - 3), lambda k: array_to_string(g[k : k + 4], ' '))) else [] end sg from t),
e as (select b.id, a.id before from f a join f b on a.id < b.id and (a.tp = b.tp or a.tg = b.tg)
 union select b.id, a.id from f a join f b on a.id < b.id and a.i = b.i and (case when len(a.sp) + len(b.sp) = 0 then 1.0 else len(list_intersect(a.sp, b.sp)) / (len(a.sp) + len(b.sp) - len(list_intersect(a.sp, b.sp))) end >= 0.8 or case when len(a.sg) + len(b.sg) = 0 then 1.0 else len(list_intersect(a.sg, b.sg)) / (len(a.sg) + len(b.sg) - len(list_intersect(a.sg, b.sg))) end >= 0.8)),
o as (select f.id, row_number() over (order by f.id) n, list(before order by before) filter (before is not null) near from f left join e on e.id = f.id group by f.id),
s(n, kept, hit) as (select 0::bigint, []::bigint[], null::bigint union all select o.n, case when len(list_intersect(coalesce(o.near, []), s.kept)) = 0 then list_append(s.kept, o.id) else s.kept end, list_min(list_intersect(coalesce(o.near, []), s.kept)) from s join o on o.n = s.n + 1)
select o.id as key, s.hit is null kept, s.hit duplicate_of from s join o using (n)
""")
def greedy_near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Prompt or golden equal to an accepted one, or nearly so where the ports are the same."""
    port = lambda p: F.concat_ws(":", *[F.coalesce(p[x], F.lit("None")) for x in ("direction", "name", "width")])
    c = table(spark, d, "candidates").select("candidate_no", F.sha2(F.concat_ws("|", F.transform("task.ports", port)), 256).alias("interface"), "prompt", "golden")
    return curate.greedy_near_duplicates(c, "candidate_no", "candidate_no", "interface", {"prompt": 0.8, "golden": 0.8}, across=True)


@query("""
with t as (select doc_id, source, row_number() over (partition by source order by doc_id) turn from documents) select doc_id, source, turn from t
""")
def interleaved_sources(spark: SparkSession, d: str) -> DataFrame:
    out = curate.interleaved(table(spark, d, "documents").select("doc_id", "source"), "source", ["doc_id"])
    return out.select("doc_id", "source", F.col("turn").cast("long").alias("turn"))


@query("""
select r.contamination_group grp, count(*) n, count(*) filter (s.split = 'heldout') n_heldout, bool_or(s.split = 'heldout') and bool_or(s.split <> 'heldout') mixed from seeds s join root_tasks r on s.id = r.id group by 1
""")
def split_leakage(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "seeds").select("id", "split").join(table(spark, d, "root_tasks").select("id", F.col("contamination_group").alias("grp")), "id")
    held = F.col("split") == "heldout"
    return j.groupBy("grp").agg(F.count("*").alias("n"), F.count_if(held).alias("n_heldout"), (F.bool_or(held) & F.bool_or(~held)).alias("mixed"))


@query("""
with recursive up(id, node, depth) as (select c.id, c.task.root_id, 1 from candidates c union all select u.id, r.lineage.seed_id, u.depth + 1 from up u join root_tasks r on u.node = r.id where u.depth < 2 and r.lineage.seed_id is not null)
select node as ancestor, max(depth) depth, count(distinct id) n_derived from up group by node
""")
def lineage_roots(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "candidates").select("id", F.col("task.root_id").alias("ancestor"), F.lit(1).alias("depth"))
    r = table(spark, d, "root_tasks").select(F.col("id").alias("ancestor"), F.col("lineage.seed_id").alias("up"))
    second = c.join(F.broadcast(r), "ancestor").where("up is not null").select("id", F.col("up").alias("ancestor"), F.lit(2).alias("depth"))
    return c.unionByName(second).groupBy("ancestor").agg(F.max("depth").alias("depth"), F.count_distinct("id").alias("n_derived"))


def _quoted(x: str | None) -> str:
    return "null" if x is None else "'" + x.replace("'", "''") + "'"


_CHANGES = ", ".join(f"({i}, {_quoted(o)}, {_quoted(n)}, {_quoted(p)}, {_quoted(re.sub(r'[$][{]?([0-9])[}]?', lambda m: chr(92) + m[1], r))})" for i, (o, n, p, r, _) in enumerate(C.MUTATIONS))


@query(f"""
with m(place, op, mutant, pattern, new_text) as (values {_CHANGES}),
x as (select candidate_no, place, op, mutant, regexp_replace(golden, pattern, new_text, 'i') rtl, golden from candidates join m on op is null or op = task.operator where golden is not null),
y as (select *, row_number() over (partition by candidate_no, rtl order by place) k from x where rtl <> golden)
select mutant, count(*) n, cast(sum(length(rtl)) as bigint) n_chars from y where op is not null or k = 1 group by mutant
""")
def mutant_counts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "candidates").select("candidate_no", F.col("task.operator").alias("operator"), "golden")
    return C.mutants(c, "candidate_no", "operator", "golden").groupBy("mutant").agg(F.count("*").alias("n"), F.sum(F.length("rtl")).alias("n_chars"))


@query(rf"""
select record_no, nullif(regexp_extract(regexp_replace(reference_solution, '//[^\n]*|/\*.*?\*/', '', 'gs'), {_quoted(C.UNSAFE)}, 0), '') as construct from expanded where reference_solution is not null
""")
def unsafe_constructs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "expanded").where("reference_solution is not null").select("record_no", C.unsafe_construct(F.col("reference_solution")).alias("construct"))


# the relational surface


@query("""
select l_returnflag, l_linestatus, round(sum(l_quantity), 2) sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue, round(avg(l_discount), 6) avg_disc, count(*) n from lineitem where l_shipdate <= timestamp '1998-09-02' group by all
""")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("""
select o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey where c_mktsegment = 'BUILDING' group by o_orderkey order by revenue desc, o_orderkey limit 10
""")
def top_revenue(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    o = table(spark, d, "orders").join(c, "o_custkey", "left_semi").select("o_orderkey")
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_extendedprice", "l_discount")
    return li.join(o, "o_orderkey").groupBy("o_orderkey").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue")).orderBy(F.desc("revenue"), "o_orderkey").limit(10)


@query("""
select r_name, n_name, c_mktsegment, count(*) n, grouping(r_name) + grouping(n_name) + grouping(c_mktsegment) depth from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by cube (r_name, n_name, c_mktsegment)
""")
def customer_cube(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    j = table(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.cube("r_name", "n_name", "c_mktsegment").agg(F.count("*").alias("n"), (F.grouping("r_name") + F.grouping("n_name") + F.grouping("c_mktsegment")).cast("long").alias("depth"))


@query("""
(select l_partkey k from lineitem where l_returnflag = 'R' intersect select l_partkey from lineitem where l_returnflag = 'A') except select l_partkey from lineitem where l_discount > 0.09
""")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    pick = lambda cond: li.where(cond).select(F.col("l_partkey").alias("k"))
    return pick("l_returnflag = 'R'").intersect(pick("l_returnflag = 'A'")).subtract(pick("l_discount > 0.09"))


@query("""
select s_suppkey, s_nationkey, rank() over w r, dense_rank() over w dr, ntile(4) over (partition by s_nationkey order by s_acctbal desc, s_suppkey) q, round(s_acctbal - lag(s_acctbal) over w, 2) step from supplier window w as (partition by s_nationkey order by s_acctbal desc, s_suppkey)
""")
def supplier_ranks(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")
    return table(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.rank().over(w).cast("long").alias("r"), F.dense_rank().over(w).cast("long").alias("dr"), F.ntile(4).over(w).cast("long").alias("q"), F.round(F.col("s_acctbal") - F.lag("s_acctbal").over(w), 2).alias("step"))


@query("""
select event_id, user_id, cast(json_extract(props, '$.k') as bigint) k from events where cast(json_extract(props, '$.k') as bigint) > 90
""")
def json_properties(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").select("event_id", "user_id", k.alias("k")).where("k > 90")


@query("""
select c_custkey, (select max(o_totalprice) from orders where o_custkey = c_custkey) most from customer where c_acctbal > (select avg(c_acctbal) from customer)
""")
def scalar_subquery(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    mean = F.broadcast(c.agg(F.avg("c_acctbal").alias("mean")))
    most = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("most"))
    return c.join(mean, F.col("c_acctbal") > F.col("mean")).join(most, "c_custkey", "left").select("c_custkey", "most")
