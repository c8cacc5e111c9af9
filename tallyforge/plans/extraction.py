"""Queries of the extractors, log readers, verdict projections and the second look at failures, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import code as C
from tallyforge.functions import extract as X
from tallyforge.functions import text as T
from tallyforge.functions import verdict as V
from tallyforge.operators import metrics, rescore
from tallyforge.plans.catalogue import query
from tallyforge.runtime import table

#: Pieces of the twins: text without reasoning and tags, its regions, its modules.
_BARE = r"""t as (select response_no, regexp_replace(regexp_replace(content, '(?s)<think>.*?</think>', '', 'g'), '</?(?:answer|think)>', '', 'g') t from llm_responses where content is not null)"""
_REGIONS = _BARE + r""",
r as (select response_no, list_concat(list_concat(regexp_extract_all(t, '(?s)```(?:[a-zA-Z+./-]+)?[ \t]*\n?(.*?)```', 1), list_transform(regexp_extract_all(t, '(?s)\[BEGIN\](.*?)\[DONE\]', 1), lambda x: regexp_replace(x, '(?m)^[ \t]*```.*$', '', 'g'))), case when len(string_split(t, '```')) % 2 = 0 then [string_split(t, '```')[-1]] else [] end) g from t),
m as (select response_no, flatten(list_transform(g, lambda x: regexp_extract_all(x, '(?s)\bmodule\b.*?endmodule'))) w, flatten(list_transform(list_filter(g, lambda x: not contains(x, 'endmodule')), lambda x: regexp_extract_all(x, '(?s)\bmodule\b.*'))) k from r),
p as (select response_no, case when len(w) > 0 then 'complete' when len(k) > 0 then 'truncated' else 'empty' end status, coalesce(case when len(w) > 0 then w[-1] else k[-1] end, '') raw_code, w from m),
q as (select response_no, status, trim(raw_code, E' \n\t\r\f') code, len(list_distinct(list_transform(w, lambda x: trim(x, E' \n\t\r\f')))) n_candidates from p)"""


def _answers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "llm_responses").where("content is not null")


@query(f"with {_REGIONS} select response_no, status, length(code) n_chars, md5(code) code, n_candidates from q")
def picked_modules(spark: SparkSession, d: str) -> DataFrame:
    p = _answers(spark, d).select("response_no", X.picked_module(F.col("content")).alias("p"), F.size(X.module_candidates(F.col("content"))).cast("long").alias("n_candidates"))
    return p.select("response_no", "p.status", F.length("p.code").cast("long").alias("n_chars"), F.md5("p.code").alias("code"), "n_candidates")


@query(rf"""
with {_BARE}, c as (select response_no, case when regexp_matches(t, '(?s)```(?:verilog|systemverilog)?\s*.*?```') then regexp_extract(t, '(?s)```(?:verilog|systemverilog)?\s*(.*?)```', 1) when contains(t, '```') then regexp_extract(t, '(?s)```(?:verilog|systemverilog)?\s*(.*)', 1) else t end c from t)
select response_no, md5(case when regexp_matches(c, '(?s)module\b.*endmodule') then regexp_extract(c, '(?s)module\b.*endmodule') when regexp_matches(c, 'module\b') then regexp_extract(c, '(?s)module\b.*') else c end) code from c
""")
def first_verilog(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).select("response_no", F.md5(X.first_verilog(F.col("content"))).alias("code"))


@query(r"""
with a as (select response_no, case when regexp_matches(content, '(?s)<answer>.*?</answer>') then regexp_extract(content, '(?s)<answer>(.*?)</answer>', 1) else content end b from llm_responses where content is not null),
k as (select response_no, regexp_extract_all(b, '(?s)```(?:[a-zA-Z+./-]+)?[ \t]*\n?(.*?)```', 1) f from a),
j as (select response_no, f, list_filter(f, lambda x: contains(x, '@triton.jit')) j from k),
s as (select response_no, len(f) n, len(j) nj, list_filter(j, lambda x: regexp_matches(x, '\bdef\b')) w from j)
select response_no, case when n = 0 then 'empty' when len(w) > 0 then 'complete' else 'partial' end status, coalesce(list_max(list_transform(w, lambda x: length(x))), 0) > 0 has_kernel from s
""")
def picked_kernels(spark: SparkSession, d: str) -> DataFrame:
    p = _answers(spark, d).select("response_no", X.picked_kernel(F.col("content")).alias("p"))
    return p.select("response_no", "p.status", ((F.col("p.status") == "complete") & (F.col("p.code") != "")).alias("has_kernel"))


@query(r"""
select response_no, md5(ltrim(regexp_replace(regexp_replace(content, '(?is)<think>.*?</think>', '', 'g'), '(?is)\A.*?</think>', ''), E'\n')) answer,
 length(trim(case when regexp_matches(content, '(?s)<answer>.*?</answer>') then regexp_extract(content, '(?s)<answer>(.*?)</answer>', 1) else '' end, E' \n\t\r\f')) n_answer,
 length(trim(regexp_extract(content, '(?s)<think>(.*?)</think>', 1), E' \n\t\r\f')) n_think from llm_responses where content is not null
""")
def reasoning_variants(spark: SparkSession, d: str) -> DataFrame:
    both = X.think_and_answer(F.col("content"))
    return _answers(spark, d).select("response_no", F.md5(X.strip_reasoning(F.col("content"))).alias("answer"), F.length(both["answer"]).cast("long").alias("n_answer"), F.length(both["think"]).cast("long").alias("n_think"))


@query(r"""
with f as (select response_no, content c, regexp_matches(content, '(?s)```(?:[a-zA-Z+./-]+)?[ \t]*\n?.*?```') y, trim(regexp_extract(content, '(?s)```(?:[a-zA-Z+./-]+)?[ \t]*\n?(.*?)```', 1), E' \n\t\r\f') b from llm_responses where content is not null)
select response_no, md5(case when y then b else trim(c, E' \n\t\r\f') end) stripped, length(trim(regexp_extract(c, '(?is)```(?:python|py)[ \t]*\n(.*?)```', 1), E' \n\t\r\f')) n_python, md5(case when y then b else trim(regexp_extract(c, '(?s)module\s+\w+.*?endmodule'), E' \n\t\r\f') end) code from f
""")
def fence_variants(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("content")
    return _answers(spark, d).select("response_no", F.md5(X.strip_fence(c)).alias("stripped"), F.length(X.python_block(c)).cast("long").alias("n_python"), F.md5(X.fenced_or_module(c)).alias("code"))


_LOG = "concat('prompt_tokens = ', response_no, '\n\nPrompt\n------\nx\n\nResponse\n--------\n\n', content, '\n\nStatistics\n----------\nresp_tokens = ', length(content), '\ncost = 0.', response_no % 90 + 10, '\nresp_tokens = ', response_no % 7, '\n')"


@query(rf"""
with l as (select response_no, regexp_replace(content, E'\r', '', 'g') content from llm_responses where content is not null and not contains(content, E'\nResponse\n') and not contains(content, E'\nStatistics\n'))
select response_no, response_no::double prompt_tokens, (response_no % 7)::double resp_tokens, round((response_no % 90 + 10) / 100, 2) as cost, md5(regexp_replace(regexp_replace(content, '\A(?:[ \t]*(?:-*|Response)[ \t]*\n)*(?:[ \t]*-*[ \t]*\z)?', ''), '(?:(?:\n|\A)[ \t]*-*[ \t]*)+\z', '')) response from l
""")
def generation_logs(spark: SparkSession, d: str) -> DataFrame:
    """Fields and the response of logs that are put together from the responses."""
    own = _answers(spark, d).select("response_no", F.regexp_replace("content", "\r", "").alias("content")).where(~F.contains("content", F.lit("\nResponse\n")) & ~F.contains("content", F.lit("\nStatistics\n")))
    log = F.expr(_LOG.replace("\n", "\\n"))
    return own.select("response_no", log.alias("log")).select("response_no", X.last_field(F.col("log"), "prompt_tokens").alias("prompt_tokens"), X.last_field(F.col("log"), "resp_tokens").alias("resp_tokens"), F.round(X.last_field(F.col("log"), "cost", r"\d+.\d+"), 2).alias("cost"), F.md5(X.response_section(F.col("log"))).alias("response"))


@query("""
with i as (select seed_id, sum(length(content)) c, sum(length(reasoning_content)) r from llm_responses group by 1)
select count(*) n_items, round(sum(c), 4)::double total_content, round(coalesce(sum(c), 0) / count(*), 6) mean_content, round(sum(r), 4)::double total_reasoning, round(coalesce(sum(r), 0) / count(*), 6) mean_reasoning from i
""")
def token_totals(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "llm_responses").select("seed_id", F.length("content").cast("double").alias("content"), F.length("reasoning_content").cast("double").alias("reasoning"))
    return metrics.totals(r, "seed_id", "content", "reasoning")


@query(f"""
with {_REGIONS}, j as (select r.source, r.content, coalesce(r.truncated, false) passed, coalesce(x.reference_solution, '') old, q.status, q.code from llm_responses r left join q on q.response_no = r.response_no left join expanded x on x.record_no = r.expanded_no)
select source, case when content is null then 'no_result' when passed then 'passed' when status = 'empty' then 'empty' when status = 'truncated' then 'truncated'
 when code <> '' and (old = '' or trim(old, E' \\n\\t\\r\\f') <> code) and (old = '' or not contains(old, 'endmodule') or length(code) > length(old) * 1.05) then 'recoverable' else 'clean' end state, count(*) n from j group by all
""")
def failure_diagnosis(spark: SparkSession, d: str) -> DataFrame:
    """What a second look at the responses finds, against the reference solutions as the code kept so far."""
    old = table(spark, d, "expanded").select(F.col("record_no").alias("expanded_no"), "reference_solution")
    r = table(spark, d, "llm_responses").select("expanded_no", "source", "content", "truncated").join(old, "expanded_no", "left")
    state = rescore.diagnosis(F.coalesce("content", F.lit("")), F.col("reference_solution"), F.col("truncated"), F.col("content").isNull())
    return r.groupBy("source", state.alias("state")).agg(F.count("*").alias("n"))


@query("""
with i as (select l_orderkey k, count(*) n, avg(case when l_returnflag = 'N' then 1.0 else 0.0 end) r, count(distinct l_linenumber) filter (l_returnflag = 'R' and l_linestatus = 'F') f from lineitem group by 1)
select count(*) n_items, round(100 * avg(least(1::double, r + f / n)), 2) pass_rate from i
""")
def flipped_rate(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    items = li.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.avg(F.when(F.col("l_returnflag") == "N", 1.0).otherwise(0.0)).alias("r"))
    flips = li.where("l_returnflag = 'R' and l_linestatus = 'F'").select("l_orderkey", F.col("l_linenumber").alias("sample"))
    return rescore.flipped_rate(items, flips, "l_orderkey", "n", "r")


@query("""
select month(ts) m, count(*) filter (event_type <> 'error') n, count(*) filter (event_type = 'error') n_skipped, round(100 * count(*) filter (event_type = 'purchase') / count(*) filter (event_type <> 'error'), 2) old_rate,
 round(100 * count(*) filter (event_type = 'purchase' or event_type = 'signup' and value > 50) / count(*) filter (event_type <> 'error'), 2) new_rate from events group by 1
""")
def corrected_rate(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("m", F.month("ts").cast("long"))
    return rescore.corrected_rate(e, ["m"], F.col("event_type") == "purchase", F.col("event_type") == "error", (F.col("event_type") == "signup") & (F.col("value") > 50))


@query("""
with i as (select l_orderkey, count(*) filter (l_returnflag = 'N' and l_linestatus <> 'F') p, count(*) filter (l_linestatus = 'F') x, max(case when l_linenumber = 1 and l_returnflag = 'N' and l_linestatus <> 'F' then 1 else 0 end) f from lineitem group by 1)
select count(*) n_items, cast(sum(x) as bigint) n_infra, round(100 * avg(round(p / 7, 4)), 2) as avg, round(100 * avg(case when x < 7 then round(p / (7 - x), 4) else 0 end), 2) avg_clean, round(100 * avg(f), 2) pass_at_1 from i
""")
def average_at_k(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").withColumn("k", F.col("l_linenumber") - 1)
    return metrics.average_at_k(li, "l_orderkey", "k", F.col("l_returnflag") == "N", F.col("l_linestatus") == "F", 7)


@query("""
with i as (select l_orderkey, count(*) filter (l_returnflag <> 'R' and l_linestatus <> 'F') n, coalesce(max(case when l_returnflag <> 'R' and l_linestatus <> 'F' then l_quantity end), 0) t, count(*) filter (l_linestatus = 'F') x from lineitem group by 1)
select count(*) n_items, round(avg(n), 2) n, round(avg(round(t, 2)), 2) t, round(sum(n) / (7 * count(*) - sum(x)), 4) n_clean, round(avg(case when x < 7 then round(t, 2) end), 2) t_clean from i
""")
def best_of_k_clean(spark: SparkSession, d: str) -> DataFrame:
    return metrics.best_of_k(table(spark, d, "lineitem"), "l_orderkey", F.col("l_returnflag") != "R", F.col("l_quantity"), F.col("l_linestatus") == "F", 7)


@query("""
select o_orderpriority, count(*) filter (o_orderstatus <> 'P') n, count(*) filter (o_orderstatus = 'P') n_skipped, count(*) filter (o_orderstatus = 'F') compiled, round(100 * count(*) filter (o_orderstatus = 'F') / count(*) filter (o_orderstatus <> 'P'), 2) compiled_rate,
 count(*) filter (o_orderstatus = 'F' and o_totalprice > 100000) correct, round(100 * count(*) filter (o_orderstatus = 'F' and o_totalprice > 100000) / count(*) filter (o_orderstatus <> 'P'), 2) correct_rate from orders group by 1
""")
def scored_summary(spark: SparkSession, d: str) -> DataFrame:
    done = F.col("o_orderstatus") == "F"
    return metrics.scored_summary(table(spark, d, "orders"), ["o_orderpriority"], F.col("o_orderstatus") == "P", compiled=done, correct=done & (F.col("o_totalprice") > 100000))


@query("""
with e as (select case event_type when 'purchase' then '.' when 'error' then 'T' when 'signup' then 'R' when 'click' then 'S' else 'C' end code, user_id % 3 g from events)
select l.place::bigint place, l.code, count(*) filter (g = 0) dir_a, count(*) filter (g = 1) dir_b, count(*) filter (g = 2) dir_c from (values (0, '.'), (1, 'C'), (2, 'S'), (3, 'm'), (4, 'r'), (5, 'R'), (6, 'T')) l(place, code) left join e using (code) group by all order by 1
""")
def failure_code_table(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    code = F.expr("case event_type when 'purchase' then '.' when 'error' then 'T' when 'signup' then 'R' when 'click' then 'S' else 'C' end")
    column = F.element_at(F.array(F.lit("dir_a"), F.lit("dir_b"), F.lit("dir_c")), (F.col("user_id") % 3 + 1).cast("int"))
    return metrics.code_table(e, code, column, ["S", "T", ".", "R", "r", "m", "C"], ["dir_a", "dir_b", "dir_c"]).withColumn("place", F.col("place").cast("long"))


_BACKENDS = "['rtl', 'cvdp', 'kernelbench', 'realbench', 'verilogeval']"
_OUTCOMES = "['payload_not_allowlisted', 'invalid_verify_mode', 'dependency_missing', 'invalid_golden_or_ports', 'golden_trace_incomplete', 'golden_run_failed', 'pass']"
_ERRORS = "['dataset_configuration_error', 'golden_verifier_failure', 'other']"


@query(f"""
with e as (select {_BACKENDS}[event_id % 5 + 1] b, {_OUTCOMES}[event_id % 7 + 1] i, {_ERRORS}[event_id % 3 + 1] t from events)
select b backend, i info, case when b = 'kernelbench' then null when i = 'payload_not_allowlisted' then 'trusted_payload_integrity' when i = 'invalid_verify_mode' and t = 'dataset_configuration_error' then 'trusted_reference_configuration' when i = 'dependency_missing' then 'trusted_runtime_dependency'
 when b = 'rtl' and i = 'invalid_golden_or_ports' then 'trusted_reference_configuration' when b = 'rtl' and (i = 'golden_trace_incomplete' or i = 'golden_run_failed' and t = 'golden_verifier_failure') then 'trusted_golden_failure' end code, count(*) n from e group by all
""")
def outcome_codes(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda names, n: F.expr(f"element_at(array({names[1:-1]}), cast(event_id % {n} + 1 as int))")
    e = table(spark, d, "events").select(pick(_BACKENDS, 5).alias("backend"), pick(_OUTCOMES, 7).alias("info"), pick(_ERRORS, 3).alias("error"))
    return e.groupBy("backend", "info", V.outcome_code(F.col("backend"), F.col("info"), F.col("error")).alias("code")).agg(F.count("*").alias("n"))


@query("""
with e as (select case event_type when 'error' then 'query_failed' when 'view' then 'no_testbench' end t, value > 20 s, case when value > 60 then 100.0 else value end v, case when event_id % 11 = 0 then 'done' end p from events)
select case when t = 'query_failed' then 'scheduler_failure' when t = 'no_testbench' then 'trusted_reference_configuration' end infra_code, t is not null infra, t is null and s and v >= 100 correct, case when t is not null then 'archx_infra:' || t when s and v >= 100 then 'pass' else 'fail' end info, count(*) n from e where p is null group by all
""")
def triggered_verdicts(spark: SparkSession, d: str) -> DataFrame:
    trigger = F.when(F.col("event_type") == "error", "query_failed").when(F.col("event_type") == "view", "no_testbench")
    v = V.triggered(trigger, F.col("value") > 20, F.when(F.col("value") > 60, 100.0).otherwise(F.col("value")), F.when(F.col("event_id") % 11 == 0, "done"))
    return table(spark, d, "events").select(v.alias("v")).where("v is not null").groupBy("v.infra_code", "v.infra", "v.correct", "v.info").agg(F.count("*").alias("n"))


@query("""
with profile as (select p_partkey k, list_sort([p_brand, 'Brand#' || p_size % 5 + 1]) h from part where p_size % 4 > 0),
c as (select l_orderkey, case when l_returnflag = 'R' then 'timeout' else 'executed' end info, case when l_linenumber <> 5 then 'Brand#' || l_suppkey % 5 + 1 end digest, h from lineitem left join profile on k = l_partkey)
select case when info = 'timeout' then null when digest is null or h is null then false else list_contains(h, digest) end correct, case when info = 'timeout' then info when digest is null or h is null then 'executed_no_profile' when list_contains(h, digest) then 'pass' else 'stdout_hash_mismatch' end info, count(*) n from c group by 1, 2
""")
def verdict_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes against the profile of their task, which some tasks lack."""
    profile = table(spark, d, "part").where("p_size % 4 > 0").select(F.col("p_partkey").alias("l_partkey"), F.expr("array(p_brand, concat('Brand#', p_size % 5 + 1))").alias("h"))
    c = table(spark, d, "lineitem").select("l_partkey", F.when(F.col("l_returnflag") == "R", "timeout").otherwise("executed").alias("info"), F.expr("case when l_linenumber <> 5 then concat('Brand#', l_suppkey % 5 + 1) end").alias("digest")).join(profile, "l_partkey", "left")
    v = V.by_profile(F.col("info"), F.lit(None).cast("string"), F.col("digest"), F.col("h"))
    return c.select(v.alias("v")).groupBy("v.correct", "v.info").agg(F.count("*").alias("n"))


@query("""
with e as (select case when event_id % 3 = 0 then 'infrastructure' end o, event_id % 2 = 0 i, case event_id % 5 when 0 then 'worker_start' when 1 then 'made_up' end c, event_id % 13 = 0 s, case event_id % 17 when 0 then 'ref_smoke_failed' else 'ok' end g, case when event_id % 19 = 0 then 'Kernel not found in x' else event_type end m from events)
select coalesce(o = 'infrastructure', false) or i and coalesce(c = 'worker_start', false) or s or g = 'ref_smoke_failed' infra, m like 'Kernel not found%' missing, count(*) n from e group by all
""")
def infra_predicate(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    code = F.when(i % 5 == 0, "worker_start").when(i % 5 == 1, "made_up")
    infra = V.is_infra(F.when(i % 3 == 0, "infrastructure"), i % 2 == 0, code, i % 13 == 0, F.when(i % 17 == 0, "ref_smoke_failed").otherwise("ok"))
    missing = V.kernel_missing(F.when(i % 19 == 0, "Kernel not found in x").otherwise(F.col("event_type")))
    return table(spark, d, "events").groupBy(infra.alias("infra"), missing.alias("missing")).agg(F.count("*").alias("n"))


_SIMULATED = "concat('run ', o_orderkey, '\nMismatches: ', o_orderkey % 3, ' in ', 10 + o_custkey % 90, ' samples\n', case when o_orderkey % 4 = 0 then 'Your Design Passed' when o_orderkey % 5 = 0 then 'MISMATCH at 3' else 'done' end, '\nMismatches: ', o_custkey % 2, '\ntask_level:module 1.0 ', o_custkey % 10, ' 3 ', o_orderkey % 10, '\n')"


@query("""
select o_orderkey % 3 = 0 mismatch_passed, (o_orderkey % 4 = 0 or o_orderkey % 3 = 0 or o_custkey % 2 = 0) and not (o_orderkey % 5 = 0 and o_orderkey % 4 <> 0) and o_orderkey % 3 = 0 and o_custkey % 2 = 0 solution_passed, count(*) n, sum(o_custkey % 10)::double syntax, sum(o_orderkey % 10)::double functional from orders group by 1, 2
""")
def simulation_verdicts(spark: SparkSession, d: str) -> DataFrame:
    log = F.col("log")
    six = X.six_numbers(log)
    o = table(spark, d, "orders").select(F.expr(_SIMULATED.replace("\n", "\\n")).alias("log"))
    return o.select(X.mismatch_passed(log).alias("mismatch_passed"), X.solution_passed(log).alias("solution_passed"), six[1].alias("s"), six[3].alias("f")).groupBy("mismatch_passed", "solution_passed").agg(F.count("*").alias("n"), F.sum("s").alias("syntax"), F.sum("f").alias("functional"))


@query(r"""
select sha256('[' || '(''always'', ' || len(regexp_extract_all(x, '(?i)\balways\b')) || '), (''case'', ' || len(regexp_extract_all(x, '(?i)\bcase[xz]?\b')) || '), (''if'', ' || len(regexp_extract_all(x, '(?i)\bif\s*\(')) || '), (''nonblocking'', ' || (length(x) - length(replace(x, '<=', '='))) || '), (''registers'', ' || len(regexp_extract_all(x, '(?i)\b(?:reg|logic)\b')) || ')]') signature, count(*) n from (select reference_solution x from expanded where reference_solution is not null) group by 1
""")
def control_signatures(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "expanded").where("reference_solution is not null")
    return e.groupBy(X.control_signature(F.col("reference_solution")).alias("signature")).agg(F.count("*").alias("n"))


@query("""
select candidate_no, sha256('{' || array_to_string(list_sort(list_transform(map_entries(task.parameters), lambda e: to_json(e.key)::varchar || ':' || coalesce(to_json(e.value)::varchar, 'null'))), ',') || '}') h from candidates where task.parameters is not null
""")
def stable_hashes(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "candidates").where("task.parameters is not null")
    return c.select("candidate_no", X.stable_hash(F.col("task.parameters")).alias("h"))


@query(r"""
select record_no, md5(regexp_replace(reference_solution, '\bmodule\s+\w+', 'module top_' || record_no % 10)) renamed, coalesce(seed_id, '') || '::evolve::v' || record_no % 4 id, md5(case when evaluator_info.ref_path like '%.py' then replace(replace(reference_solution, 'import torch', 'import torch as t'), 'torch.', 't.') else reference_solution end) source, regexp_replace(id, '[^A-Za-z0-9._-]', '_', 'g') || '-' || substr(sha256(id), 1, 16) as key from expanded where reference_solution is not null and evaluator_info.ref_path is not null
""")
def renamed_sources(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "expanded").where("reference_solution is not null and evaluator_info.ref_path is not null")
    s, n = F.col("reference_solution"), F.col("record_no")
    renamed = X.force_module_name(s, F.concat(F.lit("top_"), (n % 10).cast("string")))
    source = X.renamed_imports(F.col("evaluator_info.ref_path"), s, {"import torch": "import torch as t", "torch.": "t."})
    return e.select("record_no", F.md5(renamed).alias("renamed"), X.expand_id(F.coalesce("seed_id", F.lit("")), F.lit("evolve"), n % 4).alias("id"), F.md5(source).alias("source"), T.task_key(F.col("id")).alias("key"))


_MARKED = "concat('line ', o_orderkey, '\n', case o_orderkey % 9 when 0 then 'x syntax error y' when 1 then 'TIMEOUT' when 2 then 'Unknown module type: q' when 3 then 'Unable to bind wire/reg `x' when 4 then 'some error' when 5 then 'Mismatches: 0 in 20 samples' else 'Mismatches: 3 in 20 samples' end, '\nTIMEOUT later'[1 : case when o_custkey % 6 = 0 then 20 else 0 end])"
_SOURCE = "case when o_custkey % 2 = 0 then 'always @(posedge reset)' else 'always @*' end"


@query("""
with m as (select case when o_orderkey % 9 = 0 then 'S' when o_orderkey % 9 = 2 then 'm' when o_orderkey % 9 = 1 or o_custkey % 6 = 0 then 'T' when o_orderkey % 9 = 3 then 'p' when o_orderkey % 9 = 4 then 'C' when o_orderkey % 9 = 5 then '.' when o_custkey % 2 = 0 then 'r' else 'R' end marker from orders)
select marker, count(*) n from m group by 1
""")
def failure_markers(spark: SparkSession, d: str) -> DataFrame:
    log = F.expr(_MARKED.replace("'\nTIMEOUT later'[1 : case when o_custkey % 6 = 0 then 20 else 0 end]", "case when o_custkey % 6 = 0 then '\\nTIMEOUT later' else '' end").replace("\n", "\\n"))
    return table(spark, d, "orders").groupBy(C.failure_marker(log, F.expr(_SOURCE)).alias("marker")).agg(F.count("*").alias("n"))


@query("""
with o as (select o_orderkey k, o_custkey c from orders)
select round(case k % 4 when 0 then 100.0 * (k % 8) / (k % 8 + c % 5 + 1) when 1 then 100.0 * (k % 8) / (k % 8 + c % 5 + 1) when 2 then 100.0 else 0.0 end, 6) percent, count(*) n from o group by 1
""")
def assertion_percents(spark: SparkSession, d: str) -> DataFrame:
    log = F.expr("case o_orderkey % 4 when 0 then concat('{\"passed\": ', o_orderkey % 8, ', \"x\": 1, \"failed\": ', o_custkey % 5 + 1, '}') when 1 then concat('PASSED: ', o_orderkey % 8, '\\nfailed:  ', o_custkey % 5 + 1) when 2 then 'all PASS' else 'PASS with mismatch' end")
    return table(spark, d, "orders").groupBy(F.round(C.assertion_percent(log), 6).alias("percent")).agg(F.count("*").alias("n"))


@query(r"""
with s as (select record_no, expanded_prompt || E'\n' || repeat('#', 40 + (record_no % 30)::int) || E'\n\n' || coalesce(tests, '') x, 40 + record_no % 30 >= 50 y, expanded_prompt p, coalesce(tests, '') t from expanded where not contains(expanded_prompt, '#') and not contains(coalesce(tests, ''), '#'))
select record_no, y has_tests, length(case when y then rtrim(p, E' \n\t\r\f') || E'\n' else x end) n_kernel, length(case when y then ltrim(t, E'\n') else '' end) n_tests from s
""")
def kernel_and_tests(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "expanded").where("not contains(expanded_prompt, '#') and not contains(coalesce(tests, ''), '#')")
    s = e.select("record_no", F.expr("concat(expanded_prompt, '\\n', repeat('#', cast(40 + record_no % 30 as int)), '\\n\\n', coalesce(tests, ''))").alias("x"))
    p = C.split_tests(F.col("x"))
    return s.select("record_no", F.contains("x", F.lit("#" * 50)).alias("has_tests"), F.length(p["kernel"]).cast("long").alias("n_kernel"), F.length(p["tests"]).cast("long").alias("n_tests"))


@query(r"""
with r as (select r.response_no, e.expanded_prompt u, r.content a, response_no % 5 k from llm_responses r join expanded e on e.record_no = r.expanded_no)
select case when k = 0 then 'too_few_messages' when k = 1 then 'missing_role' when coalesce(trim(u), '') = '' then 'empty_user' when coalesce(trim(a), '') = '' then 'empty_assistant' end problem, count(*) n from r group by 1
""")
def conversation_problems(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "expanded").select(F.col("record_no").alias("expanded_no"), F.col("expanded_prompt").alias("u"))
    r = table(spark, d, "llm_responses").select("response_no", "expanded_no", F.col("content").alias("a")).join(p, "expanded_no")
    messages = F.expr("case response_no % 5 when 0 then array(struct('user' as role, u as content)) when 1 then array(struct('user' as role, u as content), struct('system' as role, a as content)) else array(struct('system' as role, 'x' as content), struct('user' as role, u as content), struct('assistant' as role, a as content)) end")
    return r.groupBy(C.conversation_problem(messages).alias("problem")).agg(F.count("*").alias("n"))


@query(r"""
with e as (select reference_solution c, record_no % 3 k from expanded where reference_solution is not null)
select case when trim(c) = '' then 'missing_fence' when not contains(c, '@triton.jit') then 'missing_kernel' when k = 0 and regexp_matches(c, '\bdef\s+no_such\s*\(') or k > 0 and regexp_matches(c, '\bdef\s+forward\s*\(') then 'ok' else 'missing_wrapper' end format, count(*) n from e group by 1
""")
def kernel_formats(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "expanded").where("reference_solution is not null")
    wrapper = F.when(F.col("record_no") % 3 == 0, "no_such").otherwise("forward")
    return e.groupBy(C.kernel_format(F.col("reference_solution"), wrapper).alias("format")).agg(F.count("*").alias("n"))


@query(r"""
with s as (select id, prompt p, golden g from root_tasks where prompt is not null and golden is not null),
t as (select id, regexp_extract_all(lower(p), '[a-z0-9_]+') a, regexp_extract_all(lower(g), '[a-z0-9_]+') b from s),
n as (select id, case when len(a) >= 2 then list_distinct(list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1])) else [] end x, case when len(b) >= 2 then list_distinct(list_transform(range(1, len(b)), lambda i: b[i] || ' ' || b[i + 1])) else [] end y from t)
select id, len(x) n_prompt, len(y) n_golden, round(case when len(x) = 0 and len(y) = 0 then 1.0 else len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) end, 6) similarity from n
""")
def ngram_similarity(spark: SparkSession, d: str) -> DataFrame:
    grams = lambda c: T.ngrams(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9_]+"), F.lit(0)), 2)
    r = table(spark, d, "root_tasks").where("prompt is not null and golden is not null").select("id", grams("prompt").alias("x"), grams("golden").alias("y"))
    return r.select("id", F.size("x").cast("long").alias("n_prompt"), F.size("y").cast("long").alias("n_golden"), F.round(T.jaccard(F.col("x"), F.col("y")), 6).alias("similarity"))


@query(r"""
with t as (select record_no, string_split(expanded_prompt, E'\n') l from expanded where expanded_prompt is not null),
k as (select record_no, list_filter(list_transform(l, lambda x, i: case when i % 3 = 0 then 'cpu time ' || x else x end), lambda x: not regexp_matches(x, 'walltime|cpu time|\$finish at')) l from t)
select record_no, length(array_to_string(l, E'\n')) n_chars from k
""")
def transcripts(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts without their wall-clock lines; the line end of the last kept line does not count."""
    lines = F.transform(F.split("expanded_prompt", "\n"), lambda x, i: F.when(i % 3 == 2, F.concat(F.lit("cpu time "), x)).otherwise(x))
    text = T.normalised_transcript(F.concat(F.array_join(lines, "\n"), F.lit("\n")))
    return table(spark, d, "expanded").where("expanded_prompt is not null").select("record_no", F.greatest(F.length(text) - 1, F.lit(0)).cast("long").alias("n_chars"))


@query("""
with m as (select l_orderkey, list(case l_linenumber % 3 when 0 then '' when 1 then 'Request timed out' else l_returnflag || ' timeout' end) m, bool_or(l_returnflag = 'A') a from lineitem group by 1)
select a, len(list_filter(m, lambda x: x <> '')) > 0 all_timed_out, count(*) n from m group by all
""")
def timed_out_items(spark: SparkSession, d: str) -> DataFrame:
    message = F.expr("case l_linenumber % 3 when 0 then '' when 1 then 'Request timed out' else concat(l_returnflag, ' timeout') end")
    own = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(message).alias("m"), F.bool_or(F.col("l_returnflag") == "A").alias("a"))
    return own.groupBy("a", V.all_timed_out(F.col("m")).alias("all_timed_out")).agg(F.count("*").alias("n"))
