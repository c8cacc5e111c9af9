"""Fixtures with known answers, and brute force where SQL has no form."""

import random

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.functions import verdict as V
from tallyforge.operators import curate, eventlog, metrics


def samples(spark, rows):
    return spark.createDataFrame(rows, "item string, ok boolean, infra boolean")


def rate(df, policy="drop"):
    r = metrics.clean_pass_rate(df, "item", F.col("ok"), F.col("infra"), policy).first()
    return r.clean_rate, r.n_infra, r.n_fully_infra


def test_clean_rate_of_two_items(spark):
    full = [("a", True, False)] * 4
    assert rate(samples(spark, full + [("b", k < 2, False) for k in range(4)]))[0] == 75.0
    assert rate(samples(spark, full + [("b", k < 2, k == 3) for k in range(4)]))[:2] == (83.333333, 1)
    assert rate(samples(spark, full + [("b", False, True)] * 4)) == (100.0, 4, 1)


def test_policies_differ_for_an_item_of_only_infra(spark):
    df = samples(spark, [("x", True, False)] * 2 + [("y", False, True)] * 2)
    assert [rate(df, p)[0] for p in ("drop", "zero", "pool")] == [100.0, 50.0, 100.0]


def test_truncation_and_holes(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("a", 3, False)], "item string, k int, ok boolean")
    assert metrics.truncated_rate(df, "item", "k", F.col("ok")).first().pass_rate == 33.0
    holes = spark.createDataFrame([("a", 1, True), ("a", 4, True)], "item string, k int, ok boolean")
    assert metrics.truncated_rate(holes, "item", "k", F.col("ok")).first().pass_rate == 50.0


def test_gini_simpson(spark):
    df = spark.createDataFrame([("p", x) for x in (".", ".", "S", "R:7")], "item string, o string")
    assert metrics.gini_simpson(df, "item", F.col("o")).first().gini_simpson == 0.625


@pytest.mark.parametrize(("refs", "with_ref", "fast"), [({1, 2, 3, 4}, 3, 2), ({1}, 1, 1), (set(), 0, 0)])
def test_fast_share(spark, refs, with_ref, fast):
    rows = [(1, 10.0 if i in refs else None, ms) for i, ms in ((1, 4.0), (2, 20.0), (3, 8.0))]
    df = spark.createDataFrame(rows, "lvl int, _ref double, ms double")
    r = metrics.fast_share(df, ["lvl"], F.lit(True), F.col("_ref") / F.col("ms")).first()
    assert (r.n, r.n_correct, r.n_with_ref, r.fast_1x) == (3, 3, with_ref, fast)
    if with_ref == 3:
        assert (r.fast_2x, r.median_speedup, r.mean_speedup) == (1, 1.25, 1.416667)


def test_gate_demotes_untrusted_and_unknown_claims(spark):
    rows = [(True, "worker_start", "trusted_control_plane"), (True, "worker_start", "stdout"), (True, "made_up", "trusted_control_plane"), (False, None, None), (None, None, None)]
    df = spark.createDataFrame(rows, "c boolean, k string, ch string").select(*[c.alias(n) for n, c in V.gate(F.col("c"), F.col("k"), F.col("ch")).items()])
    assert [r.classification_reason for r in df.collect()] == ["accepted", "untrusted_channel", "unknown_code", "no_claim", "no_claim"]
    with pytest.raises(Exception, match="unknown infrastructure code"):
        spark.createDataFrame([("nope",)], "k string").select(V.require_known_code(F.col("k"))).collect()


def test_pass_predicates(spark):
    df = spark.createDataFrame([(0, []), (0, [(0,)]), (0, [(None,)]), (1, [(0,)]), (0, None)], "e int, t array<struct<result:int>>")
    assert [r[0] for r in df.select(V.all_passed(F.col("t"), errors=F.col("e"))).collect()] == [False, True, False, False, False]
    said = spark.createDataFrame([(["Request timed out", ""],), (["Request timed out", "boom"],), ([],)], "m array<string>")
    assert [r[0] for r in said.select(V.all_timed_out(F.col("m"))).collect()] == [True, False, False]


def test_text_columns(spark):
    df = spark.createDataFrame([("Module  A; // x\n/* y */ 8'hFF",)], "t string")
    assert df.select(T.normalised(F.col("t"))).first()[0] == "module a ; 8'hff"
    assert df.select(T.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")), T.jaccard(F.array(F.lit("a")), F.array().cast("array<string>"))).first()[:] == (1.0, 0.0)
    fenced = spark.createDataFrame([("x\n```verilog\nmodule a; endmodule\n```\n```\nb\n```",)], "t string")
    assert fenced.select(T.fenced(F.col("t")), T.last_fenced(F.col("t")), T.largest(T.fenced(F.col("t")))).first()[:] == (["module a; endmodule\n", "b\n"], "b\n", "module a; endmodule\n")
    think = spark.createDataFrame([("<think>a</think> b",), ("a</think>c",), ("d",)], "t string")
    assert [r[0] for r in think.select(T.strip_think(F.col("t"))).collect()] == ["b", "c", "d"]


def test_hash_modulo_is_exact(spark):
    import hashlib

    names = [f"name {i}" for i in range(40)]
    df = spark.createDataFrame([(x,) for x in names], "t string")
    assert [r[0] for r in df.select(T.hash64_mod(F.col("t"), 13)).collect()] == [int(hashlib.sha256(x.encode()).hexdigest()[:16], 16) % 13 for x in names]


def test_mutation_score(spark):
    m = [("m%d" % i, i == 0, "valid", i != 0) for i in range(6)] + [("bad", True, "invalid", False)]
    df = spark.createDataFrame([(m,), (None,)], "m array<struct<name:string,core:boolean,status:string,killed:boolean>>")
    a, b = df.select(*[c.alias(k) for k, c in curate.mutation_score(F.col("m")).items()]).collect()
    assert (a.n_valid, a.n_killed, a.core_survivors, a.passed) == (6, 5, "m0", False)
    assert b.passed is False


def test_last_wins_and_first_failing(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None)], "id string, at int, v string")
    assert sorted((r.id, r.v) for r in curate.last_wins(df, ["id"], ["at"]).collect()) == [("a", "y"), ("b", None)]
    g = spark.createDataFrame([([("s", True), ("t", None), ("u", False)],), ([],)], "g array<struct<gate:string,passed:boolean>>")
    assert [r[0] and r[0].gate for r in g.select(curate.first_failing(F.col("g"))).collect()] == ["t", None]


def scan(rows, threshold=0.8, n=5):
    """The sequential scan the greedy operator must equal."""
    import re

    def shape(t):
        tok = re.findall(r"[a-z_][a-z0-9_]*|[0-9]+'[a-z0-9]+|[0-9]+|[^ \t\r\n\fa-z0-9_]", (t or "").lower())
        return " ".join(tok), {" ".join(tok[i : i + n]) for i in range(len(tok) - n + 1)}

    kept, out = [], {}
    for k, i, t in sorted(rows):
        text, g = shape(t)
        hit = None
        for k2, i2, text2, g2 in kept:
            if (i or "") == (i2 or "") and (text == text2 or (not g and not g2) or (g or g2) and len(g & g2) / len(g | g2) >= threshold):
                hit = k2
                break
        if hit is None:
            kept.append((k, i, text, g))
        out[k] = hit
    return out


def test_greedy_equals_the_scan(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    rows, base = [], []
    for k in range(160):
        if base and rng.random() < 0.7:
            t = list(rng.choice(base))
            for _ in range(rng.choice([0, 1, 1, 2])):
                t[rng.randrange(len(t))] = rng.choice(words)
        else:
            t = [rng.choice(words) for _ in range(60)]
        base.append(t)
        rows.append((k, rng.choice(["p", "q", None]), rng.choice([None, "", "a b"]) if rng.random() < 0.05 else " ".join(t)))
    df = spark.createDataFrame(rows, "k int, i string, t string").repartition(3)
    got = {r.key: r.duplicate_of for r in curate.greedy_near_duplicates(df, "k", "k", "i", "t").collect()}
    assert got == scan(rows)


def test_greedy_keeps_a_and_c(spark):
    a = [f"x{i}" for i in range(100)]
    b, c = a[:], a[:]
    b[0:8] = [f"y{i}" for i in range(8)]
    c[0:8] = b[0:8]
    c[90:98] = [f"z{i}" for i in range(8)]
    df = spark.createDataFrame([(1, "p", " ".join(a)), (2, "p", " ".join(b)), (3, "p", " ".join(c))], "k int, i string, t string")
    got = {r.key: (r.kept, r.duplicate_of) for r in curate.greedy_near_duplicates(df, "k", "k", "i", "t").collect()}
    assert got == {1: (True, None), 2: (False, 1), 3: (True, None)}


def test_capped_selection_under_a_binding_operator_cap(spark):
    rng = random.Random(1)
    rows = [(i, f"r{rng.randrange(12)}", "o1" if rng.random() < 0.8 else f"o{rng.randrange(2, 5)}") for i in range(300)]
    df = spark.createDataFrame(rows, "id int, root string, operator string")
    out = curate.capped_selection(df, "root", "operator", [F.col("id").desc()], target=30)
    got = out.collect()
    assert max(sum(r.operator == o for r in got) for o in {r.operator for r in got}) <= 12
    by_pair, turns = {}, {}
    for i, root, op in sorted(rows, reverse=True):
        if by_pair.get((root, op), 0) < 3 and len(turns.setdefault(root, [])) < 8:
            by_pair[root, op] = by_pair.get((root, op), 0) + 1
            turns[root].append((i, op))
    used, want = {}, []
    for turn in range(8):
        for root in sorted(turns):
            if turn < len(turns[root]) and len(want) < 30:
                i, op = turns[root][turn]
                if used.get(op, 0) < 12:
                    used[op] = used.get(op, 0) + 1
                    want.append(i)
    assert sorted(r.id for r in got) == sorted(want)


def selected(rows, target, per_root=8, per_pair=3, share=0.4):
    """The loop that the selection must equal: roots take turns, a capped row is passed over in its turn."""
    by_root = {}
    for i, root, op in sorted(rows, reverse=True):
        by_root.setdefault(root, []).append((i, op))
    out, roots, pairs, ops = [], {}, {}, {}
    while len(out) < target:
        before = len(out)
        for root in sorted(by_root):
            for i, op in by_root[root]:
                if i in out or pairs.get((root, op), 0) >= per_pair or ops.get(op, 0) + 1 > int(target * share):
                    continue
                if roots.get(root, 0) < per_root:
                    out.append(i)
                    roots[root], pairs[root, op], ops[op] = roots.get(root, 0) + 1, pairs.get((root, op), 0) + 1, ops.get(op, 0) + 1
                break
            if len(out) == target:
                break
        if len(out) == before:
            return None
    return out


@pytest.mark.parametrize(("n_roots", "target", "share", "skew"), [(6, 40, 0.2, 0.8), (40, 30, 0.4, 0.9), (12, 60, 0.3, 0.6), (5, 39, 0.4, 0.5), (4, 60, 0.2, 0.9)])
def test_capped_selection_equals_the_loop(spark, n_roots, target, share, skew):
    rng = random.Random(n_roots)
    rows = [(i, f"r{rng.randrange(n_roots):02d}", "o1" if rng.random() < skew else f"o{rng.randrange(2, 6)}") for i in range(400)]
    df = spark.createDataFrame(rows, "id int, root string, operator string").repartition(3)
    want = selected(rows, target, share=share)
    run = lambda: curate.capped_selection(df, "root", "operator", [F.col("id").desc()], target=target, operator_share=share)
    if want is None:
        with pytest.raises(ValueError, match="exhausted"):
            run()
    else:
        assert sorted(r.id for r in run().collect()) == sorted(want)


def test_plans_gates_and_logs(spark):
    from tallyforge.functions import extract as X
    from tallyforge.operators import planning, rescore

    roots = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "none"), (None, "x")], "id string, c string")
    contracts = [("one", ["x", "y"], {"k": ["1", "2"], "a": ["p", "q"]}), ("two", ["x"], {"m": ["5"]})]
    plan = {}
    for r in planning.planned(roots, "id", "c", contracts, 4).orderBy("turn").collect():
        plan.setdefault(r.root, []).append((r.operator, r.signature))
    assert plan["b"] == [("one", "a=p,k=1"), ("one", "a=p,k=2"), ("one", "a=q,k=1"), ("one", "a=q,k=2")] and "c" not in plan
    assert sorted(plan["a"]) == [("one", "a=p,k=1"), ("one", "a=p,k=2"), ("one", "a=q,k=1"), ("two", "m=5")]
    edges = spark.createDataFrame([(2, 1), (3, 2), (1, 3), (5, 4)], "n int, needs int")
    assert {tuple(r) for r in eventlog.invalidated(edges, "n", "needs", spark.createDataFrame([(1,)], "n int")).collect()} == {(1, 0), (2, 1), (3, 2)}
    log = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "a")], "e int, s int, t string")
    steps = [(None, "a"), ("a", "b")]
    assert {tuple(r) for r in eventlog.replay_strict(log, "e", ["s"], "t", steps).collect()} == {(1, "b", 2, "a"), (2, "a", 1, "a")}
    with pytest.raises(Exception, match="illegal event"):
        eventlog.replay_strict(log, "e", ["s"], "t", steps[:1]).collect()
    raw = spark.createDataFrame([("<think>module t; endmodule</think>```verilog\nmodule a; endmodule\n```\n[BEGIN]\nmodule b; endmodule\n[DONE]", "module z"), ("```\nmodule a; x", ""), ("prose module a; endmodule", ""), ("", None), ("```\nmodule a; endmodule\n```", "module a; endmodule ")], "r string, o string")
    got = raw.select(X.picked_module(F.col("r")).alias("p"), X.module_candidates(F.col("r")).alias("c"), rescore.diagnosis(F.col("r"), F.col("o"), F.lit(False), F.lit(False)).alias("d")).collect()
    assert [tuple(r.p) for r in got] == [("module b; endmodule", "complete"), ("module a; x", "truncated"), ("", "empty"), ("", "empty"), ("module a; endmodule", "complete")]
    assert got[0].c == ["module b; endmodule", "module a; endmodule"] and [r.d for r in got] == ["recoverable", "truncated", "empty", "empty", "clean"]
    dry = spark.createDataFrame([("[DRYRUN x]\na\nb\n[END]",), ("plain",)], "t string")
    assert [r[0] for r in dry.select(X.strip_dryrun(F.col("t"))).collect()] == ["a\nb", "plain"]
    judged = spark.createDataFrame([('x {"passed": true, "issues": [], "covered_obligations": ["a"]} y',), ("none",), ('{"passed": 1}',), ('{"passed": false, "issues": 2}',), (None,)], "t string").select(X.judged_json(F.col("t")).alias("j")).collect()
    assert [r.j.problem for r in judged] == [None, "no_object", "no_passed", "no_issues", "no_object"]
    items = curate.numbered(spark.range(100).repartition(7).withColumnRenamed("id", "v"), "v").collect()
    assert all(r.v == r.i for r in items)
    with pytest.raises(ValueError, match="no shards"):
        curate.shard_union([])


def scan_pairs(rows, least, n=5):
    """The sequential scan over two texts: equal ones count across interfaces, near ones within."""
    grams = lambda t: {tuple(t.split()[i : i + n]) for i in range(len(t.split()) - n + 1)}
    alike = lambda a, b, x: (not a and not b) or bool(a and b) and len(a & b) / len(a | b) >= x
    kept, out = [], {}
    for k, i, *t in sorted(rows):
        g = [grams(x) for x in t]
        out[k] = next((k2 for k2, i2, t2, g2 in kept if any(a == b for a, b in zip(t, t2)) or i == i2 and any(alike(a, b, x) for a, b, x in zip(g, g2, least))), None)
        if out[k] is None:
            kept.append((k, i, t, g))
    return out


def test_greedy_over_prompt_and_golden_across_interfaces(spark):
    rng = random.Random(8)
    pool = {c: [[f"{c}{rng.randrange(40)}" for _ in range(30)] for _ in range(45)] for c in "pg"}

    def some(c):
        t = list(rng.choice(pool[c]))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            t[rng.randrange(30)] = f"{c}{rng.randrange(40)}"
        return " ".join(t) if rng.random() > 0.06 else rng.choice(["", "a b", "c"])

    rows = [(k, rng.choice("xyz"), some("p"), some("g")) for k in range(120)]
    rows += [(900, "u", "one two three four five six", "g g g h h h"), (901, "v", "one two three four five six", "k l m n o p"), (902, "w", "q r s t u v", "g g g h h h"), (903, "w", "f f", "n n n m m m")]
    df = spark.createDataFrame(rows, "k int, i string, p string, g string").repartition(3)
    got = {r.key: r.duplicate_of for r in curate.greedy_near_duplicates(df, "k", "k", "i", {"p": 0.8, "g": 0.6}, across=True).collect()}
    assert got == scan_pairs(rows, (0.8, 0.6))
    assert (got[901], got[902], got[903]) == (900, 900, None)


def select_direct(rows, target, per_root=8, per_pair=3, share=0.4):
    """The rounds of the definition: a capped record is passed over for the root's next one in the same round."""
    by_root, picked, n_root, n_pair, n_op = {}, [], {}, {}, {}
    for i, root, op in sorted(rows, reverse=True):
        by_root.setdefault(root, []).append((i, op))
    progress = True
    while len(picked) < target and progress:
        progress = False
        for root in sorted(by_root):
            for i, op in by_root[root]:
                if i in picked or n_pair.get((root, op), 0) >= per_pair or n_op.get(op, 0) + 1 > int(target * share):
                    continue
                if n_root.get(root, 0) < per_root and len(picked) < target:
                    picked.append(i)
                    n_root[root], n_pair[root, op], n_op[op], progress = n_root.get(root, 0) + 1, n_pair.get((root, op), 0) + 1, n_op.get(op, 0) + 1, True
                break
    return picked


def test_capped_selection_replaces_capped_rows_in_the_same_round(spark):
    # the best rows of every root are of three operators that fill up; the other operators rank ninth and lower
    rows = [(1000 * r + 100 - k, f"r{r}", f"o{k // 3}") for r in range(6) for k in range(18)]
    df = spark.createDataFrame(rows, "id int, root string, operator string").repartition(3)
    for target, share in ((40, 0.2), (30, 0.2), (18, 0.1)):
        got = curate.capped_selection(df, "root", "operator", [F.col("id").desc()], target=target, operator_share=share, exact=False).collect()
        assert sorted(r.id for r in got) == sorted(select_direct(rows, target, share=share))
    with pytest.raises(ValueError, match="exhausted at"):
        curate.capped_selection(df, "root", "operator", [F.col("id").desc()], target=49)
    with pytest.raises(ValueError, match="roots 6/7"):
        curate.capped_selection(df, "root", "operator", [F.col("id").desc()], target=10, min_roots=7, operator_share=1.0)


def test_chain_edges_and_ready(spark):
    log = spark.createDataFrame([("l", 1, "d1", None, "k1"), ("l", 2, "d2", "d1", "k2"), ("l", 3, "d3", "dX", "k3"), ("l", 4, "d4", "d3", "k2")], "log string, seq int, d string, p string, k string")
    assert {(r.seq, r.reason) for r in eventlog.chain_violations(log, "log", "seq", "d", "p", "k").collect()} == {(3, "broken_chain"), (2, "repeated_key"), (4, "repeated_key")}
    ev = spark.createDataFrame([("e", 1, "new"), ("e", 2, "run"), ("e", 3, "new")], "e string, s int, st string")
    assert [r.legal for r in eventlog.edge_check(ev, "e", ["s"], "st", [(None, "new"), ("new", "run")]).orderBy("s").collect()] == [True, True, False]
    tasks = spark.createDataFrame([("a",), ("b",), ("c",)], "task string")
    edges = spark.createDataFrame([("b", "a"), ("c", "a"), ("c", "b")], "task string, needs string")
    assert {r.task: r.ready for r in eventlog.ready(tasks, edges, "task", "needs", tasks.where("task = 'a'")).collect()} == {"a": True, "b": True, "c": False}


def test_supersession_tips(spark):
    n = 150  # longer than a bounded walk of 100 steps
    df = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(n, None), (500, 77777), (600, n)], "id int, next int").repartition(3)
    got = {r.start: (r.tip, r.depth) for r in eventlog.supersession_tips(df, "id", "next").collect()}
    assert got == {i: (n, n - i) for i in range(n + 1)} | {500: (500, 0), 600: (n, 1)}
    for bad, said in (([(1, 2), (2, 3), (3, 1), (4, 1)], "cycle"), ([(1, 1)], "cycle"), ([(1, 2), (1, 3)], "unique")):
        with pytest.raises(ValueError, match=said):
            eventlog.supersession_tips(spark.createDataFrame(bad, "id int, next int"), "id", "next")


def test_pass_at_k(spark):
    df = spark.createDataFrame([(5.0, 2.0), (5.0, 0.0), (2.0, 1.0), (3.0, 3.0)], "n double, c double")
    assert [None if r[0] is None else round(r[0], 6) for r in df.select(metrics.pass_at_k(F.col("n"), F.col("c"), 3)).collect()] == [0.9, 0.0, None, 1.0]


def test_normalised_and_ports(spark):
    from tallyforge.functions import text as T

    rows = {"// see /* note\nassign x = 1;\n/* real */ y": "assign x = 1 ; y", "8'b1010_zzzz + 4'hF": "8'b1010_zzzz + 4'hf", "a/* b\nc */d // e": "a d", "Été x_1 $y": "é té x_1 $ y", "/* open": "/ * open"}
    df = spark.createDataFrame([(x,) for x in rows], "t string")
    assert [r[0] for r in df.select(T.normalised(F.col("t"))).collect()] == list(rows.values())
    source = "module m #(parameter W = 8) (a);\nmodule n (input [W-1:0] x, input signed [3:0] y, output reg  [7:0] z,\n inout w, input wire clk, output logic [7:0] z);\nendmodule"
    got = spark.createDataFrame([(source,), ("input a; OUTPUT [3:0] q;",), ("no ports here",)], "t string").select(T.port_list(F.col("t")).alias("p")).collect()
    assert [tuple(p) for p in got[0].p] == [("input", "x", "(W-1)-(0)+1"), ("input", "y", "(3)-(0)+1"), ("output", "z", "(7)-(0)+1"), ("inout", "w", "1"), ("input", "clk", "1")]
    assert [tuple(p) for p in got[1].p] == [("input", "a", "1"), ("output", "q", "(3)-(0)+1")] and got[2].p == []
