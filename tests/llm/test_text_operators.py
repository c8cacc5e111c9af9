"""Problems 1 to 5 and their parts, against brute force, round trips and held-out accuracy."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import cuts, languages, leaks, linear, neardup, pairs, syntax, tokens
from tallyforge.llm.fmindex import FMIndex, suffix_array


def test_words_and_shingles_equal_a_plain_split():
    rng = random.Random(1)
    texts = ["", "a", "  A_b c1--c1 ", "x" * 5000] + ["".join(rng.choice("ab _.\n") for _ in range(200)) for _ in range(20)]
    w = tokens.words([t.encode().translate(tokens.LOWER) for t in texts])
    plain = [re.findall(r"[a-z0-9_]+", t.lower()) for t in texts]
    assert np.diff(w.first).tolist() == [len(p) for p in plain]
    names = [x for p in plain for x in p]
    assert len({(n, h) for n, h in zip(names, w.hash.tolist(), strict=True)}) == len(set(names)) == len(set(w.hash.tolist()))
    h, d = tokens.shingles(w, 3)
    grams = [(i, tuple(p[j : j + 3])) for i, p in enumerate(plain) for j in range(len(p) - 2)]
    assert d.tolist() == [i for i, _ in grams]
    assert len({(g, x) for (_, g), x in zip(grams, h.tolist(), strict=True)}) == len({g for _, g in grams}) == len(set(h.tolist()))


@pytest.mark.parametrize(("n", "width"), [(1, 2), (5, 2), (60, 2), (300, 3), (300, 9)])
def test_index_finds_every_place(n, width):
    rng = np.random.default_rng(n + width)
    s = rng.integers(0, width, n)
    assert suffix_array(s + 1).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())
    index = FMIndex(s, width)
    phrases = rng.integers(1, width, (40, 3))
    at, which = index.locate(*index.search(phrases))
    want = sorted((j, i) for j in range(40) for i in range(n - 2) if (s[i : i + 3] == phrases[j]).all())
    assert sorted(zip(which.tolist(), at.tolist(), strict=True)) == want


def prompt(rng, n=80):
    return [f"{rng.choice(['alpha', 'beta', 'gamma', 'delta'])}_{rng.randrange(10**6)}" if rng.random() < 0.4 else rng.choice("the of unit stays high when counter loads value before next cycle".split()) for _ in range(n)]


def test_leaks(spark):
    rng = random.Random(2)
    held = {f"g{i}": prompt(rng) for i in range(6)}
    stock = "answer with code only and keep the given names and their order please".split()
    for w in held.values():
        w[:0] = stock
    filler = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    a = held["g0"][20:]
    edited = a[:34]
    for i in (6, 13, 20, 27):
        edited[i] = "changed"
    docs = {
        1: filler(30) + a[:18] + filler(9),
        2: filler(30) + a[:14] + filler(9),
        3: filler(5) + edited + filler(5),
        4: stock + filler(60),
        5: filler(40) + [w.upper() + "," for w in held["g1"][30:60]],
        6: [x for w in held["g2"][20:50] for x in (w[: len(w) // 2] + "\u200b" + w[len(w) // 2 :], "\n>")],
        7: a[:18] + filler(4) + held["g3"][20:45],
        8: a[:16] + filler(1) + a[40:56],
    }
    rows = [(k, " ".join(v), "x") for k, v in docs.items()] + [(1, " ".join(docs[1]), "again"), (9, None, "n"), (10, "", "e"), (None, " ".join(a), "k"), (11, " ".join(filler(40000)) + " " + " ".join(a[:25]), "long")]
    corpus = spark.createDataFrame(rows, "key long, text string, record_key string")
    held_rows = spark.createDataFrame([(g, " ".join(w), 1) for g, w in held.items()] + [(None, "x y", 1), ("gn", None, 1)], "contamination_group string, original_prompt string, corpus int")
    found = leaks.find_leaks({"d": (corpus, "key", "text")}, held_rows, "contamination_group", "original_prompt")
    got = sorted((r.record_key, r.contamination_group) for r in found.collect())
    assert got == sorted([(1, "g0"), (1, "g0"), (3, "g0"), (5, "g1"), (6, "g2"), (7, "g0"), (7, "g3"), (11, "g0")])
    empty = leaks.find_leaks({"d": (corpus.limit(0), "key", "text")}, held_rows, "contamination_group", "original_prompt")
    assert empty.collect() == []
    assert leaks.find_leaks({"d": (corpus, "key", "text")}, held_rows.limit(0), "contamination_group", "original_prompt").collect() == []
    with pytest.raises(ValueError, match="more than 2"):
        leaks.find_leaks({"d": (corpus, "key", "text")}, held_rows, "contamination_group", "original_prompt", max_items=2)


def responses(spark):
    return spark.read.parquet("/root/testdata/sf0.01/llm_responses.parquet")


def test_cuts_held_out_accuracy(spark):
    rows = responses(spark).where("finish_reason = 'stop' and not truncated and length(content) > 400").select("content", "source").orderBy("response_no").limit(1300).collect()
    values = [(r[0], r[1]) for r in rows]
    model = cuts.fit(values[:1000])
    rng = np.random.default_rng(9)
    intact = [v for v, _ in values[1000:]]
    cut = [c for v in intact if (c := cuts.cut(v, rng))]
    assert model.is_cut(cut, [None] * len(cut)).mean() > 0.88
    assert model.is_cut(intact, [None] * len(intact)).mean() < 0.08


def test_cuts_edges(spark):
    base = responses(spark).where("finish_reason = 'stop'").limit(300).select(F.col("response_no").alias("no"), "source", "content", F.lit(1).alias("key"), F.lit("x").alias("field"))
    odd = spark.createDataFrame([(-1, None, None, 1, "x"), (-2, "s", " ", 1, "x"), (-3, None, "N/A", 1, "x"), (-4, "s", "All is well. " * 30000 + "And then the", 1, "x"), (-4, "s", "All is well. " * 30000 + "And then the", 1, "x")], "no long, source string, content string, key int, field string")
    df = base.unionByName(odd)
    got = {}
    for r in cuts.truncated_values(df, "no", "source", ["content"], sample=200).where("key < 0").collect():
        got.setdefault(r.key, []).append(r.cut)
    assert set(got) == {-3, -4} and got[-3] == [False] and len(got[-4]) == 2 and len(set(got[-4])) == 1
    assert cuts.truncated_values(df.limit(0), "no", "source", ["content"]).collect() == []


GOOD_V = [
    "", "// only a comment\n", "module a; endmodule", "`timescale 1ns/1ps\nmodule a(input b, output reg [3:0] c);\n always @(posedge b or negedge b) begin if (!b) c <= 4'd0; else c <= c + 1; end\nendmodule\n",
    "module a #(parameter W = 8)(input logic [W-1:0] x, output y);\n wire t = x[0] ? ~&x : (x[3:1] <= 2);\n assign y = t;\n initial $display(\"a) begin\");\n b #(.W(4)) u (.x(x), .y());\nendmodule",
    "module a;\n localparam N = 3, M = 4;\n integer i;\n always_comb begin : blk\n for (i = 0; i < 4; i = i + 1) begin q[i] = {x, {2{y}}}; end\n case (s) 2'b00, 2'b01: z = 1; default: begin end endcase\n end\n function [3:0] f; input [3:0] k; f = k; endfunction\nendmodule\nmodule b; endmodule",
]
BAD_V = [
    "module a; ", "endmodule", "module a(input b output c); endmodule", "module a; assign x = ; endmodule", "module a; assign x = (y; endmodule", "module a; always @(posedge c) begin x <= 1; endmodule", "module a; assign x = y endmodule",
    "<<<<<<< HEAD\nmodule a; endmodule\n=======\n>>>>>>> b\n", "```verilog\nmodule a; endmodule\n```", "<!doctype html><html></html>", "import torch\nx = 1\n", "entity e is end entity;", "module a; initial $display(\"x); endmodule", "module a; /* open\nendmodule", "module a; if (x) else y <= 1; endmodule", "\u200bmodule a; endmodule",
]
GOOD_P = ["# c\n", "import a\nx = [1,\n 2]\n", "@d(1)\ndef f(a, *b, c=1, **k) -> int:\n    '''doc'''\n    for i in range(3):\n        if i: continue\n        else:\n            x[i:2] += -a.b(c, d=e)\n    return {1: 2}\n", "class A(B):\n    pass\ntry:\n    a()\nexcept E as e:\n    raise X from e\nfinally:\n    pass\nlambda x: x\n", "\ufeffx = f'{a!r}'\r\ny = 1\r\n"]
BAD_P = ["def f(:\n  pass\n", "x = (1\n", "if x\n  y\n", "print 'a'\n", "def f():\nreturn 1\n", "  x = 1\n y = 2\n", "<<<<<<< a\nx\n", "module a; endmodule", "x = 'abc\n", "for i in x:\n"]


def test_source_files(spark):
    rows = [(i, "a.v" if lang == "v" else "x/b.PY", t) for i, (lang, t) in enumerate([("v", t) for t in GOOD_V + BAD_V] + [("p", t) for t in GOOD_P + BAD_P])]
    extra = [(900, "a.v", None), (901, "a.sv", " \u200b\n"), (902, "a.txt", "((("), (903, None, "((("), (904, "a.v", "module a; " + "assign x = y; " * 20000 + "endmodule"), (905, "a.sv", "module ("), (905, "a.sv", "module (")]
    df = spark.createDataFrame([(k, p, t, None, "c") for k, p, t in rows + extra], "n long, path string, code string, repo string, classes string")
    bad = [r.record_key for r in syntax.invalid_files(syntax.source_files({"t": (df, "n", "path", "code", "repo")})).collect()]
    want = [i for i, (_, _, t) in enumerate(rows) if t in BAD_V and i < len(GOOD_V + BAD_V) or i >= len(GOOD_V + BAD_V) and t in BAD_P] + [905, 905]  # repeated rows are judged each
    assert sorted(bad) == sorted(want)
    assert syntax.invalid_files(syntax.source_files({"t": (df.limit(0), "n", "path", "code", "repo")})).collect() == []


def test_files_under_one_key_are_judged_each(spark):
    rows = [(k, "a.py", t, None) for k in range(20) for t in ("x = lambda a: a\n", "x = (1\n")] + [(k, "a.v", t, None) for k in range(20) for t in ("module a; endmodule", "module a; assign x = ; endmodule")]
    df = spark.createDataFrame(rows, "n long, path string, code string, repo string").repartition(4)
    bad = [(r.record_key, r.language) for r in syntax.invalid_files(syntax.source_files({"t": (df, "n", "path", "code", "repo")})).collect()]
    assert sorted(bad) == sorted((k, x) for k in range(20) for x in ("python", "verilog"))


def test_verilog_items_beyond_assignments_and_processes():
    good = [
        "or g1(y, a, b);", "or (y, a, b);", "nand #(1, 2) g2(y, a, b), g3(y, b, a);", "(* keep *) wire x; (* full_case, parallel_case = 1 *) reg q;", "always @(*) (* full_case *) case (a) 0: y = 1; default: y = 0; endcase",
        "initial do begin i = i + 1; end while (i < 5);", "initial begin do x = x + 1; while (x != 5); while (z); end", "initial fork a = 1; b = 2; join", "initial begin fork : f #1 a = 1; begin b = 2; end join_any disable fork; wait fork; end",
        "always @(posedge a) assert (a == 1);", 'always_comb begin assert (a) else $error("x"); assume (a); cover (a) x = 1; end', "always_comb begin chk: assert (a) x = 1; else y = 2; end", "assign y = a inside {1, 2, [4:6]};",
    ]
    bad = [
        "or g1(y, a, b)", "or ;", "(* keep wire x;", "(* *) wire x;", "(* keep *)", "assign y = a or b;", "initial do x = 1; while (x)", "initial do x = 1;", "initial fork a = 1;", "initial begin a = 1; join", "always_comb assert ();", "always_comb begin assert (a) end",
        "assign y = a inside ;", "assign y = inside {1};",
    ]
    permitted = {x for lang, x in syntax.permissible_pairs() if lang == "verilog"}
    rows = [syntax.lex_verilog(f"module m(input a);\n{t}\nendmodule\n") for t in good + bad]
    odd = [any(c[i : i + 2] not in permitted for i in range(len(c) - 1)) for c in rows]
    assert [a or b for a, b in zip(odd, syntax.unparsed(rows, "verilog"), strict=True)] == [False] * len(good) + [True] * len(bad)


def test_python_suspects_hold_all_that_does_not_parse():
    rng = random.Random(3)
    base = GOOD_P[2] + "\n" + GOOD_P[1]
    permitted = {x for lang, x in syntax.permissible_pairs() if lang == "python"}
    missed = []
    suspect_of = lambda c: syntax.unparsed([c], "python")[0] or any(c[i : i + 2] not in permitted for i in range(len(c) - 1))
    for wrong in ("f(a=1, b)", "5 = x", "a += b += c", "if x:\n    y()\nfinally:\n    z()", "a while b else c", "f() = 1", "try:\n    a()\nelse:\n    b()", "while x:\n    y()\nelif z:\n    a()", "x + 1 = 2", "del 5", "f() += 1"):
        assert suspect_of(syntax.lex_python(wrong + "\n")), wrong
    for _ in range(600):
        t = list(base)
        for _ in range(rng.choice([1, 2])):
            i = rng.randrange(len(t))
            if rng.random() < 0.6:
                del t[i]
            else:
                t[i] = rng.choice("()[]:=,.'\n x1")
        t = "".join(t)
        c = syntax.lex_python(t)
        if not syntax.python_parses(t) and not suspect_of(c):
            missed.append(t)
    assert missed == []


def test_answers():
    assert not any(re.search(r"\w", pairs.essence(x)) for x in [None, "", " \n", "\u200b", "```\n```", "<answer></answer>", "<think>a b</think>", "<think>a</think>\n<answer>\n</answer>"])
    assert pairs.essence("<think>a</think> b c") == "b c" and pairs.essence("// keep x\nmodule a; endmodule").startswith("//")
    assert pairs.split("Here it is.\n```verilog\nmodule a;\n```\nDone.")[0].strip() == "module a;"
    code, prose = pairs.split("Here it is.\n// note\nmodule a;\nendmodule\nDone.")
    assert code == "module a;\nendmodule" and prose.split() == ["Here", "it", "is.", "Done."]
    assert pairs.code_languages(["module a; assign b = c; endmodule", "def f():\n    return torch.x", "library ieee;\nentity a is\narchitecture b", "plain words", ""]) == ["verilog", "python", "vhdl", None, None]
    assert pairs.asked("Write it. Please give the explanation in German.") == "de" and pairs.asked("Write it.") is None


def test_languages(spark):
    prompts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.1/expanded.parquet").where("expanded_prompt is not null").orderBy("record_no").select("expanded_prompt").limit(1500).collect()]
    model = languages.Languages.fit(prompts, ["module a;\n  assign b_1 = c_2;\nendmodule\n"] * 20)
    assert set(model.names) == {"en", "de", "fr", "es", "zh", "code"}
    held = {"en": "Here is a plain description of what the unit does, written in other words.", "de": "Hier ist das gewünschte Modul mit einer kurzen Erklärung der Ports.", "fr": "Le module lit le mot suivant et la sortie reste inactive jusqu'au prochain cycle.", "es": "El módulo lee la palabra y después la guarda en la cola del contador."}
    assert model.languages(list(held.values())) == list(held)
    others = ["Модуль сначала читает слово и затем записывает его в память, если сигнал низкий.", "このモジュールは最初に単語を読み取り、次にメモリに書き込みます。信号が低い場合。", "이 모듈은 먼저 단어를 읽고 메모리에 씁니다. 신호가 낮으면 카운터는 변하지 않습니다.", "Modulen läser först ordet och skriver sedan in det i minnet när signalen är låg."]
    assert not {"en", "de", "fr", "es", "zh", None} & set(model.languages(others))
    assert model.languages(["", "x_1 = 2;", "12"]) == [None] * 3 and languages.Languages.fit([], []).languages(["some words of prose here"]) == [None]


def test_pair_classifier(spark, monkeypatch):
    e = spark.read.parquet("/root/testdata/sf0.1/expanded.parquet").orderBy("record_no").limit(1400).collect()
    rows = [(r.expanded_prompt, r.reference_solution, "python" if r.source_dataset.startswith(("kern", "triton")) else "verilog", None) for r in e]
    # every third wording of a refusal is held out of the fit
    every = pairs._REFUSALS
    monkeypatch.setattr(pairs, "_REFUSALS", [x for i, x in enumerate(every) if i % 3])
    model = pairs.fit(rows[:1000])
    monkeypatch.setattr(pairs, "_REFUSALS", every[::3])
    test = [r for r in rows[1000:] if r[1] and r[1].strip()]
    verdict = lambda answers: model.defects([r[0] for r in test], answers, [r[2] for r in test], [None] * len(test))
    rng = np.random.default_rng(1)
    assert verdict([""] * len(test))[:, 0].all() and verdict([None] * len(test)).sum() == len(test)
    assert verdict([pairs._emptied(rng, "It is so.") for _ in test])[:, 0].mean() > 0.95
    new_wording = verdict([pairs._refusal(rng, "x_y", "It is so.") for _ in test])[:, 2].mean()
    monkeypatch.setattr(pairs, "_REFUSALS", [x for i, x in enumerate(every) if i % 3])
    assert verdict([pairs._refusal(rng, "x_y", "It is so.") for _ in test])[:, 2].mean() > 0.97 and new_wording > 0.6
    # a refusal stays one however long its excuse is
    assert verdict([pairs._refusal(rng, "x_y", "It is so.") + " The topic may be restricted." * 30 for _ in test])[:, 2].mean() > 0.9
    assert verdict(["Task: " + r[0].lower() for r in test])[:, 3].mean() > 0.97
    cut = [(r, c) for r in test if (c := cuts.cut(r[1], rng))]
    assert model.defects([r[0] for r, _ in cut], [c for _, c in cut], [r[2] for r, _ in cut], [None] * len(cut))[:, 1].mean() > 0.9
    assert verdict(["entity a is\nlibrary ieee;\narchitecture rtl of a is\nbegin\nend process;\nend architecture;\n" for _ in test])[:, 4].mean() > 0.97
    assert verdict([r[1] for r in test]).any(axis=1).mean() < 0.12


def test_pairs_edges(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/expanded.parquet").orderBy("record_no").limit(250)
    prompts = e.select(F.col("record_no").alias("prompt_key"), F.col("expanded_prompt").alias("prompt"), F.lit(None).cast("string").alias("family"), F.lit(2).alias("answer"))
    base = e.select(F.col("record_no").alias("key"), F.col("record_no").alias("prompt_key"), F.col("reference_solution").alias("answer"), F.lit(None).cast("string").alias("source"), F.lit(1).alias("defect"), F.lit("x").alias("prompt"))
    odd = spark.createDataFrame([(-1, None, None, None, 1, None), (-2, -5, "", None, 1, ""), (-2, -5, "", None, 1, ""), (-3, None, "module a; endmodule", None, 1, "")], "key long, prompt_key long, answer string, source string, defect int, prompt string")
    got = sorted((r.pair_key, r.defect) for r in pairs.defective_pairs(prompts, {"k": (base.unionByName(odd), "true", True)}, sample=120).where("pair_key < 0 and defect = 'empty'").collect())
    assert got == [(-2, "empty"), (-2, "empty"), (-1, "empty")]
    assert pairs.defective_pairs(prompts.limit(0), {"k": (odd.limit(0), "true", False)}).collect() == []


def test_pair_model_is_fitted_on_all_pairs(spark, monkeypatch):
    e = spark.read.parquet("/root/testdata/sf0.01/expanded.parquet").where("length(expanded_prompt) > 0 and length(reference_solution) > 0").orderBy("record_no").limit(400)
    prompts = e.select(F.col("record_no").alias("prompt_key"), F.col("expanded_prompt").alias("prompt"), F.lit("verilog").alias("family"))
    answers = e.select(F.lit("k").alias("kind"), F.col("record_no").alias("key"), F.col("record_no").alias("prompt_key"), F.col("reference_solution").alias("answer"), F.lit(None).cast("string").alias("source"))
    rows = [(r.expanded_prompt, r.reference_solution, "verilog", "k|") for r in e.collect()]
    found = []
    monkeypatch.setattr(pairs, "averaged", lambda shell, sums, f=pairs.averaged: found.append((shell, sums)) or f(shell, sums))
    models = [pairs.fit_pairs(prompts.repartition(n), answers.repartition(n), frozenset(), len(rows), block=150) for n in (1, 6)]
    # counts are those of all rows, and the languages those of one fit on all
    shell, sums = found[0]
    assert shell.known == cuts.vocabulary([r[1] for r in rows])
    usable = [r for r in rows if pairs.usable(r)]
    proses, codes = pairs.prose_and_code([r[1] for r in rows])
    whole = languages.Languages.fit([r[0] for r in rows] + proses, codes)
    assert whole.names == shell.languages.names and np.allclose(whole.logs, shell.languages.logs) and np.allclose(whole.floor, shell.languages.floor)
    # every pair and its copies have a margin for the label that is known of all of them, but for those in doubt
    assert sums["margins"][3, 1].sum() >= 0.9 * 5 * len(usable) and sums["margins"][3, 0].sum() == len(usable)
    # the blocks do not depend on the partitioning
    assert np.allclose(models[0].worded.weights, models[1].worded.weights, atol=1e-5) and np.allclose(models[0].signed.weights, models[1].signed.weights, atol=1e-5) and np.allclose(models[0].levels, models[1].levels)


def test_pair_model_counts_more_pairs_than_a_block_holds(spark, monkeypatch):
    n = 9000
    df = spark.range(n).select(F.col("id").alias("key"), F.col("id").alias("prompt_key"), F.format_string("The unit reads word %s and writes it.", F.col("id") % 900).alias("answer"), F.lit(None).cast("string").alias("source"))
    prompts = spark.range(n).select(F.col("id").alias("prompt_key"), F.format_string("Explain in a few words what unit %s does.", "id").alias("prompt"), F.lit(None).cast("string").alias("family"))
    sent = []
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value, f=type(spark.sparkContext).broadcast: sent.append(value) or f(self, value))
    pairs.defective_pairs(prompts, {"k": (df, "true", False)})
    model = [x for x in sent if isinstance(x, pairs.PairModel)][-1]
    # a word of every answer is met in every one of them; the counts are those of 8 000 answers
    assert round(model.known["unit"][0] / model.share) == n and round(model.known["it"][1] / model.share) == n


def test_pairs_are_described_once_for_fit_and_verdicts(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/expanded.parquet").where("length(expanded_prompt) > 0").orderBy("record_no").limit(300)
    prompts = e.select(F.col("record_no").alias("prompt_key"), F.col("expanded_prompt").alias("prompt"), F.lit("verilog").alias("family"))
    odd = spark.createDataFrame([("k", -1, None, "module a; endmodule", None), ("k", -2, -7, "\n", None)], "kind string, key long, prompt_key long, answer string, source string")
    answers = e.select(F.lit("k").alias("kind"), F.col("record_no").alias("key"), F.col("record_no").alias("prompt_key"), F.col("reference_solution").alias("answer"), F.lit(None).cast("string").alias("source")).unionByName(odd)
    shell = pairs.blank_pairs(prompts, answers, frozenset(), 302)
    held = [pairs.Held.unpacked(r.packed, r.size) for r in pairs.described_pairs(prompts, answers, shell, 302, 100).collect()]
    assert sorted(k for h in held for k in h.keys) == sorted(r.key for r in answers.collect())
    for h in held:
        asks, texts, families, sources = map(list, zip(*h.pairs, strict=True))
        fresh = shell.describe(asks, texts, families, sources, [True] * len(texts))
        for name in ("pair", "signs"):
            a, b = getattr(h.found, name), getattr(fresh, name)
            assert np.array_equal(a.index, b.index) and np.array_equal(a.first, b.first)
        assert np.array_equal(pairs.worded(texts).index, fresh.words.index) and h.found.full == [bool(pairs.essence(t)) for t in texts]


def test_what_is_counted_in_batches_is_what_the_expressions_count():
    rng = np.random.default_rng(3)
    signs = list("abZ'-.;:!?)]*`\" \t\n\r\x1c_1#\u00e9\u00df\u2019\u3002")
    for _ in range(300):
        values = ["".join(rng.choice(signs, rng.integers(0, 40))) for _ in range(5)]
        count = {}
        for w, end in cuts._PROSE.findall("\n".join(values).lower() + "\n"):
            n = count.setdefault(w, [0, 0])
            n[0], n[1] = n[0] + 1, n[1] + bool(end)
        assert cuts.counted_words(values) == count
    texts = ["", "the and", "the the a_the 1the", "der der le le", "El m\u00f3dulo lee la palabra y la guarda.", "Le bloc lit le mot et la sortie est la suite.", "x" * 200 + " the the"]
    assert [None if k < 0 else languages.LABELS[k] for k in languages.seed_labels(texts)] == [languages.seed_language(t) for t in texts]


def test_a_fit_goes_on_where_examples_are_the_same():
    rng = np.random.default_rng(4)
    rows = linear.Rows.of([np.unique(rng.integers(0, 900, rng.integers(0, 30))).astype(np.int32) for _ in range(500)])
    y, half, begun = rng.integers(0, 2, (500, 2)), np.arange(0, 500, 2), {}
    linear.fit_logistic(rows, y, epochs=2, among=half, begun=begun)
    y[0, 1] = 1 - y[0, 1]  # one label changes, the other goes on from its second epoch
    again, fresh = (linear.fit_logistic(rows, y, epochs=5, among=half, keep=True, begun=b) for b in (begun, None))
    assert all(np.array_equal(getattr(again, x), getattr(fresh, x)) for x in ("weights", "bias", "seen", "bias_seen"))


def test_fits_of_blocks_are_averaged_by_what_they_met():
    shell = pairs.blank(languages.Languages.fit([], []), {}, frozenset())
    sums = {name: np.zeros(shape) for name, shape in pairs.SHAPES.items()}
    for weight, seen in ((2.0, 3.0), (-1.0, 1.0)):
        sums["paired seen"][7, 0] += seen
        sums["paired weights"][7, 0] += seen * weight
    sums["margins"][3, 0, [3000, 3100]], sums["margins"][3, 1, [900, 1000]] = 5, 80
    model = pairs.averaged(shell, sums)
    assert model.paired.weights[7, 0] == 1.25 and model.paired.weights[8, 0] == 0
    assert (1000 - 2048) / 64 < model.levels[3] < (3000 - 2048) / 64


def brute(rows, t, k=3, least=30):
    sets = {}
    for i, (key, x) in enumerate(rows):
        tok = re.findall(r"[a-z0-9_]+", (x or "").translate({c: c + 32 for c in range(65, 91)}))
        if len(tok) >= least:
            sets[i] = (key, {tuple(tok[j : j + k]) for j in range(len(tok) - k + 1)})
    out = []
    for i, (a, x) in sets.items():
        for j, (b, y) in sets.items():
            if i < j and a != b and len(x & y) / len(x | y) >= t:
                out.append((min(a, b), max(a, b)))
    return sorted(set(out))


@pytest.mark.parametrize("rare", [48, 2, 0])
def test_near_duplicates_equal_brute_force(spark, rare):
    rng = random.Random(rare)
    rows, base = [], []
    for key in range(220):
        t = list(rng.choice(base)) if base and rng.random() < 0.7 else [rng.choice(["the unit stays high", "when counter loads the value", f"sig_{rng.randrange(500)} is {rng.randrange(50)}"]) for _ in range(25)]
        for _ in range(rng.choice([0, 1, 2, 4])):
            t[rng.randrange(len(t))] = f"Edit {rng.randrange(99)}"
        base.append(t)
        rows.append((key, " ".join(t)))
    rows += [(300, None), (301, ""), (302, "too short"), (303, rows[0][1]), (304, rows[0][1].upper()), (304, rows[0][1])]
    df = spark.createDataFrame([(k, t, "f") for k, t in rows], "k long, t string, field string").repartition(3)
    got = sorted({(r.key_a, r.key_b) for r in neardup.near_duplicate_pairs({"t": (df, "k", "t", "text")}, rare=rare).collect()})
    assert got == brute(rows, 0.6)
    strict = sorted({(r.key_a, r.key_b) for r in neardup.near_duplicate_pairs({"t": (df, "k", "t", "text")}, threshold=0.8, shingle=5, rare=rare).collect()})
    assert strict == brute(rows, 0.8, 5)


def test_near_duplicate_maps_and_groups(spark):
    rows = [(1, {"a": "1", "b": " X ", "c": "3"}), (2, {"a": "1", "b": "x", "c": "3"}), (3, {"a": "1", "b": "x", "c": "4", "d": None}), (4, {"a": "1"}), (5, {"a": "1"}), (6, {}), (7, None), (8, {"b": "x", "a": "1", "c": "3", "e": "5"})]
    df = spark.createDataFrame(rows, "k long, m map<string,string>")
    fields = {"m": (df, "k", "m", "map")}
    assert sorted((r.key_a, r.key_b, round(r.similarity, 2)) for r in neardup.near_duplicate_pairs(fields).collect()) == [(1, 2, 1.0), (1, 8, 0.75), (2, 8, 0.75), (4, 5, 1.0)]
    groups = {r.key: (r["class"], r.links) for r in neardup.near_duplicate_groups(fields).collect()}
    assert groups[1] == groups[2] and groups[1][1] == 1 and groups[4][1] == 0 and set(groups) == {1, 2, 3, 4, 5, 8}
    assert neardup.near_duplicate_pairs({"m": (df.limit(0), "k", "m", "map")}).collect() == []


def test_threshold_gives_the_best_f1():
    assert 0.2 < linear.threshold(np.array([0.1, 0.2, 0.8, 0.9]), np.array([0, 0, 1, 1])) < 0.8
    assert linear.threshold(np.zeros(0), np.zeros(0)) == 0.0


def test_a_key_of_many_rows_does_not_swell_the_sample(spark):
    df = spark.range(3000).selectExpr("cast(case when id % 3 = 0 then 7 else id end as long) no", "concat('The unit reads word ', id, ' and writes it.') content", "'s' source")
    long = cuts.long_form(df, "no", "source", ["content"])
    assert len(cuts.sampled_values(long, cuts.value_lengths(long, "true"), "true", 50)) <= 50
