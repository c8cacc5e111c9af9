"""Problems 6 to 8."""

import random

import numpy as np

from tallyforge.llm import packing, reading


def containers(spark, rows, capacities, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string, profile string, capacity int").repartition(3)
    profiles = spark.createDataFrame([(f"p{c}", c) for c in capacities] + [("none", None), ("zero", 0)], "profile string, capacity int")
    return packing.pack(docs, "doc_id", "text", profiles, "profile", "capacity", **more).collect()


def test_packing_is_complete_and_full(spark):
    rng = random.Random(1)
    rows = [(i, "word " * rng.randrange(1, 120), "x", 1) for i in range(600)] + [(700, None, "x", 1), (701, "", "x", 1), (702, "word " * 5000, "x", 1), (5, "word " * 7, "x", 1)]
    out = containers(spark, rows, [64, 256])
    size = {}
    for k, t, *_ in rows:
        if t:
            size.setdefault(k, []).append(packing.token_count(t, "/opt/tokenizers/" + packing.TOKENIZER))
    for cap in (64, 256):
        own = [r for r in out if r.capacity == cap]
        assert len({r.container for r in own}) == len(own)
        assert all(r.fill == sum(x.tokens for x in r["items"]) <= cap and r.n_items == len(r["items"]) for r in own)
        pieces = {}
        for r in own:
            for x in r["items"]:
                pieces.setdefault(x.doc_id, []).append((x.first_token, x.tokens))
        assert set(pieces) == set(size)
        for k, n in size.items():
            if len(n) == 1:
                at = 0
                for first, m in sorted(pieces[k]):
                    assert first == at
                    at += m
                assert at == n[0] and len(pieces[k]) == -(-n[0] // cap)
        assert sum(r.fill for r in own) / (cap * len(own)) > 0.97
    assert {r.profile for r in out} == {"p64", "p256"}
    assert containers(spark, rows[:0], [64]) == []


def test_best_fit_takes_the_tightest_and_closes_the_fullest():
    b = packing.BestFit(10, 2)
    assert b.add(("a",), 6) is None and b.add(("b",), 7) is None
    assert b.add(("c",), 3) == [("b",), ("c",)]
    assert b.add(("d",), 8) is None
    assert b.add(("e",), 9) == [("d",)]
    assert b.rest() == [[("e",)], [("a",)]]
    full = packing.BestFit(10, 1)
    full.add(("a",), 4)
    assert full.add(("b",), 10) == [("b",)] and full.rest() == [[("a",)]]


def test_mix_reaches_the_shares(spark):
    rng = random.Random(2)
    rows = [(i, "word " * rng.randrange(20, 60), s, 1) for i, s in enumerate(["big"] * 3000 + ["small"] * 200 + ["mid"] * 800)] + [(9001, "word", None, 1), (9002, None, "big", 1), (9003, "word", "unknown", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copy_no int")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.2, 3), ("mid", 0.3, 2), ("absent", 0.1, 2), ("off", 0.0, 1), (None, 0.4, 1)], "source string, w double, r int")
    out = packing.mix(docs, "doc_id", "text", "source", targets, "source", "w", "r").collect()
    tokens, copies = {}, {}
    for r in out:
        tokens[r.source] = tokens.get(r.source, 0) + r.n_tokens
        copies[r.doc_id] = max(copies.get(r.doc_id, 0), r.copy_no)
    total = sum(tokens.values())
    want = {"big": 0.5, "small": 0.2, "mid": 0.3}
    assert set(tokens) == set(want)
    assert all(abs(tokens[s] / total - w) < 0.03 for s, w in want.items())
    assert all(abs(r.reached_share - tokens[r.source] / total) < 1e-9 for r in out)
    assert max(copies[i] for i in copies if 3000 <= i < 3200) == 3 and max(copies[i] for i in copies if i < 3000) == 1
    assert {r.doc_id for r in out if r.source == "small"} == set(range(3000, 3200))
    again = packing.mix(docs.repartition(5), "doc_id", "text", "source", targets, "source", "w", "r").collect()
    assert sorted((r.doc_id, r.copy_no) for r in again) == sorted((r.doc_id, r.copy_no) for r in out)
    assert packing.mix(docs.limit(0), "doc_id", "text", "source", targets, "source", "w", "r").collect() == []


EASY = "The cat sat on the mat. We like the red ball. You can run and play. "
HARD = "Notwithstanding epistemological heterogeneity, the characterisation attenuates regularisation. Consequently, instrumentation necessitates synchronisation of compositional verification. "


def test_levels_on_held_out_documents(spark):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(160):
        share = rng.random()
        docs.append((i, "".join(EASY if rng.random() > share else HARD for _ in range(8)), None, i))
        if i < 110:
            labels += [(i, "a", 1 + round(4 * share)), (i, "b", None)]
    docs += [(900, None, "s", 1), (901, " \n", "s", 1), (902, EASY * 4000, "s", 1), (902, EASY * 4000, "s", 1), (903, "如果信号保持无效。" * 5, "s", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, level int").repartition(2)
    lab = spark.createDataFrame(labels, "doc_id long, rater string, band int")
    out = reading.reading_levels(df, "doc_id", "text", lab, "doc_id", "band", ["source"]).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == len(docs) and got[900].level is None and got[901].level is None and got[900].n_sentences == 0
    hard = [d[1].count("Notwith") / 8 for d in docs[110:160]]
    assert np.corrcoef(hard, [got[i].level for i in range(110, 160)])[0, 1] > 0.95
    assert got[902].level < 2.5 and 1 <= got[903].level <= 5 and got[902].band in (1, 2)
    assert reading.reading_levels(df.limit(0), "doc_id", "text", lab, "doc_id", "band", ["source"]).collect() == []
    middle = reading.reading_levels(df, "doc_id", "text", lab.limit(0), "doc_id", "band", []).where("level is not null").collect()
    assert {r.level for r in middle} == {3.0}


def test_other_languages_are_not_levelled_by_the_sentence_models():
    rng = random.Random(5)
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    # much vocabulary of their own, so that a hash table of the fitted words fills
    english = [" ".join(("the cat sat on the mat and " + " ".join(word("abcdefghij", 7) for _ in range(15)) + ".") for _ in range(4)) for _ in range(600)]
    model = reading.fit(english, [1 + i % 5 for i in range(600)])
    foreign = [" ".join(" ".join(word("klmnopqrst", 3 + k % 5) for k in range(40)) + "." for _ in range(4)) for _ in range(8)]
    level, _, _ = model.levels(foreign)
    assert len(set(np.round(level, 9))) == 1
    assert len(set(np.round(model.levels(english)[0], 9))) > 1
    s = reading.sentences(["信号保持无效。状态机复位！ok", "schön üben"])
    assert s.n_words.tolist() == [3, 3, 1, 2] and s.n_letters.tolist() == [6, 5, 2, 9] and s.n_han.tolist() == [3, 3, 0, 0]
