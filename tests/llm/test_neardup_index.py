"""The index of near-duplicates: every alike pair meets, whatever the counts, sizes and blocks."""

import random

import numpy as np
import pytest

from tallyforge.llm import neardup
from tallyforge.llm.tokens import U, mix


def sets_of(rng, n, vocabulary, longest):
    out = []
    while len(out) < n:
        own = set(rng.choice(out)) if out and rng.random() < 0.7 else {min(int(rng.paretovariate(0.6)), vocabulary) for _ in range(rng.randrange(1, longest))}
        for _ in range(rng.choice([0, 1, 2, 6])):
            own.discard(rng.choice(sorted(own))) if own and rng.random() < 0.5 else own.add(rng.randrange(vocabulary))
        if own:
            out.append(own)
    return out


@pytest.mark.parametrize(("mean", "rare", "long", "t"), [(4, 8, 1024, 0.6), (60, 8, 1024, 0.6), (600, 8, 1024, 0.6), (4, 2, 8, 0.6), (600, 1, 4, 0.6), (4, 8, 16, 0.8), (4, 3, 1024, 0.4)])
def test_alike_sets_meet(monkeypatch, mean, rare, long, t):
    monkeypatch.setattr(neardup, "LONG", long)
    rng = random.Random(mean + rare)
    sets = list({frozenset(x) for x in sets_of(rng, 160, 400, 90)})
    h = np.concatenate([np.sort(mix(np.array(sorted(x), U) + U(1))) for x in sets])
    d = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    f, times = np.unique(h >> U(64 - neardup.COUNTED), return_counts=True)
    often = times > rare
    # the table is small enough that its places are shared by about this many features
    bits = 8 if mean < 60 else 4
    table = np.full(1 << bits, 255 if mean == 600 else 0)
    np.add.at(table, (f[~often] >> U(neardup.COUNTED - bits)).astype(int), times[~often])
    order = neardup.Frequencies(f[often], times[often], np.minimum(table, 255).astype(np.uint8))
    code, doc, reach, n = neardup.prefix_codes(h, d, order, t)
    by = np.lexsort((-reach, doc, code))
    code, doc, reach = code[by], doc[by], reach[by]
    number = np.unique(code, return_inverse=True)[1]
    index = np.flatnonzero(reach >= n[doc])
    key = neardup._met(number, doc, n[doc], reach, np.arange(len(doc)), index, t, len(sets))
    met = set(zip((key // len(sets)).tolist(), (key % len(sets)).tolist(), strict=True))
    alike = {(i, j) for i, a in enumerate(sets) for j in range(i + 1, len(sets)) if len(a & (b := sets[j])) >= t * len(a | b) - 1e-12}
    assert len(alike) > 30
    assert alike <= met


def test_hot_codes_and_classes_are_split(spark, monkeypatch):
    rng = random.Random(2)
    rows = []
    for key in range(120):
        words = [f"word{i} is here" for i in range(20)] + [f"own{rng.randrange(30)} thing{rng.randrange(3)}" for _ in range(4)]
        rows.append((key, " ".join(words)))
    rows += [(1000 + i, rows[0][1]) for i in range(15)]
    df = spark.createDataFrame(rows, "k long, t string").repartition(3)
    fields = {"t": (df, "k", "t", "text")}
    whole = sorted(map(tuple, neardup.near_duplicate_pairs(fields, rare=2).collect()))
    for name, value in {"HOT": 4, "BLOCK": 7, "COPIES": 4}.items():
        monkeypatch.setattr(neardup, name, value)
    split = sorted(map(tuple, neardup.near_duplicate_pairs(fields, rare=2).collect()))
    assert len(whole) > 1000 and split == whole


def test_long_records_get_codes_in_proportion():
    order = neardup.Frequencies(np.zeros(0, U), np.zeros(0, np.int64), np.full(256, 200, np.uint8))
    size = {}
    for n in (4000, 16000):
        h = np.sort(mix(np.arange(n).astype(U)))
        f = np.unique(h >> U(64 - neardup.COUNTED))
        every = neardup.Frequencies(f, np.full(len(f), 1000), order.table)
        size[n] = len(neardup.prefix_codes(h, np.zeros(n, np.int64), every, 0.6)[0])
    assert size[16000] < 6 * size[4000]
