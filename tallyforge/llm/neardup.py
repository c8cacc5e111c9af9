"""Problem 5: near-duplicate records with small edits.

A record is a set of hashed features, and records with equal sets form one
class, so copies are compared once. Features are ordered rarest first by how
many records have them: frequent ones, whose exact counts are known to every
task, come last. Two sets of Jaccard similarity ``t`` or more share their
first features, in that order, within a prefix of each. A rare feature of the
prefix is indexed by itself; frequent ones as combinations of two, for which
the prefix is extended. With a code goes the largest size a partner can have
that first meets the record there, so that most records under a code are never
paired. Candidates are thinned by parity signatures, a lower bound of the
difference, and what is left is verified with the whole sets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.tokens import LOWER, U, chunks, mix, ranges, shingles, splitmix, words
from tallyforge.runtime import checkpointed

#: Features counted more often than this are frequent. Larger only where more than LISTED features would be, so that their list has a bound.
RARE, LISTED = 64, 1 << 22
#: Bits of a feature's number when counted, of a signature, and most bits of the table that orders the rare features.
COUNTED, SIGNATURE, TABLE = 40, 512, 24
#: From this many features on, frequent ones are combined within colours only, so that codes grow in proportion to a record.
LONG = 1024
#: Features a counting task holds, postings a part of the index should hold, pairs from which a code is split, and postings of a split block.
HELD, POSTINGS, HOT, BLOCK = 4_000_000, 2_000_000, 1 << 26, 8192
#: Records of one class that are paired in one piece, and bits of the filter of records to verify.
COPIES, FILTER = 4096, 1 << 24


def _sets(batch: pa.RecordBatch, shingle: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of each row (columns field, key, text, entries), with the row of each, in order of row and hash."""
    field = batch.column(0).to_pylist()
    text = batch.column(2).to_pylist()
    salts = {f: U(zlib.crc32(f.encode()) << 17 | 1) for f in set(field)}
    own = [i for i, t in enumerate(text) if t]
    parts_h, parts_d = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for a, b in chunks([text[i] for i in own]):
        rows = np.array(own[a:b])
        w = words([text[i].encode("utf-8", "replace").translate(LOWER) for i in rows.tolist()])
        h, d = shingles(w, shingle)
        enough = (np.diff(w.first) >= least)[d]
        salt = np.array([salts[field[i]] for i in rows.tolist()], U)
        parts_h.append(mix(h[enough] ^ salt[d[enough]]))
        parts_d.append(rows[d[enough]])
    entries = batch.column(3)
    listed = np.flatnonzero(np.array(entries.is_valid().to_pylist(), bool))
    if len(listed):
        lists = entries.take(pa.array(listed))
        n = np.array([x or 0 for x in lists.value_lengths().to_pylist()])
        d = np.repeat(listed, n)
        salt = np.array([salts[f] for f in field], U)
        parts_h.append(mix(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(U) ^ salt[d]))
        parts_d.append(d)
    h, d = np.concatenate(parts_h), np.concatenate(parts_d)
    by = np.lexsort((h, d))
    h, d = h[by], d[by]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[fresh], d[fresh]


def _classes(h: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that have features, the number of these, and the 64-bit class of each set."""
    if not len(d):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
    n = np.diff(np.concatenate((first, [len(d)])))
    total = np.add.reduceat(splitmix(h, 3), first) ^ mix(np.add.reduceat(splitmix(h, 5), first))
    return d[first], n, mix(total + n.astype(U)).view(np.int64)


def _signatures(h: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Parity signature of every set, as rows of 64-bit words: a bit tells whether an odd number of features fall on it.

    A feature that only one of two sets has changes one bit, so the signatures
    differ in no more bits than the sets in features.
    """
    fresh = np.concatenate(([True], d[1:] != d[:-1]))
    doc = np.cumsum(fresh) - 1
    n = int(doc[-1]) + 1
    odd = np.bincount(doc * SIGNATURE + (h % U(SIGNATURE)).astype(np.int64), minlength=n * SIGNATURE) & 1
    return np.packbits(odd.astype(bool).reshape(n, SIGNATURE), axis=1).view(np.uint64)


@dataclass
class Frequencies:
    """Order of the features: exact counts of the frequent ones, and a table of the others' counts, some of which share a place."""

    frequent: np.ndarray  # sorted numbers
    count: np.ndarray
    table: np.ndarray

    def of(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count of every feature, never too small, and whether it is frequent."""
        f = h >> U(64 - COUNTED)
        bits = len(self.table).bit_length() - 1
        count = self.table[(f >> U(COUNTED - bits)).astype(np.int64)].astype(np.int64)
        often = np.zeros(len(h), bool)
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, f), len(self.frequent) - 1)
            often = self.frequent[at] == f
            count = np.where(often, self.count[at], count)
        return count, often


def _planes(x: np.ndarray) -> bytes:
    """Bytes of numbers place by place, which Spark's own compression shortens."""
    return np.ascontiguousarray(x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(4, -1).T).reshape(-1).view(np.uint32)


_SCANNED = "field string, key long, class long, n int, signature binary, slice int, number binary, times binary"


def scanned(rows: DataFrame, shingle: int, least: int) -> tuple[DataFrame, int]:
    """One pass over the texts: a row per record that takes part, and partial counts of the features by slices of their numbers."""
    # as many slices as the scan has parts, and some, so that a slice stays of one size
    bits = min(16, max(8, (4 * rows.rdd.getNumPartitions()).bit_length()))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            f, times = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            edge = np.searchsorted(f >> U(COUNTED - bits), np.arange((1 << bits) + 1).astype(U))
            own = np.flatnonzero(np.diff(edge))
            number, count = [], []
            for s in own.tolist():
                part = (f[edge[s] : edge[s + 1]] & U((1 << (COUNTED - bits)) - 1)).astype(np.int64)
                number.append(_planes(np.diff(part, prepend=0)))
                count.append(_planes(times[edge[s] : edge[s + 1]]))
            k = len(own)
            return pa.RecordBatch.from_arrays([pa.nulls(k, pa.string()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), pa.array(own, pa.int32()), pa.array(number, pa.binary()), pa.array(count, pa.binary())], names=names)

        names = ["field", "key", "class", "n", "signature", "slice", "number", "times"]
        for b in batches:
            h, d = _sets(b, shingle, least)
            row, n, cls = _classes(h, d)
            if not len(row):
                continue
            sig = [x.tobytes() for x in _signatures(h, d)]
            k = len(row)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(cls, pa.int64()), pa.array(n, pa.int32()), pa.array(sig, pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary())], names=names)
            held.append(h >> U(64 - COUNTED))
            if sum(map(len, held)) > HELD:
                yield counted()
        if held:
            yield counted()

    return checkpointed(rows.mapInArrow(scan, _SCANNED)), bits


def frequencies(scan: DataFrame, bits: int, total: int, rare: int) -> Frequencies:
    """Add up the partial counts, a slice in one task; only what is frequent and the table, both of bounded size, reach the driver."""
    most = max(rare, -(-total // LISTED))
    table_bits = max(bits, min(TABLE, max(0, total // 4).bit_length()))
    step = 1 << (table_bits - bits)

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, times = [], []
        for b in batches:
            for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                numbers.append(np.cumsum(_numbers(x).astype(np.int64)))
                times.append(_numbers(y).astype(np.int64))
        number, back = np.unique(np.concatenate(numbers), return_inverse=True)
        count = np.bincount(back, np.concatenate(times)).astype(np.int64)
        often = count > most
        table = np.bincount(number[~often] >> (COUNTED - table_bits), count[~often], step)
        listed = number[often] | key[0].as_py() << (COUNTED - bits)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([listed.tobytes()], pa.binary()), pa.array([count[often].tobytes()], pa.binary()), pa.array([zlib.compress(np.minimum(table, 255).astype(np.uint8).tobytes(), 1)], pa.binary())], names=["slice", "number", "times", "table"])

    parts = scan.where("slice is not null").select("slice", "number", "times").groupBy("slice").applyInArrow(add, "slice int, number binary, times binary, table binary").collect()
    parts.sort(key=lambda r: r.slice)
    table = np.zeros(1 << table_bits, np.uint8)
    for r in parts:
        table[r.slice * step : (r.slice + 1) * step] = np.frombuffer(zlib.decompress(r.table), np.uint8)
    joined = lambda name, kind: np.concatenate([np.zeros(0, kind), *(np.frombuffer(r[name], kind) for r in parts)])
    return Frequencies(joined("number", U), joined("times", np.int64), table)


def _colours(n: np.ndarray) -> np.ndarray:
    """Colours that frequent features are combined within, by the size of the larger record; a power of two."""
    return 1 << np.maximum(0, np.ceil(np.log2(np.maximum(n, 1) / LONG))).astype(np.int64)


def prefix_codes(h: np.ndarray, d: np.ndarray, order: Frequencies, t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Index codes of every set, the place of the set (0, 1, ...) each belongs to, the largest partner to be met there, and the sizes of the sets.

    If a pair's first ``j`` shared features end at place ``p`` of a set of
    ``n``, no more than ``j + n - p - 1`` are shared, which bounds the
    partner's size; a code is left out where no partner is large enough.
    """
    if not len(h):
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
    n = np.diff(np.concatenate((first, [len(d)])))
    doc = np.repeat(np.arange(len(first)), n)
    count, often = order.of(h)
    by = np.lexsort((h, count, often, doc))
    h, count, often = h[by], count[by], often[by]
    place = np.arange(len(h)) - np.repeat(first, n)
    size = np.repeat(n, n)
    most = lambda j, at: np.floor((j + size[at] - place[at] - 1) * (1 + t) / t + 1e-9).astype(np.int64) - size[at]
    least = np.ceil(t * size - 1e-9).astype(np.int64)
    every = np.arange(len(h))
    # two sets that need one shared feature only are both of at most 1 / t features
    tiny = size <= 1 / t + 1e-9
    single = np.flatnonzero((~often | tiny) & (count > 1) & (most(1, every) >= least))
    codes, docs, reach = [h[single]], [doc[single]], [most(1, single)]
    own = _colours(n)
    for step in range(2):
        # codes for partners of the same number of colours, then for larger ones that have more
        colours = own if step == 0 else np.where(_colours(np.floor(n / t + 1e-9)) > own, 2 * own, 0)
        c = colours[doc]
        at = np.flatnonzero(often & (c > 0) & (most(c + 1, every) >= least))
        if not len(at):
            continue
        # of the first c + 1 shared features two have one colour
        colour = (splitmix(h[at], 21) % np.maximum(c[at], 1).astype(U)).astype(np.int64)
        at = at[np.lexsort((place[at], colour, doc[at]))]
        group = doc[at] * (int(c.max()) + 1) + (splitmix(h[at], 21) % c[at].astype(U)).astype(np.int64)
        edge = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
        right, left = ranges(np.arange(1, len(at) + 1), np.repeat(edge[1:], np.diff(edge)))
        a, b = at[left], at[right]
        codes.append(mix(h[a] + splitmix(h[b], 9) + c[a].astype(U)))
        docs.append(doc[a])
        reach.append(most(c[b] + 1, b))
    return np.concatenate(codes), np.concatenate(docs), np.concatenate(reach), n


def _met(code: np.ndarray, doc: np.ndarray, n: np.ndarray, reach: np.ndarray, probe: np.ndarray, index: np.ndarray, t: float, width: int) -> np.ndarray:
    """Distinct pairs of a probing and an indexed posting of one code, the first no smaller, as first * width + second of their documents."""
    scale = int(n.max()) + 2
    index = index[np.lexsort((n[index], code[index]))]
    both, number = np.unique(np.concatenate((code[index], code[probe])), return_inverse=True)
    line = number[: len(index)] * scale + n[index]
    base = number[len(index) :] * scale
    lo = np.searchsorted(line, base + np.ceil(t * n[probe] - 1e-9).astype(np.int64), "left")
    hi = np.maximum(lo, np.searchsorted(line, base + np.minimum(reach[probe], n[probe]), "right"))
    total = np.cumsum(hi - lo)
    found = [np.zeros(0, np.int64)]
    cut = np.searchsorted(total, np.arange(0, int(total[-1]) + 1 if len(total) else 0, 1_000_000))
    for a, b in zip(cut, [*cut[1:], len(probe)], strict=True):
        right, left = ranges(lo[a:b], hi[a:b])
        x, y = probe[a:b][left], index[right]
        ok = (reach[y] >= n[x]) & (doc[x] != doc[y])
        x, y = doc[x[ok]], doc[y[ok]]
        found.append(np.unique(np.minimum(x, y) * width + np.maximum(x, y)))
    return np.unique(np.concatenate(found))


def candidate_pairs(rows: DataFrame, order: Frequencies, t: float, shingle: int, least: int, parts: int) -> DataFrame:
    """Distinct (class_a, class_b), class_a < class_b, that meet under a code."""
    shared = rows.sparkSession.sparkContext.broadcast(order)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for b in batches:
            h, d = _sets(b, shingle, least)
            _, n, cls = _classes(h, d)
            if not len(cls):
                continue
            # copies within a task are indexed once; copies elsewhere meet as equal classes
            _, keep = np.unique(cls, return_index=True)
            keep = keep[~np.isin(cls[keep], seen)]
            seen = np.concatenate((seen, cls[keep]))[-2_000_000:]
            chosen = np.zeros(len(cls), bool)
            chosen[keep] = True
            inside = np.repeat(chosen, n)
            codes, doc, reach, n = prefix_codes(h[inside], d[inside], shared.value, t)
            cls = cls[chosen]
            part = (splitmix(codes, 13) % U(parts)).astype(np.int64)
            by = np.lexsort((doc, part))
            codes, doc, reach, part = codes[by], doc[by], reach[by], part[by]
            edge = np.searchsorted(part, np.arange(parts + 1))
            names, blobs = [], []
            for p in np.flatnonzero(np.diff(edge)).tolist():
                own = slice(edge[p], edge[p + 1])
                used, local = np.unique(doc[own], return_inverse=True)
                names.append(p)
                blobs.append((cls[used].tobytes(), _planes(n[used]), (codes[own] >> U(32)).astype(np.uint32).tobytes(), _planes(local), _planes(reach[own])))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), *(pa.array([x[i] for x in blobs], pa.binary()) for i in range(5))], names=["part", "cls", "n", "code", "doc", "reach"])

    found = "class_a long, class_b long, cell string, blob binary"

    def pairs(key: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
        k = len(key)
        return pa.RecordBatch.from_arrays([pa.array(own[key // len(own)], pa.int64()), pa.array(own[key % len(own)], pa.int64()), pa.nulls(k, pa.string()), pa.nulls(k, pa.binary())], names=["class_a", "class_b", "cell", "blob"])

    def meet(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[list[np.ndarray]] = [[], [], [], [], []]
        base = 0
        for b in batches:
            for r in zip(*(b.column(i).to_pylist() for i in range(1, 6)), strict=True):
                got[0].append(np.frombuffer(r[0], np.int64))
                got[1].append(_numbers(r[1]).astype(np.int64))
                got[2].append(np.frombuffer(r[2], np.uint32))
                got[3].append(_numbers(r[3]).astype(np.int64) + base)
                got[4].append(_numbers(r[4]).view(np.int32).astype(np.int64))
                base += len(got[0][-1])
        cls, n, code, doc, reach = (np.concatenate(x) for x in got)
        # one document per class: copies from different tasks fall together
        own, at, back = np.unique(cls, return_index=True, return_inverse=True)
        doc = back[doc]
        by = np.lexsort((-reach, doc, code))
        code, doc, reach = code[by], doc[by], reach[by]
        once = np.ones(len(code), bool)
        once[1:] = (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
        code, doc, reach = code[once], doc[once], reach[once]
        size = n[at][doc]
        number = np.cumsum(np.concatenate(([0], code[1:] != code[:-1])))
        indexed = reach >= size
        work = np.bincount(number).astype(float) * np.bincount(number, indexed)
        hot = work[number] > HOT
        yield pairs(_met(number, doc, size, reach, np.flatnonzero(~hot), np.flatnonzero(indexed & ~hot), t, len(own)), own)
        # a code of too many pairs is cut into blocks, each block of probes with each of the index
        for c in np.unique(number[hot]).tolist():
            group = np.flatnonzero(number == c)
            index = group[indexed[group]]
            blob = lambda i: np.stack((own[doc[i]], size[i], reach[i])).tobytes()
            for i in range(0, len(group), BLOCK):
                for j in range(0, len(index), BLOCK):
                    x, y = group[i : i + BLOCK], index[j : j + BLOCK]
                    name = f"{key[0].as_py()}-{c}-{i}-{j}"
                    yield pa.RecordBatch.from_arrays([pa.nulls(2, pa.int64()), pa.array([0, 1], pa.int64()), pa.array([name] * 2), pa.array([blob(x), blob(y)], pa.binary())], names=["class_a", "class_b", "cell", "blob"])

    def meet_cell(_: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = {r["class_b"]: np.frombuffer(r["blob"], np.int64).reshape(3, -1) for b in batches for r in b.to_pylist()}
        cls, size, reach = np.concatenate((side[0], side[1]), axis=1)
        own, doc = np.unique(cls, return_inverse=True)
        k = side[0].shape[1]
        key = _met(np.zeros(len(cls), np.int64), doc, size, reach, np.arange(k), np.arange(k, len(cls)), t, len(own))
        yield pairs(key, own)

    index = rows.mapInArrow(emit, "part int, cls binary, n binary, code binary, doc binary, reach binary")
    met = checkpointed(index.groupBy("part").applyInArrow(meet, found))
    cold, hot = met.where("cell is null"), met.where("cell is not null")
    if not hot.isEmpty():
        cold = cold.unionByName(hot.groupBy("cell").applyInArrow(meet_cell, found))
    return cold.select("class_a", "class_b").distinct()


def class_pairs(rows: DataFrame, t: float, shingle: int, least: int, rare: int) -> tuple[DataFrame, DataFrame]:
    """(field, key, class) membership, and verified (class_a, class_b, similarity)."""
    scan, bits = scanned(rows, shingle, least)
    members = scan.where("slice is null").select("field", "key", "class", "n", "signature")
    total = members.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    order = frequencies(scan, bits, total, rare)
    pairs = candidate_pairs(rows, order, t, shingle, least, max(16, -(-total // POSTINGS)))
    # one record stands for its class
    classes = members.groupBy("class").agg(F.min(F.struct("field", "key")).alias("m"), F.first("n").alias("n"), F.first("signature").alias("s"))
    side = lambda x: classes.select(F.col("class").alias(f"class_{x}"), F.col("n").alias(f"n{x}"), F.col("s").alias(f"s{x}"))
    word = lambda s, i: F.conv(F.hex(F.substring(s, 8 * i + 1, 8)), 16, -10).cast("long")
    differ = reduce(Column.__add__, [F.bit_count(word("sa", i).bitwiseXOR(word("sb", i))) for i in range(SIGNATURE // 64)])
    both = F.col("na") + F.col("nb")
    close = pairs.join(side("a"), "class_a").join(side("b"), "class_b").where(differ <= both - 2 * F.ceil(F.lit(t / (1 + t)) * both - 1e-9)).select("class_a", "class_b")
    close = checkpointed(close)
    asked = close.select(F.explode(F.array("class_a", "class_b")).alias("class")).distinct()
    stands = checkpointed(classes.join(asked, "class").select("class", "m.field", "m.key"))
    whole = _among(rows, stands).join(stands, ["field", "key"]).select("field", "key", "text", "entries", "class")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, d = _sets(b, shingle, least)
            row, n, cls = _classes(h, d)
            # a repeated key may have another text
            own = np.flatnonzero(cls == b.column(4).to_numpy()[row])
            edge = np.concatenate(([0], np.cumsum(n)))
            yield pa.RecordBatch.from_arrays([pa.array(cls[own], pa.int64()), pa.array([h[edge[i] : edge[i + 1]].tobytes() for i in own.tolist()], pa.binary())], names=["class", "features"])

    sets = whole.mapInArrow(features, "class long, features binary").dropDuplicates(["class"])
    both = close.join(sets.select(F.col("class").alias("class_a"), F.col("features").alias("fa")), "class_a").join(sets.select(F.col("class").alias("class_b"), F.col("features").alias("fb")), "class_b").select("class_a", "class_b", "fa", "fb")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.zeros(b.num_rows)
            for i, (x, y) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                x, y = np.frombuffer(x, U), np.frombuffer(y, U)
                z = np.sort(np.concatenate((x, y)), kind="stable")
                inter = int((z[1:] == z[:-1]).sum())
                s[i] = inter / (len(z) - inter)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s)], names=["class_a", "class_b", "similarity"]).filter(pa.array(s >= t - 1e-12))

    return members.select("field", "key", "class"), checkpointed(both.mapInArrow(verify, "class_a long, class_b long, similarity double"))


def _among(rows: DataFrame, stands: DataFrame) -> DataFrame:
    """Rows that may be among the standing records: a bit map of fixed size keeps most other texts out of the exchange."""
    place = F.pmod(F.xxhash64("field", "key"), F.lit(FILTER))
    # bits set per word of the map; at most FILTER / 32 rows whatever the data
    words_set = stands.groupBy(F.shiftright(place, 5).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(31).cast("int"))).alias("bits")).collect()
    table = np.zeros(FILTER // 32, np.uint32)
    for r in words_set:
        table[r.w] = r.bits
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(4).to_numpy()
            yield pa.RecordBatch.from_arrays(b.columns[:4], names=b.schema.names[:4]).filter(pa.array((shared.value[at >> 5] >> (at & 31).astype(np.uint32) & 1).astype(bool)))

    return rows.select("field", "key", "text", "entries", place.alias("at")).mapInArrow(keep, "field string, key long, text string, entries array<bigint>")


def feature_rows(fields: dict[str, tuple[DataFrame, str, str, str]]) -> DataFrame:
    """(field, key, text, entries) of fields given as name: (table, key, column, 'text' or 'map').

    For a map, an entry is the hash of its key and its value, trimmed and in lower case; a null value is an empty one.
    """
    each = []
    for name, (df, key, column, kind) in fields.items():
        if kind == "text":
            text, entries = F.col(column), F.lit(None).cast("array<bigint>")
        else:
            value = lambda e: F.lower(F.regexp_replace(F.coalesce(e["value"], F.lit("")), r"^\s+|\s+$", ""))
            text, entries = F.lit(None).cast("string"), F.transform(F.map_entries(F.col(column)), lambda e: F.xxhash64(e["key"], value(e)))
        each.append(df.select(F.lit(name).alias("field"), F.col(key).cast("long").alias("key"), text.alias("text"), entries.alias("entries")).where(F.col("key").isNotNull() & F.coalesce(F.length("text") > 0, F.size("entries") > 0)))
    return reduce(DataFrame.unionByName, each)


def _large(members: DataFrame) -> DataFrame:
    """(class, blocks): the classes of many copies and the pieces they are paired in; at most a row per COPIES records."""
    return members.groupBy("class").count().where(F.col("count") > COPIES).select("class", F.ceil(F.col("count") / COPIES).cast("int").alias("blocks"))


def near_duplicate_pairs(fields: dict[str, tuple[DataFrame, str, str, str]], *, threshold: float = 0.6, shingle: int = 3, least_tokens: int = 30, rare: int = RARE) -> DataFrame:
    """(field, key_a, key_b, similarity), key_a < key_b, for every pair of records of a field at least ``threshold`` alike.

    Null and empty values and texts under ``least_tokens`` tokens take no
    part; a text of any length is taken whole; records with equal features
    pair with similarity 1; repeated keys do not pair with themselves; other
    columns are ignored; empty tables give an empty result. Many copies of
    one class are paired block by block.
    """
    rows = feature_rows(fields)
    members, links = class_pairs(rows, threshold, shingle, least_tokens, rare)
    large = checkpointed(_large(members))
    cut = lambda df, by: df.join(large.withColumnRenamed("class", by), by, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = cut(members, "class").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = cut(cut(links, "class_a").select("*", each.alias("block_a")).drop("blocks"), "class_b").select("*", each.alias("block_b")).drop("blocks")
    a = own.select("field", F.col("key").alias("key_a"), F.col("class").alias("class_a"), F.col("block").alias("block_a"))
    b = own.select(F.col("key").alias("key_b"), F.col("class").alias("class_b"), F.col("block").alias("block_b"))
    across = cells.join(a, ["class_a", "block_a"]).join(b, ["class_b", "block_b"]).where("key_a <> key_b").select("field", F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b"), "similarity")
    often = members.groupBy("class").count().where("count > 1").select("class")
    same = own.join(often, "class")
    left = same.select("field", F.col("key").alias("key_a"), "class", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"))
    right = same.select(F.col("key").alias("key_b"), "class", F.explode(F.sequence(F.lit(0), "block")).alias("i"), F.col("block").alias("j"))
    within = left.join(right, ["class", "i", "j"]).where("key_a < key_b or (i <> j and key_a <> key_b)").select("field", F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b"), F.lit(1.0).alias("similarity"))
    return across.unionByName(within)


def near_duplicate_groups(fields: dict[str, tuple[DataFrame, str, str, str]], *, threshold: float = 0.6, shingle: int = 3, least_tokens: int = 30, rare: int = RARE) -> DataFrame:
    """(field, key, class, representative, copies, links): every record that takes part, its class of equal feature sets, the smallest key and the size of that class, and how many other classes are alike."""
    rows = feature_rows(fields)
    members, links = class_pairs(rows, threshold, shingle, least_tokens, rare)
    degree = links.select(F.explode(F.array("class_a", "class_b")).alias("class")).groupBy("class").agg(F.count("*").alias("links"))
    about = members.groupBy("class").agg(F.min("key").alias("representative"), F.count("*").alias("copies")).join(degree, "class", "left")
    return members.join(about, "class").select("field", "key", "class", "representative", "copies", F.coalesce("links", F.lit(0)).alias("links"))
