"""Problems 6 and 7: token counts, filling containers, mixing sources to target weights."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.runtime import bounded_rows, checkpointed

#: Folder and file of the public tokenizer (byte-pair ranks) that sizes are counted with.
TOKENIZERS = os.environ.get("TALLYFORGE_TOKENIZERS", "/opt/tokenizers")
TOKENIZER = "byte_bpe_50k.tiktoken"
#: How the byte-pair vocabulary cuts text into pieces (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Containers that are open at once in a task, for each profile, and tasks whose rest is packed together.
OPEN, TOGETHER = 64, 32
MAX_PROFILES, MAX_SOURCES = 1000, 100_000


@cache
def _encoding(path: str):  # noqa: ANN202
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    return tiktoken.Encoding("tallyforge", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: A border that no piece of the vocabulary's pattern crosses: one space or line end between two characters that are none.
_BORDER = re.compile(r"(?<=\S)[ \n](?=\S)")


def token_count(text: str, path: str, stretch: int = 1_000_000) -> int:
    """Tokens of a whole text. To bound memory, long texts are encoded in stretches, which end at borders of pieces only, so the count is that of the whole."""
    e, n, at = _encoding(path), 0, 0
    while len(text) - at > stretch and (border := _BORDER.search(text, at + stretch)):
        n += len(e.encode_ordinary(text[at : border.start()]))
        at = border.start()
    return n + len(e.encode_ordinary(text[at:] if at else text))


def token_counts(df: DataFrame, key: str, text: str, *keep: str, path: str | None = None) -> DataFrame:
    """(key, *keep, n_tokens) for every row; a null text has 0 tokens."""
    file = path or str(Path(TOKENIZERS) / TOKENIZER)
    kept = [f for f in df.select(*keep).schema.fields]
    schema = ", ".join(["key long", *(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "n_tokens int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [token_count(t, file) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int32())], names=["key", *(f.name for f in kept), "n_tokens"])

    return df.select(F.col(key).cast("long").alias("key"), *keep, text).mapInArrow(run, schema)


class BestFit:
    """Bounded-space online best fit.

    The free space of every open container is a bit of an integer, so the
    container that an item fits best is the lowest bit from the item's size
    on. When too many are open, the fullest is closed.
    """

    def __init__(self, capacity: int, most: int = OPEN) -> None:
        self.capacity, self.most = capacity, most
        self.bits, self.count = 0, 0
        self.open: dict[int, list[list[tuple]]] = {}

    def _take(self, free: int) -> list[tuple]:
        own = self.open[free]
        out = own.pop()
        if not own:
            del self.open[free]
            self.bits &= ~(1 << free)
        self.count -= 1
        return out

    def add(self, item: tuple, size: int) -> list[tuple] | None:
        """Put an item (0 < size <= capacity) in; a container that closes by this is returned."""
        fit = self.bits >> size
        closed = None
        if fit:
            free = size + (fit & -fit).bit_length() - 1
            content = self._take(free)
        else:
            free, content = self.capacity, []
            if self.count >= self.most:
                closed = self._take((self.bits & -self.bits).bit_length() - 1)
        content.append(item)
        free -= size
        if free == 0:
            if closed is None:
                return content
            self._keep(0, closed)  # two close at once: one of them waits
            return content
        self._keep(free, content)
        return closed

    def _keep(self, free: int, content: list[tuple]) -> None:
        self.open.setdefault(free, []).append(content)
        self.bits |= 1 << free
        self.count += 1

    def rest(self) -> list[list[tuple]]:
        """All open containers, fullest first."""
        return [content for free in sorted(self.open) for content in self.open[free]]


_ITEM = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("first_token", pa.int32()), ("tokens", pa.int32())])
_OUT = pa.schema([("profile", pa.string()), ("capacity", pa.int32()), ("container", pa.string()), ("fill", pa.int32()), ("items", pa.list_(_ITEM)), ("block", pa.int32()), ("is_open", pa.bool_())])
_DDL = "profile string, capacity int, container string, fill int, items array<struct<doc_id:bigint,piece:int,first_token:int,tokens:int>>, block int, is_open boolean"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"profile": p, "capacity": c, "container": name, "fill": sum(x[3] for x in items), "items": [dict(zip(("doc_id", "piece", "first_token", "tokens"), x, strict=True)) for x in items], "block": block, "is_open": is_open} for p, c, name, items, block, is_open in rows], schema=_OUT)


def pack(df: DataFrame, key: str, text: str, profiles: DataFrame, profile: str, capacity: str, *, open_bins: int = OPEN, together: int = TOGETHER, path: str | None = None) -> DataFrame:
    """Containers of every profile: (profile, capacity, container, fill, fill_rate, n_items, items).

    An item is a document's token range; a document is split only when it is
    larger than the capacity, into full containers and a rest. Tasks pack what
    they read, without a shuffle; the containers still open at their end are
    taken apart and packed once more, those of ``together`` tasks at a time.
    Null and empty texts are no items; repeated rows are items each; profiles
    with a null or non-positive capacity are ignored; an empty table gives no
    container.
    """
    file = path or str(Path(TOKENIZERS) / TOKENIZER)
    wanted = sorted({(r[0], r[1]) for r in bounded_rows(profiles.select(F.col(profile).cast("string"), F.col(capacity).cast("int")), MAX_PROFILES, "the profiles") if r[1] and r[1] > 0}, key=str)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        bins = {p: BestFit(p[1], open_bins) for p in wanted}
        number = dict.fromkeys(wanted, 0)
        out: list[tuple] = []

        def close(p: tuple, content: list[tuple], is_open: bool = False) -> None:
            number[p] += 1
            out.append((*p, f"{task:05d}-{number[p]:06d}", content, task // together, is_open))

        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n = token_count(t, file)
                for p in wanted:
                    whole, left = divmod(n, p[1]) if n > p[1] else (0, n)
                    for i in range(whole):
                        close(p, [(k, i, i * p[1], p[1])])
                    if left:
                        done = bins[p].add((k, whole, whole * p[1], left), left)
                        if done:
                            close(p, done)
            if len(out) > 2000:
                yield _batch(out)
                out.clear()
        for p in wanted:
            for content in bins[p].rest():
                close(p, content, True)
        yield _batch(out)

    def again(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, size, block = (x.as_py() for x in key)
        items = sorted((x for b in batches for content in b.column(4).to_pylist() for x in content), key=lambda x: (-x["tokens"], x["doc_id"], x["piece"]))
        best, out = BestFit(size, open_bins), []
        closed = [c for x in items if (c := best.add((x["doc_id"], x["piece"], x["first_token"], x["tokens"]), x["tokens"]))]
        for i, content in enumerate([*closed, *best.rest()]):
            out.append((name, size, f"rest{block:05d}-{i:06d}", content, block, False))
        yield _batch(out)

    packed = checkpointed(df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).where("k is not null and length(t) > 0").mapInArrow(run, _DDL))
    rest = packed.where("is_open").groupBy("profile", "capacity", "block").applyInArrow(again, _DDL)
    return packed.where("not is_open").unionByName(rest).select("profile", "capacity", "container", "fill", (F.col("fill") / F.col("capacity")).alias("fill_rate"), F.size("items").alias("n_items"), "items")


def _uniform(*columns: Column) -> Column:
    """A number in [0, 1) from a hash of the columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 40)) / F.lit(float(1 << 40))


def mix(df: DataFrame, key: str, text: str, source: str, targets: DataFrame, target_source: str, weight: str, repeats: str, *, seed: int = 17, total_tokens: float | None = None, path: str | None = None) -> DataFrame:
    """One row (doc_id, source, copy_no, n_tokens, rate, target_share, reached_share) per drawn copy of a document.

    Tokens are added up per source before anything is exchanged. With T the
    total size (by default the largest at which no source must be used more
    often than its cap), a source's rate is T times its weight over its
    tokens, never more than the cap; a document is drawn floor(rate) times and
    once more with the rest as probability, by a hash of its key. Sources
    without a target, with weight 0 or null, and documents without tokens are
    not drawn; a source without documents has no part in choosing T. Repeated
    rows are drawn alike; an empty table gives an empty draw.
    """
    sized = checkpointed(token_counts(df, key, text, source, path=path).where("n_tokens > 0 and key is not null"))
    have = {r[0]: float(r[1]) for r in bounded_rows(sized.groupBy(source).agg(F.sum("n_tokens")), MAX_SOURCES, "the sources")}
    rows = bounded_rows(targets.select(F.col(target_source), F.col(weight).cast("double"), F.col(repeats).cast("double")), MAX_SOURCES, "the targets")
    wanted = {r[0]: (r[1], r[2]) for r in rows if r[0] is not None and r[1] and r[1] > 0 and r[2] and r[2] > 0}
    every = sum(w for w, _ in wanted.values())
    own = {s: (w / every, m) for s, (w, m) in wanted.items() if have.get(s)}
    total = total_tokens or min((m * have[s] / w for s, (w, m) in own.items()), default=0.0)
    rates = [(s, min(total * w / have[s], m), w) for s, (w, m) in own.items()]
    spark = df.sparkSession
    rate = F.broadcast(spark.createDataFrame(rates, f"`{source}` string, rate double, target_share double"))
    drawn = sized.join(rate, source).withColumn("copies", F.floor("rate") + (_uniform(F.lit(seed), F.col("key")) < F.col("rate") - F.floor("rate")).cast("long")).where("copies > 0")
    reached = drawn.groupBy(source).agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("size"))
    drawn_sizes = {r[0]: float(r[1]) for r in bounded_rows(reached, MAX_SOURCES, "the sources")}
    whole = sum(drawn_sizes.values()) or 1.0
    shares = F.broadcast(spark.createDataFrame([(s, n / whole) for s, n in drawn_sizes.items()], f"`{source}` string, reached_share double"))
    return drawn.join(shares, source).select(F.col("key").alias("doc_id"), F.col(source).alias("source"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy_no"), "n_tokens", "rate", "target_share", "reached_share")
