"""Problem 1: passages of held-out prompts inside training text.

Every partition of the corpus is a training shard. Its texts are reduced to
word numbers of the held-out vocabulary, broken wherever two neighbours never
follow each other in a held-out prompt (no phrase can cross such a break, so
nothing is lost), and indexed by an FM-index. All held-out phrases are then
searched backward at once, their places located by sampled suffix positions,
and the located phrases merged to spans, which an exact alignment with the
prompt confirms.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.fmindex import FMIndex
from tallyforge.llm.tokens import ANY_WORD, LOWER, chunks, words
from tallyforge.runtime import bounded_rows

#: Bounds and lengths of the search; all are parameters of :func:`find_leaks`.
MAX_ITEMS, MAX_BYTES = 20_000, 256_000_000
EXACT_WORDS = 18
EDITED_WORDS = 30
EDIT_SHARE = 0.15
STOCK_WORDS, STOCK_GROUPS = 8, 3
SEED_WORDS = 5
SHARD_BYTES, SHARD_WORDS = 12_000_000, 600_000

_DROPPED = b"'-_\\*`~"
_TAG = re.compile(r"<(/?)(?:[a-zA-Z][\w-]*)(?:\s[^<>\n]{0,80})?/?>")
_ESCAPED = re.compile(r"\\(?:[nrt](?![a-z]{2})|u00a0|x20)|\\[nrt](?=[a-z])")
_CODE = re.compile(r"\\u([0-9a-fA-F]{4})")
_HYPHEN = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n[ \t]*(?:(?:[>|#*%]|//|--|;;)+[ \t]*)?(?=[^\W\d_])")
_INVISIBLE = {c: None for c in range(0x110000) if unicodedata.category(chr(c)) == "Cf"} | {0x034F: None} | dict.fromkeys(range(0xFE00, 0xFE10))


def plain(text: str) -> bytes:
    """A text without what does not matter: case, markup, escapes, entities, invisible characters.

    What is left between words is punctuation and space, which the word
    splitter skips; hyphens, quotes and underscores inside words are dropped,
    so that a word broken over two lines is whole again.
    """
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text.translate(_INVISIBLE)).translate(_INVISIBLE)
        if not text.isascii():
            text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()
    if "&" in text:
        text = html.unescape(text)
        if not text.isascii():
            text = unicodedata.normalize("NFKC", text.translate(_INVISIBLE))
    if "%20" in text or "%0A" in text:
        text = unquote(text)
    if "\\" in text:
        text = _CODE.sub(lambda m: chr(int(m[1], 16)) if int(m[1], 16) < 0xD800 else " ", _ESCAPED.sub(" ", text)).translate(_INVISIBLE)
    if "<" in text:
        text = _TAG.sub(lambda m: " " if m[0][1:].lstrip("/").lower().startswith(("br", "p", "li", "div", "tr", "td", "h")) else "", text)
    if "-" in text:
        text = _HYPHEN.sub("", text)
    return text.encode("utf-8", "replace").translate(LOWER, _DROPPED)


@dataclass
class Probe:
    """The held-out prompts as word numbers, ready to be broadcast; its size follows the prompts only."""

    vocabulary: np.ndarray  # sorted word hashes; the number of a word is its place + 1
    pairs: np.ndarray  # sorted numbers of neighbouring words, first * (len + 1) + second
    prompts: list[np.ndarray]
    counts: list[np.ndarray]  # whether each word counts, that is, is not stock wording
    groups: list[str]
    seeds: list[tuple[np.ndarray, list[np.ndarray]]]  # phrases of one length, and for each its (prompt, place) rows


def probe(items: list[tuple[str, str]], seed_words: int = SEED_WORDS, seed_groups: int | None = None) -> Probe:
    """Number the words of the held-out prompts and choose the phrases to search.

    All phrases of ``seed_words`` words are searched but those within stock
    wording. With ``seed_groups``, only those found in at most so many groups
    are, and where all of these in a row are more frequent, the phrases of
    ``STOCK_WORDS`` words that are not stock wording: this is faster and still
    finds every unaltered passage, but not every altered one.
    """
    seed_groups = len(items) if seed_groups is None else seed_groups
    items = [(g, t) for g, t in items if g is not None and t]
    w = words([plain(t) for _, t in items], ANY_WORD)
    vocabulary = np.unique(w.hash)
    numbers = (np.searchsorted(vocabulary, w.hash) + 1).astype(np.int64)
    prompts = [numbers[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    groups = [g for g, _ in items]
    width = len(vocabulary) + 1
    follow = [p[:-1] * width + p[1:] for p in prompts if len(p) > 1]
    pairs = np.unique(np.concatenate(follow)) if follow else np.zeros(0, np.int64)

    def places(k: int) -> dict[tuple, list[tuple[int, int]]]:
        at = defaultdict(list)
        for i, p in enumerate(prompts):
            own = p.tolist()
            for j in range(len(own) - k + 1):
                at[tuple(own[j : j + k])].append((i, j))
        return at

    spread_of = lambda rows: len({groups[i] for i, _ in rows})
    counts = [np.ones(len(p), bool) for p in prompts]
    long = places(STOCK_WORDS)
    for rows in long.values():
        if spread_of(rows) >= STOCK_GROUPS:
            for i, j in rows:
                counts[i][j : j + STOCK_WORDS] = False
    short = {x: rows for x, rows in places(seed_words).items() if spread_of(rows) <= seed_groups and any(counts[i][j : j + seed_words].any() for i, j in rows)}
    rest = {x: rows for x, rows in long.items() if spread_of(rows) < STOCK_GROUPS and not any(x[i : i + seed_words] in short for i in range(STOCK_WORDS - seed_words + 1))}
    seeds = [(np.array(list(x), np.int64), [np.array(r, np.int64) for r in x.values()]) for x in (short, rest) if x]
    return Probe(vocabulary, pairs, prompts, counts, groups, seeds)


def _aligned(doc: np.ndarray, prompt: np.ndarray, counts: np.ndarray, hits: np.ndarray, seed: int, exact: int, edited: int, share: float) -> list[tuple[int, int]]:
    """Spans of the text that hold a long enough passage of the prompt.

    ``hits`` are rows (place in the text, place in the prompt). Located phrases
    are grown to the longest equal runs; neighbouring runs are chained over
    small gaps, the larger side of a gap being its number of edits.
    """
    runs = []
    done: dict[int, int] = {}
    for d, p in hits.tolist():
        if done.get(d - p, -1) >= d:
            continue
        a, b = d, p
        while a and b and doc[a - 1] == prompt[b - 1] and doc[a - 1]:
            a, b = a - 1, b - 1
        n = d - a + seed
        while a + n < len(doc) and b + n < len(prompt) and doc[a + n] == prompt[b + n]:
            n += 1
        done[d - p] = a + n
        runs.append((a, b, n))
    runs.sort()
    spans = [(a, a + n) for a, b, n in runs if counts[b : b + n].sum() >= exact]
    gap = 12
    for i, (a, b, n) in enumerate(runs):
        end_d, end_p, edits = a + n, b + n, 0
        for c, e, m in runs[i + 1 :]:
            if c - end_d > gap:
                break
            # runs on another diagonal may overlap by chance; the overlap belongs to the first
            over = max(0, end_d - c, end_p - e)
            if e - end_p > gap or over >= m:
                continue
            gap_d, gap_p = c + over - end_d, e + over - end_p
            between = _edits(doc[end_d : c + over], prompt[end_p : e + over]) if max(gap_d, gap_p) > 1 else max(gap_d, gap_p)
            edits, end_d, end_p = edits + between, c + m, e + m
            n_count = int(counts[b:end_p].sum())
            if n_count >= edited and edits <= share * max(end_p - b, end_d - a):
                spans.append((a, end_d))
    return spans


def _edits(x: np.ndarray, y: np.ndarray) -> int:
    """Edit distance of two short word sequences."""
    row = list(range(len(y) + 1))
    for i, a in enumerate(x.tolist(), 1):
        last, row[0] = row[0], i
        for j, b in enumerate(y.tolist(), 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]


def search_shard(p: Probe, raw: list[bytes], exact: int = EXACT_WORDS, edited: int = EDITED_WORDS, share: float = EDIT_SHARE) -> list[tuple[int, str, list[tuple[int, int]]]]:
    """(text, group, merged spans of words) for every leak in the texts of one shard."""
    if not len(p.vocabulary) or not p.seeds:
        return []
    parts, text_first, base = [], [0], 0
    for a, b in chunks(raw):
        w = words(raw[a:b], ANY_WORD)
        at = np.searchsorted(p.vocabulary, w.hash)
        at[at == len(p.vocabulary)] = 0
        parts.append(np.where(p.vocabulary[at] == w.hash, at + 1, 0))
        text_first.extend((w.first[1:] + base).tolist())
        base += len(w.hash)
    if not base:
        return []
    number = np.concatenate(parts)
    first = np.array(text_first)
    text_of = np.repeat(np.arange(len(raw)), np.diff(first))
    # keep the words that follow, or are followed, as in some prompt
    code = number[:-1] * (len(p.vocabulary) + 1) + number[1:]
    inside = (number[:-1] > 0) & (number[1:] > 0) & (text_of[1:] == text_of[:-1])
    at = np.searchsorted(p.pairs, code[inside])
    at[at == len(p.pairs)] = 0
    joined = np.zeros(len(number) + 1, bool)
    joined[1:-1][inside] = p.pairs[at] == code[inside]
    # joined[i]: words i - 1 and i belong together; runs of less than a phrase cannot hold one
    begin = np.flatnonzero(~joined[:-1])
    length = np.diff(np.concatenate((begin, [len(number)])))
    least = min(x.shape[1] for x, _ in p.seeds)
    begin, length = begin[length >= least], length[length >= least]
    if not len(begin):
        return []
    out: dict[tuple[int, str], list[tuple[int, int]]] = defaultdict(list)
    bound = np.searchsorted(np.cumsum(length) // SHARD_WORDS, np.arange((length.sum() // SHARD_WORDS) + 2))
    for lo_run, hi_run in zip(bound[:-1], bound[1:], strict=True):
        own_begin, own_length = begin[lo_run:hi_run], length[lo_run:hi_run]
        if not len(own_begin):
            continue
        size = own_length + 1
        seq = np.zeros(int(size.sum()), np.int64)
        origin = np.zeros(len(seq), np.int64)
        to = np.concatenate(([0], np.cumsum(size)[:-1]))
        step = np.arange(len(seq)) - np.repeat(to, size)
        origin[:] = np.repeat(own_begin, size) + step
        word = step < np.repeat(own_length, size)
        seq[word] = number[origin[word]]
        index = FMIndex(seq, len(p.vocabulary) + 1)
        found_at, found_prompt, found_place = [], [], []
        for phrases, rows in p.seeds:
            lo, hi = index.search(phrases)
            at, phrase = index.locate(lo, hi)
            if len(at):
                n = np.array([len(rows[x]) for x in phrase.tolist()])
                both = np.concatenate([rows[x] for x in phrase.tolist()])
                found_at.append(np.repeat(origin[at], n))
                found_prompt.append(both[:, 0])
                found_place.append(both[:, 1])
        if not found_at:
            continue
        at, prompt, place = map(np.concatenate, (found_at, found_prompt, found_place))
        dense = _dense(text_of[at] * len(p.prompts) + prompt, at, place, least)
        at, prompt, place = at[dense], prompt[dense], place[dense]
        if not len(at):
            continue
        by = np.lexsort((at, prompt, text_of[at]))
        at, prompt, place = at[by], prompt[by], place[by]
        text = text_of[at]
        edge = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (prompt[1:] != prompt[:-1]), [True])))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            i, j = int(text[a]), int(prompt[a])
            doc = number[first[i] : first[i + 1]]
            hits = np.stack((at[a:b] - first[i], place[a:b]), 1)
            spans = _aligned(doc, p.prompts[j], p.counts[j], hits, least, exact, edited, share)
            if spans:
                out[(i, p.groups[j])] += spans
    return [(i, g, _merged(s)) for (i, g), s in sorted(out.items())]


def _dense(pair: np.ndarray, at: np.ndarray, place: np.ndarray, seed: int, near: int = 16, window: int = 60, least: int = 10) -> np.ndarray:
    """Located phrases of the pairs of a text and a prompt that may hold a passage.

    Those are the pairs for which phrases within ``near`` diagonals of each
    other and within ``window`` words cover ``least`` words: fewer cannot be
    an unaltered passage nor one with the permitted edits.
    """
    good = []
    diagonal = at - place
    for shift in (0, near // 2):
        bucket = (diagonal - diagonal.min() + shift) // near
        by = np.lexsort((at, bucket, pair))
        own_pair, own_bucket, own_at = pair[by], bucket[by], at[by]
        fresh = np.concatenate(([True], (own_pair[1:] != own_pair[:-1]) | (own_bucket[1:] != own_bucket[:-1])))
        total = np.cumsum(np.where(fresh, seed, np.minimum(seed, np.diff(own_at, prepend=0))))
        line = np.cumsum(fresh) * (int(at.max()) + window + 2) + own_at
        from_ = np.searchsorted(line, line - window)
        good.append(own_pair[total - total[from_] + seed >= least])
    return np.isin(pair, np.concatenate(good))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


_OUT = pa.schema([("corpus", pa.string()), ("record_key", pa.int64()), ("contamination_group", pa.string()), ("spans", pa.list_(pa.struct([("start_word", pa.int32()), ("end_word", pa.int32())])))])


def find_leaks(corpora: dict[str, tuple[DataFrame, str, str]], held_out: DataFrame, group: str, prompt: str, *, max_items: int = MAX_ITEMS, exact_words: int = EXACT_WORDS, edited_words: int = EDITED_WORDS, edit_share: float = EDIT_SHARE, seed_words: int = SEED_WORDS, seed_groups: int | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """One row (corpus, record_key, contamination_group, spans) per record and held-out group that leaked into it.

    ``corpora`` maps a name to a table and its key and text columns. ``spans``
    are the merged half-open ranges of words to remove (words of the
    normalised text). The held-out set must have at most ``max_items`` rows and
    ``max_bytes`` of text (checked, an error otherwise); the corpora may have any size and are read
    once, without a shuffle. Rows with a null key, text or group, and blank
    texts, give no row; repeated rows each give theirs; other columns are
    ignored; empty tables give an empty result.
    """
    spark = held_out.sparkSession
    size = held_out.agg(F.coalesce(F.sum(F.octet_length(prompt)), F.lit(0))).first()[0]
    if size > max_bytes:
        raise ValueError(f"the held-out set has more than {max_bytes} bytes; raise the bound or search it part by part")
    rows = bounded_rows(held_out.select(F.col(group).cast("string"), F.col(prompt)), max_items, "the held-out set")
    shared = spark.sparkContext.broadcast(probe([(r[0], r[1]) for r in rows], seed_words, seed_groups))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        names: list[str] = []
        keys: list[int] = []
        raw: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            found = search_shard(p, raw, exact_words, edited_words, edit_share)
            spans = [[{"start_word": a, "end_word": b} for a, b in s] for _, _, s in found]
            return pa.RecordBatch.from_arrays([pa.array([names[i] for i, _, _ in found], pa.string()), pa.array([keys[i] for i, _, _ in found], pa.int64()), pa.array([g for _, g, _ in found], pa.string()), pa.array(spans, _OUT.field(3).type)], schema=_OUT)

        for batch in batches:
            for c, k, t in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                names.append(c)
                keys.append(k)
                raw.append(plain(t))
                size += len(raw[-1])
                if size > SHARD_BYTES:
                    yield flush()
                    names, keys, raw, size = [], [], [], 0
        if raw:
            yield flush()

    parts = [df.select(F.lit(name).alias("c"), F.col(key).cast("long").alias("k"), F.col(text).alias("t")).where("k is not null and length(t) > 0") for name, (df, key, text) in corpora.items()]
    return reduce(DataFrame.unionByName, parts).mapInArrow(run, "corpus string, record_key long, contamination_group string, spans array<struct<start_word:int,end_word:int>>")
