"""Problem 2: text values that lack their end.

Intact values are cut artificially to make positives; a hashed logistic
regression on closing tokens, punctuation, open structures (fences, tags,
brackets, blocks) and the distance to the usual length limit of the source is
fitted on these and scores every value. How often a last word was seen in the
sample, and how often it closed a sentence there, tells words cut in two and
sentences cut between words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.linear import Linear, Rows, fit_logistic, hashed, threshold
from tallyforge.llm.tokens import LOWER, chunks, hashes
from tallyforge.runtime import bounded_rows, checkpointed

#: Most values of each field that the model is fitted on.
SAMPLE = 4000
#: A length is a limit of a source when it is this many times as frequent as lengths within LIMIT_NEAR of it are on average, and at least so often.
LIMIT_RATIO, LIMIT_LEAST, LIMIT_NEAR = 8.0, 6, 32

_INVISIBLE = "​‌‍⁠﻿­"
_FENCE = re.compile(r"^[ \t]*(?:```|~~~)", re.M)
_TAG = re.compile(r"<(/?)([a-z][a-z_]{1,15})>")
_TRACE = re.compile(r"�+$|(?:\.\.\.|…)[ ]?(?:[\[(<{][^\])>}\n]{0,40}[\])>}])?$|\[(?:cut|truncated|snip|clipped|\+)[^\]\n]{0,30}\]?$|<(?:cut|truncated|snip)[^>\n]{0,30}>?$")
_TOKEN = re.compile(r"\n+|\d+'[sS]?[hHdDbBoO]?\w*|[^\W\d_]\w*'?[^\W\d_]*|_\w*|\d[\w.]*|[^\w\s]")
_COMMENT = re.compile(r"//[^\n]*|/\*.*?\*/|#[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'(?![hdbo])", re.S)
_CODE_START = re.compile(r"\s*(?:`timescale|module\b|import\b|from\b|library\b|entity\b|architecture\b|def\b|class\b|@\w|//|/\*|#|package\b|interface\b|\"\"\")")
_NAME = re.compile(r"\w+")
_NAMES = bytes(c if chr(c).isalnum() and c < 128 or c == 95 else 32 for c in range(256))
#: What opens a block, and what closes it.
_BLOCKS = {"module": "endmodule", "begin": "end", "case": "endcase", "function": "endfunction", "task": "endtask", "generate": "endgenerate"}
_STOPS, _CLOSING = (". ", ".\n", "! ", "!\n", "? ", "?\n", ": ", ":\n", "\n\n", "。", "！", "？"), tuple(".!?:。！？")


#: Bare placeholders that stand for a missing value (fixed values).
_PLACEHOLDER = re.compile(r"(?:[\s​\-_.·…]|n/?a|none|null|nil|tbd|todo|pending|empty|\[?\(?(?:no|empty) (?:output|answer|response|content)\)?\]?|<[^<>\n]{1,12}>|```\w*|//|/\*|\*/|#)*", re.I)


def placeholder(value: str) -> bool:
    """Whether a value is nothing but placeholders, empty tags and empty fences."""
    return len(value) < 120 and _PLACEHOLDER.fullmatch(value) is not None


@lru_cache(1 << 16)
def _word(t: str) -> str:
    if t[0] == "\n":
        return "\n" if len(t) == 1 else "\n\n"
    if "'" in t and t[0].isdigit():
        return "LIT" if len(t) > t.index("'") + 2 else "LIT_"
    if t[0].isdigit():
        return "NUM." if t.endswith(".") else "NUM"
    if "_" in t:
        return "ID_" if t.endswith("_") else "ID"
    if t[0].isalpha() and any(c.isdigit() for c in t):
        return "ID"
    return t.lower()


def _first_words(t: str, n: int) -> list[str]:
    return [_word(m[0]) for m in islice(_TOKEN.finditer(t), n)]


def _code_state(code: str) -> list[str]:
    """What is open at the end of source code: brackets, blocks, comments, statements."""
    bare = _COMMENT.sub(" ", code)
    out = []
    for a, b in ("()", "[]", "{}"):
        n = bare.count(a) - bare.count(b)
        out.append(f"c:{a}{(n > 0) - (n < 0)}")
    verilog = "module" in bare
    if verilog:
        names = bare.encode().translate(_NAMES).split() if bare.isascii() else [x.encode() for x in _NAME.findall(bare)]
        for k, end in _BLOCKS.items():
            n = names.count(k.encode()) - names.count(end.encode()) if k in bare or end in bare else 0
            out.append(f"c:{k}{(n > 0) - (n < 0)}")
    out.append(f"c:comment{'/*' in bare or (chr(34) * 3) in bare}")
    lines = [x for x in bare.splitlines() if x.strip()]
    if lines:
        last = lines[-1]
        indent = len(last) - len(last.lstrip())
        shape = " ".join(_first_words(last, 3))
        out += [f"c:indent{min(indent, 12)}:{verilog}", f"c:line:{shape}", f"c:end:{verilog}:{last.rstrip()[-1]}"]
        if not verilog:
            block = next((x.split()[0] for x in reversed(lines) if x[0] not in " \t)#"), "")
            out.append(f"c:block:{block}:{last.split()[0]}:{indent > 0}")
    return out


#: Words of prose, and what closes a sentence behind one.
_PROSE = re.compile(r"([^\W\d_]+(?:[\'’-][^\W\d_]+)*)([\"\'”’)*`\]]*[.!?:;。！？…]+(?=\s|$)|[ \t]*(?:\n|$))?")


def vocabulary(values: list[str]) -> dict[str, tuple[int, int]]:
    """How often every word is seen in the values, and how often it closes a sentence or a line."""
    out: dict[str, list[int]] = {}
    for v in values:
        for m in _PROSE.finditer(v):
            n = out.setdefault(m[1].lower(), [0, 0])
            n[0] += 1
            n[1] += m[2] is not None
    return {w: (a, b) for w, (a, b) in out.items() if a > 1}


def counted_words(values: list[str]) -> dict[str, list[int]]:
    """The counts of :func:`vocabulary` for all words of a batch, those seen once included."""
    out: dict[str, list[int]] = {}
    plain = [v for v in values if v.isascii()]
    for a, b in chunks(plain, 1 << 17):
        for w, n, closes in _counted_plain("\n".join(plain[a:b]).encode().translate(LOWER) + b"\n"):
            both = out.setdefault(w, [0, 0])
            both[0] += n
            both[1] += closes
    other = [v for v in values if not v.isascii()]
    for a, b in chunks(other, 1 << 18):
        for (w, end), n in Counter(_PROSE.findall("\n".join(other[a:b]).lower() + "\n")).items():
            both = out.setdefault(w, [0, 0])
            both[0] += n
            both[1] += n if end else 0
    return out


def _bytes(signs: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(signs.encode())] = True
    return out


#: Classes of bytes in _PROSE.
_LETTER, _JOINS, _BEHIND, _ENDS, _BLANK, _SPACE = map(_bytes, ("abcdefghijklmnopqrstuvwxyz", "'-", "\"')*`]", ".!?:;", " \t", "\t\n\v\f\r\x1c\x1d\x1e\x1f "))


def _counted_plain(raw: bytes) -> Iterator[tuple[str, int, int]]:
    """(word, n, closes) as _PROSE finds them in lower-case ASCII text that ends with a line end, without an object for every word."""
    b = np.frombuffer(raw, np.uint8)
    letter = _LETTER[b]
    # a single sign between two letters joins them
    inside = letter.copy()
    inside[1:-1] |= _JOINS[b[1:-1]] & letter[:-2] & letter[2:]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return
    beyond = lambda signs, at: (rest := np.flatnonzero(~signs[b]))[np.searchsorted(rest, at)]
    stop = beyond(_BEHIND, end)
    past = beyond(_ENDS, stop)
    closes = (past > stop) & _SPACE[b[past]] | (b[beyond(_BLANK, end)] == 10)
    h = hashes(b, start, end)
    by = np.argsort(h, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], h[by][1:] != h[by][:-1])))
    n, closed = np.diff(np.append(first, len(by))), np.add.reduceat(closes[by].astype(np.int64), first)
    for a, z, k, c in zip(start[by[first]].tolist(), end[by[first]].tolist(), n.tolist(), closed.tolist(), strict=True):
        yield raw[a:z].decode(), k, c


def near_limit(source: str | None, n: int, limits: frozenset[tuple[str, int]]) -> str:
    """Distance of a length to the next limit of its source: 0 at it, else the bits of what is missing, no for none near."""
    if not limits or (source, n) in limits:
        return "0" if limits else "no"
    return next((f"-{k.bit_length()}" for k in range(1, 9) if (source, n + k) in limits), "no")


def features(value: str, limit: str = "no", known: dict[str, tuple[float, float]] | None = None, own: float = 0, only_inside: bool = False) -> tuple[list[str], bool]:
    """Feature strings of the end of a value, and whether it ends inside a fence, tag or code block.

    ``known`` is the vocabulary; ``own`` is what the value itself counts in it,
    so that its last word is taken out again. ``only_inside`` leaves the features out.
    """
    t = value.rstrip().rstrip(_INVISIBLE).rstrip()
    out = [f"limit:{limit}", f"size:{min(9, len(t).bit_length())}"]
    if len(t) < 24:
        out.append(f"whole:{t}")
    # a trace is short but for its marks of bytes that are no character
    trace = _TRACE.search(t, max(0, min(len(t) - 64, len(t.rstrip("\ufffd")))))
    if trace:
        out.append("trace:" + re.sub(r"\d+", "N", trace[0])[:24])
        out.append("trace")
        t = t[: trace.start()].rstrip()
    fences = [m.start() for m in _FENCE.finditer(t)] if "```" in t or "~~~" in t else []
    tags = []
    for m in _TAG.finditer(t):
        if m[1]:
            if m[2] in tags:
                del tags[len(tags) - 1 - tags[::-1].index(m[2]) :]
        elif m[2] not in ("br", "hr"):
            tags.append(m[2])
    open_tag = [x for x in tags if x in ("think", "answer", "reasoning", "thought", "solution", "code", "output", "response")]
    out += [f"fence:{len(fences) % 2}", *(f"open:{x}" for x in open_tag), f"tags:{bool(open_tag)}"]
    inside = bool(len(fences) % 2 or open_tag)
    code = None
    if len(fences) % 2:
        code = t[fences[-1] :].partition("\n")[2]
    elif not fences and _CODE_START.match(_body(t)):
        code = _body(t)
    kind = "code" if code is not None else "text"
    if code is not None:
        state = _code_state(code)
        out += state
        inside = inside or any(x.endswith(")1") or x.endswith("1") and x.startswith(("c:(", "c:[", "c:{", "c:module", "c:begin", "c:case")) or x == "c:commentTrue" for x in state)
    if only_inside:
        return [], inside
    # six tokens are rarely longer than this; of longer ones fewer are compared
    tokens = [_word(x) for x in _TOKEN.findall(t[-160:])][-6:]
    raw_last = t[-80:].split()[-1] if tokens else ""
    for n in (1, 2, 3, 4, 6):
        out.append(f"{kind}{n}:" + " ".join(tokens[-n:]))
    out.append(f"char:{kind}:{t[-1:] if not t[-1:].isalnum() else 'x'}")
    out.append(f"raw:{raw_last[-3:] if raw_last.isalpha() and len(raw_last) > 3 else raw_last[-2:]}:{raw_last.isalpha()}")
    if code is None and raw_last.isalpha():
        out.append(f"word:{raw_last.lower()}")
        if known is not None:
            n, closes = known.get(raw_last.lower(), (0, 0))
            if own:
                n, closes = max(0, n - own), max(0, closes - own)
            out.append(f"known:{min(5, int(n).bit_length())}:{-1 if n < 4 else min(4, int(16 * closes / n))}:{raw_last.isascii()}")
    if code is None:
        stopped = t[-1:] in _CLOSING
        sentence = t[_sentence(t) :]
        first = _first_words(sentence[:80], 2)
        head, n_commas, size = " ".join(first), sentence.count(",") + sentence.count(";"), sentence.count(" ")
        out += [f"stop:{stopped}", f"head:{head}:{stopped}", f"s3:{head}:{n_commas}:" + " ".join(tokens[-3:]), f"s2:{head.partition(' ')[0]}:{n_commas}:{';' in sentence}:" + " ".join(tokens[-2:]), f"len:{min(size, 20)}:{stopped}"]
        before, _, line = t.rpartition("\n")
        out.append("line:" + " ".join(_first_words(line[:120], 8)))
        out.append(f"alone:{min(6, line.count(' '))}:{before[-1:] == chr(10)}:{before.rstrip()[-1:] in _CLOSING}:{'endmodule' in before[-14:]}")
    return out, inside


def _sentence(t: str) -> int:
    """Where the last sentence begins."""
    # a stop near the end comes behind all that are farther from it
    last = len(t) - 1
    near = max(t.rfind(x, max(0, last - 400), last) + len(x) if x in t[-401:] else 0 for x in _STOPS)
    return near if near > 2 else max(t.rfind(x, 0, last) + len(x) if x in t else 0 for x in _STOPS)


def _body(t: str) -> str:
    """The text behind reasoning and an opening answer tag."""
    return t.rsplit("</think>", 1)[-1].lstrip().removeprefix("<answer>").removesuffix("</answer>")


def cut(value: str, rng: np.random.Generator, trace: bool = True) -> str | None:
    """An artificially cut copy, or none where the rest happens to be complete."""
    n = len(value.rstrip())
    if n < 24:
        return None
    # half anywhere, half near the end, where a cut is hardest to see
    at = int(rng.integers(8, n)) if rng.random() < 0.6 else int(n - rng.integers(1, min(n - 8, 260)))
    out = value[:at]
    rest = out.rstrip()
    _, inside = features(out, only_inside=True)
    if not inside and (not rest or rest[-1] in ".!?。！？:`>)}|" or rest.endswith("endmodule") or value[at : at + 1] in (".", "\n") or not value[at:].strip("` \n")):
        return None
    if trace and rng.random() < 0.25:
        mark = ("…", "...", f"... [+{rng.integers(5, 900)} chars]", "�", "[truncated]", f"[cut: {rng.integers(5, 900)}]", f"… ({rng.integers(5, 900)} more)", "<", "\\", "&am", "&l", "\\u", "\\u00", "\\x", "&", " \"", " (", " [", " {", "`", " ``", "</", "<b")
        out += mark[int(rng.integers(len(mark)))]
    return out


def damaged(value: str, rng: np.random.Generator) -> str | None:
    """A copy of source code that lacks a line or a word before its end: broken, but not cut."""
    lines = value.split("\n")
    n = len(lines) - 5
    if n < 4 or "module" not in value and "def " not in value:
        return None
    i = int(rng.integers(1, n))
    if "```" in lines[i] or "<" in lines[i][:1] or not lines[i].strip():
        return None
    if rng.random() < 0.5:
        del lines[i]
    else:
        parts = re.split(r"(\W)", lines[i])
        del parts[int(rng.integers(len(parts)))]
        lines[i] = "".join(parts)
    return "\n".join(lines)


@dataclass
class CutModel:
    model: Linear
    level: float
    limits: frozenset[tuple[str, int]]
    known: dict[str, tuple[int, int]]

    def scores(self, values: list[str], sources: list[str | None]) -> np.ndarray:
        rows = [hashed(features(v, near_limit(s, len(v), self.limits), self.known)[0]) for v, s in zip(values, sources, strict=True)]
        return self.model.margin(Rows.of(rows))[:, 0] if rows else np.zeros(0)

    def is_cut(self, values: list[str], sources: list[str | None]) -> np.ndarray:
        return self.scores(values, sources) >= self.level


def fit(intact: list[tuple[str, str | None]], limits: frozenset[tuple[str, int]] = frozenset(), *, copies: int = 2, rounds: int = 3, seed: int = 11) -> CutModel:
    """Fit on values taken as intact; some may be cut unseen, so values of just a limit's length are no example of intact ones, and what one round scores as cut is left out of the next.

    A fifth of the values is held back to choose the threshold, weighted so
    that one value in twenty counts as cut.
    """
    rng = np.random.default_rng(seed)
    known = vocabulary([v for v, _ in intact])
    base: list[np.ndarray] = []
    made: list[list[np.ndarray]] = []
    bare: list[np.ndarray | None] = []
    for v, s in intact:
        base.append(hashed(features(v, near_limit(s, len(v), limits), known, own=1)[0]))
        stripped = v.rstrip()
        other = stripped[:-1] if stripped.endswith((".", "。")) else damaged(v, rng)
        bare.append(hashed(features(other, "no", known, own=1)[0]) if other and rng.random() < 0.4 else None)
        cuts = [c for c in (cut(v, rng) for _ in range(copies)) if c]
        made.append([hashed(features(c, "0" if limits and rng.random() < 0.3 else "no", known)[0]) for c in cuts])
    keep = np.array([(s, len(v)) not in limits for v, s in intact], bool)
    held = rng.random(len(intact)) < 0.2
    model, level = Linear(np.zeros((1 << 18, 1), np.float32), np.zeros(1)), 0.0
    for _ in range(rounds):
        rows, y, part = [], [], []
        for i in np.flatnonzero(keep).tolist():
            own = [(base[i], 0.0), *([(bare[i], 0.0)] if bare[i] is not None else []), *((x, 1.0) for x in made[i])]
            for x, label in own:
                rows.append(x)
                y.append(label)
                part.append(held[i])
        if not rows:
            break
        every, y, part = Rows.of(rows), np.array(y), np.array(part)
        train = np.flatnonzero(~part)
        model = fit_logistic(every.take(train), y[train])
        score = model.margin(every)[:, 0]
        test = np.flatnonzero(part)
        share = max(1, (y[test] > 0).sum()) / max(1, (y[test] == 0).sum())
        level = threshold(score[test], y[test], np.where(y[test] > 0, 1 / 19 / share, 1.0)) if len(test) else 0.0
        keep &= model.margin(Rows.of(base))[:, 0] < 0
    return CutModel(model, level, limits, known)


def value_lengths(long: DataFrame, intact: str) -> DataFrame:
    """(source, n, count, intact): values of each length by field and source, from all rows; as many rows as there are lengths, so it is kept for what follows."""
    return checkpointed(long.groupBy(F.concat_ws("|", "field", F.coalesce("source", F.lit(""))).alias("source"), "field", F.length("value").alias("n")).agg(F.count("*").alias("count"), F.count_if(F.expr(intact)).alias("intact")))


def length_limits(lengths: DataFrame, *, ratio: float = LIMIT_RATIO, least: int = LIMIT_LEAST, near: int = LIMIT_NEAR) -> frozenset[tuple[str, int]]:
    """Lengths at which the values of a source pile up; the number of limits found is small.

    ``lengths`` as of :func:`value_lengths`. A length is compared with those
    around it, of which 2 * near there are, so that limits where few texts
    end are found as well.
    """
    around = F.sum("count").over(Window.partitionBy("source").orderBy("n").rangeBetween(-near, near)) - F.col("count")
    rows = lengths.where("n > 64").withColumn("mean", (around + 2) / (2.0 * near)).where((F.col("count") >= least) & (F.col("count") > ratio * F.col("mean"))).select("source", "n")
    return frozenset((r[0], r[1]) for r in bounded_rows(rows, 1_000_000, "the length limits"))


def long_form(df: DataFrame, key: str, source: str, fields: list[str], *keep: str) -> DataFrame:
    """Columns key, source, field, value: one row per non-empty value."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])
    flat = df.select(F.col(key).cast("long").alias("key"), F.col(source).alias("source"), *[F.col(x).alias(f"_{x}") for x in keep], F.explode(each).alias("e"))
    return flat.select("key", "source", *[f"_{x}" for x in keep], "e.field", "e.value").where("length(trim(value)) > 0")


def sampled_values(long: DataFrame, lengths: DataFrame, intact: str, sample: int) -> list[tuple[str, str | None]]:
    """At most ``sample`` (value, field|source) of each field for which ``intact`` holds, by a hash of the key, in one scan for all fields."""
    total = {r[0]: r[1] for r in bounded_rows(lengths.groupBy("field").agg(F.sum("intact")), 1000, "the fields")}
    h = F.pmod(F.xxhash64("key"), F.lit(1 << 20))
    # a hash range that keeps somewhat more than wanted, so that no task sends many more
    share = F.lit(0)
    for field, n in total.items():
        share = F.when(F.col("field") == field, int(min(1.0, (1.2 * sample + 100) / max(1, n)) * (1 << 20)) + 1).otherwise(share)
    # a key of many rows has one hash, so the number of rows is bounded as well
    rows = long.where(intact).where(h < share).select("field", "value", "source", h.alias("h"), "key").orderBy("h", "key").limit(max(1, len(total)) * (2 * sample + 1000)).collect()
    rows.sort(key=lambda r: (r.field, r.h, r.key))
    out, used = [], Counter()
    for r in rows:
        used[r.field] += 1
        if used[r.field] <= sample:
            out.append((r.value, f"{r.field}|{r.source or ''}"))
    return out


def fit_cut_model(long: DataFrame, intact: str, *, sample: int = SAMPLE) -> CutModel:
    """Fit on at most ``sample`` values of each field for which the condition ``intact`` holds, chosen by a hash of the key.

    ``long`` as of :func:`long_form`. Limits come from all rows.
    """
    lengths = value_lengths(long, intact)
    return fit(sampled_values(long, lengths, intact, sample), length_limits(lengths))


def score_values(long: DataFrame, model: CutModel) -> DataFrame:
    """(key, source, field, cut, score) for every value of ``long``."""
    shared = long.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            source, field, value = (b.column(i).to_pylist() for i in (1, 2, 3))
            s = m.scores(value, [f"{f}|{x or ''}" for f, x in zip(field, source, strict=True)])
            is_cut = (s >= m.level) & ~np.fromiter((placeholder(v) for v in value), bool, len(value))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(is_cut), pa.array(s)], names=["key", "source", "field", "cut", "score"])

    return long.select("key", "source", "field", "value").mapInArrow(run, "key long, source string, field string, cut boolean, score double")


def truncated_values(df: DataFrame, key: str, source: str, fields: list[str], intact: str = "true", keep: tuple[str, ...] = (), *, sample: int = SAMPLE) -> DataFrame:
    """Every value with its verdict: columns key, source, field, cut, score.

    Null and blank values are not judged and give no row; a value of any
    length is read to its end; repeated rows are judged alike, each under its
    own key; a null source is a source of its own; other columns are ignored;
    an empty table gives an empty result. ``intact`` is a condition on the
    columns of ``keep`` (as _name) that most intact values meet.
    """
    long = long_form(df, key, source, fields, *keep)
    return score_values(long, fit_cut_model(long, intact, sample=sample))
