"""Problem 8: reading level of each document.

Every sentence is classified into the bands by two regularised linear models,
one on hashed character 4-grams and one on hashed words and word pairs; a
document's level is calibrated, on documents the models were not fitted on,
from the distribution of its sentences over the bands. Documents with few of
the words that are common in the fitted ones (those in other languages, or of
code alone) are levelled by the length of words and sentences instead. Scoring
works on whole batches of bytes, with no Python object per sentence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.linear import Rows, fit_logistic
from tallyforge.llm.tokens import ANY_WORD, LOWER, U, chunks, mix, words
from tallyforge.runtime import hash_sample

#: Most labelled documents the models are fitted on, bits of the feature hashes, bands.
SAMPLE, BITS, BANDS = 2400, 17, 5
#: Most bytes of text they are fitted on.
SAMPLE_BYTES = 64_000_000
#: A word is common if found in this share of the fitted documents; least share of common words in a document that the sentence models judge. Neither depends on how many are fitted.
COMMON, FAMILIAR = 0.1, 0.25
#: Han text has no spaces: two characters count as a word; its stops end a sentence, its other signs a word.
_HAN, _HAN_STOP, _HAN_SIGN = re.compile("[\u3400-\u9fff\uf900-\ufaff]{1,2}"), re.compile("[\u3002\uff01\uff1f]"), re.compile("[\u3000-\u3001\u3003-\u303f\uff02-\uff0f\uff1a-\uff1e\uff3b-\uff40\uff5b-\uff65]")
_ENDS = np.zeros(256, bool)
_ENDS[[33, 46, 63]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@dataclass
class Sentences:
    """Sentences of a batch: document of each, its words, and hashed features with the sentence of each."""

    doc: np.ndarray
    n_words: np.ndarray
    n_letters: np.ndarray
    chars: tuple[np.ndarray, np.ndarray]
    words: tuple[np.ndarray, np.ndarray]
    exact: np.ndarray  # 64-bit hashes of the words, and the sentence of each
    of: np.ndarray
    n_han: np.ndarray


def segmented(text: str) -> str:
    """The text with its Han characters in words of two and a line to each of their sentences."""
    return text if text.isascii() or not _HAN.search(text) else _HAN.sub(r" \g<0> ", _HAN_SIGN.sub(" ", _HAN_STOP.sub("\n", text)))


def sentences(texts: list[str]) -> Sentences:
    """Cut texts at stops before space, at Chinese stops and at line ends."""
    raw = [segmented(t).encode("utf-8", "replace").translate(LOWER) for t in texts]
    joined = b"\n".join(raw) + b"\n"
    b = np.frombuffer(joined, np.uint8)
    ends = np.cumsum(np.fromiter((len(x) + 1 for x in raw), np.int64, len(raw)))
    nxt = np.append(b[1:], 10)
    stop = (_ENDS[b] & _SPACE[nxt]) | (b == 10)
    if len(b) > 2:
        stop[2:] |= (b[2:] == 0x82) & (b[1:-1] == 0x80) & (b[:-2] == 0xE3)
    sentence_of = np.concatenate(([0], np.cumsum(stop)[:-1]))
    w = words(raw, ANY_WORD)
    of_word = sentence_of[w.start]
    used, number = np.unique(of_word, return_inverse=True)
    doc = np.searchsorted(ends, w.start, "right")
    first = np.searchsorted(number, np.arange(len(used)))
    rename = np.full(int(sentence_of[-1]) + 1 if len(b) else 1, -1, np.int64)
    rename[used] = np.arange(len(used))
    # digits are alike, and so are identifiers up to their parts
    folded = np.where((b >= 48) & (b <= 57), 48, b).astype(U)
    gram = folded[:-3] | folded[1:-2] << U(8) | folded[2:-1] << U(16) | folded[3:] << U(24) if len(b) > 3 else np.zeros(0, U)
    at = rename[sentence_of[: len(gram)]]
    inside = (at >= 0) & ~(_SPACE[b[: len(gram)]] & _SPACE[nxt[: len(gram)]])
    mask = U((1 << BITS) - 1)
    chars = ((mix(gram[inside]) & mask).astype(np.int32), at[inside])
    same = number[1:] == number[:-1]
    pair = mix(w.hash[:-1] + (w.hash[1:] << U(1)))[same]
    word_features = (np.concatenate((w.hash & mask, pair & mask)).astype(np.int32), np.concatenate((number, number[1:][same])))
    # letters are code points, that is bytes that do not continue one
    points = np.concatenate(([0], np.cumsum((b & 0xC0) != 0x80)))
    lead = b[w.start].astype(np.int32) << 8 | b[np.minimum(w.start + 1, len(b) - 1)]
    han = (lead >= 0xE390) & (lead < 0xEA00) | (lead >= 0xEFA4) & (lead < 0xEFAC)
    return Sentences(doc[first], np.bincount(number, minlength=len(used)), np.bincount(number, points[w.end] - points[w.start], len(used)), chars, word_features, w.hash, number, np.bincount(number, han, len(used)))


def _probabilities(weights: np.ndarray, bias: np.ndarray, features: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    index, row = features
    size = np.maximum(np.bincount(row, minlength=n), 1)
    z = np.stack([np.bincount(row, weights[index, k], n) / np.sqrt(size) + bias[k] for k in range(BANDS)], 1)
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


@dataclass
class ReadingModel:
    chars: tuple[np.ndarray, np.ndarray]
    words: tuple[np.ndarray, np.ndarray]
    common: np.ndarray  # sorted hashes of the words common in the fitted documents
    calibrated: np.ndarray
    neutral: np.ndarray  # for texts with few common words
    lengths: np.ndarray  # the same by sentence length alone, for Han text, whose words are not comparable
    prior: float

    def describe(self, s: Sentences, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per document: band distribution, language-neutral features, share of common words, whether in Han characters, sentences."""
        m = len(s.doc)
        p = (_probabilities(*self.chars, s.chars, m) + _probabilities(*self.words, s.words, m)) / 2
        weight = s.n_words.astype(float)
        total = np.maximum(np.bincount(s.doc, weight, n), 1)
        share = np.stack([np.bincount(s.doc, weight * p[:, k], n) / total for k in range(BANDS)], 1)
        count = np.bincount(s.doc, minlength=n)
        letters = np.bincount(s.doc, s.n_letters, n) / total
        long = np.bincount(s.doc, weight * np.minimum(s.n_words, 80), n) / total
        at = np.searchsorted(self.common, s.exact)
        seen = self.common[np.minimum(at, len(self.common) - 1)] == s.exact if len(self.common) else np.zeros(len(s.exact), bool)
        familiar = np.bincount(s.doc[s.of], seen, n) / total
        han = np.bincount(s.doc, s.n_han, n) > total / 2
        return share, np.stack([np.ones(n), np.log1p(letters), np.log1p(long)], 1), familiar, han, count

    def levels(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Level between 1 and BANDS, band distribution, and number of sentences of each text; no sentence, no level (nan)."""
        s = sentences(texts)
        share, neutral, familiar, han, count = self.describe(s, len(texts))
        level = np.where(familiar >= FAMILIAR, _design(share) @ self.calibrated, np.where(han, neutral[:, [0, 2]] @ self.lengths, neutral @ self.neutral))
        level = np.where(count > 0, np.clip(level, 1, BANDS), np.nan)
        return level, share, count


def _design(share: np.ndarray) -> np.ndarray:
    mean = share @ np.arange(1, BANDS + 1)
    return np.column_stack((np.ones(len(share)), mean, mean**2, share[:, :-1]))


def _ridge(x: np.ndarray, y: np.ndarray, l2: float) -> np.ndarray:
    return np.linalg.solve(x.T @ x + l2 * np.diag([1e-9] + [1.0] * (x.shape[1] - 1)), x.T @ y)


def fit(texts: list[str], bands: list[float], *, seed: int = 3) -> ReadingModel:
    """Fit the sentence models on two thirds of the documents, whose band every sentence inherits, and calibrate on the rest."""
    rng = np.random.default_rng(seed)
    y = np.asarray(bands, float)
    part = rng.random(len(texts)) < 2 / 3 if len(texts) > 8 else np.ones(len(texts), bool)
    train = np.flatnonzero(part)
    s = sentences([texts[i] for i in train.tolist()])
    label = y[train][s.doc] if len(s.doc) else np.zeros(0)
    # a band between two counts for both
    target = np.maximum(0, 1 - np.abs(label[:, None] - np.arange(1, BANDS + 1)[None, :]))
    models = []
    for index, row in (s.chars, s.words):
        by = np.argsort(row, kind="stable")
        rows = Rows(index[by], np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(s.doc))))).astype(np.int64))
        m = fit_logistic(rows, target, s.n_words / max(1.0, s.n_words.mean()) if len(s.doc) else None, epochs=4, rate=0.02, l2=1e-5, bits=BITS)
        models.append((m.weights.astype(np.float32), m.bias))
    # a word counts once a document
    by = np.lexsort((s.exact, s.doc[s.of]))
    d, h = s.doc[s.of][by], s.exact[by]
    new = np.concatenate((np.ones(min(1, len(h)), bool), (d[1:] != d[:-1]) | (h[1:] != h[:-1])))
    word, found = np.unique(h[new], return_counts=True)
    out = ReadingModel(models[0], models[1], word[found >= COMMON * len(train)], np.zeros(7), np.zeros(3), np.zeros(2), float(y.mean()) if len(y) else (1 + BANDS) / 2)
    held = np.flatnonzero(~part) if (~part).any() else train
    if len(held):
        share, neutral, _, _, _ = out.describe(sentences([texts[i] for i in held.tolist()]), len(held))
        out.calibrated = _ridge(_design(share), y[held], 0.3)
        out.neutral = _ridge(neutral, y[held], 0.3)
        out.lengths = _ridge(neutral[:, [0, 2]], y[held], 0.3)
    else:
        out.calibrated[0] = out.neutral[0] = out.lengths[0] = out.prior
    return out


def reading_levels(df: DataFrame, key: str, text: str, labels: DataFrame, label_key: str, band: str, keep: list[str], *, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(doc_id, *keep, level, band, shares, n_sentences) for every document with words.

    ``level`` runs from 1 to 5 as the human bands, ``band`` is the nearest of
    these and ``shares`` the distribution of the sentences. A document's label
    is the mean of its raters; null bands do not count. Null and blank texts
    have no sentence and a null level; texts are read whole; repeated rows are
    judged each; without any label every document gets the middle band.
    """
    mean = labels.where(F.col(band).isNotNull()).groupBy(F.col(label_key).cast("long").alias("key")).agg(F.avg(band).alias("mean_band"))
    # the labelled keys are chosen first, so that only their texts are looked up
    chosen = hash_sample(mean, ["key"], sample)
    labelled = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where("length(text) > 0").join(F.broadcast(chosen), "key")
    # the sizes come first, so that only what the bound allows is sent
    total, within = 0, {}
    for r in labelled.select("key", "mean_band", F.xxhash64("key").alias("h"), F.octet_length("text").alias("n")).orderBy("h", "key", "n").limit(2 * sample).collect():
        total += r.n
        if total <= sample_bytes:
            within[r.key] = r.mean_band
    wanted = df.sparkSession.createDataFrame(list(within.items()), "key long, mean_band double")
    texts = labelled.select("key", "text").join(F.broadcast(wanted), "key").orderBy("key", "text").limit(2 * sample).collect()
    shared = df.sparkSession.sparkContext.broadcast(fit([r.text for r in texts], [r.mean_band for r in texts]))
    kept = df.select(*keep).schema.fields
    names = ["doc_id", *keep, "level", "band", "shares", "n_sentences"]
    ddl = ", ".join(["doc_id long", *(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "level double, band int, shares array<double>, n_sentences int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            text = [t or "" for t in b.column(b.num_columns - 1).to_pylist()]
            parts = [m.levels(text[i:j]) for i, j in chunks(text)]
            level, share, count = (np.concatenate([x[k] for x in parts]) for k in range(3)) if parts else (np.zeros(0), np.zeros((0, BANDS)), np.zeros(0))
            none = count == 0
            band = np.where(none, 0, np.floor(np.nan_to_num(level) + 0.5)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(level, mask=none), pa.array(band, mask=none), pa.array(list(np.round(share, 4)), pa.list_(pa.float64())), pa.array(count.astype(np.int32))], names=names)

    return df.select(F.col(key).cast("long").alias("doc_id"), *keep, text).mapInArrow(run, ddl)
