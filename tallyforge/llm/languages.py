"""Natural language of prose by hashed byte 4-grams, fitted on the corpus.

Texts are labelled by function words and scripts; on these a
naive Bayes model of 4-grams is fitted, labels every segment
again and is fitted once more. Source code is a class of its own. Prose whose 4-grams are
rarer than those of any class is judged by function words and scripts, and is in
another language where these tell nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np

from tallyforge.llm.tokens import LOWER, U, chunks, mix, words

BITS = 16
CODE, OTHER = "code", "other"
#: Least segments of a class, least 4-grams of a segment and of a text that is judged.
LEAST_SEGMENTS, LEAST_SEGMENT, LEAST_TEXT = 8, 8, 16
#: Share of a 4-gram that was not seen, and how far below all texts of a class another language must lie (in units of a text of one 4-gram).
UNSEEN, APART = 2e-6, 5.0
#: Bins in which deviations from the mean are counted: the lowest, width, number; those beyond count in the outermost.
LOWEST, BIN, BINS = -896.0, 1 / 16, 1 << 14
#: Characters that are worked on at once.
PART = 1 << 17

#: Function words by which segments get their first label (fixed values).
SEEDS = {
    "en": "the and of is in to for when after with that as by on it if from into while because you are this",
    "de": "der die das und ist nicht ein eine mit dem den wird bei nach von auf des wenn sobald für zum nur im kann ich dabei",
    "fr": "le la les des et est un une dans du pour que par dès au sur jamais à ce ne pas cette je peux",
    "es": "el la los las y es un una en de que con del por si cuando para se al nunca no puedo este esta",
    "it": "il lo gli della che per con non una sono nel alla di è",
    "pt": "o os da do das dos em uma não para com que ao pela",
    "nl": "de het een en van is niet dat op te zijn met voor wordt bij",
    "sv": "och att det som en på är av för med inte den till ett",
    "pl": "i w na nie się z do jest że to przez jak dla oraz",
}
#: Scripts that stand for a language (fixed values).
SCRIPTS = {"ja": "[぀-ヿ]", "ko": "[가-힯]", "zh": "[一-鿿]", "ru": "[Ѐ-ӿ]", "ar": "[؀-ۿ]", "el": "[Ͱ-Ͽ]", "he": "[֐-׿]", "hi": "[ऀ-ॿ]"}
LABELS = sorted({*SEEDS, *SCRIPTS})
_OF = {w: [k for k, v in SEEDS.items() if w in v.split()] for v in SEEDS.values() for w in v.split()}
_SCRIPT = {k: re.compile(v) for k, v in SCRIPTS.items()}
_LETTERS = re.compile(r"[^\W\d_]+")

_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(97, 123), 32, 39, 44, 45, *range(128, 256)]] = True
_STOP = np.zeros(256, bool)
_STOP[[33, 46, 59, 63]] = True


def seed_language(text: str) -> str | None:
    """Language of a text by script or function words; none where too few are seen or two tie."""
    if not text.isascii():
        for k, script in _SCRIPT.items():
            n = len(script.findall(text))
            if n >= 4 and n * (1 if k in ("ja", "ko", "zh") else 2) > len(_LETTERS.findall(text)):
                return k
    count = Counter(_LETTERS.findall(text.lower()))
    score = Counter()
    for w in count.keys() & _OF.keys():
        for k in _OF[w]:
            score[k] += count[w]
    top = score.most_common(2)
    if not top or top[0][1] < 2 or top[0][1] < 0.06 * count.total() or len(top) > 1 and 1.3 * top[1][1] > top[0][1]:
        return None
    return top[0][0]


_PLAIN_LETTER = np.zeros(256, bool)
_PLAIN_LETTER[97:123] = True
_PLAIN_WORDS = [w for w in _OF if w.isascii()]
_PLAIN_HASH = words([w.encode() for w in _PLAIN_WORDS], _PLAIN_LETTER).hash
_BY_HASH = np.argsort(_PLAIN_HASH)
_PLAIN_HASH, _PLAIN_OF = _PLAIN_HASH[_BY_HASH], np.array([[k in _OF[_PLAIN_WORDS[i]] for k in SEEDS] for i in _BY_HASH.tolist()], float)


def seed_labels(texts: list[str]) -> np.ndarray:
    """Place in LABELS of the language that :func:`seed_language` gives each text, -1 for none; plain texts are looked at together."""
    out = np.array([-1 if t.isascii() or (k := seed_language(t)) is None else LABELS.index(k) for t in texts], np.int64)
    plain = np.array([i for i, t in enumerate(texts) if t.isascii()], np.int64)
    own = [texts[i] for i in plain.tolist()]
    for a, b in chunks(own, PART):
        w = words([t.encode().translate(LOWER) for t in own[a:b]], _PLAIN_LETTER)
        at = np.minimum(np.searchsorted(_PLAIN_HASH, w.hash), len(_PLAIN_HASH) - 1)
        hit = np.flatnonzero(_PLAIN_HASH[at] == w.hash)
        n = np.diff(w.first)
        row = np.repeat(np.arange(b - a), n)[hit]
        score = np.column_stack([np.bincount(row, x, b - a) for x in _PLAIN_OF[at[hit]].T])
        second, top = np.sort(score, axis=1)[:, -2:].T
        fine = (top >= 2) & (top >= 0.06 * n) & (1.3 * second <= top)
        out[plain[a:b][fine]] = np.array([LABELS.index(k) for k in SEEDS])[score.argmax(axis=1)[fine]]
    return out


@dataclass
class Segments:
    """4-grams of a batch: hash and segment of each, and for each segment its text."""

    gram: np.ndarray
    of: np.ndarray
    text: np.ndarray

    @classmethod
    def cut(cls, texts: list[str]) -> Segments:
        """Cut at line ends and stops; 4-grams of letters and the signs between words only, so that names and numbers do not count."""
        raw = [t.encode("utf-8", "replace").translate(LOWER) for t in texts]
        joined = b"\n".join(raw) + b"\n"
        b = np.frombuffer(joined, np.uint8)
        ends = np.cumsum(np.fromiter((len(x) + 1 for x in raw), np.int64, len(raw)))
        nxt = np.append(b[1:], 10)
        stop = (b == 10) | np.frombuffer(joined.translate(_STOP.tobytes()), bool) & ((nxt == 32) | (nxt == 10))
        if len(b) > 2:
            stop[2:] |= (b[2:] == 0x82) & (b[1:-1] == 0x80) & (b[:-2] == 0xE3)
        segment = np.concatenate((np.zeros(1, np.int32), np.cumsum(stop, dtype=np.int32)[:-1]))
        plain = np.frombuffer(joined.translate(_PLAIN.tobytes()), bool)
        if len(b) < 4:
            return cls(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        fine = plain[:-3] & plain[1:-2] & plain[2:-1] & plain[3:]
        at = np.flatnonzero(fine)
        gram = np.lib.stride_tricks.as_strided(b, (len(b) - 3, 4), (1, 1))[at].view(np.uint32).ravel().astype(U)
        # segments come in order, so they need not be sorted
        own = segment[at]
        new = np.concatenate((np.ones(min(1, len(own)), bool), own[1:] != own[:-1]))
        of = np.cumsum(new) - 1
        first = np.searchsorted(segment, own[new])
        return cls((mix(gram) >> U(64 - BITS)).astype(np.int64), of, np.searchsorted(ends, first, "right"))


def seeded(texts: list[str], code: list[str]) -> dict[str, np.ndarray]:
    """Number of each 4-gram in the texts of each of LABELS, as function words and scripts label them, and in code; number of segments of each label, and of all."""
    # a single segment often has words of several languages only, so all of a text get its label
    label = seed_labels(texts)
    m = len(LABELS) + 1
    grams, segments = np.zeros((1 << BITS, m)), np.zeros(m)
    for a, b in chunks(texts, PART):
        s = Segments.cut(texts[a:b])
        own = label[a:b][s.text]
        at = own[s.of] >= 0 if len(s.of) else np.zeros(0, bool)
        grams += np.bincount(s.gram[at] * m + own[s.of[at]], minlength=grams.size).reshape(grams.shape) if at.any() else 0
        segments += np.bincount(np.where(own < 0, m - 1, own), minlength=m)
    segments[-1] = segments.sum()
    for a, b in chunks(code, PART):
        grams[:, -1] += np.bincount(Segments.cut(code[a:b]).gram, minlength=1 << BITS)
    return {"grams": grams, "segments": segments}


def _logs(n: np.ndarray) -> np.ndarray:
    """Logs of the shares of 4-grams; what was not seen is as unlikely in a class of few segments as in one of many."""
    return np.log(n / np.maximum(n.sum(axis=0), 1) + UNSEEN).astype(np.float32)


@dataclass
class Languages:
    names: list[str]
    logs: np.ndarray  # logs[gram, class]
    mean: np.ndarray  # mean log of the 4-grams of a class; 0 where none were counted
    floor: np.ndarray  # lowest deviation of a text from it, times the root of its 4-grams

    @classmethod
    def fit(cls, texts: list[str], code: list[str]) -> Languages:
        """Fit on prose of any languages and on source code that are at hand; what is spread over tasks is fitted by the same steps, with sums over all tasks between them."""
        first = seeded(texts, code)
        model = cls.started(first)
        model = model.refined(first, model.relabelled(texts))
        return model.bounded(model.deviations(texts))

    @classmethod
    def started(cls, first: dict[str, np.ndarray]) -> Languages:
        """The model of the texts that :func:`seeded` could label."""
        seen, every = first["segments"][:-1], first["segments"][-1]
        used = [k for k, n in enumerate(seen) if n >= max(LEAST_SEGMENTS, 0.002 * every)]
        names = [*(LABELS[k] for k in used), CODE]
        return cls(names, _logs(first["grams"][:, [*used, len(LABELS)]]), np.zeros(len(names)), np.full(len(names), -np.inf))

    def relabelled(self, texts: list[str]) -> np.ndarray:
        """Number of each 4-gram in the segments of each language as this model labels them."""
        k = len(self.names)
        out = np.zeros((1 << BITS, k - 1))
        for a, b in chunks(texts, PART):
            s = Segments.cut(texts[a:b])
            best, n, _ = self._segments(s)
            fine = (best < k - 1) & (n >= LEAST_SEGMENT)
            at = fine[s.of] if len(s.of) else np.zeros(0, bool)
            out += np.bincount(s.gram[at] * (k - 1) + best[s.of[at]], minlength=out.size).reshape(out.shape) if at.any() else 0
        return out

    def refined(self, first: dict[str, np.ndarray], second: np.ndarray) -> Languages:
        """The model of all segments as :meth:`relabelled` counted them."""
        if not second.any():
            return self
        n = np.column_stack((second, first["grams"][:, -1]))
        logs = _logs(n)
        mean = (n * logs).sum(axis=0) / np.maximum(n.sum(axis=0), 1)
        mean[-1] = 0
        return Languages(self.names, logs, mean, self.floor.copy())

    def deviations(self, texts: list[str]) -> np.ndarray:
        """How many texts of each language deviate how far from its mean, by bins."""
        out = np.zeros((len(self.names), BINS))
        for a, b in chunks(texts, PART):
            k, quality, n = self._texts(texts[a:b])
            k, x = k[k >= 0], ((quality - self.mean[k]) * np.sqrt(n))[k >= 0]
            out += np.bincount(k * BINS + np.clip(((x - LOWEST) / BIN).astype(np.int64), 0, BINS - 1), minlength=out.size).reshape(out.shape)
        return out

    def bounded(self, far: np.ndarray) -> Languages:
        """With the floors that the counts of :meth:`deviations` tell."""
        floor = self.floor.copy()
        for i, n in enumerate(far[:-1]):
            if self.mean[i] and n.any():
                at = 0.0005 * (n.sum() - 1)
                low, high = np.searchsorted(np.cumsum(n), (np.floor(at), min(np.floor(at) + 1, n.sum() - 1)), "right")
                floor[i] = LOWEST + BIN * (low + 0.5 + (high - low) * (at - np.floor(at))) - APART
        return Languages(self.names, self.logs, self.mean, floor)

    def _segments(self, s: Segments) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best class of every segment, its number of 4-grams, and their log under that class."""
        m = len(s.text)
        if not m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        total = np.add.reduceat(self.logs[s.gram], np.searchsorted(s.of, np.arange(m)), axis=0)
        best = total.argmax(axis=1)
        return best, np.bincount(s.of, minlength=m), total[np.arange(m), best]

    def _texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s = Segments.cut(texts)
        best, n, log = self._segments(s)
        k = len(self.names)
        fine = (best < k - 1) & (n >= LEAST_SEGMENT)
        size = np.bincount(s.text[fine] * k + best[fine], n[fine], len(texts) * k).reshape(-1, k)
        every = size.sum(axis=1)
        quality = np.bincount(s.text[fine], log[fine], len(texts)) / np.maximum(every, 1)
        top = size.argmax(axis=1)
        top[every < LEAST_TEXT] = -1
        return top, quality, every

    def languages(self, texts: list[str]) -> list[str | None]:
        """Language of every text; none where there is too little prose."""
        if not texts:
            return []
        top, quality, n = self._texts(texts)
        far = (quality - self.mean[top]) * np.sqrt(n) < self.floor[top]
        # far from all that was fitted: new words of the language, or another one, as function words and scripts tell
        return [None if k < 0 else seed_language(t) or OTHER if x else self.names[k] for t, k, x in zip(texts, top.tolist(), far.tolist(), strict=True)]
