"""Linear models on hashed features, fitted with numpy on a bounded sample."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import chain
from zlib import crc32

import numpy as np

BITS = 18


def hashed(features: list[str], bits: int = BITS) -> np.ndarray:
    """Distinct hashed numbers of feature strings; the hash is the same in every process."""
    mask = (1 << bits) - 1
    return np.array(list({crc32(x.encode("utf-8", "replace")) & mask for x in features}), np.int32)


def hashed_rows(features: list[list[str]], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Row and hashed number of every feature string of many rows, with those that come again; numbers as :func:`hashed` gives them."""
    flat = list(chain.from_iterable(features))
    raw = "\0".join(flat).encode("utf-8", "replace").split(b"\0")
    if len(raw) != len(flat):
        raw = [x.encode("utf-8", "replace") for x in flat]
    return np.repeat(np.arange(len(features)), [len(x) for x in features]), np.fromiter(map(crc32, raw), np.int64, len(flat)) & ((1 << bits) - 1)


@dataclass
class Rows:
    """Feature numbers of many rows, one after the other, and their values (1 where none are given)."""

    index: np.ndarray
    first: np.ndarray
    value: np.ndarray | None = None
    _numbered: tuple[np.ndarray, np.ndarray] | None = field(default=None, init=False, repr=False)

    @classmethod
    def of(cls, rows: list[np.ndarray], values: list[np.ndarray] | None = None) -> Rows:
        first = np.concatenate(([0], np.cumsum([len(x) for x in rows]))).astype(np.int64)
        return cls(np.concatenate([*rows, np.zeros(0, np.int32)]), first, None if values is None else np.concatenate([*values, np.zeros(0, np.float32)]))

    @classmethod
    def distinct(cls, row: np.ndarray, feature: np.ndarray, n: int, bits: int = BITS) -> Rows:
        """``n`` rows of the features that are given with their rows, each once."""
        key = np.unique(row << bits | feature)
        return cls((key & ((1 << bits) - 1)).astype(np.int32), np.concatenate(([0], np.cumsum(np.bincount(key >> bits, minlength=n)))))

    def __len__(self) -> int:
        return len(self.first) - 1

    def take(self, which: np.ndarray) -> Rows:
        """Some rows."""
        n = self.first[which + 1] - self.first[which]
        to = np.concatenate(([0], np.cumsum(n)))
        at = np.arange(to[-1]) + np.repeat(self.first[which] - to[:-1], n)
        return Rows(self.index[at], to, None if self.value is None else self.value[at])

    @classmethod
    def joined(cls, parts: list[Rows]) -> Rows:
        """The rows of all parts, one part after the other."""
        base = np.cumsum([0, *(p.first[-1] for p in parts)])
        first = np.concatenate([np.zeros(1, np.int64), *(p.first[1:] + b for p, b in zip(parts, base[:-1], strict=True))])
        value = None if any(p.value is None for p in parts) else np.concatenate([np.zeros(0, np.float32), *(p.value for p in parts)])
        return cls(np.concatenate([np.zeros(0, np.int32), *(p.index for p in parts)]), first, value)

    def numbered(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Features that are met, the frequent ones first, and every feature's place among them, so that what is looked up lies close together; made once."""
        if self._numbered is None:
            count = np.bincount(self.index, minlength=1 << bits)
            met = np.argsort(-count, kind="stable")[: np.count_nonzero(count)]
            place = np.zeros(1 << bits, np.int64)
            place[met] = np.arange(len(met))
            self._numbered = met, place[self.index]
        return self._numbered

    def row(self) -> np.ndarray:
        """The row of every feature."""
        return np.repeat(np.arange(len(self)), np.diff(self.first))

    def beside(self, other: Rows) -> Rows:
        """The features of both, row by row."""
        first = self.first + other.first
        index, value = np.empty(first[-1], np.int32), np.ones(first[-1], np.float32)
        for rows, before in ((self, other.first[:-1]), (other, self.first[1:])):
            at = np.arange(len(rows.index)) + np.repeat(before, np.diff(rows.first))
            index[at] = rows.index
            if rows.value is not None:
                value[at] = rows.value
        return Rows(index, first, value)


@dataclass
class Linear:
    """Weights of one or more labels: ``weights[feature, label]`` and ``bias[label]``."""

    weights: np.ndarray
    bias: np.ndarray
    #: Summed squares of the gradients that each weight and bias was fitted by, where these are kept.
    seen: np.ndarray | None = None
    bias_seen: np.ndarray | None = None

    def margin(self, rows: Rows) -> np.ndarray:
        row = rows.row()
        out = np.empty((len(rows), len(self.bias)))
        for k in range(len(self.bias)):
            w = self.weights[rows.index, k]
            out[:, k] = np.bincount(row, w if rows.value is None else w * rows.value, len(rows)) + self.bias[k]
        return out


def fit_logistic(rows: Rows, y: np.ndarray, weight: np.ndarray | None = None, *, epochs: int = 12, batch: int = 1024, rate: float = 0.08, l2: float = 1e-6, bits: int = BITS, seed: int = 7, among: np.ndarray | None = None, keep: bool = False, begun: dict | None = None) -> Linear:
    """Logistic regression, one label per column of ``y``, by AdaGrad on shuffled batches; ``weight`` is one per row, or per row and label; ``among`` are the rows to fit on (all by default); ``keep`` keeps the squared gradients.

    ``begun`` is kept between fits on the same rows: what the batches of the
    first fit's epochs hold, and how far each label was fitted, from where it is
    fitted on if its examples are the same.
    """
    y = (y[:, None] if y.ndim == 1 else y).astype(float)
    labels = y.shape[1]
    weight = np.ones(len(rows)) if weight is None else weight
    weight = np.repeat(weight[:, None], labels, axis=1) if weight.ndim == 1 else weight
    met, features = rows.numbered(bits)
    values, first, size = rows.value, rows.first.tolist(), np.diff(rows.first)
    w, seen = [np.zeros(len(met), np.float32) for _ in range(labels)], [np.full(len(met), 1e-6, np.float32) for _ in range(labels)]
    bias, bias_seen = np.zeros(labels), np.full(labels, 1e-6)
    rng = np.random.default_rng(seed)
    among = np.arange(len(rows)) if among is None else among
    batch = max(64, min(batch, len(among) // 24))  # small samples need as many steps
    done, examples = [0] * labels, [(y[among, k], weight[among, k]) for k in range(labels)]
    held = None if begun is None else begun.setdefault("batches", {})
    save = held is not None and not held
    for k in range(labels):
        if begun and k in begun and begun[k][0] <= epochs and all(map(np.array_equal, begun[k][1], examples[k])):
            done[k], _, w[k], seen[k], bias[k], bias_seen[k] = begun[k]
            w[k], seen[k] = w[k].copy(), seen[k].copy()
    for epoch in range(epochs if len(among) else 0):
        step = rate / (1 + 0.3 * epoch) * 4
        order = rng.permutation(among)
        due = [k for k in range(labels) if done[k] <= epoch]
        for at in range(0, len(order) if due else 0, batch):
            which = order[at : at + batch]
            if held and (epoch, at) in held:
                index, value, n, filled, start, used = held[epoch, at]
            else:
                spans = [slice(first[i], first[i + 1]) for i in which.tolist()]
                index, value, n = np.concatenate([features[x] for x in spans]), None if values is None else np.concatenate([values[x] for x in spans]), size[which]
                filled = np.flatnonzero(n)
                start = (np.cumsum(n) - n)[filled]
                own_met = np.zeros(len(met), bool)
                own_met[index] = True
                used = np.flatnonzero(own_met)
                if save:
                    held[epoch, at] = index, value, n, filled, start, used
            for k in due:
                x = w[k][index] if value is None else w[k][index] * value
                z = np.full(len(which), bias[k])
                if len(filled):
                    z[filled] += np.add.reduceat(x, start, dtype=float)
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[which, k]) * weight[which, k]
                slope = np.repeat(g, n) if value is None else np.repeat(g, n) * value
                own_w, own_seen = w[k][used], seen[k][used]
                own = np.bincount(index, slope, len(met))[used] / len(which) + l2 * own_w
                own_seen += own**2
                own_w -= step * own / np.sqrt(own_seen)
                seen[k][used], w[k][used] = own_seen, own_w
                total = g.mean()
                bias_seen[k] += total**2
                bias[k] -= step * total / np.sqrt(bias_seen[k])
    if begun is not None:
        begun.update({k: (epochs, examples[k], w[k], seen[k], bias[k], bias_seen[k]) for k in range(labels)})
    every_w, every_seen = np.zeros((1 << bits, labels), np.float32), np.full((1 << bits, labels), 1e-6, np.float32)
    for k in range(labels):
        every_w[met, k], every_seen[met, k] = w[k], seen[k]
    return Linear(every_w, bias, every_seen, bias_seen) if keep else Linear(every_w, bias)


def threshold(scores: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> float:
    """The score from which calling rows positive gives the best F1; halfway to the next score below."""
    weight = np.ones(len(y)) if weight is None else weight
    if not len(y) or not y.any():
        return 0.0
    by = np.argsort(-scores, kind="stable")
    s, hit = scores[by], (y[by] > 0) * weight[by]
    called, found = np.cumsum(weight[by]), np.cumsum(hit)
    f1 = 2 * found / (called + hit.sum())
    f1[:-1][s[1:] == s[:-1]] = -1  # ties are called together
    k = int(np.argmax(f1))
    return float((s[k] + s[k + 1]) / 2 if k + 1 < len(s) else s[k] - 1e-6)
