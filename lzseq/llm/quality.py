"""Quality by a factorisation machine over hashed words, structure statistics and metadata of the text.

The score of features x is bias + w.x + sum over pairs i < j of <v_i, v_j> x_i x_j. The pairs cost linear time, as they
are half of (sum of v_i x_i) squared less the sum of (v_i x_i) squared, factor by factor.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import LOWER, by_text, remainder, sample_texts, word_hashes

#: Hashed words have 2**WORD_BITS places; each statistic has BINS places after them.
WORD_BITS, BINS = 13, 16
STATISTICS = ("length", "words", "word length", "distinct words", "repeated next word", "distinct lines", "line length", "upper case", "symbols", "digits", "bars", "exclamations", "marks at word ends")
FEATURES = (1 << WORD_BITS) + BINS * len(STATISTICS)
_symbol, _upper, _digit, _mark = (np.zeros(256, bool) for _ in range(4))
_symbol[list(b"%$#&*@^~=+<>{}[]\\_")] = True
_upper[65:91] = True
_digit[48:58] = True
_mark[list(b"%$#&*!|")] = True


def statistics(text: bytes, words: np.ndarray) -> np.ndarray:
    """A number from 0 to 1 for each of STATISTICS."""
    b = np.frombuffer(text, np.uint8)
    n, k = max(1, len(b)), max(1, len(words))
    count = np.bincount(b, minlength=256)
    letters = max(1, int(count[65:91].sum() + count[97:123].sum() + count[128:].sum()))
    lines = [x for x in text.split(b"\n") if x.strip()]
    spaces = max(1, int(count[32] + count[10]))
    ends = int(np.count_nonzero(_mark[b[:-1]] & ((b[1:] == 32) | (b[1:] == 10)))) if len(b) > 1 else 0
    return np.array(
        [
            np.log1p(n) / 14,
            np.log1p(len(words)) / 12,
            min(1.0, (n - spaces) / k / 16),
            len(np.unique(words)) / k,
            float(np.count_nonzero(words[1:] == words[:-1])) / k,
            len(set(lines)) / max(1, len(lines)),
            min(1.0, n / max(1, len(lines)) / 2000),
            count[65:91].sum() / letters,
            min(1.0, 4 * count[_symbol].sum() / n),
            min(1.0, 4 * count[_digit].sum() / n),
            min(1.0, 8 * count[124] / n),
            min(1.0, 8 * count[33] / n),
            ends / spaces,
        ]
    )


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of a text: words' counts scaled to length 1, and each statistic's bin."""
    words = word_hashes(text.translate(LOWER))
    stats = statistics(text, words)
    bins = (1 << WORD_BITS) + BINS * np.arange(len(stats)) + np.minimum(BINS - 1, (np.clip(stats, 0, 1) * BINS).astype(np.int64))
    count = np.bincount((words >> np.uint64(64 - WORD_BITS)).astype(np.int64), minlength=1) if len(words) else np.zeros(1, np.int64)
    at = np.flatnonzero(count)
    x = count[at] / max(1e-9, np.sqrt(float((count[at].astype(np.float64) ** 2).sum())))
    return np.concatenate([at, bins]), np.concatenate([x, np.full(len(bins), 0.5)])


@dataclass
class FactorisationMachine:
    bias: float
    w: np.ndarray
    v: np.ndarray  # (features, factors)

    def raw(self, at: np.ndarray, x: np.ndarray) -> float:
        vx = self.v[at] * x[:, None]
        s = vx.sum(0)
        return self.bias + float(self.w[at] @ x) + 0.5 * float(s @ s - (vx**2).sum())

    def score(self, text: bytes) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(*features(text)), -30, 30))))


def train(examples: list[tuple[bytes, int]], factors: int = 6, epochs: int = 5, rate: float = 0.15, l2: float = 1e-4, seed: int = 5) -> FactorisationMachine:
    """AdaGrad over the examples, both classes weighing the same. The same examples give the same machine."""
    rng = np.random.default_rng(seed)
    fm = FactorisationMachine(0.0, np.zeros(FEATURES), rng.normal(0, 0.05, (FEATURES, factors)))
    gw, gv, gb = np.full(FEATURES, 1e-4), np.full((FEATURES, factors), 1e-4), 1e-4
    rows = [(*features(t), int(y > 0)) for t, y in examples]
    good = sum(y for *_, y in rows)
    share = (0.5 * len(rows) / max(1, len(rows) - good), 0.5 * len(rows) / max(1, good))
    for _ in range(epochs if rows else 0):
        for i in rng.permutation(len(rows)):
            at, x, y = rows[i]
            v = fm.v[at]
            s = (v * x[:, None]).sum(0)
            p = 1 / (1 + np.exp(-np.clip(fm.raw(at, x), -30, 30)))
            g = (p - y) * share[y]
            dw, dv = g * x + l2 * fm.w[at], g * (x[:, None] * s - v * (x**2)[:, None]) + l2 * v
            gb += g * g
            gw[at] += dw * dw
            gv[at] += dv * dv
            fm.bias -= rate * g / np.sqrt(gb)
            fm.w[at] -= rate * dw / np.sqrt(gw[at])
            fm.v[at] -= rate * dv / np.sqrt(gv[at])
    return fm


def fit(docs: DataFrame, labels: DataFrame, limit: int = 5000) -> FactorisationMachine:
    """A machine from at most limit labelled texts (whole ones) whose crc32 remainder modulo 3 isn't 1."""
    return train(sample_texts(docs, labels.where(remainder(3) != 1), "quality", limit))


def score(docs: DataFrame, model: FactorisationMachine) -> DataFrame:
    """doc_id and score from 0 to 1 of every text; null and empty texts have the statistics of no words. Only doc_id and text are read."""
    return by_text(docs, lambda texts: [pa.array([model.score(t) for t in texts], pa.float64())], "score double")


def predict(docs: DataFrame, model: FactorisationMachine, threshold: float = 0.5) -> DataFrame:
    """score() with held_out and predicted."""
    return score(docs, model).select("doc_id", (remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
