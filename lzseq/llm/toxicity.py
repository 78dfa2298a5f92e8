"""Toxicity by weak supervision.

Lexicon entries (words and word beginnings mined from labelled rows) and patterns are voters that say toxic, clean or
nothing. A generative label model estimates, without labels, how often each voter says what given the hidden class and
how voters depend on each other. A linear classifier learns the model's posterior and scores texts by itself.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import bounded_batches, by_text, mix64, remainder, sample_texts

_words = re.compile(r"[^\W_]+").findall
#: Lengths of word beginnings that can be lexicon entries.
STEMS = (4, 5)
#: Fixed seeds of the min-hashes that find copies: 8 bands of 2.
SEEDS = mix64(np.arange(1, 17, dtype=np.uint64))
#: Words that a worker remembers entries of.
REMEMBERED = 200_000


def units(word: str) -> list[str]:
    """A word's possible lexicon entries: itself and its beginnings, marked by a hyphen."""
    return [word, *(word[:n] + "-" for n in STEMS if len(word) > n)]


def surprise(k: float, n: float, share: float) -> float:
    """Twice the log likelihood ratio of k toxic among n texts against the share expected."""
    return 2 * sum(x * math.log(x / (n * p)) for x, p in ((k, share), (n - k, 1 - share)) if x > 0 and p > 0)


def copies(sets: list[set[str]], count: Counter, common: int) -> list[list[set[str]]]:
    """Groups of word sets that are near copies, by min-hashes of words that at most `common` sets hold. A group counts once as evidence."""
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first: dict[tuple, int] = {}
    for i, s in enumerate(sets):
        rare = np.array([zlib.crc32(w.encode()) for w in s if count[w] <= common], np.uint64)
        if len(rare):
            low = mix64(rare[:, None] + SEEDS).min(0).reshape(-1, 2)
            for band, pair in enumerate(map(tuple, low.tolist())):
                parent[root(i)] = root(first.setdefault((band, *pair), i))
    groups: dict[int, list[set[str]]] = {}
    for i, s in enumerate(sets):
        groups.setdefault(root(i), []).append(s)
    return list(groups.values())


def mine(texts: list[bytes], labels: list[int], most: int = 400, least: int = 3, odds: float = 2.5, surprising: float = 22.0) -> list[str]:
    """Entries in at least `least` toxic texts whose smoothed log odds of toxic against clean reach `odds`, and whose count is surprising, strongest first.

    surprising keeps out the many rare words that occur in a few toxic texts by chance.
    """
    seen: Counter = Counter()
    sets = [set(_words(t.decode("utf-8", "replace").lower())) for t in texts]
    toxic = copies([s for s, y in zip(sets, labels) if y], Counter(w for s in sets for w in s), max(2, len(sets) // 20))
    n = [len(sets) - sum(labels), len(toxic)]
    for group in toxic:
        seen.update({u for s in group for w in s for u in units(w)})
    seen = Counter({u: k for u, k in seen.items() if k >= least})
    clean: Counter = Counter()
    for s, y in zip(sets, labels):
        if not y:
            clean.update({u for w in s for u in units(w) if u in seen})
    scored = []
    for u, k in seen.items():
        lift = math.log((k + 0.5) / (n[1] + 1)) - math.log((clean[u] + 0.5) / (n[0] + 1))
        if lift >= odds and surprise(k, k + clean[u], n[1] / max(1, sum(n))) >= surprising:
            scored.append((-lift * math.sqrt(k), u))
    return [u for _, u in sorted(scored)[:most]]


@dataclass
class Voters:
    """Each lexicon entry votes toxic where it occurs. Patterns vote on the counts of entries and on the text's look."""

    lexicon: list[str]
    index: dict[str, int] = field(init=False)
    known: dict[str, tuple[int, ...]] = field(init=False, default_factory=dict)

    PATTERNS = ("no entry", "two entries", "dense", "sparse", "shouted entry", "entry in short text")

    def __post_init__(self):
        self.index = {u: i for i, u in enumerate(self.lexicon)}

    def __getstate__(self):
        return {"lexicon": self.lexicon}

    def __setstate__(self, state):
        self.__init__(state["lexicon"])

    def hits(self, text: bytes) -> tuple[list[int], int, int]:
        """(entries that occur, words that have an entry, all words)."""
        words = _words(text.decode("utf-8", "replace").lower())
        found: set[int] = set()
        known, index, n = self.known, self.index, 0
        for w in set(words):
            got = known.get(w)
            if got is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                got = tuple(index[u] for u in units(w) if u in index)
                if len(w) <= 40:
                    known[w] = got
            if got:
                n += 1
                found.update(got)
        return sorted(found), n, len(words)

    def votes(self, text: bytes) -> np.ndarray:
        """1 toxic, -1 clean, 0 no vote; lexicon entries first, then PATTERNS."""
        found, n, words = self.hits(text)
        v = np.zeros(len(self.lexicon) + len(self.PATTERNS), np.int8)
        v[found] = 1
        rate = n / max(1, words)
        shouted = n and text.isupper()
        v[len(self.lexicon) :] = (0 if n else -1, n > 1, rate > 0.02, -1 if rate < 0.0005 else 0, shouted, n > 0 and words < 60)
        return v

    def features(self, text: bytes) -> tuple[list[int], np.ndarray]:
        """What the linear classifier sees: entries that occur, and five numbers."""
        found, n, words = self.hits(text)
        rate = n / max(1, words)
        return found, np.array([math.log1p(n), float(n > 0), float(n > 1), min(1.0, 20 * rate), float(rate > 0.02)])


@dataclass
class LabelModel:
    """P(vote | class) of every voter and the share of toxic texts, by EM; voters that agree more than the class explains share their weight.

    Copies of one voter would outvote the rest before the class is known, so votes that correlate by `copied` share theirs from the start.
    """

    prior: float
    table: np.ndarray  # (voters, 2, 3): log P(vote - 1 .. 1 | class)
    weight: np.ndarray
    correlation: np.ndarray

    @staticmethod
    def fit(votes: np.ndarray, rounds: int = 25, strength: float = 0.3, copied: float = 0.9) -> LabelModel:
        n, k = votes.shape
        said = [(votes == x).astype(np.float64) for x in (-1, 0, 1)]
        rho = LabelModel._correlation(votes - votes.mean(0))
        weight = 1 / (1 + np.where(rho > copied, rho, 0).sum(1))
        q = np.where(votes @ weight > 0, 0.9, 0.05).astype(np.float64)
        table, prior = np.zeros((k, 2, 3)), 0.1
        for r in range(rounds):
            prior = float(np.clip(q.mean(), 0.005, 0.5))
            for c, w in enumerate((1 - q, q)):
                p = np.stack([w @ s for s in said], 1) + np.array([0.5, 1.0, 0.5])
                table[:, c] = np.log(p / p.sum(1, keepdims=True))
            if r in (4, 12):  # what is left of each vote when the class is known, and how voters share it
                expected = ((np.exp(table) * np.array([-1, 0, 1])).sum(2) @ np.stack([1 - q, q])).T
                rho = LabelModel._correlation(votes - expected)
                weight = 1 / (1 + np.where(rho > strength, rho, 0).sum(1))
            q = LabelModel(prior, table, weight, rho).posterior(votes)
        return LabelModel(prior, table, weight, rho)

    @staticmethod
    def _correlation(left: np.ndarray) -> np.ndarray:
        scale = np.sqrt((left**2).sum(0)) + 1e-9
        rho = np.abs(left.T @ left) / np.outer(scale, scale)
        np.fill_diagonal(rho, 0)
        return rho

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        log_odds = math.log(self.prior) - math.log(1 - self.prior)
        ratio = (self.table[:, 1] - self.table[:, 0]) * self.weight[:, None]
        z = log_odds + sum((votes == x) @ ratio[:, i] for i, x in enumerate((-1, 0, 1)))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class ToxicityModel:
    voters: Voters
    entry_weights: np.ndarray
    number_weights: np.ndarray
    bias: float

    def scores(self, texts: list[bytes]) -> list[float]:
        out = []
        for t in texts:
            found, numbers = self.voters.features(t)
            z = self.bias + float(self.entry_weights[found].sum()) + float(numbers @ self.number_weights)
            out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
        return out


def train_linear(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 400, rate: float = 0.1) -> np.ndarray:
    """Weights, the bias last, of a logistic regression on soft labels, both classes weighing half; Adam over all rows."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    share = float(np.clip(y.mean(), 0.02, 0.98))
    row = np.where(y > 0.5, 0.5 / share, 0.5 / (1 - share)) / len(y)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ ((p - y) * row) + l2 * np.append(w[:-1], 0)
        m += 0.1 * (g - m)
        v += 0.01 * (g**2 - v)
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return w


def train(examples: list[tuple[bytes, int]]) -> ToxicityModel:
    """From labelled texts: labels choose the lexicon; the label model and the classifier then see votes only."""
    texts, labels = [t for t, _ in examples], [int(y > 0) for _, y in examples]
    voters = Voters(mine(texts, labels))
    votes = np.stack([voters.votes(t) for t in texts]) if texts else np.zeros((0, len(Voters.PATTERNS)), np.int8)
    k = len(voters.lexicon)
    if not k:
        return ToxicityModel(voters, np.zeros(0), np.zeros(5), math.log(0.01))
    q = LabelModel.fit(votes).posterior(votes)
    x = np.zeros((len(texts), k + 5))
    for i, t in enumerate(texts):
        found, numbers = voters.features(t)
        x[i, found] = 1
        x[i, k:] = numbers
    w = train_linear(x, q)
    return ToxicityModel(voters, w[:k], w[k : k + 5], float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, limit: int = 6000) -> ToxicityModel:
    """A model from at most limit labelled texts (whole ones) whose crc32 remainder modulo 4 isn't 2."""
    return train(sample_texts(docs, labels.where(remainder(4) != 2), "toxic", limit))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id and score from 0 to 1 of every text. Null and empty texts get the score of a text without words. Only doc_id and text are read."""
    return by_text(docs, lambda texts: [pa.array(model.scores(texts), pa.float64())], "score double")


def predict(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """score() with held_out and predicted."""
    return score(docs, model).select("doc_id", (remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def acceptable(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """The documents, all columns, whose text scores below threshold. Null and empty texts score as a text without words does and stay; repeated rows stay or go together."""

    def low(texts: pa.Array) -> pa.Array:
        return pa.array([x < threshold for x in model.scores([t or b"" for t in texts.cast(pa.binary()).to_pylist()])], pa.bool_())

    bounded_batches(docs.sparkSession)
    return docs.where(F.arrow_udf(low, "boolean")("text"))
