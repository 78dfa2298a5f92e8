"""Language of a text by a small convolutional network over bytes, trained and applied in numpy.

Bytes are embedded, filters of several widths run over them, each filter keeps its maximum within a window of fixed
length, and a softmax layer follows. A text's score is the mean of its windows' log probabilities, weighted by bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textkit import by_text, remainder, sample_texts

_letter = regex.compile(r"\p{L}").search
UNKNOWN = "und"


@dataclass
class ByteCnn:
    """embed (256, d); filters (width * d, f) for each width; out (all filters, classes)."""

    langs: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray
    window: int

    @property
    def widths(self) -> list[int]:
        return [len(f) // self.embed.shape[1] for f in self.filters]

    def packed(self) -> tuple[np.ndarray, np.ndarray, int]:
        """All filters as one matrix of the largest width, narrower ones with zeros at the end."""
        d, widest = self.embed.shape[1], max(self.widths)
        w = np.zeros((widest * d, sum(f.shape[1] for f in self.filters)), np.float32)
        at = 0
        for f in self.filters:
            w[: len(f), at : at + f.shape[1]] = f
            at += f.shape[1]
        return w, np.concatenate(self.biases).astype(np.float32), widest

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        """(n, classes) of (n, window) bytes."""
        w, bias, widest = self.packed()
        d = self.embed.shape[1]
        x = self.embed[windows]
        n, length = windows.shape
        s = x.strides
        seen = np.lib.stride_tricks.as_strided(x, (n, length - widest + 1, widest * d), (s[0], s[1], s[2])).reshape(-1, widest * d)
        h = (seen @ w).reshape(n, length - widest + 1, -1).max(axis=1)
        np.maximum(h := h + bias, 0, out=h)
        z = h @ self.out + self.out_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def predict(self, texts: list[bytes], block: int = 256) -> list[tuple[str, float]]:
        """(language, probability) of each text, over all of its windows; (und, 0.0) without a letter."""
        length = self.window
        total = np.zeros((len(texts), len(self.langs)))
        windows, owners, weights = np.full((block, length), 32, np.uint8), np.zeros(block, np.int64), np.zeros(block)
        k = 0

        def flush():
            nonlocal k
            if k:
                np.add.at(total, owners[:k], self.log_probabilities(windows[:k]) * weights[:k, None])
                windows[:] = 32
                k = 0

        if not self.langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        live = [bool(_letter(t.decode("utf-8", "replace"))) for t in texts]
        for i, t in enumerate(texts):
            if not live[i]:
                continue
            b = np.frombuffer(t, np.uint8)
            at = 0
            while at < len(b):
                n = min(block - k, -(-(len(b) - at) // length))
                part = b[at : at + n * length]
                windows[k : k + n].reshape(-1)[: len(part)] = part
                owners[k : k + n] = i
                weights[k : k + n] = length
                weights[k + n - 1] = len(part) - (n - 1) * length
                at += len(part)
                k += n
                if k == block:
                    flush()
        flush()
        out = []
        for i, t in enumerate(texts):
            if not live[i]:
                out.append((UNKNOWN, 0.0))
                continue
            z = total[i] / len(t)
            p = np.exp(z - z.max())
            p /= p.sum()
            out.append((self.langs[int(p.argmax())], float(p.max())))
        return out


def train(examples: list[tuple[bytes, str]], widths=(2, 3, 4), filters: int = 16, dim: int = 8, window: int = 128, steps: int = 500, batch: int = 96, rate: float = 0.004, seed: int = 11) -> ByteCnn:
    """Fits by Adam on random windows of the examples, every language as often. The same examples give the same weights.

    Without examples the network knows no language, and all texts are und.
    """
    rng = np.random.default_rng(seed)
    langs = sorted({y for _, y in examples})
    by_lang = [[np.frombuffer(t.ljust(window), np.uint8) for t, y in examples if y == lang] for lang in langs]
    widest = max(widths)
    p = {"e": rng.normal(0, 0.3, (256, dim))}
    for w in widths:
        p[f"w{w}"] = rng.normal(0, (2 / (w * dim)) ** 0.5, (w * dim, filters))
        p[f"b{w}"] = np.zeros(filters)
    p["o"], p["ob"] = rng.normal(0, 0.1, (filters * len(widths), len(langs))), np.zeros(len(langs))
    m, v = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}
    places = window - widest + 1
    rows = np.arange(batch)[:, None]
    for step in range(1, steps + 1 if len(langs) > 1 else 1):
        y = rng.integers(len(langs), size=batch)
        x = np.empty((batch, window), np.uint8)
        for i, c in enumerate(y):
            t = by_lang[c][rng.integers(len(by_lang[c]))]
            at = rng.integers(len(t) - window + 1)
            x[i] = t[at : at + window]
        emb = p["e"][x]
        pooled, where, seen = [], [], []
        for w in widths:
            view = np.lib.stride_tricks.sliding_window_view(emb, w, axis=1)[:, :places].transpose(0, 1, 3, 2).reshape(batch, places, w * dim)
            h = view @ p[f"w{w}"]
            at = h.argmax(axis=1)
            pooled.append(np.take_along_axis(h, at[:, None], 1)[:, 0] + p[f"b{w}"])
            where.append(at)
            seen.append(view)
        hidden = np.maximum(np.concatenate(pooled, 1), 0)
        z = hidden @ p["o"] + p["ob"]
        q = np.exp(z - z.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        q[np.arange(batch), y] -= 1
        q /= batch
        g = {"o": hidden.T @ q, "ob": q.sum(0), "e": np.zeros_like(p["e"])}
        back = (q @ p["o"].T) * (hidden > 0)
        for k, w in enumerate(widths):
            gh = back[:, k * filters : (k + 1) * filters]
            at = where[k]
            taken = seen[k][rows, at]  # (batch, filters, w * dim)
            g[f"w{w}"], g[f"b{w}"] = np.einsum("bfk,bf->kf", taken, gh), gh.sum(0)
            ge = (gh[:, :, None] * p[f"w{w}"].T[None]).reshape(batch, filters, w, dim)
            np.add.at(g["e"], x[rows[:, :, None], at[:, :, None] + np.arange(w)], ge)
        for k in p:
            m[k] += 0.1 * (g[k] - m[k])
            v[k] += 0.01 * (g[k] ** 2 - v[k])
            p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    f32 = np.float32
    return ByteCnn(langs, p["e"].astype(f32), [p[f"w{w}"].astype(f32) for w in widths], [p[f"b{w}"].astype(f32) for w in widths], p["o"].astype(f32), p["ob"].astype(f32), window)


def shares(counts: dict[str, int], limit: int) -> dict[str, int]:
    """How many texts of each language to take: equal parts of limit, what small languages leave going to larger ones; one at least."""
    out, left = {}, limit
    for i, (lang, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[lang] = max(1, min(n, left // (len(counts) - i)))
        left = max(0, left - out[lang])
    return out


def by_language(rows: DataFrame, limit: int) -> DataFrame:
    """doc_id, lang of about limit rows, drawn for each language by a hash of the id."""
    counts = dict(rows.groupBy("lang").count().collect())
    if not counts:
        return rows
    # A little more than the share by the hash's range first, so that few rows are ranked.
    parts = rows.sparkSession.createDataFrame([(lang, n, min(1.0, (2 * n + 64) / counts[lang])) for lang, n in shares(counts, limit).items()], "lang string, share int, most double")
    h = F.xxhash64("doc_id", F.lit(11))
    drawn = rows.join(F.broadcast(parts), "lang").where(F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53)) < F.col("most"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(h, "doc_id"))
    return drawn.withColumn("rank", rank).where("rank <= share").select("doc_id", "lang")


def fit(docs: DataFrame, limit: int = 3000) -> ByteCnn:
    """A network fitted on at most limit texts (whole ones, of each language as evenly as there are rows) with a lang whose crc32 remainder modulo 4 isn't 2; one that knows no language where there are none."""
    rows = docs.where(F.col("lang").isNotNull() & (remainder(4) != 2)).select("doc_id", "lang")
    return train(sample_texts(docs, by_language(rows, limit), "lang", limit))


def predict(docs: DataFrame, model: ByteCnn) -> DataFrame:
    """doc_id, lang_pred, score of every text; und and 0.0 for a null text or one without a letter, and for all where no language could be learned. Of languages that score the same the first in the order of their names is taken. Repeated rows repeat. Only doc_id and text are read."""

    def run(texts):
        got = model.predict(texts)
        return [pa.array([x[0] for x in got]), pa.array([x[1] for x in got], pa.float64())]

    return by_text(docs, run, "lang_pred string, score double")
