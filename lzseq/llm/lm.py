"""Language-model scores of texts.

A log-bilinear network predicts the class of the next token from the classes of those before it: their vectors, weighted
place by place, are summed and multiplied with every class's vector. It is trained on all training texts by telling tokens
from noise (noise-contrastive estimation), in numpy, by many tasks whose networks are averaged, and normalised over all classes when
it scores. A token's share of its class comes from counts over all training texts. The commonest words and the end are classes of their own; other words are
grouped by spelling, and spellings by the words that they stand near.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import remove
from .lookups import common, with_rest, written
from .textkit import LOWER, bounded_batches, by_text, in_parts, release, remainder, shared_folder, spread, texts_of, words_of

#: Common words with a class of their own, classes of other words, and spellings that words are told apart by.
HEADS, GROUPS, SPELLINGS = 128, 40, 1 << 14
#: Tokens before a token that it is predicted from, and numbers in a vector.
BEFORE, DIMENSION = 6, 24
#: What stands for a text's end among codes of words; blocks that counts of spellings are summed in.
END, BLOCKS = (1 << 16) - 1, 16
#: Tokens of a step, tokens that a task learns from at least, and steps of the round before.
BATCH, LEARNT, WARM = 2_048, 2_500_000, 300
#: Tokens whose contexts are in memory together.
AT_ONCE = 1 << 19
#: Words whose counts are broadcast, and their longest in bytes; those of others are joined.
MOST_COMMON, COMMON_BYTES = 300_000, 64
#: Bytes of texts looked at together, a text at least; tokens scored by one product.
TOGETHER, ROWS = 4 << 20, 4096


def spellings(words: pa.Array) -> np.ndarray:
    """A number below SPELLINGS of each word's first two and last three bytes."""
    words = words.cast(pa.large_binary())
    at = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    data = np.frombuffer(words.buffers()[2] or b"\0", np.uint8).astype(np.uint64)
    first, end = at[:-1], at[1:]
    h = np.zeros(len(first), np.uint64)
    for place, real in ((first, end > first), (first + 1, end > first + 1), (end - 3, end > first + 4), (end - 2, end > first + 3), (end - 1, end > first + 2)):
        h = h * np.uint64(257) + np.where(real, data[np.where(real, place, 0)] + np.uint64(1), np.uint64(0))
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SPELLINGS.bit_length() + 1)).astype(np.int64)


@dataclass
class Classes:
    """heads: words of the first classes, then comes the end's, then the groups of spellings."""

    heads: pa.Array
    group: np.ndarray

    @property
    def end(self) -> int:
        return len(self.heads)

    @property
    def size(self) -> int:
        return len(self.heads) + 1 + GROUPS

    def of(self, words: pa.Array) -> np.ndarray:
        found = pc.index_in(words.cast(pa.large_string()), self.heads.cast(pa.large_string())).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        return np.where(found >= 0, found, self.end + 1 + self.group[spellings(words)])


def coded(docs: DataFrame, heads: pa.Array) -> DataFrame:
    """codes: the words of all texts as 16-bit numbers, a head's own or len(heads) + the spelling's, each text followed by END; a row for some texts together."""

    def run(batches: Iterator[pa.RecordBatch]):
        own = Classes(heads, np.zeros(SPELLINGS, np.int64))
        for batch in batches:
            texts, rows = texts_of(batch, "text"), []
            for start, end in in_parts(texts, TOGETHER):
                known, index, ends = words_of(lowered(texts[start:end]))
                of_word = own.of(known)
                code = np.where(of_word < len(heads), of_word, len(heads) + spellings(known)).astype(np.uint16)
                out = np.full(len(index) + len(ends) - 1, END, np.uint16)
                out[np.arange(len(index)) + np.repeat(np.arange(len(ends) - 1), np.diff(ends))] = code[index]
                rows.append(out.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["codes"])
        release()

    bounded_batches(docs.sparkSession)
    return spread(docs.select("text")).mapInArrow(run, "codes binary")


def codes_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    return (np.frombuffer(x.as_py(), np.uint16) for x in batch.column("codes"))


def near(codes: DataFrame, n_heads: int) -> np.ndarray:
    """How often each spelling's words stand within four places of each head, in all texts. Tasks add up blocks of spellings, which are summed after a shuffle; a table of fixed size is gathered."""
    width = max(1, n_heads)
    block = SPELLINGS // BLOCKS

    def count(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(SPELLINGS * width, np.int64)
        for batch in batches:
            for whole in codes_of(batch):
                for start in range(0, len(whole), AT_ONCE):
                    c = whole[start : start + AT_ONCE + 4].astype(np.int64)
                    text = np.cumsum(c == END)
                    for d in range(1, min(5, len(c))):
                        a, b = c[:-d][:AT_ONCE], c[d:][:AT_ONCE]
                        same = (text[:-d][:AT_ONCE] == text[d:][:AT_ONCE]) & (a != END)
                        for own, other in ((a, b), (b, a)):
                            at = np.flatnonzero(same & (own >= n_heads) & (other < n_heads))
                            np.add.at(total, (own[at] - n_heads) * width + other[at], 1)
        yield rows_of(total)

    def add(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(SPELLINGS * width, np.int64)
        for batch in batches:
            for k, n in zip(batch.column("block").to_pylist(), batch.column("n")):
                total[k * block * width : (k + 1) * block * width] += np.frombuffer(n.as_py(), np.int64)
        yield rows_of(total)

    def rows_of(total: np.ndarray) -> pa.RecordBatch:
        some = [(k, x) for k, x in enumerate(np.split(total, BLOCKS)) if x.any()]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in some], pa.int32()), pa.array([x.tobytes() for _, x in some], pa.binary())], names=["block", "n"])

    out = np.zeros((BLOCKS, block * width), np.float32)
    schema = "block int, n binary"
    for k, n in codes.mapInArrow(count, schema).repartition(BLOCKS, "block").mapInArrow(add, schema).collect():
        out[k] = np.frombuffer(n, np.int64)
    return out.reshape(SPELLINGS, width)


def grouped(near: np.ndarray, rounds: int = 12) -> np.ndarray:
    """The group of each spelling by the heads near its words: k-means of these counts' directions. Spellings that stand near none are dealt out by number."""
    group = np.arange(SPELLINGS) % GROUPS
    weight = near.sum(1)
    seen = np.flatnonzero(weight > 0)
    if not len(seen):
        return group
    x = np.sqrt(near[seen])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    order = np.argsort(-weight[seen], kind="stable")
    centres = x[order[np.linspace(0, min(len(order), 8 * GROUPS) - 1, GROUPS).astype(int)]]
    for _ in range(rounds):
        at = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x * np.sqrt(weight[seen])[:, None])
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.maximum(size, 1e-9), centres)
    group[seen] = (x @ centres.T).argmax(1)
    return group


@dataclass
class LogBilinear:
    """before: for each place before a token the vector of each class there (the last class is what stands before a text); after, bias: of the class to predict."""

    before: np.ndarray
    after: np.ndarray
    bias: np.ndarray

    def scores(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log of the probability of each target class after its context (rows of classes, the nearest first)."""
        out = np.empty(len(target), np.float32)
        for k in range(0, len(target), ROWS):
            c, t = context[k : k + ROWS], target[k : k + ROWS]
            h = self.before[0][c[:, 0]]
            for i in range(1, c.shape[1]):
                h += self.before[i][c[:, i]]
            z = h @ self.after.T
            z += self.bias
            z -= z.max(1, keepdims=True)
            chosen = z[np.arange(len(t)), t]
            np.exp(z, out=z)
            out[k : k + ROWS] = chosen - np.log(z.sum(1))
        return out


def contexts(classes: np.ndarray, ends: np.ndarray, start: int) -> np.ndarray:
    """For each token the classes of the BEFORE tokens before it in its text, the nearest first; start where there is none."""
    n = len(classes)
    out = np.full((n, BEFORE), start, np.int32)
    place = np.arange(n) - np.repeat(ends[:-1], np.diff(ends))
    for i in range(BEFORE):
        has = np.flatnonzero(place > i)
        out[has, i] = classes[has - i - 1]
    return out


class Learner:
    """Noise-contrastive estimation: whether a class is the text's or one of `drawn` from noise (probabilities of all classes), which each batch shares."""

    def __init__(self, parameters: dict[str, np.ndarray], noise: np.ndarray, drawn: int = 64, rate: float = 0.01):
        self.p = {k: x.astype(np.float32) for k, x in parameters.items()}
        self.m, self.v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        self.drawn, self.rate, self.steps = drawn, rate, 0
        self.log_noise, self.upto = np.log(drawn * noise).astype(np.float32), np.cumsum(noise)[:-1]

    @staticmethod
    def start(size: int, noise: np.ndarray, seed: int = 5) -> dict[str, np.ndarray]:
        rng = np.random.default_rng(seed)
        return {"r": rng.normal(0, 0.1, (size + 1, DIMENSION)), "c": np.ones((BEFORE, DIMENSION)), "q": rng.normal(0, 0.1, (size, DIMENSION)), "b": np.log(noise)}

    def learn(self, x: np.ndarray, t: np.ndarray, rng: np.random.Generator, slower: float) -> None:
        """A step by a batch: contexts x (a row for each place before, the nearest first) of targets t."""
        p, size, n = self.p, len(self.p["b"]), len(t)
        other = np.searchsorted(self.upto, rng.random(self.drawn), "right")
        seen = (p["r"][None] * p["c"][:, None]).reshape(-1, DIMENSION)
        h = np.zeros((n, DIMENSION), np.float32)
        for i, row in enumerate(x):
            h += seen[i * (size + 1) : (i + 1) * (size + 1)].take(row, axis=0)
        q_t, q_o, bias = p["q"].take(t, axis=0), p["q"][other], p["b"] - self.log_noise
        g_real = 1 / (1 + np.exp(np.clip(np.einsum("ij,ij->i", h, q_t) + bias.take(t), -30, 30)))
        g_false = h @ q_o.T
        g_false += bias[other]
        np.clip(g_false, -30, 30, out=g_false)
        np.negative(g_false, out=g_false)
        np.exp(g_false, out=g_false)
        g_false += 1
        np.divide(-1, g_false, out=g_false)
        g_h = g_false @ q_o
        q_t *= g_real[:, None]
        g_h += q_t
        g = {"q": summed(t, g_real[:, None] * h, size), "b": np.bincount(t, g_real, size).astype(np.float32)}
        np.add.at(g["q"], other, g_false.T @ h)
        np.add.at(g["b"], other, g_false.sum(0))
        after = np.stack([summed(row, g_h, size + 1) for row in x])
        g["r"], g["c"] = np.einsum("ijk,ik->jk", after, p["c"]), np.einsum("ijk,jk->ik", after, p["r"])
        self.steps += 1
        for k in p:
            g[k] /= n
            self.m[k] += 0.1 * (g[k] - self.m[k])
            self.v[k] += 0.01 * (g[k] * g[k] - self.v[k])
            p[k] += self.rate * slower / (1 - 0.9**self.steps) * self.m[k] / (np.sqrt(self.v[k] / (1 - 0.99**self.steps)) + 1e-8)


def summed(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """The sum of the rows of each number below size."""
    order = np.argsort(at, kind="stable")
    n = np.bincount(at, minlength=size)
    used = np.flatnonzero(n)
    out = np.zeros((size, rows.shape[1]), np.float32)
    out[used] = np.add.reduceat(rows.take(order, axis=0), (np.cumsum(n) - n)[used], axis=0)
    return out


def network_of(p: dict[str, np.ndarray]) -> LogBilinear:
    f32 = np.float32
    return LogBilinear((p["r"][None] * p["c"][:, None]).astype(f32), np.ascontiguousarray(p["q"]).astype(f32), p["b"].astype(f32))


def train(codes: DataFrame, classes: Classes, noise: np.ndarray, tokens: int) -> LogBilinear:
    """A network of all texts (coded()). Tasks go through all tokens of theirs, from parameters that are the same for all, and what they come to is averaged, weighted by tokens.

    Each task has LEARNT tokens or more, so that it doesn't hang on few texts; where there are fewer in all, one task goes through them up to twenty
    times. With several tasks a first round over WARM batches of each finds the parameters that they begin from.
    """
    size, spark = classes.size, codes.sparkSession
    start = Learner.start(size, noise)
    if not tokens:
        return network_of(start)
    tasks = max(1, min(codes.rdd.getNumPartitions(), tokens // LEARNT))
    times = min(20, -(-LEARNT // tokens))
    expected = max(1, tokens * times // (tasks * BATCH))
    of_code = np.full(END + 1, classes.end, np.int16)
    heads = len(classes.heads)
    of_code[:heads] = np.arange(heads)
    of_code[heads : heads + SPELLINGS] = classes.end + 1 + classes.group
    shapes = {k: v.shape for k, v in start.items()}

    def unpacked(data: bytes) -> dict[str, np.ndarray]:
        return dict(zip(shapes, (x.reshape(s) for x, s in zip(np.split(np.frombuffer(data, np.float64), np.cumsum([np.prod(s) for s in shapes.values()])[:-1]), shapes.values()))))

    def pieces(sequence: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for a in range(0, len(sequence), AT_ONCE):
            before = min(a, BEFORE)
            part = sequence[a - before : a + AT_ONCE]
            ends = np.unique([0, *(np.flatnonzero(part == end) + 1), len(part)])
            yield np.ascontiguousarray(contexts(part, ends, size)[before:].T.astype(np.int16)), part[before:]

    end = classes.end
    for most in [WARM, None] if tasks > 1 else [None]:
        shared = spark.sparkContext.broadcast((start, noise, of_code))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, most=most):
            start, noise, of_code = shared.value
            learner, learnt = Learner(start, noise), 0
            parts = (of_code[c] for batch in batches for c in codes_of(batch) if len(c))
            for sequence in parts if times == 1 else [x for x in [np.concatenate([*parts, of_code[:0]])] if len(x) for _ in range(times)]:
                for x, target in pieces(sequence):
                    rng = np.random.default_rng([len(target), learner.steps])
                    order = rng.permutation(len(target))
                    for k in range(0, len(order) if learner.steps != most else 0, BATCH):
                        at = order[k : k + BATCH]
                        learner.learn(x[:, at], target[at], rng, 1.0 if most else max(0.02, min(1.0, 2 * (1 - learner.steps / (expected + 1)))))
                        learnt += len(at)
                        if learner.steps == most:
                            break
                if learner.steps == most:
                    break
            data = np.concatenate([learner.p[k].ravel() for k in shapes]).astype(np.float64).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([learnt], pa.int64()), pa.array([data], pa.binary())], names=["learnt", "data"])
            release()

        got = sorted((n, bytes(data)) for n, data in codes.coalesce(tasks).mapInArrow(run, "learnt bigint, data binary").collect() if n)
        whole, total = {k: np.zeros(s) for k, s in shapes.items()}, sum(n for n, _ in got)
        for n, data in got:
            for k, x in unpacked(data).items():
                whole[k] += x * (n / total)
        start = whole
        shared.destroy()
    return network_of(start)


@dataclass
class Model:
    """words, distinct: of all training tokens; class_words, class_distinct: of each class."""

    classes: Classes
    network: LogBilinear
    words: int
    distinct: int
    class_words: np.ndarray
    class_distinct: np.ndarray


def training(docs: DataFrame) -> DataFrame:
    return docs.where(remainder(7) != 2)


def lowered(texts: list[bytes]) -> list[bytes]:
    return [t.translate(LOWER) for t in texts]


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n over all texts, A-Z as a-z. Each batch is counted before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            known, index, _ = words_of(lowered(texts_of(batch, "text")))
            n = np.bincount(index, minlength=len(known))
            yield pa.RecordBatch.from_arrays([known.filter(pa.array(n > 0)).cast(pa.string()), pa.array(n[n > 0], pa.int64())], names=["word", "n"])
        release()

    bounded_batches(docs.sparkSession)
    return spread(docs.select("text")).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def class_totals(counts: DataFrame, classes: Classes) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and different words of each class. What each batch of words sums to is gathered."""

    def run(batches: Iterator[pa.RecordBatch]):
        n, v = np.zeros(classes.size, np.int64), np.zeros(classes.size, np.int64)
        for batch in batches:
            at = classes.of(batch.column("word"))
            np.add.at(n, at, batch.column("n").to_numpy())
            np.add.at(v, at, 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(classes.size)), pa.array(n), pa.array(v)], names=["class", "n", "v"])

    out = np.zeros((2, classes.size), np.int64)
    for c, n, v in counts.mapInArrow(run, "class bigint, n bigint, v bigint").groupBy("class").agg(F.sum("n"), F.sum("v")).collect():
        out[:, c] = n, v
    return out[0], out[1]


def fit(docs: DataFrame, counts: DataFrame, n_texts: int) -> Model:
    """A model of all training texts, of which counts has all words. Their words are written as numbers, which classes and network are fitted on; where there are none, every class is as likely."""
    heads = pa.array([r.word for r in counts.orderBy(F.desc("n"), "word").limit(HEADS).collect()], pa.large_string())
    spark, folder = docs.sparkSession, f"{shared_folder(docs.sparkSession)}/codes-{uuid.uuid4().hex}"
    coded(training(docs), heads).write.parquet(folder)
    codes = spark.read.parquet(folder)
    classes = Classes(heads, grouped(near(codes, len(heads))))
    n, v = class_totals(counts, classes)
    n[classes.end], v[classes.end] = n_texts, int(n_texts > 0)
    noise = (n + 1) / (n + 1).sum()
    network = train(codes, classes, noise, int(n.sum()))
    remove(spark, folder)
    return Model(classes, network, int(n.sum()), int(v.sum()), n, v)


def score(docs: DataFrame, model: Model, counts: DataFrame, most_common: int = MOST_COMMON) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score (logs to base 10) of every text, its end as a token too.

    base_score is of single tokens with one added to each count, and one for all unknown words. Counts of the
    most_common commonest words are broadcast; texts with others get those by a join, of which the rows before are
    kept as a table in the shared folder. Null and empty texts are an end alone; repeated rows repeat.
    """
    short, whole = common(counts.where(F.octet_length("word") <= COMMON_BYTES), most_common)
    table = short.toArrow().sort_by("word")
    whole = whole and table.num_rows == model.distinct - int(model.class_distinct[model.classes.end])
    session = docs.sparkSession.sparkContext.broadcast((model, table.column("word").combine_chunks().cast(pa.large_string()), table.column("n").to_numpy()))
    kinds = pa.list_(pa.struct([("key", pa.string()), ("times", pa.int64())]))

    def run(texts):
        model, common_words, n = session.value
        classes = model.classes
        below = np.log10(model.class_words + model.class_distinct + 1.0)
        out, rest = [], []
        for start, end in in_parts(texts, TOGETHER):
            known, index, ends = words_of(lowered(texts[start:end]))
            found = pc.index_in(known, common_words).fill_null(-1).to_numpy(zero_copy_only=False)
            count = np.where(found >= 0, n[found] if len(n) else 0, 0)
            kind = classes.of(known)
            # Each text's words, then its end.
            size = np.diff(ends)
            ends = ends + np.arange(len(ends))
            token = np.full(int(ends[-1]), len(known), np.int64)
            real = np.ones(len(token), bool)
            real[ends[1:] - 1] = False
            token[real] = index
            sequence = np.append(kind, classes.end)[token]
            above = np.log10(np.append(count, model.class_words[classes.end]) + 1.0)[token]
            network = model.network.scores(contexts(sequence, ends, classes.size), sequence).astype(np.float64) / np.log(10)
            sums = [np.add.reduceat(x, ends[:-1]) for x in (np.append(count, model.class_words[classes.end])[token] > 0, above, above + network - below[sequence])]
            out.append((size + 1, sums[0].astype(np.int64), sums[1] - (size + 1) * np.log10(model.words + model.distinct + 1.0), sums[2]))
            for a, b in zip(ends, ends[1:]):
                left = token[a : b - 1]
                words, times = np.unique(left[found[left] < 0], return_counts=True) if not whole else (left[:0], left[:0])
                rest.append(pa.StructArray.from_arrays([known.take(pa.array(words)).cast(pa.string()), pa.array(times.astype(np.int64))], names=["key", "times"]))
        columns = [np.concatenate(x) for x in zip(*out)] or [np.empty(0)] * 4
        left = pa.concat_arrays(rest) if rest else pa.array([], kinds.value_type)
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rest)]), pa.int32()), left).cast(kinds)
        return [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.float64()), lists]

    scored = by_text(docs, run, "n_tokens bigint, n_known bigint, base_score double, score double, rest array<struct<key: string, times: bigint>>")
    more = F.log10(F.col("n") + 1.0)
    return with_rest(scored, counts, "word", {"n_known": F.lit(1), "base_score": more, "score": more}, whole)


def scored_documents(docs: DataFrame, most_common: int = MOST_COMMON) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text, by a model of those whose id's crc32 modulo 7 isn't 2. A null id is neither learned from nor held out (null). Else as score; only doc_id and text are read."""
    counts = written(word_counts(training(docs)), "words")
    model = fit(docs, counts, training(docs).count())
    rows = score(docs, model, counts, most_common)
    return rows.select("doc_id", (remainder(7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.words).cast("bigint").alias("train_tokens"), "base_score", "score")
