"""A search structure over texts as tables: transformed texts in blocks with rank checkpoints and sampled places, and a directory that says which texts a pattern may be in.

A pattern's search goes from the directory (an equi-join on one of its parts) to the texts that may hold it, and there backward
over the transformed text, all patterns of a text at once; nothing else of the texts is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import keep, spread
from . import kernels
from .chunks import BROADCAST_GROUPS
from .parses import _batch, _slices, symbols

#: Rows of the transformed text in a block, between rank checkpoints, and text characters between places that are kept.
BLOCK, STEP, RATE = 65_536, 64, 16
#: Parts that the directory is made of have GRAM characters; of each WINDOW of them next to each other it has one, that with the least hash.
GRAM, WINDOW = 12, 8
#: Folders that saved tables are split into; a search reads those that it needs.
BUCKETS = 64
#: Patterns that are searched for in a text at once; more are dealt over tasks.
TOGETHER = 20_000

BLOCKS = "key {key}, block bigint, n bigint, symbols binary, codes binary, counts binary, marks binary, places binary"


def bucket_of(column: str):
    return F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int").alias("bucket")


def part_of(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of the directory that a part's hash is in, and its number there: of its lower bits, as least() likes the upper ones small."""
    return ((hashes >> np.uint64(32)) % np.uint64(BUCKETS)).astype(np.int32), (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)


def structure(text: bytes) -> dict[str, np.ndarray]:
    """symbols, codes of the transformed text (0 is the end), counts of each code before every STEP rows, marks of rows whose place is kept, places."""
    alphabet = np.unique(np.frombuffer(text, np.uint8))
    order = np.concatenate([[len(text)], kernels.suffix_array(text)]).astype(np.int64)  # the empty end comes first
    code = np.zeros(256, np.uint8)
    code[alphabet] = np.arange(1, len(alphabet) + 1)
    before = np.concatenate([[0], code[np.frombuffer(text, np.uint8)]]).astype(np.uint8)
    codes = before[order]
    kinds, steps = len(alphabet) + 1, -(-len(codes) // STEP)
    hot = np.bincount(np.arange(len(codes)) // STEP * kinds + codes, minlength=steps * kinds).reshape(steps, kinds)
    counts = np.concatenate([np.zeros((1, hot.shape[1]), np.int64), np.cumsum(hot, 0)[:-1]]) if len(hot) else hot
    marks = order % RATE == 0
    return {"symbols": alphabet, "codes": codes, "counts": counts.astype(np.int32), "marks": marks, "places": order[marks].astype(np.int32)}


def blocks(texts: DataFrame, column: str = "text") -> DataFrame:
    """The rows of BLOCKS of texts (key, text). Symbols are characters up to U+00FF, others raise; null and empty texts have none; keys are unique."""

    def run(batches):
        for batch in batches:
            for part in _slices(batch, [column]):
                out: dict[str, list] = {k: [] for k in ("block", "n", "symbols", "codes", "counts", "marks", "places")}
                rows = []
                for t in map(symbols, part.column(column).to_pylist()):
                    s = structure(t)
                    starts = range(0, len(s["codes"]), BLOCK)
                    kept = np.concatenate([[0], np.cumsum(s["marks"])])
                    for k, a in enumerate(starts):
                        b = min(a + BLOCK, len(s["codes"]))
                        out["block"].append(k)
                        out["n"].append(len(t))
                        out["symbols"].append(s["symbols"].tobytes())
                        out["codes"].append(s["codes"][a:b].tobytes())
                        out["counts"].append(s["counts"][a // STEP : -(-b // STEP)].tobytes())
                        out["marks"].append(np.packbits(s["marks"][a:b]).tobytes())
                        out["places"].append(s["places"][kept[a] : kept[b]].tobytes())
                    rows.append(len(starts))
                at = pa.array(np.repeat(np.arange(len(rows)), rows))
                yield pa.RecordBatch.from_arrays([part.column("key").take(at), *(pa.array(v, pa.int64() if k in ("block", "n") else pa.binary()) for k, v in out.items())], names=["key", *out])

    return spread(texts.where(F.length(column) > 0).select("key", column)).mapInArrow(run, BLOCKS.format(key=dict(texts.dtypes)["key"]))


def least(hashes: np.ndarray) -> np.ndarray:
    """The least of each WINDOW of hashes next to each other; of windows after each other that have the same one, once."""
    if len(hashes) < WINDOW:
        return hashes[:0]
    found, size = hashes, 1
    while size < WINDOW:  # the least of so many, and of those that begin by as many later
        more = min(size, WINDOW - size)
        found, size = np.minimum(found[:-more], found[more:]), size + more
    return found[np.append(True, found[1:] != found[:-1])]


def directory(texts: DataFrame, column: str = "text") -> DataFrame:
    """(key, part, grams) of texts: the hashes of the parts that stand for the text, as part_of() has them; a row for each text and bucket that has some. Every part of GRAM + WINDOW - 1 characters holds one of them."""

    def run(batches):
        for batch in batches:
            for some in _slices(batch, [column]):
                rows, parts, sizes, grams = [], [], [], []
                for r, t in enumerate(some.column(column).to_pylist()):
                    part, gram = part_of(least(kernels.window_hashes(t or "", GRAM)))
                    both = np.unique(part.astype(np.int64) << 32 | gram.view(np.uint32))
                    kinds, n = np.unique(both >> 32, return_counts=True)
                    rows.append(np.full(len(kinds), r))
                    parts.append(kinds)
                    sizes.append(n)
                    grams.append((both & 0xFFFFFFFF).astype(np.uint32).view(np.int32))
                offsets = np.append(0, np.cumsum(np.concatenate(sizes))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([some.column("key").take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(parts), pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(grams), pa.int32()))], names=["key", "part", "grams"])

    return spread(texts.select("key", column)).mapInArrow(run, f"key {dict(texts.dtypes)['key']}, part int, grams array<int>")


@dataclass
class Transformed:
    """One text's structure, put together from its blocks."""

    symbols: np.ndarray
    codes: np.ndarray
    counts: np.ndarray
    marks: np.ndarray
    places: np.ndarray

    def __post_init__(self):
        n = len(self.codes)
        padded = np.full(-(-(n + 1) // STEP) * STEP, 255, np.uint8)
        padded[:n] = self.codes
        self.lanes = padded.reshape(-1, STEP)
        total = np.bincount(self.codes, minlength=len(self.symbols) + 1)
        if len(self.counts) < len(self.lanes):
            self.counts = np.concatenate([self.counts, total[None].astype(np.int32)])
        self.first = np.cumsum(total) - total
        self.kept = np.cumsum(self.marks) - 1

    def rank(self, code: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How many rows before have the code."""
        at, rest = row // STEP, row % STEP
        return self.counts[at, code] + ((self.lanes[at] == code[:, None]) & (np.arange(STEP) < rest[:, None])).sum(1)

    def intervals(self, patterns: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the suffixes that begin with each pattern, backward, all patterns a character at a time."""
        code = np.zeros(256, np.int64)
        code[self.symbols] = np.arange(1, len(self.symbols) + 1)
        size = np.array([len(p) for p in patterns], np.int64)
        letters = code[np.frombuffer(b"".join(patterns), np.uint8)] if size.sum() else np.empty(0, np.int64)
        last = np.cumsum(size) - 1
        low, high = np.zeros(len(size), np.int64), np.full(len(size), len(self.codes), np.int64)
        live = np.flatnonzero(size > 0)
        high[size == 0] = 0
        step = 0
        while len(live):
            c = letters[last[live] - step]
            a = self.first[c] + self.rank(c, low[live])
            b = self.first[c] + self.rank(c, high[live])
            b = np.where(c > 0, b, a)  # a character that the text doesn't have
            low[live], high[live] = a, b
            step += 1
            live = live[(b > a) & (size[live] > step)]
        return low, np.maximum(low, high)

    def places_of(self, rows: np.ndarray) -> np.ndarray:
        """Text places of rows: back over the text to one that is kept."""
        out, at, live, steps = np.empty(len(rows), np.int64), rows.copy(), np.arange(len(rows)), 0
        while len(live):
            hit = self.marks[at[live]]
            done = live[hit]
            out[done] = self.places[self.kept[at[done]]] + steps
            live = live[~hit]
            c = self.codes[at[live]].astype(np.int64)
            at[live] = self.first[c] + self.rank(c, at[live])
            steps += 1
        return out


def assembled(rows: list[dict]) -> Transformed:
    """From a text's blocks in order."""
    alphabet = np.frombuffer(rows[0]["symbols"], np.uint8)
    joined = lambda k, kind: np.frombuffer(b"".join(r[k] for r in rows), kind)
    marks = np.concatenate([np.unpackbits(np.frombuffer(r["marks"], np.uint8), count=len(r["codes"])) for r in rows]).astype(bool)
    return Transformed(alphabet, joined("codes", np.uint8), joined("counts", np.int32).reshape(-1, len(alphabet) + 1), marks, joined("places", np.int32))


#: Different parts that patterns ask for whose numbers are sent to where the directory is read, so that no others are shuffled; with more, all are.
BROADCAST_GRAMS = 1_000_000


def candidates(directory: DataFrame, patterns: DataFrame) -> DataFrame:
    """(key, query_id, pattern) of the texts that may hold each pattern of GRAM + WINDOW - 1 characters or more; shorter ones have none here."""

    @F.arrow_udf("struct<part: int, gram: int>")
    def of_pattern(batch: pa.Array) -> pa.Array:
        part, gram = part_of(np.array([kernels.window_hashes(p[: GRAM + WINDOW - 1], GRAM).min() for p in batch.to_pylist()], np.uint64))
        return pa.StructArray.from_arrays([pa.array(part), pa.array(gram)], names=["part", "gram"])

    asked = patterns.where(F.length("pattern") >= GRAM + WINDOW - 1).select("query_id", "pattern", of_pattern("pattern").alias("x")).select("query_id", "pattern", "x.part", "x.gram")
    if "bucket" in directory.columns:
        some = [r[0] for r in asked.select("part").distinct().collect()]  # BUCKETS numbers at most
        directory = directory.where(F.col("bucket").isin(some)).drop("bucket")
    rows, different = directory.select("key", "part", F.explode("grams").alias("gram")), asked.select("part", "gram").distinct()
    if different.limit(BROADCAST_GRAMS + 1).count() <= BROADCAST_GRAMS:
        rows = rows.join(F.broadcast(different), ["part", "gram"], "left_semi")
    return asked.join(rows, ["part", "gram"]).select("key", "query_id", "pattern")


def located(blocks: DataFrame, directory: DataFrame, patterns: DataFrame) -> DataFrame:
    """(key, query_id, pos, m) of all places of the patterns (query_id, pattern; GRAM + WINDOW - 1 characters or more) in the texts.

    Only blocks of texts that may hold a pattern are joined, and, where the tables have buckets, only those folders are
    read. A text's patterns are searched for at most TOGETHER at a time; a text that very many may be in is
    sent to as many tasks. A repeated pattern is found under each of its ids.
    """
    found = candidates(directory, patterns).checkpoint()
    n = keep(found.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).cast("bigint").alias("parts")))
    dealt = found.join(n, "key").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")))
    if "bucket" in blocks.columns:
        some = [r[0] for r in n.select(bucket_of("key")).distinct().collect()]
        blocks = blocks.where(F.col("bucket").isin(some)).drop("bucket")
    key, kind = dict(blocks.dtypes)["key"], dict(patterns.dtypes)["query_id"]
    asked = dealt.groupBy("key", "part").agg(F.collect_list("query_id").alias("query_id"), F.collect_list("pattern").alias("pattern"))
    wanted = F.broadcast(n) if n.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS else n  # so blocks are shuffled once, to their patterns
    sent = blocks.join(wanted, "key").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).drop("parts")
    rows = sent.unionByName(asked, allowMissingColumns=True).repartition("key", "part").sortWithinPartitions("key", "part", F.col("block").asc_nulls_last())

    def run(batches: Iterator[pa.RecordBatch]):
        held: list[dict] = []
        for batch in batches:
            for r in range(batch.num_rows):
                if batch.column("block")[r].as_py() is not None:
                    if batch.column("block")[r].as_py() == 0:
                        held = []
                    held.append({c: batch.column(c)[r].as_py() for c in ("symbols", "codes", "counts", "marks", "places")})
                    continue
                if not held:
                    continue
                text, ids, texts = assembled(held), batch.column("query_id")[r].values, batch.column("pattern")[r].as_py()
                held = []
                low, high = text.intervals([p.encode("latin-1", "replace") if p.isascii() or max(p) <= "\xff" else b"" for p in texts])
                for a in range(0, len(low), 2_000):
                    size = (high - low)[a : a + 2_000]
                    if not size.sum():
                        continue
                    at = np.repeat(np.arange(a, a + len(size)), size)
                    pos = text.places_of(low[at] + np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size))
                    yield pa.RecordBatch.from_arrays([pa.repeat(batch.column("key")[r], len(at)), ids.take(pa.array(at)), pa.array(pos), pa.array(np.array([len(p) for p in texts], np.int64)[at])], names=["key", "query_id", "pos", "m"])

    names = ("key", "part", "block", "symbols", "codes", "counts", "marks", "places", "query_id", "pattern")
    return rows.select(*names).mapInArrow(run, f"key {key}, query_id {kind}, pos bigint, m bigint")
