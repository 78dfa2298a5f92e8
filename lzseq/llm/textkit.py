"""Shared helpers: Arrow batches of texts, vectorised word hashing, labelled samples."""

from __future__ import annotations

import ctypes
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.session import bounded_batches, shared_folder, spread

__all__ = ["LOWER", "bounded_batches", "by_text", "in_parts", "joined", "mix64", "release", "remainder", "sample_texts", "shared_folder", "spread", "texts_of", "word_hashes", "words_of"]

U64 = np.uint64
WHITE = b" \t\n\x0b\x0c\r"
#: A-Z to a-z on bytes; other bytes, so every other letter in UTF-8, stay.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MULT = 0x9E3779B97F4A7C15
_INV = pow(_MULT, -1, 1 << 64)
_is_white = np.zeros(256, bool)
_is_white[list(WHITE)] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on an array of uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


#: One random odd 64-bit value for each byte, none for white space.
_VALUE = np.where(_is_white, U64(0), mix64(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95)) | U64(1))
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        with np.errstate(over="ignore"):
            for k, base in enumerate((_MULT, _INV)):
                steps = np.full(size, U64(base))
                steps[0] = 1
                _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


#: Bytes hashed at a time; long texts go in pieces cut at white space where there is any.
PIECE = 1 << 18


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ of a text, in order. A polynomial over byte values, mixed."""
    if len(text) > PIECE:
        out, at = [], 0
        while at < len(text):
            end = min(len(text), at + PIECE)
            if end < len(text):
                cut = max(text.rfind(bytes([w]), at, end) for w in WHITE)
                if cut <= at:
                    nexts = [x for x in (text.find(bytes([w]), end) for w in WHITE) if x >= 0]
                    cut = min(nexts, default=len(text))
                end = cut
            out.append(_hash_piece(text[at:end]))
            at = end
            while at < len(text) and text[at] in WHITE:
                at += 1
        return np.concatenate(out) if out else np.empty(0, U64)
    return _hash_piece(text)


def _hash_piece(text: bytes) -> np.ndarray:
    b = np.frombuffer(text, np.uint8)
    if not len(b):
        return np.empty(0, U64)
    word = ~_is_white[b]
    starts = word.copy()
    starts[1:] &= ~word[:-1]
    at = np.flatnonzero(starts)
    if not len(at):
        return np.empty(0, U64)
    power, inverse = _power_tables(len(b))
    with np.errstate(over="ignore"):
        return mix64(np.add.reduceat(_VALUE[b] * power[: len(b)], at) * inverse[at])


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The batch's texts as UTF-8 bytes; null is empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def release() -> None:
    """Gives memory that a task no longer needs back to the system; workers live on and would keep the most that any task had."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def by_text(docs: DataFrame, fn, schema: str, id_column: str = "doc_id", text_column: str = "text", with_id: bool = False) -> DataFrame:
    """mapInArrow over (id, text) alone, so other columns, whatever their names, are not read.

    fn takes a list of UTF-8 byte strings (null is empty), and with_id the list of ids after it, and returns the columns after the id.
    """

    def run(batches):
        for batch in batches:
            texts = texts_of(batch, "text")
            out = fn(texts, batch.column(0).to_pylist()) if with_id else fn(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(x if isinstance(x, pa.Array) else pa.array(x) for x in out)], names=names)
        release()

    bounded_batches(docs.sparkSession)
    names = [x.split()[0] for x in re.split(r",(?![^<]*>)", f"{id_column} bigint, {schema}")]
    return spread(docs.select(F.col(id_column).cast("bigint").alias(id_column), F.col(text_column).alias("text"))).mapInArrow(run, f"{id_column} bigint, {schema}")


def in_parts(texts: list[bytes], most: int) -> list[tuple[int, int]]:
    """Ranges of texts with together at most that many bytes, one text at least."""
    out, start = [], 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and (end == start or size + len(texts[end]) <= most):
            size += len(texts[end])
            end += 1
        out.append((start, end))
        start = end
    return out


def words_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(different words, index of each word in them, offsets of the texts' words) for the words [^\\x20\\x09-\\x0D]+ of all texts, in order."""
    cut = pc.ascii_split_whitespace(pa.array([t.decode("utf-8", "replace") for t in texts], pa.large_string()))
    words = cut.flatten().dictionary_encode()
    known, index, ends = words.dictionary, words.indices.to_numpy().astype(np.int64), cut.offsets.to_numpy().astype(np.int64)
    empty = pc.index(known, "").as_py() if len(known) else -1
    if empty >= 0:  # what stands before a leading and after a trailing white space
        real = index != empty
        ends = np.concatenate([[0], np.cumsum(real)])[ends]
        index = index[real]
    return known, index, ends


def joined(parts: pa.Array, index: np.ndarray, ends: np.ndarray) -> list[memoryview]:
    """For each range of index between neighbouring ends, the parts that it names one after the other. parts: binary."""
    rows = parts.cast(pa.large_binary()).take(pa.array(index))
    at = np.frombuffer(rows.buffers()[1], np.int64)[rows.offset : rows.offset + len(rows) + 1][ends].tolist() if len(rows) else [0] * len(ends)
    data = memoryview(rows.buffers()[2] or b"").cast("B") if len(rows) else memoryview(b"")
    return [data[a:b] for a, b in zip(at, at[1:])]


def remainder(modulus: int, id_column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % modulus


#: Bytes of texts that fitting takes to the driver at most.
SAMPLE_BYTES = 256 << 20


def sample_texts(docs: DataFrame, labelled: DataFrame, label: str, limit: int, order_seed: int = 7, most_bytes: int = SAMPLE_BYTES) -> list[tuple[bytes, object]]:
    """Up to limit labelled texts for fitting, as [(UTF-8 text, label)] in an order that only the ids decide.

    limit and most_bytes (the first texts within it, one at least) bound what the driver holds. The ids are chosen
    first, without texts; only the chosen texts are collected. Of several texts with one doc_id the smallest is taken.
    """
    ids = labelled.where(F.col(label).isNotNull()).select("doc_id", label).orderBy(F.xxhash64("doc_id", F.lit(order_seed)), "doc_id", label).limit(limit)
    chosen = ids.collect()
    if not chosen:
        return []
    spark = docs.sparkSession
    keys = spark.createDataFrame([(r[0], r[1], i) for i, r in enumerate(chosen)], f"doc_id bigint, y {dict(labelled.dtypes)[label]}, k int")
    text = F.coalesce(F.col("text"), F.lit(""))
    sizes = docs.select("doc_id", text.alias("text")).join(F.broadcast(keys), "doc_id").groupBy("k").agg(F.octet_length(F.min("text")).alias("size")).collect()
    total, within = 0, []
    for k, size in sorted(map(tuple, sizes)):  # the texts themselves are fetched for these alone
        total += size
        if within and total > most_bytes:
            break
        within.append(k)
    got = docs.select("doc_id", text.alias("text")).join(F.broadcast(keys.where(F.col("k").isin(within))), "doc_id").groupBy("k").agg(F.min("text"), F.min("y")).collect()
    return [(r[1].encode("utf-8", "replace"), r[2]) for r in sorted(got, key=lambda r: r[0])]
