"""Benchmark items inside texts, with edits, by pieces and bit-parallel verification.

An item of m characters may be up to k = floor(rate * m) edits away. Cut into k + 1 pieces, one piece must occur exactly
(pigeonhole). An automaton finds all pieces of all items in one pass over a text; around each hit Myers' bit-parallel
algorithm computes the smallest edit distance of the item to any part of the text there.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import bounded_batches, shared_folder, spread, texts_of

#: Production parameters: edits for each character of an item; characters of items searched in one pass.
RATE, BLOCK_CHARS = 0.08, 1_000_000


def normalised(text: str) -> str:
    """Lower case, runs of white space as one space."""
    return " ".join(text.lower().split())


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces as even as can be, with their places; an item shorter than that has a piece for each character."""
    n = min(k + 1, len(item))
    cuts = [i * len(item) // n for i in range(n + 1)] if n else []
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def best_match(masks: dict[str, int], m: int, text: str, start: int, end: int, most: int) -> tuple[int, int] | None:
    """(distance, end) of the closest part of text[start:end] to a pattern of m characters, the first of the closest; None beyond `most` edits.

    masks has for each character of the pattern the places where it stands, as bits.
    """
    full, top = (1 << m) - 1, 1 << m - 1
    positive, negative, score = full, 0, m
    best, at = most + 1, -1
    get = masks.get
    for i in range(start, end):
        eq = get(text[i], 0)
        xv = eq | negative
        xh = (((eq & positive) + positive) ^ positive) | eq
        ph = negative | ~(xh | positive) & full
        mh = positive & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full  # a match may start anywhere: the first row stays 0
        positive = (mh << 1 & full) | ~(xv | ph) & full
        negative = ph & xv
        if score < best:
            best, at = score, i + 1
            if not score:
                break
    return (best, at) if at >= 0 else None


@dataclass
class Items:
    """A block of the benchmark, ready for searching. Items of one normalised text are searched once."""

    rows: list[tuple[int, str]]  # (item_id, text)
    rate: float = RATE

    def __post_init__(self):
        ids = defaultdict(list)
        for item_id, text in self.rows:
            ids[normalised(text or "")].append(item_id)
        ids.pop("", None)
        self.texts = sorted(ids)
        self.ids = [sorted(ids[t], key=lambda i: (i is None, i)) for t in self.texts]
        self.budget = [int(self.rate * len(t)) for t in self.texts]
        places = defaultdict(list)
        for i, t in enumerate(self.texts):
            for at, piece in pieces(t, self.budget[i]):
                places[piece].append((i, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()
        self.masks: list[dict[str, int] | None] = [None] * len(self.texts)

    def __getstate__(self):
        return {"rows": self.rows, "rate": self.rate}

    def __setstate__(self, state):
        self.__init__(**state)

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, end in the normalised text, budget) of the closest place of every item within its budget."""
        text = normalised(text)
        if not self.texts:
            return []
        windows: dict[int, list[list[int]]] = {}
        for end, (size, where) in self.automaton.iter(text):
            first = end + 1 - size
            for i, at in where:
                k = self.budget[i]
                a, b = max(0, first - at - k), min(len(text), first - at + len(self.texts[i]) + k)
                mine = windows.setdefault(i, [])
                if mine and a <= mine[-1][1]:  # hits come by their ends, so a window starts near or after the last one
                    mine[-1][0] = min(mine[-1][0], a)
                    mine[-1][1] = max(mine[-1][1], b)
                else:
                    mine.append([a, b])
        out = []
        for i, mine in sorted(windows.items()):
            item, k = self.texts[i], self.budget[i]
            if (masks := self.masks[i]) is None:
                masks = self.masks[i] = {}
                for j, c in enumerate(item):
                    masks[c] = masks.get(c, 0) | 1 << j
            best = None
            for a, b in mine:
                if k:
                    got = best_match(masks, len(item), text, a, b, k)
                else:
                    at = text.find(item, a, b)
                    got = (0, at + len(item)) if at >= 0 else None
                if got and (best is None or got[0] < best[0]):
                    best = got
            if best:
                out += [(item_id, *best, k) for item_id in self.ids[i]]
        return out


def blocks(benchmark: DataFrame, most: int = BLOCK_CHARS, rate: float = RATE):
    """The benchmark's items in blocks of at most `most` characters (one item at least), fetched one partition at a time."""
    rows, size = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        if rows and size + len(r[1] or "") > most:
            yield Items(rows, rate)
            rows, size = [], 0
        rows.append((r[0], r[1] or ""))
        size += len(rows[-1][1])
    yield Items(rows, rate)


SCHEMA = "doc_id bigint, item_id bigint, distance int, end bigint, budget int"


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row for each document and benchmark item that it holds: doc_id, item_id, distance, end (in the normalised text), budget.

    No shuffle. Each block of the benchmark costs a pass over the texts, so what tasks hold doesn't grow with the
    benchmark. Null and empty texts and items match nothing, a null item_id stays null; an item too short for an edit must occur exactly. Repeated
    rows repeat their matches. Only doc_id and text, item_id and text are read.
    """

    def search(items):
        def run(batches):
            for batch in batches:
                rows = []
                for doc_id, t in zip(batch.column(0).to_pylist(), texts_of(batch)):
                    rows += [(doc_id, *x) for x in items.find(t.decode("utf-8", "replace"))]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()))], names=["doc_id", "item_id", "distance", "end", "budget"])

        return spread(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).mapInArrow(run, SCHEMA)

    bounded_batches(docs.sparkSession)
    rest = blocks(benchmark, block_chars, rate)
    out, following = search(next(rest)), next(rest, None)
    if following is None:
        return out
    shared_folder(docs.sparkSession)
    out = out.checkpoint()  # so that the driver, too, has one block at a time
    while following is not None:
        out, following = out.unionByName(search(following).checkpoint()), next(rest, None)
    return out


#: Digests of up to so many texts are broadcast (some 100 MB); beyond it, that join shuffles.
BROADCAST_DIGESTS = 1_000_000


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns.

    A benchmark of one block is a filter. Of more, each block is a pass that keeps the digests of texts it found
    something in, so that a task and the driver have one block at a time. Null and empty texts hold nothing and stay;
    what holds for a text holds for all rows with it.
    """

    def flagged(items):
        @F.arrow_udf("boolean")
        def held(texts: pa.Array) -> pa.Array:
            return pa.array([bool(t) and bool(items.find(t)) for t in texts.to_pylist()], pa.bool_())

        return held(F.col("text"))

    bounded_batches(docs.sparkSession)
    rest = blocks(benchmark, block_chars, rate)
    first, following = next(rest), next(rest, None)
    if following is None:
        return docs.where(~flagged(first))
    shared_folder(docs.sparkSession)
    digest = F.md5(F.col("text").cast("binary"))
    parts, items = [], first
    while items is not None:
        parts.append(docs.select("text").where(flagged(items)).select(digest.alias("digest")).distinct().checkpoint())
        items, following = following, next(rest, None)
    gone = reduce(DataFrame.unionByName, parts).distinct().checkpoint()
    if gone.count() <= BROADCAST_DIGESTS:
        gone = F.broadcast(gone)
    return docs.join(gone, F.coalesce(digest, F.lit("")) == gone["digest"], "left_anti")
