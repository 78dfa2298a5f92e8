"""Suffixes of texts of any length in order, over many tasks, and what follows from it: common prefixes, the transform, longest matches.

Every place of a text is a row. Places are ranked by their first characters; then, round by round, those that share a rank are
told apart by the rank of the place as many characters on, which doubles the characters compared. A round ranks only
places that aren't settled. Ranks come from counts of different values, so a part that a text repeats very often is one
row of what is sorted.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.session import shared_folder, spread
from .chunks import prefix_sums

#: Characters that places are ranked by at first.
HEAD = 16
#: Places in a batch that a text is cut into.
TOGETHER = 65_536


def places(texts: DataFrame, head: int = HEAD) -> DataFrame:
    """(key, pos, head, before) of every place of texts (key, text): the characters from there on, `head` at most, and the one before (null at the start). Null and empty texts have none; keys are unique.

    Instead of whole texts, parts will do: (key, text, from, own), the part from a place on with as many places of its own, and at
    least head - 1 characters more and one less before where the text has them (before_first is that one).
    """
    parts = {"from", "own", "before_first"} <= set(texts.columns)

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                text = batch.column("text")[r].as_py() or ""
                first, own, before = (batch.column(c)[r].as_py() for c in ("from", "own", "before_first")) if parts else (0, len(text), None)
                for a in range(0, own, TOGETHER):
                    b = min(own, a + TOGETHER)
                    one = list(text[a - 1 : b - 1]) if a else [before, *text[: b - 1]]
                    yield pa.RecordBatch.from_arrays([pa.repeat(batch.column("key")[r], b - a), pa.array(range(first + a, first + b), pa.int64()), pa.array([text[i : i + head] for i in range(a, b)], pa.string()), pa.array(one, pa.string())], names=["key", "pos", "head", "before"])

    columns = ("key", "text", *(("from", "own", "before_first") if parts else ()))
    return spread(texts.select(*columns)).mapInArrow(run, f"key {dict(texts.dtypes)['key']}, pos bigint, head string, before string")


@dataclass
class Order:
    """base: places(); levels: (key, pos, rank) of all places by their first head, 2 head, 4 head ... characters, equal ones with one rank; the last has no equal ones."""

    head: int
    base: DataFrame
    levels: list[DataFrame]

    @property
    def ranks(self) -> DataFrame:
        """(key, rank, suffix): the order."""
        return self.levels[-1].select("key", "rank", F.col("pos").alias("suffix"))


def _table(rows: DataFrame, folder: str, name: str) -> DataFrame:
    rows.write.parquet(f"{folder}/{name}")
    return rows.sparkSession.read.parquet(f"{folder}/{name}")


def ordered(texts: DataFrame, head: int = HEAD, most_rounds: int = 40) -> Order:
    """The order of all suffixes of each text (a prefix comes before what it begins). The levels are tables in the shared folder: as many as the longest repeat, over head, has doublings."""
    spark = texts.sparkSession
    folder = f"{shared_folder(spark)}/suffixes-{uuid.uuid4().hex}"
    base = _table(places(texts, head), folder, "places")
    counts = base.groupBy("key", "head").agg(F.count(F.lit(1)).alias("n"))
    known = prefix_sums(counts, "key", ["head"], {"rank": F.col("n")})
    level = _table(base.join(known, ["key", "head"]).select("key", "pos", "rank", "n"), folder, "0")
    levels, width = [level.select("key", "pos", "rank")], head
    for k in range(1, most_rounds):
        if level.where("n > 1").isEmpty():
            return Order(head, base, levels)
        open_rows = level.where("n > 1").select("key", "pos", "rank")
        on = level.select("key", (F.col("pos") - width).alias("pos"), F.col("rank").alias("second"))
        pairs = open_rows.join(on, ["key", "pos"], "left").withColumn("second", F.coalesce("second", F.lit(-1).cast("bigint")))  # past the end comes first
        group = F.concat_ws("/", "key", F.col("rank").cast("string"))
        counts = pairs.groupBy("key", "rank", "second").agg(F.count(F.lit(1)).alias("n")).withColumn("of", group)
        known = prefix_sums(counts, "of", ["second"], {"by": F.col("n")}).drop("of")
        fresh = pairs.join(known, ["key", "rank", "second"]).select("key", "pos", (F.col("rank") + F.col("by")).alias("rank"), "n")
        level = _table(level.where("n = 1").unionByName(fresh), folder, str(k))
        levels.append(level.select("key", "pos", "rank"))
        width *= 2
    raise RuntimeError("a repeat is longer than any text")


def in_common(pairs: DataFrame, order: Order) -> DataFrame:
    """pairs (key, i, j, ...) of different places of a text with lcp, the characters that the suffixes there share. Pairs with a null i or j have 0.

    From the level of most characters down: where both places have one rank there, they share that many and go on behind.
    """
    names = pairs.columns
    rows = pairs.withColumn("_i", F.col("i")).withColumn("_j", F.col("j")).withColumn("lcp", F.lit(0).cast("bigint"))
    for k in range(len(order.levels) - 2, -1, -1):
        level, width = order.levels[k], order.head << k
        for end in "ij":
            rows = rows.join(level.select("key", F.col("pos").alias(f"_{end}"), F.col("rank").alias(f"_r{end}")), ["key", f"_{end}"], "left")
        step = F.when(F.col("_ri") == F.col("_rj"), width).otherwise(0)
        rows = rows.select(*names, *((F.col(c) + step).alias(c) for c in ("_i", "_j", "lcp")))
    for end in "ij":
        rows = rows.join(order.base.select("key", F.col("pos").alias(f"_{end}"), F.col("head").alias(f"_h{end}")), ["key", f"_{end}"], "left")
    same = lambda n: F.left("_hi", n) == F.left("_hj", n)
    shorter = F.least(F.length("_hi"), F.length("_hj"))
    rest = F.when(F.coalesce(shorter, F.lit(0)) > 0, F.size(F.filter(F.sequence(F.lit(1), shorter), same))).otherwise(0)
    return rows.select(*names, (F.col("lcp") + rest).cast("bigint").alias("lcp"))


def common_prefixes(order: Order) -> DataFrame:
    """(key, rank, lcp): what each suffix in order has in common with the one before; 0 for the first."""
    rows = order.levels[-1]
    before = rows.select("key", (F.col("rank") + 1).alias("rank"), F.col("pos").alias("j"))
    return in_common(rows.select("key", "rank", F.col("pos").alias("i")).join(before, ["key", "rank"], "left"), order).select("key", "rank", "lcp")


def transformed(order: Order, end: str = "\0") -> DataFrame:
    """(key, row, symbol) of the Burrows-Wheeler transform: row 0 is the empty suffix's, with the text's last character; the whole text's symbol is the end."""
    rows = order.levels[-1].join(order.base.select("key", "pos", "before"), ["key", "pos"])
    last = order.base.groupBy("key").agg(F.max_by(F.left("head", F.lit(1)), "pos").alias("symbol"))
    return rows.select("key", (F.col("rank") + 1).alias("row"), F.coalesce("before", F.lit(end)).alias("symbol")).unionByName(last.select("key", F.lit(0).cast("bigint").alias("row"), "symbol"))


def _marked(rows: DataFrame, marked: Column) -> tuple[DataFrame, DataFrame]:
    """For every row of an order the marked place nearest before it in rank, and after it: (key, rank, j) each; null where there is none."""
    by_rank = rows.withColumn("m", marked)
    top = rows.groupBy("key").agg(F.max("rank").alias("top"))
    turned = by_rank.join(top, "key").withColumn("turned", F.col("top") - F.col("rank"))
    known = by_rank.where("m").select("key", F.col("rank").alias("found"), F.col("pos").alias("j"))
    low = prefix_sums(by_rank.select("key", "rank", "m"), "key", ["rank"], {"found": F.when(F.col("m"), F.col("rank")).otherwise(-1)}, -1, largest=True)
    high = prefix_sums(turned.select("key", "rank", "m", "top", "turned"), "key", ["turned"], {"back": F.when(F.col("m"), F.col("turned")).otherwise(-1)}, -1, largest=True)
    high = high.select("key", "rank", F.when(F.col("back") >= 0, F.col("top") - F.col("back")).otherwise(-1).alias("found"))
    return tuple(x.join(known, ["key", "found"], "left").select("key", "rank", "j") for x in (low, high))


def matches(texts: DataFrame, head: int = HEAD, separator: str = "\1") -> DataFrame:
    """(key, at, len, source) of every place of texts (key, text, dictionary): the longest part from there that the dictionary has, and where (null where there is none).

    Text and dictionary are ordered together; the longest match of a place is with a suffix of the dictionary next to it
    in the order. Neither has the separator.
    """
    bad = texts.where(F.contains("text", F.lit(separator)) | F.contains("dictionary", F.lit(separator)))
    if not bad.isEmpty():
        raise ValueError("a text has the separator")
    n = texts.select("key", F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n"))
    order = ordered(texts.select("key", F.concat(F.coalesce("text", F.lit("")), F.lit(separator), F.coalesce("dictionary", F.lit(""))).alias("text")), head)
    rows = order.levels[-1].join(n, "key")
    sides = [in_common(rows.where("pos < n").select("key", "rank", F.col("pos").alias("i"), "n").join(side, ["key", "rank"]), order) for side in _marked(rows, F.col("pos") > F.col("n"))]
    both = sides[0].unionByName(sides[1])
    best = both.groupBy("key", F.col("i").alias("at")).agg(F.max("lcp").alias("len"), F.max_by(F.col("j") - F.col("n") - 1, "lcp").alias("source"))
    return best.select("key", "at", "len", F.when(F.col("len") > 0, F.col("source")).alias("source"))
