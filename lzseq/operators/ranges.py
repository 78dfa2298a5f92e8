"""Range joins by bins, and what copies bring about, to a fix point."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import shared_folder


#: How many times wider the bins of a class of interval lengths are than those of the class before.
WIDER = 16


def _length_class(start, end, bin_size: int):
    return F.greatest(F.lit(0), F.ceil(F.log((F.col(end) - F.col(start)) / bin_size) / math.log(WIDER))).cast("int")


def length_classes(intervals: DataFrame, start: str, end: str, bin_size: int) -> list[int]:
    """The classes of the intervals' lengths, for range_join(); a dozen where lengths are of every size."""
    return sorted(r[0] for r in intervals.where(F.col(end) > F.col(start)).select(_length_class(start, end, bin_size)).distinct().collect())


def range_join(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, keys: list[str], bin_size: int, classes: list[int] | None = None) -> DataFrame:
    """Points inside [start, end), equal keys: an equi-join on bins with the bounds checked after.

    An interval goes to each bin that it touches and a point to one, so no pair comes twice. Columns besides the keys
    must differ in name. bin_size near the usual interval length keeps both sides small. With classes
    (length_classes()), long intervals are in wider bins, so that each is in WIDER + 1 of them at most, however long it is, and a point
    is in one bin of each class. A bin in which very many points or intervals meet is split by adaptive execution, as either side of an inner join can be. Points and intervals with a
    null key or bound, and empty intervals, meet nothing; repeated rows meet each time.
    """
    real = intervals.where(F.col(end) > F.col(start))
    if classes is None or classes in ([], [0]):
        b = lambda c: F.floor(c / bin_size).cast("bigint")
        on, left, right = [*keys, "_bin"], points.withColumn("_bin", b(F.col(at))), real.withColumn("_bin", F.explode(F.sequence(b(F.col(start)), b(F.col(end) - 1))))
    else:
        width = F.lit(bin_size) * F.pow(F.lit(WIDER), F.col("_class"))
        b = lambda c: F.floor(c / width).cast("bigint")
        on = [*keys, "_class", "_bin"]
        left = points.withColumn("_class", F.explode(F.array(*map(F.lit, classes)))).withColumn("_bin", b(F.col(at)))
        right = real.withColumn("_class", _length_class(start, end, bin_size)).withColumn("_bin", F.explode(F.sequence(b(F.col(start)), b(F.col(end) - 1))))
    return left.join(right, on).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_class", "_bin")


def copies_of(occurrences: DataFrame, grid: DataFrame, bin_size: int = 4096, classes: list[int] | None = None) -> DataFrame:
    """Occurrences (key, query_id, pos, m) inside a copy's source, moved to the copy: as many rows as such copies. Repeated rows give repeated results."""
    to = "to_key" if "to_key" in grid.columns else "key"
    hit = range_join(occurrences, grid.select("key", F.col(to).alias("_to"), "x", "x_end", "text_start"), "pos", "x", "x_end", ["key"], bin_size, classes)
    return hit.where(F.col("pos") + F.col("m") <= F.col("x_end")).select(F.col("_to").alias("key"), "query_id", (F.col("text_start") + F.col("pos") - F.col("x")).alias("pos"), "m")


def closure(occurrences: DataFrame, grid: DataFrame, bin_size: int = 4096, most_rounds: int = 10_000) -> DataFrame:
    """Occurrences and all their copies, copies of copies included, once each.

    A round follows the last round's new places only and is checkpointed. Places grow with each copy, so it ends.
    Repeated occurrences count once; those with a null key or place have no copies.
    """
    shared_folder(occurrences.sparkSession)
    names = ["key", "query_id", "pos", "m"]
    parts = [occurrences.select(*names).distinct().checkpoint()]
    classes = length_classes(grid, "x", "x_end", bin_size)
    for _ in range(most_rounds):
        found = reduce(DataFrame.unionByName, parts)
        fresh = copies_of(parts[-1], grid, bin_size, classes).distinct().join(found, names, "left_anti").checkpoint()
        if fresh.isEmpty():
            return found
        if len(parts) == 16:  # keeps plans short
            parts = [found.checkpoint()]
        parts.append(fresh)
    raise RuntimeError("the copies form a cycle")
