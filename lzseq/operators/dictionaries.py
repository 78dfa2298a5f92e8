"""Which sequences of a group make up its dictionary, and where they lie in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import group_key, is_complete

#: The share, the limit and the size under which a group's incomplete sequences all go in.
QUOTIENT, MOST, SMALL = 0.33, 1000, 15


def size_rule(n: Column, quotient: float = QUOTIENT, most: int = MOST) -> Column:
    """How many of n incomplete sequences go into a dictionary: all of fewer than SMALL, else the share, at most `most`."""
    return F.when(n < SMALL, n).otherwise(F.least(F.floor(n * F.lit(quotient)), F.lit(most))).cast("bigint")


def stripe_selection(chunks: DataFrame, reference_size: int, repeat_first: bool = False) -> DataFrame:
    """The first reference_size chunks of every stripe by seq_id: chunk_ix, dict_ord, seq_id, length, chunk. repeat_first puts the first in twice."""
    w = Window.partitionBy("chunk_ix").orderBy("seq_id")
    chosen = chunks.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= reference_size)
    out = chosen.select("chunk_ix", F.col("rank").alias("dict_ord"), "seq_id", "length", "chunk")
    if repeat_first:
        out = out.unionByName(out.where("dict_ord = 1").withColumn("dict_ord", F.lit(0)))
    return out


def taxon_selection(seqs: DataFrame, quotient: float = QUOTIENT, most: int = MOST) -> DataFrame:
    """Each group's dictionary: complete sequences by id (at most `most`), then the longest others by size_rule().

    Rows (groupname, dict_ord, seq_id, length, complete). Ranks are drawn over ids and lengths only, and the bound on them
    is plain, so that Spark drops what lies beyond it before the shuffle: a hot group sends `most` rows from a task.
    """
    rows = seqs.select(group_key(F.col("header")).alias("groupname"), "seq_id", F.length("seq").alias("length"), is_complete(F.col("header")).alias("complete"))
    n = rows.where(~F.col("complete")).groupBy("groupname").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("groupname", "complete").orderBy(F.when(F.col("complete"), 0).otherwise(-F.col("length")), "seq_id"))
    ranked = rows.withColumn("rank", rank).where(F.col("rank") <= max(most, SMALL)).join(n, "groupname", "left")
    chosen = ranked.where(F.when(F.col("complete"), F.col("rank") <= most).otherwise(F.col("rank") <= size_rule(F.col("n"), quotient, most)))
    order = F.row_number().over(Window.partitionBy("groupname").orderBy(F.col("complete").desc(), "rank"))
    return chosen.select("groupname", order.alias("dict_ord"), "seq_id", "length", "complete")


def offsets(selection: DataFrame, group: str = "groupname") -> DataFrame:
    """dict_start and dict_end of every sequence in its group's dictionary text."""
    end = F.sum("length").over(Window.partitionBy(group).orderBy("dict_ord").rowsBetween(Window.unboundedPreceding, 0))
    return selection.withColumn("dict_end", end.cast("bigint")).withColumn("dict_start", F.col("dict_end") - F.col("length"))


def texts(selection: DataFrame, seqs: DataFrame, group: str = "groupname") -> DataFrame:
    """The dictionary text of each group. The selection bounds what a group gathers."""
    parts = selection.join(seqs.select("seq_id", "seq"), "seq_id")
    ordered = F.array_sort(F.collect_list(F.struct("dict_ord", "seq")))
    return parts.groupBy(group).agg(F.array_join(F.transform(ordered, lambda x: x["seq"]), "").alias("text"))
