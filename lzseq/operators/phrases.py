"""Phrase tables: limits, merging of short phrases, the grid of sources, kernel pieces, merging of parts. Rows (key, phrase_ix, pos, len)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.session import bounded_batches, spread
from .chunks import BROADCAST_GROUPS, prefix_sums


#: Phrases of a key from which on its sums are made over many tasks.
HOT_PHRASES = 2_000_000


def hot_key(rows: DataFrame, key: str = "key") -> bool:
    """Whether a key has so many rows that one task shouldn't sort them. Counts are combined before they are shuffled."""
    return (rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0) > HOT_PHRASES


def running(rows: DataFrame, values: dict[str, Column], order: str = "phrase_ix", key: str = "key", hot: bool | None = None) -> DataFrame:
    """rows with, for each name: column of values, the sum over the key's rows before; a hot key's rows stay spread over tasks."""
    if hot_key(rows, key) if hot is None else hot:
        return prefix_sums(rows, key, [order], values)
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumns({k: F.coalesce(F.sum(v).over(before), F.lit(0)).cast("bigint") for k, v in values.items()})


def effective(length: Column) -> Column:
    """Characters that a phrase stands for."""
    return F.greatest(length, F.lit(1).cast("bigint"))


def limits(phrases: DataFrame, hot: bool | None = None) -> DataFrame:
    """phrases with text_start and text_end, the running sums of their lengths. phrase_ix is unique within a key; a null length counts as a literal's."""
    rows = running(phrases, {"text_start": effective(F.col("len"))}, hot=hot)
    return rows.withColumn("text_end", F.col("text_start") + effective(F.col("len")))


def merge_short(phrases: DataFrame, context: int, hot: bool | None = None) -> DataFrame:
    """Runs of phrases of at most 2 * context characters become one literal phrase each; longer ones stay.

    A merged phrase keeps its last member's pos. The first phrase is literal if it was a copy, as nothing stands before
    it; where phrases have a source (another key that they copy from), none is. (key, phrase_ix, pos, len, is_literal,
    text_start, text_end[, source]).
    """
    hot = hot_key(phrases) if hot is None else hot
    apart = "source" in phrases.columns
    rows = phrases.withColumn("n", effective(F.col("len"))).withColumn("long", F.col("n") > 2 * context)
    if hot:
        rows = running(rows, {"nth": F.lit(1)}, hot=True).checkpoint()
        rows = rows.join(rows.select("key", (F.col("nth") + 1).alias("nth"), F.col("long").alias("previous")), ["key", "nth"], "left").drop("nth")
    else:
        rows = rows.withColumn("previous", F.lag("long").over(Window.partitionBy("key").orderBy("phrase_ix")))
    starts = F.coalesce(F.col("long") | F.col("previous"), F.lit(True))
    rows = running(rows.withColumn("starts", starts.cast("bigint")), {"run": F.col("starts"), "text_start": F.col("n")}, hot=hot)
    extra = [F.first("source").alias("source")] if apart else []
    out = rows.groupBy("key", (F.col("run") + F.col("starts") - 1).alias("phrase_ix")).agg(F.max_by("pos", "phrase_ix").alias("pos"), F.sum("n").alias("len"), (~F.bool_or("long")).alias("is_literal"), F.min_by("len", "phrase_ix").alias("first_len"), F.min("text_start").alias("text_start"), *extra)
    if not apart:
        out = out.withColumn("is_literal", F.col("is_literal") | ((F.col("phrase_ix") == 0) & (F.col("first_len") != 0)))
    return out.select("key", "phrase_ix", "pos", "len", "is_literal", "text_start", (F.col("text_start") + F.col("len")).alias("text_end"), *(["source"] if apart else []))


def grid(merged: DataFrame) -> DataFrame:
    """Copies as source intervals [x, x_end) of key with where they are copied to; in to_key, where phrases have a source."""
    apart = "source" in merged.columns
    return merged.where(~F.col("is_literal")).select(*([F.coalesce("source", "key").alias("key"), F.col("key").alias("to_key")] if apart else ["key"]), F.col("pos").alias("x"), (F.col("pos") + F.col("len")).alias("x_end"), "phrase_ix", "text_start")


def piece_length(context: int, edits: int = 0) -> Column:
    """Characters of a merged phrase's kernel piece; needs is_last."""
    n = F.col("len")
    last = F.when((n <= context) | F.col("is_literal"), n).otherwise(F.lit(context + 1 + edits + 1))
    inner = F.when((n < 2 * context + 2) | F.col("is_literal"), n).otherwise(F.lit(2 * context + edits + 1))
    return F.when(F.col("is_last"), last).otherwise(inner).cast("bigint")


def kernel_limits(merged: DataFrame, context: int, edits: int = 0, hot: bool | None = None) -> DataFrame:
    """merged with is_last, k_start and k_end: where each piece lies in its key's kernel text."""
    hot = hot_key(merged) if hot is None else hot
    if hot:
        last = merged.groupBy("key").agg(F.max("phrase_ix").alias("_last"))
        if last.count() <= BROADCAST_GROUPS:
            last = F.broadcast(last)
        rows = merged.join(last, "key").withColumn("is_last", F.col("phrase_ix") == F.col("_last")).drop("_last")
    else:
        rows = merged.withColumn("is_last", F.lead("phrase_ix").over(Window.partitionBy("key").orderBy("phrase_ix")).isNull())
    rows = running(rows.withColumn("k_len", piece_length(context, edits)), {"k_start": F.col("k_len")}, hot=hot)
    return rows.withColumn("k_end", F.col("k_start") + F.col("k_len")).drop("k_len")


def _cut(text: str, phrases: pa.StructArray, context: int, edits: int, separator: str) -> list[str]:
    """The pieces of one text's phrases, in their order: the whole phrase, or its ends around separators."""
    gap = separator * (edits + 1)
    n, start, end, literal, last = (phrases.field(k).to_numpy(zero_copy_only=False) for k in ("len", "text_start", "text_end", "is_literal", "is_last"))
    short = literal | np.where(last, n <= context, n < 2 * context + 2)
    out = []
    for a, b, whole, final in zip(start.tolist(), end.tolist(), short.tolist(), last.tolist()):
        out.append(text[a:b] if whole else text[a : a + context + 1] + gap if final else text[a : a + context] + gap + text[b - context : b])
    return out


def _gathered(limited: DataFrame, texts: DataFrame, fields: list[str]) -> DataFrame:
    """Each text beside its phrases in order, so that no other row carries it."""
    bounded_batches(texts.sparkSession)
    gathered = limited.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("phrase_ix", *(k for k in fields if k != "phrase_ix")))).alias("p"))
    return texts.select("key", "text").join(gathered, "key")


def kernel_pieces(limited: DataFrame, texts: DataFrame, context: int, edits: int = 0, separator: str = "$") -> DataFrame:
    """limited with piece: the whole phrase, or its ends around separators. texts: (key, text), each of a bounded block, one for a key."""
    types = dict(limited.dtypes)
    fields = [k for k in limited.columns if k != "key"]

    def run(batches):
        for batch in batches:
            for key, text, p in zip(batch.column("key"), batch.column("text"), batch.column("p")):
                some = p.values
                pieces = pa.array(_cut(text.as_py(), some, context, edits, separator), pa.string())
                yield pa.RecordBatch.from_arrays([pa.repeat(key, len(some)), *(some.field(k) for k in fields), pieces], names=["key", *fields, "piece"])

    schema = ", ".join(f"`{k}` {types[k]}" for k in ["key", *fields]) + ", piece string"
    return _gathered(limited, texts, fields).mapInArrow(run, schema).select(*limited.columns, "piece")


def kernels_of(limited: DataFrame, texts: DataFrame, context: int, edits: int = 0, separator: str = "$") -> DataFrame:
    """(key, kernel): kernel_texts() of kernel_pieces(), each text cut and put together in one row."""

    def run(batches):
        for batch in batches:
            made = ["".join(_cut(text.as_py(), p.values, context, edits, separator)) for text, p in zip(batch.column("text"), batch.column("p"))]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(made, pa.string())], names=["key", "kernel"])

    return _gathered(limited, texts, ["len", "text_start", "text_end", "is_literal", "is_last"]).mapInArrow(run, f"key {dict(limited.dtypes)['key']}, kernel string")


def kernel_texts(pieces: DataFrame) -> DataFrame:
    """The kernel text of each key."""
    ordered = F.array_sort(F.collect_list(F.struct("phrase_ix", "piece")))
    return pieces.groupBy("key").agg(F.array_join(F.transform(ordered, lambda x: x["piece"]), "").alias("kernel"))


def sampled(limited: DataFrame, every: int = 512) -> DataFrame:
    """Every so-manyth phrase."""
    return limited.where(F.col("phrase_ix") % every == 0)


def separator(texts: DataFrame, column: str = "text", candidates: tuple[int, ...] = (36, 35, *range(32, 127), *range(128, 255), *range(31, 0, -1))) -> DataFrame:
    """One row: the first candidate character that no text has."""
    def used(batches):
        for batch in batches:
            seen = set().union(*(x for x in batch.column(0).to_pylist() if x))
            yield pa.RecordBatch.from_arrays([pa.array(sorted(x for x in seen if x <= "\xff"), pa.string())], names=["c"])

    order = texts.sparkSession.range(1).select(F.posexplode(F.array(*(F.lit(chr(c)) for c in dict.fromkeys(candidates)))).alias("rank", "c"))
    used = spread(texts.select(column)).mapInArrow(used, "c string").distinct()
    return order.join(used, "c", "left_anti").agg(F.min_by("c", "rank").alias("separator"))


def statistics(phrases: DataFrame) -> DataFrame:
    """Phrases, literals, copies, characters and longest copy of each key; a null key is one, repeated rows count each time."""
    return phrases.groupBy("key").agg(
        F.count(F.lit(1)).alias("n_phrases"), F.sum((F.col("len") == 0).cast("bigint")).alias("n_literals"), F.sum((F.col("len") > 0).cast("bigint")).alias("n_copies"), F.sum(effective(F.col("len"))).alias("n_chars"), F.max("len").alias("longest")
    )


def merge_parts(phrases: DataFrame, parts: list[str] | str = "part") -> DataFrame:
    """Parses of parts as one parse of the parts' concatenation in their order: sources move by the characters before.

    Parts without phrases have no place. Rows (part, phrase_ix, pos, len) give (part, phrase_ix, pos, len) with the numbers of the whole. Totals are a row a part.
    """
    totals = phrases.groupBy("part").agg(F.sum(effective(F.col("len"))).alias("chars"), F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    moved = totals.select("part", F.coalesce(F.sum("chars").over(w), F.lit(0)).alias("by"), F.coalesce(F.sum("n").over(w), F.lit(0)).alias("by_ix"))
    rows = phrases.join(moved, "part")
    return rows.select("part", (F.col("phrase_ix") + F.col("by_ix")).alias("phrase_ix"), F.when(F.col("len") == 0, F.col("pos")).otherwise(F.col("pos") + F.col("by")).alias("pos"), "len")


def differences(limited: DataFrame, limit: str = "limit", order: str = "ix", key: str = "key", hot: bool | None = None) -> DataFrame:
    """limited with difference: each limit less the one before in its key, itself for the first. Limits rise; a hot key's rows stay spread over tasks."""
    if hot_key(limited, key) if hot is None else hot:
        before = prefix_sums(limited, key, [order], {"_before": F.col(limit)}, largest=True)
    else:
        before = limited.withColumn("_before", F.coalesce(F.lag(limit).over(Window.partitionBy(key).orderBy(order)), F.lit(0)))
    return before.withColumn("difference", (F.col(limit) - F.col("_before")).cast("bigint")).drop("_before")


def merge_limits(limited: DataFrame, every: int | None = None) -> DataFrame:
    """Limits of parts (part, ix, limit) as limits of the whole; where parts meet, the limit is given once.

    With every, only each so-manyth limit of the whole, as samples of the merged limits, with nth, its number there.
    """
    totals = limited.groupBy("part").agg(F.max("limit").alias("last"), F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    if every:
        moved = totals.select("part", F.coalesce(F.sum("last").over(w), F.lit(0)).alias("by"), F.coalesce(F.sum(F.col("n") - 1).over(w), F.lit(0)).alias("before"))
        whole = limited.join(moved, "part").select("part", "ix", (F.col("limit") + F.col("by")).alias("limit"), (F.col("ix") + F.col("before")).alias("nth"))
        return whole.where((F.col("nth") % every == 0) & ((F.col("ix") > 0) | (F.col("nth") == 0)))
    moved = totals.select("part", F.coalesce(F.sum("last").over(w), F.lit(0)).alias("by"), F.row_number().over(Window.orderBy("part")).alias("nth"))
    return limited.join(moved, "part").where((F.col("nth") == 1) | (F.col("ix") > 0)).select("part", "ix", (F.col("limit") + F.col("by")).alias("limit"))
