"""Sequences cut into chunks, numbered, grouped and packed into blocks of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.session import bounded_batches, keep, shared_folder


def fixed_chunks(seqs: DataFrame, chunks: int, width_from: str = "seq", compat: bool = False) -> DataFrame:
    """Rows (seq_id, chunk_ix, length, chunk) of chunks of len / chunks characters; a shorter one may follow.

    width_from is the column whose length decides, as gaps may have been removed since. Sequences shorter than `chunks`
    have chunks of one character; with compat they fail instead. Null and empty sequences have none; repeated rows repeat theirs.
    """
    width = F.floor(F.length(width_from) / chunks).cast("int")
    if compat:
        width = F.when(width == 0, F.raise_error(F.lit("a sequence is shorter than the number of chunks"))).otherwise(width)
    cut = seqs.where(F.length("seq") > 0).withColumn("_w", F.greatest(F.lit(1), width))
    starts = F.sequence(F.lit(0), F.length("seq") - 1, F.col("_w"))
    return cut.select("seq_id", F.col("seq"), "_w", F.posexplode(starts).alias("chunk_ix", "_at")).select("seq_id", "chunk_ix", F.substring("seq", F.col("_at") + 1, F.col("_w")).alias("chunk")).select("seq_id", "chunk_ix", F.length("chunk").alias("length"), "chunk")


def dense_ids(rows: DataFrame, order: list[str], id_column: str = "id", parts: int | None = None) -> DataFrame:
    """Dense numbers from 0 in the order given, without one task that sorts everything.

    Rows are sorted over partitions by range; each partition's count is summed for those before it (a row a partition).
    Nulls come first; of equal rows any comes first.
    """
    ranged = (rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    ranged = keep(ranged)
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return ranged.join(F.broadcast(before), "_part").select((F.col("_before") + F.col("_row")).alias(id_column), *rows.columns)


def prefix_sums(rows: DataFrame, group: str, order: list[str], values: dict, start: int = 0, largest: bool = False) -> DataFrame:
    """rows with, for each name: column of values, the sum (or the largest) over the rows before in the group's order; `start` for the first.

    A group of any size is spread over tasks: rows are sorted by range, each partition's sums are added to those of the
    group's partitions before it (a row for each group and partition) and to the sums within the partition.
    """
    shared_folder(rows.sparkSession)
    ranged = rows.withColumns({f"_v_{k}": v for k, v in values.items()}).repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_part", F.spark_partition_id()).checkpoint()
    over = F.max if largest else F.sum
    put = (lambda a, b: F.greatest(a, b)) if largest else (lambda a, b: a + b)
    totals = ranged.groupBy(group, "_part").agg(*(over(f"_v_{k}").alias(f"_t_{k}") for k in values))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    moved = totals.select(F.col(group).alias("_group"), F.col("_part").alias("_p"), *(F.coalesce(over(f"_t_{k}").over(before), F.lit(start)).alias(f"_b_{k}") for k in values))
    within = Window.partitionBy("_part", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumns({f"_s_{k}": F.coalesce(over(f"_v_{k}").over(within), F.lit(start)) for k in values})
    joined = local.join(moved, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_group")))
    return joined.select(*rows.columns, *(put(F.col(f"_s_{k}"), F.col(f"_b_{k}")).cast("bigint").alias(k) for k in values))


#: Groups whose sizes are broadcast (some 50 MB); with more groups than that, that join shuffles.
BROADCAST_GROUPS = 1_000_000


def with_blocks(seqs: DataFrame, group: str, size: int, least: DataFrame | None = None) -> DataFrame:
    """seqs with block: sequences of a group dealt by seq_id into ceil(characters of the group / size) blocks.

    Groups differ in size without bound; blocks don't by much, and which block a sequence is in depends on no order.
    least (group, chars), a row a group at most, has the sizes of those groups' blocks where they are larger.
    """
    totals = seqs.groupBy(group).agg(F.sum(F.length("seq")).alias("_total"))
    if least is not None:
        totals = keep(totals.join(least.select(group, F.col("chars").alias("_least")), group, "left"))
    if totals.count() <= BROADCAST_GROUPS:  # else the sequences of a hot group meet in a shuffle by group
        totals = F.broadcast(totals)
    most = F.lit(size) if least is None else F.greatest(F.lit(size), "_least")
    return seqs.join(totals, group).withColumn("block", F.pmod("seq_id", F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("_total") / most)))).select(*seqs.columns, "block")


def stripe_groups(chunks: DataFrame) -> DataFrame:
    """All sequences' chunks with one number: chunk_ix, n, total length."""
    return chunks.groupBy("chunk_ix").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("total"))


def taxon_groups(seqs: DataFrame) -> DataFrame:
    """Sequences by group key: n, total length, complete ones."""
    from ..functions.columns import group_key, is_complete

    return seqs.groupBy(group_key(F.col("header")).alias("groupname")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("seq")).cast("bigint").alias("total"), F.sum(is_complete(F.col("header")).cast("bigint")).alias("n_complete"))


def pieces(texts: DataFrame, width: int = 4096) -> DataFrame:
    """(key, piece_ix, piece) of texts (key, text): a text of any length as pieces for read_at()."""
    import pyarrow as pa

    bounded_batches(texts.sparkSession)

    def cut(batches):
        for batch in batches:
            for key, text in zip(batch.column("key"), batch.column("text")):
                t = text.as_py() or ""
                for at in range(0, len(t), 256 * width):
                    some = [t[x : x + width] for x in range(at, min(len(t), at + 256 * width), width)]
                    yield pa.RecordBatch.from_arrays([pa.repeat(key, len(some)), pa.array(range(at // width, at // width + len(some)), pa.int64()), pa.array(some, pa.string())], names=["key", "piece_ix", "piece"])

    return texts.select("key", "text").mapInArrow(cut, f"key {dict(texts.dtypes)['key']}, piece_ix bigint, piece string")


#: Pieces asked for whose numbers are broadcast, so that others aren't shuffled; with more, all pieces are.
BROADCAST_PIECES = 1_000_000


def only_asked(cut: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of cut (key, piece_ix, ...) that asked names, where asked is small enough to be sent to where they are; else all."""
    wanted = asked.select("key", "piece_ix").distinct()
    return cut.join(F.broadcast(wanted), ["key", "piece_ix"], "left_semi") if wanted.limit(BROADCAST_PIECES + 1).count() <= BROADCAST_PIECES else cut


def read_at(places: DataFrame, cut: DataFrame, width: int = 4096) -> DataFrame:
    """places (key, at, n and others) with text: the n characters from `at` on of the texts that pieces() cut; less at a text's end, null outside.

    Random access: only the pieces asked for are shuffled, and a place gathers as many pieces as it spans. Equal places are
    read once and repeated.
    """
    names = places.columns
    different = places.groupBy(*names).agg(F.count(F.lit(1)).alias("_times"))
    first, last = F.floor(F.col("at") / width), F.floor((F.col("at") + F.greatest("n", F.lit(1)) - 1) / width)
    asked = different.withColumn("piece_ix", F.explode(F.sequence(first, last)))
    rows = asked.join(only_asked(cut, asked), ["key", "piece_ix"], "left")
    start, end = F.greatest(F.col("at") - F.col("piece_ix") * width, F.lit(0)), F.least(F.col("at") + F.col("n") - F.col("piece_ix") * width, F.lit(width))
    own = F.substring("piece", (start + 1).cast("int"), (end - start).cast("int"))
    ordered = F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("piece_ix", own.alias("s")))))
    joined = rows.groupBy(*names, "_times").agg(ordered.alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["s"]), "")
    return joined.select(*names, F.when((F.size("p") > 0) & ((F.col("n") == 0) | (text != "")), text).alias("text"), F.explode(F.sequence(F.lit(1).cast("bigint"), "_times")).alias("_time")).drop("_time")
