"""Alignment records: SAM and BLAST tables parsed, rewritten to sequence coordinates and formatted; FASTA metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import cigar_aligned, first_token, mapped, unmapped_record
from ..functions.session import exists, shared_folder
from .ranges import range_join

SAM_FIELDS = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")
_SAM_TYPES = {"flag": "int", "pos": "bigint", "mapq": "int", "pnext": "bigint", "tlen": "bigint"}
BLAST_FIELDS = ("qseqid", "sseqid", "pident", "length", "mismatch", "gapopen", "qstart", "qend", "sstart", "send", "evalue", "bitscore")
_BLAST_TYPES = {"pident": "double", "length": "bigint", "mismatch": "int", "gapopen": "int", "qstart": "bigint", "qend": "bigint", "sstart": "bigint", "send": "bigint", "evalue": "double", "bitscore": "double"}


def sam_parsed(lines: DataFrame, column: str = "value") -> DataFrame:
    """SAM lines as the eleven fields, typed, pos from 0, with the aligned length. Header lines and null lines go; what isn't a number, or isn't there, is null; repeated lines repeat."""
    cells = F.split(column, "\t")
    rows = lines.where(~F.startswith(F.col(column), F.lit("@")))
    out = rows.select(*(F.get(cells, F.lit(i)).try_cast(_SAM_TYPES.get(k, "string")).alias(k) for i, k in enumerate(SAM_FIELDS)))
    return out.withColumn("pos", F.col("pos") - 1).withColumn("aligned", cigar_aligned(F.col("cigar")))


def sam_lines(records: DataFrame) -> DataFrame:
    """The eleven fields (pos from 0) as lines."""
    return records.select(F.concat_ws("\t", *((F.col(k) + 1 if k == "pos" else F.col(k)).cast("string") for k in SAM_FIELDS)).alias("value"))


def sam_header(catalogue: DataFrame, program: str = "lzseq", version: str = "0.1") -> DataFrame:
    """(ord, value): a line for each sequence (name, length) in their order, then the program's."""
    rows = catalogue.select(F.col("seq_ix").cast("bigint").alias("ord"), F.concat(F.lit("@SQ\tSN:"), "name", F.lit("\tLN:"), F.col("length").cast("string")).alias("value"))
    last = catalogue.sparkSession.createDataFrame([(9223372036854775807, f"@PG\tID:{program}\tVN:{version}")], "ord bigint, value string")
    return rows.unionByName(last)


def mapped_only(records: DataFrame) -> DataFrame:
    return records.where(mapped(F.col("flag")))


def normalised(records: DataFrame, catalogue: DataFrame, bin_size: int = 65_536) -> DataFrame:
    """SAM records at text positions as lines at sequence positions: what overlaps two sequences becomes unmapped.

    records: key, qname, flag, pos, aligned and the other fields; catalogue: key, name, start, end. Records with a null or
    unknown key or place have no line; repeated ones repeat.
    """
    rows = range_join(records, catalogue.select("key", F.col("name").alias("_name"), "start", "end"), "pos", "start", "end", ["key"], bin_size)
    fits = F.col("pos") + F.col("aligned") <= F.col("end")
    cells = [F.col("_name") if k == "rname" else F.col("pos") - F.col("start") + 1 if k == "pos" else F.col(k) for k in SAM_FIELDS]
    line = F.concat_ws("\t", *(c.cast("string") for c in cells))
    return rows.select("key", "qname", "flag", fits.alias("fits"), F.when(fits, line).otherwise(unmapped_record(F.col("qname"))).alias("value"))


def blast_parsed(lines: DataFrame, column: str = "value") -> DataFrame:
    """BLAST's twelve columns, typed; positions stay as they are, from 1. What isn't there, or no number, is null, so a null or empty line has a row of nulls."""
    cells = F.split(column, "\t")
    return lines.select(*(F.get(cells, F.lit(i)).try_cast(_BLAST_TYPES.get(k, "string")).alias(k) for i, k in enumerate(BLAST_FIELDS)))


def blast_moved(records: DataFrame, name: Column, start: Column) -> DataFrame:
    """Records at another sequence and start; the end moves along."""
    return records.withColumn("send", start + (F.col("send") - F.col("sstart"))).withColumn("sstart", start).withColumn("sseqid", name)


def fasta_metadata(lines: DataFrame) -> DataFrame:
    """Of FASTA lines (file, line_no, value): a row for each sequence with name, length, byte places of its header and line length.

    header_sp is the place of >, header_ep of the header's newline. Characters count as one byte each; line_len is null
    for a sequence on one line, which has no line length of its own.
    """
    from .chunks import prefix_sums

    shared_folder(lines.sparkSession)
    header = F.startswith("value", F.lit(">"))
    # Lines are read once, and only their lengths and names sorted.
    rows = lines.select("file", "line_no", header.alias("is_header"), F.length("value").cast("bigint").alias("_size"), F.when(header, first_token(F.substring("value", 2, 1 << 30))).alias("_name")).checkpoint()
    rows = prefix_sums(rows, "file", ["line_no"], {"at": F.col("_size") + 1, "_headers": F.col("is_header").cast("bigint")})
    rows = rows.withColumn("seq_ix", F.col("_headers") + F.col("is_header").cast("bigint") - 1)
    body = ~F.col("is_header")
    out = rows.groupBy("file", "seq_ix").agg(
        F.max("_name").alias("name"),
        F.coalesce(F.sum(F.when(body, F.col("_size"))), F.lit(0)).cast("bigint").alias("length"),
        F.max(F.when(F.col("is_header"), F.col("at"))).alias("header_sp"),
        F.max(F.when(F.col("is_header"), F.col("at") + F.col("_size"))).cast("bigint").alias("header_ep"),
        F.sum(body.cast("int")).alias("_lines"),
        F.min_by(F.when(body, F.col("_size")), F.when(body, F.col("line_no"))).cast("bigint").alias("_first"),
    )
    return out.where("seq_ix >= 0").select("file", "seq_ix", "name", "length", "header_sp", "header_ep", F.when(F.col("_lines") > 1, F.col("_first")).alias("line_len"))


def file_position(header_ep: Column, line_len: Column, local: Column) -> Column:
    """The byte of a sequence's character; line_len null: the sequence is one line."""
    return F.coalesce(header_ep + 1 + local % line_len + F.floor(local / line_len).cast("bigint") * (line_len + 1), header_ep + 1 + local)


def in_header(places: DataFrame, metadata: DataFrame, bin_size: int = 4096) -> DataFrame:
    """Bytes (file, at) that lie in a header, with its seq_ix."""
    ends = metadata.select("file", "seq_ix", "header_sp", (F.col("header_ep") + 1).alias("header_end"))
    return range_join(places, ends, "at", "header_sp", "header_end", ["file"], bin_size).select("file", "at", "seq_ix")


def merged_metadata(metadata: DataFrame) -> DataFrame:
    """Metadata of files as that of their concatenation in the files' order: places move by the sizes before.

    metadata has file_len as well. Rows (file, seq_ix, name, length, header_sp, header_ep) with numbers of the whole.
    """
    shared_folder(metadata.sparkSession)
    metadata = metadata.checkpoint()  # a row a sequence, gone over twice
    totals = metadata.groupBy("file").agg(F.max("file_len").alias("bytes"), F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    moved = totals.select("file", F.coalesce(F.sum("bytes").over(w), F.lit(0)).alias("by"), F.coalesce(F.sum("n").over(w), F.lit(0)).alias("by_ix"))
    rows = metadata.join(moved, "file")
    return rows.select("file", (F.col("seq_ix") + F.col("by_ix")).alias("seq_ix"), "name", "length", (F.col("header_sp") + F.col("by")).alias("header_sp"), (F.col("header_ep") + F.col("by")).alias("header_ep"))


def cached_metadata(lines: DataFrame, path: str) -> DataFrame:
    """fasta_metadata() kept as a table: read where there is one at path, else made and written; never overwritten."""
    spark = lines.sparkSession
    if not exists(spark, f"{path}/_SUCCESS"):
        fasta_metadata(lines).write.mode("ignore").parquet(path)
    return spark.read.parquet(path)
