"""Readers: FASTA, FASTQ, aligned lines, whole files, work lists, SAM, BLAST, patterns and binary parses, all by Spark's own scans."""

from __future__ import annotations

import os
from fnmatch import fnmatchcase
from itertools import islice

import numpy as np
import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import letters_only
from ..functions.session import BATCH_BYTES, bounded_batches, qualified, shared_folder
from ..operators import kernels, records


def lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(file, value) of text lines."""
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    return reader.text(path).select(F.col("_metadata.file_path").alias("file"), "value")


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, text): each file as one sequence named by the file; none for an empty file."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    return rows.select("file", F.substring_index("file", "/", -1).alias("name"), "text")


def file_paths(spark: SparkSession, path: str) -> DataFrame:
    """Paths only; the files' contents aren't read. Spark's scans pass over empty files, so they have no row."""
    return spark.read.format("binaryFile").load(path).select("path")


def work_items(text) -> Column:
    """Numbers of a column of lists such as 1-22 or 1,2,5, as an array."""
    parts = F.transform(F.split(text, ","), lambda p: F.split(p, "-"))
    return F.flatten(F.transform(parts, lambda p: F.sequence(p[0].cast("int"), F.coalesce(F.get(p, F.lit(1)), p[0]).cast("int"))))


def work_list(spark: SparkSession, text: str) -> DataFrame:
    """Numbers of a list such as 1-22 or 1,2,5."""
    return spark.range(1).select(F.explode(work_items(F.lit(text))).alias("item"))


def fasta(spark: SparkSession, path: str, single_line: bool = False, strict: bool = False, drop_first: bool = False) -> DataFrame:
    """(file, header, seq). Records begin with >; the sequence's lines are joined, or only its first taken if single_line.

    strict keeps letters only; drop_first loses the header's first character, as readers that expect > there do.
    """
    rows = spark.read.option("lineSep", ">").text(path).select(F.col("_metadata.file_path").alias("file"), "value").where(F.length("value") > 0)
    return fasta_records(rows, single_line, strict, drop_first)


def fasta_records(rows: DataFrame, single_line: bool = False, strict: bool = False, drop_first: bool = False) -> DataFrame:
    """fasta() of records in value, without their >; other columns stay."""
    header = F.regexp_replace(F.substring_index("value", "\n", 1), "\r$", "")
    body = F.expr("substring(value, length(substring_index(value, '\n', 1)) + 2)")
    seq = F.substring_index(body, "\n", 1) if single_line else body
    seq = letters_only(seq) if strict else F.regexp_replace(seq, "\\s", "")
    out = rows.withColumn("header", F.substring(header, 2, 1 << 30) if drop_first else header).withColumn("seq", seq)
    return out.drop("value")


def fastq(spark: SparkSession, path: str, mates: str | None = None, interleaved: bool = False) -> DataFrame:
    """(name, seq, qual, mate) of one or two files (or folders) of four-line records; each file has whole records.

    Lines are numbered over partitions, as no separator tells records apart: a quality line may begin with @. A record
    whose lines don't begin with @ and +, or whose quality isn't as long as its sequence, raises; empty lines at the end don't count.
    """
    if mates and interleaved:
        raise ValueError("reads are in two files or interleaved, not both")

    def one(p, mate):
        nth = F.col("line") % 4
        rows = numbered_lines(spark, p).groupBy(F.floor(F.col("line") / 4).alias("record")).agg(*(F.max(F.when(nth == k, F.regexp_replace("value", "\r$", ""))).alias(c) for k, c in enumerate(("head", "seq", "plus", "qual"))))
        name = F.substring_index(F.regexp_replace("head", "^@", ""), " ", 1)
        number = F.when(F.endswith(name, F.lit("/2")), 2).otherwise(1) if interleaved else F.lit(mate)
        whole = F.startswith("head", F.lit("@")) & F.startswith("plus", F.lit("+")) & (F.length("seq") == F.length("qual"))
        empty = (F.coalesce(F.length("head"), F.lit(0)) == 0) & (F.coalesce(F.length("seq"), F.lit(0)) == 0) & (F.coalesce(F.length("plus"), F.lit(0)) == 0)  # line ends at the end of a file
        broken = F.raise_error(F.concat(F.lit("no read begins at line "), (F.col("record") * 4 + 1).cast("string"), F.lit(" of "), F.lit(p)))
        rows = rows.where(~empty).withColumn("seq", F.when(F.coalesce(whole, F.lit(False)), F.col("seq")).otherwise(broken))
        return rows.select(F.regexp_replace(name, "/[12]$", "").alias("name"), "seq", "qual", number.cast("int").alias("mate"))

    return one(path, 1).unionByName(one(mates, 2)) if mates else one(path, 1)


def sam(spark: SparkSession, path: str) -> DataFrame:
    return records.sam_parsed(spark.read.text(path))


def blast6(spark: SparkSession, path: str) -> DataFrame:
    return records.blast_parsed(spark.read.text(path))


def patterns(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, pattern): lines numbered in their order within and over files; ids are dense."""
    return numbered_lines(spark, path).select(F.col("line").alias("query_id"), F.col("value").alias("pattern"))


def numbered_lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(line, value, file) with dense numbers over the files in the order of their names: the lines of a folder's files (those that match glob) as if copied into one."""
    from ..operators.chunks import dense_ids

    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    rows = reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"), "value")
    return dense_ids(rows, ["file", "block", "nth"], "line").select("line", "value", "file")


def merged_parses(spark: SparkSession, path: str, kind: str = "u64", glob: str | None = None) -> DataFrame:
    """(part, phrase_ix, pos, len): the binary parses of a folder in the order of their names as one parse, sources moved."""
    from ..operators.phrases import merge_parts

    return merge_parts(parse_files(spark, path, kind, glob).withColumnRenamed("file", "part"))


def parse_files(spark: SparkSession, path: str, kind: str = "u64", glob: str | None = None) -> DataFrame:
    """(file, phrase_ix, pos, len) of binary parses: pairs of little-endian u64 or u32, or of variable-length integers (vbyte)."""
    files, pairs_of = _parse_contents(spark, path, kind, glob)

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                pairs = pairs_of(batch, r)
                yield pa.RecordBatch.from_arrays([pa.repeat(batch.column("file")[r], len(pairs)), pa.array(np.arange(len(pairs))), pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["file", "phrase_ix", "pos", "len"])

    return files.mapInArrow(run, "file string, phrase_ix bigint, pos bigint, len bigint")


def _listed(spark: SparkSession, path: str, glob: str | None) -> tuple[DataFrame, str, int] | None:
    """(name, size) of a folder's files but empty ones, the folder as Spark names it, and their bytes. A task lists them, so the driver holds none. None for
    what isn't a folder of files alone in a file system that Arrow knows, or has a pattern."""
    if any(c in path for c in "*?[{,") or (glob and any(c in glob for c in "[{")):
        return None
    folder = qualified(spark, path)
    try:
        system, root = pa_fs.FileSystem.from_uri(folder)
        if system.get_file_info(root).type != pa_fs.FileType.Directory:
            return None
    except (pa.ArrowException, OSError):
        return None

    def entries():
        system, root = pa_fs.FileSystem.from_uri(folder)
        if system.type_name == "local":
            with os.scandir(root) as found:
                for x in found:
                    yield x.name, 0 if x.is_dir() else x.stat().st_size, x.is_dir()
        else:
            for x in system.get_file_info(pa_fs.FileSelector(root)):
                yield x.base_name, x.size or 0, x.type == pa_fs.FileType.Directory

    def run(batches):
        for batch in batches:
            seen = ((n, size, inner) for n, size, inner in entries() if n[0] not in "._" and (inner or size and (not glob or fnmatchcase(n, glob)))) if batch.num_rows else iter(())
            while some := list(islice(seen, 50_000)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), (pa.string(), pa.int64(), pa.bool_()))], names=["name", "size", "inner"])

    shared_folder(spark)
    rows = spark.range(1, numPartitions=1).mapInArrow(run, "name string, size bigint, inner boolean").checkpoint()
    size, inner = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.bool_or("inner"), F.lit(False))).first()
    named = spark._jvm.org.apache.hadoop.fs.Path(folder).toString()
    return None if inner else (rows.select("name", "size"), named.rstrip("/"), size)


def _parse_contents(spark: SparkSession, path: str, kind: str, glob: str | None):
    """(file, ...) of binary parses, and what gives the phrases of a batch's row. Files of a folder are listed and opened by tasks, others by Spark's scan, whose list the driver holds."""
    if kind not in ("u64", "u32", "vbyte"):
        raise ValueError("kind is u64, u32 or vbyte")
    least, found = 4 * spark.sparkContext.defaultParallelism, _listed(spark, path, glob)
    if found:
        rows, named, size = found
        files = rows.repartition(max(least, size // BATCH_BYTES + 1), "name").checkpoint().select(F.concat(F.lit(named + "/"), "name").alias("file"), "name")
    else:
        reader = spark.read.format("binaryFile")
        files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select(F.col("path").alias("file"), "content")
        size = int(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        files = files.coalesce(max(least, size // BATCH_BYTES + 1))  # a scan has a task for each 32 files, however small
    folder = qualified(spark, path) if found else None

    def contents(batch: pa.RecordBatch, r: int) -> bytes:
        if folder is None:
            return batch.column("content")[r].as_py()
        system, root = pa_fs.FileSystem.from_uri(folder)
        with system.open_input_stream(f"{root.rstrip('/')}/{batch.column('name')[r].as_py()}", compression=None) as f:
            return f.read()

    def pairs_of(batch: pa.RecordBatch, r: int) -> np.ndarray:
        data = contents(batch, r)
        numbers = from_vbyte(data) if kind == "vbyte" else np.frombuffer(data, "<u8" if kind == "u64" else "<u4").astype(np.int64)
        if len(numbers) % 2:
            raise ValueError(f"{batch.column('file')[r].as_py()}: a phrase is cut")
        return numbers.reshape(-1, 2)

    return files, pairs_of


def decoded_files(spark: SparkSession, path: str, kind: str = "u64", glob: str | None = None) -> DataFrame:
    """(file, text) of binary parses whose sources are in their own text, as parses.decoded() of parse_files(): a file is read whole, and decoded where it is read. A file without phrases has no row."""
    bounded_batches(spark)
    files, pairs_of = _parse_contents(spark, path, kind, glob)

    def run(batches):
        for batch in batches:
            names, texts, size = [], [], 0
            for r in range(batch.num_rows):
                pairs = pairs_of(batch, r)
                if not len(pairs):
                    continue
                names.append(batch.column("file")[r].as_py())
                texts.append(kernels.decode(pairs[:, 0].tolist(), pairs[:, 1].tolist()).decode("latin-1"))
                size += len(texts[-1])
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], names=["file", "text"])
                    names, texts, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], names=["file", "text"])

    return files.mapInArrow(run, "file string, text string")


def from_vbyte(data: bytes) -> np.ndarray:
    """Numbers of seven bits a byte, the lowest first; a set top bit ends a number."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.empty(0, np.int64)
    ends = np.flatnonzero(b & 0x80)
    if not len(ends) or ends[-1] != len(b) - 1:
        raise ValueError("a number is cut")
    starts = np.concatenate([[0], ends[:-1] + 1])
    within = np.arange(len(b)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((b & 0x7F).astype(np.int64) << (7 * within), starts)


def to_vbyte(numbers) -> bytes:
    n = np.asarray(numbers, np.int64)
    if len(n) and n.min() < 0:
        raise ValueError("a number is negative")
    size = np.ones(len(n), np.int64)
    for k in range(1, 9):
        size += n >= 1 << (7 * k)
    ends = np.cumsum(size)
    within = np.arange(int(size.sum())) - np.repeat(ends - size, size)
    out = ((np.repeat(n, size) >> (7 * within)) & 0x7F).astype(np.uint8)
    out[ends - 1] |= 0x80
    return out.tobytes()
