"""Writers: FASTA, SAM and binary parses. Files are written by Spark's committers or, for binary parses, one for each key under a name of its own."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import qualified
from ..operators import records
from ..sources.readers import to_vbyte


def fasta(seqs: DataFrame, path: str, header: str = "header", seq: str = "seq") -> None:
    """A record for each row, in the rows' order within partitions."""
    seqs.select(F.concat(F.lit(">"), header, F.lit("\n"), seq).alias("value")).write.mode("overwrite").text(path)


def kernel_text(kernels: DataFrame, path: str, header: str | None = None) -> None:
    """Kernel texts, each after a header line if one is given."""
    value = F.concat(F.lit(f">{header}\n"), "kernel") if header else F.col("kernel")
    kernels.select(value.alias("value")).write.mode("overwrite").text(path)


def merged_kernel_texts(parts: DataFrame, header: str) -> DataFrame:
    """(ord, value) of kernel files' lines (part, line_no, value) as one file: a header, then the parts' lines without headers."""
    spark = parts.sparkSession
    top = spark.createDataFrame([("", -1, f">{header}")], "part string, line_no bigint, value string")
    body = parts.where(~F.startswith("value", F.lit(">"))).select(F.col("part").cast("string").alias("part"), F.col("line_no").cast("bigint").alias("line_no"), "value")
    return top.unionByName(body)


def sam(lines: DataFrame, catalogue: DataFrame, path: str) -> None:
    """One SAM file's parts, which sort by name: the header lines first, then the records by read name, of a read the primary ones before the secondary (256) and supplementary (2048)."""
    head = records.sam_header(catalogue).select(F.lit(0).alias("section"), "ord", F.lit("").alias("read"), "value")
    cells = F.split("value", "\t", 3)
    later = (F.coalesce(F.get(cells, F.lit(1)).try_cast("int"), F.lit(0)).bitwiseAND(F.lit(256 + 2048)) != 0).cast("bigint")
    body = lines.select(F.lit(1).alias("section"), later.alias("ord"), cells[0].alias("read"), "value")
    order = ("section", "read", "ord", "value")
    head.unionByName(body).repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.mode("overwrite").text(path)


def parse_bytes(pos, length, kind: str = "u64") -> bytes:
    pairs = np.stack([np.asarray(pos, np.int64), np.asarray(length, np.int64)], 1)
    if kind == "vbyte":
        return to_vbyte(pairs.reshape(-1))
    return pairs.astype("<u8" if kind == "u64" else "<u4").tobytes()


def parses(phrases: DataFrame, key: str = "key", kind: str = "u64") -> DataFrame:
    """(key, content): the binary parse of each key."""
    ordered = F.array_sort(F.collect_list(F.struct("phrase_ix", "pos", "len")))
    rows = phrases.groupBy(key).agg(ordered.alias("p"))

    def content(pos: pa.Array, length: pa.Array) -> pa.Array:
        return pa.array([parse_bytes(p.values.to_numpy(), n.values.to_numpy(), kind) for p, n in zip(pos, length)], pa.binary())

    return rows.select(key, F.arrow_udf(content, "binary")(F.transform("p", lambda x: x["pos"]), F.transform("p", lambda x: x["len"])).alias("content"))


def parse_files(phrases: DataFrame, folder: str, key: str = "key", kind: str = "u64", suffix: str = ".lz") -> DataFrame:
    """Writes each key's binary parse into a folder that all executors reach, and returns (key, file, n_bytes).

    folder is in a file system that Arrow knows (file, hdfs, s3, gs), the session's if it names none; others raise. A file appears under
    its name when it is whole, so a task that runs twice does no harm. Names are the keys without spaces and colons, / as _.
    """

    folder = qualified(phrases.sparkSession, folder)

    def write(keys: pa.Array, contents: pa.Array) -> pa.Array:
        system, root = pa_fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        out = []
        for k, data in zip(keys.to_pylist(), contents.to_pylist()):
            name = "/".join([root.rstrip("/"), str(k).replace(" ", "").replace(":", "").replace("/", "_") + suffix])
            part = f"{name}.{uuid.uuid4().hex}.part"
            with system.open_output_stream(part) as f:
                f.write(data)
            system.move(part, name)
            out.append(name)
        return pa.array(out)

    rows = parses(phrases, key, kind)
    return rows.select(key, F.arrow_udf(write, "string")(F.col(key).cast("string"), "content").alias("file"), F.length("content").alias("n_bytes"))


def regrouped_fasta(seqs: DataFrame, path: str, group: str = "groupname") -> None:
    """A FASTA folder for each group (group, seq_id, header, seq), its records in the order of seq_id over files by name, as the group's parse has them.

    A hot group is several files: records are sorted over all tasks, not gathered by group.
    """
    record = F.concat(F.lit(">"), "header", F.lit("\n"), "seq").alias("value")
    seqs.repartitionByRange(group, "seq_id").sortWithinPartitions(group, "seq_id").select(group, record).write.mode("overwrite").partitionBy(group).text(path)
