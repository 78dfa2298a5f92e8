"""What operators ask of the session."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which checkpoint() writes to. Where it is unset, a temporary one, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lzseq-")
        spark.sparkContext.setCheckpointDir(found)
    return found


#: The folders of scratch(), the last one first in use.
_scratch: list[str] = []


@contextmanager
def scratch(spark: SparkSession):
    """While it lasts, keep() writes to a folder that goes at its end; so nothing that is read later may hang on what was kept."""
    _scratch.append(f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        remove(spark, _scratch.pop())


def keep(rows: DataFrame, outer: bool = False) -> DataFrame:
    """rows, made once: checkpointed, or within scratch() as a table there, which is compressed (a quarter, of bases). outer: in the folder of the scratch() around this one."""
    if not _scratch:
        shared_folder(rows.sparkSession)
        return rows.checkpoint()
    folder = f"{_scratch[-1 - outer]}/{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file or folder in any file system that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, which is the session's where the path names none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return "file:///" + full.removeprefix("file:").lstrip("/") if full.startswith("file:") else full


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system that Spark reads; nothing where there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def remove_by_task(spark: SparkSession, path: str) -> None:
    """remove() of a folder of very many files, which a task lists and not the driver; by the driver where Arrow doesn't know the file system."""
    folder = qualified(spark, path)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                system, root = pa_fs.FileSystem.from_uri(folder)
                if system.get_file_info(root).type == pa_fs.FileType.Directory:
                    system.delete_dir(root)
            yield batch

    try:
        pa_fs.FileSystem.from_uri(folder)
    except (pa.ArrowException, OSError):
        return remove(spark, path)
    spark.range(1, numPartitions=1).mapInArrow(run, "id bigint").collect()


#: Rows and bytes of the batches that texts go to Python in, so that a worker's memory doesn't hang on their lengths.
BATCH_ROWS, BATCH_BYTES = 2_000, 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's limits of Arrow batches to these, where they are higher. They stay so, as plans run later than they are made."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(re.sub(r"\D+$", "", str(spark.conf.get(key))))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


#: Inputs of up to so many estimated bytes are dealt over the cores.
SMALL_BYTES = 16 << 20


def spread(rows: DataFrame) -> DataFrame:
    """A small input in few files over all cores, for work that costs far more than its shuffle.

    One file with one row group is one task, however many cores there are. Larger inputs have splits enough and stay.
    Rows go to Python in bounded batches.
    """
    bounded_batches(rows.sparkSession)
    if int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) > SMALL_BYTES:
        return rows
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if 0 < len(rows.inputFiles()) < cores else rows
