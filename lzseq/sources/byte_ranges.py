"""Files by byte ranges: a data source for binary parses, of which one file is many partitions, and random access to bytes of any file.

Paths are in a file system that Arrow knows (file, hdfs, s3, gs), the session's if they name none.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.session import qualified, shared_folder, spread
from .readers import from_vbyte

#: Bytes of a partition; bytes that a number of seven bits a byte takes at most.
SPLIT, LONGEST = 64 << 20, 10
#: Partitions from which on ranges share one, while they have SPLIT bytes together at most; phrases of a batch.
PARTITIONS, ROWS = 256, 100_000
WIDTH = {"u64": 8, "u32": 4}
#: Bytes of places that one read takes together, with what lies between them.
READ_AHEAD = 1 << 20


class Ranges(InputPartition):
    """Byte ranges (file, start, end, numbers before, whether the file ends there), of a file one at most."""

    def __init__(self, ranges: list[tuple[str, int, int, int, bool]]):
        self.ranges = ranges


class ParseReader(DataSourceReader):
    """Options: path (a file or folder, qualified), kind (u64, u32 or vbyte), suffix, split (bytes); counts: JSON of [file, start, numbers] by which a range of vbyte that doesn't begin its file knows how many numbers are before it; without them those of files in more than one range are only counted."""

    def __init__(self, options: dict[str, str]):
        self.path, self.kind, self.suffix = options["path"], options.get("kind", "u64"), options.get("suffix", ".lz")
        self.split = int(options.get("split", SPLIT))
        self.counts = json.loads(options["counts"]) if "counts" in options else None
        if self.kind not in (*WIDTH, "vbyte"):
            raise ValueError("kind is u64, u32 or vbyte")
        if self.kind != "vbyte":  # whole phrases
            self.split = max(1, self.split // (2 * WIDTH[self.kind])) * 2 * WIDTH[self.kind]

    def partitions(self) -> list[Ranges]:
        system, root = pa_fs.FileSystem.from_uri(self.path)
        found = system.get_file_info(root)
        files = [found] if found.is_file else [x for x in system.get_file_info(pa_fs.FileSelector(root, recursive=True)) if x.is_file and x.path.endswith(self.suffix)]
        files = sorted((x for x in files if x.size), key=lambda x: x.path)
        known: dict[str, dict[int, int]] = {}
        for file, start, n in self.counts or []:
            known.setdefault(file, {})[start] = n
        most = max(self.split, min(SPLIT, sum(x.size for x in files) // PARTITIONS))
        out, here, room = [], [], most
        for x in files:
            if self.kind != "vbyte" and x.size % (2 * WIDTH[self.kind]):
                raise ValueError(f"{x.path}: a phrase is cut")
            start, before = 0, 0
            if here and x.size > room and room < most:  # as many files as fit whole
                out.append(Ranges(here))
                here, room = [], most
            while start < x.size:
                end = min(x.size, start + max(1, room // self.split) * self.split)
                here.append((x.path, start, end, before, end == x.size))
                before += known.get(x.path, {}).get(start, 0)
                room -= end - start
                start = end
                if start < x.size or room < self.split:
                    out.append(Ranges(here))
                    here, room = [], most
        return [*out, Ranges(here)] if here else out

    def read(self, part: Ranges) -> Iterator[pa.RecordBatch]:
        if part is None:  # no files
            return
        system, _ = pa_fs.FileSystem.from_uri(self.path)
        files, first, pairs, rows = [], [], [], 0
        for file, start, end, before, is_last in part.ranges:
            if self.kind == "vbyte" and self.counts is None and start == 0 and is_last:
                continue  # a file in one range needs no count
            with system.open_input_file(file) as f:
                at, found = self._range(f, file, start, end, before, is_last)
            if found is None:
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([start], pa.int64()), pa.array([at], pa.int64()), pa.array([0], pa.int64())], names=self._NAMES)
                continue
            for a in range(0, len(found), ROWS):
                files.append(file)
                first.append(at + a)
                pairs.append(found[a : a + ROWS])
                rows += len(pairs[-1])
                if rows >= ROWS:
                    yield self._batch(files, first, pairs)
                    files, first, pairs, rows = [], [], [], 0
        if rows:
            yield self._batch(files, first, pairs)

    def _range(self, f, file: str, start: int, end: int, before: int, is_last: bool) -> tuple[int, np.ndarray | None]:
        """The first phrase's number and the phrases of a range; without counts the numbers that begin in a range of vbyte, and None."""
        if self.kind != "vbyte":
            f.seek(start)
            numbers = np.frombuffer(f.read(end - start), "<u8" if self.kind == "u64" else "<u4").astype(np.int64)
            return start // (2 * WIDTH[self.kind]), numbers.reshape(-1, 2)
        # A number belongs to the range that its first byte is in; a phrase to that of its first number.
        size, low = f.size(), max(0, start - 1)
        f.seek(low)
        data = f.read(min(size, end + 2 * LONGEST) - low)
        b = np.frombuffer(data, np.uint8)
        ends = np.flatnonzero(b & 0x80)
        if low + len(b) == size and (not len(ends) or ends[-1] != len(b) - 1):
            raise ValueError(f"{file}: a number is cut")
        starts = np.concatenate([[0], ends[:-1] + 1]) if start == 0 else ends[:-1] + 1
        ends = ends if start == 0 else ends[1:]
        own = int(((starts + low >= start) & (starts + low < end)).sum())
        if self.counts is None:
            return own, None
        if is_last and (before + own) % 2:
            raise ValueError(f"{file}: a phrase is cut")
        odd = before % 2  # the range's first number ends a phrase of the range before
        last = own + (before + own) % 2
        if last <= odd:
            return 0, np.empty((0, 2), np.int64)
        return (before + odd) // 2, from_vbyte(data[int(starts[odd]) : int(ends[last - 1]) + 1]).reshape(-1, 2)

    _NAMES = ["file", "phrase_ix", "pos", "len"]

    def _batch(self, files: list[str], first: list[int], pairs: list[np.ndarray]) -> pa.RecordBatch:
        n = [len(x) for x in pairs]
        joined = np.concatenate(pairs)
        named = pa.array(files, pa.string()).take(pa.array(np.repeat(np.arange(len(n)), n)))
        return pa.RecordBatch.from_arrays([named, pa.array(np.concatenate([a + np.arange(k) for a, k in zip(first, n)])), pa.array(joined[:, 0].copy()), pa.array(joined[:, 1].copy())], names=self._NAMES)


class ParseSource(DataSource):
    """spark.read.format("lzseq_parse"): see ParseReader for its options."""

    @classmethod
    def name(cls) -> str:
        return "lzseq_parse"

    def schema(self) -> str:
        return "file string, phrase_ix bigint, pos bigint, len bigint"

    def reader(self, schema) -> ParseReader:
        return ParseReader(dict(self.options))


def parse_ranges(spark: SparkSession, path: str, kind: str = "u64", suffix: str = ".lz", split: int = SPLIT) -> DataFrame:
    """(file, phrase_ix, pos, len) of binary parses, as readers.parse_files(), with a partition for each `split` bytes of a file.

    Where these were more than PARTITIONS, a partition has more of them, of many files where files are small, up to SPLIT bytes: tasks follow the bytes
    and not the files. Numbers of variable length are counted first in files that are more than one partition's (a row for each such range on the driver), as a range can't tell
    otherwise which of its numbers are places. A phrase that is cut raises.
    """
    spark.dataSource.register(ParseSource)
    options = {"path": qualified(spark, path), "kind": kind, "suffix": suffix, "split": str(split)}
    read = lambda **more: spark.read.format("lzseq_parse").options(**options, **more).load()
    if kind != "vbyte":
        return read()
    return read(counts=json.dumps([list(r) for r in read().select("file", "phrase_ix", "pos").collect()]))


def bytes_at(places: DataFrame) -> DataFrame:
    """places (file, at, n and others) with content: n bytes of the file from `at` on, fewer at its end, null where file, at or n is null or at is outside.

    Random access: places are dealt by file and place, and only what they ask for is read, places near each other
    together. A file of any size does. Equal places are read and repeated each.
    """
    spark = places.sparkSession
    base = qualified(spark, shared_folder(spark))
    names = places.columns
    rows = spread(places).repartitionByRange("file", "at").sortWithinPartitions("file", "at")
    schema = ", ".join(f"`{k}` {t}" for k, t in places.dtypes) + ", content binary"

    def run(batches):
        opened: list = [None, None]

        def file(path: str):
            if opened[0] != path:
                system, root = pa_fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else base.split("://")[0] + "://" + path)
                opened[:] = path, system.open_input_file(root)
            return opened[1]

        for batch in batches:
            files, at, n = (batch.column(c).to_pylist() for c in ("file", "at", "n"))
            out: list = [None] * len(files)
            k = 0
            while k < len(files):
                if files[k] is None or at[k] is None or n[k] is None or at[k] < 0:
                    k += 1
                    continue
                f, end, last = file(files[k]), at[k] + n[k], k + 1
                while last < len(files) and files[last] == files[k] and at[last] is not None and n[last] is not None and at[last] + n[last] - at[k] <= READ_AHEAD:
                    end, last = max(end, at[last] + n[last]), last + 1
                if at[k] < f.size():
                    f.seek(at[k])
                    data = f.read(end - at[k])
                    for i in range(k, last):
                        if at[i] < f.size():
                            out[i] = data[at[i] - at[k] : at[i] - at[k] + n[i]]
                k = last
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*names, "content"])

    return rows.mapInArrow(run, schema)


def sequence_bytes(places: DataFrame, metadata: DataFrame) -> DataFrame:
    """places (file, seq_ix, at, n and others) with text: n letters of a FASTA file's sequence from `at` on, by the metadata of records.fasta_metadata(); fewer at the sequence's end, null outside."""
    from ..operators.records import file_position

    own = metadata.select("file", "seq_ix", "length", "header_ep", "line_len")
    rows = places.join(own, ["file", "seq_ix"], "left")
    first = F.when((F.col("at") >= 0) & (F.col("at") < F.col("length")), F.col("at"))
    last = F.least(first + F.col("n"), F.col("length")) - 1
    where = lambda local: file_position(F.col("header_ep"), F.col("line_len"), local)
    asked = rows.withColumn("_asked", F.struct("at", "n")).withColumn("n", where(last) - where(first) + 1).withColumn("at", where(first))
    got = bytes_at(asked.drop("length", "header_ep", "line_len"))
    text = F.regexp_replace(F.decode("content", "UTF-8"), "\n", "")
    return got.withColumn("text", text).select(*(F.col(f"_asked.{c}").alias(c) if c in ("at", "n") else F.col(c) for c in places.columns), "text")
