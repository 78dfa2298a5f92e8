import random

import pytest
from pyspark.sql import functions as F

from lzseq.operators import records
from lzseq.plans import jobs
from lzseq.sinks import writers
from lzseq.sources import byte_ranges, readers


@pytest.mark.parametrize("kind", ["u64", "u32", "vbyte"])
def test_a_file_is_many_partitions(spark, tmp_path, kind):
    rng = random.Random(30)
    rows = [(f"k{k}", i, rng.choice((0, 5, 300, 70_000, 2**31)), rng.choice((0, 1, 200, 40_000))) for k, n in enumerate((0, 1, 2, 40)) for i in range(n)]
    phrases = spark.createDataFrame(rows, "key string, phrase_ix long, pos long, len long")
    folder = str(tmp_path / "p")
    writers.parse_files(phrases, folder, kind=kind).collect()
    (tmp_path / "p" / "empty.lz").write_bytes(b"")
    for split in (7, 100, 10**6):
        got = byte_ranges.parse_ranges(spark, folder, kind, split=split)
        assert sorted((r.file.split("/")[-1][:-3], r.phrase_ix, r.pos, r.len) for r in got.collect()) == sorted(rows)
    assert byte_ranges.parse_ranges(spark, folder, kind, split=100).rdd.getNumPartitions() > 3


@pytest.mark.parametrize("kind", ["u64", "vbyte"])
def test_many_small_files_are_few_partitions(spark, tmp_path, kind):
    rows = [(f"k{k}", i, k * 7 + i, i % 3) for k in range(1500) for i in range(1 + k % 3)] + [("long", i, i * 3, i % 500) for i in range(3000)]
    phrases = spark.createDataFrame(rows, "key string, phrase_ix long, pos long, len long")
    folder = str(tmp_path / "p")
    writers.parse_files(phrases, folder, kind=kind).collect()
    got = byte_ranges.parse_ranges(spark, folder, kind, split=16)
    assert got.rdd.getNumPartitions() <= 2 * byte_ranges.PARTITIONS
    assert sorted((r.file.split("/")[-1][:-3], r.phrase_ix, r.pos, r.len) for r in got.collect()) == sorted(rows)


def test_cut_phrases_raise(spark, tmp_path):
    for name, kind, data in (("a.lz", "u64", b"x" * 24), ("b.lz", "vbyte", b"\x81\x82\x83"), ("c.lz", "vbyte", b"\x81\x82\x03")):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(Exception, match="is cut"):
            byte_ranges.parse_ranges(spark, str(tmp_path / name), kind, split=2).collect()
    with pytest.raises(Exception, match="kind"):
        byte_ranges.parse_ranges(spark, str(tmp_path), "u16").collect()


def test_bytes_of_files_and_letters_of_sequences(spark, tmp_path):
    rng = random.Random(31)
    seqs = ["".join(rng.choices("ACGT", k=n)) for n in (500, 1, 60, 61, 7)]
    wrap = lambda t, w: "\n".join(t[i : i + w] for i in range(0, len(t), w))
    text = "".join(f">s{i} x\n{wrap(t, 60)}\n" for i, t in enumerate(seqs))
    (tmp_path / "a.fa").write_text(text)
    path = "file://" + str(tmp_path / "a.fa")
    asked = [(path, at, n) for at, n in ((0, 5), (3, 4), (len(text) - 2, 9), (len(text), 3), (100, 0), (-1, 2))] + [(path, None, 1), (None, 0, 1)]
    got = byte_ranges.bytes_at(spark.createDataFrame(asked, "file string, at long, n long").withColumn("other", F.lit(1)))
    data = text.encode()
    content = {(r["at"], r.n): r.content and bytes(r.content) for r in got.where("file is not null").collect()}
    assert content[0, 5] == data[:5] and content[3, 4] == data[3:7] and content[len(data) - 2, 9] == data[-2:] and content[len(data), 3] is None and content[-1, 2] is None and content[None, 1] is None
    meta = records.fasta_metadata(jobs.fasta_lines(spark, str(tmp_path / "a.fa")))
    places = [(k, rng.randrange(len(t)), rng.randint(1, 80)) for k, t in enumerate(seqs) for _ in range(12)] + [(1, 5, 2), (9, 0, 1)]
    rows = spark.createDataFrame(places, "seq_ix long, at long, n long").join(meta.select("file").distinct())
    for r in byte_ranges.sequence_bytes(rows, meta).collect():
        assert r.text == (seqs[r.seq_ix][r["at"] : r["at"] + r.n] or None if r.seq_ix < 5 else None)
