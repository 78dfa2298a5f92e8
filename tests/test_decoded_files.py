"""Binary parses decoded where they are read, and numbers of variable length written at once."""

import random

import pytest

from lzseq.operators import parses
from lzseq.sinks import writers
from lzseq.sources import readers


def test_numbers_of_variable_length():
    r = random.Random(5)
    numbers = [0, 1, 127, 128, 16383, 16384, 2**32, 2**56 - 1, 2**56, 2**63 - 1] + [r.randrange(1 << r.randrange(1, 63)) for _ in range(500)]
    assert readers.from_vbyte(readers.to_vbyte(numbers)).tolist() == numbers and readers.to_vbyte([]) == b""
    assert readers.to_vbyte([5, 300]) == bytes([0x85, 0x2C, 0x82])
    with pytest.raises(ValueError):
        readers.to_vbyte([3, -1])


@pytest.mark.parametrize("kind", ["u64", "u32", "vbyte"])
def test_files_are_decoded_where_they_are_read(spark, tmp_path, kind):
    texts = {str(k): "ACGTTGÿ"[k % 3 :] * k for k in range(1, 12)}
    rows = spark.createDataFrame(list(texts.items()), "key string, text string")
    writers.parse_files(parses.lz77_phrases(rows), str(tmp_path), kind=kind).collect()
    (tmp_path / "none.lz").write_bytes(b"")
    found = readers.decoded_files(spark, str(tmp_path), kind)
    assert {r.file.split("/")[-1].removesuffix(".lz"): r.text for r in found.collect()} == texts
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, parses.decoded(readers.parse_files(spark, str(tmp_path), kind), ["file"]).collect()))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    (tmp_path / "cut.lz").write_bytes(bytes([0x81]) if kind == "vbyte" else bytes(8 if kind == "u64" else 4))
    with pytest.raises(Exception, match="a phrase is cut"):
        readers.decoded_files(spark, str(tmp_path), kind).collect()


def test_many_small_files_share_tasks(spark, tmp_path):
    for k in range(900):
        (tmp_path / f"{k}.lz").write_bytes(readers.to_vbyte([65 + k % 26, 0]))
    rows = readers.decoded_files(spark, str(tmp_path), "vbyte")
    assert rows.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism and rows.count() == 900
