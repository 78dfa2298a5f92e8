"""A group's blocks are as large as its dictionary asks for, and keys are looked up in their order."""

import random

import numpy as np

from lzseq.operators import chunks, kernels, parses


def test_blocks_grow_with_their_dictionary(spark, monkeypatch):
    dealt, of = [], chunks.with_blocks
    monkeypatch.setattr(chunks, "with_blocks", lambda *a: dealt.append(of(*a)) or dealt[-1])
    r = random.Random(3)
    dictionary = "".join(r.choices("ACGT", k=100))
    rows = [(g, k, dictionary[k % 50 : k % 50 + 40]) for g in ("a", "b", "none") for k in range(25)]
    seqs = spark.createDataFrame(rows, "g string, seq_id long, seq string")
    dictionaries = spark.createDataFrame([("a", dictionary), ("b", "ACGT")], "g string, dictionary string")
    found = parses.rlz_by_group(seqs, dictionaries, "g", ["seq_id"], block_chars=50)
    got = {(x.g, x.seq_id): x.text for x in parses.decoded_by_group(found, dictionaries, "g", ["seq_id"]).collect()}
    assert got == {(g, k): t for g, k, t in rows}
    blocks = {x.g: x.n for x in dealt[0].select("g", "block").distinct().groupBy("g").count().withColumnRenamed("count", "n").collect()}
    assert blocks["a"] <= 3 and blocks["b"] == blocks["none"] == 20  # 1,000 characters: 400 for a dictionary of 100, 50 else


def test_packed_keys_and_lookups():
    r = np.random.default_rng(1)
    for alphabet in (1, 2, 4, 40):
        packed = kernels.Packed(np.arange(65, 65 + alphabet))
        for n in (0, 1, 5, 200):
            codes = r.integers(0, alphabet + 1, n)
            padded = np.append(codes, np.zeros(packed.width, np.int64)).tolist()
            expected = [sum(padded[i + k] << (packed.bits * (packed.width - 1 - k)) for k in range(packed.width)) for i in range(n)]
            assert packed.keys_of_codes(codes).tolist() == expected
            keys, asked = np.sort(packed.keys_of_codes(codes)), r.integers(0, 1 << 62, 50)
            for side in ("left", "right"):
                assert kernels.looked_up(keys, asked, side).tolist() == np.searchsorted(keys, asked, side).tolist()
