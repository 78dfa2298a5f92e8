"""The search structure, and the join of patterns with texts, against a plain search."""

import random

import numpy as np
import pytest

from lzseq.operators import fm, kernels, search
from lzseq.plans import index


def places(texts, patterns):
    return sorted((key, q, i, len(p)) for key, t in texts for q, p in patterns for i in range(len(t or "")) if t.startswith(p, i))


def rows(found):
    return sorted(tuple(r) for r in found.select("key", "query_id", "pos", "m").collect())


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(8)
    base = "".join(rng.choices("ACGT", k=400))
    texts = [(f"k{i}", base[i : i + 300] + "".join(rng.choices("ACGT", k=80)) + "$" + base[:50]) for i in range(12)] + [("same", "A" * 300), ("short", "ACG"), ("none", None), ("empty", ""), ("accents", "é" * 40 + base[:60])]
    patterns = [(i, base[a : a + n]) for i, (a, n) in enumerate((rng.randrange(300), rng.choice((1, 2, 5, 19, 20, 24, 33, 70, 90))) for _ in range(60))]
    return texts, [*patterns, (100, "A" * 25), (101, "A" * 25), (102, "é" * 30), (103, "T" * 40), (104, "ACG"), (105, "日本" * 12), (106, "ÿ" * 22)]


def frames(spark, texts, patterns):
    return spark.createDataFrame(texts, "key string, kernel string"), spark.createDataFrame(patterns, "query_id long, pattern string")


def test_transformed_text_finds_all(monkeypatch):
    monkeypatch.setattr(fm, "BLOCK", 128)
    rng = random.Random(9)
    for text in (b"", b"a", b"aaaaaaa", b"mississippi", bytes(rng.choices(b"ab", k=700)), bytes(rng.choices(range(256), k=500))):
        s = fm.structure(text)
        t = fm.Transformed(**s)
        patterns = [text[i : i + n] for i in range(0, len(text), 7) for n in (1, 3, 9)] + [b"zz", b"", b"a"]
        low, high = t.intervals(patterns)
        for p, a, b in zip(patterns, low, high):
            assert sorted(t.places_of(np.arange(a, b)).tolist()) == (kernels.occurrences(text, p) if p else [])


def test_search_by_directory_and_blocks(spark, cases, monkeypatch):
    monkeypatch.setattr(fm, "BLOCK", 256)
    monkeypatch.setattr(fm, "TOGETHER", 7)  # several tasks for a text's patterns
    texts, patterns = cases
    k, p = frames(spark, texts, patterns)
    long = [x for x in patterns if len(x[1]) >= fm.GRAM + fm.WINDOW - 1]
    found = fm.located(fm.blocks(k, "kernel"), fm.directory(k, "kernel"), p)
    assert rows(found) == places(texts, long)


@pytest.mark.parametrize("most_bits", [1 << 28, 0])  # with the filter, and with more seeds than it has room for
def test_patterns_meet_texts_in_a_join(spark, cases, most_bits, monkeypatch):
    monkeypatch.setattr(search, "MOST_BITS", most_bits)
    texts, patterns = cases
    k, p = frames(spark, texts, patterns)
    assert rows(search.located(k, p, 100)) == places(texts, patterns)
    assert search.located(k.limit(0), p, 100).count() == 0 == search.located(k, p.limit(0), 100).count()
    with pytest.raises(ValueError):
        search.located(k, p, 50)


def test_no_pattern_goes_through_the_driver(spark, cases, monkeypatch):
    from pyspark.sql import DataFrame

    texts, patterns = cases
    k, p = frames(spark, texts, patterns)
    monkeypatch.setattr(type(p), "toLocalIterator", None)
    monkeypatch.setattr(type(p), "toPandas", None)
    assert isinstance(search.located(k, p, 100), DataFrame) and search.located(k, p, 100).count() == len(places(texts, patterns))


def test_saved_index_reads_only_the_folders_it_needs(spark, tmp_path):
    rng = random.Random(10)
    seqs = spark.createDataFrame([(i, f"g{i % 9}", "".join(rng.choices("ACGT", k=900))) for i in range(60)], "seq_id long, groupname string, seq string")
    built = index.over_sequences(seqs, index.Parameters(max_query_len=30), block_chars=2_000)
    built.save(str(tmp_path / "i"))
    loaded = index.Index.load(spark, str(tmp_path / "i"))
    text = {r.seq_id: r.seq for r in seqs.collect()}
    patterns = [(0, text[7][100:128]), (1, text[40][50:80]), (2, text[7][5:10]), (3, "A" * 30)]
    p = spark.createDataFrame(patterns, "query_id long, pattern string")
    want = sorted((q, s, i) for q, x in patterns for s, t in text.items() for i in range(len(t)) if t.startswith(x, i))
    for one in (built, built.searchable(), loaded, index.merge([loaded])):
        got = sorted((r.query_id, r.seq_id, r.seq_pos) for r in search.find_all(one, p).where("fits").collect())
        assert got == want
    one = p.where("query_id = 0")
    files = fm.candidates(loaded.directory, one)
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
