"""The order of suffixes over many tasks, against sorting them."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lzseq.operators import kernels, suffixes


def sorted_suffixes(t):
    return sorted(range(len(t)), key=lambda i: t[i:])


def common(a, b):
    return len(os.path.commonprefix([a, b]))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(13)
    base = "".join(rng.choices("ACGT", k=120))
    return {"a": "mississippi", "b": "a" * 60, "c": base + base[10:90] + base[:50], "d": "ab" * 40 + "b", "e": "".join(rng.choices("ab", k=200)), "f": "é日a日é日a", "g": "x", "h": "", "i": None}


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "key string, text string").repartition(3)


@pytest.mark.parametrize("head", [1, 3, 16])
def test_order_prefixes_and_transform(spark, texts, head, monkeypatch):
    monkeypatch.setattr(suffixes, "TOGETHER", 32)
    order = suffixes.ordered(frame(spark, texts), head)
    got = {}
    for r in sorted(order.ranks.collect(), key=lambda r: (r.key, r.rank)):
        got.setdefault(r.key, []).append(r.suffix)
    want = {k: sorted_suffixes(t) for k, t in texts.items() if t}
    assert got == want
    lcp = {(r.key, r["rank"]): r.lcp for r in suffixes.common_prefixes(order).collect()}
    assert lcp == {(k, i): common(texts[k][x[i - 1] :], texts[k][x[i] :]) if i else 0 for k, x in want.items() for i in range(len(x))}
    rows = {}
    for r in sorted(suffixes.transformed(order).collect(), key=lambda r: (r.key, r.row)):
        rows.setdefault(r.key, []).append(r.symbol)
    for k in "abcde":
        assert "".join(rows[k]).encode() == kernels.transform(texts[k].encode(), kernels.suffix_array(texts[k].encode()))


def test_parts_of_a_text_do_for_the_whole(spark, texts):
    t = texts["c"]
    parts = [("c", t[a : a + 40 + 7], a, min(40, len(t) - a), t[a - 1] if a else None) for a in range(0, len(t), 40)]
    rows = spark.createDataFrame(parts, "key string, text string, `from` long, own long, before_first string")
    a, b = (sorted(map(tuple, suffixes.places(x, 8).collect())) for x in (rows, frame(spark, {"c": t})))
    assert a == b
    assert [r.suffix for r in suffixes.ordered(rows, 8).ranks.orderBy("rank").collect()] == sorted_suffixes(t)


def test_longest_matches(spark):
    rng = random.Random(14)
    pairs = {str(k): ("".join(rng.choices("abc", k=rng.randint(0, 40))), "".join(rng.choices("abc", k=rng.randint(0, 40)))) for k in range(12)} | {"none": (None, "a"), "same": ("abcabc", "abcabc"), "other": ("xyz", "abc")}
    rows = spark.createDataFrame([(k, *v) for k, v in pairs.items()], "key string, text string, dictionary string")
    got = {(r.key, r["at"]): (r.len, r.source) for r in suffixes.matches(rows, 2).collect()}
    assert set(got) == {(k, i) for k, (t, _) in pairs.items() for i in range(len(t or ""))}
    for (k, i), (n, source) in got.items():
        t, d = pairs[k]
        assert n == max(common(t[i:], d[j:]) for j in range(len(d) + 1)) and (source is None) == (n == 0)
        assert not n or d[source : source + n] == t[i : i + n]
    with pytest.raises(ValueError):
        suffixes.matches(rows.withColumn("text", F.lit("a\1b")))


def test_no_texts(spark):
    order = suffixes.ordered(frame(spark, {"h": "", "i": None}))
    assert order.ranks.count() == 0 == suffixes.common_prefixes(order).count() == suffixes.transformed(order).count()
