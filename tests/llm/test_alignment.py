"""Alignment of two tokenizers, against a plain reading of its definition."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from lzseq.llm import alignment, lookups

from .helpers import ODD, prose, table

LETTERS = ["a", "b", "the", " ", "  ", "\n", "\n\n", "\r\n", "\t", "é", " ", "　", "日本", "x ", "<s>", "<|endoftext|>", "'s", "1", "23", "\x00", " ", "ﬁ", "é", "😀", " ", "\x85", "Σ", "ß", "\x7f", "\x1f", "᠎", "​", "﻿", ".", "▁"]


@pytest.fixture(scope="module")
def aligner():
    return alignment.load(*alignment.default_paths())


def tokens(aligner, text):
    """(id, start, end) of both sides; none where bytes differ."""
    if not text:
        return [], []
    data, out = (" " + text).encode(), []
    for ids, names in ((aligner.a.encode(" " + text, add_special_tokens=False).ids, aligner.bytes_a), (aligner.b.encode(text), aligner.bytes_b)):
        said = [names[i].as_py() for i in ids]
        if b"".join(said) != data:
            return [], []
        ends = np.cumsum([len(x) for x in said]).tolist()
        out.append(list(zip(ids, [0, *ends], ends)))
    return out


def by_definition(aligner, texts):
    both = [tokens(aligner, t) for t in texts]
    links = [[(x, y) for x, s, e in a for y, t, f in b if max(s, t) < min(e, f)] for a, b in both]
    count = Counter(p for x in links for p in x)
    most = defaultdict(int)
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    for (a, b), pairs in zip(both, links):
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        said = ";".join("|".join(",".join(str(i) for i, s, e in side if low <= s and e <= high) for side in (a, b)) for low, high in zip([0, *ends], ends))
        yield len(a), len(b), len(ends), len(pairs), sum(count[p] == most[p[1]] for p in pairs), sum(count[p] for p in pairs), hashlib.sha256(said.encode()).hexdigest() if a else ""


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    made = ["".join(rng.choices(LETTERS, k=rng.randint(1, 25))) for _ in range(300)]
    return [*made, *made[:30], *(prose(rng, 60) for _ in range(40)), "", None, " ", "\n", "x ", " x", "▁", "<|endoftext|> </s>", "中文字符" * 40, "0" * 500]


@pytest.mark.parametrize("most_common", [20, 1_000_000])  # most pairs by a join, all by a broadcast
def test_query_follows_definition(spark, aligner, texts, most_common, monkeypatch):
    monkeypatch.setattr(alignment, "TOGETHER", 2_000)
    monkeypatch.setattr(alignment, "HELD", 500)
    got = {r.doc_id: tuple(r)[1:] for r in alignment.cross_tokenizer_alignment(table(spark, texts), most_common=most_common).collect()}
    assert sorted(got) == list(range(len(texts)))
    for k, x in enumerate(by_definition(aligner, texts)):
        assert got[k] == x, texts[k]


def test_pieces_forgotten_and_remembered(aligner, texts, monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 40)
    data = [(t or "").encode() for t in texts]
    whole = alignment.Aligner(*alignment.default_paths()).align(data)
    small = alignment.Aligner(*alignment.default_paths())
    for k in range(0, len(data), 7):
        assert small.align(data[k : k + 7]) == whole[k : k + 7]


def test_groups_and_overlaps():
    low, high = alignment.overlaps(np.array([3, 2, 4]), np.array([1, 2, 5, 1]))
    assert list(zip(low, high)) == [(0, 2), (2, 3), (2, 4)]
    of_a, of_b = alignment.groups(low, high, 4)
    assert of_a.tolist() == [0, 1, 1] and of_b.tolist() == [0, 0, 1, 1]


def test_cut_keeps_all_bytes(texts):
    data = [b" " + (t or "").encode() for t in texts] + [b""]
    pieces, ends = alignment.cut(data)
    names = pieces.to_pylist()
    assert [b"".join(names[a:b]) for a, b in zip(ends, ends[1:])] == data and all(names)


def test_odd_tables(spark, aligner):
    assert alignment.cross_tokenizer_alignment(table(spark, [])).count() == 0
    got = {r.doc_id: r for r in alignment.cross_tokenizer_alignment(table(spark, [*ODD, "same text here"], ids=[*range(len(ODD)), 4])).collect()}
    assert all(got[k].n_a == 0 and got[k].groups_sha256 == "" and got[k].count_sum == 0 for k in range(2))
    assert got[7].n_a > 20_000 and got[7].count_sum >= got[7].n_links


def test_common_levels(spark):
    counts = spark.createDataFrame([(k, n) for k, n in enumerate([1] * 50 + [2] * 20 + [9] * 5)], "key long, n long")
    some, whole = lookups.common(counts, 30)
    assert not whole and sorted(r.n for r in some.collect()) == [2] * 20 + [9] * 5
    assert lookups.common(counts, 75)[1] and lookups.common(counts.limit(0), 5)[1]
    assert lookups.common(counts, 3)[0].count() == 0
