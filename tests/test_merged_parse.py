"""Short phrases are merged where a parse finds them, and short texts are parsed together."""

import random

import pytest
from pyspark.sql import functions as F

from lzseq.functions import columns as C
from lzseq.operators import kernels, parses, phrases
from lzseq.plans import index


def _texts(n, symbols="ACGT", seed=3):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        t = "".join(r.choice(symbols) for _ in range(r.choice([0, 1, 2, 9, 40, 300])))
        out.append(t + t[: r.randrange(len(t) + 1)] * r.randrange(3))
    return out


@pytest.mark.parametrize("leftmost", [False, True])
@pytest.mark.parametrize("symbols", ["A", "AB", "ACGT", "".join(map(chr, range(256)))])
def test_texts_parsed_together_are_parsed_as_each_alone(symbols, leftmost):
    texts = [t.encode("latin-1") for t in _texts(40, symbols)]
    together = kernels.lz77_all(texts, leftmost)
    assert len(together) == len(texts)
    for text, (pos, length) in zip(texts, together):
        assert [x.tolist() for x in kernels.lz77(text, leftmost)] == [pos.tolist(), length.tolist()]
        assert kernels.decode(pos.tolist(), length.tolist()) == text


def test_many_short_texts_are_sorted_once(monkeypatch):
    sorts, plain = [], kernels.ordered
    monkeypatch.setattr(kernels, "ordered", lambda *a: sorts.append(1) or plain(*a))
    assert len(kernels.lz77_all([b"ACGTACGT"] * 500)) == 500 and len(sorts) == 1


def test_phrases_merged_at_the_parse_are_those_merged_after_it(spark):
    rows = spark.createDataFrame([(str(k), t) for k, t in enumerate(_texts(30))], "key string, text string").repartition(3)
    order = lambda df: sorted(map(tuple, df.collect()))
    for context in (1, 3, 8):
        assert order(parses.lz77_phrases(rows, context=context)) == order(phrases.merge_short(parses.lz77_phrases(rows), context))
    seqs = rows.select(F.lit("g").alias("groupname"), "key", F.col("key").cast("bigint").alias("seq_id"), F.col("text").alias("seq"))
    heads = spark.createDataFrame([("g", _texts(30)[5] + "ACGTTGCAACGGT" * 4)], "groupname string, dictionary string")
    after = phrases.merge_short(parses.rlz_by_group(seqs, heads, "groupname", ["key", "seq_id"]).withColumn("source", F.lit("s")), 3).drop("source")
    assert order(parses.rlz_by_group(seqs, heads, "groupname", ["key", "seq_id"], context=3).select(after.columns)) == order(after)


@pytest.mark.parametrize("make", ["sequences", "groups", "given"])
def test_an_index_doesnt_merge_its_own_parse_again(spark, monkeypatch, make):
    merges, plain = [], phrases.merge_short
    monkeypatch.setattr(phrases, "merge_short", lambda *a, **k: merges.append(1) or plain(*a, **k))
    rows = spark.createDataFrame([(k, f"A{k} x y chromosome 1, scaffold", "g", t) for k, t in enumerate(_texts(20))], "seq_id bigint, header string, groupname string, seq string")
    if make == "given":
        texts = rows.select(F.col("seq_id").cast("string").alias("key"), F.col("seq").alias("text")).where("text <> ''")
        index.build(texts, rows.limit(0), parsed=parses.lz77_phrases(texts))
    else:
        index.over_sequences(rows) if make == "sequences" else index.over_groups(rows)
    assert len(merges) == (make == "given")


def test_letters_by_a_table_are_those_of_a_pattern(spark):
    rows = spark.createDataFrame([(t,) for t in (None, "", "aZ\nKıé b-9\x00C\U0001f600d", "\n\n", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")], "text string")
    plain = F.regexp_replace("text", "[^A-Za-z]", "")
    got = rows.select(C.as_bases(F.col("text")).alias("a"), F.translate(F.upper(plain), C.LETTERS, C.BASES).alias("b"), C.letters_and_breaks(F.col("text")).alias("c"), F.regexp_replace("text", "[^A-Za-z\n]", "").alias("d")).collect()
    assert all(r.a == r.b and r.c == r.d for r in got) and len(got) == 5


def test_pieces_are_cut_in_their_texts_own_row(spark):
    """A text beside each of its phrases is gone over from its start for each, which grows with the square of its length."""
    text = "ACGTTGCAACGGTACA" * 40
    limited = spark.range(64).select(F.lit("k").alias("key"), F.col("id").alias("phrase_ix"), F.lit(0).cast("bigint").alias("pos"), F.lit(10).cast("bigint").alias("len"), (F.col("id") % 3 == 0).alias("is_literal"), (F.col("id") * 10).alias("text_start"), (F.col("id") * 10 + 10).alias("text_end"), F.lit("s").alias("source"))
    limited = phrases.kernel_limits(limited, 3)
    texts = spark.createDataFrame([("k", text), ("other", text)], "key string, text string")
    pieces = phrases.kernel_pieces(limited, texts, 3)
    assert pieces.columns == [*limited.columns, "piece"]
    rows = {r.phrase_ix: r for r in pieces.collect()}
    assert len(rows) == 64 and all(r.source == "s" and r.k_end - r.k_start == len(r.piece) for r in rows.values())
    assert rows[3].piece == text[30:40] and rows[4].piece == text[40:43] + "$" + text[47:50] and rows[63].piece == text[630:640]
    for plan in (pieces, phrases.kernels_of(limited, texts, 3)):
        assert "substring(text" not in plan._jdf.queryExecution().toString()
