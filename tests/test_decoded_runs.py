import random

import pytest
from pyspark.sql import functions as F

from lzseq.operators import parses

DICTIONARIES = {"a": "ACGTTGCA" * 40, "b": "日本語 über 𝒳" * 30, "c": ""}


def parse_of(rng, dictionary, n):
    """Phrases, some outside the dictionary, and what they stand for."""
    rows, text = [], ""
    for ix in range(n):
        if rng.random() < 0.4:
            pos = rng.randrange(256)
            rows.append((ix, pos, 0))
            text += chr(pos)
        else:
            pos, length = rng.randrange(-3, len(dictionary) + 5), rng.randrange(1, 90)
            rows.append((ix, pos, length))
            text += dictionary[max(pos, 0) : max(pos + length, 0)]
    return rows, text


@pytest.mark.parametrize("held, block, part, shuffled", [(1 << 24, 2_000_000, 262_144, False), (1 << 24, 40, 100, True), (330, 40, 100, False)])
def test_runs_decode_as_their_phrases(spark, monkeypatch, held, block, part, shuffled):
    for name, value in (("HELD_DICTIONARY", held), ("BLOCK_PHRASES", block), ("TEXT_PART", part), ("DICTIONARY_ROW", 64)):
        monkeypatch.setattr(parses, name, value)
    rng = random.Random(9)
    rows, want = [], {}
    for k in range(30):
        g = rng.choice("abc") if held > 1000 else rng.choice("ac")
        found, text = parse_of(rng, DICTIONARIES[g], rng.randrange(1, 60))
        rows += [(g, k, *x) for x in found]
        if text:
            want[g, k] = text
    rows += [("c", 90, 0, 3, 5), ("none", 91, 0, 65, 0), ("none", 91, 1, 2, 4)]
    want["none", 91] = "A"
    if shuffled:
        rng.shuffle(rows)
    table = spark.createDataFrame(rows, "g string, seq_id long, phrase_ix long, pos long, len long")
    dictionaries = spark.createDataFrame([(k, v) for k, v in DICTIONARIES.items()], "g string, dictionary string")
    if held <= 1000:  # pieces are cut as in a join: a place before the text has none
        table, want = table.where("pos >= 0"), None
        plain = parses._decoded_by_pieces(table, dictionaries, "g", ["seq_id"]).groupBy("g", "seq_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), "").alias("text"))
        want = {(r.g, r.seq_id): r.text for r in plain.collect()}
    got = {(r.g, r.seq_id): r.text for r in parses.decoded_by_group(table, dictionaries, "g", ["seq_id"]).collect()}
    assert got == want
    if part == 100:
        assert max(r.n for r in parses.decoded_parts(table, dictionaries, "g", ["seq_id"]).select(F.length("text").alias("n")).collect()) <= (100 if held > 1000 else 1000)


def test_phrases_of_a_parse_are_one_row(spark):
    rows = spark.range(0, 3000, 1, 1).select((F.col("id") / 1000).cast("long").alias("g"), F.lit("x").alias("seq_id"), (F.col("id") % 1000).alias("phrase_ix"), F.lit(1).alias("pos"), F.lit(2).alias("len"))
    runs = parses.phrase_runs(rows, "g", ["seq_id"])
    assert runs.count() <= 4  # a batch ends within the third
    assert runs.agg(F.sum(F.size("pos"))).first()[0] == 3000
    assert sorted(r.first_ix for r in runs.collect())[:3] == [0, 0, 0]


def test_runs_of_a_parse_are_its_phrases(spark, monkeypatch):
    monkeypatch.setattr(parses, "RUN_PHRASES", 7)
    rng = random.Random(4)
    seqs = spark.createDataFrame([(rng.choice("ab"), k, "".join(rng.choices("ACGT", k=rng.choice([0, 1, 200])))) for k in range(40)], "g string, seq_id long, seq string")
    dictionaries = spark.createDataFrame([("a", "ACGTTGCAAC")], "g string, dictionary string")
    plain = parses.rlz_by_group(seqs, dictionaries, "g", ["seq_id"])
    runs = parses.rlz_by_group(seqs, dictionaries, "g", ["seq_id"], runs=True)
    assert runs.agg(F.max(F.size("pos"))).first()[0] == 7
    again = runs.select("g", "seq_id", "first_ix", F.posexplode(F.arrays_zip("pos", "len")).alias("k", "x")).select("g", "seq_id", (F.col("first_ix") + F.col("k")).alias("phrase_ix"), "x.pos", "x.len")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, plain.select(*again.columns).collect()))
    texts = {r.seq_id: r.text for r in parses.decoded_by_group(runs, dictionaries, "g", ["seq_id"]).collect()}
    assert texts == {r.seq_id: r.seq for r in seqs.collect() if r.seq}
