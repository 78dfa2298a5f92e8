import random

import pytest
from pyspark.sql import functions as F

from lzseq.functions import columns as C
from lzseq.operators import chunks, dictionaries, parses, phrases, ranges, records, search
from lzseq.plans import index
from lzseq.sinks import writers
from lzseq.sources import readers
from lzseq.streaming import align

TEXT = "ACGTTGCAACACGTTGCAACACGTAGCAAC"


def naive(texts, patterns):
    return sorted((q, k, i) for k, t in texts.items() for q, p in patterns for i in range(len(t)) if t.startswith(p, i))


def repetitive(rng, n):
    base = "".join(rng.choices("ACGT", k=40))
    out = ""
    while len(out) < n:
        at = rng.randrange(30)
        out += base[at : at + rng.randrange(1, 40)] + rng.choice("ACGT")
    return out[:n]


def test_worked_example(spark):
    texts = spark.createDataFrame([("t", TEXT)], "key string, text string")
    parsed = parses.lz77_phrases(texts, leftmost=True)
    merged = phrases.merge_short(parsed, 2)
    assert [(r.len, r.is_literal) for r in merged.orderBy("phrase_ix").collect()] == [(10, True), (14, False), (1, True), (5, False)]
    limited = phrases.kernel_limits(merged, 2)
    assert [r.k_end for r in limited.orderBy("phrase_ix").collect()] == [10, 15, 16, 20]
    assert phrases.kernel_texts(phrases.kernel_pieces(limited, texts, 2)).first().kernel == "ACGTTGCAACAC$GTAGCA$"
    assert [tuple(r) for r in phrases.grid(merged).select("x", F.col("x_end") - F.col("x"), "phrase_ix").orderBy("x").collect()] == [(0, 14, 1), (5, 5, 3)]


@pytest.mark.parametrize("method, prefix", [("lz77", None), ("lz77_leftmost", None), ("rlz", 60)])
def test_index_finds_what_naive_search_finds(spark, method, prefix):
    rng = random.Random(5)
    seqs = [(i, f"g{i % 3}", repetitive(rng, rng.choice([0, 1, 7, 150, 400]))) for i in range(12)]
    df = spark.createDataFrame(seqs, "seq_id long, groupname string, seq string")
    pats = list(enumerate({repetitive(rng, rng.randrange(1, 9)) for _ in range(25)} | {"A", "CG"}))
    pdf = spark.createDataFrame(pats, "query_id long, pattern string")
    built = index.over_sequences(df, index.Parameters(max_query_len=8), block_chars=500, method=method, prefix_chars=prefix)
    got = sorted((r.query_id, r.seq_id, r.seq_pos) for r in search.find_all(built, pdf).where("fits").collect())
    assert got == naive({i: s for i, _, s in seqs}, pats)


def test_index_saves_loads_and_merges(spark, tmp_path):
    texts = {"a": TEXT, "b": TEXT[::-1] * 2}
    one = lambda k: index.build(spark.createDataFrame([(k, texts[k])], "key string, text string"), spark.createDataFrame([(k, 0, k, len(texts[k]), 0, len(texts[k]))], "key string, seq_ix long, seq_id string, length long, start long, end long"), index.Parameters(4))
    index.merge([one("a"), one("b")]).save(str(tmp_path / "i"))
    loaded = index.Index.load(spark, str(tmp_path / "i"))
    pats = [(0, "GCAA"), (1, "AC")]
    got = sorted((r.query_id, r.key, r.pos) for r in search.find_all(loaded, spark.createDataFrame(pats, "query_id long, pattern string")).collect())
    assert got == naive({"0/a": texts["a"], "1/b": texts["b"]}, pats)
    assert loaded.space().where("key = '0/a'").first().text_chars == len(TEXT)
    with pytest.raises(ValueError):
        search.find_all(loaded, spark.createDataFrame([(0, "ACGTA")], "query_id long, pattern string"))


def test_parse_round_trips(spark):
    rng = random.Random(2)
    rows = [(str(i), repetitive(rng, n), repetitive(rng, 80)) for i, n in enumerate([0, 1, 2, 50, 300])]
    df = spark.createDataFrame(rows, "key string, seq string, dictionary string")
    want = {k: s for k, s, _ in rows if s}
    full = parses.decoded(parses.lz77_phrases(df.withColumn("text", F.col("seq"))), ["key"])
    assert {r.key: r.text for r in full.collect()} == want
    relative = parses.decoded_by_group(parses.rlz_phrases(df.withColumn("n", F.lit(1)), ["key", "n"]), df.select("key", "dictionary"), "key", ["n"])
    assert {r.key: r.text for r in relative.collect()} == want


def test_chunks(spark):
    df = spark.createDataFrame([(0, "ABCDEFGHIJ", "ABCDEFGHIJ"), (1, "AB", "A-B-"), (2, "", "--")], "seq_id long, seq string, raw string")
    got = {(r.seq_id, r.chunk_ix): r.chunk for r in chunks.fixed_chunks(df, 3, "raw").collect()}
    assert got == {(0, 0): "ABC", (0, 1): "DEF", (0, 2): "GHI", (0, 3): "J", (1, 0): "A", (1, 1): "B"}
    with pytest.raises(Exception, match="shorter"):
        chunks.fixed_chunks(df.where("seq_id = 1"), 30, "raw", compat=True).collect()
    ids = chunks.dense_ids(spark.range(1000).select((F.col("id") * 37 % 1000).alias("v")), ["v"], parts=7)
    assert sorted((r.id, r.v) for r in ids.collect()) == [(i, i) for i in range(1000)]


def test_names(spark):
    rows = [("ACC.1 Escherichia coli str, chromosome 2: x, complete genome",), ("ACC two",), ("one",), ("",)]
    df = spark.createDataFrame(rows, "h string")
    got = [tuple(r) for r in df.select(C.taxon(F.col("h")), C.chromosome(F.col("h")), C.is_complete(F.col("h"))).collect()]
    assert got == [("Escherichiacoli", "chr2x", True), ("two", "", False), ("one", "", False), ("", "", False)]
    assert df.limit(1).select(C.padded(F.lit(12345), 4)).first()[0] == "12345"


def test_dictionary_sizes(spark):
    df = spark.createDataFrame([(n,) for n in (1, 14, 15, 16, 100, 5000)], "n long")
    assert [r[0] for r in df.select(dictionaries.size_rule(F.col("n"))).collect()] == [1, 14, 4, 5, 33, 1000]


def test_range_join_and_closure(spark):
    rng = random.Random(3)
    points = [("k", i, rng.randrange(300)) for i in range(100)]
    spans = [("k", a, a + rng.randrange(0, 90), j) for j, a in enumerate(rng.randrange(250) for _ in range(40))]
    got = ranges.range_join(spark.createDataFrame(points, "key string, p long, at long"), spark.createDataFrame(spans, "key string, s long, e long, j long"), "at", "s", "e", ["key"], 16)
    assert sorted((r.p, r.j) for r in got.collect()) == sorted((p, j) for _, p, at in points for _, s, e, j in spans if s <= at < e)
    grid = spark.createDataFrame([("k", 0, 4, 1, 10), ("k", 10, 14, 2, 20)], "key string, x long, x_end long, phrase_ix long, text_start long")
    first = spark.createDataFrame([("k", 7, 1, 2), ("k", 7, 3, 2)], "key string, query_id long, pos long, m long")
    assert sorted(r.pos for r in ranges.closure(first, grid).collect()) == [1, 3, 11, 21]


def test_closure_of_a_long_chain(spark):
    grid = spark.createDataFrame([("k", 4 * i, 4 * i + 4, i, 4 * i + 4) for i in range(19)], "key string, x long, x_end long, phrase_ix long, text_start long")
    first = spark.createDataFrame([("k", 1, 1, 2)], "key string, query_id long, pos long, m long")
    assert sorted(r.pos for r in ranges.closure(first, grid).collect()) == [4 * i + 1 for i in range(20)]


def test_merge_boundaries(spark):
    for n, pieces in ((4, 1), (5, 2)):  # 2C and 2C + 1 with C = 2
        df = spark.createDataFrame([("k", 0, 65, 0), ("k", 1, 0, n)], "key string, phrase_ix long, pos long, len long")
        assert phrases.merge_short(df, 2).count() == pieces


def test_records(spark):
    lines = spark.createDataFrame([("@SQ\tSN:x",), ("r1\t0\tDummy\t6\t42\t10S5M2D3I\t*\t0\t0\tGCAAC\t*",), ("bad",)], "value string")
    rows = records.sam_parsed(lines).orderBy("qname").collect()
    assert (rows[1].pos, rows[1].aligned) == (5, 8) and rows[0].pos is None
    assert spark.range(1).select(C.cigar_clipped(F.lit("10S5M2D3I")), C.cigar_aligned(F.lit("*"))).first() == (10, 0)
    hit = spark.createDataFrame([("k", "a", 0, 8, 5), ("k", "b", 0, 6, 3)], "key string, qname string, flag int, pos long, aligned long")
    for c, v in (("mapq", 42), ("cigar", "5M"), ("rnext", "*"), ("pnext", 0), ("tlen", 0), ("seq", "*"), ("qual", "*"), ("rname", "-")):
        hit = hit.withColumn(c, F.lit(v))
    cat = spark.createDataFrame([("k", "s1", 0, 10), ("k", "s2", 10, 30)], "key string, name string, start long, end long")
    got = {r.qname: r.value for r in records.normalised(hit, cat).collect()}
    assert got["a"] == "a\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*" and got["b"].startswith("b\t0\ts1\t7\t42\t5M")


def test_files_round_trip(spark, tmp_path):
    seqs = spark.createDataFrame([("n1 x", "ACGT"), ("n2", "GG")], "header string, seq string")
    writers.fasta(seqs, str(tmp_path / "fa"))
    assert sorted((r.header, r.seq) for r in readers.fasta(spark, str(tmp_path / "fa")).collect()) == [("n1 x", "ACGT"), ("n2", "GG")]
    (tmp_path / "m.fa").write_text(">a b\nAC-\nGT\n>c\nTT\n")
    assert sorted((r.header, r.seq) for r in readers.fasta(spark, str(tmp_path / "m.fa"), strict=True).collect()) == [("a b", "ACGT"), ("c", "TT")]
    assert sorted(r.seq for r in readers.fasta(spark, str(tmp_path / "m.fa"), single_line=True, drop_first=True).collect()) == ["AC-", "TT"]
    (tmp_path / "r.fq").write_text("@r1 d\nACGT\n+\nIIII\n@r2\nGG\n+\n@I\n")
    assert sorted((r.name, r.seq, r.qual) for r in readers.fastq(spark, str(tmp_path / "r.fq")).collect()) == [("r1", "ACGT", "IIII"), ("r2", "GG", "@I")]
    p = spark.createDataFrame([("a:b c", 1, 5, 300), ("a:b c", 0, 65, 0), ("d", 0, 1 << 31, 2)], "key string, phrase_ix long, pos long, len long")
    for kind in ("u64", "u32", "vbyte"):
        written = writers.parse_files(p, str(tmp_path / kind), kind=kind).collect()
        assert sorted(r.file.rsplit("/", 1)[1] for r in written) == ["abc.lz", "d.lz"]
        back = readers.parse_files(spark, str(tmp_path / kind), kind)
        assert sorted((r.phrase_ix, r.pos, r.len) for r in back.collect()) == [(0, 65, 0), (0, 1 << 31, 2), (1, 5, 300)]
    (tmp_path / "p.txt").write_text("ACG\nTT\n")
    assert [(r.query_id, r.pattern) for r in readers.patterns(spark, str(tmp_path / "p.txt")).orderBy("query_id").collect()] == [(0, "ACG"), (1, "TT")]
    assert [r.item for r in readers.work_list(spark, "1-3,7").collect()] == [1, 2, 3, 7]
    cat = spark.createDataFrame([(0, "s1", 10)], "seq_ix long, name string, length long")
    writers.sam(spark.createDataFrame([("r\t0",)], "value string"), cat, str(tmp_path / "sam"))
    assert [r.value for r in spark.read.text(str(tmp_path / "sam")).collect()][0].startswith("@")


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("GC\nTA\n")
    built = index.build(spark.createDataFrame([("t", TEXT)], "key string, text string"), spark.createDataFrame([("t", 0, 9, 30, 0, 30)], "key string, seq_ix long, seq_id long, length long, start long, end long"), index.Parameters(2))
    stream = align.read_patterns(spark, str(tmp_path / "in")).select(F.length("value").cast("long").alias("query_id"), F.col("value").alias("pattern"))
    align.find_stream(stream, built, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.pos for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [5, 15, 23, 25]


def test_seed_align(spark):
    texts = spark.createDataFrame([("t", "AAAACGTACGTTTTACGAACGTCC")], "key string, text string")
    reads = spark.createDataFrame([(1, "ACGTACGT")], "query_id long, pattern string")
    got = sorted((r.pos, r.mismatches) for r in search.seed_align(reads, texts, 4, 1).collect())
    assert got == [(3, 0), (14, 1)]


def test_seed_align_of_short_reads(spark):
    rng = random.Random(3)
    text = "".join(rng.choices("ACGT", k=400))
    read = list(text[100:160])
    for i in (10, 30, 50):  # one in each piece of 24 and in the rest
        read[i] = "ACGT"["ACGT".index(read[i]) - 1]
    reads = spark.createDataFrame([(1, "".join(read)), (2, text[200:210])], "query_id long, pattern string")
    texts = spark.createDataFrame([("t", text)], "key string, text string")
    got = sorted((r.query_id, r.pos, r.mismatches) for r in search.seed_align(reads, texts, 24, 3).collect())
    far = lambda r, p: sum(a != b for a, b in zip(r, text[p : p + len(r)]))
    want = [(q, p, far(r, p)) for q, r in ((1, "".join(read)), (2, text[200:210])) for p in range(400 - len(r) + 1) if far(r, p) <= 3]
    assert got == want and (1, 100, 3) in got
    with pytest.raises(Exception, match="more than 3"):
        search.seed_align(spark.createDataFrame([(1, "ACG")], "query_id long, pattern string"), texts, 24, 3).collect()



def test_hot_keys_are_spread(spark, monkeypatch):
    rng = random.Random(14)
    rows = [(k, i, rng.randint(0, 50), rng.choice([0, 1, 3, 9, 21, 40])) for k, n in (("hot", 3000), ("a", 1), ("b", 40)) for i in range(n)]
    p = spark.createDataFrame(rows, "key string, phrase_ix long, pos long, len long").repartition(5)
    order = lambda d: sorted(map(tuple, d.collect()))
    plain = phrases.merge_short(p, 5)
    assert order(phrases.limits(p, hot=True)) == order(phrases.limits(p, hot=False))
    assert order(phrases.merge_short(p, 5, hot=True)) == order(plain)
    assert order(phrases.kernel_limits(plain, 5, hot=True)) == order(phrases.kernel_limits(plain, 5, hot=False))
    monkeypatch.setattr(phrases, "HOT_PHRASES", 100)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = phrases.limits(p).withColumn("task", F.spark_partition_id()).where("key = 'hot'").select("task").distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tasks > 1


def test_kernels_cut_at_once_equal_their_pieces(spark):
    rng = random.Random(15)
    texts = {f"k{i}": "".join(rng.choices("ACGT", k=rng.randint(1, 200))) for i in range(12)}
    rows = []
    for k, t in texts.items():
        at, i = 0, 0
        while at < len(t):
            n = min(len(t) - at, rng.choice([1, 5, 12, 13, 14, 30]))
            rows.append((k, i, 0, n, rng.random() < 0.4, at, at + n))
            at, i = at + n, i + 1
    merged = spark.createDataFrame(rows, "key string, phrase_ix long, pos long, len long, is_literal boolean, text_start long, text_end long")
    t = spark.createDataFrame(list(texts.items()), "key string, text string")
    for edits in (0, 2):
        limited = phrases.kernel_limits(merged, 6, edits)
        a = phrases.kernel_texts(phrases.kernel_pieces(limited, t, 6, edits)).collect()
        b = phrases.kernels_of(limited, t, 6, edits).collect()
        assert {r.key: r.kernel for r in a} == {r.key: r.kernel for r in b}


def test_symbols_are_not_lost(spark):
    t = spark.createDataFrame([("k", "AC€GT")], "key string, text string")
    with pytest.raises(Exception, match="U\\+00FF"):
        parses.lz77_phrases(t).collect()


def test_nulls_repeats_and_empty_tables(spark):
    hits = spark.createDataFrame([("a", 1, 3, 2), ("a", 1, 3, 2), (None, 2, 3, 2), ("a", 3, None, 2), ("z", 4, 3, 2)], "key string, query_id long, pos long, m long")
    ends = spark.createDataFrame([("a", 0, 10, 7), (None, 0, 10, 8), ("a", 5, 5, 9), ("a", None, 10, 9)], "key string, start long, end long, seq_id long")
    assert [r.seq_id for r in search.placed(hits, ends).collect()] == [7, 7]
    copies = spark.createDataFrame([("a", 0, 10, 20)], "key string, x long, x_end long, text_start long")
    assert ranges.copies_of(hits, copies).count() == 2
    got = sorted((r.key, r.pos) for r in ranges.closure(hits.where("key = 'a' and pos is not null"), copies).collect())
    assert got == [("a", 3), ("a", 23)]
    assert ranges.closure(hits.limit(0), copies).count() == 0 and search.placed(hits.limit(0), ends).count() == 0
    texts = spark.createDataFrame([("a", None), ("b", ""), ("c", "ACAC"), ("c", "ACAC")], "key string, text string")
    assert parses.lz77_phrases(texts).where("key = 'c'").count() == 6 == parses.lz77_phrases(texts).count()
    assert parses.suffix_arrays(texts).count() == 8 and parses.lcp_arrays(texts).count() == 8
    assert search.located(texts.withColumnRenamed("text", "kernel"), spark.createDataFrame([(1, "AC"), (2, "AC")], "query_id long, pattern string"), 5).count() == 8
    for empty in (parses.lz77_phrases(texts.limit(0)), parses.decoded(parses.lz77_phrases(texts.limit(0)), ["key"]), phrases.merge_short(parses.lz77_phrases(texts.limit(0)), 3), chunks.dense_ids(texts.limit(0), ["key"])):
        assert empty.count() == 0
    lines = spark.createDataFrame([(None,), ("",), ("@HD",), ("r\t4",)], "value string")
    assert [(r.qname, r.flag) for r in records.sam_parsed(lines).collect()] == [("", None), ("r", 4)]
    assert records.blast_parsed(lines).count() == 4
    built = index.over_sequences(spark.createDataFrame([], "seq_id long, groupname string, seq string"), index.Parameters(max_query_len=5))
    assert search.find_all(built, spark.createDataFrame([(1, "AC")], "query_id long, pattern string")).count() == 0
    assert search.align_index(spark.createDataFrame([(1, "ACGTA")], "query_id long, pattern string"), built, 4, 1).count() == 0


def test_decoding_in_rounds_and_in_parts(spark, monkeypatch):
    rng = random.Random(21)
    monkeypatch.setattr(parses, "TEXT_PART", 50)
    monkeypatch.setattr(parses, "DICTIONARY_PIECE", 16)
    base = "".join(rng.choices("ACGT", k=90))
    texts = {"a": base + base[20:70] + base, "b": "a" * 300, "c": "é", "d": "ab" * 70 + base[:30]}
    rows = spark.createDataFrame(list(texts.items()), "key string, text string")
    got = {}
    for r in parses.decoded_by_rounds(parses.lz77_phrases(rows)).orderBy("key", "part").collect():
        got[r.key] = got.get(r.key, "") + r.text
        assert len(r.text) <= 50
    assert got == texts
    with pytest.raises(Exception, match="nothing to copy"):
        parses.decoded_by_rounds(spark.createDataFrame([("x", 0, 5, 3)], "key string, phrase_ix long, pos long, len long")).collect()
    seqs = spark.createDataFrame([("g", i, base[i : i + 60] + "TÿT") for i in range(6)] + [("h", 7, "ACGT"), ("h", 8, "")], "g string, seq_id long, seq string")
    dictionaries = spark.createDataFrame([("g", base)], "g string, dictionary string")
    found = parses.rlz_by_group(seqs, dictionaries, "g", ["seq_id"])
    back = {r.seq_id: r.text for r in parses.decoded_by_group(found, dictionaries, "g", ["seq_id"]).collect()}
    assert back == {r.seq_id: r.seq for r in seqs.collect() if r.seq}
    assert parses.decoded_parts(found, dictionaries, "g", ["seq_id"]).where("seq_id = 0").count() == 2


@pytest.mark.parametrize("step", ["phrases", "relative", "decoded", "located", "windows", "cut", "pieces", "kernels"])
def test_batches_that_go_to_python_are_bounded(spark, step):
    """A batch of blocks of texts, or of their phrases, isn't as large as a partition."""
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    was = {k: spark.conf.get(k) for k in keys}
    texts = spark.createDataFrame([("g", 1, "ACGTACGTAA", "AC")], "key string, seq_id long, seq string, dictionary string").withColumn("text", F.col("seq"))
    found = spark.createDataFrame([("g", 1, 0, 65, 0)], "key string, seq_id long, phrase_ix long, pos long, len long")
    steps = {
        "phrases": lambda: parses.lz77_phrases(texts),
        "relative": lambda: parses.rlz_by_group(texts, texts, "key", ["seq_id"]),
        "decoded": lambda: parses.decoded(found, ["key"]),
        "located": lambda: search.located(texts.withColumnRenamed("text", "kernel"), spark.createDataFrame([(1, "AC")], "query_id long, pattern string"), 5),
        "windows": lambda: search.windows(spark.createDataFrame([("g", 0, 2)], "key string, at long, n long"), texts, 2),
        "cut": lambda: parses.cut_long(texts, 5, 2, "key"),
        "pieces": lambda: chunks.pieces(texts),
        "kernels": lambda: phrases.kernels_of(phrases.kernel_limits(phrases.merge_short(found.drop("seq_id"), 2), 2), texts, 2),
    }
    try:
        for k in keys:
            spark.conf.set(k, str(1 << 30))
        assert steps[step]().count() >= 0
        assert int(spark.conf.get(keys[0])) <= 2_000 and int(spark.conf.get(keys[1]).rstrip("b")) <= 16 << 20
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_pieces_that_copies_are_found_in_are_short(spark, monkeypatch):
    cut, of = [], chunks.pieces
    monkeypatch.setattr(chunks, "pieces", lambda texts, width: cut.append(of(texts, width)) or cut[-1])
    text = "".join(random.Random(4).choices("ACGT", k=70_000))
    dictionaries = spark.createDataFrame([("g", text)], "g string, dictionary string")
    rows = [("g", 1, k, 2 * k, 5) for k in range(2_000)] + [("g", 2, 0, 300, 69_000), ("g", 2, 1, 65, 0), ("g", 2, 2, 69_999, 1)]
    got = parses.decoded_by_group(spark.createDataFrame(rows, "g string, seq_id long, phrase_ix long, pos long, len long"), dictionaries, "g", ["seq_id"])
    assert {r.seq_id: r.text for r in got.collect()} == {1: "".join(text[2 * k : 2 * k + 5] for k in range(2_000)), 2: text[300:69_300] + "A" + text[-1]}
    assert max(len(r.piece) for r in cut[0].collect()) <= 1_024  # a part of one is found by going over what is before it


@pytest.mark.parametrize("most", [10**6, 0])
def test_reading_joins_only_pieces_asked_for(spark, most, monkeypatch):
    monkeypatch.setattr(chunks, "BROADCAST_PIECES", most)
    monkeypatch.setattr(search, "BROADCAST_PIECES", most)
    texts = spark.createDataFrame([(k, "".join(random.Random(k).choices("ACGT", k=9_000))) for k in range(30)], "key long, text string")
    said = {r.key: r.text for r in texts.collect()}
    asked = [(k, at, n) for k, at, n in ((1, 0, 5), (1, 4090, 20), (7, 8990, 50), (7, 8990, 50), (8, 9_500, 3), (99, 0, 1))]
    places = spark.createDataFrame(asked, "key long, at long, n long")
    got = sorted((r.key, r["at"], r.n, r.text) for r in chunks.read_at(places, chunks.pieces(texts)).where("text is not null").collect())
    assert got == sorted((k, a, n, said[k][a : a + n]) for k, a, n in asked if k in said and a < 9_000)
    found = search.windows(places, texts, 50)
    assert sorted((r.key, r["at"], r.part) for r in found.where("part <> ''").collect()) == sorted((k, a, said[k][a : a + n]) for k, a, n in asked if k in said and a < 9_000)
    if most:  # what is shuffled follows what is asked for
        assert sum(1 for r in chunks.only_asked(chunks.pieces(texts), places.withColumn("piece_ix", F.floor(F.col("at") / 4096))).collect()) == 3


def test_every_end_of_a_read_with_gaps(spark):
    rng = random.Random(22)
    base = "".join(rng.choices("ACGT", k=160))
    texts = {f"t{k}": base[: 40 + k] + "".join(rng.choices("ACGT", k=3 * k)) + base[40 + k + k % 3 :] + base[10:60] for k in range(4)}
    reads = [(q, (lambda r: r[:9] + r[10:20] + "T" + r[20:])(base[a : a + 30])) for q, a in enumerate((5, 12, 33, 60, 100))] + [(9, "ACAC" * 7)]
    edits = 3
    rows = search.aligned(spark.createDataFrame(reads, "query_id long, pattern string"), spark.createDataFrame(list(texts.items()), "key string, text string"), 12, edits, gaps=True, strands=False, every_end=True).collect()
    got = {(r.query_id, r.key, r.pos + r.n): r.edits for r in rows}
    assert len(got) == len(rows)
    want = {}
    for q, read in reads:
        for key, t in texts.items():
            row = list(range(len(read) + 1))  # edits of each beginning of the read with the closest part that ends here
            for end, c in enumerate(t, 1):
                new = [0]
                for i, x in enumerate(read, 1):
                    new.append(min(row[i - 1] + (x != c), row[i] + 1, new[i - 1] + 1))
                row = new
                if row[-1] <= edits:
                    want[q, key, end] = row[-1]
    assert got == want and len(want) > 40


def test_long_intervals_are_in_few_bins(spark):
    rng = random.Random(23)
    spans = [(k % 3, a, a + n) for k, (a, n) in enumerate((rng.randrange(10**6), rng.choice((0, 1, 3, 4, 5, 63, 64, 65, 1024, 1025, 300_000, 10**6))) for _ in range(150))]
    points = [(rng.randrange(4), rng.randrange(2 * 10**6)) for _ in range(300)] + [(k, x) for k, a, b in spans[:60] for x in (a - 1, a, b - 1, b)]
    left, right = spark.createDataFrame(points, "key int, at long"), spark.createDataFrame(spans, "key int, start long, end long")
    classes = ranges.length_classes(right, "start", "end", 4)
    assert classes[0] == 0 and 3 < len(classes) < 8
    got = ranges.range_join(left, right, "at", "start", "end", ["key"], 4, classes)
    want = sorted((k, p, a, b) for k, p in points for q, a, b in spans if k == q and a <= p < b)
    assert sorted((r.key, r["at"], r.start, r.end) for r in got.collect()) == want
    generated = [x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Generate" in x]
    assert len(generated) == 2  # points by class, intervals by bin
