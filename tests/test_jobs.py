import random

import pytest
from pyspark.sql import functions as F

from lzseq.__main__ import main
from lzseq.operators import parses
from lzseq.plans import jobs


def dna(rng, n):
    return "".join(rng.choices("ACGT", k=n))


def write_fasta(path, rng, n=8):
    base = dna(rng, 300)
    records = []
    for i in range(n):
        at = rng.randrange(250)
        records.append((f"S{i} Genus species{i % 2} chromosome {i % 3}, {'complete genome' if i % 2 else 'scaffold'}", base[:at] + dna(rng, 5) + base[at:]))
    path.write_text("".join(f">{h}\n{s[:100]}\n{s[100:]}\n" for h, s in records))
    return records


def test_compression_round_trips(spark, tmp_path):
    rng = random.Random(1)
    records = write_fasta(tmp_path / "a.fa", rng)
    seqs = jobs.fasta_sequences(spark, str(tmp_path / "a.fa")).checkpoint()
    assert [r.seq for r in seqs.orderBy("seq_id").collect()] == [s for _, s in records]
    phrases, texts = jobs.compress_taxa(seqs)
    back = parses.decoded_by_group(phrases, texts, "groupname", ["seq_id"])
    assert {r.seq_id: r.text for r in back.collect()} == dict(enumerate(s for _, s in records))
    phrases, texts = jobs.compress_stripes(seqs, 4, 2)
    parts = parses.decoded_by_group(phrases, texts, "chunk_ix", ["seq_id"]).orderBy("seq_id", "chunk_ix").groupBy("seq_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_ix", "text"))), lambda x: x["text"]), "").alias("text"))
    assert {r.seq_id: r.text for r in parts.collect()} == dict(enumerate(s for _, s in records))


def test_commands(spark, tmp_path):
    rng = random.Random(2)
    records = write_fasta(tmp_path / "a.fa", rng)
    fa, p = str(tmp_path / "a.fa"), lambda x: str(tmp_path / x)
    main(["index", fa, p("i"), "--max-query-len", "20"])
    pattern = records[3][1][40:58]
    (tmp_path / "q.txt").write_text(pattern + "\nACGT\n")
    main(["find", p("i"), p("q.txt"), p("found")])
    got = sorted((r.query_id, r.name, r.pos) for r in spark.read.parquet(p("found")).collect())
    assert got == sorted((q, h.split()[0], i) for q, x in enumerate((pattern, "ACGT")) for h, s in records for i in range(len(s)) if s.startswith(x, i))
    main(["space", p("i")])
    (tmp_path / "r.fq").write_text(f"@r1 x\n{records[0][1][10:70]}\n+\n{'I' * 60}\n@r2\n{dna(rng, 60)}\n+\n{'@' * 60}\n")
    main(["align", fa, p("r.fq"), p("sam"), "--report", "ALL"])
    lines = [r.value for r in spark.read.text(p("sam")).collect()]
    assert sum(x.startswith("@SQ") for x in lines) == len(records) and any(x.startswith("r2\t4\t*") for x in lines) and any(x.startswith("r1\t0\t") for x in lines)
    main(["align", fa, p("r.fq"), p("sam2"), "--mapped-only"])
    assert not any(x.startswith("r2") for x in (r.value for r in spark.read.text(p("sam2")).collect()))
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "h.01").write_text("ACGT-ACGTACGA\nACGTTACGTACG-\n")
    main(["compress-lines", p("lines"), p("c"), "--chunks", "3", "--reference-size", "1", "--format", "u64"])
    assert spark.read.parquet(p("c/files")).count() >= 6
    main(["compress-taxa", fa, p("t")])
    assert spark.read.parquet(p("t/phrases")).count() > 0


def test_merged_index_by_commands(spark, tmp_path):
    rng = random.Random(4)
    p = lambda x: str(tmp_path / x)
    base = dna(rng, 200)
    both = []
    for k in (0, 1):
        records = [(f"S{k}{i} Genus one chromosome 1, scaffold", base[10 * i :] + dna(rng, 20)) for i in range(3)]
        (tmp_path / f"{k}.fa").write_text("".join(f">{h}\n{s}\n" for h, s in records))
        both += records
        main(["index", p(f"{k}.fa"), p(f"i{k}"), "--max-query-len", "20", "--method", ("lz77", "relative")[k]])
    main(["merge", p("i"), p("i0"), p("i1")])
    main(["merge", p("ii"), p("i"), p("i0")])
    patterns = [base[50:65], both[4][1][-12:], "ACG"]
    (tmp_path / "q.txt").write_text("\n".join(patterns) + "\n")
    for folder, records in (("i", both), ("ii", both + both[:3])):
        main(["find", p(folder), p("q.txt"), p(folder + "found")])
        got = sorted((r.query_id, r.name, r.pos) for r in spark.read.parquet(p(folder + "found")).collect())
        assert got == sorted((q, h.split()[0], i) for q, x in enumerate(patterns) for h, s in records for i in range(len(s)) if s.startswith(x, i))


def test_relative_index_is_small(spark):
    from lzseq.operators import search
    from lzseq.plans import index

    rng = random.Random(5)
    base = dna(rng, 6000)
    seqs = []
    for i in range(60):
        s = list(base)
        for _ in range(4):
            s[rng.randrange(len(s))] = rng.choice("ACGT")
        seqs.append((i, f"S{i} Genus one chromosome 1, {'complete genome' if i < 2 else 'scaffold'}", "".join(s)))
    rows = spark.createDataFrame(seqs, "seq_id long, header string, seq string")
    built = index.over_groups(rows, index.Parameters(max_query_len=24), quotient=0.0, block_chars=40_000)
    total = built.space().selectExpr("sum(kernel_chars) / sum(text_chars)").first()[0]
    assert total < 0.12
    places = [rng.randrange(5900) for _ in range(20)]
    patterns = [(q, seqs[rng.randrange(60)][2][at : at + 24]) for q, at in enumerate(places)]
    got = sorted((r.query_id, r.seq_id, r.seq_pos) for r in search.find_all(built, spark.createDataFrame(patterns, "query_id long, pattern string")).where("fits").collect())
    assert got == sorted((q, i, k) for q, x in patterns for i, _, s in seqs for k in range(len(s)) if s.startswith(x, k))


def test_long_sequences_are_cut(spark):
    from lzseq.operators import search
    from lzseq.plans import index

    rng = random.Random(6)
    seqs = [(i, "g", dna(rng, n)) for i, n in enumerate((0, 1, 99, 100, 101, 1000, 5321))]
    rows = spark.createDataFrame(seqs, "seq_id long, groupname string, seq string")
    built = index.over_sequences(rows, index.Parameters(max_query_len=12), block_chars=100)
    assert built.space().selectExpr("max(text_chars)").first()[0] < 1000
    patterns = list(enumerate([seqs[6][2][at : at + 12] for at in range(80, 120)] + ["ACG", seqs[5][2][-12:], seqs[3][2][88:]]))
    got = sorted((r.query_id, r.seq_id, r.seq_pos) for r in search.find_all(built, spark.createDataFrame(patterns, "query_id long, pattern string")).where("fits").collect())
    assert got == sorted((q, i, k) for q, x in patterns for i, _, s in seqs for k in range(len(s)) if s.startswith(x, k))


def complement(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def similar(rng, groups=2, n=9, length=900):
    """Sequences of groups that differ in a few bases."""
    out = []
    for g in range(groups):
        base = list(dna(rng, length))
        for i in range(n):
            s = base[:]
            for _ in range(5):
                s[rng.randrange(length)] = rng.choice("ACGT")
            out.append((len(out), f"S{len(out)} Genus sp{g} chromosome 1, {'complete genome' if not i else 'scaffold'}", "".join(s)))
    return out


def test_reads_in_an_index_on_both_strands(spark):
    from lzseq.operators import search
    from lzseq.plans import index

    rng = random.Random(7)
    seqs = similar(rng, 2, 4, 2500)
    rows = spark.createDataFrame(seqs, "seq_id long, header string, seq string")
    reads = []
    for q in range(24):
        s, at = rng.choice(seqs)[2], rng.randrange(2400)
        r = list(s[at : at + rng.choice([40, 60])])
        for _ in range(rng.randrange(4)):
            r[rng.randrange(len(r))] = rng.choice("ACGT")
        reads.append((q, complement("".join(r)) if q % 2 else "".join(r)))
    reads += [(100, dna(rng, 50)), (101, ""), (102, None)]
    want = set()
    for q, r in reads:
        for reverse, x in ((False, r or ""), (True, complement(r or ""))):
            for i, _, s in seqs if x else ():
                for at in range(len(s) - len(x) + 1):
                    d = sum(a != b for a, b in zip(x, s[at : at + len(x)]))
                    if d <= 2:
                        want.add((q, reverse, i, at, d))
    pdf = spark.createDataFrame(reads, "query_id long, pattern string")
    left = []
    for built in (index.over_groups(rows, index.Parameters(max_query_len=60), quotient=0.2, block_chars=6000), index.over_sequences(rows.selectExpr("seq_id", "split(header, ' ')[2] groupname", "seq"), index.Parameters(max_query_len=60), block_chars=8000)):
        got = [(r.query_id, r.reverse, r.seq_id, r.seq_pos, r.edits) for r in search.align_index(pdf, built, 15, 2).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        some = {(r.query_id, r.reverse, r.seq_id, r.seq_pos, r.edits) for r in search.align_index(pdf, built, 15, 2, report="NONE").collect()}
        left.append(len(want - some))
        assert some <= {(r.query_id, r.reverse, r.seq_id, r.seq_pos, r.edits) for r in search.align_index(pdf, built, 15, 2, report="LZ").collect()} <= want
    assert left[1] > 0 and search.align_index(pdf.limit(0), built).count() == 0  # copies are found through their sources


def edit_distance(a, b):
    """Of a with any part of b."""
    row = [0] * (len(b) + 1)
    for i, c in enumerate(a, 1):
        new = [i]
        for j, w in enumerate(b, 1):
            new.append(min(row[j - 1] + (c != w), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_gapped_alignment():
    from lzseq.operators.kernels import best_alignment

    rng = random.Random(8)
    for _ in range(400):
        window, most = dna(rng, 30), 3
        at = rng.randrange(2 * most)
        read = list(window[at : at + 20])
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(read))
            rng.choice([lambda: read.pop(k), lambda: read.insert(k, rng.choice("ACGT")), lambda: read.__setitem__(k, rng.choice("ACGT"))])()  # noqa: B023
        read = "".join(read)
        got = best_alignment(read, window[: len(read) + 2 * most], most)
        want = edit_distance(read, window[: len(read) + 2 * most])
        assert (got[2] if got else most + 1) == min(want, most + 1)
        if got:
            start, n, edits, cigar = got
            i, j, cost = 0, start, 0
            for x, op in __import__("re").findall(r"(\d+)([MID])", cigar):
                for _ in range(int(x)):
                    cost += op != "M" or read[i] != window[j]
                    i, j = i + (op != "D"), j + (op != "I")
            assert (i, j, cost) == (len(read), start + n, edits)
    assert best_alignment("ACGT", "AC$GT", 1, "$") is None and best_alignment("ACGT", "A$ACGT", 1, "$") == (2, 4, 0, "4M")


def test_paired_reads_in_a_saved_index(spark, tmp_path):
    rng = random.Random(9)
    seqs = similar(rng, 1, 4)
    p = lambda x: str(tmp_path / x)
    (tmp_path / "a.fa").write_text("".join(f">{h}\n{s}\n" for _, h, s in seqs))
    main(["index", p("a.fa"), p("i"), "--max-query-len", "60", "--max-edit-distance", "3", "--method", "relative"])
    s = seqs[2][2]
    gapped = s[100:125] + s[127:155]
    (tmp_path / "1.fq").write_text(f"@a/1\n{s[200:250]}\n+\n{'I' * 49}J\n@b/1\n{gapped}\n+\n{'I' * len(gapped)}\n@c/1\n{dna(rng, 50)}\n+\n{'I' * 50}\n")
    (tmp_path / "2.fq").write_text(f"@a/2\n{complement(s[400:450])}\n+\n{'I' * 49}J\n@b/2\n{dna(rng, 50)}\n+\n{'I' * 50}\n@c/2\n{dna(rng, 50)}\n+\n{'I' * 50}\n")
    main(["align", p("i"), p("1.fq"), p("sam"), "--mates", p("2.fq"), "--gaps", "--seed", "12"])
    lines = [r.value.split("\t") for r in spark.read.text(p("sam")).collect()]
    assert [x[0] for x in lines[:4]] == ["@SQ"] * 4
    got = {(x[0], int(x[1]) & 192): x for x in lines if not x[0].startswith("@")}
    a1, a2, b1, b2 = got["a", 64], got["a", 128], got["b", 64], got["b", 128]
    assert int(a1[1]) == 1 + 2 + 32 + 64 and int(a2[1]) == 1 + 2 + 16 + 128 and a1[3] == "201" and a2[3] == "401" and a1[7] == "401" and a1[8] == "250" and a2[8] == "-250" and a1[6] == "="
    assert a2[9] == s[400:450] and a2[10] == "J" + "I" * 49 and a1[5] == "50M"
    assert int(b1[1]) & 12 == 8 and b1[3] == "101" and b1[5].count("D") == 1 and "2D" in b1[5] and int(b2[1]) & 12 == 4 and b2[7] == "101"
    assert int(got["c", 64][1]) & 12 == 12
    (tmp_path / "both.fq").write_text("".join(f"@{n}/{m}\n{x}\n+\n{'I' * len(x)}\n" for n, m, x in (("a", 1, s[200:250]), ("a", 2, complement(s[400:450])))))
    main(["align", p("a.fa"), p("both.fq"), p("sam2"), "--interleaved", "--report", "ALL"])
    flags = [int(x[1]) for x in (r.value.split("\t") for r in spark.read.text(p("sam2")).collect()) if x[0] == "a"]
    assert sum(f & 256 == 0 for f in flags) == 2 and len(flags) >= 4


def test_kernels_first_and_index_later(spark, tmp_path):
    rng = random.Random(10)
    records = write_fasta(tmp_path / "a.fa", rng)
    p = lambda x: str(tmp_path / x)
    (tmp_path / "q.txt").write_text("\n".join([records[0][1][5:25], "ACGT", records[7][1][-20:]]) + "\n")
    main(["index", p("a.fa"), p("i"), "--max-query-len", "20"])
    main(["kernelize", p("a.fa"), p("k"), "--max-query-len", "20"])
    assert not (tmp_path / "k" / "kernels").exists()
    main(["index-kernels", p("k")])
    main(["variables", p("k")])
    for folder in ("i", "k"):
        main(["find", p(folder), p("q.txt"), p(folder + "q")])
        main(["find", p(folder), p("q.txt"), p(folder + "v"), "--validate", p("a.fa")])
        assert spark.read.parquet(p(folder + "v")).count() == 0
    read = lambda x: sorted(map(tuple, spark.read.parquet(p(x)).collect()))
    assert read("iq") == read("kq") and len(read("iq")) > 8
    # An index that lost a kernel is found out.
    spark.read.parquet(p("i/kernels")).orderBy("key").limit(1).write.parquet(p("i/few"))
    spark.read.parquet(p("i/few")).write.mode("overwrite").parquet(p("i/kernels"))
    spark.read.parquet(p("i/blocks")).join(spark.read.parquet(p("i/kernels")).select("key"), "key").write.partitionBy("bucket").parquet(p("i/some"))
    spark.read.parquet(p("i/some")).write.mode("overwrite").partitionBy("bucket").parquet(p("i/blocks"))
    main(["find", p("i"), p("q.txt"), p("bad"), "--validate", p("a.fa")])
    lost = spark.read.parquet(p("bad"))
    assert lost.count() and lost.where("in_index or not in_text").count() == 0


def test_index_of_foreign_parses(spark, tmp_path):
    from lzseq.operators.kernels import lz77
    from lzseq.sinks.writers import parse_bytes

    rng = random.Random(11)
    p = lambda x: str(tmp_path / x)
    (tmp_path / "fa").mkdir()
    seqs = {}
    for kind in ("u64", "vbyte"):
        (tmp_path / kind).mkdir()
    for f in ("x", "y"):
        records = write_fasta(tmp_path / "fa" / f"{f}.01.fa", rng, 4)
        for h, s in records:
            seqs.setdefault(f, []).append((h.split()[0], s))
        for kind in ("u64", "vbyte"):
            (tmp_path / kind / f"{f}.01.lz").write_bytes(parse_bytes(*lz77("".join(s for _, s in records).encode()), kind))
    pattern = seqs["y"][2][1][30:50]
    (tmp_path / "q.txt").write_text(pattern + "\nGATT\n")
    want = sorted((q, n, i) for q, x in enumerate((pattern, "GATT")) for f in seqs for n, s in seqs[f] for i in range(len(s)) if s.startswith(x, i))
    for kind in ("u64", "vbyte"):
        main(["index-parsed", p("fa"), p(kind), p("i" + kind), "--max-query-len", "20", "--format", kind])
        main(["find", p("i" + kind), p("q.txt"), p("f" + kind)])
        assert sorted((r.query_id, r.name, r.pos) for r in spark.read.parquet(p("f" + kind)).collect()) == want
    # Parse tools
    main(["merge-parses", p("u64"), p("m")])
    main(["decode", p("m"), p("d")])
    assert spark.read.parquet(p("d")).first().text == "".join(s for f in ("x", "y") for _, s in seqs[f])
    main(["shrink", p("u64"), p("s")])
    main(["decode", p("s"), p("sd"), "--format", "u32"])
    assert sorted(r.text for r in spark.read.parquet(p("sd")).collect()) == sorted("".join(s for _, s in seqs[f]) for f in seqs)
    main(["merge-metadata", p("fa"), p("meta")])
    meta = sorted((r.seq_ix, r.name, r.length) for r in spark.read.parquet(p("meta")).collect())
    assert meta == [(i, n, len(s)) for i, (n, s) in enumerate(seqs["x"] + seqs["y"])]
    (tmp_path / "u64" / "z.01.lz").write_bytes(b"")
    (tmp_path / "u64" / "x.01.lz").write_bytes(parse_bytes(*lz77(b"ACGT"), "u64"))
    with pytest.raises(ValueError, match="characters"):
        main(["index-parsed", p("fa"), p("u64"), p("bad")])


def test_compressed_groups_have_their_sequences_beside(spark, tmp_path):
    rng = random.Random(12)
    records = write_fasta(tmp_path / "a.fa", rng)
    p = lambda x: str(tmp_path / x)
    main(["compress-taxa", p("a.fa"), p("t"), "--format", "vbyte"])
    from lzseq.sources import readers

    got = {r.header: r.seq for r in readers.fasta(spark, p("t/fasta") + "/*").collect()}
    assert got == dict(records)
    main(["compress-fasta", p("a.fa"), p("c"), "--chunks", "5", "--reference-size", "2"])
    phrases, texts = spark.read.parquet(p("c/phrases")), spark.read.parquet(p("c/dictionaries"))
    back = parses.decoded_by_group(phrases, texts, "chunk_ix", ["seq_id"]).groupBy("seq_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_ix", "text"))), lambda x: x["text"]), "").alias("text"))
    assert {r.seq_id: r.text for r in back.collect()} == {i: s for i, (_, s) in enumerate(records)}


def test_readers_and_writers_of_files(spark, tmp_path):
    from lzseq.operators import chunks, records
    from lzseq.sinks import writers
    from lzseq.sources import readers

    p = lambda x: str(tmp_path / x)
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.txt").write_text("ACG\nT")
    (tmp_path / "w" / "b.01").write_text("")
    assert {(r.name, r.text) for r in readers.whole_files(spark, p("w")).collect()} >= {("a.txt", "ACG\nT")}
    assert sorted(r.path.rsplit("/", 1)[1] for r in readers.file_paths(spark, p("w")).collect()) == ["a.txt"]  # empty files have no row
    assert [r.value for r in readers.lines(spark, p("w"), "*.txt").collect()] == ["ACG", "T"]
    (tmp_path / "x.sam").write_text("@SQ\tSN:s\tLN:9\nr1\t16\ts\t6\t42\t2S3M1I\t*\t0\t0\tACGTAC\t*\nbroken line\n\n")
    rows = [tuple(r)[:4] + (r.aligned,) for r in readers.sam(spark, p("x.sam")).collect()]
    assert rows[0] == ("r1", 16, "s", 5, 4) and rows[1][1] is None
    (tmp_path / "x.tsv").write_text("q\ts\t97.5\t50\t1\t0\t1\t50\t3\t52\t1e-5\t88.5\n")
    assert readers.blast6(spark, p("x.tsv")).first().send == 52
    kernels = spark.createDataFrame([("a", "AC$GT"), ("b", "T$")], "key string, kernel string")
    writers.kernel_text(kernels.where("key = 'a'"), p("k"), "Dummy")
    assert sorted(r.value for r in spark.read.text(p("k")).collect()) == [">Dummy", "AC$GT"]
    parts = spark.createDataFrame([("p1", 0, ">old"), ("p1", 1, "AC"), ("p0", 0, "GG"), ("p0", 1, None)], "part string, line_no int, value string")
    merged = writers.merged_kernel_texts(parts, "Dummy").orderBy("part", "line_no").collect()
    assert [r.value for r in merged][:2] == [">Dummy", "GG"] and merged[-1].value == "AC"
    lines = spark.createDataFrame([("f", 0, ">s1 x"), ("f", 1, "ACGT"), ("f", 2, "AC")], "file string, line_no long, value string")
    first = records.cached_metadata(lines, p("meta")).collect()
    assert first == records.cached_metadata(lines.limit(0), p("meta")).collect() and first[0].length == 6
    phrases = spark.createDataFrame([("a b:c/d", 0, 65, 0)], "key string, phrase_ix int, pos long, len long")
    made = writers.parse_files(phrases, f"file://{p('lz')}").first()
    assert made.file.endswith("abc_d.lz") and open(made.file, "rb").read() == bytes([65, *[0] * 15])
    with pytest.raises(Exception):  # noqa: B017
        writers.parse_files(phrases, "nosuch://host/folder").collect()
    texts = spark.createDataFrame([(1, "abcdefghij"), (2, ""), (3, None)], "key long, text string")
    places = spark.createDataFrame([(1, 2, 5), (1, 8, 9), (1, 10, 1), (1, 0, 0), (2, 0, 1), (3, 0, 1), (9, 0, 1)], "key long, at long, n long")
    assert [r.text for r in chunks.read_at(places, chunks.pieces(texts, 3), 3).orderBy("key", "at", "n").collect()] == ["", "cdefg", "ij", None, None, None, None]
