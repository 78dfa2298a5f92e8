import pytest

from lzseq.sources import vcf

VCF = """##fileformat=VCFv4.2
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2
1\t2\t.\tC\tG\t.\t.\t.\tGT\t0|1\t1|1
1\t4\t.\tT\tTAA\t.\t.\t.\tGT:X\t1|0:9\t0|0:9
1\t6\t.\tCGT\tC,<DEL>\t.\t.\t.\tGT\t1|2\t.|0
1\t7\t.\tG\tA\t.\t.\t.\tGT\t1|1\t1|1
1\t10\t.\tC\tT\t.\t.\t.\tGT\t0/1\t0|1
"""


def test_haplotypes(spark, tmp_path):
    (tmp_path / "x.vcf").write_text(VCF)
    names = vcf.samples(spark, str(tmp_path / "x.vcf"))
    assert names == ["S1", "S2"]
    reference = spark.createDataFrame([("1", "ACGTACGTACGT"), ("2", "TT")], "chrom string, seq string")
    got = {(r.chrom, r.chunk_ix, r.name): r.seq for r in vcf.haplotypes(reference, vcf.variants(spark, str(tmp_path / "x.vcf")), names, chunk=8, each=False).collect()}
    assert got["1", 0, "reference"] == "ACGT--ACGT"
    assert got["1", 0, "S1.1"] == "ACGTAAAC--" and got["1", 0, "S1.2"] == "AGGT--ACGT"
    assert got["1", 0, "S2.1"] == "AGGT--ACGT" == got["1", 0, "S2.2"]
    assert got["1", 1, "S2.2"] == "ATGT" and got["1", 1, "S1.2"] == "ACGT"
    assert got["2", 0, "S1.1"] == "TT" and len(got) == 15


HEAD = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\n"


def whole(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r.chunk_ix):
        out[r.name] = out.get(r.name, "") + r.seq
    return out


def test_variants_across_chunk_borders(spark, tmp_path):
    text = "ACGTTGCAACGTTGCAACGTTGCA"
    lines = [(3, text[2:5], "G", "1|0"), (8, "A", "T", "0|1"), (10, text[9:19], "C", "0|1"), (15, "C", "A", "1|1"), (21, "TG", "TAAG", "1|0")]
    (tmp_path / "x.vcf").write_text(HEAD + "".join(f"1\t{p}\t.\t{ref}\t{alt}\t.\t.\t.\tGT\t{gt}\n" for p, ref, alt, gt in lines))
    calls, reference = vcf.variants(spark, str(tmp_path / "x.vcf")), spark.createDataFrame([("1", text)], "chrom string, seq string")
    want = whole(vcf.haplotypes(reference, calls, ["S1"], chunk=100, each=False).collect())
    assert want["S1.1"].replace("-", "") == "ACG" + text[5:20] + "TAAGCA" and want["S1.2"].replace("-", "") == text[:7] + "TAC" + text[19:]
    for chunk in (1, 3, 4, 7, 16):
        rows = vcf.haplotypes(reference, calls, ["S1"], chunk=chunk, each=False).collect()
        assert whole(rows) == want and {r.chunk_ix for r in rows} == set(range(-(-len(text) // chunk)))


def test_overlapping_variants_of_different_haplotypes(spark, tmp_path):
    (tmp_path / "x.vcf").write_text(HEAD + "1\t3\t.\tGTA\tG\t.\t.\t.\tGT\t1|0\n1\t4\t.\tT\tC\t.\t.\t.\tGT\t0|1\n")
    calls, reference = vcf.variants(spark, str(tmp_path / "x.vcf")), spark.createDataFrame([("1", "ACGTACGT")], "chrom string, seq string")
    for chunk in (2, 4, 100):
        got = whole(vcf.haplotypes(reference, calls, ["S1"], chunk=chunk, each=True).collect())
        assert got == {"reference": "ACGTACGT", "S1.1": "ACG--CGT", "S1.2": "ACGCACGT"}


def test_nothing_goes_unsaid(spark, tmp_path):
    lines = [(3, "G", "T", "0|1"), (5, "C", "G", "1|0"), (7, "GT", "G", "0/1"), (7, "G", "C", "1/1"), (12, "TAC", "T", "1|0"), (90, "A", "C", "1|0"), (2, "C", "<DEL>", "1|0")]
    (tmp_path / "x.vcf").write_text(HEAD + "".join(f"1\t{p}\t.\t{ref}\t{alt}\t.\t.\t.\tGT\t{gt}\n" for p, ref, alt, gt in lines) + "7\t1\t.\tA\tC\t.\t.\t.\tGT\t0|1\n")
    calls, reference = vcf.variants(spark, str(tmp_path / "x.vcf")), spark.createDataFrame([("1", "ACGTACGTACGT")], "chrom string, seq string")
    out = {(r.chrom, r.pos, r.reason, r.name) for r in vcf.left_out(reference, calls, ["S1"]).collect()}
    assert out == {("1", 4, "reference differs", None), ("1", 11, "past the end", None), ("1", 89, "past the end", None), ("7", 0, "no such sequence", None), ("1", 6, "unphased", "S1"), ("1", 1, "symbolic", "S1")}
    got = whole(vcf.haplotypes(reference, calls, ["S1"], strict=False).collect())
    assert got["S1.1"].replace("-", "") == "ACGTACCTACGT" and got["S1.2"].replace("-", "") == "ACTTACCTACGT"
    for bad in ("pos = 4", "pos = 11", "pos = 89", "chrom = '7'"):
        with pytest.raises(Exception, match="reference"):
            vcf.haplotypes(reference, calls.where(bad), ["S1"], chunk=4).collect()
