"""Phased VCF: typed variants, and aligned haplotype sequences of a reference, chunk by chunk."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The leading columns of a VCF.
FIXED = ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format")


def samples(spark: SparkSession, path: str) -> list[str]:
    """Sample names of the header line; all files of a path must share it."""
    heads = spark.read.text(path).where(F.startswith("value", F.lit("#CHROM"))).distinct().take(2)
    if len(heads) != 1:
        raise ValueError(f"{path}: one header line is needed")
    return heads[0][0].rstrip("\r").split("\t")[len(FIXED) :]


def variants(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos from 0, ref, alts, genotypes) of each record; genotypes are the samples' GT fields in the header's order."""
    cells = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    rows = spark.read.text(path).where(~F.startswith("value", F.lit("#")) & (F.length("value") > 0))
    cell = lambda name: F.get(cells, F.lit(FIXED.index(name)))
    gt = F.transform(F.slice(cells, len(FIXED) + 1, F.greatest(F.lit(0), F.size(cells) - len(FIXED))), lambda x: F.substring_index(x, ":", 1))
    return rows.select(cell("chrom").alias("chrom"), (cell("pos").cast("bigint") - 1).alias("pos"), cell("ref").alias("ref"), F.split(cell("alt"), ",").alias("alts"), gt.alias("genotypes"))


def left_out(reference: DataFrame, calls: DataFrame, names: list[str]) -> DataFrame:
    """(chrom, pos, ref, reason, name) of what haplotypes() can't apply: `no such sequence`, `past the end` and `reference differs` for a record (name is null), `unphased` and `symbolic` for a sample's call."""
    known = reference.select("chrom", "seq")
    rows = calls.join(known, "chrom", "left")
    there = F.substring("seq", (F.col("pos") + 1).cast("int"), F.length("ref"))
    reason = F.when(F.col("seq").isNull(), "no such sequence").when((F.col("pos") < 0) | (F.col("pos") + F.length("ref") > F.length("seq")), "past the end").when(F.upper(there) != F.upper("ref"), "reference differs")
    records = rows.select("chrom", "pos", "ref", reason.alias("reason"), F.lit(None).cast("string").alias("name")).where("reason is not null")
    one = calls.select("chrom", "pos", "ref", "alts", F.explode(F.arrays_zip(F.array(*map(F.lit, names)).alias("name"), F.col("genotypes").alias("gt"))).alias("x")).select("chrom", "pos", "ref", "alts", "x.name", "x.gt")
    numbers = F.transform(F.split("gt", r"[|/]"), lambda x: x.try_cast("int"))
    called = F.filter(F.transform(numbers, lambda k: F.get("alts", k - 1)), lambda a: a.isNotNull())
    unphased = F.contains("gt", F.lit("/")) & (F.size(F.array_distinct(F.split("gt", "/"))) > 1) & (F.size(called) > 0)
    why = F.when(unphased, "unphased").when(F.exists(called, lambda a: ~a.rlike("^[A-Za-z]+$")), "symbolic")
    return records.unionByName(one.select("chrom", "pos", "ref", why.alias("reason"), "name").where("reason is not null"))


def haplotypes(reference: DataFrame, calls: DataFrame, names: list[str], chunk: int = 65_536, each: bool = True, strict: bool = True) -> DataFrame:
    """(chrom, chunk_ix, name, seq): the reference (chrom, seq) and every phased haplotype, aligned with - over equal columns.

    Work is dealt by chunks of the reference; a variant belongs to the chunk of its first base. Where one reaches past its
    chunk, the chunk's seq reaches as far, the next one starts behind it, and these chunks are one piece of work; so the
    whole sequences don't depend on chunk. Every haplotype takes its own variants, and two that overlap on one haplotype
    raise; without each, a variant that overlaps one before it is left out, for all haplotypes. A variant whose ref isn't
    what the reference has there, or that reaches past its end, raises; without strict it is left out. An
    allele that is missing or symbolic, or of an unphased call with two alleles, is the reference's. left_out() lists all that.
    """
    if not names:
        raise ValueError("no samples")
    ix = lambda c: F.floor(c / chunk).cast("bigint")
    reach = ix(F.col("pos") + F.greatest(F.length("ref"), F.lit(1)) - 1)
    joined = calls.where(reach > ix(F.col("pos"))).select("chrom", F.explode(F.sequence(ix(F.col("pos")) + 1, reach)).alias("i")).groupBy("chrom").agg(F.collect_set("i").alias("joined"))
    n = ix(F.greatest(F.length("seq") - 1, F.lit(0))) + 1
    heads = F.array_except(F.sequence(F.lit(0).cast("bigint"), n - 1), F.coalesce("joined", F.array().cast("array<bigint>")))
    pieces = F.transform("heads", lambda x, i: F.struct(x.alias("chunk_ix"), F.coalesce(F.get("heads", i + 1), "n").alias("stop")))
    split = reference.join(F.broadcast(joined), "chrom", "left").select("chrom", "seq", n.alias("n"), heads.alias("heads")).select("chrom", "seq", F.explode(pieces).alias("p")).select("chrom", "seq", "p.*")
    parts = split.select("chrom", "chunk_ix", (F.col("stop") - F.col("chunk_ix")).cast("int").alias("n_chunks"), F.substring("seq", (F.col("chunk_ix") * chunk + 1).cast("int"), ((F.col("stop") - F.col("chunk_ix")) * chunk).cast("int")).alias("text"))
    later = split.where("stop > chunk_ix + 1").select("chrom", F.col("chunk_ix").alias("head"), F.explode(F.sequence(F.col("chunk_ix") + 1, F.col("stop") - 1)).alias("i")).distinct()
    placed = calls.withColumn("i", ix(F.col("pos"))).join(F.broadcast(later), ["chrom", "i"], "left").withColumn("chunk_ix", F.coalesce("head", "i"))
    by_chunk = placed.groupBy("chrom", "chunk_ix").agg(F.array_sort(F.collect_list(F.struct((F.col("pos") - F.col("chunk_ix") * chunk).alias("at"), "ref", "alts", "genotypes"))).alias("calls"))
    rows = parts.join(by_chunk, ["chrom", "chunk_ix"], "left")
    if strict:  # records of no chunk
        lost = by_chunk.join(split.select("chrom", "chunk_ix"), ["chrom", "chunk_ix"], "left_anti").select("chrom", "chunk_ix").take(1)
        if lost:
            raise ValueError(f"{lost[0][0]}: a variant lies outside the reference, near {lost[0][1] * chunk}")

    def allele(genotype: str, k: int, ref: str, alts: list[str]) -> str:
        called = genotype.split("|")
        if "/" in genotype and len(set(genotype.split("/"))) == 1:
            called = genotype.split("/")
        if k >= len(called) or not called[k].isdigit() or not 0 < int(called[k]) <= len(alts):
            return ref
        alt = alts[int(called[k]) - 1]
        return alt if alt.isalpha() else ref

    every = ["reference", *(f"{n}.{k + 1}" for n in names for k in (0, 1))]

    def own(text: str, group: list[tuple[int, str, dict]], name: str, start: int, end: int, where: str) -> str:
        """text[start:end] with the alleles of a haplotype."""
        out, at = [], start
        for a, ref, chosen in group:
            alt = chosen.get(name, ref)
            if alt.upper() == ref.upper() and len(group) > 1:
                continue
            if a < at:
                raise ValueError(f"{where}: variants that overlap on haplotype {name}")
            out += [text[at:a], alt]
            at = a + len(ref)
        return "".join(out) + text[at:end]

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                text, found = batch.column("text")[r].as_py(), batch.column("calls")[r].as_py() or []
                chrom, first, n_chunks = (batch.column(c)[r].as_py() for c in ("chrom", "chunk_ix", "n_chunks"))
                groups: list[tuple[int, int, list]] = []  # start, end and variants that overlap each other
                for v in found:
                    a, ref = v["at"], v["ref"]
                    overlaps = bool(groups) and a < groups[-1][1]
                    if a + len(ref) > len(text) or text[a : a + len(ref)].upper() != ref.upper():
                        if strict:
                            raise ValueError(f"{chrom}:{first * chunk + a + 1}: the reference doesn't have {ref} there")
                        continue
                    if overlaps and not each:
                        continue
                    one = (a, ref, {f"{n}.{k + 1}": allele(g, k, ref, v["alts"]) for n, g in zip(names, v["genotypes"]) for k in (0, 1)})
                    if overlaps:
                        start, end, others = groups.pop()
                        groups.append((start, max(end, a + len(ref)), [*others, one]))
                    else:
                        groups.append((a, a + len(ref), [one]))
                at, i = 0, 0
                for k in range(n_chunks):
                    lines: dict[str, list[str]] = {name: [] for name in every}
                    border = len(text) if k == n_chunks - 1 else (k + 1) * chunk
                    while i < len(groups) and groups[i][0] < border:
                        start, end, group = groups[i]
                        seqs = {name: own(text, group, name, start, end, f"{chrom}:{first * chunk + start + 1}") for name in every}
                        width = max(map(len, seqs.values()))
                        for name, parts_of in lines.items():
                            parts_of += [text[at:start], seqs[name].ljust(width, "-")]
                        at, i = end, i + 1
                    rest = text[at:border]
                    at = max(at, border)
                    seqs_of = ["".join(x) + rest for x in lines.values()]
                    yield pa.RecordBatch.from_arrays([pa.array([chrom] * len(lines), pa.string()), pa.array([first + k] * len(lines), pa.int64()), pa.array(list(lines)), pa.array(seqs_of, pa.string())], names=["chrom", "chunk_ix", "name", "seq"])

    return rows.select("chrom", "chunk_ix", "n_chunks", "text", "calls").mapInArrow(run, "chrom string, chunk_ix bigint, name string, seq string")
