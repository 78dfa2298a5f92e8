"""Whole jobs from files to files: compression by stripes or taxa, indexing, merging, finding and aligning."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.session import keep, remove, scratch, shared_folder
from ..operators import chunks, dictionaries, parses, search
from ..sources import readers
from . import index


def aligned_sequences(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, header, raw, seq) of aligned lines: the file is the header, gaps go; ids follow files and places in them."""
    rows = readers.lines(spark, path).withColumn("nth", F.monotonically_increasing_id())
    rows = rows.select(F.substring_index("file", "/", -1).alias("header"), "nth", F.col("value").alias("raw"))
    return chunks.dense_ids(rows, ["header", "nth"], "seq_id").select("seq_id", "header", "raw", C.ungapped(F.col("raw")).alias("seq"))


def fasta_sequences(spark: SparkSession, path: str, **options) -> DataFrame:
    """(seq_id, header, raw, seq) of FASTA records; ids follow files and places in them."""
    rows = readers.fasta(spark, path, **options).withColumn("nth", F.monotonically_increasing_id())
    return chunks.dense_ids(rows, ["file", "nth"], "seq_id").select("seq_id", "header", F.col("seq").alias("raw"), C.ungapped(F.col("seq")).alias("seq"))


def fasta_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) of FASTA files' lines, numbered over the files in the order of their names."""
    return readers.numbered_lines(spark, path).select("file", F.col("line").alias("line_no"), "value")


def compress_stripes(seqs: DataFrame, n_chunks: int, reference_size: int, repeat_first: bool = False, leftmost: bool = True, runs: bool = False) -> tuple[DataFrame, DataFrame]:
    """(phrases, dictionaries) of chunks relative to their stripe's first chunks: (chunk_ix, seq_id, phrase_ix, pos, len) and (chunk_ix, dictionary). runs: phrases as parses.phrase_runs() has them.

    A stripe's dictionary is bounded by reference_size chunks; its chunks are dealt over tasks, not gathered in one.
    """
    shared_folder(seqs.sparkSession)
    cut = chunks.fixed_chunks(seqs, n_chunks, "raw").checkpoint()  # dictionaries and blocks go over them several times each
    selection = dictionaries.stripe_selection(cut, reference_size, repeat_first)
    ordered = F.array_sort(F.collect_list(F.struct("dict_ord", "chunk")))
    texts = selection.groupBy("chunk_ix").agg(F.array_join(F.transform(ordered, lambda x: x["chunk"]), "").alias("dictionary")).checkpoint()
    return parses.rlz_by_group(cut.select("chunk_ix", "seq_id", F.col("chunk").alias("seq")), texts, "chunk_ix", ["seq_id"], leftmost, runs=runs), texts


def compress_taxa(seqs: DataFrame, quotient: float = dictionaries.QUOTIENT, most: int = dictionaries.MOST, leftmost: bool = True, runs: bool = False) -> tuple[DataFrame, DataFrame]:
    """(phrases, dictionaries) of sequences relative to their group's dictionary: (groupname, seq_id, phrase_ix, pos, len) and (groupname, dictionary). runs: phrases as parses.phrase_runs() has them."""
    shared_folder(seqs.sparkSession)
    seqs = seqs.select("seq_id", "header", "seq").checkpoint()  # dictionaries and blocks go over them several times each
    named = seqs.withColumn("groupname", C.group_key(F.col("header")))
    texts = dictionaries.texts(dictionaries.taxon_selection(seqs, quotient, most), seqs).withColumnRenamed("text", "dictionary").checkpoint()
    return parses.rlz_by_group(named.select("groupname", "seq_id", "seq"), texts, "groupname", ["seq_id"], leftmost, runs=runs), texts


def index_fasta(spark: SparkSession, path: str, out: str, parameters: index.Parameters, search: bool = True, **options) -> None:
    """Builds an index of FASTA files, grouped by taxon and chromosome, and saves it, with its search structure or without. What lies between files and index goes at the end."""
    with scratch(spark):
        with scratch(spark):  # what numbers the sequences goes when they are numbered
            seqs = keep(fasta_sequences(spark, path).select("seq_id", "header", C.without_zeros(F.col("seq")).alias("seq"), C.group_key(F.col("header")).alias("groupname")), outer=True)
        if options.get("method") == "relative":
            built = index.over_groups(seqs, parameters, block_chars=options["block_chars"], kept=True)
        else:
            built = index.over_sequences(seqs.select("seq_id", "groupname", "seq"), parameters, kept=True, **options)
        built.names = names_of(seqs)
        built.save(out, search)


def names_of(seqs: DataFrame) -> DataFrame:
    """(seq_id, name, length) of sequences (seq_id, header, seq)."""
    return seqs.select("seq_id", C.first_token(F.col("header")).alias("name"), F.length("seq").cast("bigint").alias("length"))


def paired_texts(spark: SparkSession, fasta: str, parse: str, kind: str = "u64") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(texts, catalogue, phrases, names) of FASTA files and their binary parses, paired by base name: a file is one text, its sequences one after the other.

    A file without a parse, or a parse without a file, raises; so does a parse that isn't as long as its text.
    """
    from pyspark.sql import Window

    rows = readers.fasta(spark, fasta).withColumn("nth", F.monotonically_increasing_id()).withColumn("key", C.base_name(F.col("file")))
    seqs = chunks.dense_ids(rows.select("key", "nth", "header", "seq"), ["key", "nth"], "seq_id").select("seq_id", "key", "header", C.without_zeros(F.col("seq")).alias("seq")).checkpoint()
    phrases = readers.parse_files(spark, parse, kind).select(C.base_name(F.col("file")).alias("key"), "phrase_ix", "pos", "len").checkpoint()
    sizes = seqs.groupBy("key").agg(F.sum(F.length("seq")).alias("chars")).join(phrases.groupBy("key").agg(F.sum(F.greatest("len", F.lit(1).cast("bigint"))).alias("said")), "key", "full").where("chars is null or said is null or chars <> said").take(1)
    if sizes:
        raise ValueError(f"{sizes[0]['key']}: the text has {sizes[0]['chars']} characters, its parse {sizes[0]['said']}")
    length = F.length("seq").cast("bigint")
    w = Window.partitionBy("key").orderBy("seq_id")
    end = F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, 0))
    catalogue = seqs.select("key", (F.row_number().over(w) - 1).cast("bigint").alias("seq_ix"), "seq_id", length.alias("length"), (end - length).alias("start"), end.alias("end"), F.lit(0).cast("bigint").alias("from"))
    ordered = F.array_sort(F.collect_list(F.struct("seq_id", "seq")))
    texts = seqs.groupBy("key").agg(F.array_join(F.transform(ordered, lambda x: x["seq"]), "").alias("text"))
    return texts, catalogue, phrases, names_of(seqs)


def index_parsed(spark: SparkSession, fasta: str, parse: str, out: str, parameters: index.Parameters, kind: str = "u64") -> None:
    """Builds and saves an index of FASTA files from parses that were made elsewhere."""
    texts, catalogue, phrases, names = paired_texts(spark, fasta, parse, kind)
    built = index.build(texts.checkpoint(), catalogue.checkpoint(), parameters, parsed=phrases)
    built.names = names
    built.save(out)


def kernelize_fasta(spark: SparkSession, path: str, out: str, parameters: index.Parameters, **options) -> None:
    """The first half of index_fasta: all tables but the kernels, and the kernels as FASTA text, to be indexed elsewhere or by index_kernels()."""
    from ..sinks import writers

    index_fasta(spark, path, out, parameters, False, **options)
    writers.fasta(index.Index.load(spark, out).kernels, f"{out}/text", "key", "kernel")
    for name in ("kernels", *index.SPLIT_BY):
        remove(spark, f"{out}/{name}")


def index_kernels(spark: SparkSession, folder: str) -> None:
    """The second half: the kernels' table and search structure from their text in a folder of kernelize_fasta()."""
    kernels = readers.fasta(spark, f"{folder}/text").select(F.col("header").alias("key"), F.col("seq").alias("kernel"))
    kernels.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/kernels")
    replace(index.Index.load(spark, folder), blocks=None, directory=None).save_search(folder)


def find_validated(spark: SparkSession, folder: str, patterns: str, fasta: str) -> DataFrame:
    """(query_id, name, pos, m, in_index, in_text) of places that an index and a scan of the sequences themselves don't both find; no rows if the index is right."""
    found = find_patterns(spark, folder, patterns).select("query_id", "name", F.col("pos").cast("bigint").alias("pos"), F.col("m").cast("bigint").alias("m")).withColumn("in_index", F.lit(True))
    seqs = readers.fasta(spark, fasta).withColumn("seq", C.ungapped(F.col("seq")))
    most = index.Index.load(spark, folder).parameters.max_query_len
    plain = search.located(seqs.select(C.first_token(F.col("header")).alias("key"), F.col("seq").alias("kernel")), readers.patterns(spark, patterns), most)
    plain = plain.select("query_id", F.col("key").alias("name"), "pos", "m").withColumn("in_text", F.lit(True))
    both = found.join(plain, ["query_id", "name", "pos", "m"], "full")
    return both.select("query_id", "name", "pos", "m", F.coalesce("in_index", F.lit(False)).alias("in_index"), F.coalesce("in_text", F.lit(False)).alias("in_text")).where("not (in_index and in_text)")


def find_patterns(spark: SparkSession, folder: str, patterns: str) -> DataFrame:
    """(query_id, name, pos, m) of all places of the patterns of a file in a saved index."""
    loaded = index.Index.load(spark, folder)
    found = search.find_all(loaded, readers.patterns(spark, patterns))
    names = loaded.names.select("seq_id", "name")
    return found.where("fits").join(names, "seq_id").select("query_id", "name", F.col("seq_pos").alias("pos"), "m")


def align_reads(reads: DataFrame, target: index.Index | DataFrame, seed: int = 20, edits: int = 3, gaps: bool = False, copies: str = "ALL", report: str = "BEST", insert: int = 1000) -> DataFrame:
    """SAM lines (value) of reads (name, seq, qual, mate) in an index with names or in sequences (seq_id, name, seq), on both strands.

    copies (ALL, LZ, NONE) says which copies an index follows. report ALL gives every place, the best one first and
    others flagged 256; BEST the best only; ties go to the first place. A read that is nowhere has one unmapped line. The
    mapping quality is 42 for a single best place, else 1. Reads with mates 1 and 2 of one name are paired: each says
    where the other's best place is, and both are flagged 2 if they face each other within `insert` characters.
    """
    from pyspark.sql import Window

    if report not in ("ALL", "BEST"):
        raise ValueError("report is ALL or BEST")
    shared_folder(reads.sparkSession)
    reads = reads if "mate" in reads.columns else reads.withColumn("mate", F.lit(1))
    reads = reads.withColumn("query_id", F.xxhash64("seq"))
    patterns = reads.select("query_id", F.upper("seq").alias("pattern")).distinct()
    if isinstance(target, index.Index):
        hits = search.align_index(patterns, target, seed, edits, gaps, copies)
        names = target.names.select("seq_id", F.col("name").alias("rname"))
    else:
        hits = search.aligned(patterns, target.select(F.col("seq_id").alias("key"), F.col("seq").alias("text")), seed, edits, gaps).withColumnsRenamed({"key": "seq_id", "pos": "seq_pos"})
        names = target.select("seq_id", F.col("name").alias("rname"))
    w = Window.partitionBy("query_id")
    order = ("edits", "seq_id", "seq_pos", "reverse", "n")
    ranked = hits.withColumn("rank", F.row_number().over(w.orderBy(*order))).withColumn("ties", F.sum((F.col("edits") == F.min("edits").over(w)).cast("int")).over(w))
    ranked = ranked.where("rank = 1" if report == "BEST" else "true").join(names, "seq_id").withColumn("mapq", F.when(F.col("ties") == 1, 42).otherwise(1))
    rows = reads.join(ranked.drop("ties"), "query_id", "left").checkpoint()
    best = rows.where("rank = 1 or rank is null").groupBy("name", F.when(F.col("mate") == 1, 2).otherwise(1).alias("mate")).agg(F.first(F.struct("rname", "seq_pos", "n", "reverse", "seq_id")).alias("o"))
    return rows.join(best, ["name", "mate"], "left").select(_sam_line(insert).alias("value"))


def _sam_line(insert: int):
    """The line of a read's place beside its mate's best one, o."""
    c, o = F.col, (lambda k: F.col("o").getField(k))
    here, there, paired = c("seq_pos").isNotNull(), o("seq_pos").isNotNull(), c("o").isNotNull()
    same = here & there & (c("seq_id") == o("seq_id"))
    low, high = F.least("seq_pos", o("seq_pos")), F.greatest(c("seq_pos") + c("n"), o("seq_pos") + o("n"))
    facing = same & (c("reverse") != o("reverse")) & (F.when(c("reverse"), o("seq_pos") <= c("seq_pos")).otherwise(c("seq_pos") <= o("seq_pos"))) & (high - low <= insert)
    bit = lambda when, value: F.when(F.coalesce(when, F.lit(False)), value).otherwise(0)
    flag = bit(paired, 1) + bit(facing, 2) + bit(~here, 4) + bit(paired & ~there, 8) + bit(c("reverse"), 16) + bit(paired & o("reverse"), 32) + bit(paired & (c("mate") == 1), 64) + bit(paired & (c("mate") == 2), 128) + bit(c("rank") > 1, 256)
    size = F.when(same, F.when((c("seq_pos") < o("seq_pos")) | ((c("seq_pos") == o("seq_pos")) & (c("mate") == 1)), high - low).otherwise(low - high)).otherwise(0)
    turned = F.coalesce(c("reverse"), F.lit(False))
    text = lambda x: x.cast("string")
    next_name = F.when(~F.coalesce(there, F.lit(False)), "*").when(F.coalesce(same, F.lit(False)), "=").otherwise(o("rname"))
    cells = [
        c("name"), text(flag), F.coalesce("rname", F.lit("*")), text(F.coalesce(c("seq_pos") + 1, F.lit(0))), text(F.coalesce("mapq", F.lit(0))), F.coalesce("cigar", F.lit("*")),
        next_name, text(F.coalesce(o("seq_pos") + 1, F.lit(0))), text(size), F.when(turned, C.reverse_complement(c("seq"))).otherwise(c("seq")), F.coalesce(F.when(turned, F.reverse("qual")).otherwise(c("qual")), F.lit("*")),
    ]
    return F.when(~here & ~paired, C.unmapped_record(c("name"))).otherwise(F.concat_ws("\t", *cells))


def sam_file(lines: DataFrame, names: DataFrame, path: str) -> None:
    """Writes SAM lines under a header of the sequences (seq_id, name, length)."""
    from ..sinks import writers

    writers.sam(lines, names.withColumnRenamed("seq_id", "seq_ix"), path)


def mapped_lines(lines: DataFrame) -> DataFrame:
    """Record lines whose unmapped bit isn't set."""
    flag = F.get(F.split("value", "\t"), F.lit(1)).try_cast("int")
    return lines.where(~F.startswith("value", F.lit("@")) & C.mapped(flag))


__all__ = ["align_reads", "aligned_sequences", "compress_stripes", "compress_taxa", "fasta_sequences", "find_patterns", "find_validated", "index_fasta", "index_kernels", "index_parsed", "kernelize_fasta", "mapped_lines", "names_of", "paired_texts", "sam_file"]
