"""python -m lzseq COMMAND: jobs from the command line, under spark-submit or alone."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lzseq", description="Compress, index and search collections of similar sequences.")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name, text, **arguments):
        p = sub.add_parser(name, help=text)
        for key, options in arguments.items():
            p.add_argument(key if options.pop("positional", False) else "--" + key.replace("_", "-"), **options)

    word = lambda **o: dict(positional=True, **o)
    number = lambda default: dict(type=int, default=default)
    command("compress-lines", "relative parses of aligned lines by stripes", path=word(), out=word(), chunks=number(100), reference_size=number(10), format=dict(choices=("table", "u64", "u32", "vbyte"), default="table"))
    command("compress-fasta", "relative parses of FASTA sequences by stripes", path=word(), out=word(), chunks=number(100), reference_size=number(10), format=dict(choices=("table", "u64", "u32", "vbyte"), default="table"))
    command("compress-taxa", "relative parses of FASTA by taxon", path=word(), out=word(), quotient=dict(type=float, default=0.33), most=number(1000), format=dict(choices=("table", "u64", "u32", "vbyte"), default="table"))
    command("index", "an index of FASTA files", path=word(), out=word(), max_query_len=number(100), max_edit_distance=number(0), method=dict(choices=("lz77", "lz77_leftmost", "rlz", "relative"), default="lz77"), prefix_chars=number(None), block_chars=number(262_144))
    command("kernelize", "the tables and kernel texts of an index, without the index", path=word(), out=word(), max_query_len=number(100), max_edit_distance=number(0), method=dict(choices=("lz77", "lz77_leftmost", "rlz", "relative"), default="lz77"), prefix_chars=number(None), block_chars=number(262_144))
    command("index-kernels", "the index of a folder that kernelize made", folder=word())
    command("index-parsed", "an index of FASTA files and their binary parses, paired by name", path=word(), parses=word(), out=word(), max_query_len=number(100), max_edit_distance=number(0), format=dict(choices=("u64", "u32", "vbyte"), default="u64"))
    command("merge", "indexes as one", out=word(), parts=word(nargs="+"))
    command("find", "all places of patterns in an index", index=word(), patterns=word(), out=word(), validate=dict(default=None, metavar="FASTA", help="compare with a scan of the sequences; out has the differences"))
    command("align", "reads in an index or in FASTA sequences as SAM", path=word(), reads=word(), out=word(), mates=dict(default=None), interleaved=dict(action="store_true"), seed=number(20), edits=number(3), gaps=dict(action="store_true"), copies=dict(choices=("ALL", "LZ", "NONE"), default="ALL"), report=dict(choices=("ALL", "BEST"), default="BEST"), mapped_only=dict(action="store_true"))
    command("space", "what an index takes", index=word())
    command("variables", "the parameters of an index", index=word())
    command("merge-parses", "binary parses of parts as one, sources moved", path=word(), out=word(), format=dict(choices=("u64", "u32", "vbyte"), default="u64"))
    command("merge-metadata", "metadata of FASTA files as that of their concatenation", path=word(), out=word())
    command("merge-limits", "limits of parts, a table of (part, ix, limit), as those of the whole, or every so-manyth of them", path=word(), out=word(), every=number(None))
    command("shrink", "parses with numbers of 64 bits as parses with 32", path=word(), out=word())
    command("decode", "texts of binary parses", path=word(), out=word(), format=dict(choices=("u64", "u32", "vbyte"), default="u64"))
    return top


def main(argv: list[str] | None = None) -> None:
    from lzseq.functions import columns as C
    from lzseq.functions.session import exists, shared_folder
    from lzseq.operators import phrases, records
    from lzseq.plans import index, jobs
    from lzseq.sinks import writers
    from lzseq.sources import readers

    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"lzseq {a.command}").getOrCreate()
    shared_folder(spark)
    if a.command.startswith("compress-"):
        if a.command != "compress-taxa":
            seqs = jobs.aligned_sequences(spark, a.path) if a.command == "compress-lines" else jobs.fasta_sequences(spark, a.path)
            phrases, texts = jobs.compress_stripes(seqs, a.chunks, a.reference_size)
        else:
            seqs = jobs.fasta_sequences(spark, a.path).checkpoint()
            phrases, texts = jobs.compress_taxa(seqs, a.quotient, a.most)
            writers.regrouped_fasta(seqs.withColumn("groupname", C.group_key(F.col("header"))), f"{a.out}/fasta")
        group = texts.columns[0]
        texts.write.mode("overwrite").parquet(f"{a.out}/dictionaries")
        if a.format == "table":
            phrases.write.mode("overwrite").parquet(f"{a.out}/phrases")
        else:
            keyed = phrases.select(F.concat_ws("_", C.padded(F.col("seq_id"), 10), F.col(group).cast("string")).alias("key"), "phrase_ix", "pos", "len")
            writers.parse_files(keyed, f"{a.out}/parses", kind=a.format).write.mode("overwrite").parquet(f"{a.out}/files")
    elif a.command in ("index", "kernelize"):
        (jobs.index_fasta if a.command == "index" else jobs.kernelize_fasta)(spark, a.path, a.out, index.Parameters(a.max_query_len, a.max_edit_distance, ""), method=a.method, prefix_chars=a.prefix_chars, block_chars=a.block_chars)
    elif a.command == "index-kernels":
        jobs.index_kernels(spark, a.folder)
    elif a.command == "index-parsed":
        jobs.index_parsed(spark, a.path, a.parses, a.out, index.Parameters(a.max_query_len, a.max_edit_distance, ""), a.format)
    elif a.command == "merge":
        index.merge([index.Index.load(spark, p) for p in a.parts]).save(a.out)
    elif a.command == "find":
        found = jobs.find_validated(spark, a.index, a.patterns, a.validate) if a.validate else jobs.find_patterns(spark, a.index, a.patterns)
        found.write.mode("overwrite").parquet(a.out)
    elif a.command == "align":
        if exists(spark, f"{a.path}/parameters"):
            target = index.Index.load(spark, a.path)
            names = target.names
        else:
            seqs = jobs.fasta_sequences(spark, a.path).checkpoint()
            target, names = seqs.withColumn("name", C.first_token(F.col("header"))), jobs.names_of(seqs)
        lines = jobs.align_reads(readers.fastq(spark, a.reads, a.mates, a.interleaved), target, a.seed, a.edits, a.gaps, a.copies, a.report)
        jobs.sam_file(jobs.mapped_lines(lines) if a.mapped_only else lines, names, a.out)
    elif a.command == "space":
        index.Index.load(spark, a.index).space().show(100, False)
        index.Index.load(spark, a.index).components().show(100, False)
    elif a.command == "variables":
        spark.read.parquet(f"{a.index}/parameters").show(100, False)
    elif a.command == "merge-parses":
        whole = readers.merged_parses(spark, a.path, a.format).withColumn("key", F.lit("merged"))
        writers.parse_files(whole, a.out, kind=a.format).write.format("noop").mode("overwrite").save()
    elif a.command == "merge-metadata":
        lines = jobs.fasta_lines(spark, a.path).checkpoint()
        sizes = lines.groupBy("file").agg(F.sum(F.length("value") + 1).alias("file_len"))
        records.merged_metadata(records.fasta_metadata(lines).join(sizes, "file")).write.mode("overwrite").parquet(a.out)
    elif a.command == "merge-limits":
        phrases.merge_limits(spark.read.parquet(a.path), a.every).write.mode("overwrite").parquet(a.out)
    elif a.command == "shrink":
        rows = readers.parse_files(spark, a.path, "u64").select(C.base_name(F.col("file")).alias("key"), "phrase_ix", C.low_32_bits(F.col("pos")).alias("pos"), C.low_32_bits(F.col("len")).alias("len"))
        writers.parse_files(rows, a.out, kind="u32").write.format("noop").mode("overwrite").save()
    elif a.command == "decode":
        readers.decoded_files(spark, a.path, a.format).write.mode("overwrite").parquet(a.out)


if __name__ == "__main__":
    main()
