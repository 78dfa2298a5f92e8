"""Queries of readers, writers and whole jobs: what the tables give is written as files into the shared folder and read or worked on there."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import catalogue as T
from .functions import columns as C
from .operators import parses, phrases, records
from .plans import index, jobs
from .sinks import writers
from .sources import byte_ranges, readers


def _md5(column: str):
    return F.md5(F.col(column).cast("binary"))


def add_all(add, in_files) -> None:
    seqs = f"WITH {T._SEQS}"
    body = "list_filter(string_split(regexp_replace(text, '[^A-Za-z\\n]', '', 'g'), chr(10)), lambda x: length(x) > 0)"

    # Readers
    def line_files(s, d):
        rows = T.seqs(s, d).select(F.concat_ws("\t", F.col("seq_id").cast("string"), "seq").alias("value"))
        cells = F.split("value", "\t")
        return in_files(s, lambda f: (rows.write.text(f"{f}/a"), rows.write.csv(f"{f}/b")), lambda f: readers.lines(s, f"{f}/*", "*.txt").select(cells[0].cast("bigint").alias("seq_id"), F.md5(cells[1].cast("binary")).alias("md5"), F.endswith("file", F.lit(".txt")).alias("text_file")))

    add("line_files", line_files, f"{seqs} SELECT seq_id, md5(seq) AS md5, true AS text_file FROM seqs")

    def multi_line(s, d):
        lines = F.filter(F.split(F.regexp_replace("text", "[^A-Za-z\n]", ""), "\n"), lambda x: F.length(x) > 0)
        return T.table(s, d, "documents").select(F.concat(F.lit(">"), F.col("doc_id").cast("string"), F.lit(" x\n"), F.array_join(lines, "\n")).alias("value"))

    add("fasta_first_line", lambda s, d: in_files(s, lambda f: multi_line(s, d).write.text(f), lambda f: readers.fasta(s, f, single_line=True).select("header", _md5("seq").alias("md5"))), f"SELECT CAST(doc_id AS VARCHAR) || ' x' AS header, md5(coalesce({body}[1], '')) AS md5 FROM documents")
    add("fasta_strict", lambda s, d: in_files(s, lambda f: multi_line(s, d).write.text(f), lambda f: readers.fasta(s, f, strict=True, drop_first=True).select("header", _md5("seq").alias("md5"))), f"SELECT substr(CAST(doc_id AS VARCHAR) || ' x', 2) AS header, md5(array_to_string({body}, '')) AS md5 FROM documents")
    add("file_names", lambda s, d: in_files(s, lambda f: T.table(s, d, "documents").select("source", F.col("doc_id").cast("string").alias("value")).write.partitionBy("source").text(f), lambda f: readers.file_paths(s, f"{f}/*").select(F.regexp_extract("path", "source=([^/]*)/", 1).alias("source")).distinct()), "SELECT DISTINCT source FROM documents")

    def whole(s, d):
        rows = T.seqs(s, d).select(F.floor(F.col("seq_id") / 20).alias("bucket"), "seq_id", F.col("seq").alias("value"))
        write = lambda f: rows.repartition("bucket").sortWithinPartitions("bucket", "seq_id").drop("seq_id").write.partitionBy("bucket").text(f)
        return in_files(s, write, lambda f: readers.whole_files(s, f"{f}/*").select(F.regexp_extract("file", "bucket=(\\d+)/", 1).cast("bigint").alias("bucket"), _md5("text").alias("md5")))

    add("whole_files", whole, f"{seqs} SELECT seq_id // 20 AS bucket, md5(string_agg(seq || chr(10), '' ORDER BY seq_id)) AS md5 FROM seqs GROUP BY seq_id // 20")

    def cached(s, d):
        def read(f):
            records.cached_metadata(T.fasta_lines(s, d), f)
            return records.cached_metadata(T.fasta_lines(s, d).limit(0), f)  # found, so not made again

        return in_files(s, lambda f: None, read)

    add("metadata_cache", cached, f"WITH {T._META} SELECT * FROM meta")
    add("block_catalogue", lambda s, d: parses.block_texts(parses.cut_long(T.grouped(s, d).select("seq_id", "groupname", "seq"), 1 << 20, 10), "groupname", 5_000)[1].drop("from"), f"""WITH {T._GROUPED}, total AS (SELECT groupname, greatest(1, CAST(ceil(sum(length(seq)) / 5000) AS BIGINT)) AS n FROM grouped GROUP BY groupname),
dealt AS (SELECT g.groupname || '/' || CAST(seq_id % n AS VARCHAR) AS key, seq_id, length(seq) AS length FROM grouped g JOIN total t ON g.groupname = t.groupname)
SELECT key, row_number() OVER w - 1 AS seq_ix, seq_id, length, (sum(length) OVER w - length)::BIGINT AS start, (sum(length) OVER w)::BIGINT AS "end" FROM dealt WINDOW w AS (PARTITION BY key ORDER BY seq_id)""")
    numbered = f"WITH {T._PHRASE} SELECT key, row_number() OVER (PARTITION BY key ORDER BY phrase_ix) - 1 AS phrase_ix, pos, len FROM phrase"
    for kind in ("u64", "u32"):
        add(f"lz_files_{kind}", lambda s, d, kind=kind: in_files(s, lambda f: writers.parse_files(T.phrase(s, d), f, kind=kind).write.format("noop").mode("overwrite").save(), lambda f: readers.parse_files(s, f, kind).select(C.base_name(F.col("file")).alias("key"), "phrase_ix", "pos", "len")), numbered)
    moved = f"WITH {T._PHRASE}, t AS (SELECT key, sum(greatest(len, 1)) AS chars, count(*) AS n FROM phrase GROUP BY key), m AS (SELECT key, coalesce(sum(chars) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS moved, coalesce(sum(n) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS moved_ix FROM t), nth AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY phrase_ix) - 1 AS ix FROM phrase)"
    add("merged_folder", lambda s, d: in_files(s, lambda f: writers.parse_files(T.phrase(s, d), f).write.format("noop").mode("overwrite").save(), lambda f: readers.merged_parses(s, f, glob="*.lz").select(C.base_name(F.col("part")).alias("part"), "phrase_ix", "pos", "len")), f"{moved} SELECT key AS part, (ix + moved_ix)::BIGINT AS phrase_ix, (CASE WHEN len = 0 THEN pos ELSE pos + moved END)::BIGINT AS pos, len FROM nth JOIN m USING (key)")

    for kind in ("u64", "vbyte"):
        add(f"lz_source_{kind}", lambda s, d, kind=kind: in_files(s, lambda f: writers.parse_files(T.phrase(s, d), f, kind=kind).write.format("noop").mode("overwrite").save(), lambda f: byte_ranges.parse_ranges(s, f, kind, split=1 << 10).select(C.base_name(F.col("file")).alias("key"), "phrase_ix", "pos", "len")), numbered)

    def sequence_bytes(s, d):
        """Letters of sequences out of FASTA files, by the bytes where the files' metadata says that they are."""

        def read(f):
            meta = records.fasta_metadata(jobs.fasta_lines(s, f)).checkpoint()
            doc = F.substring("name", 4, 20).cast("bigint")
            places = meta.where("length > 0").select("file", "seq_ix", "name", (doc * 37 % F.col("length")).alias("at"), (F.lit(1) + doc % 150).alias("n"))
            return byte_ranges.sequence_bytes(places, meta).select("name", "at", "n", _md5("text").alias("md5"))

        return in_files(s, lambda f: writers.fasta(T.seqs(s, d), f), read)

    add("sequence_bytes", sequence_bytes, f"{seqs} SELECT 'ACC' || CAST(seq_id AS VARCHAR) AS name, seq_id * 37 % length(seq) AS \"at\", 1 + seq_id % 150 AS n, md5(substr(seq, CAST(seq_id * 37 % length(seq) + 1 AS BIGINT), CAST(1 + seq_id % 150 AS BIGINT))) AS md5 FROM seqs WHERE length(seq) > 0")

    # Writers
    add("regrouped_fasta", lambda s, d: in_files(s, lambda f: writers.regrouped_fasta(T.grouped(s, d), f), lambda f: readers.fasta(s, f"{f}/*").select(F.regexp_extract("file", "groupname=([^/]*)/", 1).alias("groupname"), "header", _md5("seq").alias("md5"))), f"WITH {T._GROUPED} SELECT groupname, header, md5(seq) AS md5 FROM grouped")
    add("kernel_files", lambda s, d: in_files(s, lambda f: writers.kernel_text(T.seqs(s, d).select(F.col("seq").alias("kernel")), f, "kernel"), lambda f: readers.fasta(s, f).select("header", _md5("seq").alias("md5"))), f"{seqs} SELECT 'kernel' AS header, md5(seq) AS md5 FROM seqs")
    add("text_checks", lambda s, d: T.table(s, d, "documents").select("doc_id", F.md5(C.without_zeros(F.col("text")).cast("binary")).alias("md5"), F.size(F.filter(F.split("text", ""), C.is_newline)).cast("bigint").alias("breaks")), "SELECT doc_id, md5(text) AS md5, length(text) - length(replace(replace(text, chr(10), ''), chr(13), '')) AS breaks FROM documents")

    # Whole jobs
    limited = f"WITH {T._PHRASE}, {T._MERGED}, {T._KERNEL}"
    def fixed_index(s, d):
        rows = phrases.kernel_limits(T.merged(s, d), T._CONTEXT)
        kernels = rows.groupBy("key").agg(F.repeat(F.lit("A"), F.max("k_end").cast("int")).alias("kernel"))
        return index.Index(index.Parameters(max_query_len=T._CONTEXT), rows, kernels, rows.select("key", F.col("phrase_ix").alias("seq_ix"), F.col("phrase_ix").alias("seq_id"), F.col("len").alias("length"), F.col("text_start").alias("start"), F.col("text_end").alias("end"), F.lit(0).cast("bigint").alias("from")))

    add("index_saved", lambda s, d: in_files(s, lambda f: fixed_index(s, d).save(f), lambda f: index.Index.load(s, f).limited), f"{limited} SELECT key, phrase_ix, pos, len, is_literal, text_start, text_end, is_last, k_start, k_end FROM kernel")
    add("index_components", lambda s, d: fixed_index(s, d).components(), f"{limited} SELECT 'limited' AS component, count(*) AS n_rows, sum(strlen(key) + 7 * 8 + 2)::BIGINT AS n_bytes FROM kernel UNION ALL SELECT 'catalogue', count(*), sum(strlen(key) + 6 * 8)::BIGINT FROM kernel UNION ALL SELECT 'kernels', count(*), sum(strlen(key) + n)::BIGINT FROM (SELECT key, max(k_end) AS n FROM kernel GROUP BY key)")

    def fasta_of(rows, f):
        writers.fasta(rows, f)

    def lines_of_patterns(s, d, f):
        T.tiles(s, d).select(F.col("pattern").alias("value")).distinct().write.text(f)

    def found_by(make):
        """Names and places of the distinct patterns in an index that a job makes of FASTA files and another one searches."""

        def run(s, d):
            def write(f):
                fasta_of(T.seqs(s, d).where(F.length("seq") > 0), f"{f}/fasta")
                lines_of_patterns(s, d, f"{f}/patterns")
                make(s, f"{f}/fasta", f"{f}/index")

            def read(f):
                return jobs.find_patterns(s, f"{f}/index", f"{f}/patterns").join(readers.patterns(s, f"{f}/patterns"), "query_id").select("pattern", "name", F.col("pos").cast("bigint").alias("pos"))

            return in_files(s, write, read)

        return run

    parameters = index.Parameters(T._TILE, 0, "")
    named = f"WITH {T._NAIVE} SELECT DISTINCT pattern, 'ACC' || CAST(seq_id AS VARCHAR) AS name, seq_pos AS pos FROM hit JOIN pattern USING (query_id)"
    add("job_index_find", found_by(lambda s, a, b: jobs.index_fasta(s, a, b, parameters)), named)

    def in_halves(s, a, b):
        jobs.kernelize_fasta(s, a, b, parameters, method="relative", block_chars=parses.BLOCK_CHARS)
        jobs.index_kernels(s, b)

    add("job_kernelize", found_by(in_halves), named)

    def validated(s, d):
        """An index of all sequences against the text of those whose id isn't a multiple of 5: what only one of them has."""
        rows = T.seqs(s, d).where(F.length("seq") > 0)

        def write(f):
            fasta_of(rows, f"{f}/fasta")
            fasta_of(rows.where("seq_id % 5 <> 0"), f"{f}/less")
            lines_of_patterns(s, d, f"{f}/patterns")
            jobs.index_fasta(s, f"{f}/fasta", f"{f}/index", parameters)

        def read(f):
            return jobs.find_validated(s, f"{f}/index", f"{f}/patterns", f"{f}/less").join(readers.patterns(s, f"{f}/patterns"), "query_id").select("pattern", "name", "pos", "in_index", "in_text")

        return in_files(s, write, read)

    add("job_validate", validated, f"WITH {T._NAIVE} SELECT DISTINCT pattern, 'ACC' || CAST(seq_id AS VARCHAR) AS name, seq_pos AS pos, true AS in_index, false AS in_text FROM hit JOIN pattern USING (query_id) WHERE seq_id % 5 = 0")

    def compress_lines(s, d):
        """Aligned lines, gaps among them, compressed by stripes and decoded again."""
        rows = T.seqs(s, d).where(F.length("seq") >= T._CHUNKS).select(F.concat(F.lit("-"), F.col("seq"), F.lit("--")).alias("value"))

        def read(f):
            found, texts = jobs.compress_stripes(jobs.aligned_sequences(s, f), T._CHUNKS, 3, runs=True)
            parts = parses.decoded_by_group(found, texts, "chunk_ix", ["seq_id"])
            whole = parts.groupBy("seq_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_ix", "text"))), lambda x: x["text"]), "").alias("text"))
            return whole.select(_md5("text").alias("md5"))

        return in_files(s, lambda f: rows.write.text(f), read)

    add("job_compress_lines", compress_lines, f"{seqs} SELECT md5(seq) AS md5 FROM seqs WHERE length(seq) >= {T._CHUNKS}")

    def compress_taxa(s, d):
        def read(f):
            rows = jobs.fasta_sequences(s, f)
            found, texts = jobs.compress_taxa(rows, runs=True)
            return parses.decoded_by_group(found, texts, "groupname", ["seq_id"]).join(rows.select("seq_id", "header"), "seq_id").select("header", _md5("text").alias("md5"))

        return in_files(s, lambda f: fasta_of(T.seqs(s, d), f), read)

    add("job_compress_fasta", compress_taxa, f"{seqs} SELECT header, md5(seq) AS md5 FROM seqs WHERE length(seq) > 0")

    def by_command(write, *command):
        """What a command makes of written files."""
        from .__main__ import main

        def run(s, d):
            return in_files(s, lambda f: (write(s, d, f"{f}/in"), main([command[0], f"{f}/in", f"{f}/out", *command[1:]])), lambda f: s.read.parquet(f"{f}/out"))

        return run

    decoded = by_command(lambda s, d, f: writers.parse_files(parses.lz77_phrases(T.seqs(s, d).select(F.col("seq_id").alias("key"), F.col("seq").alias("text"))), f, kind="vbyte").write.format("noop").mode("overwrite").save(), "decode", "--format", "vbyte")
    add("command_decode", lambda s, d: decoded(s, d).select(C.base_name(F.col("file")).cast("bigint").alias("seq_id"), _md5("text").alias("md5")), f"{seqs} SELECT seq_id, md5(seq) AS md5 FROM seqs WHERE length(seq) > 0")

    def limits(s, d, f):
        rows = phrases.limits(T.phrase(s, d))
        ends = rows.selectExpr("key part", "row_number() over (partition by key order by phrase_ix) ix", "text_end limit")
        ends.unionByName(rows.selectExpr("key part", "0 ix", "0L limit").distinct()).withColumn("ix", F.col("ix").cast("bigint")).write.parquet(f)

    add("command_merge_limits", by_command(limits, "merge-limits", "--every", "64"), f"WITH {T._PHRASE}, {T._LIMITS}, lim AS (SELECT key AS part, row_number() OVER (PARTITION BY key ORDER BY phrase_ix) AS ix, text_end AS lim FROM limited UNION ALL SELECT DISTINCT key, 0, 0 FROM limited), t AS (SELECT part, max(lim) AS last, count(*) - 1 AS n FROM lim GROUP BY part), m AS (SELECT part, coalesce(sum(last) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS moved, coalesce(sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t), whole AS (SELECT part, ix, (lim + moved)::BIGINT AS \"limit\", (ix + before)::BIGINT AS nth FROM lim JOIN m USING (part)) SELECT * FROM whole WHERE nth % 64 = 0 AND (ix > 0 OR nth = 0)")
