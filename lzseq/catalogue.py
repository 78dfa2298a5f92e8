"""The library's queries over the driver's tables, and their SQL.

Sequences are all documents, whole: letters as bases, headers made from the columns. Phrase tables that SQL must follow
come from the events of a user, in order: an error is a literal, another event a copy of floor(value) characters.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import columns as C
from .functions.session import remove, remove_by_task, shared_folder, spread
from .operators import chunks, dictionaries, parses, phrases, ranges, records, search, suffixes
from .plans import index, jobs
from .sinks import writers
from .sources import readers, vcf
from .streaming import align

_HEADER = "'ACC' || CAST(doc_id AS VARCHAR) || ' ' || lang || ' ' || source || ' chromosome ' || CAST(doc_id % 3 AS VARCHAR) || CASE WHEN doc_id % 5 = 0 THEN ', complete genome' ELSE ', scaffold' END"
_SEQS = f"seqs AS (SELECT doc_id AS seq_id, {_HEADER} AS header, text AS raw, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{C.LETTERS}', '{C.BASES}') AS seq FROM documents)"
_TAXON = "CASE WHEN len(string_split(header, ' ')) >= 3 THEN regexp_replace(string_split(header, ' ')[2], '[^A-Za-z0-9]', '', 'g') || regexp_replace(string_split(header, ' ')[3], '[^A-Za-z0-9]', '', 'g') WHEN len(string_split(header, ' ')) = 2 THEN regexp_replace(string_split(header, ' ')[2], '[^A-Za-z0-9]', '', 'g') ELSE regexp_replace(string_split(header, ' ')[1], '[^A-Za-z0-9]', '', 'g') END"
_CHR = "CASE WHEN contains(lower(header), 'chromosome') THEN 'chr' || regexp_replace(split_part(split_part(lower(header), 'chromosome', 2), ',', 1), '[^a-z0-9]', '', 'g') ELSE '' END"
_GROUPED = f"{_SEQS}, grouped AS (SELECT *, left({_TAXON} || '_' || {_CHR}, 200) AS groupname, contains(lower(header), 'complete genome') AS complete FROM seqs)"
_PHRASE = "phrase AS (SELECT 'u' || CAST(user_id AS VARCHAR) AS key, event_id AS phrase_ix, event_id % 97 AS pos, CASE WHEN event_type = 'error' THEN 0 ELSE CAST(floor(value) AS BIGINT) END AS len FROM events)"
_CHUNKS, _CONTEXT, _WIDTH, _PIECE_CONTEXT = 8, 10, 40, 6
_LIMITS = "limited AS (SELECT *, coalesce(sum(greatest(len, 1)) OVER (PARTITION BY key ORDER BY phrase_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS text_start, (sum(greatest(len, 1)) OVER (PARTITION BY key ORDER BY phrase_ix))::BIGINT AS text_end FROM phrase)"
_CHUNK = f"widths AS (SELECT *, greatest(1, length(raw) // {_CHUNKS}) AS w FROM seqs WHERE length(seq) > 0), chunk AS (SELECT seq_id, unnest(range(0, CAST(ceil(length(seq) / w) AS BIGINT))) AS ix, seq, w FROM widths), cut AS (SELECT seq_id, CAST(ix AS INTEGER) AS chunk_ix, substr(seq, ix * w + 1, w) AS chunk FROM chunk)"
_MERGED = f"""runs0 AS (SELECT *, greatest(len, 1) AS n, greatest(len, 1) > {2 * _CONTEXT} AS is_long FROM phrase),
runs1 AS (SELECT *, coalesce(is_long OR lag(is_long) OVER (PARTITION BY key ORDER BY phrase_ix), true) AS starts FROM runs0),
runs2 AS (SELECT *, sum(CAST(starts AS BIGINT)) OVER (PARTITION BY key ORDER BY phrase_ix) - 1 AS run FROM runs1),
runs3 AS (SELECT key, run::BIGINT AS phrase_ix, max_by(pos, phrase_ix) AS pos, sum(n)::BIGINT AS len, NOT bool_or(is_long) OR (run = 0 AND min_by(len, phrase_ix) <> 0) AS is_literal FROM runs2 GROUP BY key, run),
merged AS (SELECT *, (sum(len) OVER (PARTITION BY key ORDER BY phrase_ix) - len)::BIGINT AS text_start, (sum(len) OVER (PARTITION BY key ORDER BY phrase_ix))::BIGINT AS text_end FROM runs3)"""
_KERNEL = f"""k0 AS (SELECT *, lead(phrase_ix) OVER (PARTITION BY key ORDER BY phrase_ix) IS NULL AS is_last FROM merged),
k1 AS (SELECT *, CASE WHEN is_last THEN CASE WHEN len <= {_CONTEXT} OR is_literal THEN len ELSE {_CONTEXT + 2} END ELSE CASE WHEN len < {2 * _CONTEXT + 2} OR is_literal THEN len ELSE {2 * _CONTEXT + 1} END END AS k_len FROM k0),
kernel AS (SELECT *, (sum(k_len) OVER (PARTITION BY key ORDER BY phrase_ix) - k_len)::BIGINT AS k_start, (sum(k_len) OVER (PARTITION BY key ORDER BY phrase_ix))::BIGINT AS k_end FROM k1)"""
_FASTA = "record AS (SELECT seq_id, header || chr(10) || seq AS value FROM seqs)"
_META = """line0 AS (SELECT 'f' || CAST(doc_id % 7 AS VARCHAR) AS file, doc_id, unnest(list_concat(['>' || 'ACC' || CAST(doc_id AS VARCHAR) || ' ' || lang], list_filter(string_split(regexp_replace(text, '[^A-Za-z\\n]', '', 'g'), chr(10)), lambda x: length(x) > 0))) AS value, generate_subscripts(list_concat(['>'], list_filter(string_split(regexp_replace(text, '[^A-Za-z\\n]', '', 'g'), chr(10)), lambda x: length(x) > 0)), 1) AS sub FROM documents),
line AS (SELECT file, doc_id * 1000000 + sub AS line_no, value FROM line0),
line1 AS (SELECT *, starts_with(value, '>') AS h, (sum(length(value) + 1) OVER (PARTITION BY file ORDER BY line_no) - length(value) - 1)::BIGINT AS pl FROM line),
line2 AS (SELECT *, (sum(CAST(h AS BIGINT)) OVER (PARTITION BY file ORDER BY line_no) - 1)::BIGINT AS seq_ix FROM line1),
meta AS (SELECT file, seq_ix, max(CASE WHEN h THEN regexp_extract(value, '^>(\\S+)', 1) END) AS name, coalesce(sum(CASE WHEN NOT h THEN length(value) END), 0)::BIGINT AS length, max(CASE WHEN h THEN pl END) AS header_sp, max(CASE WHEN h THEN pl + length(value) END) AS header_ep, CASE WHEN sum(CAST(NOT h AS INTEGER)) > 1 THEN min_by(length(value), line_no) FILTER (NOT h) END AS line_len FROM line2 GROUP BY file, seq_ix)"""
_SAM = "rec AS (SELECT event_id, 'r' || CAST(event_id AS VARCHAR) AS qname, CAST(CASE event_type WHEN 'error' THEN 4 WHEN 'click' THEN 256 ELSE 0 END AS INTEGER) AS flag, 'u' || CAST(user_id AS VARCHAR) AS key, event_id * 7 % 5000 AS pos, CASE WHEN event_type = 'error' THEN '*' ELSE CAST(event_id % 9 AS VARCHAR) || 'S' || CAST(10 + event_id % 31 AS VARCHAR) || 'M' || CAST(event_id % 4 AS VARCHAR) || 'D' || CAST(event_id % 3 AS VARCHAR) || 'I' || '5=' END AS cigar FROM events)"
_ALIGNED = "list_sum(list_transform(regexp_extract_all(cigar, '(\\d+)[MIX=]', 1), lambda x: CAST(x AS BIGINT)))"
_TILE, _READ = 24, 64
_PATTERNS = f"pattern AS (SELECT item_id * 1000 + i AS query_id, substr(b, CAST(i * {_TILE} + 1 AS BIGINT), {_TILE}) AS pattern FROM (SELECT item_id, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{C.LETTERS}', '{C.BASES}') AS b, unnest(range(0, length(b) // {_TILE})) AS i FROM benchmark))"
_NAIVE = f"{_SEQS}, {_PATTERNS}, place AS (SELECT seq_id, seq, unnest(range(0, length(seq) - {_TILE - 1})) AS p FROM seqs), hit AS (SELECT query_id, seq_id, p AS seq_pos FROM place JOIN pattern ON substr(seq, p + 1, {_TILE}) = pattern)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seqs(spark, sf_dir) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    suffix = F.when(F.col("doc_id") % 5 == 0, ", complete genome").otherwise(", scaffold")
    header = F.concat(F.lit("ACC"), F.col("doc_id").cast("string"), F.lit(" "), "lang", F.lit(" "), "source", F.lit(" chromosome "), (F.col("doc_id") % 3).cast("string"), suffix)
    return d.select(F.col("doc_id").alias("seq_id"), header.alias("header"), F.col("text").alias("raw"), C.as_bases(F.col("text")).alias("seq"))


def grouped(spark, sf_dir) -> DataFrame:
    return seqs(spark, sf_dir).withColumn("groupname", C.group_key(F.col("header")))


def phrase(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    n = F.when(F.col("event_type") == "error", 0).otherwise(F.floor("value")).cast("bigint")
    return e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"), F.col("event_id").alias("phrase_ix"), (F.col("event_id") % 97).alias("pos"), n.alias("len"))


def merged(spark, sf_dir) -> DataFrame:
    return phrases.merge_short(phrase(spark, sf_dir), _CONTEXT)


def tiles(spark, sf_dir) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select("item_id", C.as_bases(F.col("text")).alias("b"))
    return search.seeds(b.select(F.col("item_id").alias("query_id"), F.col("b").alias("pattern")), _TILE).select((F.col("query_id") * 1000 + F.col("offset") / _TILE).cast("bigint").alias("query_id"), F.col("seed").alias("pattern"))


def sequence_index(spark, sf_dir) -> index.Index:
    return index.over_sequences(grouped(spark, sf_dir), index.Parameters(max_query_len=_TILE))


def fasta_lines(spark, sf_dir) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    body = F.filter(F.split(C.letters_and_breaks(F.col("text")), "\n"), lambda x: F.length(x) > 0)
    rows = F.concat(F.array(F.concat(F.lit(">ACC"), F.col("doc_id").cast("string"), F.lit(" "), "lang")), body)
    return d.select(F.concat(F.lit("f"), (F.col("doc_id") % 7).cast("string")).alias("file"), "doc_id", F.posexplode(rows).alias("sub", "value")).select("file", (F.col("doc_id") * 1000000 + F.col("sub") + 1).alias("line_no"), "value")


def sam_records(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    flag = F.when(F.col("event_type") == "error", 4).when(F.col("event_type") == "click", 256).otherwise(0)
    text = lambda c: c.cast("string")
    cigar = F.when(F.col("event_type") == "error", "*").otherwise(F.concat(text(i % 9), F.lit("S"), text(10 + i % 31), F.lit("M"), text(i % 4), F.lit("D"), text(i % 3), F.lit("I5=")))
    star, zero = F.lit("*"), F.lit(0)
    return e.select(i.alias("event_id"), F.concat(F.lit("r"), text(i)).alias("qname"), flag.cast("int").alias("flag"), F.concat(F.lit("u"), text(F.col("user_id"))).alias("key"), (i * 7 % 5000).alias("pos"), cigar.alias("cigar")).select(
        "*", F.col("key").alias("rname"), F.lit(42).alias("mapq"), star.alias("rnext"), zero.alias("pnext"), zero.alias("tlen"), star.alias("seq"), star.alias("qual")
    )


def _digest(column: str):
    return F.md5(F.col(column).cast("binary"))


def entries() -> dict:
    """name: (function of (spark, sf_dir), SQL or None)."""
    from . import catalogue_files

    q: dict = {}

    def add(name, run, sql=None):
        q[name] = (run, sql)

    # Sources, projections, filters
    def fasta_split(s, d):
        rows = seqs(s, d).select("seq_id", F.concat("header", F.lit("\n"), "seq").alias("value"))
        return readers.fasta_records(rows).select("seq_id", "header", _digest("seq").alias("seq_md5"))

    add("fasta_split", fasta_split, f"WITH {_SEQS}, {_FASTA} SELECT seq_id, split_part(value, chr(10), 1) AS header, md5(split_part(value, chr(10), 2)) AS seq_md5 FROM record")
    add("header_names", lambda s, d: seqs(s, d).select("seq_id", C.first_token(F.col("header")).alias("name"), C.file_safe(F.col("header")).alias("file_name"), C.padded(F.col("seq_id"), 4).alias("padded")), f"WITH {_SEQS} SELECT seq_id, regexp_extract(header, '^(\\S+)', 1) AS name, translate(header, ' :', '') AS file_name, CASE WHEN length(CAST(seq_id AS VARCHAR)) >= 4 THEN CAST(seq_id AS VARCHAR) ELSE lpad(CAST(seq_id AS VARCHAR), 4, '0') END AS padded FROM seqs")
    add("ungap", lambda s, d: table(s, d, "documents").select("doc_id", C.ungapped(F.translate("text", "aeiou ", "------")).alias("u")).select("doc_id", _digest("u").alias("md5"), F.length("u").alias("n")), "SELECT doc_id, md5(u) AS md5, CAST(length(u) AS INTEGER) AS n FROM (SELECT doc_id, replace(translate(text, 'aeiou ', '------'), '-', '') AS u FROM documents)")
    add("fixed_chunks", lambda s, d: chunks.fixed_chunks(seqs(s, d), _CHUNKS, "raw").select("seq_id", "chunk_ix", "length", _digest("chunk").alias("md5")), f"WITH {_SEQS}, {_CHUNK} SELECT seq_id, chunk_ix, CAST(length(chunk) AS INTEGER) AS length, md5(chunk) AS md5 FROM cut")

    def global_id(s, d):
        return chunks.dense_ids(seqs(s, d).select("header", "seq_id"), ["header", "seq_id"]).select("id", "seq_id")

    add("global_id", global_id, f"WITH {_SEQS} SELECT row_number() OVER (ORDER BY header, seq_id) - 1 AS id, seq_id FROM seqs")
    add("taxon_key", lambda s, d: grouped(s, d).select("seq_id", C.taxon(F.col("header")).alias("taxon"), C.chromosome(F.col("header")).alias("chr"), "groupname"), f"WITH {_GROUPED} SELECT seq_id, {_TAXON} AS taxon, {_CHR} AS chr, groupname FROM grouped")
    add("complete_sequences", lambda s, d: seqs(s, d).where(C.is_complete(F.col("header"))).select("seq_id", "header"), f"WITH {_SEQS} SELECT seq_id, header FROM seqs WHERE contains(lower(header), 'complete genome')")
    add("pattern_rejects", lambda s, d: search.rejected(table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("pattern")), 200).select("query_id", F.length("pattern").alias("n")), "SELECT item_id AS query_id, CAST(length(text) AS INTEGER) AS n FROM benchmark WHERE text IS NULL OR length(text) = 0 OR length(text) > 200")
    add("separator_choice", lambda s, d: phrases.separator(table(s, d, "documents")), "WITH c AS (SELECT unnest(list_concat([36, 35], list_concat(range(32, 127), list_concat(range(128, 255), range(31, 0, -1))))) AS code), r AS (SELECT chr(CAST(code AS INTEGER)) AS c, row_number() OVER () AS rank FROM c), used AS (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM documents) SELECT min_by(c, rank) AS separator FROM r WHERE c NOT IN (SELECT c FROM used)")
    add("first_symbols", lambda s, d: seqs(s, d).select("seq_id", F.explode(C.first_places(F.col("seq"), "ACGT")).alias("symbol", "first")), f"WITH {_SEQS} SELECT seq_id, symbol, CAST(instr(seq, symbol) - 1 AS INTEGER) AS first FROM seqs, (VALUES ('A'), ('C'), ('G'), ('T')) t(symbol) WHERE instr(seq, symbol) > 0")

    # Groups and dictionaries
    add("stripe_groups", lambda s, d: chunks.stripe_groups(chunks.fixed_chunks(seqs(s, d), _CHUNKS, "raw")), f"WITH {_SEQS}, {_CHUNK} SELECT chunk_ix, count(*) AS n, sum(length(chunk))::BIGINT AS total FROM cut GROUP BY chunk_ix")
    add("taxon_groups", lambda s, d: chunks.taxon_groups(seqs(s, d)), f"WITH {_GROUPED} SELECT groupname, count(*) AS n, sum(length(seq))::BIGINT AS total, sum(CAST(complete AS BIGINT))::BIGINT AS n_complete FROM grouped GROUP BY groupname")
    rule = "CASE WHEN n < 15 THEN n ELSE least(CAST(floor(n * 0.33) AS BIGINT), 1000) END"
    add("dict_size_rule", lambda s, d: grouped(s, d).where(~C.is_complete(F.col("header"))).groupBy("groupname").agg(F.count(F.lit(1)).alias("n")).select("groupname", "n", dictionaries.size_rule(F.col("n")).alias("take")), f"WITH {_GROUPED} SELECT groupname, n, {rule} AS take FROM (SELECT groupname, count(*) AS n FROM grouped WHERE NOT complete GROUP BY groupname)")
    stripe = f"WITH {_SEQS}, {_CHUNK}, ranked AS (SELECT chunk_ix, seq_id, chunk, row_number() OVER (PARTITION BY chunk_ix ORDER BY seq_id) AS dict_ord FROM cut)"
    add("dict_select_stripe", lambda s, d: dictionaries.stripe_selection(chunks.fixed_chunks(seqs(s, d), _CHUNKS, "raw"), 5).select("chunk_ix", "dict_ord", "seq_id", "length"), f"{stripe} SELECT chunk_ix, CAST(dict_ord AS INTEGER) AS dict_ord, seq_id, CAST(length(chunk) AS INTEGER) AS length FROM ranked WHERE dict_ord <= 5")
    taxon = f"WITH {_GROUPED}, counted AS (SELECT *, count(*) FILTER (NOT complete) OVER (PARTITION BY groupname) AS n, row_number() OVER (PARTITION BY groupname, complete ORDER BY CASE WHEN complete THEN 0 ELSE -length(seq) END, seq_id) AS rank FROM grouped), chosen AS (SELECT *, row_number() OVER (PARTITION BY groupname ORDER BY complete DESC, rank) AS dict_ord FROM counted WHERE CASE WHEN complete THEN rank <= 1000 ELSE rank <= {rule} END)"
    add("dict_select_taxon", lambda s, d: dictionaries.taxon_selection(seqs(s, d)), f"{taxon} SELECT groupname, CAST(dict_ord AS INTEGER) AS dict_ord, seq_id, CAST(length(seq) AS INTEGER) AS length, complete FROM chosen")
    add("dict_offsets", lambda s, d: dictionaries.offsets(dictionaries.taxon_selection(seqs(s, d))).select("groupname", "seq_id", "dict_start", "dict_end"), f"{taxon} SELECT groupname, seq_id, (sum(length(seq)) OVER (PARTITION BY groupname ORDER BY dict_ord) - length(seq))::BIGINT AS dict_start, (sum(length(seq)) OVER (PARTITION BY groupname ORDER BY dict_ord))::BIGINT AS dict_end FROM chosen")
    add("dict_text", lambda s, d: dictionaries.texts(dictionaries.taxon_selection(seqs(s, d)), seqs(s, d)).select("groupname", _digest("text").alias("md5"), F.length("text").alias("n")), f"{taxon} SELECT groupname, md5(string_agg(seq, '' ORDER BY dict_ord)) AS md5, CAST(length(string_agg(seq, '' ORDER BY dict_ord)) AS INTEGER) AS n FROM chosen GROUP BY groupname")

    # Parses of whole sequences; SQL can't follow a greedy parse over whole texts, but what is decoded again
    def texts_of(s, d):
        return seqs(s, d).select(F.col("seq_id").alias("key"), F.col("seq").alias("text"))

    def relative(s, d, runs=False):
        g = grouped(s, d).select("groupname", "seq_id", "header", "seq")
        return jobs.compress_taxa(g, runs=runs)

    def rlz_decode(s, d):
        p, texts = relative(s, d, runs=True)
        return parses.decoded_by_group(p, texts, "groupname", ["seq_id"]).select("seq_id", _digest("text").alias("md5"))

    full = f"WITH {_SEQS} SELECT seq_id, md5(seq) AS md5 FROM seqs WHERE length(seq) > 0"
    add("suffix_array", lambda s, d: parses.suffix_arrays(texts_of(s, d).withColumn("key", F.col("key").cast("string"))).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("rank") * F.col("suffix")).alias("weight")))
    add("lz77_phrases", lambda s, d: parses.lz77_phrases(texts_of(s, d), leftmost=True))
    add("lz77_decode", lambda s, d: parses.decoded(parses.lz77_phrases(texts_of(s, d)), ["key"]).select(F.col("key").alias("seq_id"), _digest("text").alias("md5")), full)
    add("rlz_phrases", lambda s, d: relative(s, d)[0])
    add("rlz_decode", rlz_decode, full)
    add("parse_statistics", lambda s, d: phrases.statistics(parses.lz77_phrases(texts_of(s, d))).select("key", "n_chars"), f"WITH {_SEQS} SELECT seq_id AS key, length(seq)::BIGINT AS n_chars FROM seqs WHERE length(seq) > 0")

    # The same kernels on short texts, where SQL can follow them step by step
    short = lambda s, d: spread(table(s, d, "part").select(F.col("p_partkey").cast("string").alias("key"), F.col("p_name").alias("text"), F.col("p_type").alias("dictionary")))
    _SHORT = "short AS (SELECT CAST(p_partkey AS VARCHAR) AS key, p_name AS text, p_type AS dictionary FROM part)"
    suffix = f"WITH {_SHORT}, suffix AS (SELECT key, unnest(range(0, length(text))) AS i, text FROM short), ranked AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY substr(text, i + 1)) - 1 AS rank, i AS suffix, substr(text, i + 1) AS rest FROM suffix)"
    add("suffix_array_short", lambda s, d: parses.suffix_arrays(short(s, d)), f"{suffix} SELECT key, rank, suffix FROM ranked")
    add("lcp_short", lambda s, d: parses.lcp_arrays(short(s, d)), f"{suffix}, pair AS (SELECT key, rank, rest, lag(rest) OVER (PARTITION BY key ORDER BY rank) AS before FROM ranked) SELECT key, rank, CASE WHEN before IS NULL THEN 0 ELSE CAST(len(list_filter(range(1, least(length(rest), length(before)) + 1), lambda n: left(rest, n) = left(before, n))) AS BIGINT) END AS lcp FROM pair")

    def longest(within: str, name: str) -> str:
        """A CTE of every place i of the short texts with the longest part from there that `within` has: n characters, found at `found` from 1."""
        return f"{name} AS (SELECT key, i, text, coalesce(max(n) FILTER (found > 0), 0) AS n, coalesce(max_by(found, n) FILTER (found > 0), 0) AS found FROM (SELECT key, i, text, n, instr({within}, substr(text, i + 1, n)) AS found FROM (SELECT *, unnest(range(1, length(text) - i + 1)) AS n FROM (SELECT *, unnest(range(0, length(text))) AS i FROM short))) GROUP BY key, i, text)"

    def greedy(within: str) -> str:
        """SQL of a greedy parse: the phrases from the start on."""
        return f"""WITH RECURSIVE {_SHORT}, {longest(within, "longest")},
step AS (SELECT key, i, n, CASE WHEN n = 0 THEN CAST(ascii(substr(text, i + 1, 1)) AS BIGINT) ELSE found - 1 END AS pos FROM longest),
chain AS (SELECT key, CAST(0 AS BIGINT) AS phrase_ix, i, pos, n FROM step WHERE i = 0 UNION ALL SELECT c.key, c.phrase_ix + 1, s.i, s.pos, s.n FROM chain c JOIN step s ON s.key = c.key AND s.i = c.i + greatest(c.n, 1)),
phrase AS (SELECT key, phrase_ix, CAST(pos AS BIGINT) AS pos, CAST(n AS BIGINT) AS len FROM chain)"""

    before = "left(text, i + n - 1)"  # where a part of n characters at i begins earlier; it may run into itself
    earlier, other = greedy(before), greedy("dictionary")
    stats = "SELECT key, count(*) AS n_phrases, sum(CAST(len = 0 AS BIGINT))::BIGINT AS n_literals, sum(CAST(len > 0 AS BIGINT))::BIGINT AS n_copies, sum(greatest(len, 1))::BIGINT AS n_chars, max(len) AS longest FROM phrase GROUP BY key"
    add("lz77_short", lambda s, d: parses.lz77_phrases(short(s, d), leftmost=True), f"{earlier} SELECT * FROM phrase")
    add("rlz_short", lambda s, d: parses.rlz_phrases(short(s, d).withColumnRenamed("text", "seq"), ["key"]), f"{other} SELECT * FROM phrase")
    add("longest_parts_short", lambda s, d: parses.longest_parts(short(s, d)), f"WITH {_SHORT}, {longest(before, 'previous')}, {longest('dictionary', 'matching')} SELECT key, i AS \"at\", CAST(p.n AS BIGINT) AS previous, CAST(m.n AS BIGINT) AS matching FROM previous p JOIN matching m USING (key, i)")
    add("bwt_short", lambda s, d: parses.transforms(short(s, d)).select("key", _digest("bwt").alias("md5")), f"{suffix} SELECT key, md5(right(text, 1) || coalesce(string_agg(CASE WHEN suffix = 0 THEN chr(0) ELSE substr(text, suffix, 1) END, '' ORDER BY rank), '')) AS md5 FROM (SELECT r.key, rank, suffix, text FROM ranked r JOIN short s ON r.key = s.key) GROUP BY key, text")
    # The same by rounds over many tasks
    head = 4
    add("suffix_order", lambda s, d: suffixes.ordered(short(s, d), head).ranks, f"{suffix} SELECT key, rank, suffix FROM ranked")
    add("lcp_order", lambda s, d: suffixes.common_prefixes(suffixes.ordered(short(s, d), head)), q["lcp_short"][1])
    add("bwt_order", lambda s, d: suffixes.transformed(suffixes.ordered(short(s, d), head)), f"{suffix} SELECT key, rank + 1 AS row, CASE WHEN suffix = 0 THEN chr(0) ELSE substr(text, suffix, 1) END AS symbol FROM (SELECT r.key, rank, suffix, text FROM ranked r JOIN short s ON r.key = s.key) UNION ALL SELECT key, 0, right(text, 1) FROM short WHERE length(text) > 0")
    add("matches_order", lambda s, d: suffixes.matches(short(s, d), head).select("key", "at", "len"), f"WITH {_SHORT}, {longest('dictionary', 'matching')} SELECT key, i AS \"at\", CAST(n AS BIGINT) AS len FROM matching")
    add("lz77_decode_rounds", lambda s, d: parses.decoded_by_rounds(parses.lz77_phrases(short(s, d))).select("key", "part", "text"), f"WITH {_SHORT} SELECT key, 0 AS part, text FROM short WHERE length(text) > 0")
    add("parse_statistics_short", lambda s, d: phrases.statistics(parses.lz77_phrases(short(s, d))), f"{earlier} {stats}")

    # Phrase tables
    add("phrase_limits", lambda s, d: phrases.limits(phrase(s, d)), f"WITH {_PHRASE}, {_LIMITS} SELECT * FROM limited")
    add("phrase_stats", lambda s, d: phrases.statistics(phrase(s, d)), f"WITH {_PHRASE} SELECT key, count(*) AS n_phrases, sum(CAST(len = 0 AS BIGINT))::BIGINT AS n_literals, sum(CAST(len > 0 AS BIGINT))::BIGINT AS n_copies, sum(greatest(len, 1))::BIGINT AS n_chars, max(len) AS longest FROM phrase GROUP BY key")
    add("merge_short_phrases", merged, f"WITH {_PHRASE}, {_MERGED} SELECT * FROM merged")
    add("grid", lambda s, d: phrases.grid(merged(s, d)), f"WITH {_PHRASE}, {_MERGED} SELECT key, pos AS x, pos + len AS x_end, phrase_ix, text_start FROM merged WHERE NOT is_literal")
    add("kernel_limits", lambda s, d: phrases.kernel_limits(merged(s, d), _CONTEXT), f"WITH {_PHRASE}, {_MERGED}, {_KERNEL} SELECT key, phrase_ix, pos, len, is_literal, text_start, text_end, is_last, k_start, k_end FROM kernel")
    add("kernel_length", lambda s, d: phrases.kernel_limits(merged(s, d), _CONTEXT).groupBy("key").agg(F.max("k_end").alias("kernel_chars")), f"WITH {_PHRASE}, {_MERGED}, {_KERNEL} SELECT key, max(k_end) AS kernel_chars FROM kernel GROUP BY key")
    add("limits_sample", lambda s, d: phrases.sampled(phrases.limits(phrase(s, d)), 512), f"WITH {_PHRASE}, {_LIMITS} SELECT * FROM limited WHERE phrase_ix % 512 = 0")
    add("limit_differences", lambda s, d: phrases.differences(phrases.limits(phrase(s, d)), "text_end", "phrase_ix").select("key", "phrase_ix", F.col("difference").alias("n")), f"WITH {_PHRASE}, {_LIMITS} SELECT key, phrase_ix, greatest(len, 1) AS n FROM limited")
    add("shrink_ints", lambda s, d: phrase(s, d).select("key", "phrase_ix", C.low_32_bits(F.col("pos") * 1234567890123).alias("pos")), f"WITH {_PHRASE} SELECT key, phrase_ix, (pos * 1234567890123) & 4294967295 AS pos FROM phrase")

    def kernel_text(s, d):
        t = seqs(s, d).where(F.length("seq") > 0).select(F.col("seq_id").cast("string").alias("key"), F.col("seq").alias("text"))
        n = F.length("text")
        rows = t.select("key", n.cast("bigint").alias("n"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(n / _WIDTH) - 1)).alias("phrase_ix"))
        start = F.col("phrase_ix") * _WIDTH
        m = rows.select("key", "phrase_ix", F.lit(0).cast("bigint").alias("pos"), F.least(F.lit(_WIDTH).cast("bigint"), F.col("n") - start).alias("len"), (F.col("phrase_ix") % 3 == 0).alias("is_literal"), start.alias("text_start"), F.least(start + _WIDTH, F.col("n")).alias("text_end"))
        return phrases.kernels_of(phrases.kernel_limits(m, _PIECE_CONTEXT), t, _PIECE_CONTEXT).select("key", _digest("kernel").alias("md5"), F.length("kernel").alias("n"))

    c = _PIECE_CONTEXT
    add("kernel_text", kernel_text, f"WITH {_SEQS}, t AS (SELECT CAST(seq_id AS VARCHAR) AS key, seq AS text FROM seqs WHERE length(seq) > 0), p0 AS (SELECT key, text, unnest(range(0, CAST(ceil(length(text) / {_WIDTH}) AS BIGINT))) AS i FROM t), p1 AS (SELECT *, substr(text, i * {_WIDTH} + 1, {_WIDTH}) AS w, (i + 1) * {_WIDTH} >= length(text) AS is_last FROM p0), p2 AS (SELECT key, i, CASE WHEN i % 3 = 0 OR (is_last AND length(w) <= {c}) OR (NOT is_last AND length(w) < {2 * c + 2}) THEN w WHEN is_last THEN substr(w, 1, {c + 1}) || '$' ELSE substr(w, 1, {c}) || '$' || right(w, {c}) END AS piece FROM p1) SELECT key, md5(string_agg(piece, '' ORDER BY i)) AS md5, CAST(length(string_agg(piece, '' ORDER BY i)) AS INTEGER) AS n FROM p2 GROUP BY key")

    # Merging of parts
    add("merge_parses", lambda s, d: phrases.merge_parts(phrase(s, d).withColumnRenamed("key", "part")), f"WITH {_PHRASE}, t AS (SELECT key, sum(greatest(len, 1)) AS chars, count(*) AS n FROM phrase GROUP BY key), m AS (SELECT key, coalesce(sum(chars) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS moved, coalesce(sum(n) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS moved_ix FROM t) SELECT key AS part, (phrase_ix + moved_ix)::BIGINT AS phrase_ix, (CASE WHEN len = 0 THEN pos ELSE pos + moved END)::BIGINT AS pos, len FROM phrase JOIN m USING (key)")
    limit_rows = "lim AS (SELECT key AS part, row_number() OVER (PARTITION BY key ORDER BY phrase_ix) AS ix, text_end AS lim FROM limited UNION ALL SELECT DISTINCT key, 0, 0 FROM limited)"

    def limit_table(s, d):
        rows = phrases.limits(phrase(s, d))
        ends = rows.select(F.col("key").alias("part"), F.row_number().over(Window.partitionBy("key").orderBy("phrase_ix")).cast("bigint").alias("ix"), F.col("text_end").alias("limit"))
        zeros = rows.select(F.col("key").alias("part"), F.lit(0).cast("bigint").alias("ix"), F.lit(0).cast("bigint").alias("limit")).distinct()
        return ends.unionByName(zeros)

    add("merge_limits", lambda s, d: phrases.merge_limits(limit_table(s, d)), f"WITH {_PHRASE}, {_LIMITS}, {limit_rows}, t AS (SELECT part, max(lim) AS last FROM lim GROUP BY part), m AS (SELECT part, coalesce(sum(last) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS moved, row_number() OVER (ORDER BY part) AS nth FROM t) SELECT part, ix, (lim + moved)::BIGINT AS \"limit\" FROM lim JOIN m USING (part) WHERE nth = 1 OR ix > 0")

    def metadata(s, d):
        return records.fasta_metadata(fasta_lines(s, d))

    def with_size(s, d):
        lines = fasta_lines(s, d)
        return records.fasta_metadata(lines).join(lines.groupBy("file").agg(F.sum(F.length("value") + 1).cast("bigint").alias("file_len")), "file")

    add("fasta_metadata", metadata, f"WITH {_META} SELECT * FROM meta")
    add("merge_metadata", lambda s, d: records.merged_metadata(with_size(s, d)), f"WITH {_META}, size AS (SELECT file, sum(length(value) + 1) AS bytes, sum(CAST(h AS BIGINT)) AS n FROM line2 GROUP BY file), m AS (SELECT file, coalesce(sum(bytes) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS moved, coalesce(sum(n) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS moved_ix FROM size) SELECT file, (seq_ix + moved_ix)::BIGINT AS seq_ix, name, length, (header_sp + moved)::BIGINT AS header_sp, (header_ep + moved)::BIGINT AS header_ep FROM meta JOIN m USING (file)")
    add("seqpos_to_filepos", lambda s, d: metadata(s, d).where("length > 0").select("file", "seq_ix", records.file_position(F.col("header_ep"), F.col("line_len"), F.col("length") - 1).alias("at")), f"WITH {_META} SELECT file, seq_ix, CASE WHEN line_len IS NULL THEN header_ep + length ELSE header_ep + 1 + (length - 1) % line_len + ((length - 1) // line_len) * (line_len + 1) END AS at FROM meta WHERE length > 0")
    add("in_header", lambda s, d: records.in_header(table(s, d, "events").select(F.concat(F.lit("f"), (F.col("user_id") % 7).cast("string")).alias("file"), (F.col("event_id") * 13).alias("at")), metadata(s, d)), f"WITH {_META}, place AS (SELECT 'f' || CAST(user_id % 7 AS VARCHAR) AS file, event_id * 13 AS at FROM events) SELECT p.file, p.at, m.seq_ix FROM place p JOIN meta m ON p.file = m.file AND p.at >= m.header_sp AND p.at <= m.header_ep")

    # Range joins
    hits = lambda s, d: table(s, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"), F.col("event_id").alias("query_id"), (F.col("event_id") * 31 % 900).alias("pos"), (F.lit(3) + F.col("event_id") % 8).alias("m"))
    hit_sql = "hit AS (SELECT 'u' || CAST(user_id AS VARCHAR) AS key, event_id AS query_id, event_id * 31 % 900 AS pos, 3 + event_id % 8 AS m FROM events)"
    add("kernel_to_text", lambda s, d: search.primary(hits(s, d), phrases.kernel_limits(merged(s, d), _CONTEXT), aligned=True, bin_size=64), f"WITH {_PHRASE}, {_MERGED}, {_KERNEL}, {hit_sql} SELECT h.key, query_id, text_end - (k_end - h.pos) AS pos, m, (k_end <= h.pos + m - 1 OR is_literal) AS crossing FROM hit h JOIN kernel k ON h.key = k.key AND k_start <= h.pos AND h.pos < k_end")
    add("secondary_direct", lambda s, d: ranges.copies_of(hits(s, d).withColumn("pos", F.col("pos") % 120), phrases.grid(merged(s, d)), 64), f"WITH {_PHRASE}, {_MERGED}, {hit_sql} SELECT h.key, query_id, text_start + h.pos % 120 - g.pos AS pos, m FROM hit h JOIN merged g ON h.key = g.key AND NOT g.is_literal AND g.pos <= h.pos % 120 AND h.pos % 120 + m <= g.pos + g.len")
    place_sql = f"WITH {_PHRASE}, {_LIMITS}, {hit_sql} SELECT h.key, query_id, h.pos, m, phrase_ix AS seq_id, h.pos - text_start AS seq_pos, h.pos + m <= text_end AS fits FROM hit h JOIN limited l ON h.key = l.key AND text_start <= h.pos AND h.pos < text_end"
    add("normalise_pos", lambda s, d: search.placed(hits(s, d), phrases.limits(phrase(s, d)).select("key", F.col("phrase_ix").alias("seq_id"), F.col("text_start").alias("start"), F.col("text_end").alias("end")), 64), place_sql)

    # Search
    add("find_all", lambda s, d: search.find_all(sequence_index(s, d), tiles(s, d)).where("fits").select("query_id", "seq_id", "seq_pos"), f"WITH {_NAIVE} SELECT query_id, seq_id, seq_pos FROM hit")
    add("find_counts", lambda s, d: search.find_all(sequence_index(s, d), tiles(s, d)).where("fits").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("seq_id").alias("n_seqs")), f"WITH {_NAIVE} SELECT query_id, count(*) AS n, count(DISTINCT seq_id) AS n_seqs FROM hit GROUP BY query_id")
    def merge_index(s, d):
        parts = []
        for k in (0, 1):  # ids begin at 0 in both, and both have the same groups
            half = grouped(s, d).where(F.col("seq_id") % 2 == k).withColumn("seq_id", F.floor(F.col("seq_id") / 2).cast("bigint"))
            part = index.over_sequences(half, index.Parameters(max_query_len=_TILE))
            part.names = half.select("seq_id", F.concat(F.lit("d"), (F.col("seq_id") * 2 + k).cast("string")).alias("name"), F.length("seq").cast("bigint").alias("length"))
            parts.append(part)
        whole = index.merge(parts)
        return search.find_all(whole, tiles(s, d)).where("fits").join(whole.names, "seq_id").select("query_id", "name", "seq_pos")

    def find_stats(s, d):
        return search.summary(search.find_all(index.over_groups(seqs(s, d), index.Parameters(max_query_len=_TILE)), tiles(s, d)).where("fits"), tiles(s, d))

    add("find_stats", find_stats, f"WITH {_NAIVE}, counts AS (SELECT p.query_id, count(h.seq_id) AS n FROM pattern p LEFT JOIN hit h ON p.query_id = h.query_id GROUP BY p.query_id) SELECT count(*) AS n_patterns, sum(CAST(n > 0 AS BIGINT))::BIGINT AS n_found, sum(n)::BIGINT AS n_places, avg(n) AS places_a_pattern, max(n) AS most, sum({_TILE} * n)::BIGINT AS chars FROM counts")
    add("merge_index", merge_index, f"WITH {_NAIVE} SELECT query_id, 'd' || CAST(seq_id AS VARCHAR) AS name, seq_pos FROM hit")
    add("find_relative", lambda s, d: search.find_all(index.over_groups(seqs(s, d), index.Parameters(max_query_len=_TILE)), tiles(s, d)).where("fits").select("query_id", "seq_id", "seq_pos"), f"WITH {_NAIVE} SELECT query_id, seq_id, seq_pos FROM hit")
    add("locate_text", lambda s, d: search.located(texts_of(s, d).select(F.col("key").cast("string").alias("key"), F.col("text").alias("kernel")), tiles(s, d), _TILE).select("key", "query_id", "pos"), f"WITH {_NAIVE} SELECT CAST(seq_id AS VARCHAR) AS key, query_id, seq_pos AS pos FROM hit")
    reads_sql = f"reads AS (SELECT item_id AS query_id, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{C.LETTERS}', '{C.BASES}') AS r FROM benchmark), seed AS (SELECT query_id, r, i * {_TILE} AS off, substr(r, i * {_TILE} + 1, {_TILE}) AS seed FROM (SELECT *, unnest(range(0, length(r) // {_TILE})) AS i FROM reads)), place AS (SELECT seq_id, seq, unnest(range(0, length(seq) - {_TILE - 1})) AS p FROM seqs), start AS (SELECT DISTINCT query_id, r, seq_id, seq, p - off AS pos FROM place JOIN seed ON substr(seq, p + 1, {_TILE}) = seed WHERE p >= off)"
    add("reads_seed_align", lambda s, d: search.seed_align(table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), C.as_bases(F.col("text")).alias("pattern")), texts_of(s, d).withColumn("key", F.col("key").cast("string")), _TILE, 3), f"WITH {_SEQS}, {reads_sql} SELECT query_id, CAST(seq_id AS VARCHAR) AS key, pos, CAST(hamming(substr(seq, pos + 1, length(r)), r) AS INTEGER) AS mismatches FROM start WHERE length(substr(seq, pos + 1, length(r))) = length(r) AND hamming(substr(seq, pos + 1, length(r)), r) <= 3")
    strands_sql = reads_sql.replace("reads AS (SELECT", "reads0 AS (SELECT", 1).replace("FROM benchmark),", f"FROM benchmark), tile AS (SELECT query_id * 1000 + i AS query_id, substr(r, CAST(i * {_READ} + 1 AS BIGINT), {_READ}) AS r FROM (SELECT *, unnest(range(0, length(r) // {_READ})) AS i FROM reads0)), reads AS (SELECT query_id, false AS reverse, r FROM tile UNION ALL SELECT query_id, true, reverse(translate(r, 'ACGT', 'TGCA')) FROM tile),", 1).replace("SELECT query_id, r, i *", f"SELECT query_id, reverse, r, i *").replace("DISTINCT query_id, r,", "DISTINCT query_id, reverse, r,").replace(f"{_TILE}", f"{_READ // 4}")

    def reads_of(s, d):
        b = table(s, d, "benchmark").select("item_id", C.as_bases(F.col("text")).alias("b"))
        return search.seeds(b.select(F.col("item_id").alias("query_id"), F.col("b").alias("pattern")), _READ).select((F.col("query_id") * 1000 + F.col("offset") / _READ).cast("bigint").alias("query_id"), F.col("seed").alias("pattern"))

    def align_index(s, d):
        built = index.over_groups(seqs(s, d), index.Parameters(max_query_len=_READ))
        return search.align_index(reads_of(s, d), built, _READ // 4, 3).select("query_id", "reverse", "seq_id", "seq_pos", F.col("edits").alias("mismatches"))

    add("align_index", align_index, f"WITH {_SEQS}, {strands_sql} SELECT query_id, reverse, seq_id, pos AS seq_pos, CAST(hamming(substr(seq, pos + 1, length(r)), r) AS INTEGER) AS mismatches FROM start WHERE length(substr(seq, pos + 1, length(r))) = length(r) AND hamming(substr(seq, pos + 1, length(r)), r) <= 3")
    add("space_usage", lambda s, d: sequence_index(s, d).space().agg(F.sum("text_chars").alias("text_chars")), f"WITH {_SEQS} SELECT sum(length(seq))::BIGINT AS text_chars FROM seqs")

    # Records
    cat = lambda s, d: table(s, d, "customer").select((F.col("c_custkey") - 1).alias("seq_ix"), F.col("c_name").alias("name"), (F.lit(100) + F.col("c_custkey") % 50).alias("length"))
    add("sam_header", lambda s, d: records.sam_header(cat(s, d)), "SELECT c_custkey - 1 AS ord, '@SQ' || chr(9) || 'SN:' || c_name || chr(9) || 'LN:' || CAST(100 + c_custkey % 50 AS VARCHAR) AS value FROM customer UNION ALL SELECT 9223372036854775807, '@PG' || chr(9) || 'ID:lzseq' || chr(9) || 'VN:0.1'")
    line = "concat_ws(chr(9), qname, CAST(flag AS VARCHAR), key, CAST(pos + 1 AS VARCHAR), '42', cigar, '*', '0', '0', '*', '*')"
    add("sam_format", lambda s, d: records.sam_lines(sam_records(s, d)), f"WITH {_SAM} SELECT {line} AS value FROM rec")
    aligned = f"CASE WHEN cigar = '*' THEN 0 ELSE coalesce({_ALIGNED}, 0) END::BIGINT"
    add("sam_parse", lambda s, d: records.sam_parsed(records.sam_lines(sam_records(s, d))).select("qname", "flag", "rname", "pos", "cigar", "aligned"), f"WITH {_SAM} SELECT qname, flag, key AS rname, pos, cigar, {aligned} AS aligned FROM rec")
    add("sam_mapped_only", lambda s, d: records.mapped_only(sam_records(s, d)).select("qname", "flag"), f"WITH {_SAM} SELECT qname, flag FROM rec WHERE (flag & 4) = 0")
    add("sam_unmapped", lambda s, d: sam_records(s, d).where(C.is_unmapped(F.col("flag"))).select(C.unmapped_record(F.col("qname")).alias("value")), f"WITH {_SAM} SELECT concat_ws(chr(9), qname, '4', '*', '0', '0', '*', '*', '0', '0', '*', '*') AS value FROM rec WHERE flag = 4")
    add("cigar_length", lambda s, d: sam_records(s, d).select("qname", C.cigar_aligned(F.col("cigar")).alias("aligned"), C.cigar_clipped(F.col("cigar")).alias("clipped")), f"WITH {_SAM} SELECT qname, {aligned} AS aligned, CASE WHEN cigar = '*' THEN 0 ELSE event_id % 9 END::BIGINT AS clipped FROM rec")
    norm = f"WITH {_PHRASE}, {_LIMITS}, {_SAM} SELECT r.key, qname, flag, pos2 + al <= text_end AS fits, CASE WHEN pos2 + al <= text_end THEN concat_ws(chr(9), qname, CAST(flag AS VARCHAR), 's' || CAST(phrase_ix AS VARCHAR), CAST(pos2 - text_start + 1 AS VARCHAR), '42', cigar, '*', '0', '0', '*', '*') ELSE concat_ws(chr(9), qname, '4', '*', '0', '0', '*', '*', '0', '0', '*', '*') END AS value FROM (SELECT *, pos AS pos2, {aligned} AS al FROM rec) r JOIN limited l ON r.key = l.key AND text_start <= pos2 AND pos2 < text_end"
    add("sam_normalise", lambda s, d: records.normalised(sam_records(s, d).withColumn("aligned", C.cigar_aligned(F.col("cigar"))), phrases.limits(phrase(s, d)).select("key", F.concat(F.lit("s"), F.col("phrase_ix").cast("string")).alias("name"), F.col("text_start").alias("start"), F.col("text_end").alias("end")), 64), norm)

    def blast_rows(s, d):
        e, i, t = table(s, d, "events"), F.col("event_id"), (lambda c: c.cast("string"))
        return e.select(F.concat_ws("\t", F.concat(F.lit("q"), t(i)), F.lit("Dummy"), F.lit("97.5"), t(50 + i % 50), F.lit("1"), F.lit("0"), F.lit("1"), t(50 + i % 50), t(i * 3 + 1), t(i * 3 + 50 + i % 50), F.lit("1e-5"), F.lit("88.5")).alias("value"))

    blast = "SELECT 'q' || CAST(event_id AS VARCHAR) AS qseqid, {name} AS sseqid, 97.5::DOUBLE AS pident, 50 + event_id % 50 AS length, 1 AS mismatch, 0 AS gapopen, 1::BIGINT AS qstart, 50 + event_id % 50 AS qend, {start} AS sstart, {end} AS send, 1e-5::DOUBLE AS evalue, 88.5::DOUBLE AS bitscore FROM events"
    add("blast_parse", lambda s, d: records.blast_parsed(blast_rows(s, d)), blast.format(name="'Dummy'", start="event_id * 3 + 1", end="event_id * 3 + 50 + event_id % 50"))
    add("blast_rewrite", lambda s, d: records.blast_moved(records.blast_parsed(blast_rows(s, d)), F.concat(F.lit("s"), F.col("qseqid")), F.col("sstart") % 100), blast.format(name="'sq' || CAST(event_id AS VARCHAR)", start="(event_id * 3 + 1) % 100", end="(event_id * 3 + 1) % 100 + 49 + event_id % 50"))

    def lz_binary(s, d):
        return writers.parses(phrase(s, d)).select("key", F.length("content").alias("n_bytes"), F.md5(F.lower(F.hex("content"))).alias("hex_md5"))

    little = lambda c: "concat(" + ", ".join(f"substr(format('{{:016x}}', {c}), {15 - 2 * i}, 2)" for i in range(8)) + ")"
    add("lz_binary", lz_binary, f"WITH {_PHRASE} SELECT key, CAST(16 * count(*) AS INTEGER) AS n_bytes, md5(string_agg({little('pos')} || {little('len')}, '' ORDER BY phrase_ix)) AS hex_md5 FROM phrase GROUP BY key")

    def in_files(s, write, read):
        """What read() finds in the files that write() makes in the shared folder; read once, then they go."""
        folder = f"{shared_folder(s)}/files-{uuid.uuid4().hex}"
        write(folder)
        out = read(folder).checkpoint()
        remove_by_task(s, folder)
        return out

    add("fasta_files", lambda s, d: in_files(s, lambda f: writers.fasta(seqs(s, d), f), lambda f: readers.fasta(s, f).select("header", _digest("seq").alias("seq_md5"))), f"WITH {_SEQS} SELECT header, md5(seq) AS seq_md5 FROM seqs")

    add("lz_files", lambda s, d: in_files(s, lambda f: writers.parse_files(phrase(s, d), f, kind="vbyte").write.format("noop").mode("overwrite").save(), lambda f: readers.parse_files(s, f, "vbyte").select(C.base_name(F.col("file")).alias("key"), "phrase_ix", "pos", "len")), f"WITH {_PHRASE} SELECT key, row_number() OVER (PARTITION BY key ORDER BY phrase_ix) - 1 AS phrase_ix, pos, len FROM phrase")

    def stream_find(s, d):
        """The patterns as files that come in as a stream, found micro-batch by micro-batch."""
        built = index.over_groups(seqs(s, d), index.Parameters(max_query_len=_TILE))

        def read(f):
            cells = F.split("value", "\t")
            arriving = align.read_patterns(s, f).select(cells[0].cast("bigint").alias("query_id"), cells[1].alias("pattern"))
            align.find_stream(arriving, built, f"{f}-out", f"{f}-log").awaitTermination()
            out = s.read.parquet(f"{f}-out").where("fits").select("query_id", "seq_id", "seq_pos").checkpoint()
            for x in ("out", "log"):
                remove(s, f"{f}-{x}")
            return out

        return in_files(s, lambda f: tiles(s, d).select(F.concat_ws("\t", F.col("query_id").cast("string"), "pattern").alias("value")).repartition(3).write.text(f), read)

    add("stream_find", stream_find, f"WITH {_NAIVE} SELECT query_id, seq_id, seq_pos FROM hit")

    def fastq_files(s, d):
        rows = seqs(s, d).select(F.concat(F.lit("@r"), F.col("seq_id").cast("string"), F.when(F.col("seq_id") % 2 == 0, "/1").otherwise("/2"), F.lit(" x\n"), "seq", F.lit("\n+\n"), F.translate("seq", "ACGT", "@+I#")).alias("value"))
        return in_files(s, lambda f: rows.write.text(f), lambda f: readers.fastq(s, f, interleaved=True).select("name", "mate", _digest("seq").alias("seq_md5"), _digest("qual").alias("qual_md5")))

    add("fastq_files", fastq_files, f"WITH {_SEQS} SELECT 'r' || CAST(seq_id AS VARCHAR) AS name, CAST(1 + seq_id % 2 AS INTEGER) AS mate, md5(seq) AS seq_md5, md5(translate(seq, 'ACGT', '@+I#')) AS qual_md5 FROM seqs")
    add("sam_files", lambda s, d: in_files(s, lambda f: writers.sam(records.sam_lines(sam_records(s, d)), cat(s, d), f), lambda f: readers.sam(s, f).select("qname", "flag", "rname", "pos", "cigar", "aligned")), f"WITH {_SAM} SELECT qname, flag, key AS rname, pos, cigar, {aligned} AS aligned FROM rec WHERE qname IS NOT NULL")
    add("blast_files", lambda s, d: in_files(s, lambda f: blast_rows(s, d).write.text(f), lambda f: readers.blast6(s, f)), blast.format(name="'Dummy'", start="event_id * 3 + 1", end="event_id * 3 + 50 + event_id % 50"))

    def fixed_index(s, d):
        """An index whose phrases SQL knows: those of the events."""
        limited = phrases.kernel_limits(merged(s, d), _CONTEXT)
        return index.Index(index.Parameters(max_query_len=_CONTEXT), limited, limited.select("key", F.lit("").alias("kernel")).distinct(), limited.limit(0))

    add("space_report", lambda s, d: fixed_index(s, d).space().drop("share"), f"WITH {_PHRASE}, {_MERGED}, {_KERNEL} SELECT key, max(text_end) AS text_chars, max(k_end) AS kernel_chars, count(*) AS n_phrases, sum(CAST(NOT is_literal AS BIGINT))::BIGINT AS n_copies FROM kernel GROUP BY key")

    def merge_kernels(s, d):
        parts = table(s, d, "documents").select((F.col("doc_id") % 5).alias("part"), F.col("doc_id").alias("line_no"), F.when(F.col("doc_id") < 5, F.concat(F.lit(">part"), F.col("doc_id").cast("string"))).otherwise(C.as_bases(F.col("text"))).alias("value"))
        return writers.merged_kernel_texts(parts, "whole").select("part", "line_no", _digest("value").alias("md5"))

    add("merge_kernels", merge_kernels, f"WITH {_SEQS} SELECT '' AS part, -1 AS line_no, md5('>whole') AS md5 UNION ALL SELECT CAST(seq_id % 5 AS VARCHAR), seq_id, md5(seq) FROM seqs WHERE seq_id >= 5")
    add("merge_limits_sampled", lambda s, d: phrases.merge_limits(limit_table(s, d), 64), f"WITH {_PHRASE}, {_LIMITS}, {limit_rows}, t AS (SELECT part, max(lim) AS last, count(*) - 1 AS n FROM lim GROUP BY part), m AS (SELECT part, coalesce(sum(last) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS moved, coalesce(sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t), whole AS (SELECT part, ix, (lim + moved)::BIGINT AS \"limit\", (ix + before)::BIGINT AS nth FROM lim JOIN m USING (part)) SELECT * FROM whole WHERE nth % 64 = 0 AND (ix > 0 OR nth = 0)")

    def vcf_haplotypes(s, d):
        """Every part's name as a reference: in each ten letters the fourth is another letter, and from the seventh two letters more, on some haplotypes."""
        reference = table(s, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("chrom"), F.regexp_replace("p_name", "[^A-Za-z]", "").alias("seq"), "p_partkey")
        at = reference.where(F.length("seq") >= 10).select("chrom", "seq", "p_partkey", F.explode(F.sequence(F.lit(0), F.floor(F.length("seq") / 10).cast("int") - 1)).alias("i"))
        letter = lambda k: F.substring("seq", F.col("i") * 10 + k, F.lit(1))
        call = lambda k: F.concat((F.col("p_partkey") + F.col("i") + k).cast("long").bitwiseAND(F.lit(1)).cast("string"), F.lit("|"), (F.col("i") + k).cast("long").bitwiseAND(F.lit(1)).cast("string"))
        line = lambda k, alt: F.concat_ws("\t", "chrom", (F.col("i") * 10 + k).cast("string"), F.lit("."), letter(k), alt, F.lit("."), F.lit("."), F.lit("."), F.lit("GT:X"), F.concat(call(k), F.lit(":9")))
        lines = at.select(F.explode(F.array(line(4, F.when(letter(4) == "x", "y").otherwise("x")), line(7, F.concat(letter(7), F.lit("zz"))))).alias("value"))
        head = s.createDataFrame([("#" + "\t".join([*(x.upper() for x in vcf.FIXED), "S"]),)], "value string")

        def read(f):
            got = vcf.haplotypes(reference.select("chrom", "seq"), vcf.variants(s, f), vcf.samples(s, f), chunk=16)
            return got.groupBy("chrom", "name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_ix", "seq"))), lambda x: x["seq"]), "").alias("seq"))

        return in_files(s, lambda f: head.unionByName(lines).write.text(f), read)

    bit = "CASE h WHEN 'reference' THEN 0 WHEN 'S.1' THEN (p_partkey + i + {k}) % 2 ELSE (i + {k}) % 2 END = 1"
    add("vcf_haplotypes", vcf_haplotypes, f"""WITH r AS (SELECT p_partkey, 'p' || CAST(p_partkey AS VARCHAR) AS chrom, regexp_replace(p_name, '[^A-Za-z]', '', 'g') AS seq, length(regexp_replace(p_name, '[^A-Za-z]', '', 'g')) // 10 AS n FROM part),
tens AS (SELECT *, unnest(range(0, n)) AS i FROM r), named AS (SELECT *, substr(seq, CAST(i * 10 + 1 AS BIGINT), 10) AS t FROM tens, (VALUES ('reference'), ('S.1'), ('S.2')) v(h)),
cut AS (SELECT chrom, h, i, substr(t, 1, 3) || CASE WHEN {bit.format(k=4)} THEN CASE WHEN substr(t, 4, 1) = 'x' THEN 'y' ELSE 'x' END ELSE substr(t, 4, 1) END || substr(t, 5, 3) || CASE WHEN {bit.format(k=7)} THEN 'zz' ELSE '--' END || substr(t, 8) AS said FROM named)
SELECT r.chrom, v.h AS name, coalesce((SELECT string_agg(said, '' ORDER BY i) FROM cut c WHERE c.chrom = r.chrom AND c.h = v.h), '') || substr(seq, CAST(n * 10 + 1 AS BIGINT)) AS seq FROM r, (VALUES ('reference'), ('S.1'), ('S.2')) v(h)""")

    def find_indexed(s, d):
        """The patterns in an index that is saved and loaded, by its search structure."""
        return in_files(s, lambda f: sequence_index(s, d).save(f), lambda f: search.find_all(index.Index.load(s, f), tiles(s, d)).where("fits").select("query_id", "seq_id", "seq_pos"))

    add("find_indexed", find_indexed, f"WITH {_NAIVE} SELECT query_id, seq_id, seq_pos FROM hit")

    def read_pieces(s, d):
        texts = texts_of(s, d)
        places = texts.select("key", F.length("text").alias("size")).where("size > 0").select("key", (F.col("key") * 37 % F.col("size")).cast("bigint").alias("at"), (F.lit(1) + F.col("key") % 150).cast("bigint").alias("n"))
        return chunks.read_at(places, chunks.pieces(texts, 64), 64).select("key", "at", "n", _digest("text").alias("md5"))

    add("read_at", read_pieces, f"WITH {_SEQS}, p AS (SELECT seq_id AS key, seq, seq_id * 37 % length(seq) AS \"at\", 1 + seq_id % 150 AS n FROM seqs WHERE length(seq) > 0) SELECT key, \"at\", n, md5(substr(seq, \"at\" + 1, n)) AS md5 FROM p")
    add("paired_names", lambda s, d: table(s, d, "documents").select("doc_id", C.base_name(F.concat(F.lit("/a/b."), F.col("lang"), F.lit("/"), F.col("source"), F.lit(".x.fa"))).alias("name")).join(table(s, d, "documents").select(F.col("source").alias("name0")).distinct().select(C.base_name(F.concat("name0", F.lit(".x.lz"))).alias("name")), "name").select("doc_id", "name"), "SELECT doc_id, source || '.x' AS name FROM documents")
    # A customer's list: from the nation to some numbers on, and the last digit of the key
    add("work_list", lambda s, d: table(s, d, "customer").select("c_custkey", F.explode(readers.work_items(F.concat(F.col("c_nationkey").cast("string"), F.lit("-"), (F.col("c_nationkey") + F.col("c_custkey") % 5).cast("string"), F.lit(","), (F.col("c_custkey") % 10).cast("string")))).alias("item")), "SELECT c_custkey, CAST(unnest(list_concat(range(c_nationkey, c_nationkey + c_custkey % 5 + 1), [c_custkey % 10])) AS INTEGER) AS item FROM customer")
    catalogue_files.add_all(add, in_files)
    return q


def queries() -> dict:
    return {name: run for name, (run, _) in entries().items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in entries().items() if sql}
