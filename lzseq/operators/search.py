"""Patterns in kernels, mapped to texts, spread to copies and placed in sequences; reads by seeds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.columns import hamming
from ..functions.session import bounded_batches, shared_folder, spread
from . import fm, kernels, parses, phrases, ranges


def rejected(patterns: DataFrame, most: int) -> DataFrame:
    """Patterns that are null, empty or longer than an index allows."""
    return patterns.where(F.col("pattern").isNull() | (F.length("pattern") == 0) | (F.length("pattern") > most))


def checked(patterns: DataFrame, most: int) -> DataFrame:
    """(query_id, pattern); raises where one can't be searched."""
    bad = rejected(patterns, most).select("query_id").take(1)
    if bad:
        raise ValueError(f"pattern {bad[0][0]} must have 1 to {most} characters")
    return patterns.select("query_id", "pattern")


def located(kernels: DataFrame, patterns: DataFrame, most: int) -> DataFrame:
    """(key, query_id, pos, m) of all places of the patterns in the kernel texts. Null and empty kernels have no places; a repeated pattern is found under each of its ids; a null, empty or too long one raises.

    A join: patterns meet the parts of the texts that have the hash of their beginning, whose length is the largest power
    of two within the pattern, 64 at most, and are compared with the characters there. There is a pass for each such
    length, seven at most, however many patterns there are.
    """
    rows = checked(patterns, most)
    begun = rows.withColumn("seed", F.expr("substring(pattern, 1, least(64, cast(pow(2, floor(log2(length(pattern)))) as int)))"))
    found = seed_places(kernels.select("key", F.col("kernel").alias("text")), begun, "pattern")
    return found.where(F.startswith("window", F.col("pattern"))).select("key", "query_id", "pos", F.length("pattern").cast("bigint").alias("m"))


def in_index(index, patterns: DataFrame) -> DataFrame:
    """located() in an index's kernels: by its search structure where it has one, patterns that are too short for that by a join with the kernels."""
    most = index.parameters.max_query_len
    if index.blocks is None:
        return located(index.kernels, patterns, most)
    rows, least = checked(patterns, most), fm.GRAM + fm.WINDOW - 1
    found = fm.located(index.blocks, index.directory, rows)
    short = rows.where(F.length("pattern") < least)
    return found if short.isEmpty() else found.unionByName(located(index.kernels, short, most))


def primary(hits: DataFrame, limited: DataFrame, aligned: bool = False, bin_size: int = 4096) -> DataFrame:
    """Kernel hits (key, query_id, pos, m) mapped to the text: those that cross their phrase's end or lie in a literal.

    Others are copies of something, and ranges.closure() finds them. aligned keeps hits in copies too, marked not crossing.
    Hits outside the kernel, or with nulls, go; repeated ones repeat.
    """
    rows = ranges.range_join(hits, limited.select("key", "k_start", "k_end", "text_end", "is_literal"), "pos", "k_start", "k_end", ["key"], bin_size)
    crossing = (F.col("k_end") <= F.col("pos") + F.col("m") - 1) | F.col("is_literal")
    rows = rows.select("key", "query_id", (F.col("text_end") - (F.col("k_end") - F.col("pos"))).alias("at"), "m", crossing.alias("crossing"))
    rows = rows.withColumnRenamed("at", "pos")
    return rows if aligned else rows.where("crossing").drop("crossing")


def placed(occurrences: DataFrame, catalogue: DataFrame, bin_size: int = 4096) -> DataFrame:
    """Text positions as positions within sequences: adds seq_id, seq_pos and fits; what overlaps two sequences doesn't fit.

    Where the catalogue has parts of sequences (from), a place in two parts that overlap comes twice, with one seq_pos.
    """
    extra = ["from"] if "from" in catalogue.columns else []
    rows = ranges.range_join(occurrences, catalogue.select("key", "seq_id", "start", "end", *extra), "pos", "start", "end", ["key"], bin_size)
    at = F.col("pos") - F.col("start")
    return rows.withColumn("seq_pos", at + F.col("from") if extra else at).withColumn("fits", F.col("pos") + F.col("m") <= F.col("end")).drop("start", "end", *extra)


def seeds(reads: DataFrame, k: int, mismatches: int | None = None) -> DataFrame:
    """(query_id, read, offset, seed): pieces of k characters next to each other.

    With mismatches, a read that has no more pieces of k than mismatches is cut into shorter ones, one more than
    mismatches; one too short for that raises. Without, reads under k characters have none.
    """
    length = F.length("pattern")
    if mismatches is None:
        rows, size = reads.where(length >= k), F.lit(k)
    else:
        short = F.raise_error(F.concat(F.lit("read "), F.col("query_id").cast("string"), F.lit(f" needs more than {mismatches} characters")))
        rows, size = reads.where(length > 0), F.when(length > mismatches, F.least(F.lit(k), F.floor(length / (mismatches + 1)).cast("int"))).otherwise(short.cast("int"))
    rows = rows.select("query_id", F.col("pattern").alias("read"), size.alias("size"))
    rows = rows.select("query_id", "read", "size", F.explode(F.sequence(F.lit(0), F.floor(F.length("read") / F.col("size")).cast("int") - 1)).alias("i"))
    return rows.select("query_id", "read", (F.col("i") * F.col("size")).alias("offset"), F.substring("read", F.col("i") * F.col("size") + 1, F.col("size")).alias("seed"))


#: Bits of the filter that a text's parts pass before they are joined to seeds: at least, at most, and for each seed; seeds beyond what the most is for go without.
LEAST_BITS, MOST_BITS, BITS_A_SEED = 1 << 16, 1 << 28, 16
#: Characters of the pieces that windows are cut from.
PIECE = 4096


def seed_places(texts: DataFrame, seeds: DataFrame, whole: str | None = None) -> DataFrame:
    """seeds (query_id, seed, ...) with key and pos of the places in texts (key, text) that have the seed's hash.

    A join on hashes of all parts of the texts with a seed's length; texts are read once for all lengths. Only hashes come to it that
    pass a filter made of the seeds; its size follows their number, and with more than it has room for all hashes are
    joined. Neither seeds nor places go through the driver. Equal hashes of different parts are as good as none; whoever
    compares the texts sees that: for that, with whole (a column that begins with the seed), window has the text
    from pos on, as long as the longest of these with such a seed.
    """
    spark = texts.sparkSession
    shared_folder(spark)
    hashed = seeds.withColumn("size", F.length("seed"))

    @F.arrow_udf("bigint")
    def of_seed(batch: pa.Array) -> pa.Array:
        return pa.array(np.array([kernels.window_hashes(x, len(x))[0] for x in batch.to_pylist()], np.uint64).view(np.int64))

    hashed = hashed.withColumn("h", of_seed("seed")).checkpoint()
    longest, passes_of = F.max(F.length(whole or "seed")), []
    for size, count, reach in sorted(map(tuple, hashed.groupBy("size").agg(F.approx_count_distinct("h"), longest).collect())):
        some = hashed.where(F.col("size") == size)
        bits = min(MOST_BITS, max(LEAST_BITS, 1 << int(BITS_A_SEED * count).bit_length()))
        passes = None
        if BITS_A_SEED * count <= 4 * MOST_BITS:
            words = some.groupBy(F.shiftright(F.col("h").bitwiseAND(F.lit(bits - 1)), 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits")).toArrow()
            passes = np.zeros(bits >> 6, np.int64)
            passes[words.column("word").to_numpy()] = words.column("bits").to_numpy()
        passes_of.append((size, bits, reach, spark.sparkContext.broadcast(passes)))
    if not passes_of:
        empty = ", ".join(f"`{k}` {t}" for k, t in [*seeds.dtypes, ("key", dict(texts.dtypes)["key"]), ("pos", "bigint"), *([("window", "string")] if whole else [])])
        return spark.createDataFrame([], empty)

    def run(batches):
        for batch in batches:
            for part in parses._slices(batch, ["text"]):
                texts_of = [t or "" for t in part.column("text").to_pylist()]
                for size, bits, reach, shared in passes_of:
                    known = None if shared.value is None else shared.value.view(np.uint64)
                    found, said = [], []
                    for t in texts_of:
                        h = kernels.window_hashes(t, size)
                        if known is None:
                            pos = np.arange(len(h))
                        else:
                            at = (h & np.uint64(bits - 1)) >> np.uint64(6)
                            pos = np.flatnonzero((known[at.astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1))
                        found.append((h[pos].view(np.int64), pos))
                        if whole:
                            said += [t[p : p + reach] for p in pos.tolist()]
                    counts = [len(x[1]) for x in found]
                    rows = parses._batch({"key": part.column("key")}, counts, {"size": [np.full(n, size, np.int32) for n in counts], "h": [x[0] for x in found], "pos": [x[1] for x in found]})
                    yield rows.append_column("window", pa.array(said, pa.string())) if whole else rows

    places = spread(texts.select("key", "text")).mapInArrow(run, f"key {dict(texts.dtypes)['key']}, size int, h bigint, pos bigint" + ", window string" * bool(whole))
    return hashed.join(places, ["size", "h"]).drop("size", "h")


#: Texts with candidates whose pieces' numbers are sent to them, so that only these are cut; with more numbers, all are.
BROADCAST_PIECES = 1_000_000


def windows(candidates: DataFrame, texts: DataFrame, most: int) -> DataFrame:
    """candidates (key, at, n: up to `most` characters) with part, the text there, cut off at the text's ends.

    Texts are cut into overlapping pieces, so that no row of the join carries a whole text, and only into those that
    candidates ask for.
    """
    bounded_batches(texts.sparkSession)
    first = F.greatest(F.col("at"), F.lit(0).cast("bigint"))
    asked = candidates.withColumn("n", F.col("n") + F.least(F.col("at"), F.lit(0).cast("bigint"))).withColumn("at", first).withColumn("_piece", F.floor(first / PIECE).cast("bigint"))
    wanted = asked.select("key", "_piece").distinct()
    rows = texts.select("key", "text").withColumn("_wanted", F.lit(None).cast("array<bigint>"))
    if wanted.limit(BROADCAST_PIECES + 1).count() <= BROADCAST_PIECES:
        rows = texts.select("key", "text").join(F.broadcast(wanted.groupBy("key").agg(F.collect_list("_piece").alias("_wanted"))), "key")

    def cut(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                text, chosen = batch.column("text")[r].as_py() or "", batch.column("_wanted")[r].as_py()
                starts = list(range(0, len(text), PIECE)) if chosen is None else [x * PIECE for x in chosen if x * PIECE < len(text)]
                for at in range(0, len(starts), 256):
                    some = starts[at : at + 256]
                    yield pa.RecordBatch.from_arrays([pa.repeat(batch.column("key")[r], len(some)), pa.array([x // PIECE for x in some], pa.int64()), pa.array([text[x : x + PIECE + most] for x in some], pa.string())], names=["key", "_piece", "_text"])

    pieces = rows.mapInArrow(cut, f"key {dict(texts.dtypes)['key']}, _piece bigint, _text string")
    return asked.join(pieces, ["key", "_piece"]).withColumn("part", F.substring("_text", (F.col("at") - F.col("_piece") * PIECE + 1).cast("int"), F.col("n").cast("int"))).drop("_piece", "_text")


def aligned(reads: DataFrame, texts: DataFrame, k: int, edits: int, gaps: bool = False, strands: bool = True, separator: str | None = None, every_end: bool = False) -> DataFrame:
    """(query_id, reverse, key, pos, n, edits, cigar) of the reads (query_id, pattern) in texts (key, text), n being the characters taken there.

    Without gaps every place with at most so many mismatches; with gaps, of the places around each exact seed the closest
    with at most so many edits, or, with every_end, for each end of such a place its closest alignment, none left out.
    Each read has more seeds than edits, so one is exact at every such place. With strands
    the reverse complement, too, is aligned. Null and empty reads have no place; reads too short for the edits raise.
    """
    both = reads.where(F.length("pattern") > 0).select("query_id", "pattern", F.lit(False).alias("reverse"))
    if strands:
        both = both.unionByName(both.select("query_id", C.reverse_complement(F.col("pattern")).alias("pattern"), F.lit(True).alias("reverse")))
    both = both.select(F.struct("query_id", "reverse").alias("query_id"), "pattern")
    most = (both.agg(F.max(F.length("pattern"))).first()[0] or 1) + 2 * edits
    pairs = seed_places(texts, seeds(both.withColumn("query_id", F.to_json("query_id")), k, edits))
    wide = edits if gaps else 0
    length = F.length("read")
    starts = pairs.select("query_id", "read", "key", (F.col("pos") - F.col("offset") - wide).alias("at"), (length + 2 * wide).cast("bigint").alias("n")).where("at >= 0" if not gaps else "true").distinct()
    parts = windows(starts.where(F.col("at") + F.col("n") > 0).checkpoint(), texts, most)
    kind = dict(reads.dtypes)["query_id"]
    back = F.from_json("query_id", f"query_id {kind}, reverse boolean")
    if gaps:

        @F.arrow_udf("array<struct<start: int, n: int, edits: int, cigar: string>>")
        def close(r: pa.Array, w: pa.Array) -> pa.Array:
            best = (lambda *a: kernels.alignments(*a)) if every_end else (lambda *a: [x for x in (kernels.best_alignment(*a),) if x])
            got = [best(a, b, edits, separator) for a, b in zip(r.to_pylist(), w.to_pylist())]
            cells = list(zip(*(x for g in got for x in g))) or [()] * 4
            kinds = (("start", pa.int32()), ("n", pa.int32()), ("edits", pa.int32()), ("cigar", pa.string()))
            return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, got)]), pa.int32()), pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(cells, kinds)], names=[k for k, _ in kinds]))

        got = parts.withColumn("x", F.explode(close("read", "part"))).where("x.n > 0")
        got = got.select(back.alias("b"), "key", (F.col("at") + F.col("x.start")).alias("pos"), F.col("x.n").cast("bigint").alias("n"), "x.edits", "x.cigar").select("b.query_id", "b.reverse", "key", "pos", "n", "edits", "cigar")
        if not every_end:
            return got.distinct()
        # A window may begin within a place that another seed's window holds whole.
        best = got.groupBy("query_id", "reverse", "key", (F.col("pos") + F.col("n")).alias("end")).agg(F.min(F.struct("edits", "n", "cigar")).alias("x"))
        return best.select("query_id", "reverse", "key", (F.col("end") - F.col("x.n")).alias("pos"), "x.n", "x.edits", "x.cigar")
    whole = parts.where(F.length("part") == length)
    if separator:
        whole = whole.where(~F.contains("part", F.lit(separator)))
    got = whole.withColumn("edits", hamming(F.col("part"), F.col("read"))).where(F.col("edits") <= edits)
    return got.select(back.alias("b"), "key", F.col("at").alias("pos"), "n", "edits", F.concat(F.col("n").cast("string"), F.lit("M")).alias("cigar")).select("b.query_id", "b.reverse", "key", "pos", "n", "edits", "cigar")


def seed_align(reads: DataFrame, texts: DataFrame, k: int, mismatches: int) -> DataFrame:
    """Reads at every place of every text (key, text) with at most so many mismatches, as they are: (query_id, key, pos, mismatches).

    Seeds have k characters, of short reads fewer, so that each read has more seeds than mismatches, one of them is exact
    at every such place and none is missed.
    """
    return aligned(reads, texts, k, mismatches, strands=False).select("query_id", "key", "pos", F.col("edits").alias("mismatches"))


def align_index(reads: DataFrame, index, k: int = 20, edits: int = 3, gaps: bool = False, report: str = "ALL", every_end: bool = False) -> DataFrame:
    """(query_id, reverse, seq_id, seq_pos, n, edits, cigar) of reads (query_id, pattern) in an index, on both strands.

    Reads are aligned in the kernels, mapped to the texts, spread to the copies there (report ALL: copies of copies too;
    LZ: direct ones; NONE: no copies) and placed in sequences; what overlaps two sequences is left out. Reads must not be
    longer than the index's queries, and with gaps edits not more than its edit distance, as kernels hold no more.
    """
    p = index.parameters
    if report not in ("ALL", "LZ", "NONE"):
        raise ValueError("report is ALL, LZ or NONE")
    if gaps and edits > p.max_edit_distance:
        raise ValueError(f"the index holds {p.max_edit_distance} edits")
    longest = reads.agg(F.max(F.length("pattern"))).first()[0] or 0
    if longest > p.max_query_len:
        raise ValueError(f"a read has {longest} characters, the index holds {p.max_query_len}")
    hits = aligned(reads, index.kernels.select("key", F.col("kernel").alias("text")), k, edits, gaps, True, p.separator, every_end)
    payload = ("query_id", "reverse", "n", "edits", "cigar")
    hits = hits.withColumn("hit", F.xxhash64(*payload)).checkpoint()
    said = hits.select("hit", *payload).distinct()
    first = primary(hits.select("key", F.col("hit").alias("query_id"), "pos", F.col("n").alias("m")), index.limited).distinct()
    grid = phrases.grid(index.merged)
    found = ranges.closure(first, grid) if report == "ALL" else first.unionByName(ranges.copies_of(first, grid)).distinct() if report == "LZ" else first
    rows = placed(found, index.catalogue).where("fits").select(F.col("query_id").alias("hit"), "seq_id", "seq_pos").distinct()
    return rows.join(said, "hit").select("query_id", "reverse", "seq_id", "seq_pos", "n", "edits", "cigar")


def find_all(index, patterns: DataFrame) -> DataFrame:
    """(query_id, key, pos, seq_id, seq_pos, fits, m) of all places of the patterns in an index (plans.index.Index), each once; seq_ids are unique.

    Places that fit are in one sequence; of others seq_id and seq_pos are those of their first character. No patterns,
    or an empty index, give no rows; a null or empty pattern, or one longer than the index allows, raises.
    """
    first = primary(in_index(index, patterns), index.limited)
    rows = placed(ranges.closure(first, phrases.grid(index.merged)), index.catalogue)
    # A place across the end of a part is in the next part whole.
    best = rows.groupBy("query_id", "seq_id", "seq_pos", "m").agg(F.max(F.struct("fits", "key", "pos")).alias("x"))
    return best.select("query_id", "x.key", "x.pos", "seq_id", "seq_pos", "x.fits", "m")


def summary(found: DataFrame, patterns: DataFrame) -> DataFrame:
    """One row on a run of queries: patterns, those found, places, places a pattern, the most of one pattern, characters found."""
    counts = patterns.select("query_id").distinct().join(found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.sum("m").alias("chars")), "query_id", "left")
    n = F.coalesce("n", F.lit(0).cast("bigint"))
    return counts.agg(F.count(F.lit(1)).alias("n_patterns"), F.sum((n > 0).cast("bigint")).alias("n_found"), F.sum(n).alias("n_places"), F.avg(n.cast("double")).alias("places_a_pattern"), F.max(n).alias("most"), F.coalesce(F.sum("chars"), F.lit(0).cast("bigint")).alias("chars"))
