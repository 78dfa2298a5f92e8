"""Parses and exact search of many bounded texts, a kernel call for each row. Nothing is grouped in Python."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import bounded_batches, shared_folder, spread
from . import kernels

#: Characters of a text that one task parses at once; packing into blocks (chunks.with_blocks) keeps to it.
BLOCK_CHARS = 262_144
#: Characters of a group's sequences that one task parses against the group's dictionary, whose suffix array it makes for them; so many times the dictionary's, where that is more.
GROUP_CHARS, TIMES_DICTIONARY = 4 << 20, 4


def cut_long(seqs: DataFrame, size: int, overlap: int, group: str = "groupname") -> DataFrame:
    """(seq_id, group, seq, from): sequences of up to size characters whole, longer ones in parts of that size that begin
    `overlap` characters before the last one's end; from is the part's place. Whatever fits into overlap + 1 characters is in a part whole."""
    if size <= overlap:
        raise ValueError("parts must be longer than their overlap")
    step = size - overlap
    types = dict(seqs.dtypes)

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                text = batch.column("seq")[r].as_py()
                starts = list(range(0, max(1, len(text) - overlap), step))
                for at in range(0, len(starts), 64):
                    some = starts[at : at + 64]
                    yield pa.RecordBatch.from_arrays([pa.repeat(batch.column("seq_id")[r], len(some)), pa.repeat(batch.column(group)[r], len(some)), pa.array([text[x : x + size] for x in some], pa.string()), pa.array(some, pa.int64())], names=["seq_id", group, "seq", "from"])

    bounded_batches(seqs.sparkSession)
    rows = seqs.select("seq_id", group, "seq")
    short = rows.where(F.length("seq") <= size).withColumn("from", F.lit(0).cast("bigint"))
    return short.unionByName(rows.where(F.length("seq") > size).mapInArrow(run, f"seq_id {types['seq_id']}, `{group}` {types[group]}, seq string, `from` bigint"))


def block_texts(seqs: DataFrame, group: str = "groupname", size: int = BLOCK_CHARS) -> tuple[DataFrame, DataFrame]:
    """(texts, catalogue) of sequences packed into blocks: (key, text), and (key, seq_ix, seq_id, length, start, end, from).

    A text is its block's sequences in the order of seq_id; from (0 where seqs doesn't have it) is a part's place in its
    sequence. A sequence longer than size is a block's text alone or with few; cut_long() before keeps blocks to the size.
    """
    from pyspark.sql import Window

    from .chunks import with_blocks

    if "from" not in seqs.columns:
        seqs = seqs.withColumn("from", F.lit(0).cast("bigint"))
    dealt = with_blocks(seqs.withColumn("_id", F.col("seq_id")).withColumn("seq_id", F.when(F.col("from") == 0, F.col("seq_id")).otherwise(F.xxhash64("seq_id", "from"))), group, size).withColumn("seq_id", F.col("_id"))
    rows = dealt.withColumn("key", F.concat_ws("/", group, F.col("block").cast("string")))
    rows = rows.withColumn("length", F.length("seq").cast("bigint"))
    w = Window.partitionBy("key").orderBy("seq_id", "from")
    end = F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, 0))
    catalogue = rows.select("key", (F.row_number().over(w) - 1).cast("bigint").alias("seq_ix"), "seq_id", "length", (end - F.col("length")).alias("start"), end.alias("end"), "from")
    ordered = F.array_sort(F.collect_list(F.struct("seq_id", "from", "seq")))
    texts = rows.groupBy("key").agg(F.array_join(F.transform(ordered, lambda x: x["seq"]), "").alias("text"))
    return texts, catalogue


def symbols(text: str | None) -> bytes:
    """A byte for each character; raises on characters above U+00FF, which a parse has no symbol for."""
    try:
        return (text or "").encode("latin-1")
    except UnicodeEncodeError as e:
        raise ValueError(f"parses take characters up to U+00FF, not {text[e.start]!r} at {e.start}") from None


def _batch(columns: dict[str, pa.Array], counts: list[int], found: dict[str, list[np.ndarray]]) -> pa.RecordBatch:
    """Rows of columns repeated by counts, beside all that was found for them."""
    at = pa.array(np.repeat(np.arange(len(counts)), counts))
    joined = {k: pa.array(np.concatenate(v) if v else np.empty(0, np.int64)) for k, v in found.items()}
    return pa.RecordBatch.from_arrays([*(c.take(at) for c in columns.values()), *joined.values()], names=[*columns, *joined])


#: What a parse gives of each phrase, and what it gives where short ones are merged.
PHRASE = "phrase_ix bigint, pos bigint, len bigint"
RUN = "first_ix bigint, pos array<bigint>, len array<bigint>"
MERGED = f"{PHRASE}, is_literal boolean, text_start bigint, text_end bigint"


def _rows(columns: dict[str, pa.Array], found: list[kernels.Phrases], context: int | None = None, apart: bool = False) -> pa.RecordBatch:
    """The phrases found for each row beside its columns: PHRASE, with a context MERGED."""
    cells = [{"phrase_ix": np.arange(len(pos)), "pos": pos, "len": n} if context is None else kernels.merged((pos, n), context, apart) for pos, n in found]
    names = [x.split()[0] for x in (PHRASE if context is None else MERGED).split(", ")]
    return _batch(columns, [len(x["pos"]) for x in cells], {k: [x[k] for x in cells] for k in names})


#: Phrases of a row where those that follow each other share one.
RUN_PHRASES = 16_384


def _runs(columns: dict[str, pa.Array], found: list[kernels.Phrases], most: int) -> pa.RecordBatch:
    """The phrases found for each row beside its columns, as phrase_runs() has them, up to most in a row."""
    sizes = np.array([len(pos) for pos, _ in found], np.int64)
    first = [np.arange(0, n, most) for n in sizes.tolist()]
    begin = np.cumsum(sizes) - sizes
    offsets = pa.array(np.append(np.concatenate([f + b for f, b in zip(first, begin)]), sizes.sum()), pa.int32())
    at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in first]))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([x[k] for x in found]), pa.int64())) for k in (0, 1)]
    return pa.RecordBatch.from_arrays([*(c.take(at) for c in columns.values()), pa.array(np.concatenate(first), pa.int64()), *lists], names=[*columns, "first_ix", "pos", "len"])


def _phrases(rows: DataFrame, parse, keys: list[str], columns: list[str], most: int, context: int | None = None) -> DataFrame:
    types = dict(rows.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + f", {PHRASE if context is None else MERGED}"

    def run(batches):
        for batch in batches:
            for part in _slices(batch, columns, most):
                found = parse(*([symbols(x) for x in part.column(c).to_pylist()] for c in columns))
                yield _rows({k: part.column(k) for k in keys}, found, context)

    return spread(rows.select(*keys, *columns)).mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch, columns: list[str], most: int = 4 * BLOCK_CHARS):
    """The batch in parts of about so many characters, a row at least, so that what is found at once is bounded."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for c in columns:
        sizes += pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for r, n in enumerate(sizes.tolist()):
        if r > start and total + n > most:
            yield batch.slice(start, r - start)
            start, total = r, 0
        total += n
    if batch.num_rows:
        yield batch.slice(start)


def lz77_phrases(texts: DataFrame, keys: list[str] | None = None, leftmost: bool = False, context: int | None = None) -> DataFrame:
    """(keys, phrase_ix, pos, len) of each row's text. Symbols are characters up to U+00FF, others raise; null and empty texts have no phrases, repeated rows repeat theirs.

    With a context, short phrases are merged where they are found, as phrases.merge_short() does it. Texts are parsed together up to BLOCK_CHARS.
    """
    return _phrases(texts, lambda t: kernels.lz77_all(t, leftmost), keys or ["key"], ["text"], BLOCK_CHARS, context)


def rlz_phrases(rows: DataFrame, keys: list[str], leftmost: bool = True) -> DataFrame:
    """Phrases of each row's seq relative to its dictionary text. Rows of one dictionary after each other share its suffix array."""
    last: list = [None, None]

    def parse(seq: bytes, dictionary: bytes):
        if last[0] != dictionary:
            last[0], last[1] = dictionary, kernels.Reference(dictionary)
        return last[1].parse(seq, leftmost)

    return _phrases(rows, lambda *pairs: [parse(*x) for x in zip(*pairs)], keys, ["seq", "dictionary"], 4 * BLOCK_CHARS)


def rlz_by_group(seqs: DataFrame, dictionaries: DataFrame, group: str, ids: list[str], leftmost: bool = True, block_chars: int = GROUP_CHARS, context: int | None = None, runs: bool = False) -> DataFrame:
    """(group, ids, phrase_ix, pos, len) of sequences relative to their group's dictionary (group, dictionary); with a context, short phrases of a sequence are merged as phrases.merge_short() does it. runs: as phrase_runs() has them instead.

    A group is dealt into blocks of about block_chars characters, and of TIMES_DICTIONARY times its dictionary where that is more; its dictionary goes to each block once, ahead of the
    block's sequences, and its suffix array is made once a block, so for all blocks in proportion to what they have. ids has seq_id. Groups without a dictionary are all literals.
    """
    from .chunks import with_blocks

    bounded_batches(seqs.sparkSession)
    shared_folder(seqs.sparkSession)
    types = dict(seqs.dtypes)
    sizes = dictionaries.select(group, (F.length("dictionary").cast("bigint") * TIMES_DICTIONARY).alias("chars"))
    dealt = with_blocks(seqs, group, block_chars, sizes).select(group, "block", F.lit(1).alias("kind"), *ids, "seq")
    blocks = dealt.select(group, "block").distinct()
    heads = blocks.join(dictionaries.select(group, "dictionary"), group).select(group, "block", F.lit(0).alias("kind"), *(F.lit(None).cast(types[k]).alias(k) for k in ids), F.col("dictionary").alias("seq"))
    rows = dealt.unionByName(heads).repartition(group, "block").sortWithinPartitions(group, "block", "kind")
    most = RUN_PHRASES
    schema = ", ".join(f"`{k}` {types[k]}" for k in (group, *ids)) + f", {RUN if runs else PHRASE if context is None else MERGED}"

    def run(batches):
        at, reference = None, kernels.Reference(b"")
        for batch in batches:
            keys = list(zip(batch.column(group).to_pylist(), batch.column("block").to_pylist(), batch.column("kind").to_pylist()))
            start = 0
            for r in range(1, len(keys) + 1):
                if r < len(keys) and keys[r] == keys[start]:
                    continue
                if keys[start][:2] != at:
                    at, reference = keys[start][:2], kernels.Reference(b"")
                for part in _slices(batch.slice(start, r - start), ["seq"]):
                    texts = [symbols(t) for t in part.column("seq").to_pylist()]
                    if not keys[start][2]:
                        reference = kernels.Reference(texts[-1])
                        continue
                    columns, found = {k: part.column(k) for k in (group, *ids)}, reference.parse_all(texts, leftmost)
                    yield _runs(columns, found, most) if runs else _rows(columns, found, context, True)
                start = r

    return rows.mapInArrow(run, schema)


def decoded(phrases: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text) of parses whose sources are in their own text. phrase_ix is unique within a key; a key without phrases has no row."""
    bounded_batches(phrases.sparkSession)
    rows = _gathered(phrases, keys)

    def text(pos: pa.Array, length: pa.Array) -> pa.Array:
        """A row's phrases at a time as numbers of Python's, so that a batch isn't."""
        return pa.array([kernels.decode(p.values.to_pylist(), n.values.to_pylist()).decode("latin-1") for p, n in zip(pos, length)], pa.string())

    return rows.select(*keys, F.arrow_udf(text, "string")("pos", "len").alias("text"))


def _gathered(phrases: DataFrame, keys: list[str]) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("phrase_ix", "pos", "len")))
    rows = phrases.groupBy(*keys).agg(ordered.alias("p"))
    return rows.select(*keys, F.transform("p", lambda x: x["pos"]).alias("pos"), F.transform("p", lambda x: x["len"]).alias("len"))


#: Characters of the pieces that dictionaries are cut into, each of which a copy is found in by going over the characters before it, and of the parts that texts are put together in.
DICTIONARY_PIECE, TEXT_PART = 256, 262_144
#: Characters of a dictionary that a task holds whole (four bytes each), and in whose rows it gets there; of phrases that go to a task with their dictionary.
HELD_DICTIONARY, DICTIONARY_ROW, BLOCK_PHRASES = 16 << 20, 1_024, 2_000_000


def decoded_by_group(phrases: DataFrame, dictionaries: DataFrame, group: str, ids: list[str]) -> DataFrame:
    """(group, ids, text) of parses relative to their group's dictionary (group, dictionary). phrase_ix is unique within a parse; a parse without phrases has no row; what lies outside the dictionary is left out."""
    parts = decoded_parts(phrases, dictionaries, group, ids)
    ordered = F.array_sort(F.collect_list(F.struct("part", "text")))
    return parts.groupBy(group, *ids).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "").alias("text"))


def decoded_parts(phrases: DataFrame, dictionaries: DataFrame, group: str, ids: list[str]) -> DataFrame:
    """(group, ids, part, text): the texts of decoded_by_group() in parts of about TEXT_PART characters, in the order of part.

    Phrases that follow each other are one row; given so already, they are taken as phrase_runs() has them. A group is dealt into blocks of about BLOCK_PHRASES by
    its parses, and its dictionary goes to each block ahead of them. Dictionaries beyond HELD_DICTIONARY are cut into pieces and a phrase
    at their borders, so that one meets the other in a join; a dictionary of any size is many rows, and so is a parse.
    Symbols of literals are characters up to U+00FF.
    """
    spark, folder = phrases.sparkSession, f"{shared_folder(phrases.sparkSession)}/decoded-{uuid.uuid4().hex}"
    (phrases if "first_ix" in phrases.columns else phrase_runs(phrases, group, ids)).write.parquet(folder)  # parsed once
    runs, dictionaries = spark.read.parquet(folder), dictionaries.select(group, "dictionary").checkpoint()
    large = dictionaries.where(F.length("dictionary") > HELD_DICTIONARY)
    if large.isEmpty():
        return _decoded_by_task(runs, dictionaries, group, ids)
    names = large.select(group).distinct()
    rows = runs.join(names, group, "left_semi").select(group, *ids, "first_ix", F.posexplode(F.arrays_zip("pos", "len")).alias("_k", "_x")).select(group, *ids, (F.col("first_ix") + F.col("_k")).alias("phrase_ix"), "_x.pos", "_x.len")
    return _decoded_by_task(runs.join(names, group, "left_anti"), dictionaries.join(names, group, "left_anti"), group, ids).unionByName(_decoded_by_pieces(rows, large, group, ids))


def phrase_runs(phrases: DataFrame, group: str, ids: list[str]) -> DataFrame:
    """(group, ids, first_ix, pos, len): phrases of a parse that come after each other and are numbered so, in one row; arrays. Phrases without a number, a place or a length have none."""
    keys, types = [group, *ids], dict(phrases.dtypes)

    def run(batches):
        for batch in batches:
            codes = [batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy() for k in range(len(keys))]
            ix = batch.column(len(keys)).to_numpy()
            new = np.append(True, ix[1:] != ix[:-1] + 1)
            for c in codes:
                new[1:] |= c[1:] != c[:-1]
            first = np.flatnonzero(new)
            offsets = pa.array(np.append(first, batch.num_rows), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, batch.column(len(keys) + k)) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(first)) for k in range(len(keys))), pa.array(ix[first]), *lists], names=[*keys, "first_ix", "pos", "len"])

    bounded_batches(phrases.sparkSession)
    numbers = [F.col(k).cast("bigint").alias(k) for k in ("phrase_ix", "pos", "len")]
    rows = phrases.where("phrase_ix is not null and pos is not null and len >= 0").select(*keys, *numbers)
    return rows.mapInArrow(run, ", ".join(f"`{k}` {types[k]}" for k in keys) + f", {RUN}")


def said(symbols: np.ndarray, pos: np.ndarray, length: np.ndarray, most: int):
    """The characters of phrases, up to most at a time. symbols has a dictionary's characters and then the 256 of literals."""
    n = len(symbols) - 256
    literal, start = length == 0, np.clip(pos, 0, n)
    size = np.where(literal, pos >= 0, np.clip(pos + length, 0, n) - start)
    start = np.where(literal, n + (pos & 255), start)
    ends = np.cumsum(size)
    if len(ends) and ends[-1] <= most:
        yield symbols[np.arange(ends[-1]) + np.repeat(start - ends + size, size)]
        return
    for x, k in zip(start.tolist(), size.tolist()):
        for at in range(x, x + k, most):
            yield symbols[at : min(at + most, x + k)]


def _decoded_by_task(runs: DataFrame, dictionaries: DataFrame, group: str, ids: list[str]) -> DataFrame:
    """decoded_parts() of phrase_runs() whose dictionaries a task can hold."""
    from .chunks import pieces

    bounded_batches(runs.sparkSession)
    types = dict(runs.dtypes)
    totals = runs.groupBy(group).agg(F.ceil(F.sum(F.size("pos")) / BLOCK_PHRASES).alias("blocks")).checkpoint()
    block = F.pmod(F.xxhash64(*ids), F.col("blocks")).alias("block")
    dealt = runs.join(totals.withColumnRenamed(group, "_group"), F.col(group).eqNullSafe(F.col("_group"))).select(group, block, F.lit(1).alias("kind"), *ids, "first_ix", "pos", "len", F.lit(None).cast("string").alias("piece"))
    cut = pieces(dictionaries.select(F.col(group).alias("key"), F.col("dictionary").alias("text")), DICTIONARY_ROW).withColumnRenamed("key", group)
    none = F.lit(None).cast("array<bigint>")
    heads = cut.join(totals, group).select(group, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("kind"), *(F.lit(None).cast(types[k]).alias(k) for k in ids), F.col("piece_ix").alias("first_ix"), none.alias("pos"), none.alias("len"), "piece")
    rows = dealt.unionByName(heads).repartition(group, "block").sortWithinPartitions(group, "block", "kind", *ids, "first_ix")
    names, most = [group, *ids], TEXT_PART

    def text(parts: list[np.ndarray]) -> str:
        return np.concatenate(parts).tobytes().decode("utf-32-le", "surrogatepass")

    def run(batches):
        literals = np.arange(256, dtype=np.uint32)
        at, symbols, key, part, held, n = None, literals, None, 0, [], 0
        read: list[str] = []
        out: list[tuple] = []
        size = 0

        def made():
            nonlocal out, size
            columns = [pa.array([k[j] for k, _, _ in out], schema[j]) for j in range(len(names))]
            rows = pa.RecordBatch.from_arrays([*columns, pa.array([x for _, x, _ in out], pa.int64()), pa.array([t for _, _, t in out], pa.string())], names=[*names, "part", "text"])
            out, size = [], 0
            return rows

        for batch in batches:
            column = {k: batch.column(j) for j, k in enumerate(batch.schema.names)}
            schema = [column[k].type for k in names]
            keys, places = list(zip(*(column[k].to_pylist() for k in names))), list(zip(column[group].to_pylist(), column["block"].to_pylist()))
            kinds = column["kind"].to_pylist()
            offsets = column["pos"].offsets.to_numpy().tolist()
            pos, length = (column[k].values.to_numpy() for k in ("pos", "len"))
            for r in range(batch.num_rows):
                if places[r] != at:
                    at, symbols, read = places[r], literals, []
                if not kinds[r]:
                    read.append(column["piece"][r].as_py())
                    continue
                if read:  # all pieces of a dictionary come before its phrases
                    symbols, read = np.concatenate([np.frombuffer("".join(read).encode("utf-32-le", "surrogatepass"), np.uint32), literals]), []
                if keys[r] != key:
                    if n:
                        out.append((key, part, text(held)))
                        size += n
                    key, part, held, n = keys[r], 0, [], 0
                for x in said(symbols, pos[offsets[r] : offsets[r + 1]], length[offsets[r] : offsets[r + 1]], most):
                    held.append(x)
                    n += len(x)
                    if n > most:  # a part at most, as said() gives no more than one at a time
                        whole = np.concatenate(held)
                        out.append((key, part, text([whole[:most]])))
                        size += most
                        part, held, n = part + 1, [whole[most:]], n - most
                    if size >= 16 * most:
                        yield made()
            if len(out) >= 2_000:
                yield made()
        if n:
            out.append((key, part, text(held)))
        if out:
            yield made()

    return rows.mapInArrow(run, ", ".join(f"`{k}` {types[k]}" for k in names) + ", part bigint, text string")


#: Numbers below 0 that literals have in place of a piece's, so that they are spread where the join shuffles.
NO_PIECE = 4096


def _decoded_by_pieces(phrases: DataFrame, dictionaries: DataFrame, group: str, ids: list[str]) -> DataFrame:
    """decoded_parts() of phrases by a join with pieces of dictionaries of any size. Rows are dealt by parses for the sums, and stay so for the texts where pieces can be broadcast."""
    from .chunks import pieces
    from .phrases import effective, running

    rows = running(phrases.withColumn("_key", F.struct(group, *ids)), {"_at": effective(F.col("len"))}, key="_key")
    part = F.floor(F.col("_at") / TEXT_PART).alias("part")
    literal = F.col("len") <= 0
    first, last = F.floor(F.col("pos") / DICTIONARY_PIECE), F.floor((F.col("pos") + F.col("len") - 1) / DICTIONARY_PIECE)
    asked = F.when(literal, F.array(-1 - F.pmod("phrase_ix", F.lit(NO_PIECE)))).otherwise(F.sequence(first, last))
    asked = rows.where("len >= 0").select("_key", F.col(group).alias("_group"), part, "phrase_ix", "pos", "len", F.explode(asked).alias("piece_ix"))
    cut = pieces(dictionaries.select(F.col(group).alias("key"), F.col("dictionary").alias("text")), DICTIONARY_PIECE).withColumnRenamed("key", "_group")
    start = F.greatest(F.col("pos") - F.col("piece_ix") * DICTIONARY_PIECE, F.lit(0))
    end = F.least(F.col("pos") + F.col("len") - F.col("piece_ix") * DICTIONARY_PIECE, F.lit(DICTIONARY_PIECE))
    copied = F.substring("piece", (start + 1).cast("int"), (end - start).cast("int"))
    found = asked.join(cut, ["_group", "piece_ix"], "left").select("_key", "part", "phrase_ix", "piece_ix", F.when(literal, F.chr("pos")).otherwise(copied).alias("said")).where("said is not null")
    ordered = F.array_sort(F.collect_list(F.struct("phrase_ix", "piece_ix", "said")))
    texts = found.groupBy("_key", "part").agg(F.array_join(F.transform(ordered, lambda x: x["said"]), "").alias("text"))
    return texts.select(*(F.col(f"_key.{k}").alias(k) for k in (group, *ids)), "part", "text")


def decoded_by_rounds(phrases: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(key, part, text) of parses (key, phrase_ix, pos, len) whose sources are in their own text, which may be of any length: texts in parts of TEXT_PART characters.

    Every character is a row that knows where it is copied from; in each round one that isn't settled takes over
    what its source knows, its character or its own source. So chains of copies halve: a round for each doubling of the
    longest. What isn't settled is written and read again each round.
    """
    from .phrases import limits

    spark = phrases.sparkSession
    folder = f"{shared_folder(spark)}/decoded-{uuid.uuid4().hex}"

    def table(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    rows = limits(phrases)
    n = F.col("text_end") - F.col("text_start")
    every = rows.select("key", "pos", "len", "text_start", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("k"))
    copied = F.col("len") > 0
    state = table(every.select("key", (F.col("text_start") + F.col("k")).alias("at"), F.when(copied, F.col("pos") + F.col("k")).alias("source"), F.when(~copied, F.chr("pos")).alias("said")), "0")
    for k in range(1, most_rounds):
        open_rows = state.where("source is not null")
        if open_rows.isEmpty():
            ordered = F.array_sort(F.collect_list(F.struct("at", "said")))
            return state.groupBy("key", F.floor(F.col("at") / TEXT_PART).alias("part")).agg(F.array_join(F.transform(ordered, lambda x: x["said"]), "").alias("text"))
        known = state.select("key", F.col("at").alias("source"), F.col("source").alias("further"), F.col("said").alias("heard"))
        fresh = open_rows.join(known, ["key", "source"], "left")
        lost = F.raise_error(F.concat(F.lit("nothing to copy at "), F.col("at").cast("string"), F.lit(" of "), F.col("key").cast("string")))
        said = F.when(F.col("further").isNull() & F.col("heard").isNull(), lost).otherwise(F.col("heard"))
        state = table(state.where("source is null").unionByName(fresh.select("key", "at", F.col("further").alias("source"), said.alias("said"))), str(k))
    raise ValueError("copies form a cycle")


def suffix_arrays(texts: DataFrame) -> DataFrame:
    """(key, rank, suffix) of each text. Null and empty texts have no rows; repeated rows repeat theirs."""

    def run(batches):
        for batch in batches:
            for part in _slices(batch, ["text"]):
                found = [kernels.suffix_array(symbols(t)) for t in part.column("text").to_pylist()]
                yield _batch({"key": part.column("key")}, [len(x) for x in found], {"rank": [np.arange(len(x)) for x in found], "suffix": found})

    return spread(texts.select("key", "text")).mapInArrow(run, "key string, rank bigint, suffix bigint")


def lcp_arrays(texts: DataFrame) -> DataFrame:
    """(key, rank, lcp): of each text's suffixes in order, what each has in common with the one before; 0 for the first."""

    def run(batches):
        for batch in batches:
            for part in _slices(batch, ["text"]):
                found = [kernels.lcp_array(t, kernels.suffix_array(t)) for t in map(symbols, part.column("text").to_pylist())]
                yield _batch({"key": part.column("key")}, [len(x) for x in found], {"rank": [np.arange(len(x)) for x in found], "lcp": found})

    return spread(texts.select("key", "text")).mapInArrow(run, "key string, rank bigint, lcp bigint")


def longest_parts(texts: DataFrame) -> DataFrame:
    """(key, at, previous, matching) of every place of texts (key, text, dictionary): the longest part from there that begins earlier in the text, and that the dictionary has."""

    def run(batches):
        for batch in batches:
            for part in _slices(batch, ["text", "dictionary"]):
                pairs = [(symbols(t), symbols(d)) for t, d in zip(part.column("text").to_pylist(), part.column("dictionary").to_pylist())]
                found = {"at": [np.arange(len(t)) for t, _ in pairs], "previous": [kernels.longest_previous(t) for t, _ in pairs], "matching": [kernels.matching_statistics(t, kernels.Reference(d)) for t, d in pairs]}
                yield _batch({"key": part.column("key")}, [len(t) for t, _ in pairs], found)

    return spread(texts.select("key", "text", "dictionary")).mapInArrow(run, "key string, at bigint, previous bigint, matching bigint")


def transforms(texts: DataFrame) -> DataFrame:
    """(key, bwt) of texts (key, text): the Burrows-Wheeler transform with 0 as the end; texts must have no zero character. A null text has an empty one."""

    @F.arrow_udf("string")
    def bwt(batch: pa.Array) -> pa.Array:
        return pa.array([kernels.transform(t, kernels.suffix_array(t)).decode("latin-1") for t in map(symbols, batch.to_pylist())], pa.string())

    return spread(texts.select("key", "text")).select("key", bwt("text").alias("bwt"))
