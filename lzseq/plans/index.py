"""The index: built from texts, kept as a directory of tables, merged from parts, and queried by operators.search."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import group_key
from ..functions.session import exists, keep, shared_folder
from ..operators import dictionaries, fm, parses, phrases


@dataclass(frozen=True)
class Parameters:
    max_query_len: int = 32
    max_edit_distance: int = 0
    separator: str = "$"
    sample_every: int = 512
    kernel: str = "exact"

    def __post_init__(self):
        if self.max_query_len < 1 or self.max_edit_distance < 0 or len(self.separator) > 1:
            raise ValueError("max_query_len must be at least 1, max_edit_distance at least 0, the separator one character, or none for one that no text has")

    @property
    def context(self) -> int:
        return self.max_query_len + self.max_edit_distance


#: Tables that are saved in folders, and by what.
SPLIT_BY = {"blocks": lambda: fm.bucket_of("key"), "directory": lambda: F.col("part")}


@dataclass
class Index:
    """limited: merged phrases with text and kernel limits and, where copies are from another key, source; kernels: (key, kernel);
    catalogue: where sequences lie, from being the place of a part within its sequence; names: (seq_id, name, length), or None;
    blocks, directory: the kernels' search structure (operators.fm), or None: then a search goes over the kernels."""

    parameters: Parameters
    limited: DataFrame
    kernels: DataFrame
    catalogue: DataFrame
    names: DataFrame | None = None
    blocks: DataFrame | None = None
    directory: DataFrame | None = None

    @property
    def merged(self) -> DataFrame:
        return self.limited

    def tables(self) -> dict[str, DataFrame]:
        return {k: getattr(self, k) for k in ("limited", "kernels", "catalogue", "names", "blocks", "directory") if getattr(self, k) is not None}

    def space(self) -> DataFrame:
        """Characters of texts and kernels, phrases and copies of each key, and the kernel's share of the text."""
        rows = self.limited.groupBy("key").agg(F.max("text_end").alias("text_chars"), F.max("k_end").alias("kernel_chars"), F.count(F.lit(1)).alias("n_phrases"), F.sum((~F.col("is_literal")).cast("bigint")).alias("n_copies"))
        return rows.withColumn("share", F.col("kernel_chars") / F.col("text_chars"))

    def components(self) -> DataFrame:
        """(component, n_rows, n_bytes) of each table: numbers as wide as their type, texts and binaries by their bytes."""
        parts = []
        for name, table in self.tables().items():
            sizes = [F.coalesce(F.octet_length(c), F.lit(0)) if t in ("string", "binary") else F.lit({"bigint": 8, "int": 4, "boolean": 1}[t]) if t != "array<int>" else 4 * F.size(c) for c, t in table.drop("bucket").dtypes]
            parts.append(table.agg(F.lit(name).alias("component"), F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(reduce(lambda a, b: a + b, sizes)), F.lit(0)).cast("bigint").alias("n_bytes")))
        return reduce(DataFrame.unionByName, parts)

    def samples(self) -> DataFrame:
        return phrases.sampled(self.limited, self.parameters.sample_every)

    def searchable(self) -> Index:
        """The index with its kernels' search structure."""
        return self if self.blocks is not None else replace(self, blocks=fm.blocks(self.kernels, "kernel"), directory=fm.directory(self.kernels, "kernel"))

    def save(self, path: str, search: bool = True) -> None:
        """Writes the tables to a folder each, with the search structure, which is split so that a search reads only what it needs, or without it."""
        spark = self.limited.sparkSession
        for name, table in self.tables().items():
            if name not in SPLIT_BY:
                table.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
        if search:
            self.save_search(path)
        spark.createDataFrame([tuple(asdict(self.parameters).values())], ", ".join(f"`{k}` {'string' if isinstance(v, str) else 'int'}" for k, v in asdict(self.parameters).items())).write.mode("overwrite").parquet(f"{path}/parameters")

    def save_search(self, path: str) -> None:
        """Writes the search structure alone, of which there must be no older one that is read from there."""
        for name, bucket in SPLIT_BY.items():
            if name == "blocks" and self.blocks is None:  # kernels are less to shuffle than what is made of them
                rows = fm.blocks(self.kernels.repartition(bucket()), "kernel").withColumn("bucket", bucket())
            else:
                table = fm.directory(self.kernels, "kernel") if self.blocks is None else getattr(self, name)
                rows = table.drop("bucket").withColumn("bucket", bucket()).repartition("bucket")
            rows.sortWithinPartitions("bucket", "key").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        p = Parameters(**spark.read.parquet(f"{path}/parameters").first().asDict())
        there = lambda name: spark.read.parquet(f"{path}/{name}") if exists(spark, f"{path}/{name}") else None
        return Index(p, *(spark.read.parquet(f"{path}/{name}") for name in ("limited", "kernels", "catalogue")), there("names"), there("blocks"), there("directory"))


def parse(texts: DataFrame, method: str = "lz77", prefix_chars: int | None = None, context: int | None = None) -> DataFrame:
    """(key, phrase_ix, pos, len) by method: lz77, lz77_leftmost, or rlz with the first prefix_chars of each text as dictionary. With a context the first two merge short phrases where they find them.

    Relative parses are text-valid: the prefix itself is parsed too, so every source lies in the text before its phrase.
    """
    if method in ("lz77", "lz77_leftmost"):
        return parses.lz77_phrases(texts, leftmost=method == "lz77_leftmost", context=context)
    if method != "rlz" or not prefix_chars:
        raise ValueError("the method is lz77, lz77_leftmost or rlz with prefix_chars")
    head = parses.lz77_phrases(texts.select("key", F.left("text", F.lit(prefix_chars)).alias("text")))
    n = head.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    rest = texts.where(F.length("text") > prefix_chars).select("key", F.expr(f"substring(text, {prefix_chars + 1})").alias("seq"), F.left("text", F.lit(prefix_chars)).alias("dictionary"))
    tail = parses.rlz_phrases(rest, ["key"], leftmost=False).join(n, "key").withColumn("phrase_ix", F.col("phrase_ix") + F.col("n")).drop("n")
    return head.unionByName(tail)


def kernelize(texts: DataFrame, parsed: DataFrame, parameters: Parameters) -> tuple[DataFrame, DataFrame]:
    """(limited, kernels) of texts (key, text) and their parses, whose short phrases may be merged already, without a search structure."""
    shared_folder(texts.sparkSession)
    c, k = parameters.context, parameters.max_edit_distance
    hot = phrases.hot_key(parsed)  # merged phrases are no more than these, which are counted once
    merged = parsed if "is_literal" in parsed.columns else phrases.merge_short(parsed, c, hot)
    limited = keep(phrases.kernel_limits(merged, c, k, hot))
    return limited, phrases.kernels_of(limited, texts, c, k, parameters.separator)


def with_separator(texts: DataFrame, parameters: Parameters) -> Parameters:
    """The parameters with a separator that no text has, where they leave it open; raises on a given one that a text has."""
    if not parameters.separator:
        return replace(parameters, separator=phrases.separator(texts).first()[0])
    if not texts.where(F.contains("text", F.lit(parameters.separator))).isEmpty():
        raise ValueError(f"a text has the separator {parameters.separator!r}")
    return parameters


def build(texts: DataFrame, catalogue: DataFrame, parameters: Parameters = Parameters(), method: str = "lz77", prefix_chars: int | None = None, checkpoint: bool = True, parsed: DataFrame | None = None) -> Index:
    """An index over texts, parsed by method or as given in parsed (key, phrase_ix, pos, len).

    checkpoint keeps the parse, so that it isn't computed for the limits and the kernels each. Null and empty texts have
    no rows in it.
    """
    shared_folder(texts.sparkSession)
    parameters = with_separator(texts, parameters)
    parsed = parse(texts, method, prefix_chars, parameters.context) if parsed is None else parsed
    if checkpoint:
        parsed = keep(parsed)
    limited, kernels = kernelize(texts, parsed, parameters)
    return Index(parameters, limited, keep(kernels) if checkpoint else kernels, catalogue)


def over_sequences(seqs: DataFrame, parameters: Parameters = Parameters(), group: str = "groupname", block_chars: int = parses.BLOCK_CHARS, kept: bool = False, **options) -> Index:
    """An index over sequences (seq_id, seq, group), packed into blocks. Sequences longer than a block are cut into parts that overlap by what a query may take, so no task parses more than a block. kept: the sequences are those of a table."""
    shared_folder(seqs.sparkSession)
    seqs = seqs.select("seq_id", group, "seq") if kept else keep(seqs.select("seq_id", group, "seq"))  # texts and catalogue go over them several times each
    texts, catalogue = parses.block_texts(parses.cut_long(seqs, block_chars, parameters.context, group), group, block_chars)
    return build(keep(texts), keep(catalogue), parameters, **options)


def over_groups(seqs: DataFrame, parameters: Parameters = Parameters(), quotient: float = dictionaries.QUOTIENT, most: int = dictionaries.MOST, block_chars: int = parses.BLOCK_CHARS, kept: bool = False) -> Index:
    """An index over sequences (seq_id, header, seq) by relative parses: of each group the dictionary is kept whole, the
    other sequences as copies from it.

    The dictionary of a group is a key of its own, one literal phrase; the others are packed into blocks, whose copies
    have the dictionary as source. So the index grows with what is new in a sequence, a hot group is many blocks, and all
    copies are found in one round. Sequences without bases have no place in it. kept: the sequences are those of a table.
    """
    shared_folder(seqs.sparkSession)
    seqs = seqs.select("seq_id", "header", "seq") if kept else keep(seqs.select("seq_id", "header", "seq"))  # dictionaries, texts and catalogue go over them several times each
    selection = keep(dictionaries.taxon_selection(seqs, quotient, most))
    head_key = F.concat("groupname", F.lit("/dictionary"))
    heads = keep(dictionaries.texts(selection, seqs).where(F.length("text") > 0))
    chosen = selection.select("seq_id")
    rest = seqs.select("seq_id", group_key(F.col("header")).alias("groupname"), "seq").where(F.length("seq") > 0).join(chosen, "seq_id", "left_anti")
    texts, catalogue = parses.block_texts(parses.cut_long(rest, block_chars, parameters.context), "groupname", block_chars)
    texts = keep(texts)
    parameters = with_separator(texts.select("text").unionByName(heads.select("text")), parameters)
    group = F.regexp_replace("key", "/[^/]*$", "")
    parsed = parses.rlz_by_group(texts.select(group.alias("groupname"), "key", F.xxhash64("key").alias("seq_id"), F.col("text").alias("seq")), heads.withColumnRenamed("text", "dictionary"), "groupname", ["key", "seq_id"], leftmost=False, context=parameters.context)
    parsed = keep(parsed.drop("groupname", "seq_id")).withColumn("source", F.regexp_replace("key", "/[^/]*$", "/dictionary"))
    limited, kernels = kernelize(texts, parsed, parameters)
    n, zero = F.length("text").cast("bigint"), F.lit(0).cast("bigint")
    whole = heads.select(head_key.alias("key"), zero.alias("phrase_ix"), zero.alias("pos"), n.alias("len"), F.lit(True).alias("is_literal"), zero.alias("text_start"), n.alias("text_end"), head_key.alias("source"), F.lit(True).alias("is_last"), zero.alias("k_start"), n.alias("k_end"))
    at = dictionaries.offsets(selection).where("length > 0").select(head_key.alias("key"), (F.col("dict_ord") - 1).cast("bigint").alias("seq_ix"), "seq_id", F.col("length").cast("bigint").alias("length"), F.col("dict_start").alias("start"), F.col("dict_end").alias("end"), zero.alias("from"))
    return Index(parameters, limited.unionByName(whole), keep(kernels.unionByName(heads.select(head_key.alias("key"), F.col("text").alias("kernel")))), keep(catalogue.unionByName(at)))


def merge(parts: list[Index]) -> Index:
    """Indexes as one, as if their sequences had been numbered one after the other; they must share their parameters but for the separator.

    Keys get the part's number, and ids move by the ids before (a row a part) or, if they are text, get that number too;
    so parts may have the same keys and ids.
    """
    if len({replace(p.parameters, separator="$") for p in parts}) != 1:
        raise ValueError("parts of an index must have the same parameters")
    if len({p.names is None for p in parts}) != 1:
        raise ValueError("either all parts of an index have names or none")
    if len({p.blocks is None for p in parts}) != 1:
        parts = [p.searchable() for p in parts]
    moved, by = [], 0
    for n, p in enumerate(parts):
        key = F.concat(F.lit(f"{n}/"), "key")
        tables = {k: t.drop("bucket").withColumn("key", key) if "key" in t.columns else t for k, t in p.tables().items()}
        source = F.concat(F.lit(f"{n}/"), "source") if "source" in p.limited.columns else F.col("key")
        tables["limited"] = tables["limited"].withColumn("source", source)
        for k in ("catalogue", "names"):
            if k in tables:
                tables[k] = tables[k].withColumn("seq_id", F.concat(F.lit(f"{n}/"), "seq_id") if dict(tables[k].dtypes)["seq_id"] == "string" else F.col("seq_id") + by)
        moved.append(tables)
        top = p.catalogue.agg(F.max("seq_id")).first()[0]
        last = p.names.agg(F.max("seq_id")).first()[0] if p.names is not None else None
        by += max([x + 1 for x in (top, last) if isinstance(x, int)], default=0)
    return Index(parts[0].parameters, **{k: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (t[k] for t in moved)) for k in moved[0]})
