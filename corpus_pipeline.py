"""From documents to token ids: toxic documents go, near copies go, benchmark leaks go, personal data is replaced, texts are encoded.

Null and empty texts go through all stages: they score as texts without a voter's word, are copies of nothing, leak nothing, hold no
personal data and have no tokens. Rows of one text are copies, of which that with the smallest id stays (rows of one id stay together); a table without rows gives
one without rows. Columns besides doc_id and text pass through up to the last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lzseq.functions.session import remove
from lzseq.llm import bpe, decontaminate, neardup, pii, textkit, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3 by a model fitted on labelled documents of this input."""
    return toxicity.acceptable(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity of 0.8 or more) the document with the smallest id."""
    return neardup.unique(docs, words=5)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item, exact or within the edit budget."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data."""
    return pii.anonymised(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of all documents."""
    return bpe.encode_documents(docs, with_ids=True, cached=100_000)  # stages before leave workers less memory than they have for this one alone


STAGES = [("toxicity", drop_toxic), ("near-dedup", drop_near_copies), ("decontamination", drop_leaks), ("pii", replace_personal_data), ("bpe", encode)]

#: The stages are learned, sketched or keyed; tests hold them against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each one's result is written to the shared folder and read again, and goes when the next one is written. The last one stays, as the rows are read from it."""
    folder = f"{textkit.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
