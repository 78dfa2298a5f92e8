"""Texts are read once for seeds of all lengths."""

from pyspark.sql import functions as F

from lzseq.operators import search


def test_texts_are_read_once_for_all_lengths(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(k):
        made.add(1)
        return "ACGTTGCAACGGTACA"[k % 5 :]

    texts = spark.range(10).select(F.col("id").cast("string").alias("key"), text(F.col("id").cast("int")).alias("text"))
    patterns = spark.createDataFrame([(k, "ACGTTGCAACGGTACA"[4 : 4 + n]) for k, n in enumerate((1, 2, 3, 5, 9))], "query_id bigint, pattern string")
    found = {(r.key, r.query_id, r.pos) for r in search.located(texts.withColumnRenamed("text", "kernel"), patterns, 20).collect()}
    assert made.value == 10
    plain = {(str(k), q, p) for k in range(10) for q, n in enumerate((1, 2, 3, 5, 9)) for p in range(16 - k % 5) if "ACGTTGCAACGGTACA"[k % 5 :].startswith("ACGTTGCAACGGTACA"[4 : 4 + n], p)}
    assert found == plain
