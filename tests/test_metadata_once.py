"""FASTA metadata: lines are read once, and what is sorted doesn't have them."""

from pyspark.sql import functions as F

from lzseq.operators import records


def _lines(spark, made):
    @F.udf("string")
    def value(k):
        made.add(1)
        return f">s{k} x" if k % 4 == 0 else "ACGTACGT"[: 1 + k % 8]

    return spark.range(40).select(F.concat(F.lit("f"), (F.col("id") >= 20).cast("int").cast("string")).alias("file"), F.col("id").alias("line_no"), value(F.col("id").cast("int")).alias("value"))


def test_lines_are_read_once(spark):
    made = spark.sparkContext.accumulator(0)
    found = records.fasta_metadata(_lines(spark, made))
    assert found.count() == 10 and made.value == 40
    row = found.where("file = 'f1' and seq_ix = 1").first()
    assert (row.name, row.length, row.header_sp, row.header_ep, row.line_len) == ("s24", 2 + 3 + 4, 31, 37, 2)
    assert "value" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_metadata_is_made_once_for_merging(spark):
    made = spark.sparkContext.accumulator(0)
    count = F.udf(lambda n: made.add(1) or n, "bigint")
    rows = records.fasta_metadata(_lines(spark, spark.sparkContext.accumulator(0))).withColumn("file_len", count(F.lit(50).cast("bigint") + F.col("seq_ix") * 0))
    assert records.merged_metadata(rows).count() == 10 and made.value == 10
