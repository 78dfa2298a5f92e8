"""Indexes and compression go over their sequences several times; what makes these must run once."""

import pytest
from pyspark.sql import functions as F

from lzseq.plans import index, jobs


@pytest.mark.parametrize("make", ["sequences", "groups", "taxa", "stripes"])
def test_sequences_are_made_once(spark, make):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seq(k):
        made.add(1)
        return "ACGTTGCA" * (3 + k % 5)

    rows = spark.range(40).select(F.col("id").alias("seq_id"), F.concat(F.lit("A"), F.col("id").cast("string"), F.lit(" x y chromosome 1, scaffold")).alias("header"), F.lit("g").alias("groupname"), seq(F.col("id").cast("int")).alias("seq"))
    if make == "sequences":
        assert index.over_sequences(rows, block_chars=200).catalogue.count() == 40
    elif make == "groups":
        assert index.over_groups(rows).catalogue.count() == 40
    elif make == "taxa":
        assert jobs.compress_taxa(rows)[0].select("seq_id").distinct().count() == 40
    else:
        assert jobs.compress_stripes(rows.withColumn("raw", F.lit("A" * 16)), 2, 3)[0].select("seq_id").distinct().count() == 40
    assert made.value == (80 if make == "stripes" else 40)  # stripes: a filter and the chunks in one pass
