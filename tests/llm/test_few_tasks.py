import random

import pytest
from pyspark.sql import functions as F

from lzseq.llm import neardup


def brute(edges):
    root = {}
    for a, b in edges:
        for x in (a, b):
            root.setdefault(x, x)
        a, b = sorted((root[a], root[b]))
        root = {k: a if v == b else v for k, v in root.items()}
    return root


@pytest.fixture
def many_partitions(spark):
    """Shuffles of 40 partitions that stay so many."""
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("few", [0, 40, 50_000])
def test_components_by_rounds_and_in_one_task(spark, monkeypatch, few):
    monkeypatch.setattr(neardup, "FEW_EDGES", few)
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(100, 160)] + [(k + 7, 3) for k in range(200, 230)] + [tuple(rng.sample(range(-50, 50), 2)) for _ in range(25)]
    rng.shuffle(edges)
    got = {r.id: r.component for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = brute(edges)
    assert got == want
    assert neardup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_few_edges_take_few_jobs(spark, many_partitions):
    links = spark.range(500).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).repartition(40).checkpoint()
    spark.sparkContext.setJobGroup("few-edges", "")
    assert {r.component for r in neardup.components(links).collect()} == {0}
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("few-edges")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(jobs) <= 6


def test_few_rows_are_in_few_tasks(spark, many_partitions):
    rows = spark.range(300).select((F.col("id") % 60).alias("group"), F.lit(0).alias("lo"), F.lit(0).alias("hi"), "id", F.lit(-1).alias("side"), F.col("id").alias("part"), F.lit("x").alias("data"))
    dealt = neardup.by_task(rows, ["data"], 300)
    assert dealt.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    seen = [[r.group for r in part] for part in dealt.rdd.glom().collect()]
    assert sum(map(len, seen)) == 300
    changes = [g for part in seen for k, g in enumerate(part) if not k or part[k - 1] != g]
    assert len(changes) == len(set(changes)) == 60  # each group in one task, its rows after each other
    assert neardup.by_task(rows, ["data"], 1 << 40).rdd.getNumPartitions() == 40
