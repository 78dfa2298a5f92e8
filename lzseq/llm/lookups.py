"""Values of corpus-wide keys for every row: the commonest keys are broadcast, within a bound, the others joined.

Rows name each key once with how often they hold it; what is looked up is summed with these weights.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import shared_folder

#: Steps of a doubling that counts are told apart by when the commonest are chosen.
STEPS = 8


def written(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, so that they are made once; executors that are lost lose nothing of it."""
    path = f"{shared_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def common(counts: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """(rows of the highest n, at most `most` of them; whether these are all). Ties in n stay together."""
    level = F.floor(F.log2(F.col("n").cast("double")) * STEPS).cast("int")
    levels = sorted(((r[0], r[1]) for r in counts.groupBy(level.alias("level")).count().collect()), reverse=True)
    total, least = 0, None
    for at, k in levels:
        total += k
        if total > most:
            return counts.where(level > at), False
        least = at
    return counts, least is None or total <= most


def with_rest(rows: DataFrame, counts: DataFrame, key: str, values: dict, all_known: bool) -> DataFrame:
    """rows with the sums of `values` (name: column of counts) over their array `rest` of (key, times) added to the columns of those names.

    Rows without a rest pass by; of the others only ids and keys are shuffled. A key that many rows hold is dealt by the
    join's skew handling, and partial sums go before the second shuffle.
    """
    if all_known:
        return rows.drop("rest")
    names = rows.columns
    rows = written(rows.withColumn("row_id", F.monotonically_increasing_id()), "rest")
    rest = rows.where(F.size("rest") > 0).select("row_id", F.explode("rest").alias("r")).select("row_id", F.col("r.key").alias(key), "r.times")
    sums = rest.join(counts, key).groupBy("row_id").agg(*(F.sum(F.col("times") * v).alias(f"more_{k}") for k, v in values.items()))
    out = rows.drop("rest").join(sums, "row_id", "left")
    return out.select(*((F.col(c) + F.coalesce(F.col(f"more_{c}"), F.lit(0))).alias(c) if c in values else F.col(c) for c in names if c != "rest"))
