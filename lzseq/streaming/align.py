"""Patterns that arrive as a stream, searched in a saved or built index, micro-batch by micro-batch. No state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import search


def read_patterns(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (value, file) lines of files as they come into the folder."""
    from pyspark.sql import functions as F

    return spark.readStream.text(folder).select("value", F.col("_metadata.file_path").alias("file"))


def find_stream(patterns: DataFrame, index, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Finds every micro-batch of (query_id, pattern) and writes (batch_id, ...) to a folder for each batch, so that a batch that runs again replaces itself."""

    def each(batch: DataFrame, batch_id: int) -> None:
        found = search.find_all(index, batch)
        found.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return patterns.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
