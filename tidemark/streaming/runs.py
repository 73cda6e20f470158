"""Running the batch operators over folders that grow. The operators are frames to frames, so they take streams as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def line_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Lines of text files as they arrive below `path`, as `value`."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)


def run_counts(counts: DataFrame, keys: list[str], count: str, path: str, state: str) -> None:
    """Bring a table of counts below `path` up to date with all that has arrived, then stop.

    `counts` is an aggregate over a stream. Each batch writes the keys that changed, under its number; a batch that runs again writes
    the same rows once more. `current_counts` reads the table.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.select(*keys, count).write.mode("overwrite").parquet(f"{path}/batch={number}")

    counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def current_counts(spark: SparkSession, path: str, keys: list[str], count: str) -> DataFrame:
    """The latest count of each key."""
    return spark.read.parquet(path).groupBy(*keys).agg(F.max_by(count, "batch").alias(count))
