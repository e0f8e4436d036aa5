"""Micro-batch ingest: validated appends, and a catalog of first-seen items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.sources import interactions


def ingest(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Validate every micro-batch and append it to target, in a folder of its batch: a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            interactions.validate(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(stream: DataFrame, key: str, time: str | None = None, late: str = "1 hour") -> DataFrame:
    """The first row of each key; with a time column the state is dropped behind the watermark."""
    if time is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Rows and sum of value by event-time window and kind."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), kind, "n", "total")


def run_to_table(spark: SparkSession, frame: DataFrame, mode: str, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over all there is, append each micro-batch's result below path, and read it back."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = frame.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(path)
