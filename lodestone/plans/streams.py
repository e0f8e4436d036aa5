"""The streaming queries, run to the end of the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.stores import shared_folder as _folder
from lodestone.streaming import ingest as S


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a stream: their file, or folder of files."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/events.parquet*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


SLICES = 8


def _in_time(spark: SparkSession, sf: str) -> tuple[DataFrame, str]:
    """The events as a stream that comes slice by slice of their time, as a log does, and the width of a slice.

    Inside a slice rows come in no order, so a row is late by one slice at most."""
    rows = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    low, high = rows.agg(F.min("ts").cast("double"), F.max("ts").cast("double")).first()
    low, width = low or 0.0, max(1.0, ((high or 0.0) - (low or 0.0)) / SLICES)
    path = _folder(spark, "stream-events")
    at = F.least(F.floor((F.col("ts").cast("double") - low) / width), F.lit(SLICES - 1))
    for k in range(SLICES):  # one folder after another: files are read by their age
        rows.where(at == k).write.parquet(f"{path}/slice={k}")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(path)
    return source, f"{int(width) + 1} seconds"


def windows(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly counts by event type; the state of a window goes when the watermark, a slice behind the latest event, has passed it."""
    events, late = _in_time(spark, sf)
    rows = S.windowed_counts(events, "ts", "event_type", late=late)
    path = _folder(spark, "stream-windows")
    got = S.run_to_table(spark, rows, "update", path, _folder(spark, "stream-state"))
    last = got.withColumn("_at", F.regexp_extract(F.col("_metadata.file_path"), r"batch=(\d+)", 1).cast("long"))
    return last.groupBy("window_start", "event_type").agg(F.max_by("n", "_at").alias("n"), F.max_by("total", "_at").alias("total")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def first_seen(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.first_seen(_events(spark, sf), "user_id").select("user_id", "event_id")
    got = S.run_to_table(spark, rows, "append", _folder(spark, "stream-first"), _folder(spark, "stream-state"))
    return got.agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_keys"))


def ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Interactions made of events, validated and appended batch by batch."""
    rows = _events(spark, sf).select(
        F.col("user_id").cast("string").alias("qid"), F.col("event_id").cast("string").alias("pid"), F.col("event_type").alias("query"), F.col("props").alias("product_title"),
        F.lit("").alias("brand"), F.lit("").alias("category"), (F.col("event_id") % 4).cast("int").alias("relevance"),
    )
    path = _folder(spark, "stream-ingest")
    S.ingest(rows, path, _folder(spark, "stream-state")).awaitTermination()
    return spark.read.parquet(path).groupBy("relevance").agg(F.count("*").alias("n"))
