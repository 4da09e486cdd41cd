"""Structured Streaming over landed event files: sessions, de-duplication and batches."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _run(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run over everything that has landed, then stop; the in-memory sink is for tests and small results."""
    name = f"s{uuid4().hex}"
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def session_counts(events: DataFrame) -> DataFrame:
    """Events per user and session (more than 30 minutes apart); late data up to two hours count."""
    w = F.session_window("ts", "30 minutes").alias("w")
    return events.withWatermark("ts", "2 hours").groupBy("user_id", w).agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("started"), "events")


def first_of_kind(events: DataFrame) -> DataFrame:
    """The first event a user sends of each type while the watermark remembers it."""
    return events.withWatermark("ts", "2 hours").dropDuplicatesWithinWatermark(["user_id", "event_type"])
