"""Streaming ingestion and status (an extension; batch forms are in operators.jobs)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType


def events(spark: SparkSession, path: str, schema: StructType, files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def windowed(stream: DataFrame, ts: str, key: str, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums of tumbling windows; events later than ``late`` are dropped."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def latest_status(stream: DataFrame, key: str, ts: str, state: str) -> DataFrame:
    """The latest state of each key, for update mode."""
    return stream.groupBy(key).agg(F.max_by(state, F.struct(ts, state)).alias(state), F.max(ts).alias("updated_at"))


def ingest(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each batch of new documents goes to ``handle`` once, which upserts it."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def poll_seconds(active: bool) -> int:
    return 3 if active else 10


def poll_after(active: Column) -> Column:
    """As ``poll_seconds``, of a column; null isn't active."""
    return F.when(active, F.lit(poll_seconds(True))).otherwise(F.lit(poll_seconds(False)))
