"""Lifecycle event logs, as a batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variorum import schemas


def usable(events: DataFrame) -> DataFrame:
    """Deltas need a stage, an agent and text; a delta without a kind is output."""
    kind = F.when(F.col("type") == "delta", F.coalesce("kind", F.lit("output"))).otherwise(F.coalesce("kind", F.lit("")))
    filled = events.withColumn("kind", kind).na.fill(
        {"stage": "", "agent": "", "text": "", "error": "", "total": 0, "latency_ms": 0, "attempt": 0, "max_attempts": 0}
    )
    empty = (F.col("type") == "delta") & ((F.col("stage") == "") | (F.col("agent") == "") | (F.col("text") == ""))
    return filled.filter(~empty)


def read_lifecycle(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """JSON lines; blank lines hold no event."""
    reader = spark.readStream if streaming else spark.read
    return usable(reader.schema(schemas.EVENT).json(path))
