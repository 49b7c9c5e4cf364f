"""Readings: one engine's full text for one page."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variorum.functions import text as T

PAGE = ("page_id",)


def mark_valid(readings: DataFrame) -> DataFrame:
    """``failed``: an error is set. ``valid``: no error and visible text. A blank success is neither."""
    failed = F.coalesce(F.col("err"), F.lit("")) != ""
    return readings.withColumn("failed", failed).withColumn(
        "valid", ~failed & ~T.is_blank("text")
    )


def valid_readings(readings: DataFrame) -> DataFrame:
    return mark_valid(readings).filter("valid").drop("failed", "valid")


def reading_counts(readings: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Engines, failed engines and ``n`` (valid readings) per page."""
    return (
        mark_valid(readings)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("engines"),
            F.count_if(F.col("failed")).alias("failed_engines"),
            F.count_if(F.col("valid")).alias("n"),
        )
    )


def collect_readings(*parts: DataFrame, keys: Sequence[str] = PAGE) -> tuple[DataFrame, DataFrame]:
    """Union of per-engine outputs, and the rows whose agent name is used twice on one page.

    Failures stay in the union as rows with ``err``. A page with a repeated name is rejected whole.
    """
    together = reduce(lambda a, b: a.unionByName(b), parts)
    repeated = (
        together.groupBy(*keys, "agent")
        .agg(F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1")
    )
    kept = together.join(repeated.select(*keys).distinct(), list(keys), "left_anti")
    return kept, repeated


def engine_order(readings: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Readings by page, then by byte order of the agent name."""
    return readings.orderBy(*keys, "agent")
