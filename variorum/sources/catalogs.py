"""Configuration files to catalog, provider and run-setting tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variorum import schemas
from variorum.operators.catalog import reference


def load_catalog(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """One row per model. The key of a provider is reduced to whether there is one.

    JSON lines split over tasks; ``multi_line`` is for hand-written files, one configuration each.
    """
    configs = spark.read.schema(schemas.CONFIG).option("multiLine", multi_line).json(path)
    providers = configs.select(F.explode("providers").alias("p"))
    rows = providers.select(
        F.col("p.id").alias("provider_id"),
        F.coalesce("p.alias", F.lit("")).alias("provider_alias"),
        F.col("p.base_url").alias("base_url"),
        (F.coalesce("p.api_key", F.lit("")) != "").alias("has_api_key"),
        F.explode("p.models").alias("m"),
    )
    return rows.select(
        "provider_id",
        "provider_alias",
        "base_url",
        "has_api_key",
        F.col("m.id").alias("model_id"),
        F.coalesce("m.alias", F.lit("")).alias("alias"),
        F.coalesce("m.context", F.lit(0)).alias("context"),
        F.col("m.api").alias("api"),
    ).withColumn("ref", reference("provider_id", "model_id"))


def load_settings(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Run settings per file, null where the file has no such key."""
    configs = spark.read.schema(schemas.CONFIG).option("multiLine", multi_line).json(path)
    return configs.withColumn("config_id", F.input_file_name()).drop("providers")
