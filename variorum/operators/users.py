"""User table rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variorum.functions import text as T


def validate_users(users: DataFrame) -> DataFrame:
    """Violation rows ``user_id, username, violation``; names are compared trimmed and in lower case."""
    named = users.withColumn("_name", T.trim_space("username")).withColumn("_canonical", F.lower("_name"))
    length = F.char_length("_name")
    bad_char = F.col("_name").rlike(rf"""[{T.SPACE}\p{{Cc}}/\\:'"]""")
    shape = named.select(
        "user_id",
        "username",
        F.when((length < 2) | (length > 32), "length")
        .when(bad_char, "character")
        .when(~F.col("role").isin("admin", "user"), "role")
        .alias("violation"),
    ).filter("violation IS NOT NULL")
    # Only names used more than once come back, so the join side stays as small as the fault.
    twice = (
        named.groupBy("_canonical").agg(F.count(F.lit(1)).alias("_copies")).filter("_copies > 1")
    )
    taken = named.join(twice, "_canonical").select("user_id", "username", F.lit("taken").alias("violation"))
    return shape.unionByName(taken)


def admin_guard(users: DataFrame, changes: DataFrame) -> DataFrame:
    """One row: active admins before and after the change set, and whether it is allowed.

    ``changes``: ``user_id, role, disabled, deleted``; null keeps the old value. The guard only bites
    when the set takes away an active admin.
    """
    told = changes.select(
        "user_id",
        F.col("role").alias("_role"),
        F.col("disabled").alias("_disabled"),
        F.coalesce("deleted", F.lit(False)).alias("_deleted"),
    )
    joined = users.join(told, "user_id", "left")
    was = (F.col("role") == "admin") & ~F.col("disabled")
    will = (
        (F.coalesce("_role", "role") == "admin")
        & ~F.coalesce("_disabled", "disabled")
        & ~F.coalesce("_deleted", F.lit(False))
    )
    counted = joined.agg(
        F.count_if(was).alias("admins_before"),
        F.count_if(will).alias("admins_after"),
        F.count_if(was & ~will).alias("admins_removed"),
    )
    return counted.withColumn("allowed", (F.col("admins_removed") == 0) | (F.col("admins_after") >= 1))
