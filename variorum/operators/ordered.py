"""Ordered scans that do not put a whole key into one task.

A window over a key sorts that key in one task. Where one key can hold a third of all rows the
scan below works on ``(key, bucket)`` instead: ``bucket`` is any column that never falls while the
order rises. Each bucket is scanned alone, one summary row per bucket is scanned over the key, and
the carried value is joined back on the columns the rows are already partitioned by.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BUCKET_ROWS = 4096


def bucket_of(order: str | Column, size: int = BUCKET_ROWS) -> Column:
    order = F.col(order) if isinstance(order, str) else order
    return F.floor(order / F.lit(size)).cast("long")


def two_pass(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    bucket: Column,
    within: dict[str, Callable[[WindowSpec], Column]],
    summary: dict[str, Column],
    carried: dict[str, Callable[[WindowSpec], Column]],
) -> DataFrame:
    """Any number of scans in the same order for two readings of ``df`` and one join.

    ``within``: columns of a row from the rows of its bucket, given the bucket's window in order.
    ``summary``: aggregates of a bucket, reduced before the shuffle; ``carried``: columns that a bucket
    gets from the summaries of its key, given their window in order. Both kinds of columns are added.
    """
    keys = list(keys)
    marked = df.withColumn("_bucket", bucket)
    rows = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    buckets = Window.partitionBy(*keys).orderBy("_bucket")
    told = marked.groupBy(*keys, "_bucket").agg(*(c.alias(name) for name, c in summary.items()))
    brought = told.select(*keys, "_bucket", *(make(buckets).alias(name) for name, make in carried.items()))
    scanned = marked.select("*", *(make(rows).alias(name) for name, make in within.items()))
    return scanned.join(brought, [*keys, "_bucket"]).drop("_bucket")


def up_to(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, 0)


def before(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, -1)


def after(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(1, Window.unboundedFollowing)


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], bucket: Column, value: Column, out: str
) -> DataFrame:
    """Inclusive running sum of ``value`` in order."""
    scanned = two_pass(
        df.withColumn("_value", value.cast("long")),
        keys,
        order,
        bucket,
        {out: lambda w: F.sum("_value").over(up_to(w))},
        {"_total": F.sum("_value")},
        {"_carried": lambda w: F.sum("_total").over(before(w))},
    )
    return scanned.withColumn(out, F.col(out) + F.coalesce(F.col("_carried"), F.lit(0))).drop("_value", "_carried")


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], bucket: Column, out: str, start: int = 0
) -> DataFrame:
    """Consecutive numbers in order, from ``start``."""
    counted = running_total(df, keys, order, bucket, F.lit(1), out)
    return counted.withColumn(out, F.col(out) - 1 + start)


def carry_last(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, value: Column, out: str
) -> DataFrame:
    """Last non-null ``value`` up to and including the row."""
    told = F.when(F.col("_value").isNotNull(), F.struct(*order))
    scanned = two_pass(
        df.withColumn("_value", value),
        keys,
        order,
        bucket,
        {out: lambda w: F.last("_value", ignorenulls=True).over(up_to(w))},
        {"_newest": F.max_by("_value", told)},
        {"_carried": lambda w: F.last("_newest", ignorenulls=True).over(before(w))},
    )
    return scanned.withColumn(out, F.coalesce(F.col(out), F.col("_carried"))).drop("_value", "_carried")


def joined_text(order: str, text: str, separator: str) -> Column:
    """Aggregate: texts of a group joined in order. The result is one value, so the group is its size."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return F.array_join(F.transform(rows, lambda r: r["t"]), separator)


def last_per_key(rows: DataFrame, keys: Sequence[str], order: str = "seq") -> DataFrame:
    """One row per key: that with the largest ``order`` or, in a table without such a column, the largest values.

    Reduced before the shuffle, so a key with many rows costs one row a task.
    """
    rest = [c for c in rows.columns if c not in keys]
    by = [order, *(c for c in rest if c != order)] if order in rest else rest
    last = rows.groupBy(*keys).agg(F.max(F.struct(*by)).alias("_last"))
    return last.select(*keys, *(F.col(f"_last.{c}").alias(c) for c in rest))
