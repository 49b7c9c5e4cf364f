"""Exact duplicates, with DataFrame functions only: frequent digests apart, the rest by shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variorum.session import stage
from variorum.llm.tables import texts, with_row_number

#: Digests that the frequent-items sketch follows. One that fills over a share of about 4 / TRACKED of
#: the rows is always among them, so a group that is left to the shuffle is smaller than that.
TRACKED = 1024
#: Sketches of tasks are merged in this many groups before the last merge.
MERGES = 64


def frequent_digests(rows: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """At most `tracked` digests, among them every one that is frequent (a Misra-Gries sketch).

    Spark's approx_top_k family keeps counters of bounded number and lowers all of them when they run
    out, as Misra and Gries do. Counts come out as estimates and are not used; see `heavy_winners`.
    """
    parts = rows.groupBy((F.spark_partition_id() % MERGES).alias("part")).agg(
        F.expr(f"approx_top_k_accumulate(digest, {tracked})").alias("sketch")
    )
    # Grouped, as a sketch of no rows, which an empty partition would add, cannot be merged.
    merged = parts.groupBy(F.lit(0).alias("all")).agg(F.expr(f"approx_top_k_combine(sketch, {tracked})").alias("sketch"))
    found = merged.select(F.explode(F.expr(f"approx_top_k_estimate(sketch, {tracked})")).alias("found"))
    return found.select(F.col("found.item").alias("digest"))


def heavy_winners(rows: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """Exact size and staying row of each frequent digest that is in fact repeated: at most `tracked` rows."""
    candidates = rows.join(F.broadcast(frequent_digests(rows, tracked)), "digest", "left_semi")
    return (
        candidates.groupBy("digest")
        .agg(F.max(F.struct("doc_id", "row_id")).alias("heavy_stays"), F.count(F.lit(1)).alias("heavy_size"))
        .filter("heavy_size > 1")
    )


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tracked: int = TRACKED
) -> DataFrame:
    """One row for each row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; a null text is an empty one. Of equal texts the row with the largest
    doc_id stays (a null id is the smallest); of repeated rows with that id exactly one. No rows give no
    rows. Only ids and digests are shuffled, and rows of frequent digests not even those: their winners,
    at most `tracked`, are broadcast.
    """
    source = texts(docs, id_col, text_col).select("doc_id", F.sha2("text", 256).alias("digest"))
    rows = stage(with_row_number(source, F.col("doc_id"), F.col("digest")), "digests")
    winners = stage(heavy_winners(rows, tracked), "heavy")
    marked = rows.join(F.broadcast(winners), "digest", "left")
    heavy = marked.filter("heavy_size is not null").select(
        "doc_id", "digest", "row_id", F.col("heavy_stays").alias("stays"), F.col("heavy_size").alias("group_size")
    )
    single = marked.filter("heavy_size is null").select("doc_id", "digest", "row_id")
    # Reduced before the shuffle and joined back: a join can be split where a digest is common, a window cannot.
    groups = stage(
        single.groupBy("digest")
        .agg(F.max(F.struct("doc_id", "row_id")).alias("stays"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1"),
        "copies",
    )
    rest = single.join(groups, "digest", "left").select(
        "doc_id", "digest", "row_id",
        F.coalesce("stays", F.struct("doc_id", "row_id")).alias("stays"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
    )
    return heavy.unionByName(rest).select(
        "doc_id",
        F.col("stays.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row_id") == F.col("stays.row_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
