"""Document and page tables: counters, order, work lists and review indexes.

``documents``: ``doc_id, user_id, name, source_type, size_bytes, status, engines, arbiter,
duplicate_checker, auto_arbitrate, created_at, updated_at, completed_at, error`` and five counters.
``pages``: ``doc_id, page_id, pos, source_page, status, image_ready, result_ready, confidence,
segments, pending_disputes, duration_ms, revision, error, updated_at``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variorum.operators import ordered
from variorum.session import by_shuffle

COUNTERS = ("page_count", "prepared_pages", "processed_pages", "failed_pages", "pending_disputes")
ACTIVE = ("queued", "processing")
WAITING = ("ready", "preparing")


def count_pages(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("page_count"),
        F.count_if(F.col("image_ready")).alias("prepared_pages"),
        F.count_if(F.col("status") == "completed").alias("processed_pages"),
        F.count_if(F.col("status") == "failed").alias("failed_pages"),
        F.sum(F.col("pending_disputes").cast("long")).alias("pending_disputes"),
    )


def recount_documents(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Documents with their five derived counters; zero for a document without pages."""
    counted = documents.drop(*COUNTERS).join(by_shuffle(count_pages(pages)), "doc_id", "left")
    return counted.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in COUNTERS})


def project_confidence(pages: DataFrame) -> DataFrame:
    """Mean confidence of pages with a result (0 if none) and completed pages, per document."""
    return pages.groupBy("doc_id").agg(
        F.coalesce(F.avg(F.when(F.col("result_ready"), F.coalesce("confidence", F.lit(0.0)))), F.lit(0.0)).alias(
            "confidence"
        ),
        F.count_if(F.col("status") == "completed").alias("completed"),
    )


def page_status_counts(pages: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    def of(*statuses: str) -> Column:
        return F.count_if(F.col("status").isin(*statuses))

    return pages.groupBy(*keys).agg(
        *[of(s).alias(s) for s in ("ready", "queued", "processing", "failed")],
        of("completed", "failed").alias("terminal"),
    )


def renumber(pages: DataFrame) -> DataFrame:
    """``page_number``: position in the document from 1, whatever gaps ``pos`` has."""
    return ordered.number_rows(
        pages, ["doc_id"], ["pos"], ordered.bucket_of("pos"), "page_number", start=1
    )


def latest_state(changes: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """The last write per key. An aggregate, so all but one write per key and task stay off the shuffle."""
    rest = [c for c in changes.columns if c not in keys]
    newest = changes.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*version)).alias("_row")
    )
    return newest.select(*keys, "_row.*").select(*changes.columns)


def history(df: DataFrame, kind: str) -> DataFrame:
    """Listing order: tasks newest first, documents by last change, users by name."""
    order = {
        "tasks": [F.col("created_at").desc(), "task_id"],
        "documents": [F.col("updated_at").desc(), "doc_id"],
        "users": ["username"],
    }[kind]
    return df.orderBy(*order)


def visible_to(df: DataFrame, user_id, role: str) -> DataFrame:
    """An admin sees every row, a user the own ones."""
    return df if role == "admin" else df.filter(F.col("user_id") == F.lit(user_id))


def queued_pages(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Queued pages with an image, in documents that are processing."""
    running = documents.filter("status = 'processing'").select("doc_id")
    return pages.filter("status = 'queued' AND image_ready").join(running, "doc_id", "left_semi")


def next_pages(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """First queued page per processing document."""
    return (
        queued_pages(documents, pages)
        .groupBy("doc_id")
        .agg(F.min_by("page_id", "pos").alias("page_id"), F.min("pos").alias("pos"))
    )


def fair_plan(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """One page per document per turn, documents in order of arrival: ``turn`` then ``created_at``."""
    ranked = ordered.number_rows(
        queued_pages(documents, pages).select("doc_id", "page_id", "pos"),
        ["doc_id"],
        ["pos"],
        ordered.bucket_of("pos"),
        "turn",
    )
    arrivals = documents.select("doc_id", "created_at")
    return ranked.join(arrivals, "doc_id").orderBy("turn", "created_at", "doc_id")


def page_worksets(pages: DataFrame, selected: DataFrame) -> DataFrame:
    """Flags per page: manageable, managed (selected too), runnable, queued, failed."""
    picked = selected.select("doc_id", "page_id", F.lit(True).alias("_picked")).distinct()
    manageable = F.col("image_ready") & ~F.col("status").isin("preparing", "processing")
    return (
        pages.select("doc_id", "page_id", "status", manageable.alias("manageable"))
        .join(picked, ["doc_id", "page_id"], "left")
        .withColumn("managed", F.col("manageable") & F.coalesce("_picked", F.lit(False)))
        .withColumn("runnable", F.col("managed") & (F.col("status") != "queued"))
        .withColumn("queued", F.col("managed") & (F.col("status") == "queued"))
        .withColumn("failed", F.col("status") == "failed")
        .drop("_picked", "status")
    )


def dispute_index(pages: DataFrame, segments: DataFrame) -> DataFrame:
    """Open regions across pages, in page then segment order.

    Pages without a result or without pending regions are dropped before the join.
    """
    open_pages = pages.filter("result_ready AND pending_disputes > 0").select(
        "doc_id", "page_id", "pos", "page_number", "source_page"
    )
    open_segments = segments.filter("disputed AND source = 'fallback'")
    return open_pages.join(open_segments, ["doc_id", "page_id"]).orderBy("doc_id", "pos", "idx")


def page_results(pages: DataFrame, results: DataFrame, keep_all: bool = True) -> DataFrame:
    """Pages with their result. ``keep_all`` keeps pages without one; else only ready pages with one."""
    keys = ["doc_id", "page_id"]
    if keep_all:
        ready = pages.filter("result_ready").select(*keys)
        return pages.join(results.join(ready, keys, "left_semi"), keys, "left")
    return pages.filter("result_ready").join(results, keys)


def _first(*reasons: tuple[Column, str]) -> Column:
    """The first reason whose condition holds; null when none does."""
    return F.coalesce(*[F.when(condition, F.lit(reason)) for condition, reason in reasons])


def check_selection(
    requests: DataFrame, selection: DataFrame, documents: DataFrame, pages: DataFrame, queueing: bool = True
) -> DataFrame:
    """First violation per requested document: ``doc_id, violation``.

    ``requests``: ``doc_id`` (and settings, when ``queueing``); ``selection``: ``doc_id, page_id``.
    Counting per document is done on per-page rows that are already unique, so one large request
    is spread over its pages.
    """
    keys = ["doc_id", "page_id"]
    asked = selection.join(by_shuffle(requests.select("doc_id")), "doc_id", "left_semi")
    per_page = asked.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
    known = per_page.join(
        by_shuffle(pages.select(*keys, "status", "image_ready")), keys, "left"
    )
    flags = known.groupBy("doc_id").agg(
        F.bool_or(F.col("page_id") == "").alias("blank"),
        F.bool_or(F.col("copies") > 1).alias("repeated"),
        F.bool_or(F.col("status").isNull()).alias("unknown"),
        F.bool_or(~F.col("image_ready") | (F.col("status") == "preparing")).alias("unprepared"),
        F.bool_or(F.col("status") == "processing").alias("busy"),
    )
    joined = requests.join(by_shuffle(flags), "doc_id", "left")
    empty = (F.col("blank").isNull(), "no page selected")
    blank = (F.col("blank"), "blank page id")
    repeated = (F.col("repeated"), "repeated page id")
    busy = (F.col("busy"), "page is being processed")
    unknown = (F.col("unknown"), "unknown page id")
    if not queueing:
        reasons = [empty, blank, repeated, busy, unknown]
    else:
        settings = ("engines", "arbiter", "duplicate_checker", "auto_arbitrate")
        current = documents.select(
            "doc_id", F.col("status").alias("_status"), *(F.col(c).alias(f"_{c}") for c in settings)
        )
        joined = joined.join(by_shuffle(current), "doc_id", "left")
        same = F.lit(True)
        for c in settings:
            same = same & (F.col(c) == F.col(f"_{c}"))
        reasons = [
            empty,
            ((F.col("_status") == "processing") & ~same, "settings differ from the running job"),
            blank,
            repeated,
            (F.col("_status") == "preparing", "document is being prepared"),
            (F.col("unprepared"), "page is not prepared"),
            busy,
            unknown,
        ]
    return joined.select("doc_id", _first(*reasons).alias("violation")).filter("violation IS NOT NULL")


def reorder_pages(
    documents: DataFrame, pages: DataFrame, order: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Pages with new positions, and rejected documents.

    ``order``: ``doc_id, page_id, place``. It must name every page of the document exactly once.
    """
    keys = ["doc_id", "page_id"]
    # Pages and order meet in one grouping, where joins of the two would sort each of them in the same task.
    named = order.select(*keys, "place", F.lit(1).alias("copy"), F.lit(0).alias("page")).unionByName(
        pages.filter("doc_id IS NOT NULL").select(*keys, F.lit(1).alias("page")), allowMissingColumns=True
    )
    both = named.groupBy(*keys).agg(
        F.count("copy").alias("copies"), F.min("place").alias("place"), F.sum("page").alias("pages")
    )
    rows = F.greatest("pages", F.lit(1))
    bad = F.col("page_id").isNull() | (F.col("pages") == 0) | (F.col("copies") != 1)
    counted = (
        both.groupBy("doc_id")
        .agg(
            F.sum(F.col("copies") * rows).alias("given"),
            F.sum("pages").alias("present"),
            F.count_if(bad).alias("bad"),
        )
        .filter("given > 0")
    )
    placed = both.filter("copies > 0")
    rejected = (
        counted.join(documents.select("doc_id", "status"), "doc_id", "left")
        .select(
            "doc_id",
            _first(
                (F.col("status") == "processing", "order is fixed while processing"),
                ((F.col("bad") > 0) & (F.col("given") != F.col("present")), "order must hold every page"),
                (F.col("bad") > 0, "unknown or repeated page"),
            ).alias("violation"),
        )
        .filter("violation IS NOT NULL")
    )
    accepted = placed.join(rejected, "doc_id", "left_anti").select(*keys, F.col("place").alias("_place"))
    moved = pages.join(accepted, keys, "left").withColumn("pos", F.coalesce("_place", "pos")).drop("_place")
    return moved, rejected
