"""Status changes of documents, pages and tasks as table updates.

An update that is checked first stages the short list of rejected documents, and one that feeds the
new pages back into document counters stages the pages: each is read by several later steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variorum.functions import text as T
from variorum.operators import documents as D, ordered
from variorum.session import by_shuffle, stage

KEYS = ["doc_id", "page_id"]
SETTINGS = ("engines", "arbiter", "duplicate_checker", "auto_arbitrate")

# Messages stored in the tables.
ALL_ENGINES_FAILED = "所有引擎均失败,请检查 Provider 连接与模型配置"
INTERRUPTED = "服务重启中断了这次识别"
PAGES_FAILED = "有 %d 页未能处理,可逐页或整批重试"
UNNAMED_IMAGE = "未命名图片"


def _flag(df: DataFrame, rows: DataFrame, on: list[str], name: str) -> DataFrame:
    marked = rows.select(*on).distinct().withColumn(name, F.lit(True))
    return df.join(by_shuffle(marked), on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def _set(df: DataFrame, when: Column, **values) -> DataFrame:
    """Replace columns where the condition holds, keeping each column's type."""
    types = dict(df.dtypes)
    changed = {}
    for name, value in values.items():
        value = value if isinstance(value, Column) else F.lit(value)
        changed[name] = F.when(when, value.cast(types[name])).otherwise(F.col(name))
    return df.withColumns(changed)


def _touch(documents: DataFrame, pages: DataFrame, when: Column, now: Column) -> DataFrame:
    return D.recount_documents(_set(documents, when, updated_at=now), pages)


def queue_pages(
    documents: DataFrame, pages: DataFrame, requests: DataFrame, selection: DataFrame, now: Column
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, pages, rejected). ``requests``: ``doc_id`` and the four settings."""
    rejected = stage(D.check_selection(requests, selection, documents, pages), "rejected")
    taken = requests.join(by_shuffle(rejected), "doc_id", "left_anti")
    picked = selection.join(by_shuffle(taken.select("doc_id")), "doc_id", "left_semi")
    flagged = _flag(pages, picked, KEYS, "_picked")
    reset = F.col("_picked") & (F.col("status") != "queued")
    new_pages = _set(
        flagged,
        reset,
        result_ready=False,
        confidence=0.0,
        segments=0,
        pending_disputes=0,
        duration_ms=0,
        error="",
        updated_at=now,
        status="queued",
    ).drop("_picked")
    new_pages = stage(new_pages, "pages")
    wanted = taken.select("doc_id", F.lit(True).alias("_asked"), *(F.col(c).alias(f"_{c}") for c in SETTINGS))
    joined = documents.join(by_shuffle(wanted), "doc_id", "left").withColumn("_asked", F.coalesce("_asked", F.lit(False)))
    idle = F.col("_asked") & (F.col("status") != "processing")
    settled = _set(joined, idle, **{c: F.col(f"_{c}") for c in SETTINGS})
    started = _set(settled, F.col("_asked"), status="processing", completed_at=F.lit(None), error="")
    new_documents = _touch(started, new_pages, F.col("_asked"), now)
    return new_documents.drop("_asked", *(f"_{c}" for c in SETTINGS)), new_pages, rejected


def page_flags(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(
        F.bool_or(F.col("status").isin(*D.ACTIVE)).alias("_active"),
        F.bool_or(F.col("status").isin(*D.WAITING)).alias("_waiting"),
        F.count_if(F.col("status") == "failed").alias("_failed"),
    )


def _rest(documents: DataFrame, when: Column, now: Column) -> DataFrame:
    """ready while pages wait, else completed."""
    waiting = F.coalesce("_waiting", F.lit(False))
    return _set(
        documents,
        when,
        status=F.when(waiting, "ready").otherwise("completed"),
        completed_at=F.when(~waiting, now),
    )


def dequeue_pages(
    documents: DataFrame, pages: DataFrame, selection: DataFrame, now: Column
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Queued pages back to ready; the document rests when nothing is active. A request with one
    page that is already being processed is rejected whole."""
    requests = selection.select("doc_id").distinct()
    rejected = stage(D.check_selection(requests, selection, documents, pages, queueing=False), "rejected")
    taken = requests.join(by_shuffle(rejected), "doc_id", "left_anti")
    picked = selection.join(by_shuffle(taken), "doc_id", "left_semi")
    flagged = _flag(pages, picked, KEYS, "_picked")
    new_pages = _set(
        flagged, F.col("_picked") & (F.col("status") == "queued"), updated_at=now, status="ready"
    ).drop("_picked")
    new_pages = stage(new_pages, "pages")
    joined = _flag(documents, taken, ["doc_id"], "_asked").join(by_shuffle(page_flags(new_pages)), "doc_id", "left")
    idle = F.col("_asked") & ~F.coalesce("_active", F.lit(False))
    new_documents = _touch(_rest(joined, idle, now), new_pages, F.col("_asked"), now)
    return new_documents.drop("_asked", "_active", "_waiting", "_failed"), new_pages, rejected


def cancel_documents(
    documents: DataFrame, pages: DataFrame, targets: DataFrame, now: Column
) -> tuple[DataFrame, DataFrame]:
    new_pages = _set(
        _flag(pages, targets, ["doc_id"], "_asked"),
        F.col("_asked") & F.col("status").isin(*D.ACTIVE),
        status="ready",
    ).drop("_asked")
    stopped = _set(
        _flag(documents, targets, ["doc_id"], "_asked"), F.col("_asked"), status="cancelled", error=""
    )
    return _touch(stopped, new_pages, F.col("_asked"), now).drop("_asked"), new_pages


def settle_documents(documents: DataFrame, pages: DataFrame, now: Column) -> DataFrame:
    """Status of every document after a batch; cancelled and failed documents keep theirs."""
    joined = documents.join(by_shuffle(page_flags(pages)), "doc_id", "left")
    open_ = ~F.col("status").isin("cancelled", "failed")
    active = F.coalesce("_active", F.lit(False))
    failed = F.coalesce("_failed", F.lit(0))
    still = _set(joined.withColumn("_open", open_), F.col("_open") & active, status="processing", completed_at=F.lit(None))
    rested = _rest(still, F.col("_open") & ~active, now)
    noted = _set(
        rested,
        F.col("_open") & ~active,
        error=F.when(failed > 0, F.format_string(PAGES_FAILED, failed)).otherwise(""),
    )
    return _touch(noted, pages, F.lit(True), now).drop("_open", "_active", "_waiting", "_failed")


def finish_pages(pages: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Fold run results into the pages.

    ``results``: ``doc_id, page_id, engines, failed_engines, confidence, segments,
    pending_disputes, duration_ms, error``. An error fails the page and keeps its old numbers; a
    result whose engines all failed is stored but the page is failed. The last of several results of a
    page counts, by ``seq`` if there is one.
    """
    results = ordered.last_per_key(results, KEYS)
    told = results.select(
        *KEYS,
        F.lit(True).alias("_told"),
        *(F.col(c).alias(f"_{c}") for c in results.columns if c not in KEYS),
    )
    joined = pages.join(told, KEYS, "left").withColumn("_told", F.coalesce("_told", F.lit(False)))
    broke = F.coalesce("_error", F.lit("")) != ""
    empty = (F.col("_engines") > 0) & (F.col("_failed_engines") == F.col("_engines"))
    # Conditions are fixed as columns first: the columns they read are replaced below.
    joined = joined.withColumn("_failed", F.col("_told") & broke).withColumn("_done", F.col("_told") & ~broke)
    failed = _set(
        joined, F.col("_failed"), status="failed", result_ready=False, duration_ms=F.col("_duration_ms"),
        error=F.col("_error"), updated_at=now,
    )
    done = _set(
        failed,
        F.col("_done"),
        result_ready=True,
        confidence=F.col("_confidence"),
        segments=F.col("_segments"),
        pending_disputes=F.col("_pending_disputes"),
        duration_ms=F.col("_duration_ms"),
        revision=F.col("revision") + 1,
        updated_at=now,
        status=F.when(empty, "failed").otherwise("completed"),
        error=F.when(empty, ALL_ENGINES_FAILED).otherwise(""),
    )
    return done.select(*pages.columns)


def save_review(pages: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Fold edited results (``confidence, segments, pending_disputes``) into the pages; a page's last one counts."""
    told = ordered.last_per_key(results, KEYS).select(
        *KEYS,
        F.lit(True).alias("_told"),
        *(F.col(c).alias(f"_{c}") for c in ("confidence", "segments", "pending_disputes")),
    )
    joined = pages.join(told, KEYS, "left").withColumn("_told", F.coalesce("_told", F.lit(False)))
    saved = _set(
        joined,
        F.col("_told"),
        result_ready=True,
        status="completed",
        confidence=F.col("_confidence"),
        segments=F.col("_segments"),
        pending_disputes=F.col("_pending_disputes"),
        revision=F.col("revision") + 1,
        error="",
        updated_at=now,
    )
    return saved.select(*pages.columns)


def recover(documents: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """After a stop: (documents, pages, work). ``work``: ``doc_id, job`` with prepare or process."""
    state = documents.select("doc_id", F.col("status").alias("_doc"))
    joined = pages.join(state, "doc_id", "left")
    prepared = _set(
        joined,
        F.col("_doc") == "preparing",
        status=F.when(F.col("image_ready"), "ready").otherwise("preparing"),
    )
    queued = _set(prepared, (F.col("_doc") == "processing") & (F.col("status") == "processing"), status="queued")
    new_pages = queued.select(*pages.columns)
    work = documents.filter("status IN ('preparing', 'processing')").select(
        "doc_id", F.when(F.col("status") == "preparing", "prepare").otherwise("process").alias("job")
    )
    return D.recount_documents(documents, new_pages), new_pages, work


def recover_tasks(tasks: DataFrame, now: Column) -> DataFrame:
    running = F.col("status") == "running"
    return _set(tasks.withColumn("_running", running), F.col("_running"), status="failed", completed_at=now, error=INTERRUPTED).drop(
        "_running"
    )


def migrate_v3(documents: DataFrame, pages: DataFrame, version: int) -> DataFrame:
    """Before version 3 an idle prepared page was called queued."""
    if version >= 3:
        return pages
    idle = documents.filter("status <> 'processing'")
    flagged = _flag(pages, idle, ["doc_id"], "_idle")
    return _set(flagged, F.col("_idle") & (F.col("status") == "queued"), status="ready").drop("_idle")


def rerun_set(pages: DataFrame) -> DataFrame:
    """Pages a rerun takes: those not finished, or all finished ones when none is left."""
    open_ = F.col("status").isin("ready", "failed", "queued")
    some_open = pages.groupBy("doc_id").agg(F.bool_or(open_).alias("_some_open"))
    finished = F.col("image_ready") & (F.col("status") == "completed")
    return (
        pages.filter(open_ | finished)
        .join(some_open, "doc_id")
        .filter(F.when(F.col("_some_open"), open_).otherwise(finished))
        .drop("_some_open")
    )


def delete_pages(
    documents: DataFrame, pages: DataFrame, targets: DataFrame, now: Column
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, pages renumbered, rejected). At least one page must stay."""
    asked = targets.select(*KEYS).distinct()
    known = asked.join(pages.select(*KEYS, F.lit(True).alias("_known")), KEYS, "left")
    wanted = known.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("_wanted"), F.bool_or(F.col("_known").isNull()).alias("_unknown")
    )
    state = wanted.join(documents.select("doc_id", "status"), "doc_id").join(
        D.count_pages(pages).select("doc_id", "page_count"), "doc_id", "left"
    )
    rejected = state.select(
        "doc_id",
        F.when(F.col("status").isin("preparing", "processing"), "document is busy")
        .when(F.coalesce("page_count", F.lit(0)) - F.col("_wanted") < 1, "one page must stay")
        .when(F.col("_unknown"), "unknown page id")
        .alias("violation"),
    ).filter("violation IS NOT NULL")
    rejected = stage(rejected, "rejected")
    gone = asked.join(by_shuffle(rejected), "doc_id", "left_anti")
    kept = stage(D.renumber(pages.drop("page_number").join(gone, KEYS, "left_anti")), "pages")
    touched = _flag(documents, gone, ["doc_id"], "_asked")
    return _touch(touched, kept, F.col("_asked"), now).drop("_asked"), kept, rejected


def start_tasks(tasks: DataFrame) -> DataFrame:
    name = T.trim_space("filename")
    return tasks.withColumn("filename", F.when(name == "", UNNAMED_IMAGE).otherwise(name)).withColumn(
        "status", F.lit("running")
    )


def finish_tasks(tasks: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """``outcomes``: ``task_id, result, duration_ms, error``; a task without a result has failed. The last one counts."""
    told = ordered.last_per_key(outcomes, ["task_id"]).select(
        "task_id",
        F.lit(True).alias("_told"),
        *(F.col(c).alias(f"_{c}") for c in ("result", "duration_ms", "error")),
    )
    joined = tasks.join(told, "task_id", "left").withColumn("_told", F.coalesce("_told", F.lit(False)))
    return _set(
        joined,
        F.col("_told"),
        completed_at=now,
        duration_ms=F.col("_duration_ms"),
        error=F.coalesce("_error", F.lit("")),
        result=F.col("_result"),
        status=F.when(F.col("_result").isNotNull(), "completed").otherwise("failed"),
    ).select(*tasks.columns)
