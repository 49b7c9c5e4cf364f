"""Text and audit exports of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variorum.functions import text as T
from variorum.operators.documents import page_results

PAGE_BREAK = "\n\n\f\n\n"  # fixed value
PAGE_HEADING = "第 %d 页\n"  # fixed value
AUDIT_SCHEMA = "document-audit.v1"
AUDIT_END = "]}"


def export_text(documents: DataFrame, pages: DataFrame, results: DataFrame) -> DataFrame:
    """``doc_id, file_name, body``: the pages with a result, in order. One document is one value."""
    shown = page_results(pages.select("doc_id", "page_id", "pos", "page_number", "result_ready"), results, keep_all=False)
    part = F.concat(F.format_string(PAGE_HEADING, F.col("page_number")), T.trim_space("text"))
    bodies = (
        shown.select("doc_id", "pos", part.alias("part"))
        .groupBy("doc_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "part"))).alias("parts"))
        .select("doc_id", F.array_join(F.transform("parts", lambda p: p["part"]), PAGE_BREAK).alias("body"))
    )
    return documents.join(bodies, "doc_id", "left").select(
        "doc_id",
        F.concat(T.document_stem("name"), F.lit(".txt")).alias("file_name"),
        F.coalesce("body", F.lit("")).alias("body"),
    )


def text_pieces(documents: DataFrame, pages: DataFrame, results: DataFrame) -> DataFrame:
    """``doc_id, file_name, pos, piece``: the text export page by page, for documents of any size.

    Pieces of a document, joined in the order of ``pos``, are its body; a document without a page that has
    a result is one empty piece. No row is larger than a page and no document meets in one task.
    """
    shown = page_results(pages.select("doc_id", "page_id", "pos", "page_number", "result_ready"), results, keep_all=False)
    part = F.concat(F.format_string(PAGE_HEADING, F.col("page_number")), T.trim_space("text"))
    parts = shown.select("doc_id", "pos", part.alias("part"))
    first = parts.groupBy("doc_id").agg(F.min("pos").alias("_first"))
    named = documents.select("doc_id", F.concat(T.document_stem("name"), F.lit(".txt")).alias("file_name"))
    breaks = F.when(F.col("pos") == F.col("_first"), "").otherwise(PAGE_BREAK)
    return (
        named.join(first, "doc_id", "left")
        .join(parts, "doc_id", "left")
        .select(
            "doc_id",
            "file_name",
            F.coalesce("pos", F.lit(0)).cast("long").alias("pos"),
            F.coalesce(F.concat(breaks, "part"), F.lit("")).alias("piece"),
        )
    )


def write_pieces(pieces: DataFrame, path: str) -> None:
    """Pieces as JSON lines in order of document and position, file after file; a document may span files."""
    pieces.repartitionByRange("doc_id", "pos").sortWithinPartitions("doc_id", "pos").write.mode("overwrite").option(
        "compression", "gzip"
    ).json(path)


def _audit_entries(pages: DataFrame, results: DataFrame) -> DataFrame:
    """``doc_id, pos, entry``: each page as JSON, without a result where there is none."""
    every = page_results(pages, results, keep_all=True)

    def kept(name: str, empty):
        value = F.col(name)
        return F.when(value != empty, value).alias(name)

    entry = F.to_json(
        F.struct(
            "page_number", "source_page", "status", kept("duration_ms", 0), kept("error", ""), F.col("result").alias("result")
        )
    )
    return every.select("doc_id", "pos", entry.alias("entry"))


def _audit_head(exported_at) -> Column:
    """What stands before the pages of a document."""
    head = F.to_json(
        F.struct(
            F.col("doc_id").alias("id"), "name", "source_type", "size_bytes",
            F.col("created_at").cast("timestamp").alias("created_at"), exported_at.alias("exported_at"),
        ),
        {"timeZone": "UTC"},
    )
    return F.concat(F.lit('{"schema":"' + AUDIT_SCHEMA + '","document":'), head, F.lit(',"pages":['))


def _audit_name() -> Column:
    return F.concat(T.document_stem("name"), F.lit("-audit.json")).alias("file_name")


def export_audit(documents: DataFrame, pages: DataFrame, results: DataFrame, exported_at) -> DataFrame:
    """``doc_id, file_name, body``: metadata and every page in order as JSON, without a result where there is none.

    ``results``: ``doc_id, page_id, result`` (a struct). One document is one value; ``audit_pieces`` has
    no such limit.
    """
    listed = (
        _audit_entries(pages, results)
        .groupBy("doc_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "entry"))).alias("entries"))
        .select("doc_id", F.array_join(F.transform("entries", lambda e: e["entry"]), ",").alias("entries"))
    )
    body = F.concat(_audit_head(exported_at), F.coalesce("entries", F.lit("")), F.lit(AUDIT_END))
    return documents.join(listed, "doc_id", "left").select("doc_id", _audit_name(), body.alias("body"))


def audit_pieces(documents: DataFrame, pages: DataFrame, results: DataFrame, exported_at) -> DataFrame:
    """``doc_id, file_name, pos, piece``: the audit export page by page, for documents of any size.

    Pieces of a document, joined in the order of ``pos``, are the body that ``export_audit`` gives: one before
    its first page, one for each page, one after its last. A document without pages has the outer two.
    No row is larger than a page and no document meets in one task.
    """
    entries = _audit_entries(pages, results)
    ends = entries.groupBy("doc_id").agg(F.min("pos").alias("_first"), F.max("pos").alias("_last"))
    outer = F.array(
        F.struct((F.coalesce("_first", F.lit(0)) - 1).cast("long").alias("pos"), _audit_head(exported_at).alias("piece")),
        F.struct((F.coalesce("_last", F.lit(-1)) + 1).cast("long").alias("pos"), F.lit(AUDIT_END).alias("piece")),
    )
    around = documents.join(ends, "doc_id", "left").select("doc_id", _audit_name(), F.explode(outer).alias("p"))
    comma = F.when(F.col("pos") == F.col("_first"), "").otherwise(",")
    inner = (
        documents.select("doc_id", _audit_name())
        .join(ends, "doc_id")
        .join(entries, "doc_id")
        .select("doc_id", "file_name", F.col("pos").cast("long").alias("pos"), F.concat(comma, "entry").alias("piece"))
    )
    return around.select("doc_id", "file_name", "p.pos", "p.piece").unionByName(inner)


def write_exports(exports: DataFrame, path: str) -> None:
    """One row per document as JSON lines; the row order and file count are Spark's."""
    exports.write.mode("overwrite").option("compression", "gzip").json(path)
