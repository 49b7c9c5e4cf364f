"""Admission of uploaded files, and the request table for external inference."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from variorum.functions import text as T
from variorum.operators import catalog as C
from variorum.session import ship_package, stage

MAX_FILE = 1 << 30
MAX_IMAGE = 32 << 20
#: Leading bytes that are read of a file.
HEAD = 16
#: Entries of a folder that go on at a time, and files whose leading bytes one task reads.
LISTED = 10_000
FILES_A_TASK = 500

# Leading bytes of the accepted formats.
SIGNATURES = (
    ("255044462D", 1, "application/pdf"),
    ("89504E470D0A1A0A", 1, "image/png"),
    ("FFD8FF", 1, "image/jpeg"),
    ("474946383761", 1, "image/gif"),
    ("474946383961", 1, "image/gif"),
    ("424D", 1, "image/bmp"),
    ("00000100", 1, "image/x-icon"),
    ("00000200", 1, "image/x-icon"),
)


def media_type(content: str | Column) -> Column:
    """Media type from the leading bytes; null when the format is not accepted."""
    head = F.hex(F.substring(T.col(content), 1, 16))
    kind = F.when(
        head.startswith("52494646") & (F.substring(head, 17, 12) == "574542505650"), "image/webp"
    )
    for signature, _, name in SIGNATURES:
        kind = kind.when(head.startswith(signature), name)
    return kind


def admit(files: DataFrame, max_file: int = MAX_FILE, max_image: int = MAX_IMAGE) -> tuple[DataFrame, DataFrame]:
    """(accepted with ``mime_type, source_type``, rejected with ``reason``) of ``path, length, content``.

    ``content`` may be the first bytes of a file only.

    The two size rules are decided on the length alone, so an oversized file is never opened by the
    first branch and its content is not read by the second.
    """
    too_large, empty = F.col("length") > max_file, F.col("length") == 0
    sized = files.filter(~too_large & ~empty).withColumn("mime_type", media_type("content"))
    kind = F.when(F.col("mime_type") == "application/pdf", "pdf").when(F.col("mime_type").isNotNull(), "image")
    typed = sized.withColumn("source_type", kind)
    heavy = (F.col("source_type") == "image") & (F.col("length") > max_image)
    reason = F.when(F.col("source_type").isNull(), "unsupported format").when(heavy, "image too large")
    judged = typed.withColumn("reason", reason)
    accepted = judged.filter("reason IS NULL").drop("reason")
    rejected = (
        files.filter(too_large | empty)
        .select("path", "length", F.when(too_large, "file too large").otherwise("empty file").alias("reason"))
        .unionByName(judged.filter("reason IS NOT NULL").select("path", "length", "reason"))
    )
    return accepted, rejected


def _visible(name: str) -> bool:
    return not name.startswith((".", "_"))


def _prefix(root: str, base: str) -> str:
    """What stands before a place of the file system to make it a path that Spark reads."""
    return root[: len(root) - len(base)] if root.endswith(base) else ""


def _entries(root: str):
    """Batches of folders (column place) to batches of what stands in them: place, length; null for a folder."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                seen = [
                    (e.path, e.size if e.type == fs.FileType.File else None)
                    for e in system.get_file_info(fs.FileSelector(folder))
                    if _visible(e.base_name) and e.type in (fs.FileType.File, fs.FileType.Directory)
                ]
                for at in range(0, len(seen), LISTED):
                    places, lengths = zip(*seen[at : at + LISTED])
                    yield pa.record_batch([pa.array(places, pa.string()), pa.array(lengths, pa.int64())], ["place", "length"])

    return work


def _heads(root: str, max_file: int):
    """Batches of (place, length) to batches of (place, length, content): the first bytes of files in the limits."""

    def head(system, place: str, length: int) -> bytes | None:
        if not 0 < length <= max_file:
            return None
        with system.open_input_file(place) as file:
            return file.read(HEAD)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(root)
        for batch in batches:
            places, lengths = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            heads = [head(system, place, length) for place, length in zip(places, lengths)]
            yield pa.record_batch([*batch.columns[:2], pa.array(heads, pa.binary())], ["place", "length", "content"])

    return work


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """``place, length`` of the files under ``path``, however deep, those without a byte among them.

    Folders are rows: a job a level lists the folders of that level in its tasks, so the driver holds
    no listing. One folder is one unit of work. Names that begin with "." or "_" are left out, files
    and folders alike, as Spark's readers leave them out; an empty folder gives no row, a missing one is
    an error. Arrow's file systems do the listing: a local path, HDFS, S3 or GCS.
    """
    ship_package(spark)
    root = path.rstrip("/")
    _, base = fs.FileSystem.from_uri(root)
    level = spark.createDataFrame([(base,)], "place string")
    levels = []
    while True:
        seen = stage(level.mapInArrow(_entries(root), "place string, length long"), "listing")
        levels.append(seen.filter("length IS NOT NULL"))
        folders = seen.filter("length IS NULL").select("place")
        if folders.isEmpty():
            return reduce(DataFrame.unionByName, levels)
        # By number, because the rows are few and small but the work behind each is not.
        level = folders.repartition(spark.sparkContext.defaultParallelism, "place")


def admit_files(
    spark: SparkSession, path: str, max_file: int = MAX_FILE, max_image: int = MAX_IMAGE
) -> tuple[DataFrame, DataFrame]:
    """Admission of the files under ``path``: (``path, length, mime_type, source_type``, ``path, length, reason``).

    Of a file only its first bytes are read, and none where its length decides; files are dealt out for
    that by number, so a folder with a third of all files is read by many tasks. A file that is gone when
    it is opened is an error.
    """
    listed = list_files(spark, path)
    root = path.rstrip("/")
    _, base = fs.FileSystem.from_uri(root)
    tasks = -(-listed.count() // FILES_A_TASK) or 1
    heads = listed.repartition(tasks).mapInArrow(_heads(root, max_file), "place string, length long, content binary")
    named = F.concat(F.lit(_prefix(root, base)), F.col("place")).alias("path")
    accepted, rejected = admit(stage(heads.select(named, "length", "content"), "uploads"), max_file, max_image)
    return accepted.drop("content"), rejected


def build_requests(pages: DataFrame, catalog: DataFrame) -> DataFrame:
    """Request bodies, one per page and model: ``..., ref, api, body``.

    ``pages``: ``page_id, ref, system, prompt`` and ``image`` (bytes, may be null for a text-only
    call). Sending is left to whoever owns the connection.
    """
    models = C.with_budget(C.with_names(catalog)).select("ref", "model_id", "api", "max_tokens")
    media = F.coalesce(media_type("image"), F.lit("application/octet-stream"))
    data = F.base64("image")
    # base64() wraps lines; a data URL must not.
    packed = F.regexp_replace(data, r"\s", "")
    url = F.concat(F.lit("data:"), media, F.lit(";base64,"), packed)
    q = T.quote_json
    has_image = F.coalesce(F.octet_length("image"), F.lit(0)) > 0
    tail = F.concat(F.col("max_tokens").cast("string"), F.lit(',"stream":true}'))
    model, system, prompt = q("model_id"), q("system"), q("prompt")
    chat_user = F.when(
        has_image,
        F.concat(
            F.lit('[{"type":"image_url","image_url":{"url":'), q(url), F.lit('}},{"type":"text","text":'), prompt, F.lit("}]")
        ),
    ).otherwise(prompt)
    chat = F.concat(
        F.lit('{"model":'), model, F.lit(',"messages":[{"role":"system","content":'), system,
        F.lit('},{"role":"user","content":'), chat_user, F.lit('}],"max_tokens":'), tail,
    )
    responses_input = F.when(
        has_image,
        F.concat(
            F.lit('[{"role":"user","content":[{"type":"input_image","image_url":'), q(url),
            F.lit('},{"type":"input_text","text":'), prompt, F.lit("}]}]"),
        ),
    ).otherwise(prompt)
    responses = F.concat(
        F.lit('{"model":'), model, F.lit(',"instructions":'), system, F.lit(',"input":'), responses_input,
        F.lit(',"max_output_tokens":'), tail,
    )
    block = F.when(
        has_image,
        F.concat(
            F.lit('{"type":"image","source":{"type":"base64","media_type":'), q(media), F.lit(',"data":'), q(packed), F.lit("}},"),
        ),
    ).otherwise("")
    messages = F.concat(
        F.lit('{"model":'), model, F.lit(',"system":'), system, F.lit(',"messages":[{"role":"user","content":['), block,
        F.lit('{"type":"text","text":'), prompt, F.lit('}]}],"max_tokens":'), tail,
    )
    body = F.when(F.col("api") == C.CHAT, chat).when(F.col("api") == C.RESPONSES, responses).when(F.col("api") == C.MESSAGES, messages)
    return pages.join(models, "ref").select(*[c for c in pages.columns if c != "image"], "api", body.alias("body"))
