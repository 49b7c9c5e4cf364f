"""Stored page results and the JSON store."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from variorum import schemas
from variorum.operators.ordered import last_per_key


def read_results(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """``doc_id, page_id, result``: one JSON file per page at ``<doc>/results/<page>.json``, or,
    without ``multi_line``, JSON lines that carry the two ids and split over tasks."""
    ids = [S.StructField("doc_id", S.StringType()), S.StructField("page_id", S.StringType())]
    with_ids = S.StructType([*ids, *schemas.RESULT.fields])
    raw = (
        spark.read.schema(with_ids)
        .option("multiLine", multi_line)
        .option("recursiveFileLookup", True)
        .json(path)
        .withColumn("_file", F.input_file_name())
    )
    place = r"([^/]+)/results/([^/]+)\.json$"
    return raw.select(
        F.coalesce("doc_id", F.url_decode(F.regexp_extract("_file", place, 1))).alias("doc_id"),
        F.coalesce("page_id", F.url_decode(F.regexp_extract("_file", place, 2))).alias("page_id"),
        F.struct("text", "confidence", "segments", "stats", "candidates").alias("result"),
    )


def flatten_results(results: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(segments, candidates, stats) of nested results; zero values that JSON left out come back."""
    segment = F.posexplode("result.segments").alias("idx", "s")
    segments = results.select("doc_id", "page_id", segment).select(
        "doc_id",
        "page_id",
        F.col("idx").cast("long").alias("idx"),
        F.coalesce("s.text", F.lit("")).alias("text"),
        F.coalesce("s.confidence", F.lit(0.0)).alias("confidence"),
        F.col("s.source").alias("source"),
        F.col("s.from").alias("from"),
        F.coalesce("s.disputed", F.lit(False)).alias("disputed"),
        F.coalesce("s.candidates", F.array().cast("array<struct<agent:string,text:string>>")).alias("candidates"),
    )
    candidates = results.select("doc_id", "page_id", F.inline("result.candidates")).na.fill(
        {"text": "", "latency_ms": 0, "err": ""}
    )
    stats = results.select(
        "doc_id",
        "page_id",
        F.coalesce("result.text", F.lit("")).alias("text"),
        F.coalesce("result.confidence", F.lit(0.0)).alias("confidence"),
        "result.stats.*",
    ).na.fill(0).na.fill("")
    return segments, candidates, stats


def load_results(
    spark: SparkSession, path: str, multi_line: bool = True
) -> tuple[DataFrame, DataFrame, DataFrame]:
    return flatten_results(read_results(spark, path, multi_line))


def check_edited_results(edited: DataFrame, body: str) -> DataFrame:
    """Edited results with a key no result has: (rows, ``unknown`` keys). Top level and segments."""
    top = [f.name for f in schemas.RESULT.fields]
    inner = [f.name for f in schemas.SEGMENT.fields]
    v = F.try_parse_json(body)
    keys = F.coalesce(F.json_object_keys(body), F.array().cast("array<string>"))
    segments = F.coalesce(
        F.from_json(F.to_json(F.try_variant_get(v, "$.segments", "variant")), "array<map<string,variant>>"),
        F.array().cast("array<map<string,variant>>"),
    )
    inner_keys = F.array_distinct(F.flatten(F.transform(segments, lambda m: F.map_keys(m))))
    unknown = F.concat(
        F.array_except(keys, F.array(*[F.lit(t) for t in top])),
        F.array_except(inner_keys, F.array(*[F.lit(t) for t in inner])),
    )
    return edited.withColumn("unknown", unknown).filter((F.size("unknown") > 0) | v.isNull())


def load_store(spark: SparkSession, path: str, multi_line: bool = True) -> dict[str, DataFrame]:
    """Tables of stored JSON databases: users, tasks, documents, pages. A path may hold many stores."""
    store = spark.read.schema(schemas.STORE).option("multiLine", multi_line).json(path)
    documents = store.select("version", F.inline("documents")).withColumnRenamed("id", "doc_id")
    pages = documents.select("doc_id", F.posexplode("pages").alias("pos", "p")).select(
        "doc_id", F.col("p.id").alias("page_id"), F.col("pos").cast("long").alias("pos"), "p.*"
    )
    return {
        "users": store.select(F.inline("users")).withColumnRenamed("id", "user_id").na.fill({"disabled": False}),
        "tasks": store.select(F.inline("tasks"))
        .withColumnRenamed("id", "task_id")
        .na.fill({"arbiter": "", "duplicate_checker": "", "duration_ms": 0, "error": ""}),
        "documents": documents.drop("pages").na.fill(
            {"arbiter": "", "duplicate_checker": "", "auto_arbitrate": False, "error": ""}
        ),
        "pages": pages.drop("id").na.fill(
            {"confidence": 0.0, "segments": 0, "pending_disputes": 0, "duration_ms": 0, "error": ""}
        ),
    }


def nest_results(pages: DataFrame, segments: DataFrame, readings: DataFrame) -> DataFrame:
    """Flat page results back to the nested form, segments and readings in order."""
    keys = ["doc_id", "page_id"]
    s = segments.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("idx", "text", "confidence", "source", "from", "disputed", "candidates"))).alias("s")
    )
    c = readings.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("agent", "text", "latency_ms", "err"))).alias("candidates")
    )
    counters = [f.name for f in schemas.STATS.fields if f.name in pages.columns]
    return (
        pages.join(s, keys, "left")
        .join(c, keys, "left")
        .select(
            *keys,
            "text",
            "confidence",
            F.transform(
                F.coalesce("s", F.array().cast(s.schema["s"].dataType)),
                lambda x: F.struct(*[x[f.name].alias(f.name) for f in schemas.SEGMENT.fields]),
            ).alias("segments"),
            F.struct(*counters).alias("stats"),
            "candidates",
        )
    )


KEYS = ["doc_id", "page_id"]


def write_results(results: DataFrame, path: str, order: str = "seq") -> None:
    """Add a run of results to the store at ``path``; ``read_stored`` gives the newest of each page.

    A run is a folder of its own, so its cost follows the pages it brings and not the store. It keeps one
    row per (document, page): of several the last by ``order``, if there is such a column. Rows are spread
    over tasks by page, whatever document they belong to.
    """
    run = time.time_ns() // 1000
    rows = last_per_key(results, KEYS, order)
    rows.write.parquet(f"{path.rstrip('/')}/run={run}")


def read_stored(spark: SparkSession, path: str) -> DataFrame:
    """The newest result of each page of a store. Runs may differ in columns."""
    return read_runs(spark, path, [path])


def read_runs(spark: SparkSession, path: str, runs: list[str]) -> DataFrame:
    """The newest result of each page in some runs of a store."""
    found = spark.read.option("mergeSchema", True).option("basePath", path).parquet(*runs)
    rows = found.withColumn("run", F.col("run").cast("long"))
    rest = [c for c in rows.columns if c not in (*KEYS, "run")]
    newest = rows.groupBy(*KEYS).agg(F.max_by(F.struct(*rest), "run").alias("_newest"))
    return newest.select(*KEYS, "_newest.*")


def compact_results(spark: SparkSession, path: str) -> None:
    """Write the newest results of the finished runs as one run and remove these.

    The new run stands right behind the newest of them, so that a run which is written meanwhile stays newer.
    Runs from the first unfinished one on are left as they are. If it breaks off in between, both are there
    and reading gives the same rows.
    """
    root = path.rstrip("/")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(root).getFileSystem(spark._jsc.hadoopConfiguration())
    finished: dict[int, str] = {}
    for run in sorted(
        int(s.getPath().getName()[4:]) for s in fs.listStatus(hadoop(root)) if s.getPath().getName().startswith("run=")
    ):
        if not fs.exists(hadoop(f"{root}/run={run}/_SUCCESS")):
            break
        finished[run] = f"{root}/run={run}"
    if len(finished) < 2:
        return
    read_runs(spark, path, list(finished.values())).write.parquet(f"{root}/run={max(finished) + 1}")
    for folder in finished.values():
        fs.delete(hadoop(folder), True)
