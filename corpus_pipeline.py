"""From raw documents to packed sequences, in five stages.

Each stage takes what the one before kept, and all but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from variorum.llm import exact, near, packing, substrings, toxicity
from variorum.llm.queries import tokenizer
from variorum.session import stage


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not taken for toxic; learnt from the labels of those that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return toxicity.acceptable(docs, toxicity.fit(rows, labels))


def row_key(doc_id: Column, text_hash: Column) -> Column:
    """Tells rows apart by id and text; never null, so that rows without an id can be joined too."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("-")), text_hash.cast("string"))


def rows_with(docs: DataFrame, kept: DataFrame, text_hash: Column) -> DataFrame:
    """Rows of `docs` whose key is in `kept` (column key); of repeated rows one."""
    given = docs.select(
        F.struct(*map(F.col, docs.columns)).alias("given"), row_key(F.col("doc_id"), text_hash).alias("key")
    )
    # The join has dealt and sorted by key already, so that telling repeated rows apart costs no shuffle.
    number = F.row_number().over(Window.partitionBy("key").orderBy("key"))
    return given.join(kept, "key", "left_semi").withColumn("number", number).filter("number = 1").select("given.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id; of repeated rows one."""
    kept = exact.exact_duplicates(docs).filter("kept")
    keys = kept.select(row_key(F.col("doc_id"), F.col("text_sha256")).alias("key"))
    return rows_with(docs, keys, F.sha2(F.coalesce("text", F.lit("")), 256))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id. Five words, 0.8 or more."""
    kept = near.near_duplicates(docs).filter("kept")
    keys = kept.select(row_key(F.col("doc_id"), F.col("text_hash")).alias("key"))
    return rows_with(docs, keys, F.xxhash64(F.coalesce("text", F.lit(""))))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words or more stay in the document with the smallest doc_id that has them."""
    return substrings.cut_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens: the pieces of documents in them, with their ids."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", clean),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", pack),
]

#: Most stages cannot be put in SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
