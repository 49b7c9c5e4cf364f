"""Jobs over text tables: segment, shingle, clean and count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variorum.functions import text as T


def clean_layout(df: DataFrame, text: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or text, T.clean_layout(text))


def segment(
    df: DataFrame, keys: Sequence[str], text: str, terminators: str = T.SENTENCE_ENDS
) -> DataFrame:
    """One row per sentence: keys, ``pos`` from 0, ``segment``."""
    return df.select(*keys, F.posexplode(T.segments_of(text, terminators)).alias("pos", "segment"))


def shingle(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """One row per distinct bigram of the core form of ``text``."""
    return df.select(*keys, F.explode(T.bigrams(T.core_form(text))).alias("gram"))


def estimate_tokens(df: DataFrame, text: str, by: Sequence[str] = ()) -> DataFrame:
    """Token estimate per row, or summed by the given columns."""
    counted = df.withColumn("tokens", T.estimate_tokens(text))
    if not by:
        return counted
    return counted.groupBy(*by).agg(F.sum("tokens").alias("tokens"))


def split_list(df: DataFrame, text: str, out: str) -> DataFrame:
    return df.withColumn(out, T.split_list(text))


def strip_fences(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn(text, T.strip_fences(text))


def clean_names(documents: DataFrame) -> DataFrame:
    cleaned = documents.withColumn("name", T.clean_name("name", "source_type"))
    return cleaned.withColumn("stem", T.document_stem("name"))
