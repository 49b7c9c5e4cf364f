"""Explicit schemas of everything read from JSON. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as S

CANDIDATE = S.StructType([S.StructField("agent", S.StringType()), S.StructField("text", S.StringType())])

READING = S.StructType(
    [
        S.StructField("agent", S.StringType()),
        S.StructField("text", S.StringType()),
        S.StructField("latency_ms", S.LongType()),
        S.StructField("err", S.StringType()),
    ]
)

SEGMENT = S.StructType(
    [
        S.StructField("text", S.StringType()),
        S.StructField("confidence", S.DoubleType()),
        S.StructField("source", S.StringType()),
        S.StructField("from", S.ArrayType(S.StringType())),
        S.StructField("disputed", S.BooleanType()),
        S.StructField("candidates", S.ArrayType(CANDIDATE)),
    ]
)

STATS = S.StructType(
    [
        S.StructField(name, kind)
        for name, kind in (
            ("engines", S.LongType()),
            ("failed_engines", S.LongType()),
            ("segments", S.LongType()),
            ("consensus_segments", S.LongType()),
            ("escalated_segments", S.LongType()),
            ("fallback_segments", S.LongType()),
            ("dropped_segments", S.LongType()),
            ("escalator", S.StringType()),
            ("escalation_err", S.StringType()),
            ("duplicate_checker", S.StringType()),
            ("duplicate_check_err", S.StringType()),
            ("duplicate_segments", S.LongType()),
        )
    ]
)

RESULT = S.StructType(
    [
        S.StructField("text", S.StringType()),
        S.StructField("confidence", S.DoubleType()),
        S.StructField("segments", S.ArrayType(SEGMENT)),
        S.StructField("stats", STATS),
        S.StructField("candidates", S.ArrayType(READING)),
    ]
)

PAGE = S.StructType(
    [
        S.StructField("id", S.StringType()),
        S.StructField("source_page", S.LongType()),
        S.StructField("page_number", S.LongType()),
        S.StructField("status", S.StringType()),
        S.StructField("image_ready", S.BooleanType()),
        S.StructField("result_ready", S.BooleanType()),
        S.StructField("confidence", S.DoubleType()),
        S.StructField("segments", S.LongType()),
        S.StructField("pending_disputes", S.LongType()),
        S.StructField("duration_ms", S.LongType()),
        S.StructField("revision", S.LongType()),
        S.StructField("error", S.StringType()),
        S.StructField("updated_at", S.TimestampType()),
    ]
)

DOCUMENT = S.StructType(
    [
        S.StructField("id", S.StringType()),
        S.StructField("user_id", S.StringType()),
        S.StructField("username", S.StringType()),
        S.StructField("name", S.StringType()),
        S.StructField("source_type", S.StringType()),
        S.StructField("mime_type", S.StringType()),
        S.StructField("size_bytes", S.LongType()),
        S.StructField("status", S.StringType()),
        S.StructField("engines", S.ArrayType(S.StringType())),
        S.StructField("arbiter", S.StringType()),
        S.StructField("duplicate_checker", S.StringType()),
        S.StructField("auto_arbitrate", S.BooleanType()),
        S.StructField("created_at", S.TimestampType()),
        S.StructField("updated_at", S.TimestampType()),
        S.StructField("completed_at", S.TimestampType()),
        S.StructField("error", S.StringType()),
        S.StructField("pages", S.ArrayType(PAGE)),
    ]
)

TASK = S.StructType(
    [
        S.StructField("id", S.StringType()),
        S.StructField("user_id", S.StringType()),
        S.StructField("username", S.StringType()),
        S.StructField("filename", S.StringType()),
        S.StructField("status", S.StringType()),
        S.StructField("engines", S.ArrayType(S.StringType())),
        S.StructField("arbiter", S.StringType()),
        S.StructField("duplicate_checker", S.StringType()),
        S.StructField("created_at", S.TimestampType()),
        S.StructField("completed_at", S.TimestampType()),
        S.StructField("duration_ms", S.LongType()),
        S.StructField("result", RESULT),
        S.StructField("error", S.StringType()),
    ]
)

# Credential fields of a user are left out on purpose, so they are never read.
USER = S.StructType(
    [
        S.StructField("id", S.StringType()),
        S.StructField("username", S.StringType()),
        S.StructField("role", S.StringType()),
        S.StructField("disabled", S.BooleanType()),
        S.StructField("created_at", S.TimestampType()),
        S.StructField("updated_at", S.TimestampType()),
    ]
)

STORE = S.StructType(
    [
        S.StructField("version", S.IntegerType()),
        S.StructField("users", S.ArrayType(USER)),
        S.StructField("tasks", S.ArrayType(TASK)),
        S.StructField("documents", S.ArrayType(DOCUMENT)),
    ]
)

MODEL = S.StructType(
    [
        S.StructField("id", S.StringType()),
        S.StructField("context", S.LongType()),
        S.StructField("alias", S.StringType()),
        S.StructField("api", S.StringType()),
    ]
)

PROVIDER = S.StructType(
    [
        S.StructField("id", S.StringType()),
        S.StructField("alias", S.StringType()),
        S.StructField("base_url", S.StringType()),
        S.StructField("api_key", S.StringType()),
        S.StructField("models", S.ArrayType(MODEL)),
    ]
)

CONFIG = S.StructType(
    [
        S.StructField("providers", S.ArrayType(PROVIDER)),
        S.StructField("engines", S.ArrayType(S.StringType())),
        S.StructField("arbiter", S.StringType()),
        S.StructField("duplicate_checker", S.StringType()),
        S.StructField("engine_timeout_seconds", S.LongType()),
        S.StructField("arbiter_timeout_seconds", S.LongType()),
        S.StructField("engine_max_attempts", S.LongType()),
        S.StructField("arbiter_max_attempts", S.LongType()),
        S.StructField("timeout_seconds", S.LongType()),
    ]
)

EVENT = S.StructType(
    [
        S.StructField("doc_id", S.StringType()),
        S.StructField("page_id", S.StringType()),
        S.StructField("seq", S.LongType()),
        S.StructField("ts", S.TimestampType()),
        S.StructField("type", S.StringType()),
        S.StructField("stage", S.StringType()),
        S.StructField("agent", S.StringType()),
        S.StructField("kind", S.StringType()),
        S.StructField("text", S.StringType()),
        S.StructField("total", S.IntegerType()),
        S.StructField("latency_ms", S.LongType()),
        S.StructField("attempt", S.IntegerType()),
        S.StructField("max_attempts", S.IntegerType()),
        S.StructField("error", S.StringType()),
    ]
)
