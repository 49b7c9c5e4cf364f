"""Captured model responses and event-stream logs to text, thinking and errors.

Bodies become variants once and fields are picked by path, so a value keeps its JSON type: a text
that looks like a list is still a text. Everything works inside one row, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variorum.functions import text as T
from variorum.operators.catalog import CHAT, MESSAGES, RESPONSES


def _text(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "string"), F.lit(""))


def _kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _list(v: Column, path: str, schema: str) -> Column:
    empty = F.array().cast(f"array<{schema}>")
    return F.coalesce(F.from_json(F.to_json(F.try_variant_get(v, path, "variant")), f"array<{schema}>"), empty)


def _present(c: Column) -> Column:
    return F.when(c != "", c)


def content_text(v: Column, path: str) -> Column:
    """A message content: a string, or the text parts of a list joined by line breaks."""
    kind = _kind(v, path)
    parts = F.filter(
        _list(v, path, "struct<type:string,text:string>"),
        lambda p: p["type"].isin("text", "output_text") & (F.coalesce(p["text"], F.lit("")) != ""),
    )
    return (
        F.when(kind == "STRING", _text(v, path))
        .when(kind.startswith("ARRAY"), F.array_join(F.transform(parts, lambda p: p["text"]), "\n"))
        .otherwise("")
    )


def _thinking(v: Column, base: str) -> Column:
    """First non-empty of the three names in use."""
    names = ("reasoning_content", "reasoning", "thinking")
    return F.coalesce(*[_present(content_text(v, f"{base}.{n}")) for n in names], F.lit(""))


def api_error(v: Column) -> Column:
    """Error message of a body or event (variant), or the empty string."""
    kind = _text(v, "$.type")
    nested = F.when(_kind(v, "$.error").startswith("OBJECT"), _present(_text(v, "$.error.message")))
    plain = F.when(_kind(v, "$.error") == "STRING", _present(_text(v, "$.error")))
    tail = F.when((kind == "error") | kind.endswith(".failed"), _present(_text(v, "$.message")))
    return F.coalesce(nested, plain, _present(_text(v, "$.response.error.message")), tail, F.lit(""))


def with_api_error(df: DataFrame, body: str, out: str = "error") -> DataFrame:
    return df.withColumn(out, F.coalesce(api_error(F.try_parse_json(body)), F.lit("")))


def ingest_responses(df: DataFrame, api: str, body: str) -> DataFrame:
    """Add ``output``, ``thinking`` and ``error`` for bodies of the three protocols."""
    v = F.col("_v")
    output_text = _text(v, "$.output_text")
    items = _list(
        v, "$.output", "struct<content:array<struct<type:string,text:string>>,summary:array<struct<type:string,text:string>>>"
    )

    def picked(parts: Column, *types: str) -> Column:
        some = F.coalesce(parts, F.array().cast("array<struct<type:string,text:string>>"))
        return F.transform(
            F.filter(some, lambda p: p["type"].isin(*types) & (F.coalesce(p["text"], F.lit("")) != "")), lambda p: p["text"]
        )

    spoken = F.array_join(F.flatten(F.transform(items, lambda i: picked(i["content"], "output_text"))), "\n")
    thought = F.array_join(F.flatten(F.transform(items, lambda i: picked(i["summary"], "summary_text", "text"))), "\n")
    blocks = _list(v, "$.content", "struct<type:string,text:string,thinking:string>")

    def block(kind: str) -> Column:
        some = F.filter(blocks, lambda b: (b["type"] == kind) & (F.coalesce(b[kind], F.lit("")) != ""))
        return F.array_join(F.transform(some, lambda b: b[kind]), "\n")

    output = (
        F.when(F.col(api) == CHAT, content_text(v, "$.choices[0].message.content"))
        .when(F.col(api) == RESPONSES, F.when(T.is_blank(output_text), spoken).otherwise(output_text))
        .when(F.col(api) == MESSAGES, block("text"))
    )
    thinking = (
        F.when(F.col(api) == CHAT, _thinking(v, "$.choices[0].message"))
        .when(F.col(api) == RESPONSES, thought)
        .when(F.col(api) == MESSAGES, block("thinking"))
    )
    told = df.withColumn("_v", F.try_parse_json(body))
    parsed = told.withColumn("_out", output).withColumn("_think", thinking).withColumn("_api", api_error(v))
    no_choice = (F.col(api) == CHAT) & ~F.coalesce(_kind(v, "$.choices[0]").startswith("OBJECT"), F.lit(False))
    error = (
        F.when(F.col("_v").isNull(), "invalid JSON")
        .when(F.col("_api") != "", F.col("_api"))
        .when(F.col("_out").isNull(), "unsupported api")
        .when(no_choice, "no choice")
        .when(F.col("_out") == "", "no text")
        .otherwise("")
    )
    done = parsed.withColumn("error", error)
    good = F.col("error") == ""
    return (
        done.withColumn("output", F.when(good, F.col("_out")).otherwise(""))
        .withColumn("thinking", F.when(good, F.coalesce("_think", F.lit(""))).otherwise(""))
        .drop("_v", "_out", "_think", "_api")
    )


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def frames(log: str | Column) -> Column:
    """Array of ``event, data`` frames of an event-stream log, in order."""
    lines = F.regexp_replace(T.col(log), r"\r(?=\n|\z)", "")
    blocks = F.split(lines, r"\n\n+")

    def values(lines: Column, field: str) -> Column:
        mine = F.filter(lines, lambda line: (line == field) | line.startswith(field + ":"))
        return F.transform(mine, lambda line: F.regexp_replace(line, rf"\A{field}:? ?", ""))

    def told(lines: Column) -> Column:
        return _let(
            F.struct(values(lines, "event").alias("event"), values(lines, "data").alias("data")),
            lambda found: F.struct(
                F.coalesce(F.try_element_at(found["event"], F.lit(-1)), F.lit("")).alias("event"),
                F.size(found["data"]).alias("lines"),
                F.array_join(found["data"], "\n").alias("data"),
            ),
        )

    def frame(block: Column) -> Column:
        return _let(F.split(block, "\n"), told)

    return F.filter(F.transform(blocks, frame), lambda f: f["lines"] > 0)


def _output(api: Column, event: Column, v: Column) -> Column:
    return (
        F.when(api == CHAT, content_text(v, "$.choices[0].delta.content"))
        .when((api == RESPONSES) & (_named(event, v) == "response.output_text.delta"), _text(v, "$.delta"))
        .when((api == MESSAGES) & (_block(v) == "text_delta"), _text(v, "$.delta.text"))
        .otherwise("")
    )


def _thought(api: Column, event: Column, v: Column) -> Column:
    thinking = _named(event, v).isin("response.reasoning_summary_text.delta", "response.reasoning_text.delta")
    return (
        F.when(api == CHAT, _thinking(v, "$.choices[0].delta"))
        .when((api == RESPONSES) & thinking, _text(v, "$.delta"))
        .when((api == MESSAGES) & (_block(v) == "thinking_delta"), _text(v, "$.delta.thinking"))
        .otherwise("")
    )


def _named(event: Column, v: Column) -> Column:
    kind = _text(v, "$.type")
    return F.when(kind == "", event).otherwise(kind)


def _block(v: Column) -> Column:
    return F.when(_text(v, "$.type") == "content_block_delta", _text(v, "$.delta.type"))


def _frame_error(api: Column, event: Column, data: Column, v: Column) -> Column:
    """Why a frame, `v` once parsed, ends its stream, or the empty string.

    In a frame that names no error, and escapes no letter that could name one, none is looked for.
    """
    kind = _text(v, "$.type")
    bad = ("response.error", "response.failed")
    suspect = (
        data.contains("error") | data.contains("failed") | data.contains("\\u") | event.isin("error", *bad)
    )
    return (
        F.when(v.isNull(), "invalid event")
        .when(~suspect, "")
        .when(api_error(v) != "", api_error(v))
        .when((api == RESPONSES) & (kind.isin(*bad) | event.isin(*bad)), "stream error")
        .when((api == MESSAGES) & ((kind == "error") | (event == "error")), "stream error")
        .otherwise("")
    )


def ingest_sse(df: DataFrame, log: str, api: str) -> DataFrame:
    """Delta rows of event-stream logs: all other columns, ``at``, ``kind``, ``text``.

    ``kind`` is output, thinking or error. A log stops at its first error, which comes as a row.
    The stop is found inside the log's own row, so frames become rows without a shuffle. A frame is
    parsed once.
    """
    rest = [c for c in df.columns if c != log]
    told = F.filter(frames(log), lambda f: f["data"] != "[DONE]")

    def judged(f: Column) -> Column:
        return _let(
            F.try_parse_json(f["data"]),
            lambda v: F.struct(
                f["event"].alias("event"), v.alias("v"), _frame_error(F.col(api), f["event"], f["data"], v).alias("error")
            ),
        )

    parsed = df.withColumn("_frames", F.transform(told, judged))
    stop = F.array_position(F.transform("_frames", lambda f: f["error"] != ""), True).cast("int")
    kept = parsed.select(*rest, "_frames", F.when(stop > 0, stop).otherwise(F.size("_frames")).alias("_stop"))
    # The explode sits between the array work and the picking of fields, which then runs in generated code.
    # The outer form and the coalesce keep Catalyst from adding size() and null filters, which it would push to the scan
    # and for which it would do all the array work again.
    inside = F.coalesce(F.col("frame") < F.col("_stop"), F.lit(False))
    rows = kept.select(*rest, "_stop", F.posexplode_outer("_frames").alias("frame", "z")).filter(inside).select(
        *rest, "frame", F.col("z.error").alias("error"), F.col("z.event").alias("event"), F.col("z.v").alias("v")
    )
    deltas = rows.select(
        *rest, "frame", "error",
        _thought(F.col(api), F.col("event"), F.col("v")).alias("thinking"),
        _output(F.col(api), F.col("event"), F.col("v")).alias("output"),
    )

    def piece(kind: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("text"))

    pieces = F.filter(
        F.when(F.col("error") != "", F.array(piece("error"))).otherwise(F.array(piece("thinking"), piece("output"))),
        lambda p: p["text"] != "",
    )
    return deltas.select(*rest, "frame", F.posexplode(pieces).alias("part", "p")).select(
        *rest, (F.col("frame") * 2 + F.col("part")).cast("long").alias("at"), "p.kind", "p.text"
    )
