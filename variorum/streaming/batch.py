"""Batch twins of the streaming jobs, over a whole event table.

An event table has ``doc_id, page_id, seq, ts, type, stage, agent, kind, text, total, latency_ms,
attempt, max_attempts, error``; ``seq`` gives the order inside a page. Ordered steps use bucketed
scans and everything else is an aggregate, so one busy page does not become one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variorum.functions import text as T
from variorum.operators import ordered
from variorum.session import stage

PAGE = ["doc_id", "page_id"]
AGENT = ["doc_id", "page_id", "stage", "agent"]
AGENT_EVENTS = ("agent_start", "attempt_start", "delta", "attempt_failed", "agent_done")
IDLE_SECONDS = 120
TPS_SECONDS = 0.25
TERMINAL = ("result", "error")


def _newest(value: Column, when: Column) -> Column:
    """Aggregate: ``value`` of the last row in order for which ``when`` holds; null if none."""
    return F.max_by(value, F.when(when, F.col("seq")))


def _is(*types: str) -> Column:
    return F.col("type").isin(*types)


def attempts(events: DataFrame) -> DataFrame:
    """Deltas with the attempt of the latest attempt start of their stage and agent."""
    started = F.when(_is("attempt_start"), F.struct("attempt", "max_attempts"))
    carried = ordered.carry_last(
        events.filter(_is("attempt_start", "delta")), AGENT, ["seq"], ordered.bucket_of("seq"), started, "_started"
    )
    return carried.filter(_is("delta")).select(
        *[c for c in events.columns if c not in ("attempt", "max_attempts")],
        F.coalesce("_started.attempt", "attempt").alias("attempt"),
        F.coalesce("_started.max_attempts", "max_attempts").alias("max_attempts"),
    )


def _current(events: DataFrame) -> DataFrame:
    """Events of agents with ``current``: whether the row belongs to the newest attempt of its agent.

    That attempt begins at the agent's last start, so one aggregate tells it and nothing is scanned in order.
    """
    mine = events.filter(_is(*AGENT_EVENTS))
    last = mine.groupBy(*AGENT).agg(F.max(F.when(_is("attempt_start"), F.col("seq"))).alias("_start"))
    return (
        mine.join(last, AGENT)
        .withColumn("current", F.col("_start").isNull() | (F.col("seq") >= F.col("_start")))
        .drop("_start")
    )


def joined_tokens(fragments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Token estimate of the joined ``text`` of each key, without joining it.

    An ASCII run may cross fragments. Fragments are numbered by how many of them break runs so far;
    the run between two breaks is the tail of one, the whole fragments in between and the head of
    the next, so its length is a sum over rows with the same number.
    """
    keys = list(keys)
    parts = fragments.select(*keys, "seq", T.token_parts("text").alias("p"))
    numbered = ordered.running_total(
        parts, keys, ["seq"], ordered.bucket_of("seq"), (~F.col("p.whole")).cast("int"), "breaks"
    )

    def piece(run: Column, length: str, inner: Column) -> Column:
        return F.struct(run.alias("run"), F.col(length).alias("length"), inner.alias("inner"))

    here, none = F.col("breaks"), F.lit(0).cast("long")
    pieces = F.when(F.col("p.whole"), F.array(piece(here, "p.lead", F.col("p.inner")))).otherwise(
        F.array(piece(here - 1, "p.lead", none), piece(here, "p.trail", F.col("p.inner")))
    )
    return (
        numbered.select(*keys, F.explode(pieces).alias("r"))
        .groupBy(*keys, "r.run")
        .agg(F.sum("r.length").alias("length"), F.sum("r.inner").alias("inner"))
        .groupBy(*keys)
        .agg((F.sum(F.floor((F.col("length") + 3) / 4)) + F.sum("inner")).cast("long").alias("tokens"))
    )


def joined_tail(fragments: DataFrame, keys: Sequence[str], out: str, chars: int = T.PREVIEW_CHARS) -> DataFrame:
    """The last characters of the joined ``text`` of each key; only fragments that reach into them are gathered."""
    keys = list(keys)
    sized = fragments.select(*keys, (-F.col("seq")).alias("back"), "text", F.char_length("text").alias("size")).filter("size > 0")
    counted = ordered.running_total(sized, keys, ["back"], ordered.bucket_of("back"), F.col("size"), "reach")
    near = counted.filter(F.col("reach") - F.col("size") < chars).withColumn("seq", -F.col("back"))
    return near.groupBy(*keys).agg(F.right(ordered.joined_text("seq", "text", ""), F.lit(chars)).alias(out))


def agent_state(events: DataFrame) -> DataFrame:
    """State of every agent after its last event: times, measures of the newest attempt, errors."""
    wanted = ("seq", "ts", "type", "kind", "text", "attempt", "max_attempts", "error", "current")
    marked = stage(_current(events).select(*AGENT, *wanted), "marked")
    # An attempt that starts after a run ended in an error keeps that error as the last one. Fragments have
    # no say in it and stay out of the ordered scan.
    ended = F.when(_is("attempt_failed", "agent_done"), F.col("error"))
    turns = marked.filter(_is("attempt_start", "attempt_failed", "agent_done")).select(*AGENT, "seq", "type", "error")
    told = ordered.carry_last(turns, AGENT, ["seq"], ordered.bucket_of("seq"), ended, "_ended")
    keeps = _is("attempt_failed") | (_is("attempt_start") & (F.coalesce("_ended", F.lit("")) != ""))
    errors = told.groupBy(*AGENT).agg(F.coalesce(_newest(F.col("_ended"), keeps), F.lit("")).alias("last_error"))
    now = F.col("current")
    out = now & _is("delta") & (F.col("kind") != "thinking")
    retry = F.col("attempt") < F.col("max_attempts")
    status = (
        F.when(_is("agent_start", "attempt_start"), "waiting")
        .when(_is("delta"), F.when(F.col("kind") == "thinking", "thinking").otherwise("streaming"))
        .when(_is("attempt_failed"), F.when(retry, "retrying").otherwise("failed"))
        .otherwise(F.when(F.col("error") != "", "failed").otherwise("completed"))
    )
    error = F.when(_is("attempt_start") | (_is("attempt_failed") & retry), "").otherwise(F.col("error"))
    base = marked.groupBy(*AGENT).agg(
        F.max("seq").alias("last_seq"),
        F.max_by(status, "seq").alias("status"),
        F.coalesce(_newest(F.col("ts"), _is("attempt_start")), F.min_by("ts", "seq")).alias("started_at"),
        F.min(F.when(now & _is("delta"), F.col("ts"))).alias("first_token_at"),
        F.min(F.when(out, F.col("ts"))).alias("first_output_at"),
        _newest(F.col("ts"), now & _is("attempt_failed", "agent_done")).alias("finished_at"),
        F.coalesce(F.sum(F.when(out, F.char_length("text"))), F.lit(0)).alias("output_chars"),
        F.coalesce(_newest(F.col("attempt"), _is("attempt_start", "attempt_failed")), F.lit(0)).alias("attempt"),
        F.coalesce(
            _newest(F.col("max_attempts"), _is("agent_start", "attempt_start", "attempt_failed")), F.lit(0)
        ).alias("max_attempts"),
        F.coalesce(_newest(error, _is("attempt_start", "attempt_failed", "agent_done")), F.lit("")).alias("error"),
    )
    thought = (F.col("kind") == "thinking").alias("thought")
    fragments = marked.filter(now & _is("delta")).select(*AGENT, thought, "seq", "text")
    tails = joined_tail(fragments, [*AGENT, "thought"], "tail").groupBy(*AGENT).agg(
        F.max(F.when(~F.col("thought"), F.col("tail"))).alias("output"),
        F.max(F.when(F.col("thought"), F.col("tail"))).alias("thinking"),
    )
    return (
        base.join(errors, AGENT, "left")
        .join(joined_tokens(fragments.filter("NOT thought"), AGENT), AGENT, "left")
        .join(tails, AGENT, "left")
        .withColumn("tokens", F.coalesce("tokens", F.lit(0).cast("long")))
        .na.fill("", ["output", "thinking", "last_error"])
    )


def _millis(start: str, end: Column) -> Column:
    return F.floor((F.unix_micros(end) - F.unix_micros(start)) / 1000).cast("long")


def heartbeat(agents: DataFrame, now: Column) -> DataFrame:
    """Elapsed time, time to first token and throughput as of ``now``; finished agents stand still."""
    end = F.coalesce("finished_at", now)
    seconds = (F.unix_micros(end) - F.unix_micros("first_output_at")) / 1e6
    rate = F.floor(F.col("tokens") / seconds * 10 + 0.5) / 10
    return (
        agents.withColumn("elapsed_ms", _millis("started_at", end))
        .withColumn("first_token", F.col("first_token_at").isNotNull())
        .withColumn("ttft_ms", F.coalesce(_millis("started_at", F.col("first_token_at")), F.lit(0).cast("long")))
        .withColumn("tps", F.when(seconds >= TPS_SECONDS, rate).otherwise(0.0))
    )


def agent_progress(events: DataFrame, now: Column) -> DataFrame:
    return heartbeat(agent_state(events), now)


def page_stage(events: DataFrame) -> DataFrame:
    """Stage machine per page. A plain aggregate, so the same plan runs on a stream.

    ``closing`` is the first terminal event, null while there is none: the page is then complete. Events
    behind it must be left out first, see ``after_terminal``.
    """
    after = (
        F.when(_is("stage_start", "agent_start", "attempt_start"), F.col("stage"))
        .when(_is("stage_done") & (F.col("stage") == "engine"), "merge")
        .when(_is("agent_done") & F.col("stage").isin("arbiter", "duplicate_check"), "saving")
        .when(_is("done"), "saving")
    )
    counted = _is("stage_start") & (F.col("stage") == "engine") & (F.col("total") > 0)
    return events.groupBy(*PAGE).agg(
        F.when(F.count_if(_is(*TERMINAL)) > 0, "complete")
        .otherwise(F.coalesce(_newest(after, after.isNotNull()), F.lit("loading")))
        .alias("stage"),
        F.coalesce(_newest(F.col("total"), counted), F.lit(0)).alias("total_engines"),
        F.count(F.lit(1)).alias("sequence"),
        F.min("ts").alias("started_at"),
        F.min_by(F.when(_is(*TERMINAL), F.struct("ts", "type", "error")), F.when(_is(*TERMINAL), F.col("seq"))).alias("closing"),
    )


def page_progress(events: DataFrame, agents: DataFrame, now: Column) -> DataFrame:
    """Page snapshots: stage, status, error, engines done and in total, elapsed time.

    A page is closed by its first terminal event: a result completes it, an error fails it, its clock stands
    still from then on, and nothing that comes later counts. ``agents`` is the state of ``events`` up to there.
    """
    events, _ = after_terminal(events)
    done = agents.filter("stage = 'engine' AND status IN ('completed', 'failed')").groupBy(*PAGE).agg(
        F.count(F.lit(1)).alias("completed_engines")
    )
    return (
        page_stage(events)
        .join(done, PAGE, "left")
        .withColumn("completed_engines", F.coalesce("completed_engines", F.lit(0).cast("long")))
        .withColumn("elapsed_ms", _millis("started_at", F.coalesce("closing.ts", now)))
        .withColumn(
            "status",
            F.when(F.col("closing").isNull(), "running").when(F.col("closing.type") == "error", "failed").otherwise("completed"),
        )
        .withColumn("error", F.coalesce("closing.error", F.lit("")))
        .drop("closing")
    )


def progress_rollup(agents: DataFrame, pages: DataFrame) -> DataFrame:
    """Per page: tokens, throughput, first token of any agent, and percent of engines done."""
    summed = agents.groupBy(*PAGE).agg(
        F.sum("tokens").alias("tokens"),
        F.sum("tps").alias("tps"),
        F.min(F.when(F.col("first_token"), F.col("ttft_ms"))).alias("first_token_ms"),
    )
    percent = F.when(F.col("total_engines") > 0, F.col("completed_engines") / F.col("total_engines") * 100).otherwise(0.0)
    return pages.join(summed, PAGE, "left").select(
        *PAGE,
        F.coalesce("tokens", F.lit(0).cast("long")).alias("tokens"),
        F.coalesce("tps", F.lit(0.0)).alias("tps"),
        "first_token_ms",
        percent.alias("percent"),
    )


def latest_progress(snapshots: DataFrame, order: str = "sequence") -> DataFrame:
    """The newest snapshot per document. A plain aggregate, so the same plan runs on a stream."""
    rest = [c for c in snapshots.columns if c != "doc_id"]
    newest = snapshots.groupBy("doc_id").agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row"))
    return newest.select("doc_id", "_row.*")


def idle_attempts(events: DataFrame, now: Column, timeout: int = IDLE_SECONDS) -> DataFrame:
    """First moment each attempt went without a fragment for the timeout.

    An attempt start or a fragment renews the wait; the next event of the agent, or ``now``, ends it.
    """
    starts = _is("attempt_start").cast("long")
    seen = ordered.two_pass(
        events.filter(_is(*AGENT_EVENTS)).select(*AGENT, "seq", "ts", "type"),
        AGENT,
        ["seq"],
        ordered.bucket_of("seq"),
        {"epoch": lambda w: F.sum(starts).over(ordered.up_to(w)), "soon": lambda w: F.lead("ts").over(w)},
        {"starts": F.sum(starts), "first_ts": F.min_by("ts", "seq")},
        {"started": lambda w: F.sum("starts").over(ordered.before(w)), "later": lambda w: F.lead("first_ts").over(w)},
    )
    waited = F.unix_micros(F.coalesce("soon", "later", now)) - F.unix_micros("ts")
    idle = seen.filter(_is("attempt_start", "delta") & (waited >= timeout * 1_000_000))
    epoch = (F.col("epoch") + F.coalesce("started", F.lit(0))).alias("epoch")
    return idle.groupBy(*AGENT, epoch).agg((F.min("ts") + F.make_dt_interval(secs=F.lit(timeout))).alias("idle_at"))


def retry_outcomes(events: DataFrame) -> DataFrame:
    """Per run of an agent: attempts, failures, latency, final error, and whether the rules held."""
    runs = ordered.running_total(
        events.filter(_is(*AGENT_EVENTS)), AGENT, ["seq"], ordered.bucket_of("seq"), _is("agent_start").cast("int"), "run"
    )
    done = _is("agent_done")
    return runs.groupBy(*AGENT, "run").agg(
        F.count_if(_is("attempt_start")).alias("attempts"),
        F.count_if(_is("attempt_failed")).alias("failures"),
        F.coalesce(F.max("max_attempts"), F.lit(0)).alias("max_attempts"),
        F.coalesce(_newest(F.col("latency_ms"), done), F.lit(0).cast("long")).alias("latency_ms"),
        F.coalesce(_newest(F.col("error"), done), F.lit("")).alias("error"),
        F.bool_or(done).alias("finished"),
    ).withColumn("within_limit", F.col("attempts") <= F.greatest("max_attempts", F.lit(1)))


def assemble_stream(deltas: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Output and thinking of each attempt, joined in order; an attempt without output is an error.

    The two texts are values of the result, so a key is as large as its own result row.
    """
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "kind", "text")))

    def joined(kind: str) -> Column:
        return F.array_join(F.transform(F.filter("rows", lambda r: r["kind"] == kind), lambda r: r["text"]), "")

    told = deltas.groupBy(*keys).agg(rows.alias("rows")).select(
        *keys, joined("output").alias("output"), joined("thinking").alias("thinking"), joined("error").alias("_error")
    )
    error = F.when(F.col("_error") != "", F.col("_error")).when(F.col("output") == "", "no text").otherwise("")
    return told.withColumn("error", error).drop("_error")


def barrier_audit(events: DataFrame) -> DataFrame:
    """Pages whose events break the order: engines, then their barrier, arbiter, repeat check, done.

    One aggregate per page; the same plan runs on a stream.
    """

    def first(when: Column) -> Column:
        return F.min(F.when(when, F.col("seq")))

    def last(when: Column) -> Column:
        return F.max(F.when(when, F.col("seq")))

    engine, arbiter, repeat = (F.col("stage") == s for s in ("engine", "arbiter", "duplicate_check"))
    seen = events.groupBy(*PAGE).agg(
        last(engine & _is("agent_done")).alias("engine_done"),
        last(engine & _is("stage_done")).alias("barrier"),
        first(arbiter).alias("arbiter_first"),
        last(arbiter).alias("arbiter_last"),
        first(repeat).alias("repeat_first"),
        first(_is("done")).alias("done"),
        F.max("seq").alias("last"),
    )
    rules = [
        (F.col("engine_done") > F.col("barrier"), "engine after barrier"),
        (F.col("arbiter_first") < F.coalesce("barrier", "arbiter_last"), "arbiter before barrier"),
        (F.col("repeat_first") < F.col("arbiter_last"), "repeat check before arbiter"),
        (F.col("last") > F.col("done"), "event after done"),
    ]
    broken = F.array_compact(F.array(*[F.when(rule, F.lit(text)) for rule, text in rules]))
    return seen.select(*PAGE, F.array_join(broken, "|").alias("violations")).filter("violations <> ''")


def after_terminal(
    events: DataFrame, keys: Sequence[str] = PAGE, terminal: Sequence[str] = TERMINAL
) -> tuple[DataFrame, DataFrame]:
    """(events up to the first terminal one, keys that never had one)."""
    keys = list(keys)
    closed = events.groupBy(*keys).agg(F.min(F.when(_is(*terminal), F.col("seq"))).alias("_closed"))
    kept = events.join(closed, keys).filter("_closed IS NULL OR seq <= _closed").drop("_closed")
    return kept, closed.filter("_closed IS NULL").select(*keys)
