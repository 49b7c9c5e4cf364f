"""Checked queries over lifecycle events."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs as I
from checks import sql as Q
from variorum.session import fresh_folder, ship_package, stage
from variorum.sources import lifecycle
from variorum.streaming import batch as B

QUERIES: dict = {}
SQL: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


NOW = "2024-02-15 00:00:00"


def now():
    return F.to_timestamp(F.lit(NOW))


EVENTS = """
raw AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
typed AS (SELECT *, CASE WHEN event_type = 'signup' AND k < 5 THEN 'stage_start' WHEN event_type = 'signup' AND k < 15 THEN 'agent_start'
  WHEN event_type = 'signup' THEN 'attempt_start' WHEN event_type IN ('click', 'view') THEN 'delta' WHEN event_type = 'error' THEN 'attempt_failed'
  WHEN k < 5 THEN 'stage_done' WHEN k < 8 THEN 'done' ELSE 'agent_done' END AS type FROM raw),
ev AS (SELECT CAST(user_id AS VARCHAR) AS doc_id, 'page-000001' AS page_id, event_id AS seq, ts, type,
  CASE WHEN type = 'done' THEN '' WHEN k % 10 < 7 THEN 'engine' WHEN k % 10 < 9 THEN 'arbiter' ELSE 'duplicate_check' END AS stage,
  CASE WHEN type IN ('stage_start', 'stage_done', 'done') THEN '' ELSE 'm' || (k % 3) END AS agent,
  CASE event_type WHEN 'click' THEN 'output' WHEN 'view' THEN 'thinking' ELSE '' END AS kind,
  CASE event_type WHEN 'click' THEN 'w' || k || CASE WHEN value > 15 THEN ' ' WHEN value > 5 THEN '' ELSE 'é' END WHEN 'view' THEN 't' || k ELSE '' END AS text,
  CASE WHEN type = 'stage_start' THEN k % 4 ELSE 0 END AS total, CAST(floor(value * 10) AS BIGINT) AS latency_ms,
  CASE WHEN type IN ('attempt_start', 'attempt_failed') THEN 1 + k % 2 ELSE 0 END AS attempt,
  CASE WHEN type IN ('attempt_start', 'attempt_failed', 'agent_start') THEN 2 ELSE 0 END AS max_attempts,
  CASE WHEN type = 'attempt_failed' THEN 'e' || k WHEN type = 'agent_done' AND k >= 60 THEN 'gave up ' || k ELSE '' END AS error FROM typed),
ag AS (SELECT * FROM ev WHERE type IN ('agent_start', 'attempt_start', 'delta', 'attempt_failed', 'agent_done'))"""

KEY = "doc_id, page_id, stage, agent"

STATE = EVENTS + f""",
ep AS (SELECT *, sum(CASE WHEN type = 'attempt_start' THEN 1 ELSE 0 END) OVER w AS epoch,
  last_value(CASE WHEN type IN ('attempt_failed', 'agent_done') THEN error END IGNORE NULLS) OVER w AS ended
  FROM ag WINDOW w AS (PARTITION BY {KEY} ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
cur AS (SELECT *, epoch = max(epoch) OVER (PARTITION BY {KEY}) AS cur FROM ep),
st AS (SELECT {KEY},
  arg_max(CASE WHEN type IN ('agent_start', 'attempt_start') THEN 'waiting' WHEN type = 'delta' AND kind = 'thinking' THEN 'thinking'
    WHEN type = 'delta' THEN 'streaming' WHEN type = 'attempt_failed' AND attempt < max_attempts THEN 'retrying' WHEN type = 'attempt_failed' THEN 'failed'
    WHEN error <> '' THEN 'failed' ELSE 'completed' END, seq) AS status,
  coalesce(arg_max(ts, seq) FILTER (WHERE type = 'attempt_start'), arg_min(ts, seq)) AS started_at,
  min(ts) FILTER (WHERE cur AND type = 'delta') AS first_token_at,
  min(ts) FILTER (WHERE cur AND type = 'delta' AND kind <> 'thinking') AS first_output_at,
  arg_max(ts, seq) FILTER (WHERE cur AND type IN ('attempt_failed', 'agent_done')) AS finished_at,
  coalesce(string_agg(text, '' ORDER BY seq) FILTER (WHERE cur AND type = 'delta' AND kind <> 'thinking'), '') AS out,
  coalesce(string_agg(text, '' ORDER BY seq) FILTER (WHERE cur AND type = 'delta' AND kind = 'thinking'), '') AS think,
  coalesce(arg_max(attempt, seq) FILTER (WHERE type IN ('attempt_start', 'attempt_failed')), 0) AS attempt,
  coalesce(arg_max(max_attempts, seq) FILTER (WHERE type IN ('agent_start', 'attempt_start', 'attempt_failed')), 0) AS max_attempts,
  coalesce(arg_max(CASE WHEN type = 'attempt_start' OR (type = 'attempt_failed' AND attempt < max_attempts) THEN '' ELSE error END, seq)
    FILTER (WHERE type IN ('attempt_start', 'attempt_failed', 'agent_done')), '') AS error,
  coalesce(arg_max(ended, seq) FILTER (WHERE type = 'attempt_failed' OR (type = 'attempt_start' AND coalesce(ended, '') <> '')), '') AS last_error
  FROM cur GROUP BY {KEY}),
fin AS (SELECT *, coalesce(finished_at, TIMESTAMP '{NOW}') AS e, {Q.tokens('out')} AS tokens FROM st),
pro AS (SELECT *, (epoch_us(e) - epoch_us(started_at)) // 1000 AS elapsed_ms, first_token_at IS NOT NULL AS first_token,
  coalesce((epoch_us(first_token_at) - epoch_us(started_at)) // 1000, 0) AS ttft_ms,
  CASE WHEN (epoch_us(e) - epoch_us(first_output_at)) / 1e6 >= 0.25
    THEN floor(tokens / ((epoch_us(e) - epoch_us(first_output_at)) / 1e6) * 10 + 0.5) / 10 ELSE 0.0 END AS tps FROM fin)"""

PROGRESS_OUT = f"""SELECT {KEY}, status, elapsed_ms, first_token, ttft_ms, length(out) AS output_chars, CAST(tokens AS BIGINT) AS tokens, CAST(tps AS DOUBLE) AS tps,
  right(out, 2000) AS output, right(think, 2000) AS thinking, attempt, max_attempts, error, last_error FROM pro"""

PAGES = STATE + f""",
pg AS (SELECT doc_id, page_id, coalesce(arg_max(CASE WHEN type IN ('stage_start', 'agent_start', 'attempt_start') THEN stage
    WHEN type = 'stage_done' AND stage = 'engine' THEN 'merge' WHEN type = 'done' OR type = 'agent_done' THEN 'saving' END, seq)
    FILTER (WHERE type IN ('stage_start', 'agent_start', 'attempt_start', 'done') OR (type = 'stage_done' AND stage = 'engine')
            OR (type = 'agent_done' AND stage IN ('arbiter', 'duplicate_check'))), 'loading') AS stage,
  coalesce(arg_max(total, seq) FILTER (WHERE type = 'stage_start' AND stage = 'engine' AND total > 0), 0) AS total_engines,
  count(*) AS sequence, min(ts) AS started_at FROM ev GROUP BY doc_id, page_id),
dn AS (SELECT doc_id, page_id, count(*) AS n FROM pro WHERE stage = 'engine' AND status IN ('completed', 'failed') GROUP BY ALL),
pp AS (SELECT pg.*, coalesce(n, 0) AS completed_engines, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(started_at)) // 1000 AS elapsed_ms
  FROM pg LEFT JOIN dn USING (doc_id, page_id))"""


def _agents(spark, sf):
    return B.agent_progress(stage(I.lifecycle(spark, sf), "events"), now())


PROGRESS = [
    "doc_id", "page_id", "stage", "agent", "status", "elapsed_ms", "first_token", "ttft_ms", "output_chars", "tokens", "tps",
    "output", "thinking", "attempt", "max_attempts", "error", "last_error",
]


@check(
    "w6_attempts",
    Q.query(
        EVENTS
        + f""", c AS (SELECT *, last_value(CASE WHEN type = 'attempt_start' THEN attempt END IGNORE NULLS) OVER
          (PARTITION BY {KEY} ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a FROM ev WHERE type IN ('attempt_start', 'delta'))""",
        """SELECT doc_id, seq, stage, agent, text, coalesce(a, 0) AS attempt, CASE WHEN a IS NULL THEN 0 ELSE 2 END AS max_attempts
        FROM c WHERE type = 'delta'""",
    ),
)
def w6(spark, sf):
    return B.attempts(I.lifecycle(spark, sf)).select("doc_id", "seq", "stage", "agent", "text", "attempt", "max_attempts")


@check("t1_t9_agent_progress", Q.query(STATE, PROGRESS_OUT))
def t1(spark, sf):
    return _agents(spark, sf).select(*PROGRESS)


@check(
    "t2_page_progress",
    Q.query(PAGES, "SELECT doc_id, page_id, stage, total_engines, completed_engines, sequence, elapsed_ms FROM pp"),
)
def t2(spark, sf):
    events = stage(I.lifecycle(spark, sf), "events")
    return B.page_progress(events, B.agent_state(events), now()).select(
        "doc_id", "page_id", "stage", "total_engines", "completed_engines", "sequence", "elapsed_ms"
    )


CLOSED_EVENTS = EVENTS.replace("ag AS (SELECT * FROM ev", """named AS (SELECT * REPLACE (
    CASE WHEN type = 'done' AND seq % 3 = 0 THEN 'error' WHEN type = 'done' AND seq % 3 = 1 THEN 'result' ELSE type END AS type,
    CASE WHEN type = 'done' AND seq % 3 = 0 THEN 'broke at ' || seq ELSE error END AS error) FROM ev),
closing AS (SELECT doc_id, page_id, min(seq) AS closed_at FROM named WHERE type IN ('result', 'error') GROUP BY ALL),
open AS (SELECT named.* FROM named LEFT JOIN closing USING (doc_id, page_id) WHERE closed_at IS NULL OR seq <= closed_at),
ag AS (SELECT * FROM open""")


@check(
    "t2_closed_pages",
    Q.query(
        PAGES.replace(EVENTS, CLOSED_EVENTS).replace("count(*) AS sequence, min(ts) AS started_at FROM ev", "count(*) AS sequence, min(ts) AS started_at FROM open")
        + """,
        ends AS (SELECT doc_id, page_id, type, error, ts FROM named JOIN closing USING (doc_id, page_id) WHERE seq = closed_at)""",
        f"""SELECT pp.doc_id, pp.page_id, CASE WHEN type IS NULL THEN stage ELSE 'complete' END AS stage, total_engines, completed_engines, sequence,
        CASE type WHEN 'error' THEN 'failed' WHEN 'result' THEN 'completed' ELSE 'running' END AS status, coalesce(error, '') AS error,
        (epoch_us(coalesce(ts, TIMESTAMP '{NOW}')) - epoch_us(started_at)) // 1000 AS elapsed_ms
        FROM pp LEFT JOIN ends USING (doc_id, page_id)""",
    ),
)
def t2_closed(spark, sf):
    """Some runs end with a result or an error; what comes after no longer counts."""
    seen, _ = B.after_terminal(stage(_closing(spark, sf), "events"))
    return B.page_progress(seen, B.agent_state(seen), now()).select(*SNAPSHOT)


SNAPSHOT = [
    "doc_id", "page_id", "stage", "total_engines", "completed_engines", "sequence", "status", "error", "elapsed_ms"
]


def _closing(spark, sf):
    done, turn = F.col("type") == "done", F.col("seq") % 3
    events = I.lifecycle(spark, sf).withColumn(
        "error", F.when(done & (turn == 0), F.concat(F.lit("broke at "), "seq")).otherwise(F.col("error"))
    )
    return events.withColumn("type", F.when(done & (turn == 0), "error").when(done & (turn == 1), "result").otherwise(F.col("type")))


@check(
    "a13_progress_rollup",
    Q.query(
        PAGES,
        """SELECT pp.doc_id, pp.page_id, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens, round(CAST(coalesce(sum(tps), 0) AS DOUBLE), 6) AS tps,
        coalesce(min(ttft_ms) FILTER (WHERE first_token), -1) AS first_token_ms,
        round(CASE WHEN any_value(total_engines) > 0 THEN any_value(completed_engines) * 100.0 / any_value(total_engines) ELSE 0 END, 6) AS percent
        FROM pp LEFT JOIN pro ON pro.doc_id = pp.doc_id AND pro.page_id = pp.page_id GROUP BY pp.doc_id, pp.page_id""",
    ),
)
def a13(spark, sf):
    events = stage(I.lifecycle(spark, sf), "events")
    agents = stage(B.agent_progress(events, now()), "agents")
    rolled = B.progress_rollup(agents, B.page_progress(events, agents, now()))
    return rolled.select(
        "doc_id", "page_id", "tokens", F.round("tps", 6).alias("tps"),
        F.coalesce("first_token_ms", F.lit(-1).cast("long")).alias("first_token_ms"), F.round("percent", 6).alias("percent"),
    )


@check(
    "t3_latest_progress",
    Q.query(EVENTS, "SELECT doc_id, max(seq) AS sequence, arg_max(type, seq) AS type, arg_max(stage, seq) AS stage FROM ev GROUP BY doc_id"),
)
def t3(spark, sf):
    snapshots = I.lifecycle(spark, sf).select("doc_id", F.col("seq").alias("sequence"), "type", "stage")
    return B.latest_progress(snapshots)


@check(
    "t4_idle_attempts",
    Q.query(
        EVENTS
        + f""", ep AS (SELECT *, sum(CASE WHEN type = 'attempt_start' THEN 1 ELSE 0 END) OVER w AS epoch,
            coalesce(lead(ts) OVER (PARTITION BY {KEY} ORDER BY seq), TIMESTAMP '{NOW}') AS next
          FROM ag WINDOW w AS (PARTITION BY {KEY} ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
        f"""SELECT {KEY}, epoch, strftime(min(ts) + INTERVAL 36000 SECOND, '%Y-%m-%d %H:%M:%S') AS idle_at FROM ep
        WHERE type IN ('attempt_start', 'delta') AND epoch_us(next) - epoch_us(ts) >= 36000000000 GROUP BY {KEY}, epoch""",
    ),
)
def t4(spark, sf):
    # The events of one agent are hours apart, so the wait is ten hours here.
    found = B.idle_attempts(I.lifecycle(spark, sf), now(), timeout=36000)
    return found.withColumn("idle_at", F.date_format("idle_at", "yyyy-MM-dd HH:mm:ss"))


@check(
    "t5_retry_outcomes",
    Q.query(
        EVENTS
        + f""", r AS (SELECT *, sum(CASE WHEN type = 'agent_start' THEN 1 ELSE 0 END) OVER (PARTITION BY {KEY} ORDER BY seq) AS run FROM ag),
        g AS (SELECT {KEY}, run, count(*) FILTER (WHERE type = 'attempt_start') AS attempts, count(*) FILTER (WHERE type = 'attempt_failed') AS failures,
          max(max_attempts) AS max_attempts, coalesce(arg_max(latency_ms, seq) FILTER (WHERE type = 'agent_done'), 0) AS latency_ms,
          coalesce(arg_max(error, seq) FILTER (WHERE type = 'agent_done'), '') AS error, bool_or(type = 'agent_done') AS finished FROM r GROUP BY {KEY}, run)""",
        "SELECT *, attempts <= greatest(max_attempts, 1) AS within_limit FROM g",
    ),
)
def t5(spark, sf):
    return B.retry_outcomes(I.lifecycle(spark, sf))


@check(
    "t6_assemble_attempts",
    Q.query(
        EVENTS,
        f"""SELECT {KEY}, coalesce(string_agg(text, '' ORDER BY seq) FILTER (WHERE kind = 'output'), '') AS output,
        coalesce(string_agg(text, '' ORDER BY seq) FILTER (WHERE kind = 'thinking'), '') AS thinking,
        CASE WHEN count(*) FILTER (WHERE kind = 'output') = 0 THEN 'no text' ELSE '' END AS error
        FROM ev WHERE type = 'delta' GROUP BY {KEY}""",
    ),
)
def t6(spark, sf):
    return B.assemble_stream(I.lifecycle(spark, sf).filter("type = 'delta'"), B.AGENT, "seq")


_AUDIT = EVENTS + """,
a AS (SELECT doc_id, page_id, max(seq) FILTER (WHERE stage = 'engine' AND type = 'agent_done') AS ed,
  max(seq) FILTER (WHERE stage = 'engine' AND type = 'stage_done') AS ba, min(seq) FILTER (WHERE stage = 'arbiter') AS af,
  max(seq) FILTER (WHERE stage = 'arbiter') AS al, min(seq) FILTER (WHERE stage = 'duplicate_check') AS rf,
  min(seq) FILTER (WHERE type = 'done') AS dn, max(seq) AS la FROM ev GROUP BY doc_id, page_id),
v AS (SELECT doc_id, page_id, concat_ws('|', CASE WHEN ed > ba THEN 'engine after barrier' END,
  CASE WHEN af < coalesce(ba, al) THEN 'arbiter before barrier' END, CASE WHEN rf < al THEN 'repeat check before arbiter' END,
  CASE WHEN la > dn THEN 'event after done' END) AS violations FROM a)"""


@check("t7_barrier_audit", Q.query(_AUDIT, "SELECT doc_id, page_id, violations FROM v WHERE violations <> ''"))
def t7(spark, sf):
    return B.barrier_audit(I.lifecycle(spark, sf))


@check(
    "t8_after_terminal",
    Q.query(
        EVENTS + ", c AS (SELECT doc_id, min(seq) FILTER (WHERE type = 'done') AS closed FROM ev GROUP BY doc_id)",
        "SELECT doc_id, seq, type FROM ev JOIN c USING (doc_id) WHERE closed IS NULL OR seq <= closed",
    ),
)
def t8(spark, sf):
    return B.after_terminal(I.lifecycle(spark, sf), terminal=("done",))[0].select("doc_id", "seq", "type")


@check(
    "t8_unfinished",
    Q.query(EVENTS, "SELECT doc_id FROM ev GROUP BY doc_id HAVING count(*) FILTER (WHERE type = 'done' AND latency_ms > 300) = 0"),
)
def t8_unfinished(spark, sf):
    late = I.lifecycle(spark, sf).withColumn("type", F.when((F.col("type") == "done") & (F.col("latency_ms") <= 300), "delta").otherwise(F.col("type")))
    return B.after_terminal(late, terminal=("done",))[1].select("doc_id")


@check(
    "s6_read_lifecycle",
    Q.query(
        EVENTS,
        """SELECT doc_id, seq, type, CASE WHEN type = 'delta' AND kind = 'thinking' THEN 'output' ELSE kind END AS kind FROM ev
        WHERE NOT (type = 'delta' AND agent = 'm1')""",
    ),
)
def s6(spark, sf):
    """Written as JSON lines without some kinds and agents, and read back."""
    events = I.lifecycle(spark, sf)
    partial = events.withColumn("kind", F.when(F.col("kind") == "output", "output")).withColumn(
        "agent", F.when((F.col("type") == "delta") & (F.col("agent") == "m1"), None).otherwise(F.col("agent"))
    )
    folder = fresh_folder(spark, "events")
    partial.write.json(folder)
    return lifecycle.read_lifecycle(spark, folder).select("doc_id", "seq", "type", "kind")


# The same answers from the streaming jobs, drained over files that Spark writes from the events.


def _stream(spark, sf, events=None):
    from variorum.streaming import live

    live.use_rocksdb(spark)
    ship_package(spark)
    folder = fresh_folder(spark, "events")
    events = I.lifecycle(spark, sf) if events is None else events
    events.write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(folder)
    return lifecycle.read_lifecycle(spark, folder, streaming=True)


def _drain(spark, stream, mode="update"):
    from variorum.streaming import live

    out = fresh_folder(spark, "drained")
    live.run_once(stream, out, fresh_folder(spark, "checkpoint"), mode)
    return spark.read.parquet(out)


@check("t1_stream_agent_progress", Q.query(STATE, PROGRESS_OUT))
def t1_stream(spark, sf):
    from variorum.streaming import live

    rows = _drain(spark, live.agent_progress(_stream(spark, sf)))
    return B.heartbeat(live.newest(rows, B.AGENT, ["last_seq"]), now()).select(*PROGRESS)


@check(
    "t2_stream_page_stage",
    Q.query(PAGES, "SELECT doc_id, page_id, stage, total_engines, sequence FROM pp"),
)
def t2_stream(spark, sf):
    from variorum.streaming import live

    rows = _drain(spark, B.page_stage(_stream(spark, sf)))
    return live.newest(rows, B.PAGE, ["epoch"]).select("doc_id", "page_id", "stage", "total_engines", "sequence")


@check(
    "t3_stream_latest",
    Q.query(EVENTS, "SELECT doc_id, max(seq) AS sequence, arg_max(type, seq) AS type, arg_max(stage, seq) AS stage FROM ev GROUP BY doc_id"),
)
def t3_stream(spark, sf):
    from variorum.streaming import live

    snapshots = _stream(spark, sf).select("doc_id", F.col("seq").alias("sequence"), "type", "stage")
    told = _drain(spark, live.latest_progress(snapshots, ends=F.col("type") == "done"))
    return live.newest(told, ["doc_id"], ["sequence"]).drop("epoch", "batch")


@check("t4_stream_idle", SQL["t4_idle_attempts"])
def t4_stream(spark, sf):
    from variorum.streaming import live

    waits = _drain(spark, live.idle_attempts(_stream(spark, sf), timeout=36000))
    return live.settled_idle(waits, now()).withColumn("idle_at", F.date_format("idle_at", "yyyy-MM-dd HH:mm:ss"))


@check("t7_stream_barrier_audit", Q.query(_AUDIT, "SELECT doc_id, page_id, violations FROM v WHERE violations <> ''"))
def t7_stream(spark, sf):
    from variorum.streaming import live

    rows = _drain(spark, live.barrier_audit(_stream(spark, sf)))
    return live.newest(rows, B.PAGE, ["epoch"]).filter("violations <> ''").select("doc_id", "page_id", "violations")


@check(
    "t8_stream_after_terminal",
    Q.query(
        EVENTS + ", c AS (SELECT doc_id, min(seq) FILTER (WHERE type = 'done') AS closed FROM ev GROUP BY doc_id)",
        "SELECT doc_id, seq, type FROM ev JOIN c USING (doc_id) WHERE closed IS NULL OR seq <= closed",
    ),
)
def t8_stream(spark, sf):
    from variorum.streaming import live

    gate = live.after_terminal(_stream(spark, sf), terminal=("done",))
    return _drain(spark, gate, "append").select("doc_id", "seq", "type")


@check("t2_stream_closed", SQL["t2_closed_pages"])
def t2_stream_closed(spark, sf):
    """Page snapshots from the stream alone: complete pages stand still, running ones are read off at ``now``."""
    from variorum.streaming import live

    rows = _drain(spark, live.page_progress(_stream(spark, sf, _closing(spark, sf))))
    pages = live.newest(rows, B.PAGE, ["epoch"])
    end = F.coalesce("finished_at", now())
    elapsed = F.floor((F.unix_micros(end) - F.unix_micros("started_at")) / 1000).cast("long")
    return pages.withColumn("elapsed_ms", elapsed).select(*SNAPSHOT)


@check("t4_stream_idle_reports", SQL["t4_idle_attempts"])
def t4_stream_reports(spark, sf):
    """Timers tell idle attempts; a clock row stands for the time that passes after the last event."""
    from variorum.streaming import live

    events = I.lifecycle(spark, sf)
    clock = spark.range(1).select(
        *[F.lit(live.CLOCK if f.name == "type" else now() if f.name == "ts" else 0 if f.name == "seq" else None).cast(f.dataType).alias(f.name) for f in events.schema]
    )
    told = _drain(spark, live.idle_reports(_stream(spark, sf, events.unionByName(clock)), timeout=36000), "append")
    return told.select(
        *B.AGENT, F.col("attempt_no").alias("epoch"), F.date_format("idle_at", "yyyy-MM-dd HH:mm:ss").alias("idle_at")
    )


@check("t9_stream_beat", Q.query(STATE, PROGRESS_OUT + " WHERE finished_at IS NULL"))
def t9_stream(spark, sf):
    """What a running stream says of its own accord, a second after the last event: every agent still running."""
    import time

    from variorum.streaming import live

    out = fresh_folder(spark, "beats")
    query = live.run_live(live.agent_progress(_stream(spark, sf), beat=True), out, fresh_folder(spark, "checkpoint"))
    try:
        while query.isActive and sum(p.numInputRows == 0 and p.batchId > 0 for p in query.recentProgress) < 2:
            time.sleep(0.5)
    finally:
        query.stop()
    if query.exception():
        raise query.exception()
    beats = spark.read.parquet(out).filter("observed_at IS NOT NULL")
    return B.heartbeat(live.newest(beats, B.AGENT, ["observed_at"]), now()).select(*PROGRESS)
