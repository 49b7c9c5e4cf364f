"""Structured Streaming jobs over lifecycle events.

Rows of one key are put in ``seq`` order inside each micro-batch. A row whose ``seq`` its key has seen is
a repeat and is dropped. One below the newest ``seq`` that was never seen is late: what it would have
changed is told already, so it does not count, and comes out as JSON in the column ``late_event`` of a row
of its own. ``run_once`` writes these rows to a folder beside the others and returns their number.

State of a key is a fixed set of small values and the seen ``seq`` as runs, whose number is that of the gaps. The
newest runs stand beside the values, so that a key costs one read and one write a micro-batch; older ones
are only read when a row is below those. Texts are kept as counters and bounded tails, never whole. With ``expire`` idle state is dropped after
``STATE_HOURS``; that needs the processing clock, which never lets a run over "what is there" end,
so drained runs leave it out.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from variorum.functions import text as T
from variorum.session import ship_package
from variorum.streaming import batch as B

STATE_HOURS = 24
HEARTBEAT_MS = 1000
TAIL = 2000
PACKED = 256
LATE = "late_event"
CLOCK = "clock"
ENDS = "ends__"  # rows come to a processor through names that may not begin with an underscore

_STATE = (
    "last_seq long, status string, started_at long, first_token_at long, first_output_at long, finished_at long, "
    "output_chars long, closed_tokens long, open_run long, output string, thinking string, error string, "
    "last_error string, attempt int, max_attempts int"
)
_COLUMNS = [part.split()[0] for part in _STATE.split(", ")]
_OUTPUT = (
    "doc_id string, page_id string, stage string, agent string, last_seq long, status string, started_at long, "
    "first_token_at long, first_output_at long, finished_at long, output_chars long, tokens long, output string, "
    "thinking string, error string, last_error string, attempt int, max_attempts int, observed_at long, late_event string"
)
_IDLE = (
    "doc_id string, page_id string, stage string, agent string, attempt_no long, idle_at long, seq long, "
    "open boolean, late_event string"
)
IDLE_COLUMNS = [part.split()[0] for part in _IDLE.split(", ")]
_PAGE = (
    "stage string, total_engines long, sequence long, started_at long, finished_at long, status string, "
    "error string, completed_engines long"
)
PAGE_COLUMNS = [part.split()[0] for part in _PAGE.split(", ")]


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state with several values needs the RocksDB store; its changelog makes recovery cheap."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def _fresh(at: int) -> dict:
    return {
        "last_seq": -1, "status": "waiting", "started_at": at, "first_token_at": None, "first_output_at": None,
        "finished_at": None, "output_chars": 0, "closed_tokens": 0, "open_run": 0, "output": "", "thinking": "",
        "error": "", "last_error": "", "attempt": 0, "max_attempts": 0,
    }


def _apply(s: dict, e: dict) -> None:
    """Fold one event into the state of its agent."""
    kind = e["type"]
    if kind == "agent_start":
        s["status"] = "waiting"
        s["max_attempts"] = e["max_attempts"]
    elif kind == "attempt_start":
        kept = s["error"] or s["last_error"]
        s.update(_fresh(e["at"]), last_error=kept, attempt=e["attempt"], max_attempts=e["max_attempts"])
    elif kind == "delta":
        if s["first_token_at"] is None:
            s["first_token_at"] = e["at"]
        if e["kind"] == "thinking":
            s["status"] = "thinking"
            s["thinking"] = (s["thinking"] + e["text"])[-TAIL:]
        else:
            s["status"] = "streaming"
            if s["first_output_at"] is None:
                s["first_output_at"] = e["at"]
            s["output_chars"] += len(e["text"])
            run = s["open_run"] + e["lead"]
            if e["whole"]:
                s["open_run"] = run
            else:
                s["closed_tokens"] += (run + 3) // 4 + e["inner"]
                s["open_run"] = e["trail"]
            s["output"] = (s["output"] + e["text"])[-TAIL:]
    elif kind == "attempt_failed":
        again = e["attempt"] < e["max_attempts"]
        s.update(
            status="retrying" if again else "failed", error="" if again else e["error"], last_error=e["error"],
            finished_at=e["at"], attempt=e["attempt"], max_attempts=e["max_attempts"],
        )
    elif kind == "agent_done":
        s.update(status="failed" if e["error"] else "completed", error=e["error"], finished_at=e["at"])


def _ordered(parts: Iterator[Row | pd.DataFrame]) -> list[dict]:
    events = []
    for part in parts:
        events.extend([part.asDict()] if isinstance(part, Row) else part.to_dict("records"))
    return sorted(events, key=lambda event: event["seq"])


class _Seen:
    """The ``seq`` that a key has seen, as runs from start to end: state grows with the gaps, not with the rows.

    A call to the state store costs more than the work on a row. So the newest ``packed`` runs of a key stand in one
    value, beside the ``own`` values of its processor; older runs have a map entry each, which is only read for a row
    below those of the value. Without ``packed`` all runs are in the map and the newest one in the value too.
    """

    def __init__(self, handle: StatefulProcessorHandle, ttl: int | None, packed: int = 0, own: str = ""):
        self.runs = handle.getMapState("runs", "start long", "end long", ttl)
        kept = "start long, end long, starts array<long>, ends array<long>"
        self.newest = handle.getValueState("newest", f"{kept}, {own}" if own else kept, ttl)
        self.packed, self.alone = packed, not own

    def load(self) -> tuple | None:
        """The values that the processor kept for this key."""
        value = self.newest.get()
        self.recent, self.mapped = [], {}
        if value is None:
            return None
        start, end, starts, ends, *own = value
        self.recent = [*zip(starts, ends), (start, end)]
        if not self.packed:
            self.mapped[start] = end
        return tuple(own)

    def take(self, parts: Iterator[Row | pd.DataFrame]) -> tuple[list[dict], list[dict]]:
        """Rows above the newest ``seq`` in order, and those below it that were never seen; no repeats.

        With ``own`` values the caller has to ``load`` before it, and to ``keep`` after it if there are any rows.
        """
        if self.alone:
            self.load()
        runs = self.recent
        known, whole = runs[-1][1] if runs else None, False
        fresh, late = [], []
        for event in _ordered(parts):
            seq = int(event["seq"])
            if not runs or seq > runs[-1][1]:
                if runs and seq == runs[-1][1] + 1:
                    runs[-1] = (runs[-1][0], seq)
                else:
                    runs.append((seq, seq))
                fresh.append(event)
            elif known is not None and seq <= known:
                # Rows come in order, so the map is read before any run has changed.
                if not whole and seq < runs[0][0]:
                    whole = True
                    self.mapped = {k[0]: v[0] for k, v in self.runs.iterator()}
                    runs[:] = sorted((self.mapped | dict(runs)).items())
                at = bisect_right(runs, (seq, runs[-1][1]))
                if at and runs[at - 1][1] >= seq:
                    continue
                low = high = seq
                if at and runs[at - 1][1] == seq - 1:
                    at -= 1
                    low = runs.pop(at)[0]
                if at < len(runs) and runs[at][0] == seq + 1:
                    high = runs.pop(at)[1]
                runs.insert(at, (low, high))
                late.append(event)
        if self.alone and (fresh or late):
            self.keep()
        return fresh, late

    def keep(self, *own) -> None:
        """Write the runs, and the processor's values beside them."""
        split = max(0, len(self.recent) - self.packed)
        older, packed = dict(self.recent[:split]), self.recent[split:-1]
        for low in self.mapped.keys() - older.keys():
            self.runs.removeKey((low,))
        for low, high in older.items():
            if self.mapped.get(low) != high:
                self.runs.updateValue((low,), (high,))
        self.newest.update((*self.recent[-1], [low for low, _ in packed], [high for _, high in packed], *own))

    def clear(self) -> None:
        self.runs.clear()
        self.newest.clear()


def _late_rows(keys: Sequence[str], key, late: list[dict]) -> Iterator[Row]:
    told = dict(zip(keys, key))
    for event in late:
        yield Row(**told, **{LATE: json.dumps({**told, **event}, default=_as_text)})


def _as_text(value) -> str:
    return str(value.replace(tzinfo=None) if hasattr(value, "tzinfo") else value)


def _move_timer(handle: StatefulProcessorHandle, standing: int | None, at: int | None) -> int | None:
    """Leave the key one timer, or none; a processor keeps the time of its timer, so that none are listed."""
    if standing != at:
        if standing is not None:
            handle.deleteTimer(standing)
        if at is not None:
            handle.registerTimer(at)
    return at


class AgentFold(StatefulProcessor):
    """State machine of one agent. With processing time, a running agent is reported every second."""

    def __init__(self, beat: bool = False, expire: bool = False):
        self.beat = beat
        self.ttl = STATE_HOURS * 3_600_000 if expire else None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = _Seen(handle, self.ttl, PACKED, f"{_STATE}, timer long")

    def _row(self, key, s: dict, observed: int | None) -> Row:
        told = {c: s[c] for c in _COLUMNS if c not in ("closed_tokens", "open_run")}
        told["tokens"] = s["closed_tokens"] + (s["open_run"] + 3) // 4
        return Row(**dict(zip(B.AGENT, key)), **told, observed_at=observed)

    def _keep(self, s: dict, timer: int | None, timers) -> None:
        if self.beat:
            running = s["finished_at"] is None
            at = timers.getCurrentProcessingTimeInMs() + HEARTBEAT_MS if running else None
            timer = _move_timer(self.handle, timer, at)
        self.seen.keep(*(s[c] for c in _COLUMNS), timer)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.seen.load()
        s, timer = (dict(zip(_COLUMNS, known)), known[-1]) if known is not None else (None, None)
        fresh, late = self.seen.take(rows)
        for event in fresh:
            if s is None:
                s = _fresh(event["at"])
            _apply(s, event)
            s["last_seq"] = int(event["seq"])
        yield from _late_rows(B.AGENT, key, late)
        if fresh:
            self._keep(s, timer, timerValues)
            yield self._row(key, s, None)
        elif late:
            self.seen.keep(*known)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known = self.seen.load()
        if known is None:
            return
        s = dict(zip(_COLUMNS, known))
        self._keep(s, None, timerValues)
        yield self._row(key, s, timerValues.getCurrentProcessingTimeInMs() * 1000)

    def close(self) -> None:
        pass


def _clock(needed: bool) -> str:
    return "ProcessingTime" if needed else "None"


def agent_progress(events: DataFrame, beat: bool = False, expire: bool = False) -> DataFrame:
    """Newest state per agent and micro-batch, in the columns of the batch twin's state.

    ``beat`` adds a row per second for every agent still running, stamped ``observed_at``.
    """
    ship_package(events.sparkSession)
    mine = (
        events.filter(F.col("type").isin(*B.AGENT_EVENTS))
        .withColumn("at", F.unix_micros("ts"))
        .withColumn("parts", T.token_parts("text"))
    )
    folded = (
        mine.select(*B.AGENT, "seq", "at", "type", "kind", "text", "attempt", "max_attempts", "error", "parts.*")
        .groupBy(*B.AGENT)
        .transformWithState(
            AgentFold(beat, expire), outputStructType=_OUTPUT, outputMode="Update", timeMode=_clock(beat or expire)
        )
    )
    times = ("started_at", "first_token_at", "first_output_at", "finished_at", "observed_at")
    return folded.withColumns({c: F.timestamp_micros(c) for c in times})


class TerminalGate(StatefulProcessor):
    """Passes the rows of a key up to its first terminal event and nothing after."""

    def __init__(self, columns: Sequence[str], keys: Sequence[str], terminal: Sequence[str], expire: bool = False):
        self.columns, self.keys, self.terminal = list(columns), list(keys), tuple(terminal)
        self.ttl = STATE_HOURS * 3_600_000 if expire else None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = _Seen(handle, self.ttl, PACKED, "closed_at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.seen.load()
        closed = known[0] if known is not None else None
        fresh, late = self.seen.take(row for row in rows if closed is None or row["seq"] < closed)
        if not fresh and not late:
            return
        ends = [int(e["seq"]) for e in (*late, *fresh) if e["type"] in self.terminal]
        if ends:
            closed = min(ends)
        self.seen.keep(closed)
        passed = [e for e in fresh if closed is None or e["seq"] <= closed]
        late = [e for e in late if closed is None or e["seq"] <= closed]
        for event in passed:
            yield Row(**{c: event[c] for c in self.columns})
        for event, told in zip(late, _late_rows(self.keys, key, late)):
            yield Row(**{c: event[c] for c in self.columns}, **{LATE: told[LATE]})

    def close(self) -> None:
        pass


def after_terminal(
    events: DataFrame, keys: Sequence[str] = B.PAGE, terminal: Sequence[str] = B.TERMINAL, expire: bool = False
) -> DataFrame:
    """Events up to each key's first terminal one, and late ones marked; a late terminal one closes its key too. With ``expire`` a key is forgotten after STATE_HOURS without
    an event, so that repeats later than that pass again."""
    ship_package(events.sparkSession)
    return events.groupBy(*keys).transformWithState(
        TerminalGate(events.columns, keys, terminal, expire),
        outputStructType=S.StructType([*events.schema.fields, S.StructField(LATE, S.StringType())]),
        outputMode="Append",
        timeMode=_clock(expire),
    )


class IdleWatch(StatefulProcessor):
    """Waits of one agent: those an event ended after the timeout, and the one still open.

    With ``timed`` an open wait is told when the watermark passes its timeout, by a timer.
    """

    def __init__(self, timeout: int, expire: bool = False, timed: bool = False):
        self.timeout = timeout * 1_000_000
        self.timed = timed
        self.ttl = STATE_HOURS * 3_600_000 if expire else None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = _Seen(handle, self.ttl, PACKED, "last_seq long, epoch long, since long, told long, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.seen.load()
        last, epoch, since, told, timer = known if known is not None else (None, 0, None, -1, None)
        fresh, late = self.seen.take(row for row in rows if row["type"] != CLOCK)
        yield from _late_rows(B.AGENT, key, late)
        if not fresh:
            if late:
                self.seen.keep(*known)
            return
        found = []
        for event in fresh:
            last = int(event["seq"])
            if since is not None and event["at"] - since >= self.timeout and told < epoch:
                told = epoch
                found.append((*key, epoch, since + self.timeout, last, False))
            epoch += event["type"] == "attempt_start"
            since = int(event["at"]) if event["type"] in ("attempt_start", "delta") else None
        open_at = since + self.timeout if since is not None and told < epoch else None
        if self.timed:
            timer = _move_timer(self.handle, timer, None if open_at is None else -(-open_at // 1000))
        else:
            found.append((*key, epoch, open_at, last, True))
        self.seen.keep(last, epoch, since, told, timer)
        yield from self._rows(found)

    def _rows(self, found: list[tuple]) -> Iterator[Row]:
        for values in found:
            yield Row(**dict(zip(IDLE_COLUMNS, values)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        last, epoch, since, told, _ = self.seen.load()
        if since is not None and told < epoch:
            self.seen.keep(last, epoch, since, epoch, None)
            yield from self._rows([(*key, epoch, since + self.timeout, last, False)])

    def close(self) -> None:
        pass


def idle_attempts(events: DataFrame, timeout: int = B.IDLE_SECONDS, expire: bool = False) -> DataFrame:
    """Idle moments per attempt as they become known; ``settled_idle`` makes the batch twin's rows of them.

    A row says that a wait reached the timeout (its attempt's first), or, with ``open``, when the newest
    wait of the agent will if nothing ends it (null: it isn't waiting). There is no
    watermark; within an agent events count in the order of ``seq``, and one that comes in a later micro-batch
    than a newer one does not count but is told as late.
    """
    ship_package(events.sparkSession)
    mine = events.filter(F.col("type").isin(*B.AGENT_EVENTS)).withColumn("at", F.unix_micros("ts"))
    waits = (
        mine.select(*B.AGENT, "seq", "at", "type")
        .groupBy(*B.AGENT)
        .transformWithState(
            IdleWatch(timeout, expire),
            outputStructType=_IDLE,
            outputMode="Update",
            timeMode=_clock(expire),
        )
    )
    return waits.withColumn("idle_at", F.timestamp_micros("idle_at"))


def idle_reports(events: DataFrame, timeout: int = B.IDLE_SECONDS, delay: str = "0 seconds") -> DataFrame:
    """Idle moments per attempt, each once: when an event ends its wait too late, or the watermark passes it.

    The watermark is the newest ``ts`` of any agent less ``delay``; Spark drops (and counts) rows behind it. Rows of
    type ``clock`` only move it, so that time also goes on while no agent says anything.
    """
    ship_package(events.sparkSession)
    timely = events.filter(F.col("type").isin(*B.AGENT_EVENTS, CLOCK)).withWatermark("ts", delay)
    told = (
        timely.select(*B.AGENT, "seq", "ts", F.unix_micros("ts").alias("at"), "type")
        .groupBy(*B.AGENT)
        .transformWithState(
            IdleWatch(timeout, timed=True), outputStructType=_IDLE, outputMode="Append", timeMode="EventTime"
        )
    )
    return told.select(*B.AGENT, "attempt_no", F.timestamp_micros("idle_at").alias("idle_at"), LATE)


class PageFold(StatefulProcessor):
    """Snapshot of one page, with the state of its agents in a map.

    The first terminal event closes the page, also one that comes late: its clock stands still, nothing that
    comes later counts, and all state but the snapshot goes.
    """

    def __init__(self, beat: bool = False, expire: bool = False):
        self.beat = beat
        self.ttl = STATE_HOURS * 3_600_000 if expire else None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.page = handle.getValueState("page", f"{_PAGE}, timer long", self.ttl)
        self.agents = handle.getMapState("agents", "stage string, agent string", _STATE, self.ttl)
        self.seen = _Seen(handle, self.ttl, PACKED)

    def _row(self, key, page: dict, observed: int | None) -> Row:
        return Row(**dict(zip(B.PAGE, key)), **page, observed_at=observed)

    def _keep(self, page: dict, timer: int | None, timers) -> None:
        if self.beat:
            running = page["status"] == "running"
            at = timers.getCurrentProcessingTimeInMs() + HEARTBEAT_MS if running else None
            timer = _move_timer(self.handle, timer, at)
        self.page.update((*(page[c] for c in PAGE_COLUMNS), timer))

    @staticmethod
    def _agent(agents: dict, event: dict) -> tuple:
        name = (event["stage"], event["agent"])
        if name not in agents:
            agents[name] = _fresh(event["at"])
        _apply(agents[name], event)
        agents[name]["last_seq"] = int(event["seq"])
        return name

    @staticmethod
    def _close(page: dict, event: dict) -> None:
        failed = event["type"] == "error"
        page.update(
            stage="complete", status="failed" if failed else "completed", finished_at=int(event["at"]),
            error=event["error"] or "",
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.page.get()
        page, timer = (dict(zip(PAGE_COLUMNS, known)), known[-1]) if known is not None else (None, None)
        if page is not None and page["status"] != "running":
            return
        fresh, late = self.seen.take(rows)
        yield from _late_rows(B.PAGE, key, late)
        ends = [event for event in late if event["type"] in B.TERMINAL]
        if ends:
            self._close(page, ends[0])
            fresh = []
        agents: dict[tuple, dict] = {}
        if page is not None and any(event["type"] in B.AGENT_EVENTS for event in fresh):
            # All agents in one call: what the done ones are is asked at the end anyway.
            agents = {tuple(name): dict(zip(_COLUMNS, s)) for name, s in self.agents.iterator()}
        changed = set()
        for event in fresh:
            if page is None:
                page = dict.fromkeys(PAGE_COLUMNS) | {
                    "stage": "loading", "total_engines": 0, "sequence": 0, "started_at": int(event["at"]),
                    "status": "running", "error": "", "completed_engines": 0,
                }
            page["sequence"] += 1
            page["started_at"] = min(page["started_at"], int(event["at"]))
            kind = event["type"]
            if kind in B.TERMINAL:
                self._close(page, event)
                break
            if kind in ("stage_start", "agent_start", "attempt_start"):
                page["stage"] = event["stage"]
            elif kind == "stage_done" and event["stage"] == "engine":
                page["stage"] = "merge"
            elif kind == "done" or (kind == "agent_done" and event["stage"] in ("arbiter", "duplicate_check")):
                page["stage"] = "saving"
            if kind == "stage_start" and event["stage"] == "engine" and event["total"] > 0:
                page["total_engines"] = int(event["total"])
            if kind in B.AGENT_EVENTS:
                changed.add(self._agent(agents, event))
        if not fresh and not ends:
            return
        if changed:
            page["completed_engines"] = sum(
                stage == "engine" and s["status"] in ("completed", "failed") for (stage, _), s in agents.items()
            )
        if page["status"] != "running":
            self.agents.clear()
            self.seen.clear()
        else:
            for name in changed:
                self.agents.updateValue(name, tuple(agents[name][c] for c in _COLUMNS))
        self._keep(page, timer, timerValues)
        yield self._row(key, page, None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        page = dict(zip(PAGE_COLUMNS, self.page.get()))
        if page["status"] == "running":
            self._keep(page, None, timerValues)
            yield self._row(key, page, timerValues.getCurrentProcessingTimeInMs() * 1000)

    def close(self) -> None:
        pass


def page_progress(events: DataFrame, beat: bool = False, expire: bool = False) -> DataFrame:
    """Newest snapshot per page and micro-batch: stage, status, error, engines done and in total, times.

    ``finished_at`` is null while a page runs. ``beat`` adds a row per second for every running page, stamped
    ``observed_at``; with ``expire`` a page is forgotten after STATE_HOURS without an event.
    """
    ship_package(events.sparkSession)
    timed = events.withColumn("at", F.unix_micros("ts")).withColumn("parts", T.token_parts("text"))
    columns = (*B.AGENT, "seq", "at", "type", "kind", "text", "total", "attempt", "max_attempts", "error", "parts.*")
    folded = (
        timed.select(*columns)
        .groupBy(*B.PAGE)
        .transformWithState(
            PageFold(beat, expire),
            outputStructType=f"doc_id string, page_id string, {_PAGE}, observed_at long, {LATE} string",
            outputMode="Update",
            timeMode=_clock(beat or expire),
        )
    )
    return folded.withColumns({c: F.timestamp_micros(c) for c in ("started_at", "finished_at", "observed_at")})


def settled_idle(waits: DataFrame, now: Column) -> DataFrame:
    """Per attempt the first idle moment up to ``now``, from all rows that ``idle_attempts`` gave."""
    newest_wait = (
        waits.filter("open").groupBy(*B.AGENT).agg(F.max_by(F.struct("attempt_no", "idle_at"), "seq").alias("last"))
    ).select(*B.AGENT, "last.attempt_no", "last.idle_at")
    over = waits.filter("NOT open").select(*B.AGENT, "attempt_no", "idle_at")
    every = over.unionByName(newest_wait.filter(F.col("idle_at") <= now))
    return every.groupBy(*B.AGENT, F.col("attempt_no").alias("epoch")).agg(F.min("idle_at").alias("idle_at"))


class NewestFold(StatefulProcessor):
    """Passes a key's newest row on; of a key the state is one number, and nothing once its newest row ends it."""

    def __init__(self, columns: Sequence[str], order: str, expire: bool = False):
        self.columns, self.order = list(columns), order
        self.ttl = STATE_HOURS * 3_600_000 if expire else None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at long", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat([part for part in rows if len(part)], ignore_index=True)
        best = frame.loc[[frame[self.order].idxmax()]]
        at = int(best[self.order].iloc[0])
        if self.last.exists() and self.last.get()[0] >= at:
            return
        if best[ENDS].iloc[0]:
            self.last.clear()
        else:
            self.last.update((at,))
        yield best[self.columns]

    def close(self) -> None:
        pass


def latest_progress(
    snapshots: DataFrame, order: str = "sequence", ends: Column | None = None, expire: bool = False
) -> DataFrame:
    """Snapshots that are newer than all before of their document, at most one per document and micro-batch.

    A row for which ``ends`` holds takes the document's state away with it: should an older snapshot follow, it is
    passed on, and loses against the newer one by ``order``. Rows without an order are left out.
    """
    ship_package(snapshots.sparkSession)
    marked = snapshots.filter(F.col(order).isNotNull()).withColumn(
        ENDS, F.coalesce(F.lit(False) if ends is None else ends, F.lit(False))
    )
    return marked.groupBy("doc_id").transformWithStateInPandas(
        NewestFold(snapshots.columns, order, expire),
        outputStructType=snapshots.schema, outputMode="Update", timeMode=_clock(expire),
    )


_ORDER = ("engine_done", "barrier", "arbiter_first", "arbiter_last", "repeat_first", "done", "last")


class AuditFold(StatefulProcessor):
    """First and last places of what matters for the order of one page; a terminal event ends the page's state."""

    def __init__(self, expire: bool = False):
        self.ttl = STATE_HOURS * 3_600_000 if expire else None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("order", ", ".join(f"{c} long" for c in _ORDER) + ", told string", self.ttl)

    @staticmethod
    def _broken(s: dict) -> str:
        def before(one: int | None, two: int | None) -> bool:
            return one is not None and two is not None and one < two

        barrier = s["barrier"] if s["barrier"] is not None else s["arbiter_last"]
        rules = [
            (before(s["barrier"], s["engine_done"]), "engine after barrier"),
            (before(s["arbiter_first"], barrier), "arbiter before barrier"),
            (before(s["repeat_first"], s["arbiter_last"]), "repeat check before arbiter"),
            (before(s["done"], s["last"]), "event after done"),
        ]
        return "|".join(text for broken, text in rules if broken)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.state.get() if self.state.exists() else (*[None] * len(_ORDER), "")
        s, told = dict(zip(_ORDER, known)), known[-1]

        def first(name: str, seqs: pd.Series) -> None:
            if len(seqs):
                s[name] = int(min(seqs.min(), seqs.max() if s[name] is None else s[name]))

        def last(name: str, seqs: pd.Series) -> None:
            if len(seqs):
                s[name] = int(max(seqs.max(), seqs.min() if s[name] is None else s[name]))

        ended = False
        for part in rows:
            seq, kind, stage = part["seq"], part["type"], part["stage"]
            last("engine_done", seq[(stage == "engine") & (kind == "agent_done")])
            last("barrier", seq[(stage == "engine") & (kind == "stage_done")])
            first("arbiter_first", seq[stage == "arbiter"])
            last("arbiter_last", seq[stage == "arbiter"])
            first("repeat_first", seq[stage == "duplicate_check"])
            first("done", seq[kind == "done"])
            last("last", seq)
            ended |= bool(kind.isin(B.TERMINAL).any())
        now = self._broken(s)
        if ended:
            self.state.clear()
        else:
            self.state.update((*[s[c] for c in _ORDER], now))
        if now != told:
            yield pd.DataFrame([(*key, now)], columns=[*B.PAGE, "violations"])

    def close(self) -> None:
        pass


def barrier_audit(events: DataFrame, expire: bool = False) -> DataFrame:
    """What breaks the order of a page, told whenever it changes (empty: nothing any more). The page's state goes with
    its terminal event, or with ``expire`` after STATE_HOURS without one."""
    ship_package(events.sparkSession)
    return events.select(*B.PAGE, "seq", "type", "stage").groupBy(*B.PAGE).transformWithStateInPandas(
        AuditFold(expire),
        outputStructType="doc_id string, page_id string, violations string", outputMode="Update", timeMode=_clock(expire),
    )


def _writer(path: str, count) -> Callable[[DataFrame, int], None]:
    """Writes each micro-batch to Parquet files of ``path`` and its late events beside it; safe to repeat."""

    def write(part: DataFrame, epoch: int) -> None:
        rows = part.withColumn("epoch", F.lit(epoch))
        if LATE not in part.columns:
            rows.write.mode("overwrite").parquet(f"{path}/batch={epoch}")
            return
        rows.persist()
        rows.filter(F.col(LATE).isNull()).drop(LATE).write.mode("overwrite").parquet(f"{path}/batch={epoch}")
        aside = rows.filter(F.col(LATE).isNotNull()).select(LATE, "epoch")
        aside.write.mode("overwrite").parquet(f"{path}-late/batch={epoch}")
        count(aside.count())
        rows.unpersist()

    return write


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "update") -> int:
    """Drain what is there into Parquet files of ``path``, one set per micro-batch, safe to repeat.

    Late events go to ``path`` + "-late" in the same way; their number in this run is returned.
    """
    late = []
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(_writer(path, late.append))
        .start()
    )
    query.awaitTermination()
    return sum(late)


def run_live(stream: DataFrame, path: str, checkpoint: str, mode: str = "update", every: str = "1 second") -> StreamingQuery:
    """As ``run_once``, but running until it is stopped; timers also fire where no rows come."""
    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=every)
        .foreachBatch(_writer(path, lambda n: None))
        .start()
    )


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last reported row per key of a drained update stream."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")
