"""Processors over several micro-batches: seen numbers, closing, clean-up, idle timers and the beat of a running stream."""

import json
import random
import time
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import Row

from variorum import schemas
from variorum.sources.lifecycle import usable
from variorum.streaming import batch as B
from variorum.streaming import live

KEY = {"doc_id": "d", "page_id": "p", "stage": "engine", "agent": "m1"}


def event(seq, kind="delta", **more):
    at = f"2024-01-01T00:{seq // 60:02d}:{seq % 60:02d}.000Z"
    return KEY | {"seq": seq, "ts": at, "type": kind, "text": "x" if kind == "delta" else ""} | more


class Runs(dict):
    updateValue = dict.__setitem__
    removeKey = dict.__delitem__

    def iterator(self):
        return iter(self.items())


class Value:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def seen_numbers():
    runs = Runs()
    handle = SimpleNamespace(getMapState=lambda *a: runs, getValueState=lambda *a: Value())
    return live._Seen(handle, None), runs


@pytest.mark.parametrize("seed", range(20))
def test_seen_numbers_equal_a_set(seed):
    rng = random.Random(seed)
    seen, runs = seen_numbers()
    known, newest = set(), -1
    for _ in range(30):
        batch = [rng.randrange(60) for _ in range(rng.randrange(1, 8))]
        fresh, late = seen.take(iter([pd.DataFrame({"seq": batch})]))
        assert [e["seq"] for e in fresh] == sorted({n for n in batch if n > newest})
        assert [e["seq"] for e in late] == sorted({n for n in batch if n < newest} - known)
        known |= set(batch)
        newest = max(newest, *batch)
        assert sum(high - low + 1 for (low,), (high,) in runs.items()) == len(known)
        assert len(runs) == sum(n - 1 not in known for n in known)


def test_a_million_events_in_order_are_one_run():
    seen, runs = seen_numbers()
    for start in range(0, 1_000_000, 250_000):
        fresh, late = seen.take(iter([pd.DataFrame({"seq": range(start, start + 250_000)})]))
        assert (len(fresh), late) == (250_000, [])
    assert runs == {(0,): (999_999,)}


def fed(spark, folder, make, batches, mode="update"):
    """Late events of each drained micro-batch, and all rows."""
    live.use_rocksdb(spark)
    inbox, out = folder / "inbox", str(folder / "out")
    inbox.mkdir()
    counts = []
    for k, rows in enumerate(batches):
        (inbox / f"{k}.json").write_text("\n".join(map(json.dumps, rows)))
        stream = usable(spark.readStream.schema(schemas.EVENT).json(str(inbox)))
        counts.append(live.run_once(make(stream), out, str(folder / "checkpoint"), mode))
    return counts, spark.read.parquet(out)


def state_rows(spark, folder, name):
    return spark.read.format("statestore").option("stateVarName", name).load(str(folder / "checkpoint")).count()


def test_late_terminal_event_closes_the_gate(spark, tmp_path):
    batches = [[event(1), event(4)], [event(3, "done"), event(5)], [event(6), event(2)]]
    counts, rows = fed(spark, tmp_path, lambda e: live.after_terminal(e, terminal=("done",)), batches, "append")
    assert counts == [0, 1, 1]
    assert sorted(r.seq for r in rows.collect()) == [1, 4]


def test_page_snapshots_until_the_end(spark, tmp_path):
    start = [event(1, "stage_start", agent="", total=2), event(2, "attempt_start", attempt=1, max_attempts=1), event(3)]
    batches = [
        start,
        [event(5, "agent_done"), event(6, "agent_done", agent="m2", error="broke"), event(7, "stage_done", agent="")],
        [event(4, "error", error="out of paper")],
        [event(9), event(10, "result"), event(3)],
    ]
    counts, rows = fed(spark, tmp_path, live.page_progress, batches)
    assert counts == [0, 0, 1, 0]
    told = [(r.stage, r.status, r.error, r.total_engines, r.completed_engines, r.sequence) for r in rows.orderBy("epoch").collect()]
    assert told == [
        ("engine", "running", "", 2, 0, 3),
        ("merge", "running", "", 2, 2, 6),
        ("complete", "failed", "out of paper", 2, 2, 6),
    ]
    assert rows.filter("finished_at IS NOT NULL").first().finished_at.second == 4
    assert state_rows(spark, tmp_path, "agents") == 0
    assert state_rows(spark, tmp_path, "runs") == 0
    assert state_rows(spark, tmp_path, "page") == 1


def test_newest_snapshots_give_their_state_back(spark, tmp_path):
    def make(events):
        return live.latest_progress(events.select("doc_id", "seq", "type"), "seq", events.type == "done")

    batches = [[event(2), event(5), event(1, doc_id="other")], [event(4)], [event(6, "done")]]
    _, rows = fed(spark, tmp_path, make, batches)
    assert sorted((r.doc_id, r.seq) for r in rows.collect()) == [("d", 5), ("d", 6), ("other", 1)]
    assert state_rows(spark, tmp_path, "last") == 1


def test_audit_follows_changes_and_ends(spark, tmp_path):
    batches = [
        [event(2, "stage_done", agent=""), event(3, "agent_done")],
        [event(4, "stage_done", agent=""), event(5, "done", stage="", agent=""), event(1, "delta", page_id="q")],
        [event(6)],
        [event(7, "result", stage="", agent="")],
    ]
    _, rows = fed(spark, tmp_path, live.barrier_audit, batches)
    told = [r.violations for r in rows.filter("page_id = 'p'").orderBy("epoch").collect()]
    assert told == ["engine after barrier", "", "event after done"]
    assert state_rows(spark, tmp_path, "order") == 1


def test_idle_is_told_by_timers_once(spark, tmp_path):
    clock = [event(0, live.CLOCK, stage="", agent="", ts="2024-01-01T00:05:00.000Z")]
    batches = [[event(1, "attempt_start"), event(2)], clock, [event(360)], clock]
    _, rows = fed(spark, tmp_path, lambda e: live.idle_reports(e, timeout=60), batches, "append")
    assert [(r.attempt_no, r.idle_at.minute, r.idle_at.second) for r in rows.collect()] == [(1, 1, 2)]


@pytest.mark.parametrize("make", [live.agent_progress, live.page_progress])
def test_beat_of_a_running_stream(spark, tmp_path, make):
    live.use_rocksdb(spark)
    inbox, out = tmp_path / "inbox", str(tmp_path / "out")
    inbox.mkdir()
    (inbox / "0.json").write_text("\n".join(map(json.dumps, [event(1, "attempt_start"), event(2)])))
    stream = usable(spark.readStream.schema(schemas.EVENT).json(str(inbox)))
    query = live.run_live(make(stream, beat=True), out, str(tmp_path / "checkpoint"), every="200 milliseconds")

    def rows():
        try:
            return spark.read.parquet(out).orderBy("epoch").collect()
        except Exception as missing:  # nothing is written yet
            assert "PATH_NOT_FOUND" in str(missing) or "UNABLE_TO_INFER_SCHEMA" in str(missing) or query.isActive
            return []

    def wait(enough):
        end = time.time() + 60
        while time.time() < end and not enough(rows()):
            time.sleep(0.5)

    try:
        wait(lambda told: sum(r.observed_at is not None for r in told) >= 3)
        (inbox / "1.json").write_text("\n".join(map(json.dumps, [event(3, "agent_done"), event(4, "result", stage="", agent="")])))
        wait(lambda told: any(r.finished_at is not None for r in told))
        time.sleep(4)
    finally:
        query.stop()
    told = rows()
    beats = [r.observed_at for r in told if r.observed_at is not None]
    assert len(beats) >= 3
    assert all((b - a).total_seconds() >= 1 for a, b in zip(beats, beats[1:]))
    assert told[-1].finished_at is not None and told[-1].observed_at is None


class Counted(Value):
    def __init__(self):
        super().__init__()
        self.calls = 0

    def get(self):
        self.calls += 1
        return super().get()

    def update(self, value):
        self.calls += 1
        super().update(value)


@pytest.mark.parametrize("seed", range(20))
def test_packed_numbers_equal_a_set(seed):
    rng = random.Random(seed)
    runs, value = Runs(), Counted()
    handle = SimpleNamespace(getMapState=lambda *a: runs, getValueState=lambda *a: value)
    seen = live._Seen(handle, None, packed=4, own="count long")
    known, newest = set(), -1
    for _ in range(30):
        batch = [rng.randrange(newest + 1 if rng.random() < 0.5 else 0, newest + 40) for _ in range(rng.randrange(1, 8))]
        assert (seen.load() or (0,))[0] == len(known)
        fresh, late = seen.take(iter([pd.DataFrame({"seq": batch})]))
        assert [e["seq"] for e in fresh] == sorted({n for n in batch if n > newest})
        assert [e["seq"] for e in late] == sorted({n for n in batch if n < newest} - known)
        known |= set(batch)
        newest = max(newest, *batch)
        if fresh or late:
            seen.keep(len(known))
        start, end, starts, ends, _ = value.value
        whole = [*((low, high) for (low,), (high,) in runs.items()), *zip(starts, ends), (start, end)]
        assert len(starts) < 4
        assert sum(high - low + 1 for low, high in whole) == len(known)
        assert len(set(whole)) == len(whole) == sum(n - 1 not in known for n in known)


def test_a_key_costs_two_calls_a_batch():
    """A map entry a gap was a call to the state store a row."""
    value = Counted()
    handle = SimpleNamespace(getMapState=lambda *a: None, getValueState=lambda *a: value)
    gate = live.TerminalGate(["seq", "type"], ["doc_id"], ("done",))
    gate.init(handle)
    for k in range(3):
        rows = [Row(seq=100 * k + 3 * n, type="delta") for n in range(20)]
        assert len(list(gate.handleInputRows(("d",), iter(rows), None))) == 20
        assert value.calls == 2 * (k + 1)
