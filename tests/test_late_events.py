"""Events that come a micro-batch late are set aside and counted; repeats are not."""

import json

import pytest

from variorum import schemas
from variorum.sources.lifecycle import usable
from variorum.streaming import batch as B
from variorum.streaming import live

KEY = {"doc_id": "d", "page_id": "p", "stage": "read", "agent": "m1"}


def event(seq, kind="delta", **more):
    return KEY | {"seq": seq, "ts": f"2024-01-01T00:00:{seq:02d}.000Z", "type": kind, "text": "x" if kind == "delta" else ""} | more


#: In the second micro-batch 3 is late and 2 a repeat; in the third 3 is a repeat, 5 late, 9 newest (past a terminal event).
BATCHES = [
    [event(1, "attempt_start", attempt=1, max_attempts=1), event(2), event(4)],
    [event(3), event(2), event(6), event(7, "done")],
    [event(3), event(5), event(9)],
]
JOBS = {
    "progress": (lambda e: live.agent_progress(e), "update"),
    "idle": (lambda e: live.idle_attempts(e, timeout=3600), "update"),
    "gate": (lambda e: live.after_terminal(e, keys=B.PAGE, terminal=("done",)), "append"),
}


@pytest.mark.parametrize("job", JOBS)
def test_late_events_are_set_aside(spark, tmp_path, job):
    live.use_rocksdb(spark)
    make, mode = JOBS[job]
    inbox, out = tmp_path / "inbox", str(tmp_path / "out")
    inbox.mkdir()
    counts = []
    for k, rows in enumerate(BATCHES):
        (inbox / f"{k}.json").write_text("\n".join(map(json.dumps, rows)))
        stream = usable(spark.readStream.schema(schemas.EVENT).json(str(inbox)))
        counts.append(live.run_once(make(stream), out, str(tmp_path / "checkpoint"), mode))
    assert counts == [0, 1, 1]
    late = [json.loads(r.late_event) for r in spark.read.parquet(f"{out}-late").collect()]
    assert sorted((e["doc_id"], e["page_id"], e["seq"]) for e in late) == [("d", "p", 3), ("d", "p", 5)]
    rows = spark.read.parquet(out)
    assert live.LATE not in rows.columns
    if job == "gate":
        assert sorted(r.seq for r in rows.collect()) == [1, 2, 4, 6, 7]
    if job == "progress":
        assert live.newest(rows, B.AGENT, ["last_seq"]).first().output_chars == 4
