"""Small known cases: what goes in is a few readings, what must come out is spelled out."""

import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from checks import inputs
from variorum.functions import text as T
from variorum.operators import assemble, dedupe, documents, resolve, similar, votes
from variorum.plans.fuse import fuse
from variorum.sources import exports, files, lifecycle, responses, results
from variorum.streaming import batch as B
from variorum.streaming import live

NAME = "arbiter"


def readings(spark, **texts):
    rows = [(1, agent, text, 1, "") for agent, text in texts.items()]
    return spark.createDataFrame(rows, "page_id long, agent string, text string, latency_ms long, err string")


def rows(df, *columns, order):
    return [tuple(r) for r in df.orderBy(order).select(*columns).collect()]


def test_three_paths(spark):
    given = readings(
        spark,
        c="列车班次7K3。\n站台编号9号。开车时间是晚上。",
        a="列车班次713。站台编号 9号。开车时间是早上。",
        b="列车班次7l3。站台编号9号。开车时间是早上。",
    )
    answers = spark.createDataFrame([(1, 0, "列车班次713。"), (1, 9, "stray")], "page_id long, segment long, text string")
    out = fuse(given, answers)
    assert rows(out.segments, "text", "confidence", "source", "disputed", order="idx") == [
        ("列车班次713。", 0.95, "escalated", True),
        ("站台编号9号。", 0.971, "consensus", False),
        ("开车时间是早上。", 0.7699, "consensus", False),
    ]
    page = out.pages.first()
    assert (page.engines, page.segments, page.consensus_segments, page.escalated_segments) == (3, 3, 2, 1)
    dispute = out.disputes.first()
    assert (dispute.segment, dispute.before, dispute.after, len(dispute.candidates)) == (0, "", "站台编号9号。", 3)


def test_adjacent_disputes_are_one_region(spark):
    out = fuse(readings(spark, a="山路很长。第一座桥有12根柱。过桥费要30块钱。", b="山路很长。第一座桥有l2根柱。过桥费要39块钱。"))
    assert rows(out.disputes, "segment", "before", order="segment") == [(1, "山路很长。")]
    assert out.disputes.first().candidates[0].text == "第一座桥有12根柱。过桥费要30块钱。"


def test_deferred_dropped_and_single(spark):
    given = readings(spark, a="水温¥21。", b="水温21。")
    answers = spark.createDataFrame([(1, 0, " ")], "page_id long, segment long, text string")
    assert rows(fuse(given, answers, defer=True).segments, "source", "disputed", order="idx") == [("fallback", True)]
    page = fuse(given, answers).pages.first()
    assert (page.escalated_segments, page.dropped_segments, page.text, page.confidence) == (1, 1, "", 0.0)
    lone = fuse(readings(spark, a="一句。两句。")).segments.collect()
    assert [(s.text, s.confidence) for s in lone] == [("一句。两句。", 0.25)]


def test_all_failed(spark):
    given = spark.createDataFrame(
        [(1, "b", "", 1, "x"), (1, "a", "", 1, "y")], "page_id long, agent string, text string, latency_ms long, err string"
    )
    page = fuse(given).pages.first()
    assert (page.engines, page.failed_engines, page.text) == (2, 2, "")


@pytest.mark.parametrize(
    "k,n,want", [(2, 2, 0.9239), (3, 3, 0.971), (5, 5, 0.9958), (2, 3, 0.7699), (3, 4, 0.8496), (4, 5, 0.8901), (3, 5, 0.7768)]
)
def test_consensus_confidence(spark, k, n, want):
    assert spark.range(1).select(votes.consensus_confidence(F.lit(k), F.lit(n))).first()[0] == want


def test_text_forms(spark):
    df = spark.createDataFrame([(" 高度： ≈ 3,456.7 \n", "三座山连线", "三座山连钱")], "t string, a string, b string")
    row = df.select(T.visible_form("t"), T.similarity("a", "b")).first()
    assert row[0] == "高度：≈3,456.7" and 0.5 < row[1] < 1
    text = "早上下\n大雪。 \n中午出太阳！“晚上呢？\n”夜里看星星"
    cut = spark.createDataFrame([(text,), ("Two\nlines meet!",)], "t string").select(T.segments_of("t")).collect()
    assert cut[0][0] == ["早上下大雪。", "中午出太阳！", "“晚上呢？”", "夜里看星星"]
    assert cut[1][0] == ["Two lines meet!"]


def test_long_blank_runs_are_cleaned_in_one_pass(spark):
    """Time by the square of a run of white space would take minutes here."""
    start = time.time()
    text = spark.createDataFrame([("a" + "\t " * 300_000 + "b. c" + " " * 300_000 + "!\u3000d",)], "text string")
    told = text.select(T.clean_layout("text"), F.size(T.segments_of("text")), T.trim_space(F.concat("text", F.lit("\u2009\n")))).first()
    assert told[:2] == ("a b.c!d", 2) and told[2].endswith("d") and time.time() - start < 30


def test_sentences_equal_the_plain_cut(spark):
    alphabet = "ab1é 。！？!?；;”’」\"')].,中𠀀\t\u2028\u3000$"
    draw = random.Random(3)
    texts = ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 30))) for _ in range(3000)]
    given = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    ends, closers = re.escape(T.SENTENCE_ENDS), re.escape(T.CLOSING_MARKS)
    for row in given.select("text", T.clean_layout("text").alias("clean"), T.segments_of("text").alias("cut")).collect():
        pieces = re.findall(f"[^{ends}]*[{ends}][{closers}]*|[^{ends}]+", row["clean"])
        assert row["cut"] == [p.strip() for p in pieces if p.strip()]


def test_engines_alone_cut_no_text(spark):
    plan = inputs.readings(spark, "/root/testdata/sf0.001").select("page_id", "agent")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and "replace" not in plan


def test_answer_lines(spark):
    fence = "```"
    answers = spark.createDataFrame(
        [(1, f"Sure, here you go:\n{fence}\n#4\n#99 ignore me\n#3 fixed line\n{fence}\n"), (2, "#1234.5 元")], "page_id long, text string"
    )
    asked = spark.createDataFrame([(1, 3), (1, 4), (2, 1234)], "page_id long, segment long")
    good, bad = resolve.parse_resolutions(answers, asked)
    assert rows(good, "segment", "text", order="segment") == [(3, "fixed line"), (4, "")]
    assert [r.page_id for r in bad.collect()] == [2]
    pairs, bad = dedupe.parse_proposals(
        spark.createDataFrame([(1, " #12 -> #3 \n#12 -> #4"), (2, "#12 => #3"), (3, "none")], "page_id long, text string")
    )
    assert rows(pairs, "page_id", "later", "earlier", order="later") == [(1, 12, 3)]
    assert [r.page_id for r in bad.collect()] == [2]


def test_unsafe_repeats_stay(spark):
    text = "河边的老树每年春天都会开花。"
    data = [(1, 0, text, 0.9, "consensus", False), (1, 1, text, 0.5, "fallback", True), (1, 2, text, 0.9, "consensus", False),
            (1, 3, "短句。", 0.5, "fallback", True), (1, 6, text, 0.5, "fallback", True)]
    segments = spark.createDataFrame(data, "page_id long, idx long, text string, confidence double, source string, disputed boolean")
    hints = spark.createDataFrame(
        [(1, 1, 0), (1, 2, 0), (1, 3, 0), (1, 6, 0), (1, 0, 1), (1, 9, 6), (1, 6, 2)], "page_id long, later int, earlier int"
    )
    assert rows(dedupe.validate_proposals(segments, hints), "later", "earlier", order="later") == [(1, 0), (6, 2)]


def test_similar_pairs_equal_brute_force(spark):
    import random

    rng = random.Random(3)
    texts = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    df = spark.createDataFrame([(i % 2, t) for i, t in enumerate(texts)], "page_id int, text string")

    def grams(t):
        return {t[i : i + 2] for i in range(len(t) - 1)}

    for floor in (0.2, 0.5):
        want = set()
        for k in (0, 1):
            forms = sorted(set(texts[k::2]))
            for i, a in enumerate(forms):
                for b in forms[i + 1 :]:
                    x, y = grams(a), grams(b)
                    if x and y and len(x & y) / len(x | y) > floor:
                        want.add((k, a, b))
        got = similar.similar_segments(df, ["page_id"], "text", floor)
        assert {(r.page_id, r.left_core, r.right_core) for r in got.collect()} == want


def test_similar_pairs_of_small_and_large_keys(spark):
    import random

    rng = random.Random(4)
    texts = [(k, "".join(rng.choice("abé😀") for _ in range(rng.randint(1, 9)))) for k in (0, 0, 0, 1) for _ in range(20)]
    df = spark.createDataFrame(texts + [(0, None), (None, "abab"), (None, "aba")], "page_id int, text string")
    both = similar.similar_segments(df, ["page_id"], "text", 0.3, direct=30)
    columns = ("page_id", "left_core", "right_core", "copies_left", "copies_right", "similarity")
    ways = [{tuple(r[c] for c in columns) for r in similar.similar_segments(df, ["page_id"], "text", 0.3, direct=d).collect()} for d in (0, 99)]
    assert {tuple(r[c] for c in columns) for r in both.collect()} == ways[0] == ways[1] and len(ways[0]) > 50
    # A page's forms are shuffled once as they are, not once a gram.
    assert "gram#" not in similar.similar_segments(df, ["page_id"], "text")._jdf.queryExecution().executedPlan().toString()


def test_anchors_and_waits_over_many_buckets(spark):
    import random
    from datetime import datetime, timedelta

    rng = random.Random(5)
    segments = []
    for page in (1, 2):
        for place in range(60):
            text = rng.choice(["", " \n", "a%d" % place, "b", ""]) if not 20 < place < 40 else " "
            # Numbers 700 apart: a bucket holds about six of them, and some hold no text at all.
            segments.append((page, place * 700, text, rng.random() < 0.4))
    df = spark.createDataFrame(segments, "page_id long, idx long, text string, disputed boolean").withColumn("candidates", F.lit("c"))
    got = {(r.page_id, r.segment): (r.before, r.after) for r in assemble.review_anchors(df.repartition(5), ["page_id"]).collect()}
    want = {}
    for page, idx, _, disputed in segments:
        if disputed:
            near = [(i, t) for p, i, t, _ in segments if p == page and t.strip()]
            want[page, idx] = (max([x for x in near if x[0] < idx], default=(0, ""))[1], min([x for x in near if x[0] > idx], default=(0, ""))[1])
    assert got == want and len(want) > 20

    start = datetime(2024, 1, 1)
    events, clock = [], 0
    for place in range(80):
        clock += rng.choice([1, 5, 400, 20])
        events.append(("d", "p", "engine", "m", place * 900, start + timedelta(seconds=clock), rng.choice(["attempt_start", "delta", "delta", "attempt_failed"])))
    now = start + timedelta(seconds=clock + 500)
    epoch, want = 0, {}
    for this, then in zip(events, [*events[1:], (*events[0][:5], now, "")]):
        epoch += this[6] == "attempt_start"
        if this[6] in ("attempt_start", "delta") and (then[5] - this[5]).total_seconds() >= 300:
            want.setdefault(epoch, this[5] + timedelta(seconds=300))
    df = spark.createDataFrame(events, "doc_id string, page_id string, stage string, agent string, seq long, ts timestamp, type string")
    got = {r.epoch: r.idle_at for r in B.idle_attempts(df, F.lit(now), 300).collect()}
    assert got == want and len(want) > 3


def test_files_on_disk(spark, tmp_path):
    deep = tmp_path / "x y" / "z%20"
    deep.mkdir(parents=True)
    (tmp_path / "nothing here").mkdir()
    for name, data in {"a.pdf": b"%PDF-1.7 x", "b.png": b"\x89PNG\r\n\x1a\nxx", "c.txt": b"hello", "d": b"", "_SUCCESS": b"", ".c.crc": b"1"}.items():
        (tmp_path / name).write_bytes(data)
    (deep / "e.jpg").write_bytes(b"\xff\xd8\xff" + b"j" * 40)
    (deep / "f.pdf").write_bytes(b"%PDF-" + b"p" * 90)
    (deep / "g").write_bytes(b"")
    (deep / "h").write_bytes(b"%P")
    for root in (str(tmp_path), f"file://{tmp_path}/"):
        accepted, rejected = files.admit_files(spark, root, max_file=90, max_image=30)
        at = len(str(tmp_path)) + (7 if root.startswith("file") else 0) + 1
        assert sorted((r.path[at:], r.length, r.source_type) for r in accepted.collect()) == [("a.pdf", 10, "pdf"), ("b.png", 10, "image")]
        assert sorted((r.path[at:], r.reason) for r in rejected.collect()) == [
            ("c.txt", "unsupported format"), ("d", "empty file"), ("x y/z%20/e.jpg", "image too large"),
            ("x y/z%20/f.pdf", "file too large"), ("x y/z%20/g", "empty file"), ("x y/z%20/h", "unsupported format"),
        ]
    accepted, rejected = files.admit_files(spark, str(tmp_path / "nothing here"))
    assert accepted.isEmpty() and rejected.isEmpty()


def test_audit_pieces_make_the_audit(spark):
    documents = spark.createDataFrame(
        [(1, 'a "b".pdf', "pdf", 5), (2, "none.png", "image", 0)], "doc_id long, name string, source_type string, size_bytes long"
    ).withColumn("created_at", F.lit("2024-01-02").cast("timestamp"))
    pages = spark.createDataFrame(
        [(1, "p2", 1, 2, 2, "failed", 7, "no\nanswer", False), (1, "p1", 0, 1, 1, "completed", 0, "", True), (1, "p3", 4, 3, 3, "completed", 1, "", True)],
        "doc_id long, page_id string, pos long, page_number int, source_page int, status string, duration_ms long, error string, result_ready boolean",
    )
    results = spark.createDataFrame([(1, "p1", "x"), (1, "p2", "unread")], "doc_id long, page_id string, text string").select(
        "doc_id", "page_id", F.struct("text").alias("result")
    )
    now = F.lit("2030-01-01").cast("timestamp")
    whole = {r.doc_id: r.body for r in exports.export_audit(documents, pages, results, now).collect()}
    pieces = exports.audit_pieces(documents, pages, results, now).orderBy("doc_id", "pos").collect()
    joined = {d: "".join(r.piece for r in pieces if r.doc_id == d) for d in (1, 2)}
    assert joined == whole and [r.pos for r in pieces] == [-1, 0, 1, 4, 5, -1, 0]
    first = json.loads(joined[1])
    assert first["document"]["name"] == 'a "b".pdf' and [p["page_number"] for p in first["pages"]] == [1, 2, 3]
    assert [p.get("result") for p in first["pages"]] == [{"text": "x"}, None, None] and first["pages"][1]["error"] == "no\nanswer"
    assert json.loads(joined[2])["pages"] == [] and len(pieces) == 7


def test_results_by_path(spark, tmp_path):
    folder = tmp_path / "d1" / "results"
    folder.mkdir(parents=True)
    (folder / "page-000001.json").write_text(json.dumps({"text": "x", "segments": [{"text": "x", "source": "fallback"}], "stats": {"engines": 1}}))
    segments, _, stats = results.load_results(spark, str(tmp_path))
    assert rows(segments, "doc_id", "page_id", "text", "confidence", "disputed", order="idx") == [("d1", "page-000001", "x", 0.0, False)]
    assert stats.first().fallback_segments == 0


def test_text_that_looks_like_a_list_is_text(spark):
    body = json.dumps({"choices": [{"message": {"content": '[{"type":"text","text":"no"}]'}}]})
    df = spark.createDataFrame([("openai-chat-completions", body)], "api string, body string")
    assert responses.ingest_responses(df, "api", "body").first().output == '[{"type":"text","text":"no"}]'


EVENTS = [
    # type, kind, text, attempt, error
    ("agent_start", "", "", 0, ""), ("attempt_start", "", "", 1, ""), ("delta", "output", "lost", 1, ""),
    ("attempt_failed", "", "", 1, "reset"), ("attempt_start", "", "", 2, ""), ("delta", "thinking", "hm", 2, ""),
    ("delta", "output", "abc", 2, ""), ("delta", "output", "def 中", 2, ""), ("agent_done", "", "", 0, ""),
]


def write_events(spark, path, part):
    for seq in part:
        kind = EVENTS[seq]
        line = {
            "doc_id": "d", "page_id": "p", "seq": seq, "ts": f"2024-01-01T00:00:{seq:02d}Z", "type": kind[0], "stage": "engine",
            "agent": "m", "kind": kind[1], "text": kind[2], "attempt": kind[3], "max_attempts": 2, "error": kind[4],
        }
        with open(path / f"{part[0]}.json", "a") as f:
            f.write(json.dumps(line) + "\n\n")


def test_stream_equals_batch_over_several_runs(spark, tmp_path):
    live.use_rocksdb(spark)
    inbox, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    inbox.mkdir()
    for n, part in enumerate(([0, 1, 2], [3, 4, 5, 6], [7, 8])):
        write_events(spark, inbox, part)
        live.run_once(live.agent_progress(lifecycle.read_lifecycle(spark, str(inbox), streaming=True)), out, state)
        got = live.newest(spark.read.parquet(out), B.AGENT, ["last_seq"]).first()
        events = lifecycle.read_lifecycle(spark, str(inbox))
        want = B.agent_state(events).first()
        for c in ("status", "started_at", "first_token_at", "first_output_at", "finished_at", "output_chars", "tokens",
                  "output", "thinking", "error", "last_error", "attempt", "max_attempts"):
            assert got[c] == want[c], (n, c)
    assert (want.status, want.output, want.tokens, want.last_error) == ("completed", "abcdef 中", 3, "reset")


def test_reordering_sorts_pages_and_order_once(spark):
    """Odd rows: a page given twice, one unknown, one missing, no id, a document not asked, a page kept twice."""
    documents_ = spark.createDataFrame([(d, "ready") for d in range(1, 8)], "doc_id long, status string")
    pages = spark.createDataFrame(
        [(1, "a", 0), (1, "b", 1), (2, "a", 0), (2, "b", 1), (3, "a", 0), (4, "a", 0), (5, "a", 0), (5, None, 1), (6, "a", 0), (6, "a", 1)]
        + [(None, "a", 0)],
        "doc_id long, page_id string, pos int",
    )
    order = spark.createDataFrame(
        [(1, "a", 5), (1, "b", 4), (2, "a", 1), (2, "a", 0), (3, "x", 0), (5, "a", 1), (5, None, 0), (6, "a", 3), (None, "a", 9)],
        "doc_id long, page_id string, place int",
    )
    moved, rejected = documents.reorder_pages(documents_, pages, order)
    told = {r.doc_id: r.violation for r in rejected.collect()}
    repeated = "unknown or repeated page"
    assert told == {2: repeated, 3: repeated, 5: repeated, None: "order must hold every page"}
    where = sorted((r.doc_id or 0, r.page_id or "", r.pos) for r in moved.collect())
    assert where == [
        (0, "a", 0), (1, "a", 5), (1, "b", 4), (2, "a", 0), (2, "b", 1), (3, "a", 0), (4, "a", 0), (5, "", 1), (5, "a", 0),
        (6, "a", 3), (6, "a", 3),
    ]
    plan = rejected._jdf.queryExecution().optimizedPlan().toString()
    assert "FullOuter" not in plan and "LeftSemi" not in plan


def test_similar_pairs_by_matrix_and_by_places(monkeypatch):
    import random

    rng = random.Random(9)
    cores = sorted({"".join(rng.choice("abc日") for _ in range(rng.randint(2, 9))) for _ in range(70)})
    grams = [{c[i : i + 2] for i in range(len(c) - 1)} for c in cores]
    want = {}
    for i in range(len(cores)):
        for j in range(i + 1, len(cores)):
            value = len(grams[i] & grams[j]) / len(grams[i] | grams[j])
            if value > 0.35:
                want[i, j] = value

    def found():
        return {(i, j): s for part in similar._found(cores, 0.35) for i, j, s in zip(*(p.tolist() for p in part))}

    assert found() == want and len(want) > 50
    monkeypatch.setattr(similar, "CELLS", 200)
    assert found() == want
    monkeypatch.setattr(similar, "WIDE", 0)
    assert found() == want
    assert list(similar._found(["ab"], 0.35)) == []


def test_similar_pairs_compare_no_arrays_row_by_row(spark):
    df = spark.createDataFrame([(1, "north wind"), (1, "north wing")], "page_id int, text string")
    pairs = similar.similar_segments(df, ["page_id"], "text")
    assert "array_intersect" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in pairs.collect()] == [(1, "northwind", "northwing", 1, 1, 7 / 9)]
