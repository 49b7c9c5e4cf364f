"""Plans that keep rows small: what a row carries must not grow with its page."""

import re

import pytest
from pyspark.sql import functions as F

from checks import inputs as I
from variorum.functions import text as T
from variorum.operators import documents as documents_
from variorum.operators import align, dedupe, resolve, transitions, votes
from variorum.session import stage

FOLDER = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("lossy", [True, False])
def test_a_sentence_does_not_carry_its_page(spark, lossy):
    slots = I.slots(spark, FOLDER, lossy)
    plan = slots._jdf.queryExecution().executedPlan().toString()
    carried = re.findall(r"Generate .*\), \[([^\]]*)\], (?:true|false), \[", plan)
    assert carried
    for columns in carried:
        assert not re.search(r"engines|sents|text", columns), columns
    assert "DataFilters: []" in plan  # no filter that cuts the texts at the scan
    assert "Exchange hash" not in plan
    gathered = votes.gather_slots(I.candidate_rows(spark, FOLDER, lossy))
    assert gathered.exceptAll(slots).isEmpty() and slots.exceptAll(gathered).isEmpty()


def test_agreed_slots_leave_their_candidates_behind(spark):
    slots = spark.createDataFrame(
        [(1, 0, [("a", "x"), ("b", "x")], 2), (1, 1, [("a", "y"), ("b", "z")], 2), (1, 2, [("a", "v"), ("b", "v")], 2)],
        "page_id long, slot long, candidates array<struct<agent: string, text: string>>, n int",
    )
    blocks = votes.dispute_blocks(votes.consensus_vote(slots))
    assert " Join" not in optimized(blocks).replace("Join Inner, ", "", 1)  # but that of the scan
    assert [(r.segment, r.last_slot, r.before, r.after, len(r.candidates)) for r in blocks.collect()] == [(1, 1, "x", "v", 2)]


def test_a_filter_on_votes_makes_each_form_once(spark):
    slots = spark.createDataFrame(
        [(1, 0, [("a", "x y"), ("b", "xy"), ("c", "z")], 3), (1, 1, [("a", None), ("b", None), ("c", "z")], 3)],
        "page_id long, slot long, candidates array<struct<agent: string, text: string>>, n int",
    ).repartition(2)
    agreed = votes.consensus_vote(slots).filter("consensus")
    filters = [line for line in optimized(agreed).split("\n") if "Filter" in line]
    assert all(line.count("regexp_replace") <= 1 for line in filters)
    assert [tuple(r) for r in agreed.select("slot", "text", F.size("agreed")).collect()] == [(0, "x y", 2)]


def test_code_points_are_whole_characters(spark):
    texts = ["", "a", "äb", "a\nb", "𝄞x", "日本"]
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    found = {r.t: r.p for r in rows.select("t", T.code_points("t").alias("p")).collect()}
    assert found == {**{t: list(t) for t in texts}, None: None}
    assert "regexp" not in optimized(rows.select(T.code_points("t")))


def test_regions_at_bucket_edges_and_gaps(spark):
    def slot(at, *texts):
        return (1, at, [(a, t) for a, t in zip("ab", texts)], 2)

    given = [slot(i, f"t{i}", f"t{i}") for i in range(4090, 4100)]
    given[5] = slot(4095, "p", "q")
    given[6] = slot(4096, "r")
    given[9] = slot(4200, "v", "w")  # not next to 4098
    slots = spark.createDataFrame(
        given, "page_id long, slot long, candidates array<struct<agent: string, text: string>>, n int"
    )
    found = votes.dispute_blocks(votes.consensus_vote(slots)).orderBy("segment").collect()
    assert [(r.segment, r.last_slot, r.before, r.after) for r in found] == [
        (4095, 4096, "t4094", "t4097"), (4200, 4200, "", ""),
    ]
    assert [tuple(c) for c in found[0].candidates] == [("a", "pr"), ("b", "q")]


def test_queueing_broadcasts_no_table_of_documents_or_pages(spark):
    documents, pages = I.documents(spark, FOLDER), stage(I.pages(spark, FOLDER), "pages")
    requests, selection = I.requests(spark, FOLDER), I.selection(pages)
    checked = documents_.check_selection(requests, selection, documents, pages)
    queued = transitions.queue_pages(documents, pages, requests, selection, I.now())
    dequeued = transitions.dequeue_pages(documents, pages, selection, I.now())
    for df in (checked, *queued, *dequeued):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_local_choice_compares_a_pair_once(spark):
    rows = [
        (1, 0, [("a", "north wind"), ("b", "north wing"), ("c", "xyz")]),
        (1, 1, [("a", "日本語"), ("b", "日本𠀀"), ("c", "日本語")]),
        (1, 2, [("a", "x"), ("b", "y")]),
        (1, 3, [("a", "")]),
    ]
    disputes = spark.createDataFrame(
        [(p, s, "", "", c) for p, s, c in rows],
        "page_id long, segment long, before string, after string, candidates array<struct<agent: string, text: string>>",
    ).repartition(2)
    outcomes = resolve.apply_resolutions(disputes, None)
    assert optimized(outcomes).count("array_intersect") == 1
    found = disputes.select("segment", votes.medoid("candidates").alias("m")).orderBy("segment").select("m.*").collect()
    # northwind and northwing share 7 of 9 bigrams; 日本語 and 日本𠀀 one of three.
    assert [tuple(r) for r in found] == [("a", "north wind", 7 / 9), ("a", "日本語", 1 / 3 + 1.0), ("a", "x", 0.0), ("a", "", 0.0)]
    assert [r["from"] for r in outcomes.collect()] == [["a"]] * 4


def test_proposals_make_each_form_once(spark):
    segments = spark.createDataFrame(
        [(1, 0, "the north wind", False, "consensus"), (1, 1, "The North Wind", True, "fallback"), (1, 2, "the-north wind.", True, "fallback")],
        "page_id long, idx long, text string, disputed boolean, source string",
    )
    valid = dedupe.validate_proposals(segments, dedupe.propose_nearby(segments))
    assert optimized(valid).count("regexp_replace") == 4  # core and visible form of two texts
    assert [tuple(r) for r in valid.collect()] == [(1, 2, 0)]


def test_alignment_shuffles_texts_uncut(spark):
    plan = optimized(align.page_bundles(I.readings(spark, FOLDER))).split("\n")
    below = plan[next(i for i, line in enumerate(plan) if "Repartition" in line) :]
    assert not any(" AS cores" in line for line in below)
