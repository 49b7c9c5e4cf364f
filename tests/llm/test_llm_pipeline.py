"""The pipeline against its stages done plainly, stage by stage."""

from collections import defaultdict

import cases
import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from variorum.llm import toxicity
from variorum.session import stage

FOLDER = "/root/testdata/sf0.001"


def test_each_stage(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    given = [(r.doc_id, r.text) for r in docs.collect()]
    results = {}
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, FOLDER), name)
        results[name] = docs
    for name in ("toxicity", "exact_dedup", "near_dedup", "substring_dedup"):
        assert results[name].columns == columns

    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    source = spark.read.parquet(f"{FOLDER}/documents.parquet")
    scored = {r.doc_id: r.predicted for r in toxicity.toxicity(source, labels).collect()}
    held = [(d, t) for d, t in given if not scored[d]]
    assert {r.doc_id for r in results["toxicity"].collect()} == {d for d, _ in held}

    last = {}
    for doc, text in held:
        last[text or ""] = max(last.get(text or "", doc), doc)
    held = [(d, t) for d, t in held if last[t or ""] == d]
    assert {r.doc_id for r in results["exact_dedup"].collect()} == {d for d, _ in held}

    held.sort()
    sets = [cases.shingles(t, 5) for _, t in held]
    held = [row for i, (row, s, root) in enumerate(zip(held, sets, cases.linked(sets, 80))) if not s or root == i]
    assert {r.doc_id for r in results["near_dedup"].collect()} == {d for d, _ in held}

    cut = cases.cut_repeats(held)
    held = [(d, b" ".join(cut[d, t][2]).decode() if cut[d, t][1] else t) for d, t in held]
    found = results["substring_dedup"].collect()
    assert {(r.doc_id, r.text) for r in found} == set(held)
    assert all(r.n_chars == len(r.text) for r in found)

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = defaultdict(int)
    for r in results["packing"].collect():
        pieces[r.doc_id] += r.length
    assert pieces == {d: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in held}


def test_repeated_rows_and_nulls(spark):
    rows = [(1, "a b c"), (1, "a b c"), (2, "a b c"), (3, None), (4, ""), (None, "a b c"), (None, None)]
    docs = cases.frame(spark, rows)
    kept = corpus_pipeline.exact_dedup(spark, docs, FOLDER)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == [(2, "a b c"), (4, "")]
    near = corpus_pipeline.near_dedup(spark, docs, FOLDER).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in near) == [(0, ""), (1, "a b c"), (3, ""), (4, "")]
