"""Exact duplicates, near duplicates, repeated passages and the components under them, against plain versions."""

import random
from collections import Counter, defaultdict

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from variorum.llm import exact, near, substrings
from variorum.llm.components import components


def order(doc):
    return (doc is None, doc if doc is not None else 0)


@pytest.mark.parametrize("tracked", [8, 1024])
def test_exact(docs, rows, tracked):
    got = exact.exact_duplicates(docs, tracked=tracked).collect()
    groups = defaultdict(list)
    for doc, text in rows:
        groups[text or ""].append(doc)
    want = Counter()
    for text, ids in groups.items():
        known = [d for d in ids if d is not None]
        keep = max(known) if known else None
        for doc in ids:
            want[doc, keep, len(ids), cases.sha(text)] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_a_frequent_digest_is_found(docs):
    digests = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")).withColumn(
        "row_id", F.monotonically_increasing_id()
    )
    heavy = exact.heavy_winners(digests, 8).collect()
    assert cases.sha("the same text over and over") in {r.digest for r in heavy if r.heavy_size == 30}


@pytest.mark.parametrize(("shingle", "percent", "block"), [(3, 85, 2000), (5, 80, 2000), (3, 85, 6)])
def test_near(docs, rows, shingle, percent, block):
    got = near.near_duplicates(docs, shingle=shingle, percent=percent, block=block).collect()
    ordered = sorted(rows, key=lambda r: order(r[0]))
    sets = [cases.shingles(text, shingle) for _, text in ordered]
    roots = cases.linked(sets, percent)
    want = Counter(
        (doc, len(s), ordered[root][0] if s else doc) for (doc, _), s, root in zip(ordered, sets, roots)
    )
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert sum(r.kept for r in got) == len({root for root, s in zip(roots, sets) if s}) + sum(not s for s in sets)
    assert all(r.component_id == r.doc_id for r in got if r.kept)


@pytest.mark.parametrize("block", [2000, 2])
def test_near_copies_of_a_row_without_an_id(spark, block):
    base = [f"w{i}" for i in range(200)]
    near_copy = lambda k: " ".join(base[:k] + ["other"] + base[k + 1 :])
    text = " ".join(base)
    # The null ids come first, so that one is the row of its class; 9 and 8 are copies of it, the rest near copies.
    rows = [(None, text), (None, text), (9, text), (8, text.upper())] + [(k, near_copy(k)) for k in (50, 100, 150)]
    rows += [(None, "alone, without an id"), (None, near_copy(180)), (77, "alone, with an id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = near.near_duplicates(docs, shingle=3, percent=85, block=block).collect()
    want = Counter((doc, doc if "alone" in t else 8) for doc, t in rows)
    assert Counter((r.doc_id, r.component_id) for r in got) == want
    assert Counter(r.doc_id for r in got if r.kept) == Counter([8, 77, None])


def test_registers_estimate_similarity():
    np.seterr(over="ignore")
    rnd, order = np.random.default_rng(3), near.donors(512)
    for size in (30, 300, 5000):
        common = rnd.integers(0, 1 << 63, size, dtype=np.uint64)
        for share in (0.0, 0.5, 0.9):
            k = int(size * share)
            pair = [np.unique(np.concatenate([common[:k], rnd.integers(0, 1 << 63, size - k, dtype=np.uint64)])) for _ in range(2)]
            both = k / (2 * size - k)
            one, two = (near.hyperminhash(s, order) for s in pair)
            guess = near.estimates(one, two[None, :], near.chance_of_collision(size / 512))[0]
            assert abs(guess - both) < 6 * np.sqrt(0.25 * (1 / 512 + 1 / size)) * max(2 * np.sqrt(both * (1 - both)), 0.3)


@pytest.mark.parametrize("shard_bytes, shard_docs", [(substrings.SHARD_BYTES, substrings.SHARD_DOCS), (40, 2)])
def test_substrings(docs, rows, shard_bytes, shard_docs):
    got = substrings.without_repeats(docs, shard_bytes=shard_bytes, shard_docs=shard_docs).collect()
    plain = cases.cut_repeats(rows)
    want = Counter((doc, *plain[doc, text][:2], b" ".join(plain[doc, text][2]).decode()) for doc, text in rows)
    assert Counter(tuple(r) for r in got) == want
    assert any(r.n_removed for r in got)


def test_no_copy_of_an_automaton_sees_more_than_its_documents(spark, docs, rows):
    """A passage that most documents share is dealt over copies; each has all its owners."""
    rnd = random.Random(8)
    shared = " ".join(cases.word(rnd) for _ in range(20))
    more = [(k, f"before{k} {shared} behind{k}") for k in range(400)]
    keyed = substrings.keyed(spark.createDataFrame(more, "doc_id long, text string"), "doc_id", "text")
    keyed = keyed.select("place", "row", "text")
    found = substrings.windows(keyed, substrings.recurring(substrings.anchor_table(keyed, 13, 8)), 13, 8).cache()
    recur = substrings.confirmed(found).cache()
    assert recur.count() == 8 and {r.low for r in recur.collect()} == {0}
    asks = substrings.asked(found, recur, 1 << 20, 20).collect()
    copies = Counter(r.copy for r in asks if r.owned is None)
    assert sum(copies.values()) == 399 and len(copies) == 20 and max(copies.values()) < 60
    assert sorted(r.copy for r in asks if r.owned is not None) == list(range(20))


def test_cut_repeats_leaves_other_texts_and_columns(docs, rows):
    got = substrings.cut_repeats(docs)
    assert got.columns == docs.columns
    plain = cases.cut_repeats(rows)
    want = Counter(
        (doc, b" ".join(plain[doc, text][2]).decode() if plain[doc, text][1] else text) for doc, text in rows
    )
    assert Counter((r.doc_id, r.text) for r in got.collect()) == want


def test_components_of_a_chain_a_star_and_a_ring(spark):
    links = [(i, i + 1) for i in range(100, 130)] + [(5, i) for i in range(6, 40)] + [(51, 52), (52, 53), (53, 51), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 131))
    assert all(got[i] == 5 for i in range(5, 40))
    assert {got[i] for i in (51, 52, 53)} == {51}


def test_nothing(nothing):
    assert exact.exact_duplicates(nothing).count() == 0
    assert near.near_duplicates(nothing).count() == 0
    assert substrings.without_repeats(nothing).count() == 0
    assert substrings.cut_repeats(nothing).count() == 0
