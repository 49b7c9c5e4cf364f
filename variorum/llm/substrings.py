"""Passages that repeat across documents: confirmed, compiled into sharded automata, and cut from later documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variorum.llm.near import pieces
from variorum.llm.tables import in_batches, texts
from variorum.llm.words import FACTOR, Numbering, mixed, rolling
from variorum.session import ship_package, stage, unstage

#: Words of a window; a passage is one or more windows in a row.
WINDOW = 13
#: Words of an anchor. Of the anchors in a window the one with the smallest hash stands for it. A longer anchor
#: recurs by chance less often, a shorter one stands for more windows.
ANCHOR = 8
#: Bytes of the confirmed passages in one automaton, about; a document's own passages stay together.
SHARD_BYTES = 256 << 10
#: Documents that are streamed through one copy of an automaton; those of a common passage are dealt over several.
SHARD_DOCS = 4_000
#: A cut of all words, if they are a window at least: what becomes of a copy.
WHOLE = -1
#: Factors of the two rolling hashes of a window (fixed values, odd).
FACTORS = (FACTOR, np.uint64(0xC2B2AE3D27D4EB4F))

def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, place (the doc_id, a null one behind all others), row (tells texts under one id apart), text."""
    rows = texts(docs, id_col, text_col)
    return rows.select(
        "doc_id", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("place"), F.xxhash64("text").alias("row"), "text"
    )


def smallest_of_runs(values: np.ndarray, n: int) -> np.ndarray:
    """The smallest of each run of `n` values, from smallest of runs half as long."""
    width = 1
    while 2 * width <= n:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    return np.minimum(values[: len(values) - (n - width)], values[n - width :]) if n > width else values


def runs(lists: list[list[bytes]], window: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: (number of the text, first window, last window, anchor).

    Every window of every text lies in exactly one run. Which anchor a window has depends on its own words
    alone, so equal windows of two texts have one anchor.
    """
    counts = np.array([len(words) for words in lists], np.int64)
    numbers = Numbering()
    hashes_of = numbers.ids([w for words in lists for w in words])
    none = np.zeros(0, np.int64)
    if len(hashes_of) < window:
        return none, none, none, none
    grams = mixed(rolling(numbers.hashes()[hashes_of], size))
    anchors = smallest_of_runs(grams, window - size + 1)
    owner = np.repeat(np.arange(len(lists)), counts)
    inside = owner[: len(anchors)] == owner[window - 1 :]
    first = np.cumsum(counts) - counts
    at = np.flatnonzero(inside)
    if not len(at):
        return none, none, none, none
    new = np.ones(len(at), bool)
    new[1:] = (anchors[at[1:]] != anchors[at[:-1]]) | (owner[at[1:]] != owner[at[:-1]])
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(at)) - 1
    text = owner[at[heads]]
    return text, at[heads] - first[text], at[tails] - first[text], anchors[at[heads]].view(np.int64)


def anchor_table(rows: DataFrame, window: int, size: int) -> DataFrame:
    """(anchor, place, text_key) of each run of windows."""

    def make():
        np.seterr(over="ignore")

        def work(batch: pa.RecordBatch) -> Iterator[list]:
            for part in pieces(batch, 2):
                lists = [t.as_py().split() for t in part.column(2).cast(pa.binary())]
                text, _, _, anchor = runs(lists, window, size)
                yield [anchor, part.column(0).to_numpy()[text], part.column(1).to_numpy()[text]]

        return work

    keyed_rows = rows.select("place", text_key().alias("text_key"), "text")
    return in_batches(keyed_rows, "anchor long, place long, text_key long", make)


def text_key() -> Column:
    """One number for a text and its id. Two texts under one number only lend each other anchors, which changes no result."""
    return F.xxhash64("place", "row")


def recurring(anchors: DataFrame) -> DataFrame:
    """For each text the anchors that documents of two different ids have: a list no longer than the text."""
    shared = (
        anchors.groupBy("anchor")
        .agg(F.min("place").alias("low"), F.max("place").alias("high"))
        .filter("low < high")
        .select("anchor")
    )
    return (
        anchors.select("anchor", "text_key")
        .join(shared, "anchor", "left_semi")
        .groupBy("text_key")
        .agg(F.collect_set("anchor").alias("shared"))
    )


def windows(rows: DataFrame, shared: DataFrame, window: int, size: int) -> DataFrame:
    """(h1, h2, place, row, start, bytes) of each window whose anchor recurs: two hashes of its words, and where it stands.

    `bytes` are those of its first word, so that their sum over a passage is nearly the passage's length.
    """

    def make():
        np.seterr(over="ignore")

        def work(batch: pa.RecordBatch) -> Iterator[list]:
            for part in pieces(batch, 2):
                lists = [t.as_py().split() for t in part.column(2).cast(pa.binary())]
                text, first, last, anchor = runs(lists, window, size)
                ends = np.searchsorted(text, np.arange(len(lists) + 1))
                wanted = [np.asarray(x.values) for x in part.column(3)]
                keep = [np.isin(anchor[a:b], found) for a, b, found in zip(ends, ends[1:], wanted)]
                keep = np.concatenate([*keep, np.zeros(0, bool)])
                text, first, last = text[keep], first[keep], last[keep]
                if not len(text):
                    continue
                counts = last - first + 1
                owner = np.repeat(text, counts)
                start = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first, counts)
                before = np.cumsum([0, *map(len, lists)])[:-1]
                numbers = Numbering()
                ids = numbers.ids([w for words in lists for w in words])
                hashes = mixed(numbers.hashes())[ids]
                at = before[owner] + start
                one, two = (mixed(rolling(hashes, window, f)[at]).view(np.int64) for f in FACTORS)
                lengths = np.fromiter(map(len, numbers), np.int64, len(numbers))[ids][at]
                yield [one, two, part.column(0).to_numpy()[owner], part.column(1).to_numpy()[owner], start, lengths]

        return work

    held = rows.withColumn("text_key", text_key()).join(shared, "text_key").select("place", "row", "text", "shared")
    return in_batches(held, "h1 long, h2 long, place long, row long, start long, bytes long", make)


def confirmed(found: DataFrame) -> DataFrame:
    """Each window that documents of two ids have, once: h1, h2, low (the smallest of these ids), bytes, and how its
    occurrences are told from those of other windows: their number, sums of hashes of their places, and of the places
    one word on."""
    here, ahead = F.xxhash64("place", "row", "start"), F.xxhash64("place", "row", F.col("start") + 1)
    sums = [
        F.sum(F.shiftrightunsigned(h, 33 * k).bitwiseAND(0x7FFFFFFF)).alias(f"{name}{k}")
        for name, h in (("here", here), ("ahead", ahead))
        for k in (0, 1)
    ]
    groups = found.groupBy("h1", "h2").agg(
        F.min("place").alias("low"), F.max("place").alias("high"), F.max("bytes").alias("bytes"),
        F.count(F.lit(1)).alias("n"), *sums,
    )
    return groups.filter("low < high").drop("high")


def asked(found: DataFrame, recur: DataFrame, shard_bytes: int, shard_docs: int) -> DataFrame:
    """Which texts go to which automata: (place, row, shard, copy, owned).

    A document owns the windows it is the first to have. It comes with them to their shard; to be streamed, a
    text comes with null to each shard of a window that it has. A shard that many texts are streamed through
    has copies, with its owners in each.
    """
    total = recur.agg(F.sum("bytes")).first()[0] or 0
    shard = F.pmod(F.xxhash64("low"), F.lit(max(1, -(-total // shard_bytes)))).alias("shard")
    own = F.struct("start", "n", "here0", "here1", "ahead0", "ahead1")
    pairs = stage(
        found.select("h1", "h2", "place", "row", "start")
        .join(recur.drop("bytes"), ["h1", "h2"])
        .groupBy("place", "row", shard)
        .agg(
            F.max(F.col("place") > F.col("low")).alias("streamed"),
            F.collect_list(F.when(F.col("place") == F.col("low"), own)).alias("owned"),
        ),
        "pairs",
    )
    streamed = pairs.filter("streamed")
    copies = streamed.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / shard_docs).alias("copies"))
    copy = F.pmod(F.xxhash64("place", "row"), F.col("copies")).alias("copy")
    texts_in = streamed.join(copies, "shard").select(
        "place", "row", "shard", copy, F.lit(None).cast(pairs.schema["owned"].dataType).alias("owned")
    )
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")
    owners = pairs.filter(F.size("owned") > 0).join(copies, "shard").select("place", "row", "shard", every, "owned")
    return texts_in.unionByName(owners)


def passages(owned: pa.StructArray, window: int) -> Iterator[tuple[int, int]]:
    """(first word, words) of the passages that a text's own windows make.

    Two windows in a row are of one passage if every text with the one has the other beside it, one word on: then
    the passage stands wherever any of its windows does, and one pattern finds all of them.
    """
    start, n, here0, here1, ahead0, ahead1 = (owned.field(k).to_numpy() for k in range(6))
    order = np.argsort(start, kind="stable")
    start, n, here0, here1, ahead0, ahead1 = (c[order] for c in (start, n, here0, here1, ahead0, ahead1))
    goes_on = (start[1:] == start[:-1] + 1) & (n[1:] == n[:-1])
    goes_on &= (here0[1:] == ahead0[:-1]) & (here1[1:] == ahead1[:-1])
    heads = np.flatnonzero(np.concatenate([[True], ~goes_on]))
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(start)]):
        yield int(start[a]), b - a + window - 1


def located(rows: DataFrame, asks: DataFrame, window: int) -> DataFrame:
    """(place, row, cut) where a text has a window of a document with a smaller id, each cut as from * 2**32 + to.

    A task reads a shard's owners first and compiles their passages, word for word, into an automaton; then the
    shard's documents are streamed through it, whole and one at a time. It holds one automaton and one document.
    """
    dealt = (
        asks.join(rows, ["place", "row"])
        .repartition("shard", "copy")
        .sortWithinPartitions("shard", "copy", F.col("owned").isNull())
        .select("shard", "copy", "place", "row", "owned", "text")
    )

    def make():
        import ahocorasick

        now: dict = {"of": None}

        def begin(of: tuple) -> None:
            automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            now.update(of=of, ready=False, numbers={}, automaton=automaton)

        def compile_in(words: list[bytes], owned: pa.StructArray, place: int) -> None:
            numbers, automaton = now["numbers"], now["automaton"]
            for first, length in passages(owned, window):
                phrase = tuple([numbers.setdefault(w, len(numbers) + 1) for w in words[first : first + length]])
                automaton.add_word(phrase, (length, min(place, automaton.get(phrase, (0, place))[1])))

        def cuts(words: list[bytes], place: int) -> Iterator[int]:
            if not now["ready"]:
                now["automaton"].make_automaton()
                now["ready"] = True
            number = now["numbers"].get
            for end, (length, low) in now["automaton"].iter(tuple([number(w, 0) for w in words])):
                if low < place:
                    yield (end - length + 1) << 32 | end

        def work(batch: pa.RecordBatch) -> Iterator[list]:
            out: list[tuple] = []
            for i in range(batch.num_rows):
                shard, copy, place, row = (batch.column(c)[i].as_py() for c in range(4))
                if now["of"] != (shard, copy):
                    begin((shard, copy))
                words = batch.column(5)[i].as_py().encode().split()
                if batch.column(4)[i].is_valid:
                    compile_in(words, batch.column(4)[i].values, place)
                else:
                    out += [(place, row, cut) for cut in cuts(words, place)]
            if out:
                yield list(map(list, zip(*out)))

        return work

    return in_batches(dealt, "place long, row long, cut long", make)


def copied(rows: DataFrame, window: int) -> DataFrame:
    """(place, row) of texts that a document with a smaller id has word for word and space for space.

    Texts that are too short for a window of words are left out.
    """
    each = rows.filter(F.length("text") >= 2 * window - 1).select("place", "row", F.sha2("text", 256).alias("content"))
    groups = each.groupBy("content").agg(F.min("place").alias("low"), F.max("place").alias("high")).filter("low < high")
    found = each.join(stage(groups.drop("high"), "copied-contents"), "content").filter("place > low")
    return found.select("place", "row").distinct()


def repeated_ranges(
    rows: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, shard_bytes: int = SHARD_BYTES, shard_docs: int = SHARD_DOCS
) -> DataFrame:
    """(place, row, cuts) of each text of `keyed` rows that has something to cut; one row for each."""
    rows = rows.select("place", "row", "text")
    copies = stage(copied(rows, window), "copies")  # all their windows go, so nothing else is to be learnt from them
    anchors = stage(anchor_table(rows.join(copies, ["place", "row"], "left_anti"), window, anchor), "anchors")
    shared = stage(recurring(anchors), "shared-anchors")
    unstage(anchors)
    found = stage(windows(rows, shared, window, anchor), "windows")
    unstage(shared)
    recur = stage(confirmed(found), "recurring-windows")
    asks = stage(asked(found, recur, shard_bytes, shard_docs), "asks")
    unstage(found, recur)
    parts = located(rows, asks, window).groupBy("place", "row").agg(F.collect_set("cut").alias("cuts"))
    whole = copies.select("place", "row", F.array(F.lit(WHOLE).cast("long")).alias("cuts"))
    cuts = stage(parts.unionByName(whole), "cuts")
    unstage(asks, copies)
    return cuts


def cut_words(words: list[bytes], cuts: np.ndarray, window: int = WINDOW) -> list[bytes]:
    """The words outside all ranges."""
    if len(cuts) == 1 and cuts[0] == WHOLE:
        return [] if len(words) >= window else words
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, cuts >> 32, 1)
    np.add.at(cover, (cuts & 0xFFFFFFFF) + 1, -1)
    return [w for w, hidden in zip(words, np.cumsum(cover).tolist()) if not hidden]


def without_repeats(
    docs: DataFrame,
    window: int = WINDOW,
    anchor: int = ANCHOR,
    shard_bytes: int = SHARD_BYTES,
    shard_docs: int = SHARD_DOCS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_words, n_removed, kept_text.

    A word goes if a window of `window` words over it also starts in a document with a smaller doc_id;
    kept words are one space apart. Windows are judged on the texts as given. A null text has no words; a
    null id counts as the largest; rows with one id never cut each other, so repeated rows are cut alike. No
    rows give no rows.

    A copy of an earlier document's whole text goes as a whole. Of all others, a window is looked at if its anchor - its 8-word run with the smallest hash - stands in documents of two
    ids, and is confirmed if its own 128-bit hash does. Only hashes and places are shuffled for that. Then
    automata find confirmed windows word for word, so hashes decide what is looked for and never what is cut.
    Texts are shuffled three times: to meet their recurring anchors, their automata, and their cuts.
    """
    rows = keyed(docs, id_col, text_col)
    cuts = repeated_ranges(rows, window, anchor, shard_bytes, shard_docs)

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[list]:
            counts, gone, kept = [], [], []
            for text, cut in zip(batch.column(1).cast(pa.binary()), batch.column(2)):
                words = text.as_py().split()
                stays = cut_words(words, np.asarray(cut.values), window) if cut.is_valid else words
                counts.append(len(words))
                gone.append(len(words) - len(stays))
                kept.append(b" ".join(stays))
            yield [batch.column(0), counts, gone, pa.array(kept, pa.binary()).cast(pa.string())]

        return work

    held = rows.join(cuts, ["place", "row"], "left").select("doc_id", "text", "cuts")
    return in_batches(held, "doc_id long, n_words long, n_removed long, kept_text string", make)


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the same columns and rows; a text with repeats is its kept words, one space apart, all others are as they were."""
    ship_package(docs.sparkSession)
    cuts = repeated_ranges(keyed(docs, id_col, text_col))

    def shorter(text: str, cut: np.ndarray) -> str:
        words = text.encode().split()
        kept = cut_words(words, cut)
        return text if len(kept) == len(words) else b" ".join(kept).decode()

    @F.pandas_udf("string")
    def shortened(text: pd.Series, cut: pd.Series) -> pd.Series:
        return pd.Series([t if c is None else shorter(t, np.asarray(c)) for t, c in zip(text, cut)])

    place = F.coalesce(docs[id_col].cast("long"), F.lit((1 << 63) - 1))
    row = F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    marked = docs.select(F.struct(*map(F.col, docs.columns)).alias("given"), place.alias("place"), row.alias("row"))
    held = marked.join(cuts, ["place", "row"], "left")
    text = F.when(F.col("cuts").isNull(), F.col(f"given.{text_col}")).otherwise(
        shortened(F.coalesce(f"given.{text_col}", F.lit("")), "cuts")
    )
    return held.select(*(text.alias(c) if c == text_col else F.col(f"given.{c}") for c in docs.columns))
