"""Toxicity: a linear classifier over character n-grams, scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variorum.llm.tables import in_batches, texts
from variorum.llm.words import FACTOR, mixed
from variorum.session import ship_package, stage

#: Lengths of the character n-grams; the two edges of a word count as characters.
LENGTHS = (4, 5, 6, 7, 8, 9)
#: Features are counted in 2**BITS hashed places.
BITS = 20
#: The bound of the fitting sample: labelled documents of each class, by hash of the id.
SAMPLE = {1: 2500, 0: 5000}
#: A place that fewer sampled documents use than this is no feature.
LEAST_DOCUMENTS = 3
#: Nor is one whose log-count ratio is closer to nought than this.
LEAST_RATIO = 1.0
#: Share of the sample's imbalance that the loss evens out, as an exponent.
BALANCE = 0.6
STEPS = 300
RATE = 5.0
PENALTY = 1e-5
THRESHOLD = 0.3
#: The remainder, of four, of the ids' CRC-32 that no label is learnt from.
HELD_OUT = 2
#: Characters of words whose places are worked out at once.
BLOCK = 400_000

_EDGE = "\x02"


def distinct_words(text: str) -> set[str]:
    return set(text.lower().split())


def word_places(words: list[str], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(number of the word, place) for each n-gram of each word; only places that are `wanted`, if given.

    Words come in order; a place that a word has twice comes twice.
    """
    owners, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for low, high in _blocks(words):
        part = words[low:high]
        sizes = np.fromiter(map(len, part), np.int64, len(part)) + 2
        joined = _EDGE + (_EDGE + _EDGE).join(part) + _EDGE
        letters = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        owner = np.repeat(np.arange(low, high), sizes)
        value, found = letters, []
        for n in range(2, max(LENGTHS) + 1):
            value = value[: len(letters) - n + 1] * np.uint64(FACTOR) + letters[n - 1 :]
            if n in LENGTHS:
                place = (mixed(value) >> np.uint64(64 - BITS)).astype(np.int64)
                keep = owner[: len(value)] == owner[n - 1 :]
                if wanted is not None:
                    keep &= wanted[place]
                found.append((owner[: len(value)][keep], place[keep]))
        owner, place = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(owner, kind="stable")
        owners.append(owner[order])
        places.append(place[order])
    return np.concatenate(owners), np.concatenate(places)


def _blocks(words: list[str]) -> Iterator[tuple[int, int]]:
    low = size = 0
    for i, word in enumerate(words):
        if size and size + len(word) > BLOCK:
            yield low, i
            low, size = i, 0
        size += len(word) + 2
    if words:
        yield low, len(words)


def document_places(text: str) -> np.ndarray:
    """The distinct places of a text: what it has is counted once, however often it stands there."""
    return np.unique(word_places(list(distinct_words(text)))[1])


@dataclass(frozen=True)
class Model:
    """Places with a weight (already scaled by their log-count ratios), the weights, and the offset."""

    places: np.ndarray
    weights: np.ndarray
    offset: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS)
        out[self.places] = self.weights
        return out


def scores(documents: list[str], weights: np.ndarray, wanted: np.ndarray, offset: float) -> np.ndarray:
    """Between 0 and 1, higher if likelier toxic. A text's distinct words are looked at, each word once a batch."""
    sets = [distinct_words(text) for text in documents]
    words = list(set().union(*sets))
    number = {w: i for i, w in enumerate(words)}
    owner, place = word_places(words, wanted)
    first = np.searchsorted(owner, np.arange(len(words) + 1))
    out = np.empty(len(documents))
    for i, held in enumerate(sets):
        of = np.fromiter(map(number.__getitem__, held), np.int64, len(held))
        of = of[first[of + 1] > first[of]]
        at = np.concatenate([np.arange(first[k], first[k + 1]) for k in of]) if len(of) else of
        out[i] = offset + weights[np.unique(place[at])].sum()
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def regress(owner: np.ndarray, feature: np.ndarray, labels: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression by gradient steps with momentum; document owner[i] has feature[i], worth its ratio."""
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    scale = ratio[feature]
    norm = max(1.0, np.sqrt((scale**2).sum() / len(labels)))  # keeps steps small enough for any sample
    scale = scale / norm
    weights, offset = np.zeros(len(ratio)), float(np.log(n1 / n0))
    balance = np.where(labels == 1, 0.5 * len(labels) / n1, 0.5 * len(labels) / n0) ** BALANCE
    speed_w, speed_o = np.zeros(len(ratio)), 0.0
    for _ in range(STEPS):
        margin = np.bincount(owner, weights[feature] * scale, len(labels)) + offset
        error = balance * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels) / len(labels)
        slope = np.bincount(feature, error[owner] * scale, len(ratio)) + PENALTY * weights
        speed_w = 0.9 * speed_w - RATE * slope
        speed_o = 0.9 * speed_o - RATE * error.sum()
        weights, offset = weights + speed_w, offset + speed_o
    return weights * ratio / norm, float(offset)


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == HELD_OUT, F.lit(False))


def fitting_sample(labels: DataFrame, sample: dict[int, int]) -> DataFrame:
    """doc_id and toxic of at most `sample[label]` labelled ids of each class, none of them held out."""
    known = (
        labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic"))
        .filter("doc_id is not null and toxic in (0, 1)")
        .filter(~is_held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    picked = [
        known.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
        for label, size in sample.items()
    ]
    return picked[0].unionByName(picked[1])


def fit(docs: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE) -> Model:
    """Learn from `labels` (doc_id, toxic) of documents that are not held out.

    Counts are made on the executors. The driver gets the ratios of at most 2**BITS places, and of each of
    the at most 7,500 sampled documents the places that have one, and runs the regression. Without labels
    of both classes the score is the same for all texts.
    """
    picked = F.broadcast(fitting_sample(labels, sample))
    rows = docs.join(picked, "doc_id").select("doc_id", "text", "toxic")

    def features():
        np.seterr(over="ignore")

        def work(batch: pa.RecordBatch) -> Iterator[list]:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                places = [document_places(t.as_py()).astype("<i4").tobytes() for t in part.column(1)]
                yield [part.column(2).cast(pa.int64()), places]

        return work

    held = stage(in_batches(rows, "toxic long, places binary", features), "toxic-features")
    sizes = {r["toxic"]: r["n"] for r in held.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return Model(np.zeros(0, np.int64), np.zeros(0), 3.0 if n1 else -3.0)

    def counts():
        def work(batch: pa.RecordBatch) -> Iterator[list]:
            labels, lists = batch.column(0).to_numpy(), [np.frombuffer(x.as_py(), "<i4") for x in batch.column(1)]
            place, at = np.unique(np.concatenate(lists), return_inverse=True)
            owner = np.repeat(labels, [len(x) for x in lists])
            yield [place.astype(np.int64), np.bincount(at, owner, len(place)).astype(np.int64), np.bincount(at, minlength=len(place))]

        return work

    summed = (
        in_batches(held, "place long, positive long, every long", counts)
        .groupBy("place")
        .agg(F.sum("positive").alias("positive"), F.sum("every").alias("every"))
    )
    ratio = F.log((F.col("positive") + 1) / F.lit(n1 + 2.0)) - F.log(
        (F.col("every") - F.col("positive") + 1) / F.lit(n0 + 2.0)
    )
    features_found = (
        summed.filter(F.col("every") >= LEAST_DOCUMENTS)
        .select("place", ratio.alias("ratio"))
        .filter(F.abs("ratio") >= LEAST_RATIO)
        .orderBy("place")
        .toArrow()
    )
    places, ratios = features_found["place"].to_numpy(), features_found["ratio"].to_numpy()

    def narrowed():
        def work(batch: pa.RecordBatch) -> Iterator[list]:
            lists = [np.frombuffer(x.as_py(), "<i4") for x in batch.column(1)]
            yield [batch.column(0), [x[np.isin(x, places)].tobytes() for x in lists]]

        return work

    table = in_batches(held, "toxic long, places binary", narrowed).toArrow()
    lists = [np.frombuffer(x.as_py(), "<i4") for x in table["places"]]
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    feature = np.searchsorted(places, np.concatenate(lists)) if len(places) else np.zeros(0, np.int64)
    weights, offset = regress(owner, feature, table["toxic"].to_numpy().astype(float), ratios)
    return Model(places, weights, offset)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of `docs`, which has doc_id and text."""

    def make():
        np.seterr(over="ignore")
        weights = model.dense()
        wanted = weights != 0

        def work(batch: pa.RecordBatch) -> Iterator[list]:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = scores(part.column(1).to_pylist(), weights, wanted, model.offset)
                yield [part.column(0), found, (found >= THRESHOLD).astype(np.int32)]

        return work

    scored = in_batches(docs, "doc_id long, score double, predicted int", make)
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def acceptable(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of `docs` with a score under THRESHOLD, whole and without a shuffle."""
    ship_package(docs.sparkSession)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        np.seterr(over="ignore")
        weights = model.dense()
        wanted = weights != 0
        for text in batches:
            parts = [text[i : i + 1000].tolist() for i in range(0, len(text), 1000)]
            yield pd.Series(np.concatenate([scores(x, weights, wanted, model.offset) for x in parts] or [[]]))

    return docs.filter(scored(F.coalesce(docs[text_col].cast("string"), F.lit(""))) < THRESHOLD)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fit on the labelled documents that are not held out, and score each row of `docs`.

    A null text is an empty one, which gets the score of the offset alone; repeated rows score alike; a
    null id is not held out and has no label. An id labelled twice and otherwise is toxic; labels other than
    0 and 1 and labels of unknown ids are passed over. An empty table gives no rows; without labels of both
    classes all texts score alike. Other columns are not looked at. Only texts make a score.
    """
    rows = texts(docs, id_col, text_col)
    return score(rows, fit(rows, labels))
