"""Near duplicates by HyperMinHash: compressed registers, banded, estimated, then confirmed on full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - reached as pa.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variorum.llm.components import components
from variorum.llm.tables import in_batches, texts, with_row_number
from variorum.llm.words import Numbering, mixed, rolling
from variorum.session import stage

#: Defaults of the operator: words in a shingle, and similarity in percent from which texts are linked.
SHINGLE = 5
PERCENT = 80
#: Registers in a band, and the default number of bands, a parameter. Two texts share no band with a
#: probability of (1 - 0.8**8)**64 = 8e-6 at a similarity of 0.8, (1 - 0.85**8)**48 = 2e-7 at 0.85.
ROWS = 8
BANDS = 64
#: Bits of a register: those of the mantissa; six more hold the count of leading zeros.
MANTISSA = 10
#: An estimate this many standard errors under the limit rules a pair out before the sets are compared.
ERRORS = 6
#: Texts of a cluster that one task compares; a larger cluster is dealt out as pairs of such blocks.
BLOCK = 2000
#: Words that are worked on at once.
BLOCK_WORDS = 300_000


def shingle_sets(documents: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the runs of `n` words of each text; of all its words if they are fewer.

    A-Z are lower-cased. A text without words has an empty set.
    """
    lists = [text.lower().split() for text in documents]
    numbers = Numbering()
    ids = numbers.ids([w for words in lists for w in words])
    hashes = numbers.hashes()[ids]
    out, at = [], 0
    for words in lists:
        own = hashes[at : at + len(words)]
        at += len(words)
        width = min(n, len(words))
        runs = mixed(rolling(own, width) + np.uint64(width)) if width else own
        out.append(np.unique(runs))
    return out


def donors(registers: int) -> np.ndarray:
    """For each register the order in which it asks the others for their value; the same everywhere."""
    return np.random.default_rng(20).permuted(
        np.tile(np.arange(registers, dtype=np.uint16), (registers, 1)), axis=1
    )


def hyperminhash(hashes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Registers of a set: of its smallest hash in each bucket the leading zeros and the mantissa behind them.

    The top bits of the hash as a floating-point number are just these two. A bucket that no hash falls in
    takes the value of the first filled one in its own fixed order, so that registers agree in proportion
    to the similarity for small sets too.
    """
    size = len(order)
    bucket = (hashes >> np.uint64(40)) % np.uint64(size)
    value = mixed(hashes) >> np.uint64(10)
    keys = np.sort((bucket << np.uint64(54)) | value)
    filled, first = np.unique(keys >> np.uint64(54), return_index=True)
    smallest = (keys[first] & np.uint64((1 << 54) - 1)) + np.uint64(1)
    bits = smallest.astype(np.float64).view(np.uint64) >> np.uint64(52 - MANTISSA)
    out = np.zeros(size, np.uint16)
    filled = filled.astype(np.int64)
    out[filled] = (bits - np.uint64(1023 << MANTISSA)).astype(np.uint16)
    if len(filled) < size:
        empty = np.setdiff1d(np.arange(size), filled, assume_unique=True)
        donor = filled[order[np.ix_(empty, filled)].argmin(axis=1)]
        out[empty] = out[donor]
    return out


def band_keys(registers: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of registers."""
    bands = registers.reshape(-1, rows)
    key = np.arange(1, len(bands) + 1).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    for k in range(rows):
        key = mixed(key + bands[:, k].astype(np.uint64))
    return key.view(np.int64)


def chance_of_collision(per_register: float) -> float:
    """Probability that two unrelated registers agree, each the smallest of `per_register` hashes on average."""
    edges = np.concatenate(
        [[0.0], (np.arange(1, 1 + (1 << MANTISSA)) / (1 << MANTISSA) + 1)[None, :].repeat(55, 0).ravel()
         * np.exp2(np.arange(55)).repeat(1 << MANTISSA)]
    )
    tail = np.exp(-max(per_register, 1e-9) * edges / 2.0**54)
    return float(((tail[:-1] - tail[1:]) ** 2).sum())


def estimates(one: np.ndarray, others: np.ndarray, collision: float) -> np.ndarray:
    """Similarity of a text and others by their registers, less what agrees by chance."""
    agree = (others == one).mean(axis=1)
    return np.clip((agree - collision) / (1 - collision), 0, 1)


class Links:
    """Union-find over the texts of one block; yields the links that joined two parts."""

    def __init__(self, size: int) -> None:
        self.parent = list(range(size))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        a, b = self.root(x), self.root(y)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def confirmed(
    sets: list[np.ndarray], side: np.ndarray, percent: int, order: np.ndarray
) -> list[tuple[int, int]]:
    """Links that span the parts of a block, each confirmed on the full sets.

    `side` is 0 or 1 where the block pairs two lists (only pairs across count), else all 0. A pair whose
    parts are joined already is not compared again.
    """
    across = side.any()
    registers = np.array([hyperminhash(s, order) for s in sets])
    sizes = np.array([len(s) for s in sets], np.int64)
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sets)), sizes)
    names, ids = np.unique(np.concatenate(sets), return_inverse=True)
    member = np.zeros(len(names), bool)
    collision = chance_of_collision(sizes.mean() / len(order))
    limit, links, found = percent / 100, Links(len(sets)), []
    for x in range(1, len(sets)):
        near = np.minimum(sizes[:x], sizes[x]) * 100 >= percent * np.maximum(sizes[:x], sizes[x])
        if across:
            near &= side[:x] != side[x]
        others = np.flatnonzero(near)
        if not len(others):
            continue
        error = np.sqrt(limit * (1 - limit) * (1 / len(order) + 1 / np.maximum(sizes[others], sizes[x])))
        others = others[estimates(registers[x], registers[others], collision) >= limit - ERRORS * error]
        others = others[[links.root(x) != links.root(y) for y in others.tolist()]] if len(others) else others
        if not len(others):
            continue
        # What all earlier sets share with this one, in one pass over their elements.
        own, before = ids[starts[x] : starts[x] + sizes[x]], slice(0, starts[x])
        member[own] = True
        both = np.bincount(owner[before][member[ids[before]]], minlength=x)[others]
        member[own] = False
        for y in others[100 * both >= percent * (sizes[others] + sizes[x] - both)].tolist():
            if links.join(x, y):
                found.append((x, y))
    return found


SKETCH = "doc_id long, text_hash long, row_id long, n_shingles long, set_1 long, set_2 long, bands array<long>"


def sketched(rows: DataFrame, shingle: int, bands: int) -> DataFrame:
    """SKETCH of doc_id, text and row_id: size and 128-bit digest of each text's set, and its band keys."""

    def make():
        np.seterr(over="ignore")
        order = donors(bands * ROWS)

        def work(batch: pa.RecordBatch) -> Iterator[list]:
            for part in pieces(batch, 1):
                sets = shingle_sets(part.column(1).cast(pa.binary()).to_pylist(), shingle)
                digests = np.array(
                    [divmod(xxhash.xxh3_128_intdigest(s.tobytes()), 1 << 64) for s in sets], np.uint64
                ).view(np.int64)
                keys = [band_keys(hyperminhash(s, order), ROWS) if len(s) else [] for s in sets]
                yield [
                    part.column(0), part.column(2), part.column(3), [len(s) for s in sets], digests[:, 0], digests[:, 1],
                    pa.array(keys, pa.list_(pa.int64())),
                ]

        return work

    return in_batches(rows.select("doc_id", "text", F.xxhash64("text"), "row_id"), SKETCH, make)


def pieces(batch: pa.RecordBatch, text: int, limit: int = 6 * BLOCK_WORDS) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about `limit` bytes of text; a longer text comes alone."""
    sizes = pa.compute.binary_length(batch.column(text)).to_numpy()
    start = held = 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    yield batch.slice(start)


def clusters(classes: DataFrame) -> DataFrame:
    """`node` and `component` of classes that share a band with others, directly or by way of them.

    Each bucket links its members to its smallest one, a row each, so a bucket of any size is no more rows.
    """
    keyed = classes.select(F.explode("bands").alias("key"), "class")
    first = keyed.groupBy("key").agg(F.min("class").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return components(keyed.join(first, "key").select(F.col("class").alias("a"), F.col("first").alias("b")))


def verified_links(docs: DataFrame, members: DataFrame, shingle: int, percent: int, bands: int, block: int) -> DataFrame:
    """Links (a, b) between classes of one cluster, confirmed on full sets; they span what is linked.

    `members` has class, doc_id, text_hash, set_1, set_2 and cluster. A text goes to one task with its cluster; a
    cluster of over `block` texts is dealt out by pairs of blocks, so that no task holds more than two.
    Texts are found by id and hash, null ids as well as others.
    """
    place = F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("place")
    size = members.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("n_blocks"))
    own = F.pmod(F.xxhash64("class"), F.col("n_blocks")).cast("int")
    dealt = (
        members.join(size, "cluster")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        .select(
            place, "text_hash", "class", "set_1", "set_2", "own", "cluster",
            F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        )
    )
    held = docs.select(place, F.xxhash64("text").alias("text_hash"), "text").join(dealt, ["place", "text_hash"])
    spread = held.repartition("cluster", "low", "high").sortWithinPartitions("cluster", "low", "high", "class")

    def make():
        np.seterr(over="ignore")
        order = donors(bands * ROWS)
        waiting: list = []

        def compare(group: list) -> list[tuple[int, int]]:
            seen: dict[int, tuple[np.ndarray, int]] = {}
            for at in range(0, len(group), 200):
                part = group[at : at + 200]
                for row, found in zip(part, shingle_sets([r[0] for r in part], shingle)):
                    one, two = divmod(xxhash.xxh3_128_intdigest(found.tobytes()), 1 << 64)
                    # Another text under the same id and hash is not this class.
                    if (one, two) == (row[2] % (1 << 64), row[3] % (1 << 64)):
                        seen[row[1]] = (found, int(row[4] == row[6]))
            names = list(seen)
            same = group[0][5] == group[0][6]
            side = np.zeros(len(names), int) if same else np.array([seen[c][1] for c in names])
            if len(names) < 2:
                return []
            return [
                (names[x], names[y]) for x, y in confirmed([seen[c][0] for c in names], side, percent, order)
            ]

        def work(batch: pa.RecordBatch | None) -> Iterator[list]:
            nonlocal waiting
            out: list[tuple[int, int]] = []
            if batch is None:
                out = compare(waiting) if waiting else []
            else:
                columns = [batch.column(0).cast(pa.binary()).to_pylist(), *(c.to_pylist() for c in batch.columns[1:])]
                for row in zip(*columns):
                    if waiting and row[5:] != waiting[0][5:]:
                        out += compare(waiting)
                        waiting = []
                    # Rows with one text and no id (or one id) all meet their class; one of them will do.
                    if not waiting or row[:2] != waiting[-1][:2]:
                        waiting.append(row)
            if out:
                yield [list(x) for x in zip(*out)]

        return work

    rows = spread.select("text", "class", "set_1", "set_2", "own", "low", "high", "cluster")
    return in_batches(rows, "a long, b long", make, last=True)


def near_duplicates(
    docs: DataFrame,
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    bands: int = BANDS,
    block: int = BLOCK,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_shingles, component_id, kept, text_hash.

    Texts are linked when 100 * intersection >= `percent` * union of their sets of `shingle` words, and
    fall into components; component_id is the smallest doc_id of one, and the row with it is kept (of
    repeated rows one). text_hash (64 bits) tells texts under one id apart. A text without words, or null, is alone and kept. A null id counts as the largest.

    Texts with one set are one class; copies are never compared with each other. Classes that share a band
    form clusters, and each cluster's sets are compared once, in blocks.
    """
    source = texts(docs, id_col, text_col)
    rows = stage(sketched(with_row_number(source, F.col("doc_id"), F.col("text")), shingle, bands), "sketches")
    full = rows.filter("n_shingles > 0")
    classes = stage(full.groupBy("set_1", "set_2").agg(F.min("row_id").alias("class")), "classes")
    firsts = full.join(classes, full["row_id"] == classes["class"]).select(
        "class", "doc_id", "text_hash", full["set_1"], full["set_2"], "bands"
    )
    cluster = clusters(firsts.select("class", "bands")).withColumnRenamed("component", "cluster")
    members = firsts.drop("bands").join(cluster, firsts["class"] == cluster["node"]).drop("node")
    links = stage(verified_links(source, members, shingle, percent, bands, block), "near-links")
    component = components(links)
    labelled = (
        rows.drop("bands")
        .join(classes, ["set_1", "set_2"], "left")
        .join(component, F.col("class") == component["node"], "left")
        .select(
            "doc_id", "text_hash", "row_id", "n_shingles",
            F.when(F.col("n_shingles") > 0, F.coalesce("component", "class")).alias("component"),
        )
    )
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id")
    lowest = labelled.filter("component is not null").groupBy("component").agg(F.min(place).alias("lowest"))
    return labelled.join(lowest, "component", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("lowest").isNull(), F.col("doc_id")).otherwise(F.col("lowest.doc_id")).alias("component_id"),
        F.coalesce(F.col("row_id") == F.col("lowest.row_id"), F.lit(True)).alias("kept"),
        "text_hash",
    )
