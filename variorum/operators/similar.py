"""Similarity self-join within a key."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from variorum.functions import text as T
from variorum.operators.align_kernel import Side
from variorum.session import ship_package, stage

#: Keys with at most this many forms are compared form by form, larger ones through an index.
DIRECT = 4096
#: A key with more different bigrams than this is not compared by a matrix; cells of one step of it.
WIDE = 4096
CELLS = 1 << 18


def _found(cores: list[str], floor: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of places in ``cores`` (distinct, in order) whose Jaccard exceeds ``floor``, and it, some rows at a time.

    What two forms share is an entry of a matrix product over bigrams; where a key has very many different bigrams, it is
    counted from the places of each.
    """
    side = Side(cores)
    vocabulary, side.ids = np.unique(side.codes, return_inverse=True)
    ends = np.arange(1, len(cores) + 1)
    if len(vocabulary) > WIDE:
        shares = _shared_sparse(side)
    else:
        shares = _shared_dense(side.sets(ends, 1, max(1, len(vocabulary))))
    for first, sizes, shared in shares:
        union = sizes[first : first + len(shared), None] + sizes[None, first:] - shared
        similarity = np.divide(shared, union, out=np.zeros_like(union), where=union > 0)
        left, right = np.nonzero(similarity > floor)
        ahead = right > left
        left, right = left[ahead], right[ahead]
        if len(left):
            yield first + left, first + right, similarity[left, right]


def _shared_dense(sets: np.ndarray):
    sizes = sets.sum(axis=1, dtype=np.float64)
    step = max(1, CELLS // len(sets))
    for first in range(0, len(sets), step):
        yield first, sizes, (sets[first : first + step] @ sets[first:].T).astype(np.float64)


def _shared_sparse(side: Side):
    """The same, a form's distinct bigrams looked up among the forms that have them."""
    count, width = side.count, int(side.ids.max()) + 1
    form = np.repeat(np.arange(count), np.diff(side.edges))
    inside = form[:-1] == form[1:]
    forms, grams = np.divmod(np.unique(form[:-1][inside] * width + side.ids[inside]), width)
    sizes = np.bincount(forms, minlength=count)
    by_gram = forms[np.argsort(grams, kind="stable")]
    starts = np.concatenate(([0], np.cumsum(np.bincount(grams, minlength=width))))
    edges = np.concatenate(([0], np.cumsum(sizes)))
    step = max(1, CELLS // count)
    for first in range(0, count, step):
        shared = np.zeros((min(step, count - first), count))
        for row, mine in enumerate(shared, first):
            for gram in grams[edges[row] : edges[row + 1]]:
                mine[by_gram[starts[gram] : starts[gram + 1]]] += 1
        yield first, sizes.astype(np.float64), shared[:, first:]


def _compared(forms: DataFrame, keys: list[str], floor: float) -> DataFrame:
    """Pairs of forms of a key, each with each, a key's forms gathered in one row."""
    # A fixed number of pieces, as the work is heavy per byte.
    pieces = int(forms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = forms.repartition(pieces, *keys)
    gathered = dealt.groupBy(*keys).agg(F.collect_list(F.struct("core", "copies")).alias("forms"))
    for key in keys:
        gathered = gathered.filter(F.col(key).isNotNull())
    ship_package(forms.sparkSession)
    fields = {"left_core": S.StringType(), "right_core": S.StringType(), "copies_left": S.LongType(), "copies_right": S.LongType()}
    schema = S.StructType(
        [gathered.schema[k] for k in keys]
        + [S.StructField(name, kind) for name, kind in fields.items()]
        + [S.StructField("similarity", S.DoubleType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(k) for k in keys]
            for at in range(len(batch)):
                rows = batch.column("forms").slice(at, 1).flatten()
                rows = rows.take(pc.array_sort_indices(rows.field("core")))
                core, copies = rows.field("core"), rows.field("copies")
                for left, right, similarity in _found(core.to_pylist(), floor):
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(c.take(pa.array(np.full(len(left), at, dtype=np.int32))) for c in columns),
                            core.take(pa.array(left)),
                            core.take(pa.array(right)),
                            copies.take(pa.array(left)),
                            copies.take(pa.array(right)),
                            pa.array(similarity),
                        ],
                        names=[*keys, *fields, "similarity"],
                    )

    return gathered.mapInArrow(run, schema)


def _indexed(forms: DataFrame, keys: list[str], floor: float) -> DataFrame:
    """The same pairs from an inverted index on the rarest bigrams of each form.

    Two sets with Jaccard above ``floor`` must share a gram among the first ``size - ceil(floor * size) + 1`` in any
    common order. Sizes, and how many grams can still follow the first shared one, are checked inside the join, before
    anything is emitted. A gram's row holds the number of its form, not its text.
    """
    spread = forms.select(*keys, "form", "size", F.explode(T.bigrams("core")).alias("gram"))
    common = spread.groupBy(*keys, "gram").agg(F.count(F.lit(1)).alias("df"))
    by_form = Window.partitionBy(*keys, "form").orderBy("df", "gram")
    prefix = stage(
        spread.join(common, [*keys, "gram"])
        .withColumn("at", F.row_number().over(by_form))
        .filter(F.col("at") <= F.col("size") - F.ceil(F.col("size") * floor) + 1)
        .drop("df"),
        "prefix",
    )
    left = prefix.select(*keys, "gram", *(F.col(c).alias(f"l_{c}") for c in ("form", "size", "at")))
    right = prefix.select(*keys, "gram", *(F.col(c).alias(f"r_{c}") for c in ("form", "size", "at")))
    smaller = F.least("l_size", "r_size")
    larger = F.greatest("l_size", "r_size")
    needed = (F.col("l_size") + F.col("r_size")) * (floor / (1 + floor))
    possible = F.least(F.col("l_size") - F.col("l_at"), F.col("r_size") - F.col("r_at")) + 1
    candidates = (
        left.join(right, [*keys, "gram"])
        .filter((F.col("l_form") < F.col("r_form")) & (smaller > larger * floor) & (possible >= needed - 1e-9))
        .select(*keys, "l_form", "r_form")
        .distinct()
    )

    def side(name: str) -> DataFrame:
        told = forms.withColumn("grams", T.gram_codes("core"))
        return told.select(*keys, *(F.col(c).alias(f"{name}_{c}") for c in ("form", "core", "copies", "size", "grams")))

    found = candidates.join(side("l"), [*keys, "l_form"]).join(side("r"), [*keys, "r_form"])
    turned = F.col("l_core") > F.col("r_core")

    def of(column: str, first: str, second: str) -> Column:
        return F.when(turned, F.col(f"{second}_{column}")).otherwise(F.col(f"{first}_{column}"))

    pairs = found.select(
        *keys,
        of("core", "l", "r").alias("left_core"),
        of("core", "r", "l").alias("right_core"),
        of("copies", "l", "r").alias("copies_left"),
        of("copies", "r", "l").alias("copies_right"),
        (F.col("l_size") + F.col("r_size")).alias("sizes"),
        # Exploded, because the filter would otherwise be pushed down and the grams be compared twice.
        F.explode_outer(F.array(F.size(F.array_intersect("l_grams", "r_grams")))).alias("shared"),
    )
    similarity = F.try_divide(F.col("shared").cast("double"), (F.col("sizes") - F.col("shared")).cast("double"))
    return pairs.withColumn("similarity", similarity).filter(F.col("similarity") > floor).drop("sizes", "shared")


def similar_segments(
    df: DataFrame, keys: Sequence[str], text: str, floor: float = 0.35, direct: int = DIRECT
) -> DataFrame:
    """Pairs of distinct core forms of a key whose bigram Jaccard exceeds ``floor``.

    Copies are grouped first and come back as counts, so a sentence that fills a third of a table
    is one row here and the result stays whole. Keys of up to ``direct`` forms, as pages are, are compared
    form by form, which shuffles a form once; larger ones go through an inverted index. Both give all pairs.
    """
    keys = list(keys)
    # Forms feed both ways and their choice; they are written once, so the texts are cut once.
    forms = stage(
        df.select(*keys, T.core_form(text).alias("core"))
        .groupBy(*keys, "core")
        .agg(F.count(F.lit(1)).alias("copies"))
        .filter("char_length(core) > 1"),
        "forms",
    )
    large = forms.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > direct).select(*keys)
    if large.isEmpty():
        return _compared(forms, keys, floor)
    pairs = _compared(forms.join(large, keys, "left_anti"), keys, floor)
    numbered = forms.withColumn("size", F.size(T.gram_codes("core"))).withColumn("form", F.monotonically_increasing_id())
    numbered = stage(numbered.join(large, keys, "left_semi"), "numbered")
    return pairs.unionByName(_indexed(numbered, keys, floor))
