"""What the operators share: the two columns they read, row numbers, and typed Arrow output."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variorum.session import ship_package, stage


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id (long) and text (string, a null one empty), and no other column, so that no name can clash."""
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
    )


def with_row_number(rows: DataFrame, *columns: Column) -> DataFrame:
    """The columns and `row_id`, which tells repeated rows apart. Stage the result: only then is it fixed."""
    return rows.select(*columns, F.monotonically_increasing_id().alias("row_id"))


def staged_rows(rows: DataFrame, name: str, *columns: Column) -> DataFrame:
    return stage(with_row_number(rows, *columns), name)


def in_batches(
    rows: DataFrame,
    schema: str,
    make: Callable[[], Callable[[pa.RecordBatch], Iterator[list]]],
    last: bool = False,
) -> DataFrame:
    """Run `make()` once in each task; what it returns turns each Arrow batch into lists of output columns.

    With `last` it is called once more with None when the rows of the task are over.
    """
    ship_package(rows.sparkSession)
    fields = arrow_fields(schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in chain(batches, [None] if last else []):
            if batch is None or batch.num_rows:
                for columns in work(batch):
                    yield pa.RecordBatch.from_arrays(
                        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, fields)],
                        schema=fields,
                    )

    return rows.mapInArrow(task, schema)


_ARROW = {
    "long": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "string": pa.string(),
    "binary": pa.binary(),
    "array<long>": pa.list_(pa.int64()),
    "array<int>": pa.list_(pa.int32()),
    "array<double>": pa.list_(pa.float64()),
}


def arrow_fields(schema: str) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in (part.split() for part in schema.split(", "))])
