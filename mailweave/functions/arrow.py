"""Row functions over Arrow batches: the one place where Python sees rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def flat_map(df: DataFrame, make: Callable[[], Callable[..., Iterable[tuple]]], schema: str | T.StructType) -> DataFrame:
    """df.mapInArrow with a function of one row's values that yields output tuples.

    `make` runs once per task, so what it builds (compiled tables, caches) is shared by the task's batches.
    Output goes out in batches of at most 8192 rows, so memory doesn't grow with the partition.
    """

    def make_batch() -> Callable[..., Iterable[tuple]]:
        fn = make()
        return lambda *cols: (out for row in zip(*cols) for out in fn(*row))

    return flat_map_batches(df, make_batch, schema)


def flat_map_batches(df: DataFrame, make: Callable[[], Callable[..., Iterable[tuple]]], schema: str | T.StructType) -> DataFrame:
    """Like flat_map, but the function gets the columns of a batch as lists, for work that gains from many rows at once."""
    target = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    width = len(target.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, fn, out = to_arrow_schema(target), make(), []

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            cols: list[Any] = list(zip(*rows)) if rows else [()] * width
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow)], schema=arrow)

        for b in batches:
            for row in fn(*[c.to_pylist() for c in b.columns]) if b.num_rows else ():
                out.append(row)
                if len(out) >= 8192:
                    yield batch(out)
                    out = []
        if out:
            yield batch(out)

    return df.mapInArrow(run, target)
