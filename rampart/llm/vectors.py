"""Integer vectors from float embeddings, and their batches in tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(v: Column) -> Column:
    """Whether a vector is there and holds finite numbers only (an empty one does)."""
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def integer_code(v: Column, scale: int, limit: int) -> Column:
    """floor(scale * x) of each component, x as double, held within ``limit``."""
    def one(x):
        y = x.cast("double") * scale
        return F.floor(F.greatest(F.least(y, F.lit(float(limit))), F.lit(-float(limit)))).cast("bigint")
    return F.transform(v, one)


def batches_of(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least ``rows`` (but for the last)."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def matrix(col: pa.Array, width: int) -> np.ndarray:
    """The vectors of a list array, all of length ``width``, as rows."""
    return col.flatten().to_numpy().reshape(-1, width)
