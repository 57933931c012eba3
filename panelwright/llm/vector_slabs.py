"""Vectors as integers, many to a row, so that tasks work on matrices instead of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Integer components must stay below this size, so that squared distances fit 64 bits.
LARGEST = 1 << 27


def whole(vector: Column) -> Column:
    """Not NULL, and neither NULL nor a non-finite number among the components."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def slabs(
    vectors: DataFrame, key: str, vector: str, dim: int, scale: int = 1024, shift: int = 0, rows: int = 2048
) -> DataFrame:
    """Rows of up to ``rows`` vectors: ``slab``, ``keys`` and ``x``, their components as 64-bit integers.

    A component c becomes floor(scale * c) + shift, c as double. Vectors that are not ``whole``
    or of another length than ``dim`` are left out; keys may be NULL or repeat. ``slab`` is only as
    stable as the rows' order, so write the result before using it twice. Components of 2^27 and more raise.
    """
    field = vectors.schema[key]
    schema = T.StructType(
        [T.StructField("keys", T.ArrayType(field.dataType)), T.StructField("x", T.BinaryType())]
    )
    v = F.col("v")
    taken = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).where(
        whole(v) & (F.size(v) == dim)
    )

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, rows - count)
                held.append(part)
                count += part.num_rows
                at += part.num_rows
                if count == rows:
                    yield packed(held)
                    held, count = [], 0
        if count:
            yield packed(held)

    def packed(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        own = pa.Table.from_batches(parts).combine_chunks()
        values = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in own["v"].chunks])
        x = np.floor(values * scale)
        if len(x) and np.abs(x).max() >= LARGEST:
            raise ValueError(f"a component times {scale} is {LARGEST} or more")
        keys = pa.concat_arrays(own["key"].chunks)
        return pa.RecordBatch.from_arrays(
            [
                pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys),
                pa.array([(x.astype("<i8") + shift).tobytes()], pa.binary()),
            ],
            names=["keys", "x"],
        )

    return taken.mapInArrow(gather, schema).select(F.monotonically_increasing_id().alias("slab"), "keys", "x")


def matrix(row: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(row, "<i8").reshape(-1, dim)
