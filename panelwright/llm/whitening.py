"""Embeddings projected on their leading principal components at unit variance.

Method: Chebyshev-filtered subspace iteration. A polynomial recurrence over distributed centred XᵀXQ
passes damps the unwanted spectrum; QR and Rayleigh-Ritz follow, until residuals certify the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.matrices import PARTS, emitted, tree_sum

from .common import stored
from .vector_slabs import matrix, slabs, whole

Apply = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Basis:
    """Eigenvalues, falling, their unit eigenvectors as columns, the largest residual relative
    to the first eigenvalue, and how many passes over the data were made."""

    values: np.ndarray
    vectors: np.ndarray
    residual: float
    passes: int


def lower_end(apply: Apply, dim: int, steps: int, rng: np.random.Generator) -> tuple[float, int]:
    """About where the spectrum begins: the smallest Ritz value of a few Lanczos steps, less its residual."""
    v = rng.standard_normal(dim)
    basis, a, b = [v / np.linalg.norm(v)], [], []
    for _ in range(min(steps, dim)):
        w = apply(basis[-1][:, None])[:, 0]
        a.append(float(basis[-1] @ w))
        w = w - np.stack(basis, 1) @ (np.stack(basis, 1).T @ w)
        w = w - np.stack(basis, 1) @ (np.stack(basis, 1).T @ w)
        b.append(float(np.linalg.norm(w)))
        if b[-1] <= 1e-12 * max(abs(a[0]), 1e-300):
            break
        basis.append(w / b[-1])
    values, vectors = np.linalg.eigh(np.diag(a) + np.diag(b[: len(a) - 1], 1) + np.diag(b[: len(a) - 1], -1))
    return max(0.0, float(values[0] - b[-1] * abs(vectors[-1, 0]))), len(a)


def filtered(apply: Apply, q: np.ndarray, aq: np.ndarray, low: float, cut: float, top: float, degree: int) -> np.ndarray:
    """The Chebyshev polynomial of ``degree`` that is small on [low, cut], times q; ``aq`` is A q.

    The scaled three-term recurrence keeps the part at ``top`` near 1, so nothing overflows.
    """
    half, centre = (cut - low) / 2, (cut + low) / 2
    first = half / (top - centre)
    sigma, before, now = first, q, (aq - centre * q) * (first / half)
    for _ in range(degree - 1):
        new = 1 / (2 / first - sigma)
        before, now = now, (apply(now) - centre * now) * (2 * new / half) - sigma * new * before
        sigma = new
    return now


def leading(
    apply: Apply,
    dim: int,
    wanted: int,
    extra: int = 32,
    degree: int = 8,
    tolerance: float = 1e-13,
    most_cycles: int = 60,
    seed: int = 13,
) -> Basis:
    """The ``wanted`` leading eigenpairs of a positive semidefinite matrix known by its products.

    A block of ``wanted + extra`` columns is filtered by turns, made orthonormal (QR) and rotated to its
    Ritz vectors, whose smallest Ritz value is the next filter's cut. The pairs are certified when every
    wanted residual |A q - e q| is within ``tolerance`` of the first eigenvalue, or stays within 100 times
    that without halving any more (rounding). A pass multiplies the whole block; the product of a
    Rayleigh-Ritz step is the next filter's first. Raises when the cycles do not suffice.
    """
    rng, passes = np.random.default_rng(seed), 0
    size = min(dim, wanted + extra)

    def times(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        return apply(q)

    low = 0.0 if size == dim else lower_end(times, dim, 8, rng)[0]
    q, last = np.linalg.qr(rng.standard_normal((dim, size)))[0], np.inf
    for _ in range(most_cycles):
        aq = times(q)
        h = q.T @ aq
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, aq = q @ turn, aq @ turn
        top = max(float(values[0]), 0.0)
        residual = float(np.linalg.norm(aq[:, :wanted] - q[:, :wanted] * values[:wanted], axis=0).max())
        if residual <= tolerance * top or (residual <= 100 * tolerance * top and residual > last / 2):
            return Basis(values[:wanted], q[:, :wanted], residual / top if top else 0.0, passes)
        last = residual
        cut = float(values[-1])
        if size == dim or not low < cut < top:  # nothing unwanted is known to be damped: a plain power step
            q = np.linalg.qr(aq)[0] if size < dim else np.linalg.qr(q)[0]
            low = 0.0
            continue
        q = np.linalg.qr(filtered(times, q, aq, low, cut, top, degree))[0]
    raise RuntimeError(f"no certified basis: residual {residual:.3g} at a largest eigenvalue of {top:.3g}")


def whitened(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    components: int = 8,
    scale: int = 1024,
    shift: int = 100_000,
    tolerance: float = 1e-13,
    extra: int = 32,
    degree: int = 8,
) -> DataFrame:
    """A row per vector and component: ``key``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``,
    ``identity_error``, ``residual`` and ``passes``.

    Vectors that are NULL, empty, or hold NULL or non-finite components have no rows, nor do those of
    another length than most (the shortest, on a tie), which share no dimensions with the rest.
    Each component c becomes x = floor(scale c) + shift. With n vectors and sums S by dimension, V is the
    covariance of x (divisor n). Components are V's unit eigenvectors by falling eigenvalue e, the largest entry
    of each positive, up to ``components``; directions without variance (e of 1e-12 of the first or
    less) are left out, so a table of equal vectors, or an empty one, has no rows. ``deviation`` is the exact
    sum of (n x - S)^2, NULL beyond 64 bits; ``whitened`` the projection of x - S/n over sqrt(e); ``explained`` is
    e over V's trace; ``identity_error`` the largest entry of whitened's covariance less the identity,
    measured on the rows returned. Repeated rows count as vectors of their own; NULL keys stay.

    The integers are written once in slabs; a pass multiplies them, centred exactly before
    anything is squared, with the block's columns, and its d x (components + extra) sums are added up on the
    executors (``tree_sum``). Nothing that grows with the rows reaches the driver.
    """
    spark = vectors.sparkSession
    schema = T.StructType(
        [T.StructField(key, vectors.schema[key].dataType), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType())]
        + [T.StructField(c, T.DoubleType()) for c in ("whitened", "explained")]
    )
    more = T.StructType([*schema.fields, T.StructField("identity_error", T.DoubleType()), T.StructField("residual", T.DoubleType()), T.StructField("passes", T.IntegerType())])
    empty = spark.createDataFrame([], more)
    v = F.col(vector).cast("array<double>")
    lengths = (
        vectors.where(whole(v) & (F.size(v) > 0)).groupBy(F.size(v).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    )
    if lengths is None:
        return empty
    dim = lengths["d"]
    table = stored(slabs(vectors, key, vector, dim, scale, 0), "whitening_slabs")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(dim, np.int64), 0
        for batch in batches:
            for row in batch.column("x"):
                x = matrix(row.as_py(), dim)
                total += x.sum(0)
                count += len(x)
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64()), pa.array([total.tolist()], pa.list_(pa.int64()))], names=["n", "s"])

    sums = (
        table.select("x").mapInArrow(add_up, "n long, s array<long>").select("n", F.posexplode("s").alias("at", "s")).groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("at").collect()
    )  # a row per dimension
    n, s = sums[0]["n"], np.array([r["s"] for r in sums], dtype=np.int64)  # without the shift, which centring takes off again
    base = s // n
    rest = (s - n * base) / n  # the mean is base + rest, the first part exact

    def centred(x: np.ndarray) -> np.ndarray:
        return (x - base) - rest

    def apply(q: np.ndarray) -> np.ndarray:
        width = q.shape[1]

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((dim, width))
            for batch in batches:
                for row in batch.column("x"):
                    x = centred(matrix(row.as_py(), dim))
                    total += x.T @ (x @ q)
            yield emitted({0: total})

        return tree_sum(table.select("x").mapInArrow(multiply, PARTS))[0].reshape(dim, width) / n

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1)
        for batch in batches:
            for row in batch.column("x"):
                total += (centred(matrix(row.as_py(), dim)) ** 2).sum()
        yield emitted({0: total})

    trace = float(tree_sum(table.select("x").mapInArrow(spread, PARTS))[0][0]) / n
    if not trace > 0:
        return empty
    found = leading(apply, dim, min(components, dim), extra, degree, tolerance)
    kept = int((found.values > 1e-12 * found.values[0]).sum())
    values, basis = found.values[:kept], found.vectors[:, :kept]
    basis = basis * np.sign(basis[np.abs(basis).argmax(0), np.arange(kept)])
    project = basis / np.sqrt(values)
    shares = values / trace
    left = s - n * base

    def deviations(x: np.ndarray) -> list[int | None]:
        off = x - base
        if (n * (int(np.abs(off).max(initial=0)) + 1)) ** 2 * dim < 1 << 63:
            return ((n * off - left) ** 2).sum(1).tolist()
        exact = (n * off.astype(object) - left.astype(object)) ** 2
        return [int(d) if d < 1 << 63 else None for d in exact.sum(1)]

    def project_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                x = matrix(batch.column("x")[row].as_py(), dim)
                own, rows = pa.array(np.repeat(np.arange(len(x)), kept)), len(x)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("keys")[row].values.take(own),
                        pa.array(np.tile(np.arange(1, kept + 1), rows), pa.int32()),
                        pa.array(np.full(rows * kept, n), pa.int64()),
                        pa.array(deviations(x), pa.int64()).take(own),
                        pa.array((centred(x) @ project).ravel(), pa.float64()),
                        pa.array(np.tile(shares, rows), pa.float64()),
                    ],
                    names=schema.names,
                )

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((kept + 1, kept))
        for batch in batches:
            for row in batch.column("x"):
                w = centred(matrix(row.as_py(), dim)) @ project
                total += np.concatenate([w.T @ w, w.sum(0)[None]])
        yield emitted({0: total})

    sums_of = tree_sum(table.select("x").mapInArrow(squares, PARTS))[0].reshape(kept + 1, kept) / n
    error = float(np.abs(sums_of[:kept] - np.outer(sums_of[kept], sums_of[kept]) - np.eye(kept)).max())
    return (
        table.mapInArrow(project_rows, schema)
        .withColumn("identity_error", F.lit(error))
        .withColumn("residual", F.lit(found.residual))
        .withColumn("passes", F.lit(found.passes + 3))
    )
