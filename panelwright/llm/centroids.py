"""Exact k-means on integer vectors.

Method: Shallot search. Bounded vectors remember their second-nearest centroid, a scan starts from the
closer of the two, its ball over the sorted neighbours shrinks as nearer ones are met, and
the survivors are compared in integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.sources.tables import bucket_count, bucketed

from .common import stored
from .vector_slabs import matrix, slabs, whole

#: Roots of exact integers are widened by this share, so that rounding never hides a centroid.
MARGIN = 1e-12
STATE = "slab long, nearest binary, second binary, upper binary, lower binary, scanned long, moved array<struct<cluster:int,n:long,sums:array<long>>>"


@dataclass(frozen=True)
class Neighbours:
    """What a round knows of its centroids: the distances between them, each one's neighbours
    from near to far, half the distance to the nearest, and how far each moved since the last round."""

    centroids: np.ndarray
    apart: np.ndarray
    order: np.ndarray
    half: np.ndarray
    drift: np.ndarray

    @staticmethod
    def of(centroids: np.ndarray, before: np.ndarray | None) -> Neighbours:
        k = len(centroids)
        squares = ((centroids[:, None, :] - centroids[None]) ** 2).sum(2) if k * k <= 1 << 16 else np.stack([((centroids - c) ** 2).sum(1) for c in centroids])
        apart = np.sqrt(squares.astype(np.float64)) * (1 - MARGIN)
        order = np.argsort(apart + np.where(np.eye(k, dtype=bool), -1.0, 0.0), axis=1, kind="stable")
        half = apart[np.arange(k), order[:, 1]] / 2 if k > 1 else np.full(k, np.inf)
        drift = np.zeros(k) if before is None else np.sqrt(((centroids - before) ** 2).sum(1).astype(np.float64)) * (1 + MARGIN)
        return Neighbours(centroids, apart, order, half, drift)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((x - c) ** 2).sum(1)


def search(
    x: np.ndarray,
    at: Neighbours,
    nearest: np.ndarray,
    second: np.ndarray,
    upper: np.ndarray,
    lower: np.ndarray,
) -> int:
    """Bring each vector's nearest and second-nearest centroid up to date, in place.

    ``upper`` bounds the distance to the nearest from above, ``lower`` that to every other from
    below. Returns the number of distances computed. Ties go to the smaller number: a vector is
    skipped only if its bounds part strictly, and the ball holds all that could tie.
    """
    k = len(at.centroids)
    upper += at.drift[nearest]
    if k == 1:
        return 0
    fast = int(at.drift.argmax())
    others = np.where(np.arange(k) == fast, np.delete(at.drift, fast).max(), at.drift[fast])
    lower -= others[nearest]
    todo = np.flatnonzero(upper >= np.maximum(lower, at.half[nearest]))
    own = squared(x[todo], at.centroids[nearest[todo]])
    computed = len(todo)
    upper[todo] = np.sqrt(own.astype(np.float64)) * (1 + MARGIN)
    still = upper[todo] >= np.maximum(lower[todo], at.half[nearest[todo]])
    todo, first_d = todo[still], own[still]
    if not len(todo):
        return computed
    rows = x[todo]
    first, other = nearest[todo].copy(), second[todo].copy()
    other_d = squared(rows, at.centroids[other])
    computed += len(todo)
    swap = (other_d < first_d) | ((other_d == first_d) & (other < first))
    first[swap], other[swap] = other[swap], first[swap]
    first_d[swap], other_d[swap] = other_d[swap], first_d[swap]
    # the closer one is the ball's centre; what lies beyond centre + second cannot be second
    centre, known = first.copy(), other.copy()
    to_centre = np.sqrt(first_d.astype(np.float64)) * (1 + MARGIN)
    alive = np.arange(len(todo))
    for step in range(1, k):
        near = at.order[centre[alive], step]
        ball = to_centre[alive] + np.sqrt(other_d[alive].astype(np.float64)) * (1 + MARGIN)
        alive = alive[at.apart[centre[alive], near] <= ball]
        if not len(alive):
            break
        near = at.order[centre[alive], step]
        new = alive[near != known[alive]]
        if not len(new):
            continue
        c = at.order[centre[new], step]
        d = squared(rows[new], at.centroids[c])
        computed += len(new)
        best = (d < first_d[new]) | ((d == first_d[new]) & (c < first[new]))
        better = ~best & ((d < other_d[new]) | ((d == other_d[new]) & (c < other[new])))
        to = new[best]
        other[to], other_d[to] = first[to], first_d[to]
        first[to], first_d[to] = c[best], d[best]
        to = new[better]
        other[to], other_d[to] = c[better], d[better]
    nearest[todo], second[todo] = first, other
    upper[todo] = np.sqrt(first_d.astype(np.float64)) * (1 + MARGIN)
    lower[todo] = np.sqrt(other_d.astype(np.float64)) * (1 - MARGIN)
    return computed


def changes(x: np.ndarray, before: np.ndarray | None, after: np.ndarray) -> list[dict]:
    """What the clusters' counts and sums gain and lose when vectors move from ``before`` to ``after``."""
    moved = np.arange(len(x)) if before is None else np.flatnonzero(before != after)
    rows, sides = x[moved], [(after[moved], 1)] + ([] if before is None else [(before[moved], -1)])
    found: dict[int, list] = {}
    for clusters, sign in sides:
        for c in np.unique(clusters):
            own = rows[clusters == c]
            n, sums = found.get(int(c), (0, 0))
            found[int(c)] = (n + sign * len(own), sums + sign * own.sum(0))
    return [{"cluster": c, "n": n, "sums": s.tolist()} for c, (n, s) in found.items()]


def seeds(vectors: DataFrame, key: str, vector: str, dim: int, k: int, salt: str) -> np.ndarray:
    """The ``k`` vectors whose salted key has the smallest sha256, in that order; ties by components."""
    v = F.col("v")
    name = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("key").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = (
        vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
        .where(whole(v) & (F.size(v) == dim))
        .select(name.alias("h"), F.transform(v, lambda c: F.floor(c * 1024)).alias("x"))
        .orderBy("h", "x")
        .limit(k)
        .collect()
    )
    return np.array([r["x"] for r in rows], dtype=np.int64).reshape(-1, dim)


def cluster(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    dim: int = 64,
    k: int = 8,
    rounds: int = 10,
    salt: str = "3:",
    per_bucket: int = 1 << 18,
    log: list | None = None,
) -> DataFrame:
    """One row per vector: ``key``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``, ``centroid_sha256``.

    Vectors with exactly ``dim`` components, none NULL or non-finite, are kept, each component c as
    floor(1024 c); others have no row. Centroids start as the ``k`` kept vectors of the smallest
    sha256 of ``salt`` and key (fewer vectors: fewer centroids). Each round assigns every vector to the
    nearest centroid, ties to the smaller number, and moves every non-empty centroid to the
    exact floor of its vectors' mean; then vectors are assigned once more. Distances are squared and exact.
    Repeated rows are vectors of their own; a NULL key is hashed as an empty one. An empty table
    gives an empty result. Other columns are not read. Components of 2^17 and more in size raise.

    Vectors lie in buckets of rows of 256; a round's bounds (24 bytes a vector) lie in as many
    buckets, so both meet without an exchange, and only bounds are written. Counts and sums move by
    the vectors that changed cluster; k x dim sums and the centroids are all that reaches the driver. A round after
    which no centroid moved ends the search. ``log`` gets (round, distances computed) for tests.
    """
    spark = vectors.sparkSession
    centroids = seeds(vectors, key, vector, dim, k, salt)
    k = len(centroids)
    names = T.StructType(
        [
            T.StructField(key, vectors.schema[key].dataType),
            T.StructField("cluster", T.IntegerType()),
            T.StructField("distance", T.LongType()),
        ]
    )
    more = T.StructType(
        [T.StructField(c, T.LongType()) for c in ("cluster_inertia", "inertia")] + [T.StructField("centroid_sha256", T.StringType())]
    )
    if not k:
        return spark.createDataFrame([], T.StructType([*names.fields, *more.fields]))
    rows = slabs(vectors, key, vector, dim, rows=256)
    buckets = bucket_count(vectors.count(), per_bucket, spark)
    table = bucketed(rows, "vector_slabs", ["slab"], buckets)

    def unpack(batch: pa.RecordBatch, row: int) -> list[np.ndarray]:
        kinds = (("nearest", "<i4"), ("second", "<i4"), ("upper", "<f8"), ("lower", "<f8"))
        return [np.frombuffer(batch.column(c)[row].as_py(), t).copy() for c, t in kinds]

    def begun(n: int) -> list[np.ndarray]:
        return [np.zeros(n, np.int32), np.full(n, min(1, k - 1), np.int32), np.full(n, np.inf), np.zeros(n)]

    def round_of(at: Neighbours, state: DataFrame | None) -> DataFrame:
        fresh = state is None

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for row in range(batch.num_rows):
                    x = matrix(batch.column("x")[row].as_py(), dim)
                    nearest, second, upper, lower = begun(len(x)) if fresh else unpack(batch, row)
                    before = None if fresh else nearest.copy()
                    n = search(x, at, nearest, second, upper, lower)
                    out.append(
                        {
                            "slab": batch.column("slab")[row].as_py(),
                            "nearest": nearest.astype("<i4").tobytes(),
                            "second": second.astype("<i4").tobytes(),
                            "upper": upper.tobytes(),
                            "lower": lower.tobytes(),
                            "scanned": n,
                            "moved": changes(x, before, nearest),
                        }
                    )
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

        own = table.select("slab", "x")
        if state is not None:
            own = own.join(state.drop("scanned", "moved").hint("shuffle_hash"), "slab")
        return bucketed(own.mapInArrow(assign, STATE), "vector_bounds", ["slab"], buckets, deal=False)

    moved = pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])
    arrow = pa.schema(
        [("slab", pa.int64())]
        + [(c, pa.binary()) for c in ("nearest", "second", "upper", "lower")]
        + [("scanned", pa.int64()), ("moved", pa.list_(moved))]
    )
    counts, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
    at, state = Neighbours.of(centroids, None), None
    for turn in range(rounds):
        state = round_of(at, state)
        gains = state.select("scanned", F.explode_outer("moved").alias("m"))
        if log is not None:
            log.append((turn, state.agg(F.sum("scanned")).first()[0]))
        found = (
            gains.where("m IS NOT NULL")
            .select("m.cluster", "m.n", F.posexplode("m.sums").alias("at", "s"))
            .groupBy("cluster", "at")
            .agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
            .collect()
        )  # k x dim rows at most
        for r in found:
            sums[r["cluster"], r["at"]] += r["s"]
            if r["at"] == 0:
                counts[r["cluster"]] += r["n"]
        new = at.centroids.copy()
        new[counts > 0] = sums[counts > 0] // counts[counts > 0][:, None]
        same = bool((new == at.centroids).all())
        at = Neighbours.of(new, at.centroids)
        if same:
            break

    fresh = state is None

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("keys").flatten()
            clusters, distances = [], []
            for row in range(batch.num_rows):
                x = matrix(batch.column("x")[row].as_py(), dim)
                nearest, second, upper, lower = begun(len(x)) if fresh else unpack(batch, row)
                search(x, at, nearest, second, upper, lower)
                clusters.append(nearest)
                distances.append(squared(x, at.centroids[nearest]))
            if clusters:
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(np.concatenate(clusters), pa.int32()), pa.array(np.concatenate(distances), pa.int64())],
                    names=names.names,
                )

    own = table if fresh else table.join(state.drop("scanned", "moved").hint("shuffle_hash"), "slab")
    done = stored(own.mapInArrow(finish, names), "clustered")
    inertia = {r["cluster"]: r["d"] for r in done.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at.centroids.tolist()]
    parameters = spark.createDataFrame(
        [(c, inertia.get(c, 0), sum(inertia.values()), hashes[c]) for c in range(k)],
        T.StructType([T.StructField("cluster", T.IntegerType()), *more.fields]),
    )
    return done.join(F.broadcast(parameters), "cluster").select(key, "cluster", "distance", *more.names)  # k rows
