"""Connected components, and groups of rows met one after another in a task."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _toward_smallest(edges: DataFrame, both_ways: bool) -> DataFrame:
    """One round of stars: every neighbour of a node moves to the smallest node around it.

    With ``both_ways`` only larger neighbours move (to the smallest of all neighbours),
    otherwise the node and its smaller neighbours do.
    """
    seen = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both_ways else edges
    least = seen.groupBy("a").agg(F.min("b").alias("m"))
    joined = seen.join(least, "a")
    if both_ways:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return moved.where("a > b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """``node`` and ``root`` for every node that has an edge to another node.

    The root is the smallest node of the component. Stars are built toward smaller nodes by
    turns, each round one pass over the edges, written to the shared folder; the number of
    rounds grows with the logarithm of the longest path. NULL nodes and loops are left out.
    """
    now = stored(
        edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") > F.col("b")))
        .distinct(),
        "edges",
    )
    before = None
    for _ in range(most_rounds):
        mark = now.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        ).first()
        if (mark["n"], mark["h"]) == before or not mark["n"]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = (mark["n"], mark["h"])
        now = stored(_toward_smallest(_toward_smallest(now, True), False), "edges")
    raise RuntimeError("components did not settle")


def local_roots(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 joined by pairs (p, q): the smallest node of each one's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[p], root[q])
        new = root.copy()
        np.minimum.at(new, p, low)
        np.minimum.at(new, q, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """The rows of each key, from batches sorted by ``keys``; a run may cross batches."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for at, to in zip(starts[:-1], starts[1:], strict=True):
            key = tuple(c[at] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(at, to - at))
    if held:
        yield pa.Table.from_batches(held)
