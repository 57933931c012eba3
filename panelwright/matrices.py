"""Sums of matrices over all tasks: one partial a task, added up row by row on the executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A partial matrix: its number, the number of one of its rows (or pieces), and that row.
PARTS = "matrix int, piece int, part array<double>"
_NAMES = ["matrix", "piece", "part"]
#: Numbers in a piece of a flat array.
PIECE = 1024


def emitted(matrices: dict[int, np.ndarray]) -> pa.RecordBatch:
    """One task's partial sums as ``PARTS``: every array is cut into pieces of ``PIECE`` numbers."""
    which, piece, parts = [], [], []
    for i, m in matrices.items():
        flat = np.ascontiguousarray(m, dtype=np.float64).ravel()
        for at in range(0, len(flat), PIECE):
            which.append(i)
            piece.append(at // PIECE)
            parts.append(flat[at : at + PIECE])
    sizes = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    values = pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())
    return pa.RecordBatch.from_arrays(
        [pa.array(which, pa.int32()), pa.array(piece, pa.int32()), pa.ListArray.from_arrays(pa.array(sizes), values)],
        names=_NAMES,
    )


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        which, piece = batch.column("matrix").to_numpy(), batch.column("piece").to_numpy()
        parts = batch.column("part")
        values, edges = parts.values.to_numpy(zero_copy_only=False), parts.offsets.to_numpy()
        for row in range(batch.num_rows):
            own, key = values[edges[row] : edges[row + 1]], (int(which[row]), int(piece[row]))
            if key in total:
                total[key] += own
            else:
                total[key] = own.copy()
    if total:
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in total], pa.int32()),
                pa.array([k[1] for k in total], pa.int32()),
                pa.array(list(total.values()), pa.list_(pa.float64())),
            ],
            names=_NAMES,
        )


def tree_sum(partials: DataFrame, slots: int = 8) -> dict[int, np.ndarray]:
    """The sums of ``PARTS`` rows by matrix, as flat arrays.

    Whole pieces move, never single numbers: the one exchange has tasks x pieces rows, whatever
    a piece holds. Tasks take turns among ``slots`` reducers a piece, and the driver adds the
    ``slots`` results, so it holds that many times the matrices, however many tasks there were.
    """
    summed = (
        partials.withColumn("slot", F.spark_partition_id() % slots)
        .repartition("matrix", "piece", "slot")
        .drop("slot")
        .mapInArrow(_added, PARTS)
        .collect()
    )
    out: dict[int, dict[int, np.ndarray]] = {}
    for r in summed:
        pieces, part = out.setdefault(r["matrix"], {}), np.asarray(r["part"])
        pieces[r["piece"]] = pieces[r["piece"]] + part if r["piece"] in pieces else part
    return {i: np.concatenate([pieces[k] for k in sorted(pieces)]) for i, pieces in out.items()}
