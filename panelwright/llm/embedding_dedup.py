"""Near-duplicate vectors under the cosine.

Method: inverted multi-index. Independent codebooks on the two halves of a vector form a product
grid; multi-sequence traversal visits the nearest cells until the target recall; what is found is verified.
Vectors travel in blocks, two blocks to a task, and visit cells there: a vector is sent once a block, not once a cell.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import astuple, dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored
from .graph import components, local_roots, runs
from panelwright.sources.tables import scratch_path

#: Times its own size that a table of vectors is sent at once; what is more is sent in rounds.
COPIES = 2
#: Shuffle files go when the query that wrote them has ended, not when the driver happens to collect its garbage.
FREEING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Pairs held before they are counted.
PAIRS = 1 << 20
#: Leading coordinates that are compared first.
LEADING = 15


@dataclass(frozen=True)
class Grid:
    """A codebook for each half, how far from a vector cells are visited, and a rotation to principal axes."""

    first: np.ndarray
    second: np.ndarray
    reach: float
    axes: np.ndarray

    @staticmethod
    def half_bounds(half: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's nearest code, and its squared distance to every code's cell, from below.

        A cell lies beyond the plane halfway between its code and the nearest one.
        """
        d = np.maximum((half**2).sum(1)[:, None] - 2 * half @ book.T + (book**2).sum(1), 0)
        own = d.argmin(1)
        apart = np.sqrt(np.maximum(((book[:, None, :] - book[None]) ** 2).sum(2), 1e-30))[own]
        to_plane = (d - d[np.arange(len(d)), own][:, None]) / (2 * apart)
        to_plane[np.arange(len(d)), own] = 0
        return own, np.maximum(to_plane - 1e-9, 0) ** 2

    def bounds(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        cut = self.first.shape[1]
        own1, low1 = self.half_bounds(unit[:, :cut], self.first)
        own2, low2 = self.half_bounds(unit[:, cut:], self.second)
        return own1, own2, low1, low2

    def visits(self, low1: np.ndarray, low2: np.ndarray, cells: list[tuple[int, list]]) -> Iterator[tuple[object, np.ndarray]]:
        """For each of ``cells`` the rows that visit it: both halves' distances add up to the reach at most.

        ``cells`` lists, by code of the first half, (code of the second half, anything) of the cells to
        walk. Rows are taken along both lists of codes at once, so that those whose first half is too far are never asked again.
        """
        by1, by2 = np.ascontiguousarray(low1.T), np.ascontiguousarray(low2.T)
        for a, own in cells:
            near = np.flatnonzero(by1[a] <= self.reach**2)
            rest = self.reach**2 - by1[a][near]
            for b, what in own if len(near) else ():
                rows = near[by2[b][near] <= rest]
                if len(rows):
                    yield what, rows


def codebook(rows: np.ndarray, codes: int, seed: int, rounds: int = 12) -> np.ndarray:
    """k-means from distinct rows; empty codes keep their place."""
    distinct = np.unique(rows, axis=0)
    book = distinct[np.random.default_rng(seed).permutation(len(distinct))[:codes]].copy()
    for _ in range(rounds):
        near = ((rows**2).sum(1)[:, None] - 2 * rows @ book.T + (book**2).sum(1)).argmin(1)
        for k in range(len(book)):
            if (near == k).any():
                book[k] = rows[near == k].mean(0)
    return np.unique(book, axis=0)


def furthest_link(threshold: float) -> float:
    """How far apart unit vectors are at most whose cosine is ``threshold`` or more."""
    return math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-7


def grid_for(sample: np.ndarray, labels: np.ndarray, codes: int, threshold: float, recall: float, seed: int = 5) -> Grid:
    """Codebooks of the sample, and the reach that finds ``recall`` of its linked pairs.

    Unit vectors whose cosine is the threshold are sqrt(2 - 2 threshold) apart, so at a recall
    of 1 the reach is that distance, and no cell with a linked vector is missed.
    """
    cut = sample.shape[1] // 2
    furthest = furthest_link(threshold)
    axes = np.linalg.eigh(sample.T @ sample)[1][:, ::-1]
    grid = Grid(codebook(sample[:, :cut], codes, seed), codebook(sample[:, cut:], codes, seed + 1), furthest, axes)
    if recall >= 1:
        return grid
    own1, own2, low1, low2 = grid.bounds(sample)
    need = []
    for at in range(0, len(sample), 512):
        part = slice(at, at + 512)
        p, q = np.nonzero((sample[part] @ sample.T >= threshold) & (labels[part][:, None] == labels))
        need.append(np.sqrt(low1[p + at, own1[q]] + low2[p + at, own2[q]])[p + at != q])
    need = np.concatenate(need)
    return grid if not len(need) else replace(grid, reach=min(furthest, float(np.quantile(need, recall)) + 1e-9))


def units(raw: np.ndarray, dim: int) -> np.ndarray:
    """Rows of length 1 in double precision, filled up with zeros to ``dim`` components.

    Scaled by its largest component first, a finite vector's squares neither overflow nor all vanish.
    """
    v = raw.astype(np.float64)
    v /= np.abs(v).max(1)[:, None]
    v /= np.sqrt((v**2).sum(1))[:, None]
    return v if v.shape[1] == dim else np.pad(v, ((0, 0), (0, dim - v.shape[1])))


@dataclass(frozen=True)
class Block:
    """Classes of one label in the order of their cells: numbers, sizes, components as given, and rounded units along the grid's axes.

    ``head`` holds a unit's leading coordinates and the length of the others: the product of two is no less than their cosine.
    """

    cid: np.ndarray
    size: np.ndarray
    raw: np.ndarray
    unit: np.ndarray
    head: np.ndarray
    own1: np.ndarray
    own2: np.ndarray
    dim: int

    @classmethod
    def of(cls, cid: np.ndarray, size: np.ndarray, raw: np.ndarray, dim: int, grid: Grid, step: int) -> Block:
        unit, own = np.empty((len(cid), dim), np.float32), np.empty((2, len(cid)), np.int64)
        head = np.empty((len(cid), min(dim, LEADING) + 1), np.float32)
        for at in range(0, len(cid), step):
            exact = units(raw[at : at + step], dim)
            turned = exact @ grid.axes
            unit[at : at + step] = turned
            head[at : at + step, :-1] = turned[:, :LEADING]
            head[at : at + step, -1] = np.sqrt((turned[:, LEADING:] ** 2).sum(1))
            own[:, at : at + step] = grid.bounds(exact)[:2]
        by = np.lexsort((cid, own[1], own[0]))
        return cls(cid[by], size[by], raw[by], unit[by], head[by], own[0][by], own[1][by], dim)

    def cells(self, most: int) -> list[tuple[int, list]]:
        """By code of the first half: (code of the second half, (from, to)) of each cell, in pieces of ``most`` rows."""
        starts = np.flatnonzero(np.r_[True, (np.diff(self.own1) != 0) | (np.diff(self.own2) != 0)])
        out: dict[int, list] = {}
        for at, to in zip(starts, np.r_[starts[1:], len(self.cid)], strict=True):
            out.setdefault(int(self.own1[at]), []).extend((int(self.own2[at]), (k, min(k + most, to))) for k in range(at, to, most))
        return list(out.items())

    def linked(self, rows: np.ndarray, other: Block, to: np.ndarray, threshold: float) -> np.ndarray:
        """Whether the cosine in double precision is ``threshold`` or more, pair by pair."""
        out = np.empty(len(rows), bool)
        for at in range(0, len(rows), 8192):
            k = slice(at, at + 8192)
            out[k] = (units(self.raw[rows[k]], self.dim) * units(other.raw[to[k]], self.dim)).sum(1) >= threshold
        return out

    def visited_by(self, rows: np.ndarray, other: Block, to: np.ndarray, grid: Grid) -> np.ndarray:
        """Whether ``other``'s vector visits the cell of this block's, pair by pair."""
        out = np.empty(len(rows), bool)
        for at in range(0, len(rows), 8192):
            k = slice(at, at + 8192)
            _, _, low1, low2 = grid.bounds(units(other.raw[to[k]], self.dim))
            own = np.arange(len(low1))
            out[k] = low1[own, self.own1[rows[k]]] + low2[own, self.own2[rows[k]]] <= grid.reach**2
        return out


def meetings(index: Block, asking: Block, grid: Grid, threshold: float, block: int, queries: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs (row of ``asking``, row of ``index``) of which the first visits the second's cell.

    Heads rule out most pairs, products of rounded units all others but those that lie within rounding of the threshold, which are computed anew.
    """
    slack = (index.dim + 8) * 1.2e-7
    cells = index.cells(block)
    for at in range(0, len(asking.cid), queries):
        _, _, low1, low2 = grid.bounds(units(asking.raw[at : at + queries], index.dim))
        for (start, end), rows in grid.visits(low1, low2, cells):
            if asking is index and grid.reach >= furthest_link(threshold):
                rows = rows[np.searchsorted(rows, start + 1 - at) :]  # the later ask the earlier
            rows = rows + at
            hit = np.flatnonzero(asking.head[rows] @ index.head[start:end].T >= threshold - slack)
            if not len(hit):
                continue
            p, q = rows[hit // (end - start)], start + hit % (end - start)
            if 64 * len(hit) > len(rows) * (end - start):
                cosine = (asking.unit[rows] @ index.unit[start:end].T).ravel()[hit]
            else:
                cosine = np.einsum("ij,ij->i", asking.unit[p], index.unit[q])
            sure = cosine >= threshold + slack
            close = np.flatnonzero(~sure & (cosine >= threshold - slack))
            sure[close] = asking.linked(p[close], index, q[close], threshold)
            yield p[sure], q[sure]


def pairs(index: Block, asking: Block, grid: Grid, threshold: float, block: int, queries: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each linked pair once of which one visits the other's cell, as rows of ``asking`` and ``index``.

    At the reach of the threshold both ends of a link visit each other, so one side asks; below it, both do.
    """
    both = grid.reach < furthest_link(threshold)
    for p, q in meetings(index, asking, grid, threshold, block, queries):
        if asking is index:
            once = p > q
            if both:
                once |= (p != q) & ~asking.visited_by(p, index, q, grid)
            p, q = p[once], q[once]
        yield p, q
    if both and asking is not index:
        for q, p in meetings(asking, index, grid, threshold, block, queries):
            once = ~index.visited_by(q, asking, p, grid)
            yield p[once], q[once]


def links_and_roots(index: Block, asking: Block, found: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the linked classes, vectors that each is linked with, and a class of the same component."""
    shift = 0 if asking is index else len(index.cid)
    cid, size = (index.cid, index.size) if asking is index else (np.r_[index.cid, asking.cid], np.r_[index.size, asking.size])
    links, root = np.zeros(len(cid)), np.arange(len(cid))
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def count() -> None:
        nonlocal root
        p, q = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        np.add(links, np.bincount(p, size[q], len(cid)), out=links)
        np.add(links, np.bincount(q, size[p], len(cid)), out=links)
        a, b = root[p], root[q]
        if (apart := a != b).any():
            root = local_roots(len(cid), a[apart], b[apart])[root]

    for p, q in found:
        if len(p):
            held.append((p + shift, q))
        if sum(len(x) for x, _ in held) >= PAIRS:
            count()
    if held:
        count()
    has = np.flatnonzero(links)
    return cid[has], links[has].astype(np.int64), cid[root[has]]


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """Inside, a query's shuffle files go when it ends; for tables that are written once and then read."""
    before = spark.conf.get(FREEING, None)
    spark.conf.set(FREEING, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREEING)
        else:
            spark.conf.set(FREEING, before)


def digests(vectors: pa.Array) -> pa.Array:
    """MD5 of each vector's components as doubles; zeros have no sign."""
    x = (vectors.flatten().to_numpy(zero_copy_only=False).astype("<f8") + 0.0).view(np.uint8)
    ends = 8 * np.r_[0, np.cumsum(vectors.value_lengths().fill_null(0).to_numpy())]
    return pa.array([hashlib.md5(x[a:b], usedforsecurity=False).digest() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())


def _usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def near_vectors(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    threshold: float = 0.98,
    recall: float = 1.0,
    sample: int = 8192,
    codes: int | None = None,
    block: int = 512,
    queries: int = 8192,
    held: int = 32 << 20,
) -> DataFrame:
    """One row per vector: ``key``, ``n_links``, ``component_id``, ``kept``.

    Vectors of equal, non-NULL label are linked when their cosine in double precision is
    ``threshold`` or more, vectors of different length never. Vectors that are NULL, empty or
    zero, or hold NULL or non-finite numbers link with nothing. Lengths between two powers of 2 are compared
    in one run, the shorter ones filled up with zeros, so there are as many runs as such ranges hold vectors.
    ``component_id`` is the smallest key that links lead to; ``kept`` marks its row. Keys should be
    unique; rows that repeat a key count as vectors of their own and share its component. A NULL key has
    no component of its own but links others.

    Equal vectors of a label form a class, and classes are compared. Codebooks are fitted on
    at most ``sample`` classes, those of the smallest hash; every class is indexed. A class visits the cells
    within reach of it, and meets there the classes of its label in blocks of ``block`` by ``queries``;
    only counts and a spanning edge a class leave a task. With ``recall`` below 1 the reach is
    the one that finds that share of the sample's pairs, and a pair found from one side counts for both.

    A label's classes are dealt into groups of about ``held`` bytes at most (no more than four groups a label, nor
    smaller ones than 8,192 classes, unless ``held`` wants it), and two groups meet in a task. So a vector is sent once for
    each group of its label, ``COPIES`` times a round; links are written and the round's shuffle files are gone before the next begins.
    """
    kind = vectors.select(F.col(vector)).schema[0].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    rows = vectors.select(
        F.col(key).alias("key"),
        F.struct(F.col(label).alias("label"), F.size(vector).alias("length")).alias("label"),
        F.col(vector).cast("array<float>" if single else "array<double>").alias("v"),
        (F.col(label).isNotNull() & _usable(F.col(vector).cast("array<double>"))).alias("ok"),
    ).withColumn("range", F.when(F.col("ok"), F.ceil(F.log2(F.size("v"))).cast("int")))
    alone = rows.where(~F.col("ok"))
    out = alone.select(F.col("key").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"), F.lit(True).alias("kept"))
    ranges = rows.where("ok").groupBy("range").agg(F.max("label.length").alias("d")).orderBy("range").collect()  # one row per power of 2
    for r in ranges:
        own = rows.where(F.col("ok") & (F.col("range") == r["range"])).select("key", "label", "v")
        out = out.unionByName(_linked(own, key, max(2, r["d"]), threshold, recall, sample, codes, block, queries, held))
    return out


def _linked(
    rows: DataFrame, key: str, dim: int, threshold: float, recall: float, sample: int, codes: int | None, block: int, queries: int, held: int
) -> DataFrame:
    """``near_vectors`` for usable vectors of up to ``dim`` components; ``label`` holds label and length."""
    spark = rows.sparkSession
    kind = np.dtype("<f4" if isinstance(rows.schema["v"].dataType.elementType, T.FloatType) else "<f8")
    # never NULL, so that no join looks for NULLs by hashing once more
    keyed = rows.withColumn("vec_hash", F.coalesce(F.arrow_udf(digests, "binary")("v"), F.lit(b"")))
    with freeing(spark):
        classes = stored(
            keyed.groupBy("label", "vec_hash")
            .agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("size"), F.first("v").alias("v"))
            .withColumn("cid", F.monotonically_increasing_id()),
            "vectors",
        )
        found = _links(spark, classes, dim, kind, threshold, recall, sample, codes, block, queries, held)
        roots = components(found, "cid", "near").withColumnRenamed("node", "cid")
    linked = classes.select("cid", "key").join(roots, "cid")
    heads = linked.groupBy("root").agg(F.min("key").alias("component_id"))
    counted = linked.select("cid", "root").join(heads, "root").join(found.groupBy("cid").agg(F.sum("links").alias("links")), "cid")
    known = classes.select("cid", "label", "vec_hash", "key", "size").join(counted, "cid", "left").select(
        "label",
        "vec_hash",
        F.coalesce("component_id", "key").alias("component_id"),
        (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
    )
    return keyed.select("key", "label", "vec_hash").join(known, ["label", "vec_hash"]).select(
        F.col("key").alias(key), "n_links", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept")
    )


def _grid_of(classes: DataFrame, n: int, dim: int, sample: int, codes: int, threshold: float, recall: float) -> Grid:
    """The grid of the ``sample`` classes of the smallest hash, of ``n``."""
    place = F.xxhash64("vec_hash")
    few = classes if n < 4 * sample else classes.where(place < F.lit(int(-(2**63) + 2**65 * sample / n)))  # twice as many as wanted
    seen = few.orderBy(place, "label").limit(sample).select("v", F.xxhash64("label").alias("l")).collect()
    raw = np.array([r["v"] + [0.0] * (dim - len(r["v"])) for r in seen], dtype=np.float64)
    return grid_for(units(raw, dim), np.array([r["l"] for r in seen]), codes, threshold, recall)


def _links(
    spark: SparkSession,
    classes: DataFrame,
    dim: int,
    kind: np.dtype,
    threshold: float,
    recall: float,
    sample: int,
    codes: int | None,
    block: int,
    queries: int,
    held: int,
) -> DataFrame:
    """``cid``, ``links`` and a class ``near`` it, for each task in which a class met links."""
    counts = classes.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    largest = counts.agg(F.max("n")).first()[0]
    most = max(1, min(held // (dim * kind.itemsize), max(8192, -(-largest // 4))))
    groups = F.expr(f"cast(ceil(n / {most}) as int)")
    of_all = counts.select("n", groups.cast("long").alias("g")).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("g")).alias("sent"), F.sum(F.expr("g * (g + 1) / 2")).alias("tasks")
    )
    total = of_all.first()
    rounds = -(-total["sent"] // (COPIES * total["n"]))
    tasks = min(2000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(2 * total["tasks"] / rounds)))
    grid = _grid_of(classes, total["n"], dim, sample, codes or max(2, min(256, math.isqrt(most // 64))), threshold, recall)
    sent = spark.sparkContext.broadcast(astuple(grid))
    # labels of several groups: at most a row for each ``most`` classes
    split = stored(counts.where(F.col("n") > most).select("label", groups.alias("groups")), "vector_groups")
    dealt = (
        classes.select("cid", "label", "size", "v")
        .join(F.broadcast(split), "label", "left")
        .withColumn("groups", F.coalesce("groups", F.lit(1)))
        .select(F.xxhash64("label").alias("l"), "groups", F.pmod(F.xxhash64("cid"), F.col("groups")).cast("int").alias("own"), "cid", "size", "v")
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each group that a batch has classes of."""
        for batch in batches:
            if not batch.num_rows:
                continue
            by = np.lexsort((batch["own"].to_numpy(), batch["l"].to_numpy()))
            batch = batch.take(pa.array(by))
            l, own, groups, cid, size = (batch[c].to_numpy() for c in ("l", "own", "groups", "cid", "size"))
            values = batch["v"].flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
            ends = np.r_[0, np.cumsum(batch["v"].value_lengths().to_numpy())]
            starts = np.flatnonzero(np.r_[True, (np.diff(l) != 0) | (np.diff(own) != 0)])
            runs_of = list(zip(starts, np.r_[starts[1:], len(l)], strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(l[starts]),
                    pa.array(groups[starts]),
                    pa.array(own[starts]),
                    pa.array([cid[a:b].astype("<i8").tobytes() for a, b in runs_of], pa.binary()),
                    pa.array([size[a:b].astype("<i8").tobytes() for a, b in runs_of], pa.binary()),
                    pa.array([values[ends[a] : ends[b]].tobytes() for a, b in runs_of], pa.binary()),
                ],
                names=["l", "groups", "own", "cid", "size", "v"],
            )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Grid(*sent.value)

        def block_of(part: pa.Table) -> Block:
            cid, size, v = (np.frombuffer(b"".join(part[c].to_pylist()), t) for c, t in (("cid", "<i8"), ("size", "<i8"), ("v", kind)))
            return Block.of(cid, size, v.reshape(len(cid), -1), dim, own, queries)

        for table in runs(batches, ["l", "i", "j"]):
            split = int(np.searchsorted(table["asks"].to_numpy(), 1))
            alone = table["i"][0] == table["j"][0]
            if not alone and split in (0, table.num_rows):
                continue
            index = block_of(table.slice(0, split))
            asking = index if alone else block_of(table.slice(split))
            cid, links, near = links_and_roots(index, asking, pairs(index, asking, own, threshold, block, queries))
            if len(cid):
                yield pa.RecordBatch.from_arrays([pa.array(cid), pa.array(links), pa.array(near)], names=["cid", "links", "near"])

    packed = dealt.mapInArrow(pack, "l long, groups int, own int, cid binary, size binary, v binary")
    met = (
        packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
        .select(
            "l",
            F.least("own", "other").alias("i"),
            F.greatest("own", "other").alias("j"),
            F.expr("cast(own > other as int)").alias("asks"),
            "cid",
            "size",
            "v",
        )
    )
    path = scratch_path(spark, "vector_links")
    for k in range(rounds):
        now = met.where((F.expr("cast(j as long) * (j + 1) div 2 + i") % rounds) == k)
        now = now.repartition(tasks, "l", "i", "j").sortWithinPartitions("l", "i", "j", "asks")
        now.mapInArrow(compare, "cid long, links long, near long").write.mode("append").parquet(path)
    return spark.read.schema("cid long, links long, near long").parquet(path)
