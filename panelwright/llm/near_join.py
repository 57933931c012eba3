"""Documents joined by the Jaccard similarity of their word n-grams.

Method: Bayesian candidate pruning. MinHash values of candidate pairs are compared a few at a
time, a pair is dropped when the posterior probability of reaching the threshold falls below a
tolerance, and the rest is verified exactly.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, stored, text_of
from .graph import components, local_roots, runs
from .text_arrays import LOWER, Texts, U, gram_hashes, mixed, texts

VALUES, ROWS = 128, 4  # MinHash values, and how many make a band
STEP = 16  # values compared between two looks at the posterior
_A = mixed(np.arange(1, VALUES + 1).astype(U)) | U(1)
_B = mixed(np.arange(1001, VALUES + 1001).astype(U))


def shingle_sets(batch: Texts, n: int) -> list[np.ndarray]:
    """The distinct n-grams of each text's words as sorted 64-bit hashes.

    Words are runs without ASCII white space, A-Z in lower case. A text of fewer than n words
    has one n-gram, all its words; one without words has none.
    """
    begin, end, first = batch.words()
    words = batch.span_hashes(batch.prefix_hashes(LOWER[batch.data]), begin, end)
    grams = mixed(gram_hashes(words, n))
    out = []
    for i in range(len(batch)):
        a, z = first[i], first[i + 1]
        if z - a >= n:
            out.append(np.unique(grams[a : z - n + 1]))
        else:
            out.append(mixed(gram_hashes(words[a:z], int(z - a)) + U(z - a)) if z > a else np.zeros(0, U))
    return out


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 32-bit MinHash values for each set; sets must not be empty."""
    starts = np.cumsum([0, *map(len, sets[:-1])])
    joined = np.concatenate(sets)
    out = np.empty((len(sets), VALUES), np.uint32)
    for k in range(VALUES):
        out[:, k] = np.minimum.reduceat(((joined * _A[k] + _B[k]) >> U(32)).astype(np.uint32), starts)
    return out


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For 16, 32, ... compared values: the fewest matches a pair needs to stay.

    With m of k values equal and every similarity as likely beforehand, the similarity has a
    Beta(m + 1, k - m + 1) posterior, which exceeds t as often as k + 1 tosses of a t-coin show at most m heads.
    """
    out = []
    for k in range(STEP, VALUES + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance and m < k:
            m += 1
            tail += math.comb(k + 1, m) * threshold**m * (1 - threshold) ** (k + 1 - m)
        out.append(m)
    return out


def plausible(x: np.ndarray, y: np.ndarray, least: list[int]) -> np.ndarray:
    """Which rows of two equally long MinHash tables survive the incremental comparison."""
    alive, matches = np.arange(len(x)), np.zeros(len(x), np.int64)
    for turn, need in enumerate(least):
        part = slice(turn * STEP, (turn + 1) * STEP)
        matches[alive] += (x[alive, part] == y[alive, part]).sum(axis=1)
        alive = alive[matches[alive] >= need]
    return alive


def signed(docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """``key``, the hash of the text, the identity of its n-gram set, its size and its MinHash values."""
    schema = T.StructType(
        [
            T.StructField("key", docs.schema[key].dataType),
            T.StructField("text_hash", T.LongType()),
            T.StructField("set_id", T.BinaryType()),
            T.StructField("n", T.LongType()),
            T.StructField("minhash", T.BinaryType()),
        ]
    )

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, own in texts(batches, "text"):
            sets = shingle_sets(own, n)
            full = [s for s in sets if len(s)]
            values = iter(minhashes(full)) if full else iter(())
            found = [next(values).tobytes() if len(s) else None for s in sets]
            ids = [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"),
                    batch.column("text_hash"),
                    pa.array(ids, pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(found, pa.binary()),
                ],
                names=schema.names,
            )

    return docs.select(
        F.col(key).alias("key"), F.xxhash64(text_of(text)).alias("text_hash"), F.col(text).cast("binary").alias("text")
    ).mapInArrow(sign, schema)


def _candidates(classes: DataFrame, threshold: float, tolerance: float, small: int) -> DataFrame:
    """Edges (a, b) between classes that share a band of MinHash values, at most one a class and band.

    The classes of a bucket of up to ``small`` are compared pair by pair where they meet, a few values at a
    time, and a spanning forest of the pairs that survive leaves the task. In a larger
    bucket every class gets an edge to the smallest; its pairs are compared in blocks later.
    """
    parts = VALUES // ROWS
    bands = classes.select(
        "cid",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.lit(parts - 1)),
                lambda i: F.xxhash64(i, F.substring(F.col("minhash"), i * (4 * ROWS) + 1, F.lit(4 * ROWS))),
            )
        ).alias("bucket"),
    )
    sizes = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.min("cid").alias("first")).where("m > 1")
    shared = bands.join(sizes, "bucket")
    stars = shared.where(F.col("m") > small).where("cid <> first").select(F.col("first").alias("a"), F.col("cid").alias("b")).distinct()
    met = (
        shared.where(F.col("m") <= small)
        .select("bucket", "cid")
        .join(classes.select("cid", "n", "minhash"), "cid")
        .repartition("bucket")
        .sortWithinPartitions("bucket", "cid")
    )
    least = least_matches(threshold, tolerance)

    def forest(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        bucket, cid, n = (table[c].to_numpy() for c in ("bucket", "cid", "n"))
        values = np.frombuffer(b"".join(table["minhash"].to_pylist()), np.uint32).reshape(-1, VALUES)
        p, q, at, apart = [], [], np.arange(len(cid)), 1
        while len(at := at[at + apart < len(cid)]) and len(at := at[bucket[at] == bucket[at + apart]]):
            near = at[np.minimum(n[at], n[at + apart]) >= threshold * np.maximum(n[at], n[at + apart]) - 1e-9]
            near = near[plausible(values[near], values[near + apart], least)]
            p.append(near)
            q.append(near + apart)
            apart += 1
        p, q = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (p, q))
        roots = local_roots(len(cid), p, q)  # rows of different buckets are never joined
        own = np.flatnonzero(roots != np.arange(len(cid)))
        return pa.RecordBatch.from_arrays([pa.array(cid[roots[own]]), pa.array(cid[own])], names=["a", "b"])

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # whole buckets, and the last one as far as it is known
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                bucket = part.column("bucket").to_numpy()
                last = int(np.searchsorted(bucket, bucket[-1]))
                if held and (last or held[-1].column("bucket")[-1].as_py() != bucket[0]):
                    yield forest([*held, part.slice(0, last)])
                    held = []
                elif last:
                    yield forest([part.slice(0, last)])
                held.append(part.slice(last))
        if held:
            yield forest(held)

    return met.select("bucket", "cid", "n", "minhash").mapInArrow(prune, "a long, b long").unionByName(stars)


def _links_in(table: pa.Table, least: list[int], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The linked pairs (positions in the table) of one block, or of two blocks across."""
    cid, block = table["cid"].to_numpy(), table["block"].to_numpy()
    own = np.flatnonzero(np.concatenate([[True], cid[1:] != cid[:-1]]))  # a class once, if its document is repeated
    table, cid, block = table.take(pa.array(own)), cid[own], block[own]
    sets = [np.frombuffer(s.as_py(), np.uint64) for s in table["shingles"]]
    sizes = np.array([len(s) for s in sets])
    values = np.frombuffer(b"".join(table["minhash"].to_pylist()), np.uint32).reshape(-1, VALUES)
    across = len(np.unique(block)) > 1
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    edges = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(int(ids.max()) + 1, bool)
    p, q = [], []
    for i in range(len(cid)):
        others = np.flatnonzero(block > block[i]) if across else np.arange(i + 1, len(cid))
        others = others[np.minimum(sizes[others], sizes[i]) >= threshold * np.maximum(sizes[others], sizes[i]) - 1e-9]
        if not len(others):
            continue
        others = others[plausible(np.broadcast_to(values[i], (len(others), VALUES)), values[others], least)]
        if not len(others):
            continue
        mark[ids[edges[i] : edges[i + 1]]] = True
        common = np.array([int(mark[ids[edges[j] : edges[j + 1]]].sum()) for j in others])
        mark[ids[edges[i] : edges[i + 1]]] = False
        others = others[common * (1 + threshold) >= threshold * (sizes[others] + sizes[i]) - 1e-9]
        p.append(np.full(len(others), i))
        q.append(others)
    none = np.zeros(0, np.int64)
    return own, np.concatenate(p) if p else none, np.concatenate(q) if q else none


def _verified(groups: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """Per class and block: how many documents it is linked with there, and a spanning edge."""
    least = least_matches(threshold, tolerance)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["root", "i", "j"]):
            own, p, q = _links_in(table, least, threshold)
            if not len(p):
                continue
            cid = table["cid"].to_numpy()[own]
            size = table["size"].to_numpy()[own].astype(np.float64)
            links = np.bincount(p, size[q], len(cid)) + np.bincount(q, size[p], len(cid))
            order = np.argsort(cid, kind="stable")
            place = np.empty(len(cid), np.int64)
            place[order] = np.arange(len(cid))
            roots = cid[order][local_roots(len(cid), place[p], place[q])][place]
            has = np.flatnonzero(links > 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cid[has]), pa.array(links[has].astype(np.int64)), pa.array(roots[has])],
                names=["cid", "links", "near"],
            )

    return groups.mapInArrow(verify, "cid long, links long, near long")


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    n: int = 5,
    threshold: float = 0.8,
    tolerance: float = 1e-9,
    small: int = 64,
    block: int = 256,
    most_broadcast: int = 32_000_000,
) -> DataFrame:
    """One row per document: ``key``, ``text_hash``, ``class_id``, ``n_links``, ``n_same``.

    Two documents are linked when the Jaccard similarity of their word n-gram sets is
    ``threshold`` or more; ``n_links`` counts a document's links, ``n_same`` those to equal sets, and
    ``class_id`` is the smallest key of the documents that links connect it with, itself
    included. Documents without words (NULL, empty, blank) link with nothing. Every row is a
    document, also when it repeats another; a NULL key is a key, and the smallest only where
    there is no other. Other columns of ``docs`` are not read.

    Equal sets form a class, and only classes are compared. Candidates share one of 32 bands of
    4 MinHash values: a pair at the threshold misses all of them once in 20 million. Classes of
    small buckets are compared there and pruned by the posterior, and only a spanning forest of
    the rest leaves the task; larger buckets are put into one group as they are. Groups are compared in blocks, pruned again and
    verified on whole n-gram sets, and only counts and one spanning edge a class leave a task.
    """
    sign = stored(signed(docs, key, text, n), "signed")
    classes = stored(
        sign.where("set_id IS NOT NULL")
        .groupBy("set_id")
        .agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("size"), F.first("n").alias("n"), F.first("minhash").alias("minhash"))
        .withColumn("cid", F.monotonically_increasing_id()),
        "classes",
    )
    groups = components(_candidates(classes, threshold, tolerance, small))
    blocks = groups.groupBy("root").agg(F.count(F.lit(1)).alias("m")).withColumn("nb", F.expr(f"cast((m + {block - 1}) div {block} as int)"))
    members = stored(
        groups.join(blocks, "root")
        .withColumnRenamed("node", "cid")
        .join(classes, "cid")
        .withColumn("block", F.pmod(F.xxhash64("cid"), F.col("nb")).cast("int")),
        "members",
    )
    wanted = members.select(F.col("key").alias("_key"), "set_id", "cid")
    sizes = F.sum(F.coalesce(F.octet_length(F.col("key").cast("string")), F.lit(0)) + 64)
    if (members.agg(sizes).first()[0] or 0) <= most_broadcast:  # bytes, whatever the keys hold
        wanted = F.broadcast(wanted)
    sources = docs.select(F.col(key).alias("_key"), F.col(text).cast("binary").alias("text"))
    texts_of = sources.alias("d").join(wanted.alias("w"), F.col("d._key").eqNullSafe(F.col("w._key"))).select("cid", "set_id", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, own in texts(batches, "text"):
            found = [s.tobytes() for s in shingle_sets(own, n)]
            ids = batch.column("set_id").to_pylist()
            same = [k for k, s in enumerate(found) if s and hashlib.md5(s).digest() == ids[k]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("cid").take(pa.array(same, pa.int64())), pa.array([found[k] for k in same], pa.binary())],
                names=["cid", "shingles"],
            )

    full = members.select("cid", "root", "size", "minhash", "block", "nb").join(
        texts_of.mapInArrow(sets, "cid long, shingles binary"), "cid"
    )
    met = (
        full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        .withColumn("i", F.least("block", "other"))
        .withColumn("j", F.greatest("block", "other"))
        .drop("other", "nb")
        .repartition("root", "i", "j")
        .sortWithinPartitions("root", "i", "j", "block", "cid")
    )
    found = stored(_verified(met, threshold, tolerance), "links")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = components(found, "cid", "near")
    named = classes.select("cid", "set_id", "key", "size").join(
        roots.withColumnRenamed("node", "cid"), "cid", "left"
    ).withColumn("root", F.coalesce("root", "cid"))
    heads = named.groupBy("root").agg(F.min("key").alias("class_id"))
    known = (
        named.join(heads, "root")
        .join(links, "cid", "left")
        .select("set_id", "class_id", (F.col("size") - 1).alias("n_same"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    )
    zero = F.lit(0).cast("long")
    joined = sign.where("set_id IS NOT NULL").join(known, "set_id").select("key", "text_hash", "class_id", "n_links", "n_same")
    alone = sign.where("set_id IS NULL").select("key", "text_hash", F.col("key").alias("class_id"), zero.alias("n_links"), zero.alias("n_same"))
    return joined.unionByName(alone).withColumnRenamed("key", key)


def one_of_each(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their class: the one of the smallest key.

    Rows that agree in key and text count once; texts without words all stay, each key once.
    """
    heads = found.where(F.col(key).eqNullSafe(F.col("class_id"))).select(F.col(key).alias("_key"), F.col("text_hash").alias("_hash")).distinct()
    own = free_name(docs, "_text_hash")
    marked = docs.withColumn(own, F.xxhash64(text_of(text)))
    left, right = marked.alias("d"), heads.alias("h")
    same = F.col(f"d.`{key}`").eqNullSafe(F.col("h._key")) & (F.col(f"d.{own}") == F.col("h._hash"))
    return left.join(right, same, "left_semi").dropDuplicates([key, own]).drop(own)
