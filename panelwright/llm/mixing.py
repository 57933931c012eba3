"""A mix of sources at target weights, cut into fixed-length blocks.

Method: pack tokens (here words) into fixed-length blocks; draw multinomial source counts per
output shard; map slots through per-source pseudorandom index permutations; join blocks by index.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, running_totals, stored, text_of, word_count

M64 = (1 << 64) - 1


@dataclass(frozen=True)
class Mix:
    """``documents``: the rows with ``size``, ``source_size``, ``target`` and ``first`` (words
    of the source before the document). ``slots``: the output, one row per piece of a document
    in a slot: shard, slot, source, epoch, first, start and length in words."""

    documents: DataFrame
    slots: DataFrame


def share_out(sizes: np.ndarray, weights: np.ndarray, limit: float) -> np.ndarray:
    """Targets in proportion to ``weights`` that add up to all sizes.

    A target above ``limit`` times its size stops there and the excess is shared again by
    weight, until none is above.
    """
    caps, targets = limit * sizes.astype(float), np.zeros(len(sizes))
    open_, left = sizes > 0, float(sizes.sum())
    while left > 0 and open_.any():
        given = np.where(open_, weights * (left / weights[open_].sum()), 0.0)
        over = open_ & (given > caps)
        if not over.any():
            return targets + given
        targets[over] = caps[over]
        left -= caps[over].sum()
        open_ &= ~over
    return targets


def drawn_slots(counts: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """How many of ``n`` slots fall to each source when ``counts`` are dealt without replacement."""
    out, rest = np.zeros_like(counts), int(counts.sum())
    for s, own in enumerate(counts.tolist()):
        others = rest - own
        if rest < 1_000_000_000:
            got = int(rng.hypergeometric(own, others, n)) if n and own else 0
        else:  # numpy draws up to here; the normal law is as good beyond
            share = own / rest
            spread = np.sqrt(n * share * (1 - share) * (rest - n) / (rest - 1))
            got = int(min(max(round(rng.normal(n * share, spread)), n - others, 0), own, n))
        out[s], n, rest = got, n - got, others
    return out


def shard_counts(
    slots: np.ndarray, per_shard: int, seed: int, first: int = 0, last: int | None = None
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Multinomial source counts of the output shards from ``first`` up to ``last``, given that all use up ``slots``.

    Each shard comes with what the shards before it take of each source. Slots are split over halves of the
    shards, halves of these and so on, by draws seeded with the range; a task descends only to its own shards.
    """
    total = int(slots.sum())
    shards = -(-total // per_shard)
    last = shards if last is None else min(last, shards)

    def walk(low: int, high: int, begun: np.ndarray, counts: np.ndarray):
        if high <= first or low >= last:
            return
        if high - low == 1:
            yield low, begun, counts
            return
        middle = (low + high) // 2
        left = drawn_slots(counts, (middle - low) * per_shard, np.random.default_rng([seed, low, high]))
        yield from walk(low, middle, begun, left)
        yield from walk(middle, high, begun + left, counts - left)

    if shards:
        yield from walk(0, shards, np.zeros(len(slots), np.int64), slots.astype(np.int64))


def permuted(n: np.ndarray, index: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The image of ``index`` under a pseudorandom permutation of 0..n-1 chosen by ``key``.

    A Feistel network over the next even number of bits; images outside the range are mapped
    again until they fall inside. Every row has its own n and key.
    """
    n, out, key = n.astype(np.uint64), index.astype(np.uint64).copy(), key.astype(np.uint64)
    half = np.ones(len(n), np.uint64)
    while (short := (np.uint64(1) << (half * np.uint64(2))) < n).any():
        half[short] += np.uint64(1)
    mask = (np.uint64(1) << half) - np.uint64(1)
    todo = np.arange(len(n))
    with np.errstate(over="ignore"):
        while len(todo):
            h, m, k = half[todo], mask[todo], key[todo]
            low, high = out[todo] & m, out[todo] >> h
            for turn in range(4):
                x = (low + k + np.uint64(turn * 0x9E3779B97F4A7C15 & M64)) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
                low, high = high ^ ((x ^ (x >> np.uint64(29))) & m), low
            out[todo] = (high << h) | low
            todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def slot_plan(
    spark: SparkSession,
    sizes: np.ndarray,
    words: np.ndarray,
    block: int,
    per_shard: int,
    seed: int,
    together: int = 256,
) -> DataFrame:
    """Every slot of the output: shard, slot, source_id, epoch, block and the words taken of the block.

    ``words`` of each source's ``sizes`` are dealt: whole rounds over its blocks, then a part of one. Each row of
    the range draws ``together`` shards and sends the slots of one at a time. A task runs this in one Python
    worker, since another beside it would stay on the executor and take up memory in later stages.
    """
    blocks = -(-sizes // block)
    rounds, rest = np.divmod(words, np.maximum(sizes, 1))
    slots = rounds * blocks + -(-rest // block)
    groups = -(-(-(-int(slots.sum()) // per_shard)) // together)
    epochs = -(-slots // np.maximum(blocks, 1))  # begun ones; a permutation has a key for each
    at = np.cumsum(epochs) - epochs
    source = np.repeat(np.arange(len(sizes)), epochs)
    asked = pa.table(
        {"source_id": pa.array(source, pa.int32()), "epoch": pa.array(np.arange(len(source)) - at[source], pa.int64())}
    )
    hashed = spark.createDataFrame(asked).select("*", F.xxhash64(F.lit(seed), "source_id", "epoch").alias("key"))
    keys = np.array([r["key"] for r in sorted(hashed.collect())], dtype=np.int64)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g in batch.column("id").to_pylist():
                for shard, begun, counts in shard_counts(slots, per_shard, seed, g * together, (g + 1) * together):
                    s = np.repeat(np.arange(len(counts)), counts)
                    slot = np.arange(len(s)) - (np.cumsum(counts) - counts)[s]
                    epoch, index = np.divmod(begun[s] + slot, blocks[s])
                    image, inner = index.copy(), index < blocks[s] - 1
                    # the source's last block, which may be short, keeps the last place
                    image[inner] = permuted((blocks[s] - 1)[inner], index[inner], keys[at[s] + epoch][inner])
                    taken = np.where(epoch == rounds[s], np.minimum(block, rest[s] - index * block), block)
                    whole = [pa.array(x, pa.int64()) for x in (slot, epoch, image, taken)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(s), shard), pa.int32()), whole[0], pa.array(s, pa.int32()), *whole[1:]],
                        names=["shard", "slot", "source_id", "epoch", "block", "taken"],
                    )

    return spark.range(groups).mapInArrow(
        draw, "shard int, slot long, source_id int, epoch long, block long, taken long"
    )


def mix(
    docs: DataFrame,
    key: Sequence[str] = ("doc_id",),
    weights: Sequence[float] = (1, 2, 3),
    limit: float = 3.0,
    block: int = 1024,
    per_shard: int = 4096,
    seed: int = 20_240_501,
) -> Mix:
    """Mix all documents so that each source gives its target of words.

    Sources in code point order, NULL last, weigh ``weights`` in turn; targets follow
    ``share_out``. A source's words, document after document in a hashed order, are cut into
    blocks of ``block`` words. Its target takes whole rounds over all blocks and then the first
    blocks of a permutation drawn anew for each round, the last one cut, so a source gives
    its target rounded to whole words, and no block is taken more often than ``limit`` rounded up.

    A NULL or empty text has no words: the row stays in ``documents`` and is never taken. An
    empty table, or one without words, gives an empty mix. Rows equal in ``key``, source and
    text are separate documents. ``docs`` needs ``text`` and ``source``; only these and ``key``
    are carried. One row per source (name, two counts) and a key per source and round reach the driver;
    documents, blocks and the draws of the shards do not.
    """
    spark = docs.sparkSession
    sized = stored(
        docs.select(
            *key,
            "source",
            word_count().alias("size"),
            F.xxhash64(text_of()).alias("text_hash"),
        ),
        "sizes",
    )
    found = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")).collect()
    found.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = np.array([r["size"] for r in found], dtype=np.int64)
    weight = np.array([weights[i % len(weights)] for i in range(len(found))], dtype=float)
    targets = share_out(sizes, weight, limit)
    totals = spark.createDataFrame(
        pa.table(
            {
                "source": pa.array([r.source for r in found], pa.string()),
                "source_id": pa.array(np.arange(len(found)), pa.int32()),
                "source_size": pa.array(sizes, pa.int64()),
                "target": pa.array(targets, pa.float64()),
            }
        )
    )
    known = sized.alias("d").join(
        totals.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))
    ).select("d.*", "source_id", "source_size", "target")
    placed = stored(
        running_totals(
            known, ["source_id"], [*key, "text_hash"], F.col("size"), "first", sum(r.rows for r in found)
        ),
        "placed",
    )

    words = np.rint(np.minimum(targets, limit * sizes)).astype(np.int64)
    at = slot_plan(spark, sizes, words, block, per_shard, seed)
    pieces = (
        placed.where("size > 0")
        .select(*key, "source_id", "source", "text_hash", "first", "size")
        .withColumn("block", F.explode(F.expr(f"sequence(first div {block}, (first + size - 1) div {block})")))
        .withColumn("begin", F.greatest(F.col("first"), F.col("block") * block))
        .withColumn("end", F.least(F.col("first") + F.col("size"), (F.col("block") + 1) * block))
    )
    mixed = (
        pieces.join(at.hint("merge"), ["source_id", "block"])  # a range's estimated size says nothing of the slots
        .withColumn("end", F.least("end", F.col("block") * block + F.col("taken")))
        .where("end > begin")
        .select(
            "shard",
            "slot",
            "epoch",
            *key,
            "source_id",
            "source",
            "text_hash",
            "first",
            (F.col("begin") - F.col("first")).alias("start"),
            (F.col("end") - F.col("begin")).alias("length"),
            "size",
        )
    )
    return Mix(placed, mixed)


def taken_words(mixed: Mix) -> DataFrame:
    """``documents`` with ``taken``: the words the mix takes of each, repeats counted."""
    takes = mixed.slots.groupBy("source_id", "first").agg(F.sum("length").alias("taken"))
    empty, full = mixed.documents.where("size = 0"), mixed.documents.where("size > 0")
    return (
        full.join(takes, ["source_id", "first"], "left")
        .withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))
        .unionByName(empty.withColumn("taken", F.lit(0).cast("long")))
    )


def mixed_texts(docs: DataFrame, mixed: Mix, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The mix as rows like those of ``docs``: a document once per round that takes words of it.

    A row's text is made of the pieces taken in that round, in order, white space inside
    them kept; a document taken whole keeps its text unchanged. Documents are found again by
    ``key``, source and the hash of the text; copies equal in all of them share what they give,
    each in its turn.
    """
    rounds = (
        mixed.slots.groupBy(*key, "source", "text_hash", "first", "size", "epoch")
        .agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("_pieces"), F.sum("length").alias("_n"))
        .drop("first", "epoch")
        .alias("m")
    )
    hashed = free_name(docs, "_hash")
    own = docs.withColumn(hashed, F.xxhash64(text_of()))
    # of rows equal in all of key, source and text, one stands for all: each has its rounds of its own
    own = own.dropDuplicates([*key, "source", hashed]).alias("d")
    same = F.col(f"d.{hashed}") == F.col("m.text_hash")
    for k in [*key, "source"]:
        same = same & F.col(f"d.{k}").eqNullSafe(F.col(f"m.{k}"))
    words = F.regexp_extract_all(F.col("d.text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.array_join(
        F.transform("m._pieces", lambda p: F.array_join(F.slice(words, p["start"] + 1, p["length"]), "")), ""
    )
    text = F.when(F.col("m._n") == F.col("m.size"), F.col("d.text")).otherwise(
        F.btrim(cut, F.lit("\t\n\x0b\x0c\r "))
    )
    made = free_name(docs, "_text")
    out = own.join(rounds, same).select("d.*", text.alias(made))
    return out.select(
        *[
            F.col(made).alias(c) if c == "text" else F.char_length(made).cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`")
            for c in docs.columns
        ]
    )
