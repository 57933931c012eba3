"""Documents packed into token sequences with little padding.

Method: cutting-stock column generation. A linear program over patterns of a length histogram,
priced by knapsack dynamic programming; rounded patterns are assigned to ranked pieces.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, running_totals, stored
from .cutting_stock import patterns_for


class _TextIds(dict):
    """Token ids of texts as little-endian 32-bit numbers; parts met lately are remembered.

    In a text of Latin letters, digits and common punctuation, lower-casing and normalisation
    treat each character alone, so the parts that the tokenizer forms are found by one
    expression, and the tokenizer's model sees each different part once. Any other text goes
    through the tokenizer word by word: none of its parts crosses ASCII white space.

    At most twice ``limit`` parts are held: a full generation becomes the older one, from which
    parts that are met again return, and the rest is let go with the next.
    """

    #: The tokenizer's own part rule, written for the characters of ``plain``.
    plain = re.compile(r"[\x09-\x0D\x20-\x7E¡¿«»À-ÖØ-öø-ÿ]*")
    parts = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\x09-\x0D\x20a-z0-9ß-öø-ÿ]+")

    def __init__(self, path: str, limit: int = 200_000) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.limit, self.words, self.older = Tokenizer.from_file(path), limit, {}, {}
        self.bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def __missing__(self, part: str) -> bytes:
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        found = self.older.get(part)
        if found is None:
            mapped = part if part.isascii() else self.bytes.pre_tokenize_str(part)[0][0]
            found = b"".join([t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(mapped)])
        if len(part) < 64:
            self[part] = found
        return found

    def word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            if len(self.words) >= self.limit // 5:
                self.words.clear()
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
            found = b"".join([i.to_bytes(4, "little") for i in ids])
            if len(word) < 64:
                self.words[word] = found
        return found

    def forget(self) -> None:
        """Lets go of all parts, so that a Python worker holds none between tasks."""
        self.clear()
        self.words.clear()
        self.older = {}

    def of(self, text: str) -> bytes:
        if "<|" not in text and self.plain.fullmatch(text):
            return b"".join(map(self.__getitem__, self.parts.findall(text.lower())))
        return b"".join(map(self.word, _WORDS.findall(text)))


_WORDS = re.compile(WORD)
_TEXT_IDS: dict[str, _TextIds] = {}


def token_pieces(
    docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 4096, text: str = "text"
) -> DataFrame:
    """Cut every document's token ids into pieces of ``capacity`` and a remainder.

    One row per piece, with the other columns of ``docs`` and ``start``, ``length``,
    ``doc_tokens`` and ``ids`` (little-endian unsigned 32-bit). A NULL text counts as empty;
    every document ends with ``end_id``, so an empty one is a piece of one id. ``tokenizer``
    is the path of a word-level tokenizer file; texts are read whole, a batch at a time.
    """
    others = [f for f in docs.schema.fields if f.name != text]
    schema = T.StructType(
        [*others]
        + [T.StructField(n, T.LongType()) for n in ("start", "length", "doc_tokens")]
        + [T.StructField("ids", T.BinaryType())]
    )
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _TEXT_IDS:
            _TEXT_IDS[tokenizer] = _TextIds(tokenizer)
        ids_of = _TEXT_IDS[tokenizer].of
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    rows, starts, lengths, totals, ids = [], [], [], [], []
                    for i, value in enumerate(part.column(text).to_pylist()):
                        found = ids_of(value or "") + end
                        total = len(found) // 4
                        for start in range(0, total, capacity):
                            rows.append(i)
                            starts.append(start)
                            lengths.append(min(capacity, total - start))
                            totals.append(total)
                            ids.append(found[4 * start : 4 * (start + capacity)])
                    kept = part.select([f.name for f in others]).take(pa.array(rows, pa.int64()))
                    new = [pa.array(x, pa.int64()) for x in (starts, lengths, totals)]
                    yield pa.RecordBatch.from_arrays(
                        [*kept.columns, *new, pa.array(ids, pa.binary())], names=[f.name for f in schema.fields]
                    )
        finally:
            _TEXT_IDS[tokenizer].forget()

    return docs.select(*[f.name for f in others], text).mapInArrow(cut, schema)


def pack_pieces(
    pieces: DataFrame, order: Sequence[str], capacity: int = 4096, grain: int = 16, length: str = "length"
) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to every piece; no sequence exceeds ``capacity``.

    Lengths are rounded up to a multiple of ``grain`` for the histogram, whose size is thereby
    bounded by capacity / grain, and sequences are planned on it. Pieces are ranked within
    their length by ``order`` through hash buckets, and the rank says which sequence of which
    pattern takes the piece. Only the histogram and the patterns reach the driver. Pieces
    equal in ``order`` are interchangeable; ``pieces`` is read several times and must not change.
    An empty table gives an empty table. A piece longer than ``capacity`` or shorter than 1 is an error.
    """
    spark = pieces.sparkSession
    units = capacity // grain
    sized = pieces.withColumn(
        "_units",
        F.when(F.col(length).between(1, capacity), F.expr(f"cast((`{length}` + {grain - 1}) div {grain} as int)"))
        .otherwise(F.raise_error(F.lit("a piece does not fit"))),
    )
    counts = {r["_units"]: r["n"] for r in sized.groupBy("_units").agg(F.count(F.lit(1)).alias("n")).collect()}
    ranked = running_totals(sized, ["_units"], order, F.lit(1), "_rank", sum(counts.values()))
    places, taken, sequence = [], defaultdict(int), 0
    for pattern, times in patterns_for(counts, units):
        for size, each in pattern.items():
            places.append((size, taken[size], taken[size] + each * times, sequence, each))
            taken[size] += each * times
        sequence += times
    names, kinds = ["_u", "_from", "_to", "_sequence", "_each"], [pa.int32(), *[pa.int64()] * 4]
    plan = spark.createDataFrame(
        pa.table([pa.array([p[i] for p in places], kind) for i, kind in enumerate(kinds)], names=names)
    )
    # at most capacity / grain lengths in as many patterns
    on = (F.col("_units") == F.col("_u")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    placed = (
        ranked.join(F.broadcast(plan), on)
        .withColumn("sequence_id", F.expr("_sequence + (_rank - _from) div _each"))
        .withColumn("_turn", F.expr("(_rank - _from) % _each"))
    )
    earlier = (
        Window.partitionBy("sequence_id")
        .orderBy(F.desc("_units"), "_turn")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return placed.withColumn("offset", F.coalesce(F.sum(length).over(earlier), F.lit(0).cast("long"))).select(
        *pieces.columns, "sequence_id", "offset"
    )


def crc32_of_ids(ids: str = "ids"):
    return F.crc32(F.col(ids)).cast("long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096) -> DataFrame:
    """``token_pieces`` and ``pack_pieces`` with the ids reduced to their checksum.

    The pieces are stored without ids, so the passes over them move a few numbers a row.
    """
    cut = token_pieces(docs.select("doc_id", "text"), tokenizer, capacity=capacity)
    small = cut.select("doc_id", "start", "length", crc32_of_ids().alias("ids_crc32"), "doc_tokens")
    return pack_pieces(stored(small, "pieces"), ["doc_id", "start", "ids_crc32", "doc_tokens"], capacity)
