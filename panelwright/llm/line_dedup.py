"""Lines that many documents share, dropped wherever they stand.

Method: explode normalised lines, hash them, count distinct documents per hash, drop lines
over the threshold, reassemble the rest by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, making_room, stored, text_of

#: Fixed value: the characters stripped from both ends of a line.
STRIPPED = "\t\n\x0b\x0c\r "
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, with A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(STRIPPED)), UPPER, UPPER.lower())


def dedup_lines(docs: DataFrame, min_documents: int = 10, min_chars: int = 1, text: str = "text") -> DataFrame:
    """Add ``kept_text``, ``n_lines`` and ``n_dropped`` to every row; other columns stay as they are.

    An own column that bears one of these names is returned as ``kept_text_own`` and so on.

    A key of ``min_chars`` or more code points that ``min_documents`` or more documents hold
    loses all its lines in every document. Every row is a document, also when it repeats
    another. A NULL text is one empty line, as is an empty one; NULL keys in other columns
    make no difference. An empty table gives an empty table. A document that loses every
    line keeps an empty text.

    Rows with the same text share one decision, so a row is known by the hash of its text
    and copies meet before anything is grouped by document. Only hashes of lines are
    shuffled by line; the texts move once, to meet their flags. A line in a third of the
    documents is one key of partial counts, and of a join that adaptive execution splits.
    """
    docs = making_room(docs, ("kept_text", "n_lines", "n_dropped"))
    text_id = F.unhex(F.md5(text_of(text).cast("binary")))
    lines = stored(
        docs.select(text_id.alias("_id"), F.posexplode(F.split(text_of(text), "\n", -1)).alias("_at", "_line"))
        .select("_id", "_at", line_key(F.col("_line")).alias("_key"))
        .select(
            "_id",
            "_at",
            F.when(F.char_length("_key") >= min_chars, F.unhex(F.md5(F.col("_key").cast("binary")))).alias("_hash"),
        )
        .groupBy("_id", "_at")
        .agg(F.any_value("_hash").alias("_hash"), F.count(F.lit(1)).alias("_copies")),
        "lines",
    )
    keyed, keyless = lines.where("_hash IS NOT NULL"), lines.where("_hash IS NULL")
    once = keyed.groupBy("_hash", "_id").agg(F.any_value("_copies").alias("_copies"))
    shared = once.groupBy("_hash").agg(F.sum("_copies").alias("_n")).where(F.col("_n") >= min_documents)
    # lines without a key are never dropped and stay out of the join, where they would all meet
    decided = keyed.join(shared.select("_hash", F.lit(True).alias("_drop")), "_hash", "left").select("_id", "_at", "_drop")
    flags = (
        decided.unionByName(keyless.select("_id", "_at", F.lit(None).cast("boolean").alias("_drop")))
        .groupBy("_id")
        .agg(
            F.sort_array(
                F.collect_list(F.struct("_at", F.coalesce("_drop", F.lit(False)).alias("_drop")))
            ).alias("_flags")
        )
    )
    own, flag = free_name(docs, "_id"), free_name(docs, "_flags")
    marked = docs.withColumn(own, text_id).join(flags.select(F.col("_id").alias(own), F.col("_flags").alias(flag)), own)
    paired = F.arrays_zip(F.split(text_of(text), "\n", -1).alias("line"), F.col(f"{flag}._drop").alias("drop"))
    kept = F.transform(F.filter(paired, lambda p: ~p["drop"]), lambda p: p["line"])
    return marked.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.array_join(kept, "\n").alias("kept_text"),
        F.size(flag).cast("long").alias("n_lines"),
        F.size(F.filter(flag, lambda f: f["_drop"])).cast("long").alias("n_dropped"),
    )
