"""Secrets in texts: fixed patterns, and strings that look random.

Method: character Markov models of random strings and of ordinary identifiers, compared by
log-likelihood ratio, trained from labelled samples. DataFrame functions only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_of

#: Kinds in order, their patterns, the group whose length counts, and the least length.
KINDS = ("assign", "access", "hex")
#: A run of one character class is matched as a whole, so its least length can stand in the pattern.
PATTERNS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
#: Stands for a pattern where that is cheaper to look for; it finds at least the texts with a span.
HINTS = {"assign": r"(?i)(?:passw|secret|token|api_?key)", "access": "AKIA", "hex": "[0-9a-f]{24}"}
#: A candidate for the models: a run of these, at least as long as given.
CANDIDATE, LEAST = r"[A-Za-z0-9+/_-]{16,}", 16
#: Of these the ordinary sample is made: the same characters, so that their signs are ordinary too.
ORDINARY = r"[A-Za-z0-9+/_-]{6,}"
CODES = 128
#: Character classes of candidates, each with a threshold of its own.
CLASSES = ("letters", "digits", "mixed")


def spans(text: Column, pattern: str, kind: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches as structs: start and end in code points, kind, the group's text.

    Matches and the pieces of text between them alternate, so positions are running sums of
    their lengths. Matches whose group is shorter than ``least`` are dropped afterwards.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pieces = F.split(text, pattern, -1)
    parts = F.arrays_zip(
        F.slice(pieces, F.lit(1), F.size(found)).alias("before"), found.alias("match"), groups.alias("group")
    )
    empty = F.lit(None).cast("array<struct<start:int,end:int,kind:string,value:string>>")
    begun = F.struct(F.lit(0).alias("at"), F.coalesce(empty, F.array().cast("array<struct<start:int,end:int,kind:string,value:string>>")).alias("out"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.char_length(p["before"])
        end = start + F.char_length(p["match"])
        one = F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), p["group"].alias("value"))
        return F.struct(end.alias("at"), F.array_append(acc["out"], one).alias("out"))

    return F.filter(F.aggregate(parts, begun, step, lambda a: a["out"]), lambda s: F.char_length(s["value"]) >= least)


def outside(span: Column, base: Column, least: int = LEAST) -> Column:
    """The stretches of a span that no span of ``base`` (by start) covers, ``least`` characters at least."""

    def piece(at: Column, end: Column) -> Column:
        value = F.substring(span["value"], at - span["start"] + 1, end - at)
        one = F.struct(at.alias("start"), end.alias("end"), span["kind"].alias("kind"), value.alias("value"))
        return F.when(end - at >= least, F.array(one)).otherwise(F.array().cast("array<struct<start:int,end:int,kind:string,value:string>>"))

    met = F.filter(base, lambda b: (b["start"] < span["end"]) & (span["start"] < b["end"]))
    begun = F.struct(span["start"].alias("at"), F.array().cast("array<struct<start:int,end:int,kind:string,value:string>>").alias("out"))

    def step(acc: Column, b: Column) -> Column:
        return F.struct(
            F.greatest(acc["at"], b["end"]).alias("at"), F.concat(acc["out"], piece(acc["at"], b["start"])).alias("out")
        )

    return F.aggregate(met, begun, step, lambda a: F.concat(a["out"], piece(a["at"], span["end"])))


def base_spans(text: Column) -> Column:
    """All pattern spans of a text by start, then kind as listed."""
    none = F.array().cast("array<struct<start:int,end:int,kind:string,value:string>>")
    lists = [
        F.when(text.rlike(HINTS[k]), spans(text, PATTERNS[k][0], k, PATTERNS[k][1], PATTERNS[k][2])).otherwise(none)
        for k in KINDS
    ]
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    tagged = F.transform(F.concat(*lists), lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s.alias("span")))
    return F.transform(F.array_sort(tagged), lambda t: t["span"])


def listed(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@dataclass(frozen=True)
class Model:
    """For each pair of neighbouring ASCII characters the log of how much likelier it is in
    random strings than in identifiers (``table[128 * before + after]``), and for each of ``CLASSES`` the mean
    from which on a string is secret."""

    table: tuple[float, ...]
    thresholds: tuple[float, ...]


def _pairs(strings: DataFrame, name: str) -> DataFrame:
    at = F.sequence(F.lit(1), F.char_length("s") - 1)
    pairs = F.transform(at, lambda i: F.ascii(F.substring(F.col("s"), i, F.lit(1))) * CODES + F.ascii(F.substring(F.col("s"), i + 1, F.lit(1))))
    return (
        strings.where(F.char_length("s") > 1)
        .select(F.explode(pairs).alias("pair"))
        .where(F.col("pair") < CODES * CODES)
        .groupBy("pair")
        .agg(F.count(F.lit(1)).alias(name))
    )


def class_of(string: Column) -> Column:
    """The place in ``CLASSES``: no digit, no letter, or both."""
    return F.when(~string.rlike("[0-9]"), 0).when(~string.rlike("[A-Za-z]"), 1).otherwise(2)


def train(
    random: DataFrame, ordinary: DataFrame, thresholds: Sequence[float] = (0.5, 0.5, 0.5), smoothing: float = 0.5
) -> Model:
    """The two first-order models from columns ``s`` of random strings and of identifiers.

    Transition counts are sums over all rows; at most 128 x 128 of them reach the driver. Each row of
    counts is smoothed over the characters that occur. ``thresholds`` are those of ``CLASSES``; they are not
    taken from the identifiers, which may hold secrets that no label knows. Without random strings, or
    without identifiers, every ratio is 0 and nothing is found.
    """
    counts = _pairs(random, "r").join(_pairs(ordinary, "o"), "pair", "outer").collect()
    r = {x["pair"]: x["r"] or 0 for x in counts}
    o = {x["pair"]: x["o"] or 0 for x in counts}
    table = [0.0] * (CODES * CODES)
    if not sum(r.values()) or not sum(o.values()):
        return Model(tuple(table), (float("inf"),) * len(CLASSES))
    used = sorted({c for p in (*r, *o) for c in divmod(p, CODES)})
    for a in used:
        sums = [sum(m.get(a * CODES + b, 0) for b in used) + smoothing * len(used) for m in (r, o)]
        for b in used:
            p = (r.get(a * CODES + b, 0) + smoothing) / sums[0]
            q = (o.get(a * CODES + b, 0) + smoothing) / sums[1]
            table[a * CODES + b] = round(math.log(p / q), 6)
    return Model(tuple(table), tuple(thresholds))


def is_secret(string: Column, model: Model) -> Column:
    limits = F.array(*map(F.lit, model.thresholds))
    return ratio(string, model) >= F.get(limits, class_of(string))


def ratio(string: Column, model: Model) -> Column:
    """Mean log-likelihood ratio of a string's transitions; positive for random strings."""
    table = F.split(F.lit(",".join(map(str, model.table))), ",").cast("array<double>")  # one literal
    at = F.sequence(F.lit(1), F.char_length(string) - 1)
    pair = lambda i: F.ascii(F.substring(string, i, F.lit(1))) * CODES + F.ascii(F.substring(string, i + 1, F.lit(1)))
    total = F.aggregate(at, F.lit(0.0), lambda s, i: s + F.element_at(table, pair(i) + 1))
    return F.when(F.char_length(string) > 1, total / (F.char_length(string) - 1)).otherwise(F.lit(0.0))


def scan(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    most_random: int = 20_000,
    most_documents: int = 2_000,
    thresholds: Sequence[float] = (0.5, 0.5, 0.5),
) -> DataFrame:
    """One row per document: ``key``, ``base`` (pattern spans) and ``found`` (all spans), as arrays.

    ``base`` are the leftmost non-overlapping matches of each pattern in the whole text that
    are long enough. ``found`` adds, as kind ``random``, runs of 16 or more key characters whose
    transitions fit random strings better than identifiers; where base spans cover part of a run, its
    stretches outside them are judged. Letters alone, digits alone and both have each their threshold.
    The samples are labelled by the patterns: values of base spans, at most ``most_random``, are
    random; runs of 6 or more key characters in at most ``most_documents`` documents without base spans are ordinary;
    both those of the smallest hash. The bounds are parameters of the fit alone.

    NULL and empty texts have no spans. Every row is judged by its own text, so repeated rows
    agree; NULL keys stay. Only spans, not texts, are written and shuffled.
    """
    body = text_of(text)
    seen = stored(
        docs.select(F.col(key).alias("key"), body.alias("text"))
        .select("key", F.xxhash64("key").alias("h"), base_spans(F.col("text")).alias("base"), spans(F.col("text"), CANDIDATE, "random", 0, LEAST).alias("more"))
        .withColumn("more", F.flatten(F.transform("more", lambda s: outside(s, F.col("base"))))),
        "spans",
    )
    random = (
        seen.select(F.explode("base.value").alias("s"))
        .where(F.char_length("s") >= LEAST)
        .distinct()
        .orderBy(F.xxhash64("s"), "s")
        .limit(most_random)
    )
    plain = seen.where((F.size("base") == 0) & F.col("key").isNotNull()).select("key", "h").orderBy("h", "key").limit(most_documents)
    ordinary = (
        docs.select(F.col(key).alias("key"), body.alias("text"))
        .join(F.broadcast(plain.select("key")), "key", "left_semi")
        .select(F.explode(F.regexp_extract_all("text", F.lit(ORDINARY), F.lit(0))).alias("s"))
    )
    model = train(random, ordinary, thresholds)
    added = F.filter("more", lambda s: is_secret(s["value"], model))
    kinds = F.array(*map(F.lit, (*KINDS, "random")))
    ranked = F.transform(
        F.concat("base", added), lambda s: F.struct(s["start"].alias("start"), F.array_position(kinds, s["kind"]).alias("rank"), s.alias("span"))
    )
    return seen.select(F.col("key").alias(key), "base", F.transform(F.array_sort(ranked), lambda t: t["span"]).alias("found"))
