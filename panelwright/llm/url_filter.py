"""URL rules: given ones by host and path, and mined ones by token combinations.

Method: association-rule filtering. Spark's FP-growth mines combinations of URL tokens from labelled
URLs; confidence- and support-pruned rules match by inverted index. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CHANCE = 0.05


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(host, UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def given_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest fitting rule as a struct of ``rule`` and ``verdict``, or NULL.

    ``rules`` are (verdict, host and path) pairs, a few dozen at most: each becomes a branch.
    A rule fits its host and all subdomains where the path starts with the rule's.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        at, slash, rest = rule.partition("/")
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit(slash + rest))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def fixed_parts(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The given rules' hosts and paths that a URL lies under: what the selection by these rules fixes."""
    hosts = sorted({rule.partition("/")[0] for _, rule in rules})
    paths = sorted({"/" + rule.partition("/")[2] for _, rule in rules} - {"/"})
    under = [F.when((host == h) | F.endswith(host, F.lit("." + h)), F.lit("host:" + h)) for h in hosts]
    under += [F.when(F.startswith(path, F.lit(p)), F.lit("path:" + p)) for p in paths]
    return F.filter(F.array(*under, F.lit(None).cast("string")), lambda x: x.isNotNull())


def tokens_of(url: Column) -> Column:
    """A URL's distinct tokens: scheme, each host suffix, path parts, file ending, query names, fragment.

    Digits are read as one number sign, so that page numbers don't tell URLs apart.
    """
    url = F.coalesce(url, F.lit(""))
    host, path = host_of(url), F.regexp_replace(path_of(url), "[0-9]+", "#")
    labels = F.split(host, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))),
        lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, -i, i), ".")),
    )
    parts = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path:"), x))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    names = F.transform(
        F.filter(F.split(query, "&"), lambda x: x != ""),
        lambda x: F.concat(F.lit("query:"), F.regexp_extract(x, "^([^=]*)", 1)),
    )
    fragment = F.regexp_extract(url, "#(.*)$", 1)
    return F.array_distinct(
        F.filter(
            F.concat(
                F.array(F.concat(F.lit("scheme:"), F.regexp_extract(url, "^([A-Za-z]+)://", 1))),
                F.filter(suffixes, lambda x: x != "host:"),
                parts,
                names,
                F.array(F.when(fragment != "", F.concat(F.lit("fragment:"), fragment))),
            ),
            lambda x: x.isNotNull() & (x != "scheme:"),
        )
    )


def mine(labelled: DataFrame, min_support: float = 0.005, min_confidence: float = 0.9, most_tokens: int = 4) -> DataFrame:
    """Rules (tokens, verdict, confidence, support) from rows of ``tokens`` and ``verdict``.

    The verdict is a token of its transaction; FP-growth's association rules that lead to it
    are kept if they have the support and confidence, at most ``most_tokens`` tokens, and no
    shorter rule of the same verdict among their parts that is as sure. An empty table or one
    verdict only still gives rules; with no rows there are none. With a column ``fixed`` (see
    ``fixed_parts``) rules that restate the selection are left out, before any is pruned for them.
    """
    spark = labelled.sparkSession
    baskets = stored(
        labelled.where(F.col("verdict").isNotNull()).select(
            F.array_append("tokens", F.concat(F.lit("verdict="), "verdict")).alias("items")
        ),
        "baskets",
    )
    if baskets.isEmpty():
        return spark.createDataFrame([], "rule_id long, tokens array<string>, verdict string, confidence double, support double")
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    found = stored(
        model.associationRules.where(F.startswith(F.col("consequent")[0], F.lit("verdict=")))
        .where((F.size("antecedent") <= most_tokens) & ~F.exists("antecedent", lambda x: F.startswith(x, F.lit("verdict="))))
        .select(
            F.array_sort("antecedent").alias("tokens"),
            F.substring(F.col("consequent")[0], 9, 1_000_000).alias("verdict"),
            "confidence",
            "support",
        )
        .withColumn("rule_id", F.monotonically_increasing_id()),
        "rules",
    )
    if "fixed" in labelled.columns:
        found = stored(beyond_selection(found, labelled, min_support, min_confidence), "beyond")
    # a shorter rule shares each of its tokens with the longer one: it is looked up by its first
    short, long_ = found.alias("s"), found.withColumn("token", F.explode("tokens")).alias("l")
    idle = long_.join(
        short,
        (F.col("l.token") == F.col("s.tokens")[0])
        & (F.col("l.verdict") == F.col("s.verdict"))
        & (F.size("s.tokens") < F.size("l.tokens"))
        & (F.size(F.array_except("s.tokens", "l.tokens")) == 0)
        & (F.col("s.confidence") >= F.col("l.confidence")),
    ).select(F.col("l.rule_id").alias("rule_id"))
    return found.join(idle.distinct(), "rule_id", "left_anti").select("rule_id", "tokens", "verdict", "confidence", "support")


def held_rules(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Each row of ``tokens`` beside every rule that it holds whole, as a struct ``rule``.

    The inverted index posts a rule under its rarest token only; token sets look up
    their own tokens, and a posting counts when the set holds the whole rule.
    """
    spread = sets.withColumn("token", F.explode("tokens"))
    often = spread.groupBy("token").agg(F.count(F.lit(1)).alias("n_sets"))
    rarest = Window.partitionBy("rule_id").orderBy("n_sets", "token")  # a rule has few tokens
    posted = (
        rules.withColumn("token", F.explode("tokens"))
        .join(often, "token")
        .withColumn("turn", F.row_number().over(rarest))
        .where("turn = 1")
        .select("token", F.struct("rule_id", F.col("tokens").alias("need"), "verdict", "confidence", "support").alias("rule"))
    )
    return spread.join(posted, "token").where(F.size(F.array_except("rule.need", "tokens")) == 0).drop("token")


def beyond_selection(found: DataFrame, labelled: DataFrame, min_support: float, min_confidence: float) -> DataFrame:
    """The rules that say more than which URLs the given rules selected.

    A given rule fixes a host and a path, and its verdict follows from them: what is seen under one
    host or path only may be that selection itself. A rule stays if, for each of its URLs' fixed
    parts, it has the support and confidence without the URLs under that part too, if it errs at
    most half as often as its verdict does over all URLs, and if chance makes any of the rules tried
    so sure with a probability of ``CHANCE`` at most (Chernoff's bound).
    """
    known = labelled.where(F.col("verdict").isNotNull())
    sets = stored(
        known.groupBy("tokens", "fixed", F.col("verdict").alias("label")).agg(F.count(F.lit(1)).alias("n")), "decided"
    )
    of_part = sets.select(F.explode("fixed").alias("part"), "n").groupBy("part").agg(F.sum("n").alias("part_n"))
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    of_label = sets.groupBy(F.col("label").alias("verdict")).agg(F.sum("n").alias("label_n"))
    hits = held_rules(sets, found).withColumn("hit", F.when(F.col("label") == F.col("rule.verdict"), F.col("n")).otherwise(0))
    seen = stored(
        hits.select("rule.rule_id", F.explode(F.array_append("fixed", F.lit("all"))).alias("part"), "n", "hit")
        .groupBy("rule_id", "part")
        .agg(F.sum("n").alias("n"), F.sum("hit").alias("hit")),
        "seen",
    )
    whole = seen.where("part = 'all'").select("rule_id", F.col("n").alias("all_n"), F.col("hit").alias("all_hit"))
    rest_n, rest_hit = F.col("all_n") - F.col("n"), F.col("all_hit") - F.col("hit")
    restated = (
        seen.join(whole, "rule_id").join(of_part, "part").crossJoin(total)
        .where(
            (rest_hit == 0)
            | (rest_hit < F.lit(min_confidence) * rest_n)
            | (rest_hit < F.lit(min_support) * (F.col("total") - F.col("part_n")))
        )
        .select("rule_id")
    )
    errs = F.col("all_n") - F.col("all_hit")
    usual = F.col("total") - F.col("label_n")
    # hits and misses against those expected, in units of the log probability
    gain = F.col("all_hit") * F.log(F.col("all_hit") * F.col("total") / (F.col("all_n") * F.col("label_n"))) + F.when(
        errs > 0, errs * F.log(errs * F.col("total") / (F.col("all_n") * usual))
    ).otherwise(0.0)
    tried = found.agg(F.count(F.lit(1)).alias("tried"))
    telling = (
        found.select("rule_id", "verdict").join(whole, "rule_id").join(of_label, "verdict").crossJoin(total).crossJoin(tried)
        .where((usual > 0) & (2 * errs * F.col("total") <= usual * F.col("all_n")))
        .where(gain >= F.log(F.col("tried") / F.lit(CHANCE)))
        .select("rule_id")
    )
    return found.join(telling, "rule_id", "left_semi").join(restated.distinct(), "rule_id", "left_anti")


def match(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """The surest mined rule for each row of ``tokens``: adds ``mined`` (verdict, confidence, tokens).

    Of rules equally sure the best supported, then the shortest, then the first by name wins.
    Equal sets are looked up once.
    """
    best = held_rules(sets.select("tokens").distinct(), rules).select("tokens", "rule.*").groupBy("tokens").agg(
        F.min(
            F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), F.size("need").alias("k"), F.array_join("need", " ").alias("need"), "verdict")
        ).alias("best")
    )
    return sets.join(best, "tokens", "left").withColumn(
        "mined", F.when(F.col("best").isNotNull(), F.struct(F.col("best.verdict").alias("verdict"), (-F.col("best.c")).alias("confidence"), F.col("best.need").alias("tokens")))
    ).drop("best")


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]],
    key: str = "page_id",
    url: str = "url",
    labelled: DataFrame | None = None,
    default: str = "allow",
    min_support: float = 0.005,
    min_confidence: float = 0.9,
) -> DataFrame:
    """``key``, ``host``, ``path``, ``rule``, ``verdict``, ``by`` (rule, mined or default) and ``confidence``.

    A given rule decides where one fits. Other URLs get the verdict of the surest mined
    rule, else ``default``. Rules are mined from ``labelled`` (``url`` and ``verdict``), or, without
    it, from the URLs that given rules decide, as far as they say more than that selection
    (``beyond_selection``). NULL URLs, and URLs without ``://``, have an
    empty host and path and few tokens or none. Each row is judged alone, so ties and repeated rows agree.
    """
    read = pages.select(F.col(key).alias("key"), F.col(url).alias("url")).select(
        "key", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), tokens_of(F.col("url")).alias("tokens")
    ).withColumn("given", given_rule(F.col("host"), F.col("path"), rules))
    read = stored(read.drop("url"), "urls")
    known = (
        read.where("given IS NOT NULL").select(
            "tokens", F.col("given.verdict").alias("verdict"), fixed_parts(F.col("host"), F.col("path"), rules).alias("fixed")
        )
        if labelled is None
        else labelled.select(tokens_of(F.col(url)).alias("tokens"), "verdict")
    )
    mined = match(read.where("given IS NULL").select("tokens").distinct(), mine(known, min_support, min_confidence))
    joined = read.join(mined, "tokens", "left")
    return joined.select(
        F.col("key").alias(key),
        "host",
        "path",
        F.col("given.rule").alias("rule"),
        F.coalesce("given.verdict", "mined.verdict", F.lit(default)).alias("verdict"),
        F.when(F.col("given").isNotNull(), "rule").when(F.col("mined").isNotNull(), "mined").otherwise("default").alias("by"),
        F.when(F.col("given").isNull(), F.col("mined.confidence")).alias("confidence"),
    )
