"""Regression queries.

A model with one categorical exposure has a closed form: each level's fitted mean is its
weighted mean, and the clustered covariance of the log means is a sum over clusters. The
SQL side computes that; the Spark side runs the general estimator.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import recode as R
from ..models import effects as E
from ..models.design import Cat, Num, crossed
from ..models.glm import Model, fit_models, model_audit
from ..models.weights import class_models, marginal_structural_weights, observation_models, observation_weights
from ..operators import joins
from ..operators.sequences import HISTORY_GROUPS, add_previous_wave, mean_normalised, standardise_within
from ..operators.summaries import fill_missing, gate
from ..sources import tables
from ..sources.tables import stored
from . import standin as S
from .interval_queries import (
    GROUPS,
    SQL_HISTORY,
    SQL_STACK,
    index_stack,
    interval_history,
)
from .panel_queries import SQL_LAG, lagged_intervals
from .registry import query, rounded

STATE = Cat("state", reference=0, levels=(0, 1, 2, 3))
CONTRASTS = [(3, 2), (3, 1)]

SQL_SPECS = "specs(model, origin, d1, d2) AS (VALUES " + ", ".join(
    f"('{label}', {origin}, {dests[0]}, {dests[-1]})" for origin, dests, label in S.KEY_TRANSITIONS
) + ")"


def sql_risk(group: str = "o.state", source: str = "obs", where: str = "true", weight: str = "CAST(o.n_orders AS DOUBLE)") -> str:
    return f"""{SQL_SPECS},
r AS (SELECT s.model, o.id, {group} AS g, {weight} AS w,
        CASE WHEN o.destination_state IN (s.d1, s.d2) THEN 1.0 ELSE 0.0 END AS y
      FROM {source} o JOIN specs s ON o.functional_state = s.origin WHERE {where})"""


def sql_saturated(k: int, family: str = "poisson") -> str:
    """Closed form of a one-factor model over r(model, id, g, w, y)."""
    bread = "sum(w * y)" if family == "poisson" else "sum(w) * (sum(w * y) / sum(w)) * (1 - sum(w * y) / sum(w))"
    return f"""cell AS (SELECT model, g, {bread} AS m, sum(w * y) / sum(w) AS mu FROM r GROUP BY 1, 2),
sc AS (SELECT r.model, r.id, r.g, sum(w * (y - mu)) AS s FROM r JOIN cell ON cell.model = r.model AND cell.g = r.g GROUP BY 1, 2, 3),
tot AS (SELECT model, count(*) AS n, count(DISTINCT id) AS people, CAST(sum(y) AS BIGINT) AS events FROM r GROUP BY 1),
cv AS (SELECT a.model, a.g, b.g AS h, sum(a.s * b.s) AS v FROM sc a JOIN sc b ON a.model = b.model AND a.id = b.id GROUP BY 1, 2, 3),
cov AS (SELECT x.model, x.g, y.g AS h,
    coalesce(cv.v, 0) / (x.m * y.m) * (people / (people - 1.0)) * ((n - 1.0) / (n - {k})) AS c
  FROM cell x JOIN cell y ON x.model = y.model JOIN tot ON tot.model = x.model
  LEFT JOIN cv ON cv.model = x.model AND cv.g = x.g AND cv.h = y.g)"""


# pairs(comparison, hi, lo, critical) to log ratios with standard errors
SQL_PAIRS = """est AS (
  SELECT hi.model, p.comparison, p.critical, ln(hi.mu / lo.mu) AS b,
    sqrt(greatest(chh.c + cll.c - 2 * chl.c, 0)) AS se
  FROM pairs p JOIN cell hi ON hi.g = p.hi JOIN cell lo ON lo.g = p.lo AND lo.model = hi.model
  JOIN cov chh ON chh.model = hi.model AND chh.g = p.hi AND chh.h = p.hi
  JOIN cov cll ON cll.model = hi.model AND cll.g = p.lo AND cll.h = p.lo
  JOIN cov chl ON chl.model = hi.model AND chl.g = p.hi AND chl.h = p.lo)"""


def sql_tail(z: str) -> str:
    """Two-sided normal tail by Simpson's rule on the density."""
    step = f"(abs({z}) / 400)"
    return (
        f"greatest(1 - 2 / sqrt(2 * pi()) * {step} / 3 * list_sum(list_transform(range(0, 401), "
        f"lambda i: (CASE WHEN i IN (0, 400) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-0.5 * (i * {step}) * (i * {step})))), 0)"
    )


RATIO_COLUMNS = f"""est.model, comparison, round(exp(b), 6) AS estimate, round(se, 6) AS se_log,
  round(exp(b - critical * se), 6) AS ci_low, round(exp(b + critical * se), 6) AS ci_high,
  round({sql_tail("(b / se)")}, 6) AS p_value, n AS n_intervals, events, people"""

PAIRS_STATE = "pairs(comparison, hi, lo, critical) AS (VALUES " + ", ".join(
    [f"('{S.STATE_LABELS[g]}', {g}, 0, 1.959963984540054::DOUBLE)" for g in (1, 2, 3)]
    + [f"('{S.STATE_LABELS[h]} vs {S.STATE_LABELS[g]}', {h}, {g}, 1.96::DOUBLE)" for h, g in CONTRASTS]
) + ")"


def transition_models(terms, weight="w", transitions=S.KEY_TRANSITIONS, where=None, suffix="", destination="destination_state"):
    out = []
    for origin, destinations, label in transitions:
        risk = F.col("functional_state") == origin
        out.append(
            Model(
                label + suffix,
                R.event_in(destination, destinations),
                tuple(terms),
                where=risk if where is None else risk & where,
                weight=weight,
            )
        )
    return out


def weighted(spark, sf):
    return S.observed(spark, sf).withColumn("w", F.col("n_orders").cast("double"))


def state_fits(spark, sf):
    rows = weighted(spark, sf)
    models = transition_models([STATE])
    return rows, models, fit_models(rows, models, cluster="id")


@query(
    "transition_rr",
    f"""WITH {S.SQL_INTERVALS}, {sql_risk(weight="1.0")}, cell AS (SELECT model, g, avg(y) AS mu FROM r GROUP BY 1, 2),
    tot AS (SELECT model, count(*) AS n, CAST(sum(y) AS BIGINT) AS events, count(DISTINCT id) AS people FROM r GROUP BY 1)
    SELECT c.model, CASE c.g WHEN 1 THEN 'Urgent only' WHEN 2 THEN 'High spend only' ELSE 'Both' END AS comparison,
      round(c.mu / z.mu, 6) AS estimate, n AS n_intervals, events, people
    FROM cell c JOIN cell z ON z.model = c.model AND z.g = 0 JOIN tot ON tot.model = c.model WHERE c.g > 0""",
)
def transition_rr(spark, sf):
    rows = S.observed(spark, sf)
    fits = fit_models(rows, transition_models([STATE], weight=None), cluster="id")
    out = [r for f in fits.values() for r in E.ratio_rows(f, "state", [1, 2, 3], S.STATE_LABELS)]
    table = E.as_table(spark, out, E.RATIO_FIELDS)
    return rounded(table.select("model", "comparison", "estimate", "n_intervals", "events", "people"))


@query(
    "transition_rr_cluster_se",
    f"""WITH {S.SQL_INTERVALS}, {sql_risk()}, {sql_saturated(4)}, {PAIRS_STATE}, {SQL_PAIRS}
    SELECT {RATIO_COLUMNS} FROM est JOIN tot ON tot.model = est.model""",
)
def transition_rr_cluster_se(spark, sf):
    _, _, fits = state_fits(spark, sf)
    rows = [
        r
        for f in fits.values()
        for r in E.ratio_rows(f, "state", [1, 2, 3], S.STATE_LABELS, CONTRASTS)
    ]
    return rounded(E.as_table(spark, rows, E.RATIO_FIELDS))


def hub_intervals(spark, sf):
    """Observed intervals with people's covariates, from tables in buckets of people."""
    waves, fixed = S.person_hub(spark, sf)
    paired = S.intervals(spark, sf, build=lambda *_: waves).filter("outcome_observed = 1")
    joined = joins.checked_join(paired, fixed, ["id"], "left", "many_to_one")
    return joined.withColumn("w", F.col("n_orders").cast("double"))


@query(
    "hub_region_rr",
    f"""WITH {S.SQL_INTERVALS}, {S.SQL_PEOPLE}, {sql_risk("o.region", "(SELECT obs.*, people.region FROM obs JOIN people ON people.id = obs.id)")}, {sql_saturated(5)},
    pairs(comparison, hi, lo, critical) AS (VALUES {", ".join(f"('Region {g}', {g}, 0, 1.959963984540054::DOUBLE)" for g in range(1, 5))}), {SQL_PAIRS}
    SELECT {RATIO_COLUMNS} FROM est JOIN tot ON tot.model = est.model""",
)
def hub_region_rr(spark, sf):
    """Region ratios over person-bucketed tables: no row moves between panel, interval, join and score."""
    region = Cat("region", reference=0, levels=(0, 1, 2, 3, 4))
    fits = fit_models(hub_intervals(spark, sf), transition_models([region]), cluster="id")
    names = {g: f"Region {g}" for g in range(1, 5)}
    rows = [r for f in fits.values() for r in E.ratio_rows(f, "region", [1, 2, 3, 4], names)]
    return rounded(E.as_table(spark, rows, E.RATIO_FIELDS))


@query(
    "contrast_vs_single",
    f"""WITH {S.SQL_INTERVALS}, {sql_risk()}, {sql_saturated(4)}, {PAIRS_STATE}, {SQL_PAIRS}
    SELECT est.model, comparison, round(exp(b), 6) AS estimate, round(exp(b - 1.96 * se), 6) AS ci_low, round(exp(b + 1.96 * se), 6) AS ci_high
    FROM est WHERE comparison LIKE '% vs %'""",
)
def contrast_vs_single(spark, sf):
    _, _, fits = state_fits(spark, sf)
    rows = [r for f in fits.values() for r in E.ratio_rows(f, "state", [], S.STATE_LABELS, CONTRASTS)]
    table = E.as_table(spark, rows, E.RATIO_FIELDS)
    return rounded(table.select("model", "comparison", "estimate", "ci_low", "ci_high"))


SQL_GRADIENT = """rr AS (SELECT model, max(CASE WHEN g = 0 THEN mu END) AS m0, max(CASE WHEN g = 1 THEN mu END) AS m1,
    max(CASE WHEN g = 2 THEN mu END) AS m2, max(CASE WHEN g = 3 THEN mu END) AS m3 FROM cell GROUP BY 1),
d AS (SELECT model, unnest([0, 1, 2, 3]) AS g, unnest([-(m3 - m1 - m2) / m0, -m1 / m0, -m2 / m0, m3 / m0]) AS w FROM rr),
v AS (SELECT cov.model, sqrt(greatest(sum(x.w * y.w * c), 0)) AS se FROM cov JOIN d x ON x.model = cov.model AND x.g = cov.g
  JOIN d y ON y.model = cov.model AND y.g = cov.h GROUP BY 1)"""


@query(
    "reri",
    f"""WITH {S.SQL_INTERVALS}, {sql_risk()}, {sql_saturated(4)}, {SQL_GRADIENT},
    e AS (SELECT rr.*, (m3 - m1 - m2) / m0 + 1 AS reri, se FROM rr JOIN v ON v.model = rr.model)
    SELECT model, round(m1 / m0, 6) AS rr_first, round(m2 / m0, 6) AS rr_second, round(m3 / m0, 6) AS rr_both, round(reri, 6) AS reri,
      round(se, 6) AS se, round(reri - 1.96 * se, 6) AS ci_low, round(reri + 1.96 * se, 6) AS ci_high, round({sql_tail("(reri / se)")}, 6) AS p_value FROM e""",
)
def reri(spark, sf):
    _, _, fits = state_fits(spark, sf)
    rows = [
        E.additive_interaction(f, "state[1]", "state[2]", "state[3]")
        for f in fits.values()
        if all(f.has(f"state[{g}]") for g in (1, 2, 3))
    ]
    return rounded(E.as_table(spark, rows, E.RERI_FIELDS))


@query(
    "standardized_risk",
    f"""WITH {S.SQL_INTERVALS}, {sql_risk()}, {sql_saturated(4)},
    one AS (SELECT cell.model, cell.g, mu, mu * sqrt(c) AS se FROM cell JOIN cov ON cov.model = cell.model AND cov.g = cell.g AND cov.h = cell.g),
    dif AS (SELECT a.model, a.mu - b.mu AS d, sqrt(greatest(a.mu * a.mu * aa.c + b.mu * b.mu * bb.c - 2 * a.mu * b.mu * ab.c, 0)) AS se
      FROM cell a JOIN cell b ON b.model = a.model AND a.g = 3 AND b.g = 2 JOIN cov aa ON aa.model = a.model AND aa.g = 3 AND aa.h = 3
      JOIN cov bb ON bb.model = a.model AND bb.g = 2 AND bb.h = 2 JOIN cov ab ON ab.model = a.model AND ab.g = 3 AND ab.h = 2)
    SELECT one.model, CASE one.g WHEN 0 THEN 'Neither' WHEN 1 THEN 'Urgent only' WHEN 2 THEN 'High spend only' ELSE 'Both' END AS scenario,
      round(one.mu, 6) AS risk, round(greatest(one.mu - 1.96 * se, 0), 6) AS ci_low, round(least(one.mu + 1.96 * se, 1), 6) AS ci_high,
      round(one.mu - z.mu, 6) AS difference, CAST(NULL AS DOUBLE) AS difference_low, CAST(NULL AS DOUBLE) AS difference_high, CAST(NULL AS DOUBLE) AS p_value
    FROM one JOIN cell z ON z.model = one.model AND z.g = 0
    UNION ALL SELECT model, 'Both vs High spend only', NULL, NULL, NULL, round(d, 6), round(d - 1.96 * se, 6), round(d + 1.96 * se, 6), round({sql_tail("(d / se)")}, 6) FROM dif""",
)
def standardized_risk(spark, sf):
    rows, models, fits = state_fits(spark, sf)
    out = E.standardised_risks(rows, models, fits, "state", [0, 1, 2, 3], S.STATE_LABELS, [(3, 2)])
    return rounded(E.as_table(spark, out, E.RISK_FIELDS))


@query(
    "absolute_risk_table",
    f"""WITH {S.SQL_INTERVALS}, {sql_risk()}, {sql_saturated(4)}
    SELECT r.model, r.g AS state, count(*) AS intervals, count(DISTINCT r.id) AS people, CAST(sum(y) AS BIGINT) AS events,
      round(avg(y), 6) AS rate, round(any_value(mu), 6) AS standardized_risk
    FROM r JOIN cell ON cell.model = r.model AND cell.g = r.g GROUP BY 1, 2""",
)
def absolute_risk_table(spark, sf):
    """Crude rates beside the model's standardised risks."""
    rows, models, fits = state_fits(spark, sf)
    sums = E.scenario_sums(rows, models, fits, "state", [0, 1, 2, 3])
    risks = spark.createDataFrame(
        [(m, g, risk) for (m, g), (risk, _) in sums.items()], "model string, state int, standardized_risk double"
    )
    cases = [
        F.struct(F.lit(label).alias("model"), R.event_in("destination_state", dests).alias("event"), (F.col("functional_state") == origin).alias("at_risk"))
        for origin, dests, label in S.KEY_TRANSITIONS
    ]
    long = rows.select("id", "state", F.explode(F.array(*cases)).alias("e")).select("id", "state", "e.*").filter("at_risk")
    crude = long.groupBy("model", "state").agg(
        F.count(F.lit(1)).alias("intervals"), F.countDistinct("id").alias("people"), F.sum("event").alias("events")
    )
    crude = crude.withColumn("rate", F.col("events") / F.col("intervals"))
    return rounded(crude.join(F.broadcast(risks), ["model", "state"]))


PAIRS_HALF = "pairs(comparison, stratum, hi, lo) AS (VALUES " + ", ".join(
    f"('{label}', '{stratum}', {hi + 10 * h}, {lo + 10 * h})"
    for h, stratum in ((0, "Half 0"), (1, "Half 1"))
    for label, hi, lo in (
        ("Urgent only", 1, 0),
        ("High spend only", 2, 0),
        ("Both", 3, 0),
        ("Both vs High spend only", 3, 2),
    )
) + ")"


@query(
    "subgroup_rr",
    f"""WITH {S.SQL_INTERVALS}, {S.SQL_PEOPLE}, oh AS (SELECT obs.*, half FROM obs JOIN people ON people.id = obs.id),
    {sql_risk("o.state + 10 * o.half", "oh")}, {sql_saturated(8)}, {PAIRS_HALF},
    est AS (SELECT hi.model, p.stratum, p.comparison, ln(hi.mu / lo.mu) AS b, sqrt(greatest(chh.c + cll.c - 2 * chl.c, 0)) AS se
      FROM pairs p JOIN cell hi ON hi.g = p.hi JOIN cell lo ON lo.g = p.lo AND lo.model = hi.model
      JOIN cov chh ON chh.model = hi.model AND chh.g = p.hi AND chh.h = p.hi JOIN cov cll ON cll.model = hi.model AND cll.g = p.lo AND cll.h = p.lo
      JOIN cov chl ON chl.model = hi.model AND chl.g = p.hi AND chl.h = p.lo),
    iw(g, w) AS (VALUES (13, 1.0), (12, -1.0), (3, -1.0), (2, 1.0)),
    inter AS (SELECT cell.model, sum(iw.w * ln(mu)) AS b FROM cell JOIN iw ON iw.g = cell.g GROUP BY 1),
    iv2 AS (SELECT cov.model, sqrt(greatest(sum(x.w * y.w * c), 0)) AS se FROM cov JOIN iw x ON x.g = cov.g JOIN iw y ON y.g = cov.h GROUP BY 1)
    SELECT est.model, stratum, comparison, round(exp(est.b), 6) AS estimate, round(est.se, 6) AS se_log,
      round(exp(est.b - 1.96 * est.se), 6) AS ci_low, round(exp(est.b + 1.96 * est.se), 6) AS ci_high, round({sql_tail("(est.b / est.se)")}, 6) AS p_value,
      CASE WHEN comparison LIKE '% vs %' THEN round({sql_tail("(inter.b / iv2.se)")}, 6) END AS p_interaction
    FROM est JOIN inter ON inter.model = est.model JOIN iv2 ON iv2.model = est.model""",
)
def subgroup_rr(spark, sf):
    rows = S.with_people(weighted(spark, sf), spark, sf)
    half = Num("half", discrete=True)
    fits = fit_models(rows, transition_models(crossed(STATE, half)), cluster="id")
    out = [
        r
        for f in fits.values()
        for r in E.stratum_rows(f, STATE, "half", S.STATE_LABELS, {0: "Half 0", 1: "Half 1"}, [1, 2, 3], [(3, 2)])
    ]
    return rounded(E.as_table(spark, out, E.STRATUM_FIELDS))


INDEXES = ["Costly", "Repeated", "Urgent"]


@query(
    "heterogeneity_rr",
    f"""WITH {S.SQL_INTERVALS}, {SQL_STACK}, {sql_risk("CASE o.index_name WHEN 'Urgent' THEN 0 WHEN 'Costly' THEN 10 ELSE 20 END + o.index_flag", "stacked", "o.b = 1")},
    {sql_saturated(6)}, cmp(comparison, base) AS (VALUES ('Urgent vs Costly', 10), ('Urgent vs Repeated', 20)),
    iw AS (SELECT comparison, unnest([base + 1, base, 1, 0]) AS g, unnest([1, -1, -1, 1]) AS w FROM cmp),
    b AS (SELECT cell.model, comparison, sum(w * ln(mu)) AS b FROM cell JOIN iw ON iw.g = cell.g GROUP BY 1, 2),
    s AS (SELECT cov.model, x.comparison, sqrt(greatest(sum(x.w * y.w * c), 0)) AS se FROM cov JOIN iw x ON x.g = cov.g JOIN iw y ON y.g = cov.h AND y.comparison = x.comparison GROUP BY 1, 2)
    SELECT b.model, b.comparison, round(exp(-b), 6) AS estimate, round(exp(-b - 1.96 * se), 6) AS ci_low, round(exp(-b + 1.96 * se), 6) AS ci_high,
      round({sql_tail("(b / se)")}, 6) AS p_heterogeneity, n AS n_rows, people
    FROM b JOIN s ON s.model = b.model AND s.comparison = b.comparison JOIN tot ON tot.model = b.model""",
)
def heterogeneity_rr(spark, sf):
    """Does an index condition add as much as the others, among those with the second exposure?"""
    rows = index_stack(weighted(spark, sf))
    index = Cat("index_name", reference="Urgent", levels=tuple(INDEXES))
    terms = crossed(index, Num("index_flag", discrete=True))
    fits = fit_models(rows, transition_models(terms, where=F.col("b") == 1), cluster="id")
    out = []
    for f in fits.values():
        for other in ("Costly", "Repeated"):
            found = E.ratio(f, {f"index_name[{other}]:index_flag": 1.0}, sign=-1.0)
            out.append(
                {
                    **found,
                    "model": f.name,
                    "comparison": f"Urgent vs {other}",
                    "p_heterogeneity": found["p_value"],
                    "n_rows": f.n,
                    "people": f.clusters,
                }
            )
    fields = "model string, comparison string, estimate double, ci_low double, ci_high double, p_heterogeneity double, n_rows bigint, people bigint"
    return rounded(E.as_table(spark, out, fields))


@query(
    "index_condition_rr",
    f"""WITH {S.SQL_INTERVALS}, {SQL_STACK}, {SQL_SPECS},
    r AS (SELECT s.model || ': ' || o.index_name AS model, o.id, o.index_state AS g, CAST(o.n_orders AS DOUBLE) AS w, CASE WHEN o.destination_state IN (s.d1, s.d2) THEN 1.0 ELSE 0.0 END AS y
          FROM stacked o JOIN specs s ON o.functional_state = s.origin),
    {sql_saturated(4)}, pairs(comparison, hi, lo, critical) AS (VALUES ('Both vs High spend only', 3, 2, 1.96::DOUBLE)), {SQL_PAIRS}
    SELECT est.model, comparison, round(exp(b), 6) AS estimate, round(exp(b - critical * se), 6) AS ci_low, round(exp(b + critical * se), 6) AS ci_high,
      n AS n_intervals, events, people FROM est JOIN tot ON tot.model = est.model""",
)
def index_condition_rr(spark, sf):
    """The same models for every index condition, in one stacked fit."""
    rows = index_stack(weighted(spark, sf))
    exposure = Cat("index_state", reference=0, levels=(0, 1, 2, 3))
    models = [
        m
        for name in INDEXES
        for m in transition_models([exposure], where=F.col("index_name") == name, suffix=f": {name}")
    ]
    fits = fit_models(rows, models, cluster="id")
    out = [r for f in fits.values() for r in E.ratio_rows(f, "index_state", [], S.STATE_LABELS, [(3, 2)])]
    table = E.as_table(spark, out, E.RATIO_FIELDS)
    return rounded(table.drop("se_log", "p_value"))


HISTORY = Cat("history_group", reference=HISTORY_GROUPS["single_never"], levels=tuple(GROUPS))
SQL_OBS_HISTORY = "oh AS (SELECT obs.*, complete_history, both_count, history_group FROM obs JOIN history h ON h.id = obs.id AND h.wave = obs.wave)"


@query(
    "history_rr",
    f"""WITH {S.SQL_INTERVALS}, {SQL_HISTORY}, {SQL_OBS_HISTORY}, {sql_risk("o.history_group", "oh", "o.history_group IN (" + ", ".join(f"'{g}'" for g in GROUPS) + ")")},
    {sql_saturated(4)}, pairs(comparison, hi, lo, critical) AS (VALUES {", ".join(f"('{g}', '{g}', '{GROUPS[0]}', 1.959963984540054::DOUBLE)" for g in GROUPS[1:])}), {SQL_PAIRS}
    SELECT {RATIO_COLUMNS} FROM est JOIN tot ON tot.model = est.model""",
)
def history_rr(spark, sf):
    rows = interval_history(spark, sf).withColumn("w", F.col("n_orders").cast("double"))
    among = F.col("history_group").isin(GROUPS)
    fits = fit_models(rows, transition_models([HISTORY], where=among), cluster="id")
    labels = {g: g for g in GROUPS}
    out = [r for f in fits.values() for r in E.ratio_rows(f, "history_group", GROUPS[1:], labels)]
    return rounded(E.as_table(spark, out, E.RATIO_FIELDS))


@query(
    "dose_rr",
    f"""WITH {S.SQL_INTERVALS}, {SQL_HISTORY}, {SQL_OBS_HISTORY}, {sql_risk("CASE WHEN o.both_count = 1 THEN 0 ELSE 1 END", "oh", "o.complete_history = 1 AND o.state = 3 AND o.both_count >= 1")},
    {sql_saturated(2)}, pairs(comparison, hi, lo, critical) AS (VALUES ('At least two vs one', 1, 0, 1.959963984540054::DOUBLE)), {SQL_PAIRS}
    SELECT {RATIO_COLUMNS} FROM est JOIN tot ON tot.model = est.model""",
)
def dose_rr(spark, sf):
    rows = interval_history(spark, sf).withColumn("w", F.col("n_orders").cast("double"))
    burden = F.when(F.col("both_count") == 1, "One").when(F.col("both_count") >= 2, "Two or more")
    rows = rows.withColumn("burden", burden)
    among = (F.col("complete_history") == 1) & (F.col("state") == 3)
    term = Cat("burden", reference="One", levels=("One", "Two or more"))
    fits = fit_models(rows, transition_models([term], where=among), cluster="id")
    out = [
        r for f in fits.values() for r in E.ratio_rows(f, "burden", ["Two or more"], {"Two or more": "At least two vs one"})
    ]
    return rounded(E.as_table(spark, out, E.RATIO_FIELDS))


SQL_BAND = """mean_lines AS (SELECT o_custkey AS id, CAST(year(o_orderdate) - 1994 AS INTEGER) AS wave, avg(l_quantity) AS q
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2),
ob AS (SELECT obs.*, CASE WHEN q < 22 THEN 0 WHEN q <= 28 THEN 1 WHEN q > 28 THEN 2 ELSE 3 END AS band FROM obs LEFT JOIN mean_lines m ON m.id = obs.id AND m.wave = obs.wave)"""


def banded(spark, sf):
    """Intervals with a time-varying covariate: the wave's mean line quantity in bands."""
    line = S.table(spark, sf, "lineitem", "l_orderkey", "l_quantity")
    per_order = line.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"), F.count("l_quantity").alias("lines"))
    orders = S.table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    waves = (
        orders.join(per_order, F.col("o_orderkey") == F.col("l_orderkey"))
        .groupBy(F.col("o_custkey").alias("id"), (F.year("o_orderdate") - S.FIRST_YEAR).alias("wave"))
        .agg((F.sum("q") / F.sum("lines")).alias("quantity"))
    )
    joined = joins.checked_join(weighted(spark, sf), waves, ["id", "wave"])
    return stored(joined.withColumn("band", R.banded("quantity", 22, 28)), "banded")


def sql_two_factor(model: str) -> str:
    """Main-effects Poisson fit of r2(g, h, w, y) by alternating margins, for the ratio of level 3 to 2."""
    return f"""grid AS (SELECT coalesce(sum(w), 0) AS w, coalesce(sum(w * y), 0) AS y, gs.g, hs.h FROM (SELECT unnest([0, 1, 2, 3]) AS g) gs CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS h) hs
      LEFT JOIN (SELECT * FROM r WHERE model = '{model}') r ON r.g = gs.g AND r.h = hs.h GROUP BY 3, 4),
    gw AS (SELECT g, list(w ORDER BY h) AS ws, sum(y) AS y FROM grid GROUP BY g),
    hw AS (SELECT h, list(w ORDER BY g) AS ws, sum(y) AS y FROM grid GROUP BY h),
    m AS (SELECT (SELECT list(ws ORDER BY g) FROM gw) AS rows_w, (SELECT list(y ORDER BY g) FROM gw) AS rows_y, (SELECT list(ws ORDER BY h) FROM hw) AS cols_w, (SELECT list(y ORDER BY h) FROM hw) AS cols_y),
    fit(step, alpha, beta) AS (
      SELECT 0, [1.0::DOUBLE, 1.0, 1.0, 1.0], [1.0::DOUBLE, 1.0, 1.0, 1.0]
      UNION ALL SELECT step + 1, a, list_transform(range(1, 5), lambda j: CASE WHEN cols_y[j] = 0 THEN 0 ELSE cols_y[j] / list_dot_product(cols_w[j], a) END) FROM (
        SELECT step, m.*, list_transform(range(1, 5), lambda i: CASE WHEN rows_y[i] = 0 THEN 0 ELSE rows_y[i] / list_dot_product(rows_w[i], beta) END) AS a FROM fit, m WHERE step < 60))
    SELECT alpha FROM fit ORDER BY step DESC LIMIT 1"""


SQL_RATIOS = " UNION ALL ".join(
    f"SELECT '{label}' AS model, (WITH RECURSIVE {sql_two_factor(label)}) AS alpha" for _, _, label in S.KEY_TRANSITIONS
)


@query(
    "attenuation",
    f"""WITH {S.SQL_INTERVALS}, {SQL_BAND}, {SQL_SPECS},
    r AS (SELECT s.model, o.id, o.state AS g, o.band AS h, CAST(o.n_orders AS DOUBLE) AS w, CASE WHEN o.destination_state IN (s.d1, s.d2) THEN 1.0 ELSE 0.0 END AS y
          FROM ob o JOIN specs s ON o.functional_state = s.origin),
    cell AS (SELECT model, g, sum(w * y) / sum(w) AS mu FROM r GROUP BY 1, 2), adj AS ({SQL_RATIOS}),
    b AS (SELECT hi.model, ln(hi.mu / lo.mu) AS b0, ln(alpha[4] / alpha[3]) AS b1 FROM cell hi JOIN cell lo ON lo.model = hi.model AND lo.g = 2 AND hi.g = 3 JOIN adj ON adj.model = hi.model)
    SELECT model, round(exp(b0), 6) AS primary_ratio, round(exp(b1), 6) AS adjusted_ratio, round(100 * (abs(b0) - abs(b1)) / abs(b0), 4) AS attenuation_percent,
      (SELECT count(*) FROM r WHERE r.model = b.model) AS n_intervals, (SELECT count(*) FROM r WHERE r.model = b.model AND h = 3) AS covariate_missing FROM b""",
)
def attenuation(spark, sf):
    rows = banded(spark, sf)
    band = Cat("band", reference=1, levels=(0, 1, 2, 3))
    models = transition_models([STATE]) + transition_models([STATE, band], suffix=" adjusted")
    fits = fit_models(rows, models, cluster="id")
    gaps = rows.filter("band = 3").groupBy("functional_state").count().collect()
    missing = {r[0]: r[1] for r in gaps}
    out = []
    contrast = {"state[3]": 1.0, "state[2]": -1.0}
    for origin, _, label in S.KEY_TRANSITIONS:
        before, after = (E.linear(fits[n], contrast)[0] for n in (label, f"{label} adjusted"))
        out.append(
            {
                "model": label,
                "primary_ratio": E.ratio(fits[label], contrast)["estimate"],
                "adjusted_ratio": E.ratio(fits[f"{label} adjusted"], contrast)["estimate"],
                "attenuation_percent": E.attenuation(before, after),
                "n_intervals": fits[f"{label} adjusted"].n,
                "covariate_missing": missing.get(origin, 0),
            }
        )
    fields = "model string, primary_ratio double, adjusted_ratio double, attenuation_percent double, n_intervals bigint, covariate_missing bigint"
    return rounded(E.as_table(spark, out, fields)).withColumn(
        "attenuation_percent", F.round("attenuation_percent", 4)
    )


SQL_OLS = """xy AS (SELECT l_quantity AS x, l_extendedprice / 1000 AS y, l_linenumber FROM lineitem),
m AS (SELECT count(*) AS n, avg(x) AS xm, avg(y) AS ym, var_pop(x) * count(*) AS sxx, regr_slope(y, x) AS b FROM xy)"""


def line_fit(spark, sf, errors):
    rows = S.table(spark, sf, "lineitem", "l_quantity", "l_extendedprice").select(
        F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y")
    )
    models = [Model(e, F.col("y"), (Num("x"),), family="gaussian", errors=e) for e in errors]
    return fit_models(rows, models)


@query(
    "ols_slope",
    f"WITH {SQL_OLS} SELECT round(ym - b * xm, 6) AS intercept, round(b, 6) AS slope, n FROM m",
)
def ols_slope(spark, sf):
    fit = line_fit(spark, sf, ["HC0"])["HC0"]
    row = {"intercept": float(fit.beta[0]), "slope": float(fit.beta[1]), "n": fit.n}
    return rounded(E.as_table(spark, [row], "intercept double, slope double, n bigint"))


@query(
    "ols_hc1_hc3",
    f"""WITH {SQL_OLS}, e AS (SELECT (x - xm) AS d, y - ym - b * (x - xm) AS e, 1.0 / n + (x - xm) * (x - xm) / sxx AS h, sxx, n, b FROM xy, m)
    SELECT 'HC1' AS errors, round(any_value(b), 6) AS slope, round(sqrt(sum(d * d * e * e) / any_value(sxx * sxx) * any_value(n / (n - 2.0))), 8) AS se FROM e
    UNION ALL SELECT 'HC3', round(any_value(b), 6), round(sqrt(sum(d * d * e * e / ((1 - h) * (1 - h))) / any_value(sxx * sxx)), 8) FROM e""",
)
def ols_hc1_hc3(spark, sf):
    fits = line_fit(spark, sf, ["HC1", "HC3"])
    rows = [
        {"errors": e, "slope": round(float(f.beta[1]), 6), "se": round(float(f.cov[1, 1]) ** 0.5, 8)}
        for e, f in fits.items()
    ]
    return E.as_table(spark, rows, "errors string, slope double, se double")


@query(
    "mediator_link",
    f"""WITH {S.SQL_INTERVALS}, {SQL_BAND},
    r AS (SELECT 'm' AS model, id, CASE WHEN state = 3 THEN 1 ELSE 0 END AS g, 1.0 AS w, CASE WHEN band = 0 THEN 1.0 ELSE 0.0 END AS y FROM ob WHERE state IN (2, 3) AND band < 3),
    {sql_saturated(2, "binomial")},
    e AS (SELECT ln(h.mu / (1 - h.mu)) - ln(l.mu / (1 - l.mu)) AS b, sqrt(a.c + c.c - 2 * d.c) AS se FROM cell h, cell l, cov a, cov c, cov d
      WHERE h.g = 1 AND l.g = 0 AND a.g = 1 AND a.h = 1 AND c.g = 0 AND c.h = 0 AND d.g = 1 AND d.h = 0)
    SELECT round(exp(b), 6) AS estimate, round(exp(b - 1.96 * se), 6) AS ci_low, round(exp(b + 1.96 * se), 6) AS ci_high, n, people FROM e, tot""",
)
def mediator_link(spark, sf):
    """Exposure and a later binary mediator, by person-clustered logit."""
    rows = banded(spark, sf).filter("state in (2, 3)").withColumn("both", R.flag(F.col("state") == 3))
    short = F.when(F.col("band") < 3, R.flag(F.col("band") == 0))
    model = Model("short", short, (Num("both", discrete=True),), family="binomial", where=F.col("band") < 3)
    fit = fit_models(rows, [model], cluster="id")["short"]
    row = {**E.ratio(fit, {"both": 1.0}), "n": fit.n, "people": fit.clusters}
    fields = "estimate double, ci_low double, ci_high double, n bigint, people bigint"
    return rounded(E.as_table(spark, [row], fields))


@query(
    "continuous_mediator_link",
    f"""WITH {S.SQL_PANEL}, {S.SQL_PEOPLE}, z AS (
      SELECT p.id, state, (spend - avg(spend) OVER w) / stddev_samp(spend) OVER w AS z FROM panel p JOIN people q ON q.id = p.id WHERE wave = 3 WINDOW w AS (PARTITION BY half)),
    r AS (SELECT CASE WHEN a.state IN (1, 3) THEN 1 ELSE 0 END AS g, z.z AS y FROM z JOIN panel a ON a.id = z.id AND a.wave = 2),
    c AS (SELECT g, count(*) AS n, avg(y) AS m FROM r GROUP BY 1),
    v AS (SELECT r.g, sum((y - m) * (y - m) / ((1 - 1.0 / n) * (1 - 1.0 / n))) / any_value(n * n) AS v FROM r JOIN c ON c.g = r.g GROUP BY 1)
    SELECT round(max(CASE WHEN g = 1 THEN m END) - max(CASE WHEN g = 0 THEN m END), 6) AS estimate, round((SELECT sqrt(sum(v)) FROM v), 6) AS se, CAST(sum(n) AS BIGINT) AS n FROM c""",
)
def continuous_mediator_link(spark, sf):
    """Exposure at one wave and the standardised reading at the next, by OLS with HC3 errors."""
    waves = S.panel(spark, sf)
    origin = waves.filter("wave = 2").select("id", R.flag(F.col("state").isin(1, 3)).alias("exposed"))
    later = S.with_people(waves.filter("wave = 3").select("id", "spend"), spark, sf)
    scaled = standardise_within(later, ["half"], {"spend": "z"})
    rows = joins.checked_join(scaled, origin, ["id"], how="inner")
    fit = fit_models(rows, [Model("z", F.col("z"), (Num("exposed"),), family="gaussian", errors="HC3")])["z"]
    row = {**E.difference(fit, {"exposed": 1.0}), "n": fit.n}
    return rounded(E.as_table(spark, [row], "estimate double, se double, n bigint"))


@query(
    "lr_test_saturated",
    f"""WITH {S.SQL_INTERVALS}, x AS (SELECT a, b, CASE WHEN destination_state = 2 THEN 1.0 ELSE 0.0 END AS y FROM obs),
    f AS (SELECT sum(n * (p * ln(p) + (1 - p) * ln(1 - p))) AS ll FROM (SELECT a, b, count(*) AS n, avg(y) AS p FROM x GROUP BY 1, 2)),
    d AS (SELECT sum(n * (p * ln(p) + (1 - p) * ln(1 - p))) AS ll FROM (SELECT a, count(*) AS n, avg(y) AS p FROM x GROUP BY 1))
    SELECT round(2 * (f.ll - d.ll), 6) AS chi2, 2 AS df, round(exp(-(f.ll - d.ll)), 6) AS p_value FROM f, d""",
)
def lr_test_saturated(spark, sf):
    rows = S.observed(spark, sf)
    a, b = Num("a", discrete=True), Num("b", discrete=True)
    event = R.event_in("destination_state", [2])
    fits = fit_models(
        rows,
        [
            Model("full", event, crossed(a, b), family="binomial", errors="HC0"),
            Model("reduced", event, (a,), family="binomial", errors="HC0"),
        ],
    )
    test = E.likelihood_ratio(fits["full"], fits["reduced"])
    return rounded(E.as_table(spark, [test], "chi2 double, df int, p_value double"))


@query(
    "logit_newton",
    f"""WITH RECURSIVE {S.SQL_INTERVALS}, x AS (SELECT CASE WHEN destination_state = 2 THEN 1.0 ELSE 0.0 END AS y, spend / 100000 AS x FROM obs),
    it(step, b0, b1) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE
      UNION ALL SELECT any_value(step) + 1,
        any_value(b0) + (sum(p * (1 - p) * x * x) * sum(y - p) - sum(p * (1 - p) * x) * sum((y - p) * x)) / (sum(p * (1 - p)) * sum(p * (1 - p) * x * x) - sum(p * (1 - p) * x) * sum(p * (1 - p) * x)),
        any_value(b1) + (sum(p * (1 - p)) * sum((y - p) * x) - sum(p * (1 - p) * x) * sum(y - p)) / (sum(p * (1 - p)) * sum(p * (1 - p) * x * x) - sum(p * (1 - p) * x) * sum(p * (1 - p) * x))
      FROM (SELECT step, b0, b1, x, y, 1 / (1 + exp(-(b0 + b1 * x))) AS p FROM it, x WHERE step < 10) HAVING count(*) > 0)
    SELECT round(b0, 6) AS intercept, round(b1, 6) AS slope FROM it ORDER BY step DESC LIMIT 1""",
)
def logit_newton(spark, sf):
    rows = S.observed(spark, sf).withColumn("x", F.col("spend") / 100000)
    model = Model("logit", R.event_in("destination_state", [2]), (Num("x"),), family="binomial", errors="HC0")
    fit = fit_models(rows, [model])["logit"]
    row = {"intercept": float(fit.beta[0]), "slope": float(fit.beta[1])}
    return rounded(E.as_table(spark, [row], "intercept double, slope double"))


#: Of the slope's square in the two queries below.
RIDGE = 40


@query(
    "ridge_logit_newton",
    f"""WITH RECURSIVE {S.SQL_INTERVALS}, x AS (SELECT CASE WHEN destination_state = 2 THEN 1.0 ELSE 0.0 END AS y, spend / 100000 AS x FROM obs),
    it(step, b0, b1) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE
      UNION ALL SELECT step + 1, b0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
      FROM (SELECT any_value(step) AS step, any_value(b0) AS b0, any_value(b1) AS b1, sum(y - p) AS g0, sum((y - p) * x) - {RIDGE} * any_value(b1) AS g1,
          sum(p * (1 - p)) AS h00, sum(p * (1 - p) * x) AS h01, sum(p * (1 - p) * x * x) + {RIDGE} AS h11
        FROM (SELECT step, b0, b1, x, y, 1 / (1 + exp(-(b0 + b1 * x))) AS p FROM it, x WHERE step < 12) HAVING count(*) > 0))
    SELECT unnest(['binary', 'two classes']) AS model, round(b0, 6) AS intercept, round(b1, 6) AS slope FROM (SELECT * FROM it ORDER BY step DESC LIMIT 1)""",
)
def ridge_logit_newton(spark, sf):
    """A penalised slope; two classes share the penalty between them, so theirs is twice as large."""
    rows = S.observed(spark, sf).withColumn("x", F.col("spend") / 100000)
    flagged = R.event_in("destination_state", [2])
    models = [
        Model("binary", flagged, (Num("x"),), family="binomial", errors="none", penalty=RIDGE),
        Model("two classes", flagged, (Num("x"),), family="multinomial", errors="none", penalty=2 * RIDGE),
    ]
    out = [
        {"model": f.name, "intercept": float(f.beta[0]), "slope": float(f.beta[1])}
        for f in fit_models(rows, models).values()
    ]
    return rounded(E.as_table(spark, out, "model string, intercept double, slope double"))


@query(
    "observation_weights",
    f"""WITH {S.SQL_INTERVALS},
    p AS (SELECT *, least(greatest(avg(outcome_observed) OVER (PARTITION BY state, functional_state, "interval"), 0.02), 0.995) AS p_den,
      least(greatest(avg(outcome_observed) OVER (PARTITION BY functional_state, "interval"), 0.02), 0.995) AS p_num FROM iv),
    q AS (SELECT *, p_num / p_den AS raw FROM p WHERE outcome_observed = 1)
    SELECT id, wave, round(p_den, 6) AS p_denominator, round(p_num, 6) AS p_numerator, round(raw, 6) AS iow_raw,
      round(least(greatest(raw, (SELECT quantile_cont(raw, 0.01) FROM q)), (SELECT quantile_cont(raw, 0.99) FROM q)), 6) AS iow FROM q""",
)
def observation_weights_query(spark, sf):
    rows = S.intervals(spark, sf)
    rows = rows.withColumn("origin_cell", F.concat_ws("|", "functional_state", "interval"))
    rows = rows.withColumn("full_cell", F.concat_ws("|", "state", "functional_state", "interval"))
    weighted_rows, _ = observation_weights(
        stored(rows, "cells"), "outcome_observed", [Cat("full_cell")], [Cat("origin_cell")],
        keep=lambda df: stored(df, "weighted"),
    )
    return rounded(weighted_rows.select("id", "wave", "p_denominator", "p_numerator", "iow_raw", "iow"))


@query(
    "survey_weight_rr",
    f"""WITH {S.SQL_INTERVALS}, ow AS (SELECT *, n_orders / avg(n_orders) OVER (PARTITION BY "interval") AS sw FROM obs),
    {sql_risk(source="ow", weight="o.sw", where="o.sw > 0")}, {sql_saturated(4)}, {PAIRS_STATE}, {SQL_PAIRS}
    SELECT est.model, comparison, round(exp(b), 6) AS estimate, round(se, 6) AS se_log FROM est""",
)
def survey_weight_rr(spark, sf):
    rows = mean_normalised(S.observed(spark, sf), ["interval"], "n_orders", "sw")
    fits = fit_models(rows, transition_models([STATE], weight="sw", where=F.col("sw") > 0), cluster="id")
    out = [r for f in fits.values() for r in E.ratio_rows(f, "state", [1, 2, 3], S.STATE_LABELS, CONTRASTS)]
    return rounded(E.as_table(spark, out, E.RATIO_FIELDS).select("model", "comparison", "estimate", "se_log"))


SQL_LAGGED = f"""{SQL_LAG}, x AS (SELECT * FROM lagged WHERE lag_state IS NOT NULL)"""


@query(
    "msm_weights",
    f"""WITH {S.SQL_INTERVALS}, {SQL_LAGGED},
    p AS (SELECT id, wave, least(greatest(count(*) OVER (PARTITION BY lag_state, state) * 1.0 / count(*) OVER (PARTITION BY lag_state), 0.01), 0.99) AS p_num,
      least(greatest(count(*) OVER (PARTITION BY lag_state, functional_state, state) * 1.0 / count(*) OVER (PARTITION BY lag_state, functional_state), 0.01), 0.99) AS p_den FROM x),
    q AS (SELECT *, product(p_num / p_den) OVER (PARTITION BY id ORDER BY wave ROWS UNBOUNDED PRECEDING) AS raw FROM p)
    SELECT id, wave, round(p_num, 6) AS p_numerator, round(p_den, 6) AS p_denominator, round(raw, 6) AS sw_raw,
      round(least(greatest(raw, (SELECT quantile_cont(raw, 0.01) FROM q)), (SELECT quantile_cont(raw, 0.99) FROM q)), 6) AS sw FROM q""",
)
def msm_weights(spark, sf):
    rows, _ = msm_rows(spark, sf)
    return rounded(rows.select("id", "wave", "p_numerator", "p_denominator", "sw_raw", "sw"))


def msm_rows(spark, sf):
    rows = lagged_intervals(spark, sf).filter("lag_state is not null")
    rows = stored(rows.withColumn("lag_cell", F.concat_ws("|", "lag_state", "functional_state")), "lagged")
    return marginal_structural_weights(
        rows, "id", "wave", "state", [Cat("lag_cell")], [Cat("lag_state")], keep=lambda df: stored(df, "msm")
    )


LIVING, ABSORBING = (0, 1, 2), 3


def moves(origin: int) -> list[tuple[int, list[int]]]:
    """Every move out of a living state, and the joined moves up or down where there are several."""
    single = [(origin, [d]) for d in (*LIVING, ABSORBING) if d != origin]
    sides = ([d for d in LIVING if d < origin], [d for d in LIVING if d > origin])
    return single + [(origin, side) for side in sides if len(side) > 1]


GRID = [move for origin in LIVING for move in moves(origin)]
GRID_SQL = ", ".join(
    f"('{o}->{'+'.join(map(str, d))}', {o}, {d[0]}, {d[-1]})" for o, d in GRID
)


@query(
    "model_grid",
    f"""WITH {S.SQL_INTERVALS}, grid(name, origin, d1, d2) AS (VALUES {GRID_SQL}),
    variants(variant, min_orders, first_waves) AS (VALUES ('unweighted', 1, 9), ('weighted', 1, 9), ('adjusted', 1, 9), ('repeat orders', 2, 9), ('first waves', 1, 4))
    SELECT name || ' ' || variant AS model, count(*) AS n, CAST(sum(CASE WHEN destination_state IN (d1, d2) THEN 1 ELSE 0 END) AS DOUBLE) AS events,
      count(DISTINCT id) AS people, true AS converged
    FROM obs JOIN grid ON functional_state = origin JOIN variants ON n_orders >= min_orders AND wave <= first_waves GROUP BY 1""",
)
def model_grid(spark, sf):
    """Eleven transitions under five specifications: 55 fits that share every pass."""
    audit = model_audit(spark, grid_fits(spark, sf))
    return audit.select("model", "n", "events", "people", "converged")


GRID_SHARED = ("unweighted", "weighted", "repeat orders", "first waves")


@query(
    "grid_saturated_ratios",
    f"""WITH {S.SQL_INTERVALS}, grid(name, origin, d1, d2) AS (VALUES {GRID_SQL}),
    variants(variant, min_orders, first_waves) AS (VALUES ('unweighted', 1, 9), ('weighted', 1, 9), ('repeat orders', 2, 9), ('first waves', 1, 4)),
    r AS (SELECT name || ' ' || variant AS model, id, state AS g, CASE WHEN variant = 'unweighted' THEN 1.0 ELSE CAST(n_orders AS DOUBLE) END AS w,
        CASE WHEN destination_state IN (d1, d2) THEN 1.0 ELSE 0.0 END AS y
      FROM obs JOIN grid ON functional_state = origin JOIN variants ON n_orders >= min_orders AND wave <= first_waves),
    {sql_saturated(4)}, {PAIRS_STATE}, {SQL_PAIRS}
    SELECT est.model, comparison, round(exp(b), 6) AS estimate, round(se, 6) AS se_log FROM est
    WHERE est.model IN (SELECT model FROM cell GROUP BY 1 HAVING min(mu) > 0 AND count(*) = 4)""",
)
def grid_saturated_ratios(spark, sf):
    """The ratios of the grid's 44 fits on the state alone, as far as each state has an event in the fit."""
    rows = weighted(spark, sf)
    models = [m for m in grid_models() if m.name.endswith(GRID_SHARED)]
    fits = fit_models(rows, models, cluster="id")
    events = [F.count_if(m.where & (m.outcome == 1)).alias(m.name) for m in models]
    by_state = rows.groupBy("state").agg(*events).collect()
    full = [m.name for m in models if len([r for r in by_state if r[m.name]]) == len(S.STATE_LABELS)]
    out = [r for n in full for r in E.ratio_rows(fits[n], "state", [1, 2, 3], S.STATE_LABELS, CONTRASTS)]
    return rounded(E.as_table(spark, out, E.RATIO_FIELDS).select("model", "comparison", "estimate", "se_log"))


@query("model_grid_ratios")
def model_grid_ratios(spark, sf):
    """The ratios of every fit of the grid beside its audit; a fit without any keeps one row."""
    fits = grid_fits(spark, sf)
    out = [r for f in fits.values() for r in E.ratio_rows(f, "state", [1, 2, 3], S.STATE_LABELS, CONTRASTS)]
    ratios = E.as_table(spark, out, E.RATIO_FIELDS).drop("n_intervals", "events", "people")
    audit = model_audit(spark, fits).select("model", "n", "events", "people", "converged", "error")
    return rounded(audit.join(ratios, "model", "left"))


def grid_fits(spark, sf):
    return fit_models(weighted(spark, sf), grid_models(), cluster="id")


def grid_models():
    specs = [(o, d, f"{o}->{'+'.join(map(str, d))}") for o, d in GRID]
    wave = Cat("wave", levels=(1, 2, 3, 4, 5))
    return (
        transition_models([STATE], None, specs, suffix=" unweighted")
        + transition_models([STATE], "w", specs, suffix=" weighted")
        + transition_models([STATE, wave], "w", specs, suffix=" adjusted")
        + transition_models([STATE], "w", specs, F.col("n_orders") >= 2, " repeat orders")
        + transition_models([STATE], "w", specs, F.col("wave") <= 4, " first waves")
    )


COVARIATES = (
    Cat("interval"),
    Cat("segment_cat"),
    Cat("region"),
    Num("half", discrete=True),
    Num("balance_filled"),
    Num("balance_missing", discrete=True),
    Num("order_count"),
)


def prepared(spark, sf):
    """All intervals with filled covariates; fills are over the interval rows."""
    rows = S.modelled(S.with_people(S.intervals(spark, sf), spark, sf))
    rows = stored(rows.withColumn("order_count", F.col("n_orders").cast("double")), "intervals")
    filled = fill_missing(rows, median={"balance_k": "balance_filled"})
    return filled.withColumnRenamed("balance_k_missing", "balance_missing")


def fully_weighted(spark, sf, covariates=COVARIATES):
    origin = Cat("functional_state")
    return observation_weights(
        prepared(spark, sf),
        "outcome_observed",
        [STATE, origin, *covariates],
        [origin, Cat("interval")],
        keep=lambda df: stored(df, "weighted"),
    )


@query("adjusted_rr_full")
def adjusted_rr_full(spark, sf):
    """Observation-weighted, covariate-adjusted transition ratios (continuous covariates)."""
    rows, _ = fully_weighted(spark, sf)
    fits = fit_models(rows, transition_models([STATE, *COVARIATES], "iow"), cluster="id")
    out = [r for f in fits.values() for r in E.ratio_rows(f, "state", [1, 2, 3], S.STATE_LABELS, CONTRASTS)]
    return rounded(E.as_table(spark, out, E.RATIO_FIELDS))


#: Rules on fitted intervals: name, key transition, comparison, and the bound that must be above or below one.
GATE_INTERVALS = [
    ("both_predicts_flagged", "Settled to flagged", "Both", "ci_low"),
    ("both_adds_to_high_spend", "Pending to flagged", "Both vs High spend only", "ci_low"),
    ("both_reduces_settling", "Pending to settled", "Both", "ci_high"),
]


def key_gate(rows, ratios, least_people=5000, least_events=200, above=1.0, below=1.0):
    """Size, events of every key transition and three fitted intervals, five rules, and the decision.

    A rule on an interval that no model gave does not hold.
    """
    moves = {
        f"events_{label.lower().replace(' ', '_')}": R.flag(
            (F.col("functional_state") == origin) & F.col("destination_state").isin(destinations)
        )
        for origin, destinations, label in S.KEY_TRANSITIONS
    }
    checks = rows.agg(
        F.count(F.lit(1)).alias("intervals"),
        F.countDistinct("id").alias("people"),
        *[F.coalesce(F.sum(event), F.lit(0)).alias(name) for name, event in moves.items()],
    )
    found = {(r["model"], r["comparison"]): r for r in ratios}
    rules = {
        "enough_people": F.col("people") >= least_people,
        "enough_events": F.least(*moves) >= least_events,
    }
    for name, model, comparison, bound in GATE_INTERVALS:
        value = found.get((model, comparison), {}).get(bound)
        checks = checks.withColumn(f"{name}_{bound}", F.lit(value).cast("double"))
        column = F.col(f"{name}_{bound}")
        rules[name] = column > above if bound == "ci_low" else column < below
    return gate(checks, rules)


@query("decision_gate_full")
def decision_gate_full(spark, sf, least_people=5000, least_events=200, above=1.0, below=1.0):
    """All five rules of the gate, on the observation-weighted, adjusted models of the key transitions."""
    rows, _ = fully_weighted(spark, sf)
    fits = fit_models(rows, transition_models([STATE, *COVARIATES], "iow"), cluster="id")
    ratios = [r for f in fits.values() for r in E.ratio_rows(f, "state", [1, 2, 3], S.STATE_LABELS, CONTRASTS)]
    return rounded(key_gate(rows, ratios, least_people, least_events, above, below))


SQL_GATE_EVENTS = {
    f"events_{label.lower().replace(' ', '_')}": f"CAST(count(*) FILTER (functional_state = {origin} AND destination_state IN ({', '.join(map(str, dests))})) AS BIGINT)"
    for origin, dests, label in S.KEY_TRANSITIONS
}
SQL_GATE_RULES = {
    "enough_people": "people >= 500",
    "enough_events": f"least({', '.join(SQL_GATE_EVENTS)}) >= 200",
    **{n: f"coalesce({n}_{b} {'> 0.9' if b == 'ci_low' else '< 1.1'}, false)" for n, _, _, b in GATE_INTERVALS},
}


@query(
    "decision_gate_saturated",
    f"""WITH {S.SQL_INTERVALS}, {sql_risk()}, {sql_saturated(4)}, {PAIRS_STATE}, {SQL_PAIRS},
    iv_bounds AS (SELECT model, comparison, exp(b - critical * se) AS ci_low, exp(b + critical * se) AS ci_high FROM est),
    c AS (SELECT count(*) AS intervals, count(DISTINCT id) AS people, {", ".join(f"{x} AS {n}" for n, x in SQL_GATE_EVENTS.items())} FROM obs),
    g AS (SELECT c.*, {", ".join(f"(SELECT {b} FROM iv_bounds WHERE model = '{m}' AND comparison = '{k}') AS {n}_{b}" for n, m, k, b in GATE_INTERVALS)} FROM c),
    d AS (SELECT g.*, {", ".join(f"{x} AS {n}" for n, x in SQL_GATE_RULES.items())} FROM g)
    SELECT * REPLACE ({", ".join(f"round({n}_{b}, 6) AS {n}_{b}" for n, _, _, b in GATE_INTERVALS)}),
      CASE WHEN {" AND ".join(SQL_GATE_RULES)} THEN 'CONTINUE' ELSE 'STOP' END AS decision FROM d""",
)
def decision_gate_saturated(spark, sf, least_people=500, least_events=200, above=0.9, below=1.1):
    """The five rules on the weighted models of the state alone, whose intervals have a closed form; wider thresholds."""
    rows, _, fits = state_fits(spark, sf)
    ratios = [r for f in fits.values() for r in E.ratio_rows(f, "state", [1, 2, 3], S.STATE_LABELS, CONTRASTS)]
    return rounded(key_gate(rows, ratios, least_people, least_events, above, below))


@query("adjusted_absolute_risks")
def adjusted_absolute_risks(spark, sf):
    rows, _ = fully_weighted(spark, sf)
    models = transition_models([STATE, *COVARIATES], "iow")
    fits = fit_models(rows, models, cluster="id")
    out = E.standardised_risks(rows, models, fits, "state", [0, 1, 2, 3], S.STATE_LABELS, [(3, 2)])
    return rounded(E.as_table(spark, out, E.RISK_FIELDS))


WITHOUT_BALANCE = tuple(t for t in COVARIATES if not t.columns[0].startswith("balance"))


@query("omit_covariate_sensitivity")
def omit_covariate_sensitivity(spark, sf):
    """Weights and models refitted without the covariate that is often missing."""
    rows, _ = fully_weighted(spark, sf, WITHOUT_BALANCE)
    fits = fit_models(rows, transition_models([STATE, *WITHOUT_BALANCE], "iow"), cluster="id")
    out = [r for f in fits.values() for r in E.ratio_rows(f, "state", [1, 2, 3], S.STATE_LABELS, [(3, 2)])]
    return rounded(E.as_table(spark, out, E.RATIO_FIELDS))


TREATMENT = (Cat("lag_state"), *COVARIATES)
TREATMENT_SEEN = (Cat("functional_state"), Num("lag_reading_filled"), Num("lag_reading_missing", discrete=True))
TREATMENT_PENALTY = 1e-6


def treatment_rows(spark, sf):
    """Intervals with the exposure and the reading of the wave before; readings above 300,000 count as missing."""
    rows = prepared(spark, sf).withColumn("reading", R.in_range("spend", 0, 300_000) / 1000)
    rows = add_previous_wave(rows, "id", "wave", {"state": "lag_state", "reading": "lag_reading"})
    rows = stored(rows.filter("lag_state is not null"), "treatment")
    return fill_missing(rows, median={"lag_reading": "lag_reading_filled"})


@query("msm_rr")
def msm_rr(spark, sf):
    """Transition ratios under exposure-history weights times observation weights.

    Both treatment models hold the covariates; the denominator also the origin, the reading of the wave
    before and whether it was missing.
    """
    seen, _ = fully_weighted(spark, sf)
    history, _ = marginal_structural_weights(
        treatment_rows(spark, sf), "id", "wave", "state", (*TREATMENT, *TREATMENT_SEEN), TREATMENT,
        keep=lambda df: stored(df, "msm"), penalty=TREATMENT_PENALTY,
    )
    rows = joins.checked_join(seen, history.select("id", "wave", "sw"), ["id", "wave"], how="inner")
    rows = rows.withColumn("msm_weight", F.col("iow") * F.col("sw"))
    fits = fit_models(rows, transition_models([STATE, *COVARIATES], "msm_weight"), cluster="id")
    out = [r for f in fits.values() for r in E.ratio_rows(f, "state", [], S.STATE_LABELS, [(3, 2)])]
    return rounded(E.as_table(spark, out, E.RATIO_FIELDS))


def decline_fit(spark, sf):
    rows = prepared(spark, sf).filter("outcome_observed = 1")
    terms = (*crossed(STATE, Num("half", discrete=True)), Cat("segment_cat"), Num("balance_filled"))
    model = Model("Any decline", R.event_in("destination_state", [2]), terms, where=F.col("functional_state") < 2, family="binomial", errors="HC1")
    return rows, model, fit_models(rows, [model])


@query("coefficient_table")
def coefficient_table(spark, sf):
    _, _, fits = decline_fit(spark, sf)
    return rounded(E.as_table(spark, E.coefficient_rows(fits["Any decline"]), E.COEFFICIENT_FIELDS))


def sql_entries(columns: dict[str, str]) -> str:
    return ", ".join(f"{{'term': '{name}', 'x': CAST({x} AS DOUBLE)}}" for name, x in columns.items())


def sql_balance(columns: dict[str, str], source: str, digits: int = 3) -> str:
    """Weighted sums of y times each column; a fit must give the same for its means."""
    return f"""l AS (SELECT model, w, y, unnest([{sql_entries(columns)}], recursive := true) FROM {source})
    SELECT model, term, round(sum(w * x * y), {digits}) AS observed, round(sum(w * x * y), {digits}) AS fitted FROM l GROUP BY 1, 2"""


#: Reference levels are the smallest of each: the first interval (of wave 1), segment and region.
SQL_ADJUSTED_COLUMNS = {
    "intercept": "1",
    **{f"state[{g}]": f"state = {g}" for g in (1, 2, 3)},
    **{f"interval[{S.FIRST_YEAR + w}-{S.FIRST_YEAR + w + 1}]": f"wave = {w}" for w in range(2, S.LAST_ORIGIN + 1)},
    **{f"segment_cat[{c}]": f"segment = '{c}'" for c in ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")},
    **{f"region[{g}]": f"region = {g}" for g in (1, 2, 3, 4)},
    "half": "half",
    "balance_filled": "coalesce(balance, (SELECT median(p.balance) FROM iv JOIN people p ON p.id = iv.id)) / 1000",
    "balance_missing": "balance IS NULL",
    "order_count": "n_orders",
}
SQL_WITH_PEOPLE = "(SELECT obs.*, segment, region, half, balance FROM obs JOIN people ON people.id = obs.id)"


def adjusted_fits(spark, sf):
    rows = prepared(spark, sf).filter("outcome_observed = 1").withColumn("w", F.col("n_orders").cast("double"))
    models = transition_models([STATE, *COVARIATES])
    return rows, models, fit_models(rows, models, cluster="id")


@query(
    "adjusted_balance",
    f"WITH {S.SQL_INTERVALS}, {S.SQL_PEOPLE}, {sql_risk(source=SQL_WITH_PEOPLE).replace('o.state AS g', 'o.*')}, {sql_balance(SQL_ADJUSTED_COLUMNS, 'r')}",
)
def adjusted_balance(spark, sf):
    """Observed against fitted events, by every level and number of the covariate-adjusted transition models."""
    rows, models, fits = adjusted_fits(spark, sf)
    return rounded(E.balance(rows, fits, models), 3)


SQL_ORIGIN_COLUMNS = {f"functional_state[{g}]": f"functional_state = {g}" for g in (1, 2)}


@query(
    "observation_balance",
    f"""WITH {S.SQL_INTERVALS}, {S.SQL_PEOPLE},
    r AS (SELECT unnest(['denominator', 'numerator']) AS model, 1.0 AS w, outcome_observed AS y, iv.*, segment, region, half, balance
      FROM iv JOIN people ON people.id = iv.id), {sql_balance({**SQL_ADJUSTED_COLUMNS, **SQL_ORIGIN_COLUMNS}, "r")}
    HAVING model = 'denominator' OR term = 'intercept' OR term LIKE 'interval%' OR term LIKE 'functional%'""",
)
def observation_balance(spark, sf):
    """Observed against fitted outcomes seen, by every column of both models behind the observation weights."""
    rows, origin = prepared(spark, sf), Cat("functional_state")
    models = observation_models("outcome_observed", [STATE, origin, *COVARIATES], [origin, Cat("interval")])
    return rounded(E.balance(rows, fit_models(rows, models), models), 3)


SQL_REDUCED_COLUMNS = {c: x for c, x in SQL_ADJUSTED_COLUMNS.items() if not c.startswith("balance")}


@query(
    "omitted_balance",
    f"""WITH {S.SQL_INTERVALS}, {S.SQL_PEOPLE}, {SQL_SPECS},
    r AS (SELECT 'denominator' AS model, 1.0 AS w, outcome_observed AS y, iv.*, segment, region, half FROM iv JOIN people ON people.id = iv.id
      UNION ALL SELECT s.model, CAST(n_orders AS DOUBLE), (destination_state IN (d1, d2))::INT, iv.*, segment, region, half
      FROM iv JOIN people ON people.id = iv.id JOIN specs s ON functional_state = s.origin WHERE outcome_observed = 1),
    {sql_balance({**SQL_REDUCED_COLUMNS, **SQL_ORIGIN_COLUMNS}, "r")} HAVING model = 'denominator' OR term NOT LIKE 'functional%'""",
)
def omitted_balance(spark, sf):
    """Observed against fitted sums of the observation and transition models without the covariate that is often missing."""
    rows = prepared(spark, sf).withColumn("w", F.col("n_orders").cast("double"))
    origin, seen = Cat("functional_state"), F.col("outcome_observed") == 1
    denominator, _ = observation_models("outcome_observed", [STATE, origin, *WITHOUT_BALANCE], [origin, Cat("interval")])
    models = [denominator, *transition_models([STATE, *WITHOUT_BALANCE], where=seen)]
    return rounded(E.balance(rows, fit_models(rows, models, cluster="id"), models), 3)


MANY_LEVELS = tuple(range(1, 13))


@query(
    "absent_exposure_levels",
    f"""WITH {S.SQL_INTERVALS}, {SQL_SPECS}, r AS (SELECT s.model, least(n_orders, 12) AS g FROM obs JOIN specs s ON functional_state = s.origin),
    n AS (SELECT model, count(*) AS n FROM r GROUP BY 1), k AS (SELECT model, unnest(range(2, 13)) AS g FROM n)
    SELECT k.model, 'orders[' || k.g || ']' AS term, count(r.g) > 0 AS in_model, count(r.g) AS intervals, any_value(n) AS n
    FROM k JOIN n ON n.model = k.model LEFT JOIN r ON r.model = k.model AND r.g = k.g GROUP BY 1, 2""",
)
def absent_exposure_levels(spark, sf):
    """An audit row for every declared level of an exposure: those without rows in a risk set are absent from its model."""
    rows = weighted(spark, sf).withColumn("orders", R.clip("n_orders", high=MANY_LEVELS[-1]).cast("int"))
    models = transition_models([Cat("orders", reference=1, levels=MANY_LEVELS)])
    fits = fit_models(rows, models, cluster="id")
    counts = rows.groupBy("orders").agg(*[F.count_if(m.where).alias(m.name) for m in models]).collect()
    found = {(m.name, r["orders"]): r[m.name] for m in models for r in counts}
    out = []
    for m in models:
        missing = E.absent_rows(fits[m.name], "orders", MANY_LEVELS[1:])
        for level in MANY_LEVELS[1:]:
            term = f"orders[{level}]"
            out.append({"model": m.name, "term": term, "in_model": term not in missing, "intervals": found.get((m.name, level), 0), "n": fits[m.name].n})
    return E.as_table(spark, out, "model string, term string, in_model boolean, intervals bigint, n bigint")


SQL_TREATMENT_COLUMNS = {
    **{c: x for c, x in SQL_ADJUSTED_COLUMNS.items() if not c.startswith(("state", f"interval[{S.FIRST_YEAR + 2}-"))},
    **{f"lag_state[{g}]": f"lag_state = {g}" for g in (1, 2, 3)},
    **SQL_ORIGIN_COLUMNS,
    "lag_reading_filled": "coalesce(lag_reading, (SELECT median(lag_reading) FROM t))",
    "lag_reading_missing": "lag_reading IS NULL",
}


@query(
    "treatment_balance",
    f"""WITH {S.SQL_INTERVALS}, {S.SQL_PEOPLE},
    t AS (SELECT iv.*, segment, region, half, balance, q.state AS lag_state, CASE WHEN q.spend <= 300000 THEN q.spend / 1000 END AS lag_reading
      FROM iv JOIN panel q ON q.id = iv.id AND q.wave = iv.wave - 1 JOIN people ON people.id = iv.id),
    c AS (SELECT *, unnest([0, 1, 2, 3]) AS class FROM t),
    l AS (SELECT (state = class)::INT AS y, class, unnest([{sql_entries(SQL_TREATMENT_COLUMNS)}], recursive := true) FROM c),
    s AS (SELECT term, class, round(sum(x * y), 3) AS v FROM l GROUP BY 1, 2)
    SELECT model, term || '|' || class AS term, v AS observed, v AS fitted
    FROM s CROSS JOIN (VALUES ('p_denominator'), ('p_numerator')) m(model)
    WHERE model = 'p_denominator' OR NOT (term LIKE 'functional%' OR term LIKE 'lag_reading%')""",
)
def treatment_balance(spark, sf):
    """People by exposure, observed against fitted, for every column of both multinomial models behind ``msm_rr``."""
    designs = {"p_denominator": (*TREATMENT, *TREATMENT_SEEN), "p_numerator": TREATMENT}
    rows, models, fits = class_models(treatment_rows(spark, sf), "state", designs, TREATMENT_PENALTY)
    return rounded(E.balance(rows, fits, models), 3)


SQL_DECLINE_COLUMNS = {
    **{c: SQL_ADJUSTED_COLUMNS[c] for c in SQL_ADJUSTED_COLUMNS if c.startswith(("intercept", "state", "segment_cat", "half", "balance_filled"))},
    **{f"state[{g}]:half": f"(state = {g})::INT * half" for g in (1, 2, 3)},
}


@query(
    "coefficient_balance",
    f"""WITH {S.SQL_INTERVALS}, {S.SQL_PEOPLE}, r AS (SELECT 'Any decline' AS model, o.*, 1.0 AS w, (destination_state = 2)::INT AS y
      FROM {SQL_WITH_PEOPLE} o WHERE functional_state < 2), {sql_balance(SQL_DECLINE_COLUMNS, "r")}""",
)
def coefficient_balance(spark, sf):
    """The same check of the logistic model with products behind ``coefficient_table``."""
    rows, model, fits = decline_fit(spark, sf)
    return rounded(E.balance(rows, fits, [model]), 3)


@query(
    "nested_audit",
    f"""WITH {S.SQL_INTERVALS},
    c AS (SELECT wave, functional_state AS s, count(*) AS n, count(outcome_observed) FILTER (outcome_observed = 1) AS seen FROM iv GROUP BY 1, 2),
    w AS (SELECT wave, CAST(sum(n) AS BIGINT) AS n, map_from_entries(list({{'k': CAST(s AS VARCHAR), 'v': {{'intervals': n, 'observed': seen}}}} ORDER BY s)) AS by_state FROM c GROUP BY 1)
    SELECT CAST(to_json({{'intervals': CAST(sum(n) AS BIGINT), 'waves': map_from_entries(list({{'k': CAST(wave AS VARCHAR), 'v': {{'intervals': n, 'by_state': by_state}}}} ORDER BY wave)),
      'models': {{'Settled to flagged': true, 'Pending to flagged': true, 'Pending to settled': true, 'Flagged to better': true}}}}) AS VARCHAR) AS document FROM w""",
)
def nested_audit(spark, sf):
    """One document of nested maps: intervals by wave and state from one aggregate, and each model's convergence."""
    rows = S.intervals(spark, sf)
    counted = rows.groupBy("wave", F.col("functional_state").alias("s")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome_observed") == 1).alias("seen")
    )
    held = tables.stored(counted, "audit_counts")
    states = tables.grouped_map(held, ["wave"], "s", F.struct(F.col("n").alias("intervals"), F.col("seen").alias("observed")), "by_state")
    waves = states.join(held.groupBy("wave").agg(F.sum("n").alias("intervals")), "wave").withColumn("all", F.lit(1))
    document = tables.grouped_map(waves, ["all"], "wave", F.struct("intervals", "by_state"), "waves")
    total = held.agg(F.sum("n").alias("intervals"))
    _, models, fits = state_fits(spark, sf)
    converged = F.struct(*[F.lit(bool(fits[m.name].converged)).alias(m.name) for m in models])
    joined = total.withColumn("all", F.lit(1)).join(document, "all", "left")
    return tables.audit_document(joined.select("intervals", "waves", converged.alias("models")))
