"""Imputation, trajectories, mediation, intensities and the bootstrap."""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from ..functions import recode as R
from ..models import effects as E
from ..models import impute, markov, mixture
from ..models.design import Cat, Num, crossed
from ..models.glm import Model, fit_models, predicted
from ..operators import joins, reshape
from ..operators.quantiles import exact_quantiles
from ..operators.sequences import first_event_followup, first_per_person
from ..operators.summaries import cohort_flow, fill_missing, transition_totals
from ..sources.tables import stored
from . import standin as S
from .interval_queries import SQL_SPEND_WIDE, YEARS, spend_wide
from .model_queries import (
    CONTRASTS,
    COVARIATES,
    PAIRS_STATE,
    RATIO_COLUMNS,
    SQL_ADJUSTED_COLUMNS,
    SQL_PAIRS,
    STATE,
    fully_weighted,
    sql_balance,
    sql_risk,
    sql_saturated,
    transition_models,
    weighted,
)
from .registry import query, rounded

IMPUTED = ["balance_k", "early_spend"]
MATRIX = [*IMPUTED, "spend_k", "order_count", "a", "b", "functional_state", "half"]


def imputation_rows(spark, sf, waves=None):
    """One row per person: first interval, with spend at the second wave where there is one.

    ``waves`` is the panel where it is stored already; it takes the quantile of all prices, so it is built once.
    """
    waves = stored(S.panel(spark, sf), "waves") if waves is None else waves
    first = first_per_person(S.intervals(spark, sf, build=lambda *_: waves), "id", "wave")
    early = waves.filter("wave = 2").select("id", (F.col("spend") / 1000).alias("early_spend"))
    rows = S.modelled(S.with_people(joins.checked_join(first, early, ["id"]), spark, sf))
    rows = rows.select(
        "id",
        *IMPUTED,
        (F.col("spend") / 1000).alias("spend_k"),
        F.col("n_orders").cast("double").alias("order_count"),
        "a",
        "b",
        "functional_state",
        "half",
    )
    return stored(rows, "people")


@query("impute_chained")
def impute_chained(spark, sf):
    """Means of the completed columns by imputation, beside the observed ones."""
    rows = imputation_rows(spark, sf)
    chains = impute.fit_chains(rows, "id", MATRIX, draws=20, rounds=20, seed=11)
    filled = impute.completed(rows, chains, IMPUTED, seed=11)
    long = filled.select(
        *IMPUTED, F.posexplode(F.arrays_zip(*[f"{c}_draws" for c in IMPUTED])).alias("imputation", "e")
    )
    return rounded(
        long.groupBy((F.col("imputation") + 1).alias("imputation")).agg(
            F.count(F.lit(1)).alias("people"),
            *[F.avg(F.col(f"e.{c}_draws")).alias(f"mean_{c}") for c in IMPUTED],
            *[F.avg(c).alias(f"observed_{c}") for c in IMPUTED],
            *[F.sum(F.col(c).isNull().cast("int")).alias(f"imputed_{c}") for c in IMPUTED],
        )
    )


@query("multiple_imputation_rr")
def multiple_imputation_rr(spark, sf, m=20, rounds=20):
    """Weights and models refitted on every imputation in shared passes, then pooled."""
    waves = stored(S.panel(spark, sf), "waves")
    people = imputation_rows(spark, sf, waves)
    chains = impute.fit_chains(people, "id", MATRIX, draws=m, rounds=rounds, seed=12)
    drawn = impute.completed(people, chains, ["balance_k"], seed=12).select("id", "balance_k_draws")
    rows = S.modelled(S.with_people(S.intervals(spark, sf, build=lambda *_: waves), spark, sf))
    rows = stored(joins.checked_join(rows, drawn, ["id"]), "imputed")
    rows = rows.select("*", *[F.col("balance_k_draws")[k].alias(f"balance_{k}") for k in range(m)]).drop("balance_k_draws")
    origin = Cat("functional_state")
    shared = (Cat("interval"), Cat("segment_cat"), Num("half", discrete=True))
    seen = F.col("outcome_observed")
    numerator = Model("numerator", seen, (origin, Cat("interval")), family="binomial", errors="HC0")
    denominators = [
        Model(f"denominator {k}", seen, (STATE, origin, *shared, Num(f"balance_{k}")), family="binomial", errors="HC0")
        for k in range(m)
    ]
    fits = fit_models(rows, [numerator, *denominators])
    bounded = (0.02, 0.995)
    scored = predicted(rows, fits["numerator"], numerator, "p_num", bounded)
    for k, d in enumerate(denominators):
        scored = predicted(scored, fits[d.name], d, f"p_den_{k}", bounded)
    observed = scored.filter("outcome_observed = 1").select(
        *rows.columns, *[(F.col("p_num") / F.col(f"p_den_{k}")).alias(f"raw_{k}") for k in range(m)]
    )
    observed = stored(observed, "weighted")
    long = observed.select(F.posexplode(F.array(*[F.col(f"raw_{k}") for k in range(m)])).alias("k", "raw"))
    bounds = exact_quantiles(long, "raw", [0.01, 0.99], by=["k"])
    for k in range(m):
        observed = observed.withColumn(f"iow_{k}", R.clip(f"raw_{k}", *bounds[(k,)]))
    # the outcomes and risk sets are the same columns in every imputation, so the rows hold them once
    models = [
        replace(model, name=f"{model.name} {k}", terms=(STATE, *shared, Num(f"balance_{k}")), weight=f"iow_{k}")
        for model in transition_models([])
        for k in range(m)
    ]
    fits = fit_models(observed, models, cluster="id")
    wanted = {S.STATE_LABELS[g]: {f"state[{g}]": 1.0} for g in (1, 2, 3)}
    wanted["Both vs High spend only"] = {"state[3]": 1.0, "state[2]": -1.0}
    out = []
    for _, _, label in S.KEY_TRANSITIONS:
        repeated = [fits[f"{label} {k}"] for k in range(m)]
        # the imputed column has its own name in every imputation but the same place
        out += [{"model": label, **r} for r in impute.pooled(repeated, wanted)]
    fields = "model string, comparison string, estimate double, ci_low double, ci_high double, p_value double, imputations int"
    return rounded(E.as_table(spark, out, fields))


@query(
    "impute_exact_linear",
    f"""WITH {S.SQL_PEOPLE}, x AS (SELECT half, region, coalesce(balance, 0) / 1000 AS known, balance IS NULL AS missing FROM people)
    SELECT region, imputation, count(*) AS people, CAST(sum(missing::INT) AS BIGINT) AS imputed, round(avg(5 + 2 * known - 3 * half + region), 2) AS mean_filled
    FROM x, (SELECT CAST(unnest([1, 2, 3]) AS INTEGER) AS imputation) k GROUP BY 1, 2""",
)
def impute_exact_linear(spark, sf):
    """Gaps in a column that is linear in the others: every draw must restore what the line says."""
    rows = S.people(spark, sf).select(
        "id", "half", "region", F.coalesce(F.col("balance") / 1000, F.lit(0.0)).alias("known"), F.col("balance").isNull().alias("missing")
    )
    line = 5 + 2 * F.col("known") - 3 * F.col("half") + F.col("region")
    rows = stored(rows.withColumn("target", F.when(~F.col("missing"), line)), "linear")
    chains = impute.fit_chains(rows, "id", ["target", "known", "half", "region"], draws=3, rounds=4, seed=13)
    filled = impute.completed(rows, chains, ["target"], seed=13)
    long = filled.select("region", "missing", F.posexplode("target_draws").alias("at", "value"))
    found = long.groupBy("region", (F.col("at") + 1).alias("imputation")).agg(
        F.count(F.lit(1)).alias("people"), F.count_if("missing").alias("imputed"), F.avg("value").alias("mean_filled")
    )
    return rounded(found, 2)


FILLS = [k / 6 for k in range(1, 6)]


@query(
    "rubin_pool",
    f"""WITH {S.SQL_PEOPLE}, q AS (SELECT unnest([1, 2, 3, 4, 5]) AS k, unnest([{", ".join(f"(SELECT quantile_cont(balance, {p!r}) FROM people)" for p in FILLS)}]) AS fill),
    x AS (SELECT half, k, ln(1 + coalesce(balance, fill)) AS v FROM people CROSS JOIN q),
    e AS (SELECT half, k, avg(v) AS est, var_samp(v) / count(*) AS var FROM x GROUP BY 1, 2),
    p AS (SELECT half, count(*) AS imputations, avg(est) AS estimate, avg(var) AS w, var_samp(est) AS b FROM e GROUP BY 1)
    SELECT half, imputations, round(estimate, 6) AS estimate, round(w, 8) AS within, round(b, 8) AS between, round(sqrt(w + 1.2 * b), 6) AS se,
      round(estimate - 1.96 * sqrt(w + 1.2 * b), 6) AS ci_low, round(estimate + 1.96 * sqrt(w + 1.2 * b), 6) AS ci_high FROM p""",
)
def rubin_pool(spark, sf):
    """Mean log balance under five fills of the missing balances, pooled."""
    people = S.people(spark, sf)
    fills = exact_quantiles(people, "balance", FILLS)[()]
    copies = [{"k": F.lit(k), "v": F.log1p(F.coalesce(F.col("balance"), F.lit(q)))} for k, q in enumerate(fills)]
    each = (
        reshape.stack_copies(people, copies)
        .groupBy("half", "k")
        .agg(F.avg("v").alias("estimate"), (F.var_samp("v") / F.count("v")).alias("variance"))
    )
    out = impute.pool_table(each, ["half"], "estimate", "variance")
    fine = out.withColumn("within", F.round("within", 8)).withColumn("between", F.round("between", 8))
    return fine.select(
        "half", "imputations", "within", "between",
        *[F.round(c, 6).alias(c) for c in ("estimate", "se", "ci_low", "ci_high")],
    )


Z = [f"z{w}" for w in YEARS]


def curves(spark, sf):
    """People with spend at waves 1, 3 and 5, and their slope in standard deviations."""
    rows = spend_wide(spark, sf)
    slope = R.linear_slope([f"s{w}" for w in YEARS], [0.0, 2.0, 4.0]) / 1000
    rows = rows.withColumn("slope", slope)
    spread = rows.agg(F.avg("slope").alias("m"), F.stddev_pop("slope").alias("s")).first()
    return stored(rows.withColumn("slope_sd", (F.col("slope") - spread["m"]) / spread["s"]), "curves")


def trajectories(spark, sf):
    """People with spend at waves 1, 3 and 5, their class, slope and later outcome."""
    rows = curves(spark, sf)
    fitted = mixture.fit_mixtures(rows, "id", Z, starts=5, max_rounds=500, seed=5)
    selection = mixture.select_mixture(rows, Z, fitted)
    return mixture.with_trajectory(rows, Z, selection), selection


def with_incident(rows, spark, sf):
    """Orders by wave, and the outcome at wave 6 of people free of it at wave 5.

    A strict curve rests on two orders or more at each of its waves; the weight of a person is the number
    of orders at wave 5 relative to the mean over the rows.
    """
    waves = S.panel(spark, sf)
    states = reshape.long_to_wide(waves, "id", "wave", [5, 6], "functional_state", lambda w: f"f{w}")
    counts = reshape.long_to_wide(waves, "id", "wave", YEARS, "n_orders", lambda w: f"orders_{w}")
    rows = joins.checked_join(joins.checked_join(rows, states, ["id"]), counts, ["id"])
    rows = rows.withColumn("orders_5", F.col("orders_5").cast("double"))
    later = F.when(F.col("f6").isNotNull(), R.event_in("f6", [2]))
    origin = R.flag(F.col("f5") == 2)
    rows = stored(rows.withColumn("incident", R.incident_only(origin, later)), "curves-outcome")
    mean = rows.agg(F.avg("orders_5")).first()[0]
    strict = F.least(*[F.col(f"orders_{w}") for w in YEARS]) >= 2
    return rows.withColumn("sampling", F.col("orders_5") / mean).withColumn("strict", R.all_present([f"s{w}" for w in YEARS]) & strict)


def trajectory_people(spark, sf):
    rows, selection = trajectories(spark, sf)
    return with_incident(rows, spark, sf), selection


@query(
    "incident_outcome",
    f"""WITH {S.SQL_PANEL} SELECT p.id, CAST(CASE WHEN p.functional_state <> 2 THEN (q.functional_state = 2)::INT END AS INTEGER) AS incident
    FROM panel p JOIN panel q ON q.id = p.id AND q.wave = 6 WHERE p.wave = 5""",
)
def incident_outcome(spark, sf):
    """The outcome at wave 6 of people seen at waves 5 and 6, unless they had it before."""
    wide = reshape.long_to_wide(S.panel(spark, sf), "id", "wave", [5, 6], "functional_state", lambda w: f"f{w}")
    seen = wide.filter(R.all_present(["f5", "f6"]))
    return seen.select("id", R.incident_only(R.flag(F.col("f5") == 2), R.event_in("f6", [2])).alias("incident"))


@query("mixture_selection")
def mixture_selection(spark, sf):
    _, selection = trajectories(spark, sf)
    fields = "classes int, bic double, aic double, smallest_n bigint, smallest_share double, converged boolean"
    return rounded(E.as_table(spark, selection.choices, fields), 4)


SQL_TWO = """x AS (SELECT c_acctbal / 1000 AS a, CAST(c_nationkey AS DOUBLE) AS b FROM customer)"""


def two_numbers(spark, sf):
    customer = S.table(spark, sf, "customer", "c_custkey", "c_acctbal", "c_nationkey")
    return customer.select("c_custkey", (F.col("c_acctbal") / 1000).alias("a"), F.col("c_nationkey").cast("double").alias("b"))


def mixture_rows(spark, m):
    rows = [
        {"class": i, "weight": float(m.weights[i]), "mean_a": float(m.means[i, 0]), "mean_b": float(m.means[i, 1]), "var_a": float(m.variances[i, 0]), "var_b": float(m.variances[i, 1]), "loglik": float(m.loglik)}
        for i in range(m.classes)
    ]
    return E.as_table(spark, rows, "class int, weight double, mean_a double, mean_b double, var_a double, var_b double, loglik double")


@query(
    "mixture_single_class",
    f"""WITH {SQL_TWO}, m AS (SELECT avg(a) AS ma, avg(b) AS mb, var_pop(a) + 1e-6 AS va, var_pop(b) + 1e-6 AS vb FROM x)
    SELECT CAST(0 AS INTEGER) AS class, 1.0::DOUBLE AS weight, round(any_value(ma), 6) AS mean_a, round(any_value(mb), 6) AS mean_b, round(any_value(va), 6) AS var_a, round(any_value(vb), 6) AS var_b,
      round(sum(-0.5 * (ln(2 * pi() * va) + ln(2 * pi() * vb) + (a - ma) * (a - ma) / va + (b - mb) * (b - mb) / vb)), 3) AS loglik FROM x, m""",
)
def mixture_single_class(spark, sf):
    """One class: the columns' means and variances."""
    m = mixture.fit_mixtures(two_numbers(spark, sf), "c_custkey", ["a", "b"], class_counts=(1,), starts=2, tolerance=1e-12)[1]
    return rounded(mixture_rows(spark, m).withColumn("loglik", F.round("loglik", 3)))


#: Where one step begins: two classes, far from settled.
STEP_FROM = mixture.Mixture(np.array([0.6, 0.4]), np.array([[1.0, 5.0], [6.0, 18.0]]), np.array([[9.0, 40.0], [4.0, 25.0]]))
SQL_DENSITY = " - ".join(["ln({w})", "0.5 * (ln(2 * pi() * {va}) + ln(2 * pi() * {vb}) + (a - {ma}) * (a - {ma}) / {va} + (b - {mb}) * (b - {mb}) / {vb})"])


@query(
    "mixture_one_step",
    f"""WITH {SQL_TWO}, d AS (SELECT a, b, unnest([0, 1]) AS class, unnest([exp({SQL_DENSITY.format(w=0.6, ma=1.0, mb=5.0, va=9.0, vb=40.0)}), exp({SQL_DENSITY.format(w=0.4, ma=6.0, mb=18.0, va=4.0, vb=25.0)})]) AS p FROM x),
    r AS (SELECT *, p / s AS share FROM (SELECT *, sum(p) OVER (PARTITION BY a, b) / (count(*) OVER (PARTITION BY a, b) / 2) AS s FROM d)),
    m AS (SELECT class, sum(share) AS size, sum(share * a) / sum(share) AS ma, sum(share * b) / sum(share) AS mb, sum(share * a * a) / sum(share) AS aa, sum(share * b * b) / sum(share) AS bb FROM r GROUP BY 1)
    SELECT class, round(size / sum(size) OVER (), 6) AS weight, round(ma, 6) AS mean_a, round(mb, 6) AS mean_b, round(aa - ma * ma + 1e-6, 6) AS var_a, round(bb - mb * mb + 1e-6, 6) AS var_b,
      round((SELECT sum(ln(s)) / 2 FROM r), 3) AS loglik FROM m""",
)
def mixture_one_step(spark, sf):
    """One round of expectation and maximisation from given classes."""
    m = mixture.step(two_numbers(spark, sf), ["a", "b"], STEP_FROM)
    return rounded(mixture_rows(spark, m).withColumn("loglik", F.round("loglik", 3)))


@query(
    "mixture_class_profiles",
    f"""WITH {SQL_TWO}, d AS (SELECT a, b, {SQL_DENSITY.format(w=0.6, ma=1.0, mb=5.0, va=9.0, vb=40.0)} AS first, {SQL_DENSITY.format(w=0.4, ma=6.0, mb=18.0, va=4.0, vb=25.0)} AS second FROM x)
    SELECT CASE WHEN first >= second THEN 'Lower' ELSE 'Upper' END AS trajectory, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share,
      round(avg(a), 6) AS a, round(avg(b), 6) AS b, round((avg(a) + avg(b)) / 2, 6) AS mean_level, round(avg(b) - avg(a), 6) AS change FROM d GROUP BY 1""",
)
def mixture_class_profiles(spark, sf):
    """Everyone's most likely class of a given mixture, and the classes' sizes and means."""
    given = mixture.Selection(STEP_FROM, [], ["Lower", "Upper"])
    return rounded(mixture.profiles(mixture.with_trajectory(two_numbers(spark, sf), ["a", "b"], given), ["a", "b"]))


@query("mixture_trajectories")
def mixture_trajectories(spark, sf):
    rows, _ = trajectories(spark, sf)
    return rounded(mixture.profiles(rows, Z))


HALF = Num("half", discrete=True)
#: All people, each with a sampling weight, and those whose curve rests on enough orders: weight and rows.
SENSITIVITY = {"": (None, None), " weighted": ("sampling", None), " strict": (None, "strict")}


def outcome_models(label, exposure, variants=SENSITIVITY):
    """Logit models of the later outcome, with and without products of exposure and half."""
    return [
        Model(f"{label}{variant}{rest}", F.col("incident"), (*terms, Num("orders_5")), weight=weight,
              where=F.col(rows) if rows else None, family="binomial", errors="HC1")
        for variant, (weight, rows) in variants.items()
        for rest, terms in (("", crossed(exposure, HALF)), (", no interaction", (exposure, HALF)))
    ]


def trajectory_fits(spark, sf, variants=("",)):
    rows, selection = trajectory_people(spark, sf)
    top = selection.names[int(selection.chosen.means.mean(axis=1).argmax())]
    group = Cat("trajectory", reference=top, levels=tuple(sorted(selection.names)))
    wanted = {v: SENSITIVITY[v] for v in variants}
    models = outcome_models("class", group, wanted) + outcome_models("slope", Num("slope_sd"), wanted)
    return fit_models(rows, models), group, selection


def class_contrasts(fits, group, selection, names):
    """Odds ratios of each class to the highest one within both halves, for every model named."""
    labels = {n: f"{n} vs {group.reference}" for n in selection.names}
    levels = [n for n in sorted(selection.names) if n != group.reference]
    return [r for n in names for r in E.stratum_rows(fits[n], group, "half", labels, {0: "Half 0", 1: "Half 1"}, levels, [])]


@query("trajectory_contrasts")
def trajectory_contrasts(spark, sf):
    """Odds ratios of each class to the highest one within both halves."""
    rows = class_contrasts(*trajectory_fits(spark, sf), ["class"])
    return rounded(E.as_table(spark, rows, E.STRATUM_FIELDS))


@query("trajectory_sensitivity")
def trajectory_sensitivity(spark, sf):
    """The same contrasts under sampling weights and among strict curves, beside the test of all products."""
    fits, group, selection = trajectory_fits(spark, sf, (" weighted", " strict"))
    names = ["class weighted", "class strict"]
    contrasts = E.as_table(spark, class_contrasts(fits, group, selection, names), E.STRATUM_FIELDS)
    tests = [E.likelihood_ratio(fits[n], fits[f"{n}, no interaction"]) for n in names]
    audit = [{**t, "n": fits[t["model"]].n, "events": int(fits[t["model"]].events), "converged": bool(fits[t["model"]].converged)} for t in tests]
    table = E.as_table(spark, audit, "model string, chi2 double, df int, p_value double, n bigint, events bigint, converged boolean")
    return rounded(contrasts.drop("p_interaction").join(table.withColumnRenamed("p_value", "p_products"), "model"))


@query("interaction_tests")
def interaction_tests(spark, sf):
    """Likelihood-ratio tests of all product terms, by class and by continuous slope."""
    fits, _, _ = trajectory_fits(spark, sf)
    rows = [E.likelihood_ratio(fits[n], fits[f"{n}, no interaction"]) for n in ("class", "slope")]
    return rounded(E.as_table(spark, rows, "model string, chi2 double, df int, p_value double"))


@query("slope_trend")
def slope_trend(spark, sf):
    """Coefficients of the continuous-slope models."""
    fits, _, _ = trajectory_fits(spark, sf)
    rows = [r for n in ("slope", "slope, no interaction") for r in E.coefficient_rows(fits[n])]
    return rounded(E.as_table(spark, rows, E.COEFFICIENT_FIELDS))


SQL_SLOPE_TERMS = {"intercept": "1", "slope_sd": "slope_sd", "half": "half", "slope_sd:half": "slope_sd * half", "orders_5": "orders_5"}


SQL_SLOPES = f"""{S.SQL_PANEL}, {S.SQL_PEOPLE}, {SQL_SPEND_WIDE},
sl AS (SELECT wp.id, half, (s5 - s1) * 2 / 8 / 1000 AS slope FROM wp WHERE s1 IS NOT NULL AND s3 IS NOT NULL AND s5 IS NOT NULL),
ms AS (SELECT avg(slope) AS m, stddev_pop(slope) AS s FROM sl),
ab AS (SELECT sl.half, (slope - m) / s AS x, CAST(n_orders AS DOUBLE) AS y FROM sl CROSS JOIN ms JOIN panel p ON p.id = sl.id AND p.wave = 6)"""


@query(
    "slope_balance",
    f"""WITH {SQL_SLOPES}, sp AS (SELECT sl.id, sl.half, (slope - m) / s AS slope_sd, CAST(p5.n_orders AS DOUBLE) AS orders_5, p5.functional_state AS f5,
        least(p1.n_orders, p3.n_orders, p5.n_orders) >= 2 AS strict
      FROM sl CROSS JOIN ms JOIN panel p1 ON p1.id = sl.id AND p1.wave = 1 JOIN panel p3 ON p3.id = sl.id AND p3.wave = 3 JOIN panel p5 ON p5.id = sl.id AND p5.wave = 5),
    mo AS (SELECT avg(n_orders) AS m FROM panel WHERE wave = 5),
    rv AS (SELECT sp.*, orders_5 / mo.m AS sampling, (q.functional_state = 2)::INT AS y
      FROM sp CROSS JOIN mo JOIN panel q ON q.id = sp.id AND q.wave = 6 WHERE f5 <> 2),
    r AS (SELECT v || n AS model, CASE WHEN v = 'slope weighted' THEN sampling ELSE 1.0 END AS w, rv.*
      FROM rv, (VALUES ('slope'), ('slope weighted'), ('slope strict')) a(v), (VALUES (''), (', no interaction')) b(n) WHERE v <> 'slope strict' OR strict),
    {sql_balance(SQL_SLOPE_TERMS, "r")} HAVING term <> 'slope_sd:half' OR model NOT LIKE '%no interaction'""",
)
def slope_balance(spark, sf):
    """Observed against fitted sums by every column of the slope models: of all people, weighted, and of strict curves."""
    rows, models = with_incident(curves(spark, sf), spark, sf), outcome_models("slope", Num("slope_sd"))
    return rounded(E.balance(rows, fit_models(rows, models), models), 3)


def mediation_rows(spark, sf):
    rows = spend_wide(spark, sf).withColumn(
        "slope", R.linear_slope([f"s{w}" for w in YEARS], [0.0, 2.0, 4.0]) / 1000
    )
    spread = rows.agg(F.avg("slope").alias("m"), F.stddev_pop("slope").alias("s")).first()
    rows = rows.withColumn("slope_sd", (F.col("slope") - spread["m"]) / spread["s"])
    later = S.panel(spark, sf).filter("wave = 6").select(
        "id", F.col("n_orders").cast("double").alias("mediator"), R.event_in("functional_state", [2]).alias("flagged")
    )
    joined = joins.checked_join(rows, later, ["id"], how="inner")
    return stored(S.modelled(joined.filter(F.col("slope_sd").isNotNull())), "mediation")


@query(
    "sobel_a_path",
    f"""WITH {SQL_SLOPES}, m AS (SELECT half, count(*) AS n, avg(x) AS xm, avg(y) AS ym, var_pop(x) * count(*) AS sxx, regr_slope(y, x) AS b FROM ab GROUP BY 1),
    e AS (SELECT ab.half, any_value(b) AS b, any_value(n) AS n, sqrt(sum((x - xm) * (x - xm) * power(y - ym - b * (x - xm), 2)) / any_value(sxx * sxx) * any_value(n / (n - 2.0))) AS se
      FROM ab JOIN m ON m.half = ab.half GROUP BY 1)
    SELECT half, n, round(b, 6) AS a, round(se, 6) AS a_se FROM e""",
)
def sobel_a_path(spark, sf):
    rows = mediation_rows(spark, sf)
    models = [
        Model(str(h), F.col("mediator"), (Num("slope_sd"),), where=F.col("half") == h, family="gaussian", errors="HC1")
        for h in (0, 1)
    ]
    out = []
    for h, fit in fit_models(rows, models).items():
        a, se = E.linear(fit, {"slope_sd": 1.0})
        out.append({"half": int(h), "n": fit.n, "a": a, "a_se": se})
    return rounded(E.as_table(spark, out, "half int, n bigint, a double, a_se double"))


MEDIATION_COVARIATES = (Cat("segment_cat"), Cat("region"), Num("balance_k"))


def mediation_models():
    """Within halves: slope to order count, and both to the outcome, given the covariates."""
    models = []
    for h in (0, 1):
        inside, terms = F.col("half") == h, (Num("slope_sd"), *MEDIATION_COVARIATES)
        models.append(Model(f"a{h}", F.col("mediator"), terms, where=inside, family="gaussian", errors="HC1"))
        models.append(
            Model(f"b{h}", F.col("flagged"), (*terms, Num("mediator")), where=inside, family="binomial", errors="HC1")
        )
    return models


SQL_MEDIATION_COLUMNS = {
    **{c: x for c, x in SQL_ADJUSTED_COLUMNS.items() if c.startswith(("intercept", "segment_cat", "region"))},
    "balance_k": "balance / 1000", "slope_sd": "slope_sd", "mediator": "mediator",
}


@query(
    "mediation_balance",
    f"""WITH {SQL_SLOPES}, md AS (SELECT sl.half, (slope - m) / s AS slope_sd, CAST(n_orders AS DOUBLE) AS mediator,
        CAST(functional_state = 2 AS DOUBLE) AS flagged, segment, region, balance
      FROM sl CROSS JOIN ms JOIN panel p ON p.id = sl.id AND p.wave = 6 JOIN people q ON q.id = sl.id WHERE balance IS NOT NULL),
    r AS (SELECT unnest([{{'model': 'a' || half, 'y': mediator}}, {{'model': 'b' || half, 'y': flagged}}], recursive := true), 1.0 AS w, md.* FROM md),
    {sql_balance(SQL_MEDIATION_COLUMNS, "r", 5)} HAVING model LIKE 'b%' OR term <> 'mediator'""",
)
def mediation_balance(spark, sf):
    """Observed against fitted sums by every column of the models behind ``mediation_sobel``."""
    rows, models = mediation_rows(spark, sf), mediation_models()
    return rounded(E.balance(rows, fit_models(rows, models), models), 5)


@query("mediation_sobel")
def mediation_sobel(spark, sf, least_rows: int = 200, least_events: int = 20):
    """Slope to order count to outcome within halves; too small a stratum is left out.

    People without a balance are in neither model.
    """
    fits = fit_models(mediation_rows(spark, sf), mediation_models())
    out = []
    for h in (0, 1):
        first, second = fits[f"a{h}"], fits[f"b{h}"]
        if second.n < least_rows or second.events < least_events:
            continue
        effect = E.product_of_coefficients(
            E.linear(first, {"slope_sd": 1.0}), E.linear(second, {"mediator": 1.0})
        )
        out.append({"half": h, "n": second.n, "events": int(second.events), **effect})
    fields = "half int, n bigint, events bigint, a double, b double, indirect double, se double, ci_low double, ci_high double"
    return rounded(E.as_table(spark, out, fields))


@query("ordered_pathway")
def ordered_pathway(spark, sf):
    """Exposure at wave 2, covariate at wave 3, transition after wave 3: ratio before and after adjustment."""
    rows, _ = fully_weighted(spark, sf)
    origin = S.panel(spark, sf).filter("wave = 2").select("id", F.col("state").alias("state_2"))
    rows = joins.checked_join(rows.filter("wave = 3"), origin, ["id"], how="inner")
    rows = rows.withColumn("reading", R.in_range("spend", 0, 450000)).withColumn(
        "reading_k", F.col("reading") / 1000
    )
    rows = fill_missing(stored(rows, "pathway"), median={"reading_k": "reading_filled"})
    exposure = Cat("state_2", reference=0, levels=(0, 1, 2, 3))
    base = (exposure, *[t for t in COVARIATES if t.columns != ("interval",)])
    more = (Num("reading_filled"), Num("reading_k_missing", discrete=True))
    keys = [t for t in S.KEY_TRANSITIONS if t[0] == 1]
    models = transition_models(base, "iow", keys) + transition_models((*base, *more), "iow", keys, suffix=" adjusted")
    fits = fit_models(rows, models, cluster="id")
    contrast = {"state_2[3]": 1.0, "state_2[2]": -1.0}
    out = []
    for _, _, label in keys:
        before, after = fits[label], fits[f"{label} adjusted"]
        first, second = E.ratio(before, contrast), E.ratio(after, contrast)
        out.append(
            {
                "model": label,
                "primary_ratio": first["estimate"],
                "primary_low": first["ci_low"],
                "primary_high": first["ci_high"],
                "adjusted_ratio": second["estimate"],
                "adjusted_low": second["ci_low"],
                "adjusted_high": second["ci_high"],
                "attenuation_percent": E.attenuation(
                    E.linear(before, contrast)[0], E.linear(after, contrast)[0]
                ),
                "n": after.n,
            }
        )
    fields = (
        "model string, primary_ratio double, primary_low double, primary_high double, adjusted_ratio double, "
        "adjusted_low double, adjusted_high double, attenuation_percent double, n bigint"
    )
    return rounded(E.as_table(spark, out, fields))


SQL_STRICT_OBS = f"{S.SQL_STRICT}, {S.sql_intervals('strict', 'siv')}, sobs AS (SELECT * FROM siv WHERE outcome_observed = 1)"


@query(
    "strict_rr",
    f"""WITH {SQL_STRICT_OBS}, {sql_risk(source="sobs")}, {sql_saturated(4)}, {PAIRS_STATE}, {SQL_PAIRS}
    SELECT {RATIO_COLUMNS} FROM est JOIN tot ON tot.model = est.model""",
)
def strict_rr(spark, sf):
    """The transition models under the stricter state definition."""
    rows = S.intervals(spark, sf, threshold=2).filter("outcome_observed = 1")
    rows = rows.withColumn("w", F.col("n_orders").cast("double"))
    fits = fit_models(rows, transition_models([STATE]), cluster="id")
    out = [r for f in fits.values() for r in E.ratio_rows(f, "state", [1, 2, 3], S.STATE_LABELS, CONTRASTS)]
    return rounded(E.as_table(spark, out, E.RATIO_FIELDS))


@query(
    "first_decline_rr",
    f"""WITH {S.SQL_INTERVALS}, started AS (SELECT * FROM obs WHERE id IN (SELECT id FROM obs WHERE wave = 2 AND functional_state = 0)),
    r AS (SELECT 'First decline' AS model, id, state AS g, CAST(n_orders AS DOUBLE) AS w, CASE WHEN destination_state IN (1, 2) THEN 1.0 ELSE 0.0 END AS y FROM started s
      WHERE functional_state = 0 AND NOT EXISTS (SELECT 1 FROM started e WHERE e.id = s.id AND e.wave < s.wave AND (e.functional_state <> 0 OR e.destination_state IN (1, 2, 3)))),
    {sql_saturated(4)}, {PAIRS_STATE}, {SQL_PAIRS} SELECT {RATIO_COLUMNS} FROM est JOIN tot ON tot.model = est.model""",
)
def first_decline_rr(spark, sf):
    """Exposure and the first move out of the settled state."""
    kept = first_event_followup(
        weighted(spark, sf), "id", "wave", "functional_state", "destination_state", 2, [1, 2, 3]
    )
    keys = [(0, [1, 2], "First decline")]
    fits = fit_models(kept, transition_models([STATE], transitions=keys), cluster="id")
    out = [r for f in fits.values() for r in E.ratio_rows(f, "state", [1, 2, 3], S.STATE_LABELS, CONTRASTS)]
    return rounded(E.as_table(spark, out, E.RATIO_FIELDS))


@query(
    "measurement_flow",
    f"""WITH {S.SQL_PANEL}, {S.SQL_PEOPLE}, {SQL_SPEND_WIDE}, f AS (SELECT count(*) AS n1, count(s1) AS n2, count(CASE WHEN s1 IS NOT NULL AND s3 IS NOT NULL AND s5 IS NOT NULL THEN 1 END) AS n3 FROM wp)
    SELECT 1 AS step_no, 'People' AS step, n1 AS n, CAST(NULL AS DOUBLE) AS retained FROM f
    UNION ALL SELECT 2, 'Reading at wave 1', n2, round(n2 / n1, 6) FROM f UNION ALL SELECT 3, 'All three readings', n3, round(n3 / n2, 6) FROM f""",
)
def measurement_flow(spark, sf):
    rows = spend_wide(spark, sf)
    return rounded(
        cohort_flow(
            rows,
            [
                ("People", F.lit(True)),
                ("Reading at wave 1", F.col("s1").isNotNull()),
                ("All three readings", R.all_present(["s3", "s5"])),
            ],
        )
    )


KEY_MOVES = {label: [(origin, d) for d in dests] for origin, dests, label in S.KEY_TRANSITIONS}


def exposed(spark, sf):
    return weighted(spark, sf).filter("state in (2, 3)")


def state_totals(rows):
    return transition_totals(
        rows, "functional_state", "destination_state", "interval_years", "w", ["state"]
    )


@query("markov_intensities")
def markov_intensities(spark, sf):
    """Transition intensities under single and double exposure, and their ratio."""
    rates = markov.fit_groups(state_totals(exposed(spark, sf)), ["state"], 3)
    keyed = markov.key_rates(rates, ["state"], KEY_MOVES)
    return rounded(markov.rate_ratios(keyed, "state", 3, 2))


@query(
    "bootstrap_replicate_totals",
    f"""WITH {S.SQL_INTERVALS}, x AS (SELECT * FROM obs WHERE state IN (2, 3)),
    people AS (SELECT state, id, row_number() OVER (PARTITION BY state ORDER BY substr(md5(CAST(id AS VARCHAR)), 1, 3), id) - 1 AS no FROM (SELECT DISTINCT state, id FROM x)),
    sizes AS (SELECT state, count(*) AS n FROM people GROUP BY 1),
    draws AS (SELECT sizes.state, r AS replicate, ('0x' || substr(md5('7|' || sizes.state || '|' || r || '|' || d), 1, 15))::BIGINT % n AS no
      FROM sizes, (SELECT CAST(unnest(range(1, 51)) AS INTEGER) AS r), LATERAL (SELECT unnest(range(sizes.n)) AS d)),
    mult AS (SELECT state, replicate, no, count(*) AS times FROM draws GROUP BY 1, 2, 3)
    SELECT m.replicate, x.state, functional_state, destination_state, interval_years, round(CAST(sum(times * n_orders) AS DOUBLE), 6) AS weight
    FROM mult m JOIN people p ON p.state = m.state AND p.no = m.no JOIN x ON x.state = p.state AND x.id = p.id GROUP BY 1, 2, 3, 4, 5""",
)
def bootstrap_replicate_totals(spark, sf):
    return rounded(markov.bootstrap_totals(exposed(spark, sf), "id", "state", 50, 7))


@query(
    "markov_one_living_state",
    f"""WITH {S.SQL_INTERVALS}, t AS (
      SELECT state, interval_years, sum(CASE WHEN destination_state = 3 THEN n_orders ELSE 0 END) * 1.0 / sum(n_orders) AS share FROM obs GROUP BY 1, 2)
    SELECT state, interval_years, round(greatest(least(-ln(1 - least(share, 1 - 1e-12)) / interval_years, exp(3)), exp(-10)), 5) AS rate FROM t""",
)
def markov_one_living_state(spark, sf):
    """Intensity of leaving when all living states are one: in closed form -ln(1 - share) / t per interval length."""
    rows = weighted(spark, sf).select(
        "state",
        "interval_years",
        F.lit(0).alias("functional_state"),
        (F.col("destination_state") == 3).cast("int").alias("destination_state"),
        F.col("interval_years").alias("years"),
        "w",
    )
    totals = transition_totals(rows, "functional_state", "destination_state", "years", "w", ["state", "interval_years"])
    rates = markov.fit_groups(totals, ["state", "interval_years"], 1, length="years")
    return rounded(rates.select("state", "interval_years", "rate"), 5)


SQL_ONE_RATE = "greatest(least(-ln(1 - least(sum(CASE WHEN destination_state = 3 THEN n_orders ELSE 0 END) * 1.0 / sum(n_orders), 1 - 1e-12)), exp(3)), exp(-10))"


@query(
    "markov_leaving_ratio",
    f"""WITH {S.SQL_INTERVALS}, t AS (SELECT state, functional_state, {SQL_ONE_RATE} AS rate FROM obs WHERE interval_years = 1 AND state IN (2, 3) GROUP BY 1, 2),
    k AS (SELECT state, CASE WHEN functional_state = 0 THEN 'Settled' ELSE 'Pending or flagged' END AS transition, sum(rate) AS rate FROM t GROUP BY 1, 2)
    SELECT transition, round(max(CASE WHEN state = 2 THEN rate END), 5) AS rate_low, round(max(CASE WHEN state = 3 THEN rate END), 5) AS rate_high, 1 AS converged,
      round(max(CASE WHEN state = 3 THEN rate END) / max(CASE WHEN state = 2 THEN rate END), 5) AS ratio FROM k GROUP BY 1""",
)
def markov_leaving_ratio(spark, sf):
    """Intensities of leaving from each level, summed over named groups of them, under both exposures against one of them.

    Each level is fitted alone, over intervals of one year, so that the rates have a closed form.
    """
    rows = exposed(spark, sf).filter("interval_years = 1").select(
        "state", F.col("functional_state").alias("origin_level"), F.lit(0).alias("functional_state"),
        (F.col("destination_state") == 3).cast("int").alias("destination_state"), "interval_years", "w",
    )
    totals = transition_totals(rows, "functional_state", "destination_state", "interval_years", "w", ["state", "origin_level"])
    rates = markov.fit_groups(totals, ["state", "origin_level"], 1).withColumn("origin", F.col("origin_level")).withColumn("target", F.lit(3))
    keyed = markov.key_rates(rates, ["state"], {"Settled": [(0, 3)], "Pending or flagged": [(1, 3), (2, 3)]})
    return rounded(markov.rate_ratios(keyed, "state", 3, 2), 5)


@query(
    "pattern_bootstrap_people",
    f"""WITH {S.SQL_INTERVALS}, n AS (SELECT state, count(DISTINCT id) AS people FROM obs WHERE state IN (2, 3) GROUP BY 1)
    SELECT state, CAST(unnest(range(1, 51)) AS INTEGER) AS replicate, people FROM n""",
)
def pattern_bootstrap_people(spark, sf):
    """Every replicate draws exactly as many people as there are."""
    draws = markov.pattern_draws(exposed(spark, sf), "id", "state", 50, 7)
    each = draws.select("state", F.posexplode("times").alias("at", "k"))
    return each.groupBy("state", (F.col("at") + 1).alias("replicate")).agg(F.sum("k").alias("people"))


@query("markov_bootstrap_ci")
def markov_bootstrap_ci(spark, sf, replicates: int = 50, least_successful: int = 45):
    """Intensity ratios with percentile intervals over person-level resamples.

    A replicate is successful when the fits of both groups converged. The result is feasible when both
    fits to the data converged and at least ``least_successful`` replicates were successful.
    """
    rows = exposed(spark, sf)
    rates = markov.fit_groups(state_totals(rows), ["state"], 3)
    found = rates.orderBy("state", "origin", "target").collect()
    starts: dict[tuple, list[float]] = {}
    for r in found:
        starts.setdefault((r["state"],), []).append(math.log(r["rate"]))
    keyed = markov.key_rates(spark.createDataFrame(found, rates.schema), ["state"], KEY_MOVES)
    point = markov.rate_ratios(keyed, "state", 3, 2)
    totals = markov.pattern_totals(markov.pattern_draws(rows, "id", "state", replicates, 7), "state")
    again = stored(markov.fit_groups(totals, ["replicate", "state"], 3, starts=starts, start_by=["state"]), "replicate_rates")
    whole = again.groupBy("replicate").agg(F.min(F.col("converged").cast("int")).alias("whole"), F.countDistinct("state").alias("fits"))
    good = whole.filter(f"whole = 1 and fits = {len(starts)}").select("replicate")
    successful = good.count()
    kept = again.join(F.broadcast(good), "replicate", "left_semi")  # at most one row per replicate
    ratios = markov.rate_ratios(markov.key_rates(kept, ["replicate", "state"], KEY_MOVES), "state", 3, 2, ["replicate"])
    bounds = markov.percentile_interval(ratios)
    table = spark.createDataFrame(
        [(k, lo, hi) for k, (lo, hi) in bounds.items()], "transition string, ci_low double, ci_high double"
    )
    feasible = (F.col("converged") == 1) & F.lit(successful >= least_successful)
    return rounded(
        point.join(F.broadcast(table), "transition", "left")
        .withColumn("bootstrap_requested", F.lit(replicates))
        .withColumn("bootstrap_successful", F.lit(successful))
        .withColumn("feasible", feasible)
    )
