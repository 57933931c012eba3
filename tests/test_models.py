"""Estimators against hand-derived answers, numpy and Spark's own estimators."""

import math

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import functions as F

from panelwright.models import effects, glm, impute, markov, mixture
from panelwright.models.design import Cat, Num, crossed, design_columns
from panelwright.models.glm import Model, fit_models, model_audit
from panelwright.models.weights import class_probabilities, observation_weights


def frame(spark, n=600, seed=1):
    noise = np.random.default_rng(seed)
    x, g = noise.normal(size=n), noise.integers(0, 3, size=n)
    p = np.minimum(0.9, np.exp(-1.2 + 0.3 * x + 0.2 * g))
    y = (noise.random(n) < p).astype(int)
    w = noise.uniform(0.5, 2, size=n)
    person = noise.integers(0, 150, size=n)
    rows = [(int(i), int(a), float(b), int(c), float(d)) for i, a, b, c, d in zip(person, g, x, y, w)]
    return spark.createDataFrame(rows, "id int, g int, x double, y int, w double")


def arrays(df):
    pdf = df.toPandas()
    x = np.column_stack([np.ones(len(pdf)), pdf.g == 1, pdf.g == 2, pdf.x]).astype(float)
    return x, pdf.y.to_numpy(float), pdf.w.to_numpy(), pdf.id.to_numpy()


TERMS = (Cat("g"), Num("x"))


def test_hand_worked_poisson(spark):
    rows = [(0, 0, 1.0), (0, 1, 2.0), (1, 1, 1.0), (1, 0, 3.0), (1, 1, 1.5)]
    df = spark.createDataFrame(rows, "g int, y int, w double").withColumn("id", F.monotonically_increasing_id())
    fit = fit_models(df, [Model("m", F.col("y"), (Cat("g"),), weight="w")], cluster="id")["m"]
    assert math.exp(fit.beta[0]) == pytest.approx(2 / 3)
    assert math.exp(fit.beta[1]) == pytest.approx((2.5 / 5.5) / (2 / 3))


@pytest.mark.parametrize("family", ["poisson", "binomial"])
def test_against_spark_glm(spark, family):
    df = frame(spark)
    fit = fit_models(df, [Model("m", F.col("y"), TERMS, weight="w", family=family, errors="HC0")])["m"]
    ready = VectorAssembler(inputCols=["g1", "g2", "x"], outputCol="f").transform(
        df.withColumn("g1", (F.col("g") == 1).cast("double")).withColumn("g2", (F.col("g") == 2).cast("double"))
    )
    theirs = GeneralizedLinearRegression(
        family=family, featuresCol="f", labelCol="y", weightCol="w", tol=1e-12, maxIter=50
    ).fit(ready)
    assert fit.converged
    assert np.allclose(fit.beta, [theirs.intercept, *theirs.coefficients], atol=1e-7)


def test_cluster_errors_and_both_engines(spark):
    df = frame(spark)
    x, y, w, person = arrays(df)
    fit = fit_models(df, [Model("m", F.col("y"), TERMS, weight="w")], cluster="id")["m"]
    mu = np.exp(x @ fit.beta)
    bread = np.linalg.inv((x * (w * mu)[:, None]).T @ x)
    score = x * (w * (y - mu))[:, None]
    sums = np.array([score[person == c].sum(axis=0) for c in np.unique(person)])
    g, n, k = len(sums), len(y), x.shape[1]
    cov = bread @ (sums.T @ sums) @ bread * g / (g - 1) * (n - 1) / (n - k)
    assert np.allclose(fit.cov, cov, rtol=1e-6)
    assert (fit.n, fit.clusters, fit.events) == (n, g, y.sum())
    discrete = Model("m", F.col("y"), (Cat("g"),), weight="w")
    cells = fit_models(df, [discrete], cluster="id")["m"]
    rows = fit_models(df, [discrete], cluster="id", max_cells=1)["m"]  # too many cells: passes over rows
    assert np.allclose(cells.beta, rows.beta) and np.allclose(cells.cov, rows.cov)


def test_hot_cluster_is_exact(spark):
    df = frame(spark).withColumn("id", F.when(F.col("x") > -0.4, 0).otherwise(F.col("id")))
    x, y, w, person = arrays(df)
    fit = fit_models(df.repartition(7), [Model("m", F.col("y"), TERMS, weight="w")], cluster="id")["m"]
    score = x * (w * (y - np.exp(x @ fit.beta)))[:, None]
    sums = np.array([score[person == c].sum(axis=0) for c in np.unique(person)])
    g, n, k = len(sums), len(y), x.shape[1]
    cov = fit.bread @ (sums.T @ sums) @ fit.bread * g / (g - 1) * (n - 1) / (n - k)
    assert np.allclose(fit.cov, cov)


def test_weights_times_constant_leave_coefficients(spark):
    df = frame(spark).withColumn("w3", F.col("w") * 3)
    fits = fit_models(
        df, [Model(c, F.col("y"), TERMS, weight=c) for c in ("w", "w3")], cluster="id"
    )
    assert np.allclose(fits["w"].beta, fits["w3"].beta) and np.allclose(fits["w"].cov, fits["w3"].cov)


def test_ols_and_robust_errors(spark):
    df = frame(spark).withColumn("z", F.col("x") * 2 + F.col("y") - F.col("g"))
    models = [Model(e, F.col("z"), TERMS, family="gaussian", errors=e) for e in ("HC0", "HC1", "HC3")]
    fits = fit_models(df, models)
    x, y, _, _ = arrays(df)
    z = np.array([r[0] for r in df.select("z").collect()])
    inverse = np.linalg.inv(x.T @ x)
    beta = inverse @ x.T @ z
    r, h = z - x @ beta, np.einsum("ij,jk,ik->i", x, inverse, x)
    hc0 = inverse @ ((x * (r * r)[:, None]).T @ x) @ inverse
    scaled = x * (r / (1 - h))[:, None]
    assert np.allclose(fits["HC0"].beta, beta) and np.allclose(fits["HC0"].cov, hc0)
    assert np.allclose(fits["HC1"].cov, hc0 * len(z) / (len(z) - 4))
    assert np.allclose(fits["HC3"].cov, inverse @ (scaled.T @ scaled) @ inverse)


def test_constant_column_and_empty_risk_set_are_reported(spark):
    df = frame(spark).withColumn("one", F.lit(1))
    models = [
        Model("constant", F.col("y"), (*TERMS, Num("one")), errors="HC0"),
        Model("empty", F.col("y"), TERMS, where=F.col("g") == 9, errors="HC0"),
    ]
    fits = fit_models(df, models)
    assert fits["constant"].converged and fits["constant"].rank == 4
    found = {r["model"]: r["error"] for r in model_audit(spark, fits).collect()}
    assert found == {"constant": None, "empty": "no rows in the risk set"}


def test_absent_level_is_skipped(spark):
    df = frame(spark).filter("g < 2")
    fit = fit_models(df, [Model("m", F.col("y"), (Cat("g", 0, (0, 1, 2)),), errors="HC0")])["m"]
    assert effects.absent_rows(fit, "g", [1, 2]) == ["g[2]"]
    assert [r["comparison"] for r in effects.ratio_rows(fit, "g", [1, 2], {1: "one", 2: "two"})] == ["one"]


def test_missing_values_leave_the_model(spark):
    df = frame(spark).withColumn("x", F.when(F.col("x") < 1, F.col("x")))
    fit = fit_models(df, [Model("m", F.col("y"), TERMS, errors="HC0")])["m"]
    assert fit.n == df.filter("x is not null").count()


def test_design_names(spark):
    levels = {"s": [0, 1, 2], "t": ["a", "b"]}
    names = [n for n, _ in design_columns(crossed(Cat("s", 1), Num("x")), levels)]
    assert names == ["intercept", "s[0]", "s[2]", "x", "s[0]:x", "s[2]:x"]
    whole = design_columns([Cat("t", drop_reference=False)], levels, intercept=False)
    assert [n for n, _ in whole] == ["t[a]", "t[b]"]


def test_scenario_risks_stay_in_bounds(spark):
    df = frame(spark)
    model = Model("m", F.col("y"), TERMS, weight="w")
    fits = fit_models(df, [model], cluster="id")
    rows = effects.standardised_risks(df, [model], fits, "g", [0, 1, 2], {0: "0", 1: "1", 2: "2"}, [(2, 1)])
    x, _, w, _ = arrays(df)
    x[:, 1], x[:, 2] = 0, 1
    assert rows[2]["risk"] == pytest.approx(np.average(np.exp(x @ fits["m"].beta), weights=w))
    assert all(0 <= r["ci_low"] <= r["ci_high"] <= 1 for r in rows[:3])


def test_tails():
    assert effects.p_value(1.959963984540054) == pytest.approx(0.05)
    for df, at in ((1, 3.841459), (2, 5.991465), (3, 7.814728), (4, 9.487729), (7, 14.06714)):
        assert effects.chi2_tail(at, df) == pytest.approx(0.05, abs=1e-6)
    assert effects.chi2_tail(-1, 2) == 1.0
    assert effects.attenuation(1e-13, 0.5) is None
    assert effects.attenuation(-0.4, 0.2) == pytest.approx(50.0)


def test_sobel():
    row = effects.product_of_coefficients((0.5, 0.1), (0.4, 0.2))
    assert row["indirect"] == pytest.approx(0.2)
    assert row["se"] == pytest.approx(math.sqrt((0.4 * 0.1) ** 2 + (0.5 * 0.2) ** 2))


def test_observation_weights_are_bounded_and_stable(spark):
    df = frame(spark).withColumn("seen", (F.col("y") + (F.col("x") > 0).cast("int") > 0).cast("int"))
    rows, report = observation_weights(df, "seen", [Cat("g"), Num("x")], [Cat("g")])
    low, high = rows.agg(F.min("iow"), F.max("iow")).first()
    assert rows.filter("seen = 0").count() == 0
    assert low == pytest.approx(report.low) and high == pytest.approx(report.high)


def test_saturated_classes_are_cell_shares(spark):
    df = frame(spark, 400).withColumn("half", (F.col("x") > 0).cast("int"))
    scored = class_probabilities(df, "g", {"p": [Cat("half")]})
    share = df.groupBy("half", "g").count()
    total = df.groupBy("half").agg(F.count("*").alias("all"))
    joined = scored.join(share, ["half", "g"]).join(total, "half")
    assert joined.filter(F.abs(F.col("p") - F.col("count") / F.col("all")) > 1e-9).count() == 0


def test_continuous_classes_agree_with_spark(spark):
    df = frame(spark)
    scored = class_probabilities(df, "g", {"p": [Num("x"), Num("w")]})
    ready = VectorAssembler(inputCols=["x", "w"], outputCol="f").transform(scored)
    learner = LogisticRegression(family="multinomial", featuresCol="f", labelCol="g", tol=1e-10, maxIter=300)
    theirs = learner.fit(ready).transform(ready).withColumn("q", vector_to_array("probability")[F.col("g")])
    assert theirs.filter(F.abs(F.col("p") - F.col("q")) > 1e-4).count() == 0


def test_keyed_normals():
    keys = np.arange(200_000) * 7919
    z = impute.keyed_normals(keys, 1, 2, 3)
    assert abs(z.mean()) < 0.01 and abs(z.std() - 1) < 0.01
    assert np.array_equal(z[::-1], impute.keyed_normals(keys[::-1], 1, 2, 3))
    other = impute.keyed_normals(keys, 2, 2, 3)
    assert abs(np.corrcoef(z, other)[0, 1]) < 0.01


def test_imputation_recovers_a_linear_relation(spark):
    noise = np.random.default_rng(4)
    x = noise.normal(size=2000)
    y = 3 + 2 * x + noise.normal(scale=0.5, size=2000)
    gaps = noise.random(2000) < 0.3
    rows = [(i, float(a), None if g else float(b)) for i, (a, b, g) in enumerate(zip(x, y, gaps))]
    df = spark.createDataFrame(rows, "id int, x double, y double")
    chains = impute.fit_chains(df, "id", ["x", "y"], draws=4, rounds=2, seed=9)
    done = impute.completed(df, chains, ["y"], seed=9).orderBy("id").collect()
    draws = np.array([r["y_draws"] for r in done])
    assert np.allclose(draws[~gaps], y[~gaps][:, None])  # what was observed stays
    resid = draws[gaps] - (3 + 2 * x[gaps])[:, None]
    assert abs(resid.mean()) < 0.05 and abs(resid.std() - 0.5) < 0.05
    assert draws[gaps].std(axis=1).min() > 0
    again = impute.completed(df.repartition(5), chains, ["y"], seed=9).orderBy("id").collect()
    assert [r["y_draws"] for r in again] == [r["y_draws"] for r in done]


def test_identical_fits_pool_to_themselves(spark):
    df = frame(spark)
    fit = fit_models(df, [Model("m", F.col("y"), TERMS)], cluster="id")["m"]
    alone = effects.ratio(fit, {"x": 1.0})
    row = impute.pooled([fit, fit], {"x": {"x": 1.0}})[0]
    assert row["ci_low"] == pytest.approx(alone["ci_low"]) and row["ci_high"] == pytest.approx(alone["ci_high"])


def test_mixture_finds_separate_groups(spark):
    noise = np.random.default_rng(6)
    low, high = noise.normal(-2, 0.4, size=(300, 3)), noise.normal(2, 0.6, size=(700, 3))
    rows = [(i, *map(float, v)) for i, v in enumerate(np.vstack([low, high]))]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double")
    fitted = mixture.fit_mixtures(df, "id", ["a", "b", "c"], class_counts=(2, 3), starts=3, max_rounds=60)
    chosen = mixture.select_mixture(df, ["a", "b", "c"], fitted)
    assert chosen.chosen.classes == 2
    found = mixture.profiles(mixture.with_trajectory(df, ["a", "b", "c"], chosen), ["a", "b", "c"])
    assert {r["trajectory"]: r["n"] for r in found.collect()} == {"Class 1": 300, "Class 2": 700}


def test_class_choice_falls_back_to_all(spark):
    df = spark.createDataFrame([(i, float(i % 2) * 9 + i / 100) for i in range(40)], "id int, a double")
    fitted = mixture.fit_mixtures(df, "id", ["a"], class_counts=(2,), starts=2)
    assert mixture.select_mixture(df, ["a"], fitted, smallest_share=0.9).chosen.classes == 2


def test_transition_probabilities():
    q = markov.intensity_matrix(np.log(np.arange(1, 10) / 10), 3)
    for t in (0.5, 1, 7):
        p = markov.matrix_exponential(q * t)
        assert np.allclose(p.sum(axis=1), 1) and (p >= 0).all()
    single = markov.intensity_matrix(np.log([0.3]), 1)
    assert markov.matrix_exponential(single * 2)[0, 1] == pytest.approx(1 - math.exp(-0.6))


def test_intensities_are_recovered(spark):
    truth = np.array([0.2, 0.1, 0.05, 0.3, 0.25, 0.1, 0.15, 0.2, 0.4])
    q = markov.intensity_matrix(np.log(truth), 3)
    rows = [
        ("g", i, j, t, float(1000 * markov.matrix_exponential(q * t)[i, j]))
        for t in (1, 2)
        for i in range(3)
        for j in range(4)
    ]
    totals = spark.createDataFrame(
        rows, "g string, functional_state int, destination_state int, interval_years int, weight double"
    )
    rates = markov.fit_groups(totals, ["g"], 3).orderBy("origin", "target").collect()
    assert all(r["converged"] for r in rates)
    assert np.allclose([r["rate"] for r in rates], truth, rtol=1e-4)
    one = markov.counts_from(
        totals.filter("functional_state = 0 and destination_state in (0, 3)").toPandas().assign(destination_state=lambda d: d.destination_state // 3),
        "functional_state", "destination_state", "interval_years", "weight", 1,
    )
    theta, _, converged = markov.fit_intensities(one, 1)
    assert converged and theta.shape == (1,)


def test_person_numbers_are_dense(spark):
    people = spark.createDataFrame([(s, i) for s in (2, 3) for i in range(50 * s)], "state int, id int")
    indexed, sizes = markov.person_index(people, "state", "id")
    assert sizes == {2: 100, 3: 150}
    for s, n in sizes.items():
        found = sorted(r[0] for r in indexed.filter(f"state = {s}").select("person_no").collect())
        assert found == list(range(n))
    drawn = markov.resample(spark, sizes, "state", "int", 4, 1)
    counts = drawn.groupBy("state", "replicate").agg(F.sum("times")).collect()
    assert {(r[0], r[2]) for r in counts} == {(2, 100), (3, 150)} and len(counts) == 8


def test_solver_handles_zero_matrix():
    beta, inverse, rank = glm.solve(np.zeros((2, 2)), np.zeros(2))
    assert rank == 0 and not beta.any() and not inverse.any()


def test_errors_agree_between_cells_and_rows(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from panelwright.models.design import Cat
    from panelwright.models.glm import Model, fit_models

    rng = np.random.default_rng(8)
    rows = [(int(i), int(i % 3), int(rng.random() < 0.3 + 0.1 * (i % 3)), float(1 + i % 4)) for i in range(90)]
    df = spark.createDataFrame(rows, "id int, g int, y int, w double")
    for errors in ("cluster", "HC0", "HC1", "HC3", "none"):
        for weight in (None, "w"):
            model = Model("m", F.col("y"), (Cat("g", 0, (0, 1, 2)),), family="binomial", weight=weight, errors=errors)
            cells = fit_models(df, [model], cluster="id")["m"]
            by_row = fit_models(df, [model], cluster="id", max_cells=1)["m"]
            assert np.allclose(cells.cov, by_row.cov, rtol=1e-6, atol=1e-9, equal_nan=True), (errors, weight)


def test_undeclared_levels_and_absent_reference(spark):
    import math

    from pyspark.sql import functions as F

    from panelwright.models import effects
    from panelwright.models.design import Cat
    from panelwright.models.glm import Model, fit_models

    rows = [(i, i % 4, int(i % 5 == 0)) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, g int, y int")
    fit = fit_models(df, [Model("m", F.col("y"), (Cat("g", 0, (0, 1)),))], cluster="id")["m"]
    assert fit.n == 40
    assert math.exp(fit.beta[0]) == pytest.approx(0.2)
    absent = fit_models(df.filter("g in (1, 2)"), [Model("m", F.col("y"), (Cat("g", 0, (0, 1, 2)),))], cluster="id")["m"]
    assert effects.ratio(absent, {"g[1]": 1.0})["estimate"] is None
    assert effects.ratio(absent, {"g[2]": 1.0, "g[1]": -1.0})["estimate"] == pytest.approx(1.0)


def test_pooled_query_makes_twenty_draws_of_twenty_rounds(spark, monkeypatch):
    from panelwright.plans import QUERIES

    made, fit_chains = [], impute.fit_chains
    monkeypatch.setattr(impute, "fit_chains", lambda *a, **b: made.append(fit_chains(*a, **b)) or made[-1])
    rows = QUERIES["multiple_imputation_rr"](spark, "/root/testdata/sf0.01").collect()
    assert {r["imputations"] for r in rows} == {20}
    assert [(c.draws, len({r for r, _, _ in c.steps})) for c in made] == [(20, 20)]


def test_gate_needs_all_five_rules(spark):
    from panelwright.plans.model_queries import GATE_INTERVALS, decision_gate_full, key_gate

    moves = [(0, 2), (1, 2), (1, 0), (2, 0), (2, 1)]
    rows = spark.createDataFrame([(10 * i + k, o, d) for i in range(3) for k, (o, d) in enumerate(moves)], "id int, functional_state int, destination_state int")
    good = [{"model": m, "comparison": c, "ci_low": 1.1 if b == "ci_low" else 0.5, "ci_high": 2.0 if b == "ci_low" else 0.9} for _, m, c, b in GATE_INTERVALS]
    whole = key_gate(rows, good, 15, 3).first()
    assert whole["decision"] == "CONTINUE" and whole["events_flagged_to_better"] == 6
    few = key_gate(rows.filter("not (functional_state = 1 and destination_state = 0 and id > 10)"), good, 1, 3).first()
    assert (few["enough_events"], few["decision"]) == (False, "STOP")
    assert key_gate(rows, good, 16, 3).first()["decision"] == "STOP"
    for i, (name, *_) in enumerate(GATE_INTERVALS):
        for other in ([{**good[i], "ci_low": 0.9, "ci_high": 1.2}], []):
            row = key_gate(rows, good[:i] + other + good[i + 1 :], 15, 3).first()
            assert (row[name], row["decision"]) == (False, "STOP")

    row = decision_gate_full(spark, "/root/testdata/sf0.01").first()
    assert row["decision"] == "STOP" and not row["enough_people"]


def test_grid_ratios_against_closed_forms(spark):
    """Every fit has its five ratios; those of the weighted one-factor models are the closed form's."""
    from oracle import connect
    from panelwright.plans import model_queries as M

    sf = "/root/testdata/sf0.01"
    got = {(r["model"], r["comparison"]): r for r in M.model_grid_ratios(spark, sf).collect()}
    assert len({m for m, _ in got}) == 5 * len(M.GRID)
    sql = f"""WITH {M.S.SQL_INTERVALS}, grid(name, origin, d1, d2) AS (VALUES {M.GRID_SQL}),
    r AS (SELECT name || ' weighted' AS model, id, state AS g, CAST(n_orders AS DOUBLE) AS w, CASE WHEN destination_state IN (d1, d2) THEN 1.0 ELSE 0.0 END AS y
      FROM obs JOIN grid ON functional_state = origin),
    {M.sql_saturated(4)}, {M.PAIRS_STATE}, {M.SQL_PAIRS} SELECT model, comparison, exp(b), se FROM est WHERE b IS NOT NULL AND isfinite(b)"""
    sql = sql.replace("ln(hi.mu / lo.mu)", "CASE WHEN hi.mu > 0 AND lo.mu > 0 THEN ln(hi.mu / lo.mu) END")
    want = connect(sf).sql(sql).fetchall()
    assert len(want) >= 30
    for model, comparison, estimate, se in want:
        row = got[model, comparison]
        assert row["estimate"] == pytest.approx(estimate, abs=2e-6, rel=1e-5) and row["se_log"] == pytest.approx(se, abs=2e-6, rel=1e-5)


def test_tree_sum_adds_every_task(spark):
    from panelwright.matrices import PARTS, emitted, tree_sum

    def partial(batches):
        total = np.zeros((60, 60))
        for batch in batches:
            for v in batch.column("id").to_pylist():
                total += v
        yield emitted({3: total, 5: total[:1, :2] * 2, 9: np.zeros(0)})

    found = tree_sum(spark.range(1000).repartition(13).mapInArrow(partial, PARTS))
    assert set(found) == {3, 5} and found[3].shape == (3600,)
    assert (found[3] == 499_500).all() and (found[5] == 999_000).all()


def test_cluster_scores_stay_inside_partitions(spark, monkeypatch):
    from panelwright.models import glm

    df = frame(spark)
    models = [Model("m", F.col("y"), TERMS, weight="w"), Model("g", F.col("y"), (Cat("g"),))]
    dealt = fit_models(df.repartition(5, "id"), models, cluster="id")
    for crossing in (df.repartition(7), df.withColumn("id", F.when(F.col("x") > -0.4, 0).otherwise(F.col("id"))).repartition(7)):
        for most in (glm.MAX_CROSSING, -1):  # few clusters move, then all of them
            monkeypatch.setattr(glm, "MAX_CROSSING", most)
            fits = fit_models(crossing, models, cluster="id")
            if most < 0:
                for name, fit in fits.items():
                    assert np.allclose(fit.cov, before[name].cov, rtol=1e-10) and fit.clusters == before[name].clusters
            before = fits
        monkeypatch.undo()
    plain = fit_models(df.repartition(7), models, cluster="id")
    for name, fit in plain.items():
        assert np.allclose(fit.cov, dealt[name].cov, rtol=1e-10) and fit.clusters == dealt[name].clusters


def test_person_hub_needs_no_exchange(spark):
    from panelwright.models.glm import crossing_clusters
    from panelwright.plans.model_queries import hub_intervals

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = hub_intervals(spark, "/root/testdata/sf0.001")
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "Window" in plan and "SortMergeJoin" in plan and "Exchange" not in plan
        held = rows.select("id", "w").persist()
        assert held.count() == rows.count()
        found = crossing_clusters(held, "id")
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        assert not found.count()
        held.unpersist()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_stacked_intensity_fits_agree_with_single_ones():
    from panelwright.models import markov

    rng = np.random.default_rng(3)
    lengths = np.array([1.0, 2.0, 3.5])
    counts = rng.integers(0, 40, (9, 3, 4, 4)).astype(float)
    counts[:, :, 3] = 0
    counts[4, 1:] = 0  # a fit that lacks two of the lengths
    theta, value, converged = markov.fit_stack(counts, lengths, 3)
    for g in range(len(counts)):
        own = {t: c for t, c in zip(lengths, counts[g]) if c.any()}
        alone, best, done = markov.fit_intensities(own, 3)
        assert done == converged[g] and abs(best - value[g]) <= 1e-7 * abs(best)
        inner = (alone > markov.LOW + 0.1) & (alone < markov.HIGH - 0.1)
        assert np.allclose(np.exp(alone[inner]), np.exp(theta[g][inner]), rtol=1e-3, atol=1e-4)


def test_pattern_draws_are_multinomial(spark):
    from panelwright.models import markov

    people = [(i, "a" if i % 3 else None, i % 4, 1.0) for i in range(400)]
    rows = [(p, g, kind % 2, kind // 2, 1, w) for p, g, kind, w in people for _ in (0,)]
    df = spark.createDataFrame(rows, "id int, grp string, functional_state int, destination_state int, interval_years int, w double")
    drawn = markov.pattern_draws(df, "id", "grp", 600, 5, buckets=3).collect()
    again = markov.pattern_draws(df.repartition(6), "id", "grp", 600, 5, buckets=3).collect()
    assert sorted(map(str, drawn)) == sorted(map(str, again))  # whatever the partitions
    for group in ("a", None):
        own = [r for r in drawn if r["grp"] == group]
        n = sum(r["people"] for r in own)
        times = np.array([r["times"] for r in own])
        assert n == sum(g == group for _, g, _, _ in people) and (times.sum(axis=0) == n).all()
        for r, t in zip(own, times):
            share = r["people"] / n
            assert abs(t.mean() - n * share) < 5 * np.sqrt(n * share * (1 - share) / 600)
            assert 0.8 < t.var() / (n * share * (1 - share)) < 1.25
    totals = markov.pattern_totals(markov.pattern_draws(df, "id", "grp", 600, 5, buckets=3), "grp")
    assert totals.where("replicate = 17").agg(F.sum("weight")).first()[0] == 400


def test_bootstrap_counts_its_successes(spark, monkeypatch):
    from panelwright.models import markov
    from panelwright.plans import study_queries

    rows = study_queries.markov_bootstrap_ci(spark, "/root/testdata/sf0.001", replicates=4, least_successful=4).collect()
    assert all(r["bootstrap_requested"] == 4 and 0 <= r["bootstrap_successful"] <= 4 for r in rows)
    assert all(r["feasible"] == (r["bootstrap_successful"] == 4 and r["converged"] == 1) for r in rows)
    whole = markov.fit_stack

    def failing(*args, **more):
        theta, value, converged = whole(*args, **more)
        return theta, value, converged & False

    monkeypatch.setattr(markov, "fit_stack", failing)
    rows = study_queries.markov_bootstrap_ci(spark, "/root/testdata/sf0.001", replicates=2).collect()
    assert rows and all(r["bootstrap_successful"] == 0 and not r["feasible"] and r["ci_low"] is None for r in rows)


def test_seeded_starts_never_fit_worse(spark):
    from panelwright.models import mixture

    rng = np.random.default_rng(11)
    middles = np.array([[0, 0], [0, 6], [6, 0], [30, 30]])
    rows = [(i, *(middles[3 if i % 50 == 1 else 1 + i % 2 if i % 5 == 0 else 0] + rng.normal(size=2))) for i in range(1500)]
    df = spark.createDataFrame([(int(i), float(a), float(b)) for i, a, b in rows], "id long, a double, b double")
    plain = mixture.fit_mixtures(df, "id", ["a", "b"], (2, 4), starts=2, seed=3, seeded=False)
    more = mixture.fit_mixtures(df, "id", ["a", "b"], (2, 4), starts=2, seed=3)
    again = mixture.fit_mixtures(df.repartition(7), "id", ["a", "b"], (2, 4), starts=2, seed=3)
    for k in (2, 4):
        assert more[k].loglik >= plain[k].loglik - 1e-6
        assert abs(more[k].loglik - again[k].loglik) < 1e-6
    assert np.allclose(sorted(more[4].means.sum(axis=1)), [0, 6, 6, 60], atol=1.0)
    same = spark.createDataFrame([(i, 1.0, 2.0) for i in range(30)], "id long, a double, b double")
    assert mixture.fit_mixtures(same, "id", ["a", "b"], (3,), starts=2)[3].n == 30


def test_balance_tells_a_wrong_fit(spark):
    from panelwright.models import effects

    df = frame(spark)
    model = Model("m", F.col("y"), TERMS, weight="w")
    fits = fit_models(df, [model], cluster="id")
    rows = effects.balance(df, fits, [model]).collect()
    assert len(rows) == len(fits["m"].names) and all(abs(r["observed"] - r["fitted"]) < 1e-6 * max(1, abs(r["observed"])) for r in rows)
    fits["m"].beta = fits["m"].beta + 0.01
    assert any(abs(r["observed"] - r["fitted"]) > 1e-3 for r in effects.balance(df, fits, [model]).collect())


def test_penalised_classes_treat_every_class_alike(spark):
    df = frame(spark)
    terms = (Num("x"), Num("w"))
    first = Model("first", F.col("g"), terms, family="multinomial", errors="none", classes=3, penalty=25.0)
    turned = Model("turned", 2 - F.col("g"), terms, family="multinomial", errors="none", classes=3, penalty=25.0)
    fits = fit_models(df, [first, turned])
    one = glm.class_shares(df, fits["first"], first, "p")
    both = glm.class_shares(one, fits["turned"], turned, "q").select("p", F.reverse("q").alias("q")).collect()
    assert max(abs(a - b) for r in both for a, b in zip(r.p, r.q)) < 1e-9

    pdf = df.toPandas()
    x = np.column_stack([np.ones(len(pdf)), pdf.x, pdf.w])
    beta = np.zeros((3, 3))  # a class per row; the penalty alone settles the slopes, so plain descent finds them
    hit = np.eye(3)[pdf.g.to_numpy()]
    for _ in range(20_000):
        odds = np.exp(x @ beta.T)
        beta += 1e-3 * ((hit - odds / odds.sum(axis=1, keepdims=True)).T @ x - 25.0 * beta * [0, 1, 1])
    slopes = (beta - beta[0])[1:, 1:]
    assert np.allclose(fits["first"].beta.reshape(2, 3)[:, 1:], slopes, atol=1e-6)
    gap = effects.balance(df, fits, [first, turned]).filter(F.abs(F.col("observed") - F.col("fitted")) > 1e-6)
    assert gap.count() == 0


def test_penalty_settles_separated_and_constant_columns(spark):
    df = spark.createDataFrame([(float(i), int(i > 4), 1.0) for i in range(10)], "x double, y int, one double")
    model = Model("m", F.col("y"), (Num("x"), Num("one")), family="binomial", errors="none", penalty=0.5)
    fit = fit_models(df, [model])["m"]
    assert fit.converged and fit.error is None
    assert abs(fit.beta[fit.at("one")]) < 1e-9 and 0.5 < fit.beta[fit.at("x")] < 5


def test_models_on_imputations_share_one_outcome_column(spark):
    """Rows hold an outcome once, and a model leaves out the rows that lack its own column or weight."""
    from dataclasses import replace

    from panelwright.models.glm import _Layout

    rows = spark.createDataFrame(
        [(i, i % 3, float(i % 2), float(i), None if i % 5 == 0 else float(i % 7), None if i == 1 else 1.0 + i % 4) for i in range(200)],
        "id int, risk int, y double, x0 double, x1 double, w double",
    )
    one = Model("0", F.col("y"), (Num("x0"),), where=F.col("risk") == 1, weight="w")
    models = [one, replace(one, name="1", terms=(Num("x1"),)), replace(one, name="2", where=F.col("risk") < 2)]
    layout = _Layout(rows, models, "id")
    assert [c for c in layout.rows.columns if c.startswith("__o")] == ["__o0", "__o1"]
    fits = fit_models(rows, models, cluster="id", max_cells=0)
    assert [fits[n].n for n in "012"] == [66, 53, 133]
