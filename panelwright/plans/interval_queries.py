"""Intervals, sequences, reports and sufficient statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import recode as R
from ..operators import intervals as I
from ..operators import joins, reshape, summaries
from ..operators import sequences as Q
from ..sources.tables import stored
from . import standin as S
from .panel_queries import SQL_LAG, lagged_intervals
from .registry import query, rounded


@query(
    "intervals_with_censoring",
    f"""WITH {S.SQL_INTERVALS} SELECT id, wave, state, functional_state, destination_state, known_dead,
      outcome_observed, "interval", interval_years FROM iv""",
)
def intervals_with_censoring(spark, sf):
    return S.intervals(spark, sf).select(
        "id", "wave", "state", "functional_state", "destination_state", "known_dead",
        "outcome_observed", "interval", "interval_years",
    )


@query(
    "mortality_intervals",
    f"""WITH {S.SQL_INTERVALS}
    SELECT id, wave, state, CASE WHEN known_dead = 1 THEN 1 ELSE 0 END AS death FROM iv
    WHERE outcome_observed = 1 AND n_orders >= 1""",
)
def mortality_intervals(spark, sf):
    code = F.when(F.col("known_dead") == 1, 5).when(F.col("outcome_observed") == 1, 1).otherwise(9)
    return I.mortality_intervals(
        S.intervals(spark, sf), "id", "wave", I.vital_outcome(code), F.col("n_orders") >= 1
    ).select("id", "wave", "state", "death")


@query(
    "state_transitions",
    f"""WITH {S.SQL_PANEL} SELECT p.id, p.wave, p.state AS from_state, q.state AS to_state
    FROM panel p JOIN panel q ON q.id = p.id AND q.wave = p.wave + 1""",
)
def state_transitions(spark, sf):
    waves = S.panel(spark, sf).withColumn("seen", F.lit(1))
    return I.state_pairs(waves, "id", "wave", "state", "seen")


SQL_MATRIX = """ SELECT functional_state, destination_state, n,
    CASE functional_state WHEN 0 THEN 'Settled' WHEN 1 THEN 'Pending' ELSE 'Flagged' END AS origin_label,
    CASE destination_state WHEN 0 THEN 'Settled' WHEN 1 THEN 'Pending' WHEN 2 THEN 'Flagged' ELSE 'Gone' END AS destination_label,
    round(100.0 * n / sum(n) OVER (PARTITION BY functional_state), 6) AS row_percent
    FROM (SELECT functional_state, destination_state, count(*) AS n FROM {} WHERE outcome_observed = 1 GROUP BY 1, 2)"""


def matrix(intervals):
    counted = summaries.counts_with_share(
        intervals.filter("outcome_observed = 1"),
        ["functional_state", "destination_state"],
        ["functional_state"],
        "row_percent",
        100.0,
    )
    return rounded(S.labelled(counted))


@query("transition_matrix", f"WITH {S.SQL_INTERVALS}" + SQL_MATRIX.format("iv"))
def transition_matrix(spark, sf):
    return matrix(S.intervals(spark, sf, build=S.status_panel))


@query(
    "strict_transition_matrix",
    f"WITH {S.SQL_STRICT}, {S.sql_intervals('strict', 'siv')}" + SQL_MATRIX.format("siv"),
)
def strict_transition_matrix(spark, sf):
    return matrix(S.intervals(spark, sf, threshold=2, build=S.status_panel))


@query(
    "descriptive_risks",
    f"""WITH {S.SQL_INTERVALS}
    SELECT functional_state, destination_state, state, n, round(n * 1.0 / sum(n) OVER (PARTITION BY functional_state, state), 6) AS risk
    FROM (SELECT functional_state, destination_state, state, count(*) AS n FROM obs GROUP BY 1, 2, 3)""",
)
def descriptive_risks(spark, sf):
    return rounded(
        summaries.counts_with_share(
            S.observed(spark, sf),
            ["functional_state", "destination_state", "state"],
            ["functional_state", "state"],
            "risk",
        )
    )


@query(
    "exposure_distribution",
    f"""WITH {S.SQL_INTERVALS}
    SELECT wave, state, n, round(100.0 * n / sum(n) OVER (PARTITION BY wave), 6) AS percent
    FROM (SELECT wave, state, count(*) AS n FROM obs GROUP BY 1, 2)""",
)
def exposure_distribution(spark, sf):
    return rounded(
        summaries.counts_with_share(S.observed(spark, sf), ["wave", "state"], ["wave"], "percent", 100.0)
    )


@query(
    "incident_risk_set",
    f"""WITH {S.SQL_PANEL}, pairs AS (
      SELECT p.id, p.wave, p.state, CASE WHEN q.functional_state = 2 THEN 1 ELSE 0 END AS incident
      FROM panel p JOIN panel q ON q.id = p.id AND q.wave = p.wave + 1
      WHERE p.functional_state < 2 AND p.wave <= 5)
    SELECT * FROM pairs WHERE NOT EXISTS (SELECT 1 FROM pairs e WHERE e.id = pairs.id AND e.wave < pairs.wave AND e.incident = 1)""",
)
def incident_risk_set(spark, sf):
    pairs = Q.add_next_wave(S.panel(spark, sf), "id", "wave", {"__after": F.col("functional_state")})
    pairs = pairs.withColumn("incident", R.event_in("__after", [2]))
    eligible = F.col("__has_next") & (F.col("functional_state") < 2) & (F.col("wave") <= S.LAST_ORIGIN)
    kept = Q.incident_risk_set(pairs, "id", "wave", eligible, F.col("incident") == 1)
    return kept.select("id", "wave", "state", "incident")


@query(
    "first_decline_followup",
    f"""WITH {S.SQL_INTERVALS}, started AS (
      SELECT * FROM obs WHERE id IN (SELECT id FROM obs WHERE wave = 2 AND functional_state = 0))
    SELECT id, wave, functional_state, destination_state FROM started s
    WHERE functional_state = 0 AND NOT EXISTS (
      SELECT 1 FROM started e WHERE e.id = s.id AND e.wave < s.wave
      AND (e.functional_state <> 0 OR e.destination_state IN (1, 2, 3)))""",
)
def first_decline_followup(spark, sf):
    kept = Q.first_event_followup(
        S.observed(spark, sf), "id", "wave", "functional_state", "destination_state", 2, [1, 2, 3]
    )
    return kept.select("id", "wave", "functional_state", "destination_state")


SQL_HISTORY = """hist AS (
  SELECT p.id, p.wave, p.state,
    (SELECT count(*) FROM panel h WHERE h.id = p.id AND h.wave <= p.wave) AS known,
    (SELECT count(*) FROM panel h WHERE h.id = p.id AND h.wave <= p.wave AND h.state = 3) AS n_both,
    (SELECT count(*) FROM panel h WHERE h.id = p.id AND h.wave < p.wave AND h.state = 3) AS n_prior
  FROM panel p WHERE p.wave IN (2, 3, 4)),
history AS (
  SELECT id, wave, CASE WHEN known = wave THEN 1 ELSE 0 END AS complete_history,
    CASE WHEN known = wave THEN CASE WHEN n_prior > 0 THEN 1 ELSE 0 END END AS prior_both,
    CASE WHEN known = wave THEN n_both END AS both_count,
    CASE WHEN known <> wave THEN 'incomplete'
      WHEN state = 2 AND n_prior = 0 THEN 'single_never'
      WHEN state = 2 THEN 'single_after'
      WHEN state = 3 AND n_prior = 0 THEN 'first'
      WHEN state = 3 THEN 'repeated' ELSE 'other' END AS history_group
  FROM hist)"""


def history(spark, sf):
    return Q.exposure_history(S.panel(spark, sf), "id", "wave", "state", [2, 3, 4])


@query("exposure_history", f"WITH {S.SQL_PANEL}, {SQL_HISTORY} SELECT * FROM history")
def exposure_history(spark, sf):
    return history(spark, sf)


def interval_history(spark, sf):
    """Observed intervals with the exposure history at their origin, from one window."""
    return S.observed(
        spark, sf, extend=lambda p: Q.with_exposure_history(p, "id", "wave", "state", [2, 3, 4])
    )


GROUPS = [Q.HISTORY_GROUPS[k] for k in ("single_never", "single_after", "first", "repeated")]
SQL_GROUPS = ", ".join(f"({i}, '{g}')" for i, g in enumerate([*GROUPS, "Never assigned"]))


@query(
    "history_counts_all_levels",
    f"""WITH {S.SQL_INTERVALS}, {SQL_HISTORY},
    declared(level_order, history_group) AS (VALUES {SQL_GROUPS}),
    x AS (SELECT o.id, o.destination_state, h.history_group FROM obs o JOIN history h ON h.id = o.id AND h.wave = o.wave
          WHERE o.functional_state = 1 AND h.complete_history = 1)
    SELECT d.level_order, d.history_group, count(x.id) AS intervals, count(DISTINCT x.id) AS people,
      CAST(coalesce(sum(CASE WHEN x.destination_state = 2 THEN 1 ELSE 0 END), 0) AS BIGINT) AS events
    FROM declared d LEFT JOIN x ON x.history_group = d.history_group GROUP BY 1, 2""",
)
def history_counts_all_levels(spark, sf):
    rows = interval_history(spark, sf).filter("functional_state = 1 and complete_history = 1")
    return summaries.counts_all_levels(
        rows,
        "history_group",
        [*GROUPS, "Never assigned"],
        {
            "intervals": F.count(F.lit(1)),
            "people": F.countDistinct("id"),
            "events": F.sum(R.event_in("destination_state", [2])),
        },
    )


SQL_ONSET = """starts AS (
  SELECT id, min(CASE WHEN state = 3 THEN wave END) AS first_both_wave, min(CASE WHEN a = 1 THEN wave END) AS fa,
    min(CASE WHEN b = 1 THEN wave END) AS fb FROM panel GROUP BY id),
onset AS (SELECT id, first_both_wave, CASE WHEN fa < fb THEN 'Urgent first' WHEN fb < fa THEN 'High spend first' ELSE 'Same observed wave' END AS sequence
  FROM starts WHERE first_both_wave > 1)"""
ORDER_LABELS = ("Urgent first", "High spend first", "Same observed wave")


def onset(spark, sf):
    return Q.onset_order(S.panel(spark, sf), "id", "wave", "a", "b", ORDER_LABELS)


@query(
    "onset_order_landmark",
    f"""WITH {S.SQL_INTERVALS}, {SQL_ONSET}
    SELECT sequence, count(DISTINCT s.id) AS people, count(destination_state) AS observed_intervals,
      CAST(sum(CASE WHEN functional_state = 1 THEN 1 ELSE 0 END) AS BIGINT) AS origin_intervals,
      CAST(sum(CASE WHEN functional_state = 1 AND destination_state = 2 THEN 1 ELSE 0 END) AS BIGINT) AS events,
      sum(CASE WHEN functional_state = 1 THEN 1 ELSE 0 END) >= 20 AND sum(CASE WHEN functional_state = 1 AND destination_state = 2 THEN 1 ELSE 0 END) >= 5 AS feasible
    FROM onset s LEFT JOIN obs o ON o.id = s.id AND o.wave = s.first_both_wave GROUP BY 1""",
)
def onset_order_landmark(spark, sf):
    rows = joins.landmark_join(onset(spark, sf), S.observed(spark, sf), "id", "wave", "first_both_wave")
    origin = F.col("functional_state") == 1
    counted = rows.groupBy("sequence").agg(
        F.countDistinct("id").alias("people"),
        F.count("destination_state").alias("observed_intervals"),
        F.sum(R.flag(origin)).alias("origin_intervals"),
        F.sum(R.flag(origin & (F.col("destination_state") == 2))).alias("events"),
    )
    return counted.withColumn("feasible", (F.col("origin_intervals") >= 20) & (F.col("events") >= 5))


@query(
    "onset_order_followup",
    f"""WITH {S.SQL_INTERVALS}, {SQL_ONSET},
    x AS (SELECT o.*, sequence FROM obs o JOIN onset s ON s.id = o.id AND o.wave >= s.first_both_wave WHERE functional_state = 1)
    SELECT sequence, count(DISTINCT id) AS people, count(*) AS intervals,
      CAST(sum(CASE WHEN destination_state = 2 THEN 1 ELSE 0 END) AS BIGINT) AS progressions,
      CAST(sum(CASE WHEN destination_state = 0 THEN 1 ELSE 0 END) AS BIGINT) AS recoveries,
      round(100.0 * sum(CASE WHEN destination_state = 2 THEN 1 ELSE 0 END) / count(*), 6) AS progression_percent,
      round(100.0 * sum(CASE WHEN destination_state = 0 THEN 1 ELSE 0 END) / count(*), 6) AS recovery_percent
    FROM x GROUP BY 1""",
)
def onset_order_followup(spark, sf):
    rows = S.observed(
        spark, sf, extend=lambda p: Q.with_onset_order(p, "id", "wave", "a", "b", ORDER_LABELS)
    ).filter("sequence is not null and wave >= first_both_wave and functional_state = 1")
    counted = rows.groupBy("sequence").agg(
        F.countDistinct("id").alias("people"),
        F.count(F.lit(1)).alias("intervals"),
        F.sum(R.event_in("destination_state", [2])).alias("progressions"),
        F.sum(R.event_in("destination_state", [0])).alias("recoveries"),
    )
    return rounded(
        counted.select(
            "*",
            F.try_divide(100.0 * F.col("progressions"), F.col("intervals")).alias("progression_percent"),
            F.try_divide(100.0 * F.col("recoveries"), F.col("intervals")).alias("recovery_percent"),
        )
    )


@query(
    "intervals_from_landmark",
    f"""WITH {S.SQL_INTERVALS}, {SQL_ONSET} SELECT o.id, o.wave, s.first_both_wave, s.sequence FROM obs o JOIN onset s ON s.id = o.id AND o.wave >= s.first_both_wave""",
)
def intervals_from_landmark(spark, sf):
    """The same follow-up when the onsets come as a table of their own."""
    rows = joins.from_landmark_on(
        onset(spark, sf), S.observed(spark, sf), "id", "wave", "first_both_wave"
    )
    return rows.select("id", "wave", "first_both_wave", "sequence")


@query(
    "interval_history_join",
    f"""WITH {S.SQL_INTERVALS}, {SQL_HISTORY} SELECT o.id, o.wave, h.complete_history, h.both_count, h.history_group FROM obs o LEFT JOIN history h ON h.id = o.id AND h.wave = o.wave""",
)
def interval_history_join(spark, sf):
    """Histories held as a table of their own, joined many to one."""
    joined = joins.checked_join(S.observed(spark, sf), history(spark, sf), ["id", "wave"])
    return joined.select("id", "wave", "complete_history", "both_count", "history_group")


@query(
    "crude_event_rates",
    f"""WITH {S.SQL_INTERVALS}
    SELECT functional_state, state, count(*) AS intervals, count(DISTINCT id) AS people,
      CAST(sum(CASE WHEN destination_state = 2 THEN 1 ELSE 0 END) AS BIGINT) AS events,
      round(avg(CASE WHEN destination_state = 2 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM obs GROUP BY 1, 2""",
)
def crude_event_rates(spark, sf):
    return rounded(
        summaries.group_rates(
            S.observed(spark, sf), ["functional_state", "state"], F.col("destination_state") == 2, "id"
        )
    )


@query(
    "missingness_report",
    f"""WITH {S.SQL_INTERVALS}, {S.SQL_PEOPLE}, {SQL_LAG},
    f AS (SELECT l.*, p.balance FROM lagged l LEFT JOIN people p ON p.id = l.id QUALIFY row_number() OVER (PARTITION BY l.id ORDER BY l.wave) = 1)
    SELECT 'lag_state' AS variable, CAST(count(*) - count(lag_state) AS BIGINT) AS missing_n, round(100.0 * (count(*) - count(lag_state)) / count(*), 6) AS missing_percent FROM f
    UNION ALL SELECT 'balance', count(*) - count(balance), round(100.0 * (count(*) - count(balance)) / count(*), 6) FROM f
    UNION ALL SELECT 'destination_state', count(*) - count(destination_state), round(100.0 * (count(*) - count(destination_state)) / count(*), 6) FROM f""",
)
def missingness_report(spark, sf):
    first = Q.first_per_person(lagged_intervals(spark, sf), "id", "wave")
    rows = S.with_people(first, spark, sf)
    return rounded(summaries.missingness(rows, ["lag_state", "balance", "destination_state"]))


@query(
    "qa_checks",
    f"""WITH {S.SQL_INTERVALS}, c AS (
      SELECT CAST(count(*) AS BIGINT) AS "rows", CAST(count(DISTINCT id) AS BIGINT) AS people,
        CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT id, wave FROM iv)) AS BIGINT) AS duplicate_keys,
        CAST(sum(CASE WHEN functional_state NOT IN (0, 1, 2) THEN 1 ELSE 0 END) AS BIGINT) AS bad_origin,
        CAST(sum(CASE WHEN destination_state IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS censored,
        CAST(sum(CASE WHEN n_orders <= 0 THEN 1 ELSE 0 END) AS BIGINT) AS bad_weight FROM iv)
    UNPIVOT c ON "rows", people, duplicate_keys, bad_origin, censored, bad_weight INTO NAME "check" VALUE "value" """,
)
def qa_checks(spark, sf):
    return summaries.quality_checks(
        S.intervals(spark, sf, build=S.status_panel),
        ["id", "wave"],
        "id",
        {
            "bad_origin": ~F.col("functional_state").isin(0, 1, 2),
            "censored": F.col("destination_state").isNull(),
            "bad_weight": F.col("n_orders") <= 0,
        },
    )


@query(
    "cohort_flow",
    f"""WITH {S.SQL_INTERVALS}, {S.SQL_PEOPLE}, {SQL_LAG},
    m AS (SELECT count(*) AS n1, count(*) FILTER (wave >= 2) AS n2, count(*) FILTER (wave >= 2 AND lag_state IS NOT NULL) AS n3,
      count(*) FILTER (wave >= 2 AND lag_state IS NOT NULL AND outcome_observed = 1) AS n4,
      count(*) FILTER (wave >= 2 AND lag_state IS NOT NULL AND outcome_observed = 1 AND balance IS NOT NULL) AS n5
      FROM lagged l LEFT JOIN people p ON p.id = l.id)
    SELECT 1 AS step_no, 'All origins' AS step, n1 AS n, CAST(NULL AS DOUBLE) AS retained FROM m
    UNION ALL SELECT 2, 'Second wave or later', n2, round(n2 / n1, 6) FROM m
    UNION ALL SELECT 3, 'Previous wave known', n3, round(n3 / n2, 6) FROM m
    UNION ALL SELECT 4, 'Destination observed', n4, round(n4 / n3, 6) FROM m
    UNION ALL SELECT 5, 'Complete covariates', n5, round(n5 / n4, 6) FROM m""",
)
def cohort_flow(spark, sf):
    rows = S.with_people(lagged_intervals(spark, sf), spark, sf)
    return rounded(
        summaries.cohort_flow(
            rows,
            [
                ("All origins", F.lit(True)),
                ("Second wave or later", F.col("wave") >= 2),
                ("Previous wave known", F.col("lag_state").isNotNull()),
                ("Destination observed", F.col("outcome_observed") == 1),
                ("Complete covariates", R.all_present(["balance"])),
            ],
        )
    )


@query(
    "table1_first_origin",
    f"""WITH {S.SQL_INTERVALS}, {S.SQL_PEOPLE},
    f AS (SELECT o.*, balance, half FROM obs o LEFT JOIN people p ON p.id = o.id QUALIFY row_number() OVER (PARTITION BY o.id ORDER BY wave) = 1),
    g AS (SELECT state, count(*) AS n, count(balance) AS bn, avg(balance) AS bm, stddev_samp(balance) AS bs, avg(spend) AS sm, stddev_samp(spend) AS ss,
      count(*) FILTER (half = 1) AS hn, count(*) FILTER (functional_state = 0) AS f0, count(*) FILTER (functional_state = 1) AS f1, count(*) FILTER (functional_state = 2) AS f2 FROM f GROUP BY state)
    SELECT state, 'Participants' AS characteristic, n, CAST(NULL AS DOUBLE) AS mean_or_percent, CAST(NULL AS DOUBLE) AS sd FROM g
    UNION ALL SELECT state, 'balance', bn, round(bm, 4), round(bs, 4) FROM g
    UNION ALL SELECT state, 'spend', n, round(sm, 4), round(ss, 4) FROM g
    UNION ALL SELECT state, 'half', hn, round(100.0 * hn / n, 4), NULL FROM g
    UNION ALL SELECT state, 'functional_state: 0', f0, round(100.0 * f0 / n, 4), NULL FROM g
    UNION ALL SELECT state, 'functional_state: 1', f1, round(100.0 * f1 / n, 4), NULL FROM g
    UNION ALL SELECT state, 'functional_state: 2', f2, round(100.0 * f2 / n, 4), NULL FROM g""",
)
def table1_first_origin(spark, sf):
    rows = S.with_people(S.observed(spark, sf), spark, sf)
    return rounded(
        summaries.baseline_table(
            rows, "id", "wave", "state", ["balance", "spend"], ["half"], {"functional_state": [0, 1, 2]}
        ),
        4,
    )


@query(
    "weight_normalised",
    f"""WITH {S.SQL_INTERVALS} SELECT id, wave, round(n_orders / avg(n_orders) OVER (PARTITION BY "interval"), 6) AS weight_norm FROM obs""",
)
def weight_normalised(spark, sf):
    rows = Q.mean_normalised(S.observed(spark, sf), ["interval"], "n_orders", "weight_norm")
    return rounded(rows.select("id", "wave", "weight_norm"))


SQL_BOUNDS = "(SELECT quantile_cont(ratio, 0.01) FROM x WHERE outcome_observed = 1)", "(SELECT quantile_cont(ratio, 0.99) FROM x WHERE outcome_observed = 1)"
SQL_RATIO = """x AS (SELECT id, wave, state, outcome_observed, spend / (SELECT avg(o_totalprice) FROM orders) AS ratio FROM iv)"""


def price_ratio(spark, sf):
    mean = S.table(spark, sf, "orders", "o_totalprice").agg(F.avg("o_totalprice")).first()[0]
    rows = S.intervals(spark, sf).withColumn("ratio", F.col("spend") / F.lit(mean))
    return stored(rows.select("id", "wave", "outcome_observed", "ratio"), "ratio")


@query(
    "winsorised_ratio",
    f"""WITH {S.SQL_INTERVALS}, {SQL_RATIO} SELECT id, wave, round(least(greatest(ratio, {SQL_BOUNDS[0]}), {SQL_BOUNDS[1]}), 6) AS ratio_w
    FROM x WHERE outcome_observed = 1""",
)
def winsorised_ratio(spark, sf):
    rows, _ = Q.winsorised(price_ratio(spark, sf).filter("outcome_observed = 1"), "ratio", "ratio_w")
    return rounded(rows.select("id", "wave", "ratio_w"))


@query(
    "weight_diagnostics",
    f"""WITH {S.SQL_INTERVALS}, {SQL_RATIO} SELECT count(ratio) AS n, round(avg(ratio), 6) AS mean, round(stddev_samp(ratio), 6) AS sd,
      round(min(ratio), 6) AS min, round(max(ratio), 6) AS max, round(avg(CASE WHEN ratio < 0.5 THEN 1.0 ELSE 0.0 END), 6) AS share_below,
      round(quantile_cont(ratio, 0.01), 6) AS p01, round(quantile_cont(ratio, 0.5), 6) AS median, round(quantile_cont(ratio, 0.99), 6) AS p99 FROM x""",
)
def weight_diagnostics(spark, sf):
    return rounded(summaries.weight_summary(price_ratio(spark, sf), "ratio", below=("ratio", 0.5)))


@query(
    "weight_truncation",
    f"""WITH {S.SQL_INTERVALS}, {SQL_RATIO}, q AS (SELECT quantile_cont(ratio, 0.01) AS low, quantile_cont(ratio, 0.99) AS high FROM x)
    SELECT round(any_value(low), 6) AS low, round(any_value(high), 6) AS high, count(ratio) AS n, count(*) FILTER (ratio < low) AS n_below,
      count(*) FILTER (ratio > high) AS n_above, count(*) FILTER (ratio < low OR ratio > high) AS truncated_n FROM x, q""",
)
def weight_truncation(spark, sf):
    """How many weights the bounds change."""
    return rounded(summaries.weight_truncation(price_ratio(spark, sf), "ratio"))


@query(
    "zscore_within",
    f"""WITH {S.SQL_PANEL}, {S.SQL_PEOPLE} SELECT p.id, wave, round((spend - avg(spend) OVER w) / stddev_samp(spend) OVER w, 6) AS spend_z,
      round(coalesce((balance - avg(balance) OVER w) / stddev_samp(balance) OVER w, 0), 6) AS balance_z
    FROM panel p JOIN people q ON q.id = p.id WINDOW w AS (PARTITION BY half)""",
)
def zscore_within(spark, sf):
    rows = S.with_people(S.panel(spark, sf), spark, sf)
    scaled = Q.standardise_within(rows, ["half"], {"spend": "spend_z", "balance": "balance_z"})
    return rounded(scaled.select("id", "wave", "spend_z", F.coalesce("balance_z", F.lit(0.0)).alias("balance_z")))


YEARS = [1, 3, 5]
SQL_SPEND_WIDE = """wide AS (SELECT id, max(CASE WHEN wave = 1 THEN spend END) AS s1, max(CASE WHEN wave = 3 THEN spend END) AS s3,
  max(CASE WHEN wave = 5 THEN spend END) AS s5 FROM panel GROUP BY id),
wp AS (SELECT w.*, half FROM wide w JOIN people p ON p.id = w.id),
ref AS (SELECT half, avg(s1) AS m, stddev_pop(s1) AS s FROM wp WHERE s1 IS NOT NULL AND s3 IS NOT NULL AND s5 IS NOT NULL GROUP BY half)"""


def spend_wide(spark, sf):
    """Spend at waves 1, 3 and 5 side by side, on the wave-1 scale of its half."""
    wide = reshape.long_to_wide(S.panel(spark, sf), "id", "wave", YEARS, "spend", lambda w: f"s{w}")
    rows = S.with_people(wide, spark, sf)
    return Q.standardise_to_reference(
        rows, "half", "s1", {f"s{w}": f"z{w}" for w in YEARS}, R.all_present([f"s{w}" for w in YEARS])
    )


@query(
    "zscore_fixed_reference",
    f"""WITH {S.SQL_PANEL}, {S.SQL_PEOPLE}, {SQL_SPEND_WIDE}
    SELECT id, {", ".join(f"CASE WHEN s1 IS NOT NULL AND s3 IS NOT NULL AND s5 IS NOT NULL THEN round((s{w} - m) / s, 6) END AS z{w}" for w in YEARS)},
      CASE WHEN s3 IS NOT NULL THEN round((s5 - s1) * 2 / 8, 6) END AS slope
    FROM wp LEFT JOIN ref ON ref.half = wp.half""",
)
def zscore_fixed_reference(spark, sf):
    rows = spend_wide(spark, sf)
    slope = R.linear_slope([f"s{w}" for w in YEARS], [0.0, 2.0, 4.0])
    return rounded(rows.select("id", "z1", "z3", "z5", F.round(slope, 6).alias("slope")))


@query(
    "cumulative_weight",
    f"""WITH {S.SQL_INTERVALS}, r AS (SELECT id, wave, 0.5 + n_orders / (n_orders + 1.0) AS w FROM obs)
    SELECT id, wave, round(product(w) OVER (PARTITION BY id ORDER BY wave ROWS UNBOUNDED PRECEDING), 6) AS running FROM r""",
)
def cumulative_weight(spark, sf):
    rows = S.observed(spark, sf).withColumn("w", 0.5 + F.col("n_orders") / (F.col("n_orders") + 1.0))
    return rounded(Q.running_product(rows, "id", "wave", "w", "running").select("id", "wave", "running"))


SQL_STACK = """c AS (SELECT *, CASE WHEN spend >= 350000 THEN 1 ELSE 0 END AS costly, CASE WHEN n_orders > 1 THEN 1 ELSE 0 END AS repeated FROM obs),
stacked AS (
  SELECT *, 'Urgent' AS index_name, a AS index_flag, a + 2 * b AS index_state, greatest(costly + repeated, 0) AS other_count FROM c
  UNION ALL SELECT *, 'Costly', costly, costly + 2 * b, greatest(costly + repeated - costly, 0) FROM c
  UNION ALL SELECT *, 'Repeated', repeated, repeated + 2 * b, greatest(costly + repeated - repeated, 0) FROM c)"""


@query(
    "index_condition_stack",
    f"""WITH {S.SQL_INTERVALS}, {SQL_STACK} SELECT id, wave, index_name, index_flag, index_state, other_count FROM stacked""",
)
def index_condition_stack(spark, sf):
    return index_stack(S.observed(spark, sf)).select(
        "id", "wave", "index_name", "index_flag", "index_state", "other_count"
    )


def index_stack(rows):
    """One copy per index condition; its own contribution leaves the count of the others."""
    costly, repeated = R.flag(F.col("spend") >= 350000), R.flag(F.col("n_orders") > 1)
    rows = rows.withColumn("costly", costly).withColumn("repeated", repeated)
    total = F.col("costly") + F.col("repeated")

    def copy(name, own, counted):
        return {
            "index_name": F.lit(name),
            "index_flag": F.col(own),
            "index_state": R.two_flag_state(own, "b"),
            "other_count": R.count_without(total, F.col(own) if counted else F.lit(0)),
        }

    return reshape.stack_copies(
        rows, [copy("Urgent", "a", False), copy("Costly", "costly", True), copy("Repeated", "repeated", True)]
    )


@query(
    "scenario_expand",
    f"""WITH {S.SQL_INTERVALS}, levels(state) AS (VALUES (0), (1), (2), (3))
    SELECT o.id, o.wave, levels.state, o.functional_state FROM obs o CROSS JOIN levels WHERE o.functional_state = 1""",
)
def scenario_expand(spark, sf):
    rows = S.observed(spark, sf).filter("functional_state = 1")
    return reshape.set_to_each_level(rows, "state", [0, 1, 2, 3]).select("id", "wave", "state", "functional_state")


@query(
    "decision_gate",
    f"""WITH {S.SQL_INTERVALS}, c AS (SELECT count(*) AS intervals, count(DISTINCT id) AS people,
      CAST(sum(CASE WHEN functional_state = 0 AND destination_state = 2 THEN 1 ELSE 0 END) AS BIGINT) AS events FROM obs)
    SELECT intervals, people, events, people >= 500 AS enough_people, events >= 200 AS enough_events,
      CASE WHEN people >= 500 AND events >= 200 THEN 'CONTINUE' ELSE 'STOP' END AS decision FROM c""",
)
def decision_gate(spark, sf):
    event = R.flag((F.col("functional_state") == 0) & (F.col("destination_state") == 2))
    checks = S.observed(spark, sf).agg(
        F.count(F.lit(1)).alias("intervals"), F.countDistinct("id").alias("people"), F.sum(event).alias("events")
    )
    return summaries.gate(
        checks, {"enough_people": F.col("people") >= 500, "enough_events": F.col("events") >= 200}
    )


@query(
    "markov_sufficient_stats",
    f"""WITH {S.SQL_INTERVALS} SELECT state, functional_state, destination_state, interval_years, round(CAST(sum(n_orders) AS DOUBLE), 6) AS weight
    FROM obs WHERE state IN (2, 3) GROUP BY 1, 2, 3, 4""",
)
def markov_sufficient_stats(spark, sf):
    rows = S.observed(spark, sf).filter("state in (2, 3)").withColumn("w", F.col("n_orders").cast("double"))
    return rounded(
        summaries.transition_totals(
            rows, "functional_state", "destination_state", "interval_years", "w", ["state"]
        )
    )


@query(
    "markov_person_time",
    f"""WITH {S.SQL_INTERVALS}, x AS (SELECT * FROM obs WHERE state IN (2, 3)),
    pt AS (SELECT state, functional_state, CAST(sum(n_orders * interval_years) AS DOUBLE) AS person_time FROM x GROUP BY 1, 2),
    d AS (SELECT unnest([0, 1, 2, 3]) AS destination_state),
    ev AS (SELECT state, functional_state, destination_state, CAST(sum(n_orders) AS DOUBLE) AS events FROM x GROUP BY 1, 2, 3)
    SELECT pt.state, pt.functional_state, d.destination_state, coalesce(ev.events, 0.0) AS events, pt.person_time,
      round(greatest(coalesce(ev.events, 0.0) / greatest(pt.person_time, 1), 0.002), 6) AS initial_rate
    FROM pt CROSS JOIN d LEFT JOIN ev ON ev.state = pt.state AND ev.functional_state = pt.functional_state AND ev.destination_state = d.destination_state
    WHERE pt.functional_state <> d.destination_state""",
)
def markov_person_time(spark, sf):
    rows = S.observed(spark, sf).filter("state in (2, 3)").withColumn("w", F.col("n_orders").cast("double"))
    return rounded(
        summaries.person_time_rates(
            rows, "functional_state", "destination_state", "interval_years", "w", 3, groups=["state"]
        )
    )


SQL_EVENTS = """ev AS (
  SELECT user_id AS id, CAST(floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 432000) AS INTEGER) + 1 AS wave,
    CAST(max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS INTEGER) AS a, CAST(max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS INTEGER) AS b, count(*) AS n
  FROM events GROUP BY 1, 2), panel AS (SELECT *, a + 2 * b AS state FROM ev)"""


@query(
    "event_wave_transitions",
    f"""WITH {SQL_EVENTS} SELECT from_state, to_state, n, round(100.0 * n / sum(n) OVER (PARTITION BY from_state), 6) AS row_percent
    FROM (SELECT p.state AS from_state, q.state AS to_state, count(*) AS n FROM panel p JOIN panel q ON q.id = p.id AND q.wave = p.wave + 1 GROUP BY 1, 2)""",
)
def event_wave_transitions(spark, sf):
    events = S.table(spark, sf, "events", "user_id", "ts", "event_type")
    start = F.unix_timestamp(F.lit("2024-01-01").cast("timestamp"))
    wave = (F.floor((F.unix_timestamp(F.col("ts").cast("timestamp")) - start) / 432000) + 1).cast("int")
    waves = events.groupBy(F.col("user_id").alias("id"), wave.alias("wave")).agg(
        F.max(R.flag(F.col("event_type") == "error")).alias("a"),
        F.max(R.flag(F.col("event_type") == "purchase")).alias("b"),
        F.lit(1).alias("seen"),
    )
    waves = waves.withColumn("state", R.two_flag_state("a", "b"))
    pairs = I.state_pairs(waves, "id", "wave", "state", "seen")
    return rounded(
        summaries.counts_with_share(pairs, ["from_state", "to_state"], ["from_state"], "row_percent", 100.0)
    )
