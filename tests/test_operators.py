"""Panel, join, sequence and summary operators on hand-made rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.bounded import TooManyRows, collect_bounded, join_parameters
from panelwright.operators import joins, reshape, sequences, summaries
from panelwright.operators.intervals import origin_destination, state_pairs
from panelwright.operators.quantiles import exact_quantiles
from panelwright.sources import tables


@pytest.fixture
def gapped(spark):
    """Four people over five waves; the first one misses wave 3."""
    rows = [("p", w, s) for w, s in ((1, 0), (2, 2), (4, 3), (5, 3))]
    rows += [("q", w, s) for w, s in ((1, 2), (2, 3), (3, 2), (4, 3), (5, 0))]
    rows += [("r", w, s) for w, s in ((1, 3), (2, 3))]
    rows += [("s", 2, None), ("s", 3, 2)]
    return spark.createDataFrame(rows, "id string, wave int, state int")


def rows_of(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_pairs_do_not_bridge_gaps(gapped):
    pairs = state_pairs(gapped.withColumn("seen", F.lit(1)), "id", "wave", "state", "seen")
    found = rows_of(pairs.filter("id = 'p'"), "wave")
    assert found == [("p", 1, 0, 2), ("p", 4, 3, 3)]


def test_origin_destination_censors_and_absorbs(spark):
    panel = spark.createDataFrame(
        [("a", 1, 0, False), ("a", 2, 1, True), ("b", 1, 2, False), ("b", 3, 2, True)],
        "id string, wave int, f int, last boolean",
    )
    out = origin_destination(panel, "id", "wave", "f", dead=F.col("last"))
    found = rows_of(out.select("id", "wave", "destination_state", "outcome_observed"), "id", "wave")
    assert found == [("a", 1, 1, 1), ("a", 2, 3, 1), ("b", 1, None, 0), ("b", 3, 3, 1)]


def test_history(gapped):
    history = sequences.exposure_history(gapped, "id", "wave", "state", [2, 3, 4])
    found = {(r["id"], r["wave"]): tuple(r)[2:] for r in history.collect()}
    names = sequences.HISTORY_GROUPS
    assert found["p", 2] == (1, 0, 0, names["single_never"])
    assert found["p", 4] == (0, None, None, names["incomplete"])
    assert found["q", 2] == (1, 0, 1, names["first"])
    assert found["q", 3] == (1, 1, 1, names["single_after"])
    assert found["q", 4] == (1, 1, 2, names["repeated"])
    assert found["s", 2] == (0, None, None, names["incomplete"])


def test_onset_order(spark):
    rows = [("same", 1, 0, 0), ("same", 2, 1, 1)]
    rows += [("first", 1, 1, 0), ("first", 2, None, 1), ("first", 3, 1, 1)]
    rows += [("early", 1, 1, 1), ("never", 1, 1, 0)]
    panel = spark.createDataFrame(rows, "id string, wave int, a int, b int")
    found = rows_of(sequences.onset_order(panel, "id", "wave", "a", "b", ("A", "B", "tie")), "id")
    assert found == [("first", 3, "A"), ("same", 2, "tie")]


def test_first_event_stops_follow_up(spark):
    rows = [("x", 2, 0, 0), ("x", 3, 0, 1), ("x", 4, 0, 2), ("y", 2, 0, 0), ("y", 3, 1, 0), ("y", 4, 0, 0), ("z", 2, 1, 0)]
    table = spark.createDataFrame(rows, "id string, wave int, o int, d int")
    kept = sequences.first_event_followup(table, "id", "wave", "o", "d", 2, [1, 2, 3])
    assert rows_of(kept.select("id", "wave"), "id", "wave") == [("x", 2), ("x", 3), ("y", 2)]


def test_incident_risk_set_has_one_event(spark):
    rows = [("x", w, e) for w, e in ((1, 0), (2, 1), (3, 0), (4, 1))]
    table = spark.createDataFrame(rows, "id string, wave int, e int")
    kept = sequences.incident_risk_set(table, "id", "wave", F.col("wave") != 1, F.col("e") == 1)
    assert rows_of(kept.select("wave", "e"), "wave") == [(2, 1)]


def test_checked_join_rejects_repeated_keys(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    right = spark.createDataFrame([(1, 10), (2, 20)], "k int, w int")
    assert joins.checked_join(left, right, ["k"]).count() == 3
    with pytest.raises(Exception, match="not unique"):
        joins.checked_join(right, left, ["k"]).collect()
    with pytest.raises(Exception, match="not unique"):
        joins.checked_join(left, right, ["k"], validate="one_to_one").collect()
    with pytest.raises(ValueError):
        joins.checked_join(left, right, ["k"], validate="any")


@pytest.mark.parametrize("how", ["left", "inner"])
def test_hot_keys_joined_apart_give_the_same_rows(spark, how):
    left = spark.range(1000).select(F.when(F.col("id") < 600, 7).otherwise(F.col("id") % 50).alias("k"), "id")
    left = left.unionByName(spark.createDataFrame([(None, 5000)], "k bigint, id bigint"))
    right = spark.range(0, 40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    plain = joins.checked_join(left, right, ["k"], how)
    apart = joins.checked_join(left, right, ["k"], how, hot_rows=100)
    assert rows_of(apart.select("id", "k", "v"), "id") == rows_of(plain.select("id", "k", "v"), "id")
    with pytest.raises(Exception, match="not unique"):
        joins.checked_join(left, right.unionByName(right), ["k"], how, hot_rows=100).collect()


def test_pivot_rejects_repeated_keys(spark):
    long = spark.createDataFrame([(1, 2011, 3.0), (1, 2011, 4.0)], "id int, year int, v double")
    with pytest.raises(Exception, match="not unique"):
        reshape.long_to_wide(long, "id", "year", [2011], "v", str).collect()


def test_other_joins(spark):
    left = spark.createDataFrame([(1, None), (2, 5.0)], "k int, w double")
    right = spark.createDataFrame([(1, 7.0), (2, 8.0)], "k int, w double")
    assert rows_of(joins.coalescing_join(left, right, ["k"], "w"), "k") == [(1, 7.0), (2, 5.0)]
    assert rows_of(joins.replace_columns(left, right, "k"), "k") == [(1, 7.0), (2, 8.0)]
    counts = spark.createDataFrame([(2, 3)], "k int, times int")
    weighted = joins.weighted_by_multiplicity(left, counts, "k", "w", "times")
    assert rows_of(weighted.select("k", "w"), "k") == [(2, 15.0)]


def test_empty_level_is_kept(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 0)], "g string, e int")
    out = summaries.counts_all_levels(rows, "g", ["b", "a"], {"n": F.count(F.lit(1)), "e": F.sum("e")})
    assert rows_of(out, "level_order") == [(0, "b", 0, 0), (1, "a", 2, 1)]


def test_mode_tie_and_median_fill(spark):
    rows = spark.createDataFrame([(1, 1.0), (0, 2.0), (1, 4.0), (0, 10.0), (None, None)], "m int, v double")
    assert summaries.modal_values(rows, ["m"]) == {"m": 0.0}
    filled = summaries.fill_missing(rows, mode=["m"], median={"v": "v_filled"}).filter("v_missing = 1")
    row = filled.first()
    assert (row["m"], row["v_filled"]) == (0.0, 3.0)


def test_quantiles_match_linear_rule(spark):
    rows = spark.createDataFrame([(v,) for v in (1.0, 2.0, 4.0, 10.0)], "v double")
    assert np.allclose(exact_quantiles(rows, "v", [0.01, 0.5, 0.99])[()], [1.03, 3.0, 9.82])
    empty = rows.filter("v > 99")
    assert exact_quantiles(empty, "v", [0.5])[()] == [None]


@pytest.mark.parametrize("shape", ["normal", "ties", "heavy"])
def test_searched_quantiles_are_exact(spark, shape):
    """The way for groups too large for one buffer gives the same numbers."""
    noise = np.random.default_rng(3)
    values = {
        "normal": noise.normal(size=30_001),
        "ties": noise.integers(0, 5, size=30_000).astype(float),
        "heavy": np.exp(noise.normal(scale=8, size=20_000)),
    }[shape]
    group = np.arange(len(values)) % 3 // 2
    rows = spark.createDataFrame(list(zip(map(int, group), map(float, values))), "g int, v double")
    probs = [0.0, 0.01, 0.37, 0.5, 0.99, 1.0]
    for bound in (0, 12_000):  # every group searched; the smaller one by percentile
        found = exact_quantiles(rows, "v", probs, by=["g"], small_group=bound)
        for g in (0, 1):
            assert np.allclose(found[(g,)], np.quantile(values[group == g], probs), rtol=1e-12, atol=0)
    whole = exact_quantiles(rows, "v", probs, small_group=0)[()]
    assert np.allclose(whole, np.quantile(values, probs), rtol=1e-12, atol=0)


def test_standardising(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "g string, v double")
    scaled = sequences.standardise_within(rows, ["g"], {"v": "z"})
    assert rows_of(scaled.select("g", "z"), "g", "z")[2] == ("b", None)
    fixed = sequences.standardise_to_reference(rows, "g", "v", {"v": "z"}, F.col("v") < 4)
    assert rows_of(fixed.select("g", "z"), "g", "z") == [("a", -1.0), ("a", 1.0), ("b", None)]


def test_parameters_join_with_and_without_broadcast(spark):
    rows = spark.createDataFrame([(1, 2.0), (2, 3.0)], "g int, v double")
    params = rows.groupBy("g").agg(F.sum("v").alias("t"))
    for bound in (10, 1):
        joined = join_parameters(rows, params, ["g"], max_rows=bound)
        assert rows_of(joined.select("g", "t"), "g") == [(1, 2.0), (2, 3.0)]


def test_bounded_collection(spark):
    assert len(collect_bounded(spark.range(3), 3)) == 3
    with pytest.raises(TooManyRows):
        collect_bounded(spark.range(4), 3)


def test_gate_and_person_time(spark):
    checks = spark.createDataFrame([(10, None)], "n int, e int")
    row = summaries.gate(checks, {"big": F.col("n") > 5, "known": F.col("e") > 1}).first()
    assert (row["big"], row["known"], row["decision"]) == (True, False, "STOP")
    moves = spark.createDataFrame([(0, 1, 1, 2.0), (0, 0, 2, 3.0)], "o int, d int, t int, w double")
    rates = summaries.person_time_rates(moves, "o", "d", "t", "w", 1)
    assert rows_of(rates.select("d", "events", "person_time", "initial_rate"), "d") == [(1, 2.0, 8.0, 0.25)]


def test_formatted_baseline(spark):
    rows = spark.createDataFrame([("p", 1, 0, 2.0, 1), ("q", 1, 0, 4.0, 0)], "id string, wave int, g int, x double, b int")
    table = summaries.formatted(summaries.baseline_table(rows, "id", "wave", "g", ["x"], ["b"], {}))
    found = {r["characteristic"]: r["value"] for r in table.collect()}
    assert found == {"Participants": "2", "x": "3.00 (1.41)", "b": "1 (50.0%)"}


def test_sources(spark, tmp_path):
    assert tables.wave_columns(["bmi", "age"], [1, 4], absent=["r4bmi"]) == ["r1bmi", "r1age", "r4age"]
    rows = spark.createDataFrame([("007", 1.5)], "id string, v double")
    path = tables.write_table(rows, str(tmp_path / "t"), "csv")
    assert tables.read_delimited(spark, path, "id string, v double").collect() == rows.collect()
    assert tables.stored(rows, "t").collect() == rows.collect()
    doc = tables.write_audit(rows, str(tmp_path / "audit"))
    assert spark.read.text(doc).first()[0] == '{"id":"007","v":1.5}'


def test_scan_reads_only_what_is_used(spark):
    from panelwright.plans import standin

    orders = standin.table(spark, "/root/testdata/sf0.001", "orders", "o_custkey", "o_orderstatus")
    plan = orders.filter("o_orderstatus = 'F'")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_custkey:bigint,o_orderstatus:string>" in plan
    assert "EqualTo(o_orderstatus,F)" in plan


def test_checked_join_keeps_rows_without_a_key(spark):
    from panelwright.operators.joins import checked_join

    left = spark.createDataFrame([(1, "a"), (None, "b"), (None, "c")], "k int, x string")
    right = spark.createDataFrame([(1, "p"), (None, "q"), (None, "r")], "k int, y string")
    assert checked_join(left, right, ["k"], "left", "one_to_one").count() == 3
    assert checked_join(left, right, ["k"], "outer", "many_to_one").count() == 5
    twice = right.unionByName(right.filter("k = 1"))
    with pytest.raises(Exception, match="not unique"):
        checked_join(left, twice, ["k"], "left", "many_to_one").collect()


def test_quantile_table_of_many_groups(spark):
    from panelwright.operators.quantiles import quantile_table

    rows = spark.range(60_000).select(
        F.when(F.col("id") < 20_000, F.lit(None)).otherwise(F.col("id") % 20_000).alias("g"), F.col("id").cast("double").alias("v")
    )
    plain = quantile_table(rows, "v", [0.25, 0.5], ["g"])
    apart = quantile_table(rows, "v", [0.25, 0.5], ["g"], small_group=1000)  # the rows without a group are searched for
    assert apart.count() == 20_001
    assert rows_of(apart, "g") == rows_of(plain, "g")
    assert rows_of(plain, "g")[:2] == [(None, 4999.75, 9999.5), (0, 25000.0, 30000.0)]


def test_quantiles_with_infinite_values(spark):
    import math

    from panelwright.operators.quantiles import exact_quantiles

    values = [float(i) for i in range(2000)] + [math.inf, math.inf, -math.inf, 1e300, math.nan]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for probs in ([0.0, 0.25, 0.5, 0.9],):
        ordered = sorted(v for v in values if v == v) + [math.nan]
        expected = []
        for p in probs:
            h = p * (len(ordered) - 1)
            low, high = ordered[math.floor(h)], ordered[math.ceil(h)]
            expected.append(low + (high - low) * (h - math.floor(h)) if low != high and h % 1 else low)
        assert exact_quantiles(df, "v", probs, small_group=10)[()] == pytest.approx(expected)


def test_repeated_person_wave_is_an_error(spark):
    from panelwright.operators.sequences import add_next_wave

    rows = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (1, 2, 7)], "id int, wave int, v int")
    with pytest.raises(Exception, match="is not unique"):
        add_next_wave(rows, "id", "wave", {"next_v": F.col("v")}).collect()


def test_buckets_spare_the_exchange(spark):
    from panelwright.sources.tables import bucket_count, bucketed

    left = bucketed(spark.range(300).selectExpr("id % 40 as k", "id as v"), "left_side", ["k"], 5)
    right = bucketed(spark.range(40).selectExpr("id as k", "id * 2 as w"), "right_side", ["k"], 5)
    joined = left.hint("merge").join(right, "k").groupBy("k").agg(F.sum("w").alias("w"))
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert {r["k"]: r["w"] for r in joined.collect()} == {k: 2 * k * sum(i % 40 == k for i in range(300)) for k in range(40)}
    assert bucket_count(10, 3, spark) >= 4


def test_sketched_quantiles_narrow_and_recover(spark, monkeypatch):
    """Brackets that are sketched again, and brackets that miss, still end in the exact values."""
    from panelwright.operators import quantiles

    noise = np.random.default_rng(8)
    values = np.concatenate([np.exp(noise.normal(scale=4, size=40_000)), np.zeros(5_000), -np.zeros(10)])
    rows = spark.createDataFrame([(i % 2 if i % 7 else None, float(v)) for i, v in enumerate(values)], "g int, v double").repartition(5)
    probs = [0.0, 0.013, 0.5, 0.77, 1.0]

    def check():
        found = exact_quantiles(rows, "v", probs, by=["g"], small_group=100)
        for g in (0, 1, None):
            own = [v for i, v in enumerate(values) if (i % 2 if i % 7 else None) == g]
            assert np.allclose(found[(g,)], np.quantile(own, probs), rtol=1e-12, atol=0)

    monkeypatch.setattr(quantiles, "SKETCH", 64)
    monkeypatch.setattr(quantiles, "REACH", 0.08)
    monkeypatch.setattr(quantiles, "MOST_INSIDE", 200)
    check()  # several rounds of narrowing
    monkeypatch.setattr(quantiles, "REACH", 0.0005)
    monkeypatch.setattr(quantiles, "SKETCH", 8)
    check()  # brackets far narrower than the sketch's error miss and are widened


def test_quantiles_of_twenty_thousand_large_groups(spark):
    from panelwright.operators.quantiles import quantile_table

    rows = spark.range(400_000).select((F.col("id") % 20_000).alias("g"), (F.xxhash64("id") % 1000).cast("double").alias("v"))
    plain, apart = (quantile_table(rows, "v", [0.1, 0.5], ["g"], small_group=n) for n in (100, 0))
    assert apart.count() == 20_000 and not apart.exceptAll(plain).count()


def test_quantiles_of_nan_and_empty_groups(spark):
    rows = spark.createDataFrame([(1, float("nan")), (1, float("nan")), (2, None), (3, 1.0), (3, float("nan"))], "g int, v double")
    found = exact_quantiles(rows, "v", [0.0, 1.0], by=["g"], small_group=0)
    assert set(found) == {(1,), (3,)} and np.isnan(found[(1,)]).all() and found[(3,)][0] == 1.0 and np.isnan(found[(3,)][1])


def test_rewriting_a_partition_prunes_and_keeps_the_rest(spark, tmp_path):
    from panelwright.sources import tables

    path = tables.write_table(spark.range(40).selectExpr("id", "cast(id % 4 as int) as wave"), str(tmp_path / "t"), partition_by=["wave"])
    tables.replace_partitions(spark.createDataFrame([(100, 2)], "id long, wave int"), path, ["wave"])
    read = tables.read_table(spark, path)
    assert read.count() == 31 and [r["id"] for r in read.filter("wave = 2").collect()] == [100]
    plan = read.filter("wave = 2").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(wave" in plan and "DataFilters: []" in plan


def test_nested_documents_keep_key_order(spark):
    from panelwright.sources import tables

    rows = spark.createDataFrame([(1, k, k * 2) for k in (10, 9, 2)] + [(1, None, 5)], "g int, k int, n int")
    found = tables.audit_document(tables.grouped_map(rows, ["g"], "k", F.struct("n"), "m").select("m")).first()[0]
    assert found == '{"m":{"2":{"n":4},"9":{"n":18},"10":{"n":20}}}'
