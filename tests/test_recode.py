"""Row-wise recodes on NULL, NaN and edge values."""

import math

from pyspark.sql import functions as F

from panelwright.functions import recode as R
from panelwright.operators.intervals import destination_state, vital_outcome


def one(spark, column, **values):
    """The value of a column over one row."""
    types = {int: "int", float: "double", str: "string", type(None): "int"}
    schema = ", ".join(f"{n} {types[type(v)]}" for n, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


def test_flags_read_missing_as_no(spark):
    assert one(spark, R.flag(F.col("x") == 1), x=None) == 0
    assert one(spark, R.event_in("x", [1, 2]), x=None) == 0
    assert one(spark, ~R.holds(F.col("x") == 1), x=None) is True


def test_strict_binary_and_ranges(spark):
    rows = spark.createDataFrame([(0,), (1,), (2,), (None,)], "x int")
    assert [r[0] for r in rows.select(R.strict_binary("x")).collect()] == [0.0, 1.0, None, None]
    assert one(spark, R.in_range("x", 0, 90), x=0.0) == 0.0
    assert one(spark, R.in_range("x", 0, 90, open_low=True), x=0.0) is None


def test_clip_keeps_missing(spark):
    assert one(spark, R.clip("x", 1, 3), x=None) is None
    assert one(spark, R.clip("x", 1, 3), x=9) == 3


def test_nan_becomes_missing(spark):
    assert one(spark, R.nan_to_null("x"), x=math.nan) is None
    assert one(spark, R.lenient_number("x"), x="n/a") is None
    assert one(spark, R.lenient_number("x"), x="4.5") == 4.5


def test_decimal_year(spark):
    assert one(spark, R.decimal_year("y", "m", 2000.5), y=2011, m=None) == 2011 + 6.5 / 12
    assert one(spark, R.decimal_year("y", "m", 2000.5), y=2011, m=99) == 2011 + 11.5 / 12
    assert one(spark, R.decimal_year("y", "m", 2000.5), y=None, m=3) == 2000.5


def test_counts_and_scores_need_every_item(spark):
    complete = R.all_valid(["a", "b"], [1, 2, 3, 4])
    assert one(spark, R.count_equal(["a", "b"]), a=1, b=None) == 1
    assert one(spark, R.count_if_complete(["a", "b"], lambda c: c > 1, complete), a=1, b=None) is None
    assert one(spark, R.any_if_complete(["a", "b"], lambda c: c > 1, complete), a=1, b=4) == 1
    assert one(spark, R.scale_score(["a", "b"], [1, 2, 3, 4], reverse=["b"]), a=4, b=1) == 6


def test_last_rule_wins(spark):
    rules = [(F.col("a") == 1, 1.0), (F.col("b") == 1, 0.0)]
    assert one(spark, R.prioritised(rules), a=1, b=1) == 0.0
    assert one(spark, R.prioritised(rules), a=1, b=None) == 1.0
    assert one(spark, R.prioritised(rules), a=None, b=None) is None


def test_states(spark):
    assert one(spark, R.two_flag_state("a", "b"), a=1, b=1) == 3
    assert one(spark, R.two_flag_state("a", "b"), a=1, b=None) is None
    assert one(spark, R.ordered_level("a", "b", F.lit(True)), a=0, b=2) == 1
    assert one(spark, R.ordered_level("a", "b", F.lit(True), 2), a=1, b=1) == 0
    assert one(spark, R.ordered_level("a", "b", F.lit(False)), a=1, b=1) is None


def test_bands_and_categories(spark):
    found = [one(spark, R.banded("x", 6, 8), x=v) for v in (5.9, 6.0, 8.0, 8.1)]
    assert found == [0, 1, 1, 2]
    assert one(spark, R.banded("x", 6, 8), x=None) == 3
    assert one(spark, R.as_category("x"), x=None) == "-1"
    assert one(spark, R.rounded_category("x"), x=2.4) == "2"


def test_readings_and_slope(spark):
    readings = [R.in_range(c, 0, 90, open_low=True) for c in ("a", "b", "c")]
    assert one(spark, R.best_reading(readings), a=31.0, b=95.0, c=28.0) == 31.0
    assert one(spark, R.best_reading(readings), a=31.0, b=95.0, c=0.0) is None
    assert one(spark, R.linear_slope(["a", "b", "c"], [0, 2, 4]), a=1.0, b=9.0, c=5.0) == 1.0
    assert one(spark, R.count_without("a", "b"), a=0, b=1) == 0


def test_vital_codes_and_destination(spark):
    found = [one(spark, vital_outcome(F.col("x")), x=v) for v in (1, 4, 5, 9, None)]
    assert found == [0, 0, 1, None, None]
    rule = destination_state(F.col("dead") == 1, F.col("alive") == 1, F.col("s"), 3)
    assert one(spark, rule, dead=1, alive=0, s=0) == 3
    assert one(spark, rule, dead=0, alive=1, s=2) == 2
    assert one(spark, rule, dead=0, alive=0, s=2) is None
    assert one(spark, rule, dead=None, alive=None, s=2) is None
