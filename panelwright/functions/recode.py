"""Row-wise recodes. A missing value is NULL throughout and no function returns NaN.

Comparisons with NULL are NULL in Spark, so everything that must answer "no" for a
missing value goes through :func:`flag`.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def as_col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def holds(condition: Column) -> Column:
    """The condition, with NULL read as false."""
    return F.coalesce(condition, F.lit(False))


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it fails or cannot be decided."""
    return holds(condition).cast("int")


def indicator(condition: Column) -> Column:
    """1 / 0 / NULL: keeps an undecidable condition missing."""
    return condition.cast("double")


def nan_to_null(c: ColumnLike) -> Column:
    return F.nanvl(as_col(c).cast("double"), F.lit(None).cast("double"))


def strict_binary(c: ColumnLike) -> Column:
    c = as_col(c)
    return F.when(c.isin(0, 1), c.cast("double"))


def in_range(c: ColumnLike, low: float, high: float, open_low: bool = False) -> Column:
    c = as_col(c)
    above = c > low if open_low else c >= low
    return F.when(above & (c <= high), c)


def lenient_number(c: ColumnLike) -> Column:
    """Numeric value of any text; NULL for what is not a number."""
    return nan_to_null(as_col(c).cast("string").try_cast("double"))


def clip(c: ColumnLike, low: float | None = None, high: float | None = None) -> Column:
    """Bound a value; NULL stays NULL (greatest and least alone would return the bound)."""
    c = as_col(c)
    bounded = c
    if low is not None:
        bounded = F.greatest(bounded, F.lit(low))
    if high is not None:
        bounded = F.least(bounded, F.lit(high))
    return F.when(c.isNotNull(), bounded)


def decimal_year(year: ColumnLike, month: ColumnLike, fallback: float | Column) -> Column:
    """Year plus the middle of the month; July for an unknown month."""
    month = F.coalesce(clip(lenient_number(month), 1.0, 12.0), F.lit(7.0))
    fallback = fallback if isinstance(fallback, Column) else F.lit(float(fallback))
    return F.coalesce(lenient_number(year) + (month - 0.5) / 12, fallback)


def count_equal(columns: Sequence[ColumnLike], value=1) -> Column:
    """How many columns equal the value; a missing one does not count."""
    return reduce(add, [flag(as_col(c) == value) for c in columns])


def all_valid(columns: Sequence[ColumnLike], codes: Sequence) -> Column:
    return reduce(and_, [holds(as_col(c).isin(*codes)) for c in columns])


def all_present(columns: Sequence[ColumnLike]) -> Column:
    return reduce(and_, [as_col(c).isNotNull() for c in columns])


def any_missing(columns: Sequence[ColumnLike]) -> Column:
    return flag(~all_present(columns))


def count_if_complete(
    columns: Sequence[ColumnLike], test: Callable[[Column], Column], complete: Column
) -> Column:
    """How many columns pass the test; NULL unless every item is valid."""
    return F.when(complete, reduce(add, [flag(test(as_col(c))) for c in columns]))


def any_if_complete(
    columns: Sequence[ColumnLike], test: Callable[[Column], Column], complete: Column
) -> Column:
    return F.when(complete, reduce(or_, [holds(test(as_col(c))) for c in columns]).cast("int"))


def scale_score(
    items: Sequence[str], codes: Sequence[int], reverse: Sequence[str] = ()
) -> Column:
    """Sum of items counted from zero, with reverse-keyed ones mirrored; NULL unless all are valid."""
    low, span = min(codes), max(codes) - min(codes)
    parts = [F.lit(span) - (F.col(i) - low) if i in reverse else F.col(i) - low for i in items]
    return F.when(all_valid(items, codes), reduce(add, parts))


def at_least(c: ColumnLike, threshold: float) -> Column:
    return (as_col(c) >= threshold).cast("int")


def prioritised(rules: Sequence[tuple[Column, object]]) -> Column:
    """Value of the last rule that holds; NULL when none does."""
    (condition, value), *earlier = list(reversed(rules))
    out = F.when(condition, F.lit(value))
    for condition, value in earlier:
        out = out.when(condition, F.lit(value))
    return out


def two_flag_state(first: ColumnLike, second: ColumnLike) -> Column:
    """0 neither, 1 first only, 2 second only, 3 both; NULL if either is missing."""
    first, second = as_col(first), as_col(second)
    return (first.cast("int") + 2 * second.cast("int")).cast("int")


def ordered_level(
    severe: ColumnLike, moderate: ColumnLike, present: Column, threshold: int = 1
) -> Column:
    """2 when the severe count reaches the threshold, else 1 when the moderate one does, else 0."""
    severe, moderate = as_col(severe), as_col(moderate)
    known = present & severe.isNotNull() & moderate.isNotNull()
    level = F.when(severe >= threshold, 2).when(moderate >= threshold, 1).otherwise(0)
    return F.when(holds(known), level)


def label_of(c: ColumnLike, labels: Mapping) -> Column:
    pairs = [F.lit(x) for item in labels.items() for x in item]
    return F.create_map(*pairs)[as_col(c)]


def banded(c: ColumnLike, low: float, high: float) -> Column:
    """0 below low, 1 in [low, high], 2 above, 3 when missing."""
    c = as_col(c)
    return F.when(c < low, 0).when(c <= high, 1).when(c > high, 2).otherwise(3)


def centred(c: ColumnLike, at: float) -> Column:
    return as_col(c) - at


def as_category(c: ColumnLike, missing: int = -1) -> Column:
    """Category text of a code, with its own level for a missing one."""
    return F.coalesce(as_col(c).cast("string"), F.lit(str(missing)))


def rounded_category(c: ColumnLike) -> Column:
    return F.bround(as_col(c), 0).cast("int").cast("string")


def best_reading(readings: Sequence[Column], min_valid: int = 2) -> Column:
    """Largest of repeated readings, given enough valid ones."""
    valid = reduce(add, [r.isNotNull().cast("int") for r in readings])
    return F.when(valid >= min_valid, F.greatest(*readings))


def valid_readings(readings: Sequence[Column]) -> Column:
    return reduce(add, [r.isNotNull().cast("int") for r in readings])


def linear_slope(columns: Sequence[ColumnLike], times: Sequence[float]) -> Column:
    """Least-squares slope of one row's values on fixed times."""
    centre = sum(times) / len(times)
    spread = sum((t - centre) ** 2 for t in times)
    return reduce(add, [as_col(c) * ((t - centre) / spread) for c, t in zip(columns, times)])


def event_in(destination: ColumnLike, codes: Sequence) -> Column:
    return flag(as_col(destination).isin(*codes))


def incident_only(origin: ColumnLike, outcome: ColumnLike) -> Column:
    """The outcome among those free of it at the origin."""
    return F.when(as_col(origin) == 0, as_col(outcome))


def count_without(total: ColumnLike, own: ColumnLike) -> Column:
    """A total less the row's own contribution, not below zero."""
    return clip(as_col(total) - as_col(own), low=0)


def interval_label(start: ColumnLike, end: ColumnLike) -> Column:
    return F.concat_ws("-", as_col(start).cast("string"), as_col(end).cast("string"))
