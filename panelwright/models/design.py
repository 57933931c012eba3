"""Design columns from declared terms: numbers, categories against a reference, products."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..bounded import collect_bounded

MAX_LEVELS = 5_000


@dataclass(frozen=True)
class Num:
    """A number as it is. ``discrete`` says that it has few values, such as a 0/1 flag."""

    column: str
    discrete: bool = False

    @property
    def columns(self) -> tuple[str, ...]:
        return (self.column,)


@dataclass(frozen=True)
class Cat:
    """Indicators of a category's levels other than the reference (the smallest by default)."""

    column: str
    reference: object = None
    levels: tuple | None = None
    drop_reference: bool = True

    @property
    def columns(self) -> tuple[str, ...]:
        return (self.column,)


@dataclass(frozen=True)
class Product:
    """Products of the columns of two terms, without the terms themselves."""

    left: Num | Cat
    right: Num | Cat

    @property
    def columns(self) -> tuple[str, ...]:
        return self.left.columns + self.right.columns


Term = Num | Cat | Product


def crossed(left: Num | Cat, right: Num | Cat) -> tuple[Term, ...]:
    """Both terms and their product."""
    return (left, right, Product(left, right))


def categories(terms: Sequence[Term]) -> list[Cat]:
    out: list[Cat] = []
    for t in terms:
        parts = [t.left, t.right] if isinstance(t, Product) else [t]
        out += [p for p in parts if isinstance(p, Cat)]
    return out


def is_discrete(term: Term) -> bool:
    if isinstance(term, Product):
        return is_discrete(term.left) and is_discrete(term.right)
    return isinstance(term, Cat) or term.discrete


def find_levels(df: DataFrame, terms: Sequence[Term]) -> dict[str, list]:
    """Sorted levels of every category without declared ones, in one pass over the data."""
    declared = {c.column: list(c.levels) for c in categories(terms) if c.levels is not None}
    wanted = sorted({c.column for c in categories(terms)} - set(declared))
    if not wanted:
        return declared
    values = F.array(
        *[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in wanted]
    )
    distinct = df.select(F.explode(values).alias("e")).select("e.*").dropna().distinct()
    found: dict[str, list] = {c: [] for c in wanted}
    for row in collect_bounded(distinct, MAX_LEVELS, "category levels"):
        found[row["name"]].append(row["value"])
    for c in wanted:
        if isinstance(df.schema[c].dataType, NumericType):
            whole = df.schema[c].dataType.typeName() not in ("double", "float")
            found[c] = [int(float(v)) if whole else float(v) for v in found[c]]
        found[c].sort()
    return {**declared, **found}


def reference_of(cat: Cat, levels: Mapping[str, list]) -> object:
    return levels[cat.column][0] if cat.reference is None else cat.reference


def design_columns(
    terms: Sequence[Term], levels: Mapping[str, list], intercept: bool = True
) -> list[tuple[str, Column]]:
    """Named design columns; the level in a name is the term's value, as in ``state[3]``."""
    out = [("intercept", F.lit(1.0))] if intercept else []
    for t in terms:
        if isinstance(t, Product):
            left = design_columns([t.left], levels, intercept=False)
            right = design_columns([t.right], levels, intercept=False)
            out += [(f"{a}:{b}", x * y) for a, x in left for b, y in right]
        elif isinstance(t, Cat):
            skipped = reference_of(t, levels) if t.drop_reference else None
            out += [
                (f"{t.column}[{v}]", F.when(F.col(t.column) == F.lit(v), 1.0).otherwise(0.0))
                for v in levels[t.column]
                if not t.drop_reference or v != skipped
            ]
        else:
            out.append((t.column, F.col(t.column).cast("double")))
    return out


def declared_levels(terms: Sequence[Term]) -> dict[str, list]:
    """The values allowed by categories that declare their levels, the reference included."""
    out: dict[str, list] = {}
    for t in terms:
        if isinstance(t, Product):
            out.update(declared_levels([t.left, t.right]))
        elif isinstance(t, Cat) and t.levels is not None:
            out[t.column] = list(dict.fromkeys([*t.levels, *([] if t.reference is None else [t.reference])]))
    return out


def used_columns(terms: Sequence[Term]) -> list[str]:
    return sorted({c for t in terms for c in t.columns})
