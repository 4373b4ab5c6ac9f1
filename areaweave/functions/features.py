"""Declarative ratio features, compiled to Columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Literal

from pydantic import BaseModel, ConfigDict, model_validator
from pyspark.sql import Column
from pyspark.sql import functions as F


class _Strict(BaseModel):
    model_config = ConfigDict(extra="forbid", frozen=True)


class Expression(_Strict):
    """One field, a sum of fields, or a weighted sum."""

    expression: Literal["field", "sum", "weighted_sum"] = "field"
    fields: list[str]
    weights: list[float] | None = None

    @model_validator(mode="after")
    def _shape(self):
        if self.expression == "field" and len(self.fields) != 1:
            raise ValueError("a field expression takes exactly one field")
        if not self.fields:
            raise ValueError("an expression needs fields")
        if (self.expression == "weighted_sum") != (self.weights is not None) or (self.weights is not None and len(self.weights) != len(self.fields)):
            raise ValueError("weighted_sum takes one weight for each field, other expressions none")
        return self


class Feature(_Strict):
    """A feature: numerator over denominator, with rules for zero and for values out of bounds."""

    id: str
    label: str = ""
    output_kind: Literal["percentage", "ratio", "rate", "scalar", "index"] = "ratio"
    numerator: Expression
    denominator: Expression | None = None
    scale: float = 1.0
    bounds: tuple[float | None, float | None] | None = None
    zero_denominator: Literal["null", "zero", "error"] = "null"
    out_of_bounds: Literal["clip", "warn", "error"] = "warn"

    def source_fields(self) -> list[str]:
        """The distinct fields that the feature needs, in order."""
        return list(dict.fromkeys(self.numerator.fields + (self.denominator.fields if self.denominator else [])))


def value_of(e: Expression, column: Callable[[str], Column]) -> Column:
    """An expression over doubles; a null anywhere makes it null."""
    terms = [column(f).cast("double") * F.lit(float(w)) for f, w in zip(e.fields, e.weights or [1.0] * len(e.fields))] if e.weights else [column(f).cast("double") for f in e.fields]
    return reduce(lambda a, b: a + b, terms)


def out_of_bounds(x: Column, f: Feature) -> Column:
    """Whether a value lies outside the bounds; nulls do not."""
    low, high = f.bounds or (None, None)
    low_bad = x < F.lit(float(low)) if low is not None else F.lit(False)
    high_bad = x > F.lit(float(high)) if high is not None else F.lit(False)
    return F.coalesce(low_bad | high_bad, F.lit(False))


def compiled(f: Feature, column: Callable[[str], Column]) -> Column:
    """A feature as one Column. Rules of ``error`` raise while the query runs; ``warn`` leaves values as they are."""
    num = value_of(f.numerator, column)
    if f.denominator is not None:
        den = value_of(f.denominator, column)
        usable = den.isNotNull() & (den != 0)
        x = F.when(usable, F.try_divide(num, den))
        if f.zero_denominator == "zero":
            x = x.otherwise(F.lit(0.0))
        elif f.zero_denominator == "error":
            x = x.otherwise(F.raise_error(F.lit(f"feature {f.id}: denominator is zero or missing")).cast("double"))
    else:
        x = num
    if f.output_kind == "percentage":
        x = x * 100.0
    if f.scale != 1.0:
        x = x * F.lit(f.scale)
    if f.bounds and f.out_of_bounds == "clip":
        low, high = f.bounds
        y = x
        if low is not None:
            y = F.when(x < F.lit(float(low)), F.lit(float(low))).otherwise(y)
        if high is not None:
            y = F.when(x > F.lit(float(high)), F.lit(float(high))).otherwise(y)
        return y
    if f.bounds and f.out_of_bounds == "error":
        return F.when(out_of_bounds(x, f), F.raise_error(F.lit(f"feature {f.id}: value out of bounds")).cast("double")).otherwise(x)
    return x
