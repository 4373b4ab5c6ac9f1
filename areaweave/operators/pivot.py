"""Long tables to wide ones, and sums by group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_values(df: DataFrame, key: str, measure: str, value: str, names: dict[str, str], order: str) -> DataFrame:
    """One row for each key with the first non-null value (by ``order``) of each measure; other measures are dropped.

    The measures are known beforehand: one aggregation, no job to find them and a schema that does not change.
    """
    picked = [F.min_by(F.when((F.col(measure) == m) & F.col(value).isNotNull(), F.col(value)), F.when((F.col(measure) == m) & F.col(value).isNotNull(), F.col(order))).alias(n) for m, n in names.items()]
    return df.groupBy(key).agg(*picked)


def unknown_measures(df: DataFrame, measure: str, names: dict[str, str]) -> DataFrame:
    """The measures that a pivot leaves out."""
    return df.select(measure).distinct().where(~F.col(measure).isin(*names))


def group_sums(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Whole-number sums by key; a group without any value has 0."""
    return df.groupBy(key).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in columns])


def rightmost(df: DataFrame, key: str, year: str, value: str) -> DataFrame:
    """The value of the last year that each key has."""
    return df.groupBy(key).agg(F.max_by(value, year).alias(value), F.max(year).alias(year))


def history(df: DataFrame, key: str, prefix: str, years: list[int]) -> DataFrame:
    """Columns ``<prefix><year>`` as rows ``key, year, value``."""
    pairs = ", ".join(f"{y}, `{prefix}{y}`" for y in years)
    return df.select(key, F.expr(f"stack({len(years)}, {pairs}) as (year, value)"))
