"""Joining area-keyed tables to rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_id(df: DataFrame, name: str = "_row_id") -> DataFrame:
    """Number the rows as they are read. The number is for use within one plan; pass a key of your own to keep it."""
    return df.withColumn(name, F.monotonically_increasing_id())


def left_enrich(rows: DataFrame, lookup: DataFrame, row_key: str, lookup_key: str, columns: dict[str, str]) -> DataFrame:
    """Left-join ``columns`` (friendly name to lookup column) by key; unknown and null keys give nulls.

    Each friendly name is an alias of its own, so two names may show one column. The lookup is pruned to what is asked
    for; whether it is small enough to broadcast is left to its measured size.
    """
    missing = sorted(set(columns.values()) - set(lookup.columns))
    if missing:
        raise KeyError(f"no such columns: {missing}")
    slim = lookup.where(F.col(lookup_key).isNotNull()).select(F.col(lookup_key).alias("__key"), *[F.col(c).alias(n) for n, c in columns.items()])
    return rows.join(slim, F.col(row_key) == F.col("__key"), "left").drop("__key")


def outer_concat(tables: list[DataFrame], key: str) -> DataFrame:
    """Put tables side by side on a key that is unique in each: every key of any table, nulls where one has none.

    The tables are stacked and gathered by one shuffle on the key, however many they are.
    """
    columns = list(dict.fromkeys(c for t in tables for c in t.columns if c != key))
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return stacked.groupBy(key).agg(*[F.first(F.col(f"`{c}`"), ignorenulls=True).alias(c) for c in columns])


def outer_join_shared(tables: list[DataFrame], key: str) -> DataFrame:
    """Full outer join of sheets that repeat some columns: a shared column comes from the first table that has it."""
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t.drop(*[c for c in t.columns if c != key and c in out.columns]), key, "full_outer")
    return out


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand in more than one row, with their number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """The same rows; an error with samples if a key repeats."""
    found = duplicates(df, keys).limit(5).collect()
    if found:
        raise ValueError(f"duplicate keys {keys}: {[tuple(r)[:-1] for r in found]}")
    return df


def missing_keys(df: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """Distinct keys of ``df`` that ``known`` lacks."""
    return df.where(F.col(key).isNotNull()).select(key).distinct().join(known.select(F.col(known_key).alias("__k")).distinct(), F.col(key) == F.col("__k"), "left_anti")


def key_then_points(rows: DataFrame, lookup: DataFrame, key: str, lookup_key: str, lookup_code: str, spatial: DataFrame, row_key: str) -> DataFrame:
    """Resolve a code by key first and by place else; ``resolution`` tells how.

    ``spatial`` has ``row_key, area_code`` for the rows that were tested in polygons.
    """
    slim = lookup.select(F.col(lookup_key).alias("__key"), F.col(lookup_code).alias("__by_key"))
    out = rows.join(slim, F.col(key) == F.col("__key"), "left").join(spatial.select(F.col(row_key).alias("__row"), F.col("area_code").alias("__by_place")), F.col(row_key) == F.col("__row"), "left")
    how = F.when(F.col("__by_key").isNotNull(), "mb_code").when(F.col("__by_place").isNotNull(), "spatial_join").otherwise("unmatched")
    return out.withColumn("resolution", how).withColumn("area_code", F.coalesce("__by_key", "__by_place")).drop("__key", "__by_key", "__row", "__by_place")


def union_states(tables: list[DataFrame]) -> DataFrame:
    """All tables under one another; empty ones add nothing, none at all is an error."""
    if not tables:
        raise ValueError("no tables to put together")
    return reduce(lambda a, b: a.unionByName(b), tables)


def null_counts(df: DataFrame, columns: list[str], where: Column | None = None) -> DataFrame:
    """One row: how many nulls each column has, over the rows that a condition picks."""
    rows = df.where(where) if where is not None else df
    return rows.agg(*[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in columns])
