"""Bringing data from coarser or overlapping areas down to the target areas.

A correspondence has ``sa2_code, lga_code, intersection_area_m2, sa2_area_m2, lga_area_m2, sa2_share_of_lga,
lga_share_of_sa2``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaweave.operators.overlay import overlaps
from areaweave.operators.spatial import areas


def correspondence(sa2: DataFrame, lga: DataFrame, cell: float, least: float = 1.0) -> DataFrame:
    """Area weights between two boundary sets in plane coordinates."""
    pairs = overlaps(sa2, lga, cell, least)
    a = areas(sa2, project=False).select(F.col("code").alias("a_code"), F.col("area").alias("sa2_area_m2"))
    b = areas(lga, project=False).select(F.col("code").alias("b_code"), F.col("area").alias("lga_area_m2"))
    out = pairs.join(a, "a_code", "left").join(b, "b_code", "left")
    return out.select(
        F.col("a_code").alias("sa2_code"), F.col("b_code").alias("lga_code"), F.col("area").alias("intersection_area_m2"), "sa2_area_m2", "lga_area_m2",
        F.try_divide("area", "lga_area_m2").alias("sa2_share_of_lga"), F.try_divide("area", "sa2_area_m2").alias("lga_share_of_sa2"),
    )


def lgas_of(weights: DataFrame, sa2_code: str) -> DataFrame:
    return weights.where(F.col("sa2_code") == sa2_code).select("lga_code", "lga_share_of_sa2")


def sa2s_of(weights: DataFrame, lga_code: str) -> DataFrame:
    return weights.where(F.col("lga_code") == lga_code).select("sa2_code", "sa2_share_of_lga")


def counts(weights: DataFrame, values: DataFrame, columns: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Counts of LGAs dealt to SA2s by area: all columns in one pass. Areas that overlap none are left out.

    A missing count adds nothing, and an area of only missing counts has 0. Values of several releases, told apart by the
    columns ``by``, are dealt side by side.
    """
    met = weights.select("sa2_code", "lga_code", F.col("sa2_share_of_lga").alias("__w")).join(values.select("lga_code", *by, *columns), "lga_code")
    return met.groupBy("sa2_code", *by).agg(*[F.coalesce(F.sum(F.col(c) * F.col("__w")), F.lit(0.0)).alias(c) for c in columns])


def rates(weights: DataFrame, values: DataFrame, columns: list[str]) -> DataFrame:
    """Rates of LGAs averaged over the part of each SA2 that they cover; a missing rate makes the average missing."""
    met = weights.select("sa2_code", "lga_code", F.col("lga_share_of_sa2").alias("__w")).join(values.select("lga_code", *columns), "lga_code")
    total = F.sum("__w")
    made = met.groupBy("sa2_code").agg(
        total.alias("__total"),
        *[F.when(F.count_if(F.col(c).isNull()) == 0, F.try_divide(F.sum(F.col(c) * F.col("__w")), total)).alias(c) for c in columns],
    )
    return made.where("__total > 0").drop("__total")


def replicate(children: DataFrame, parents: DataFrame, parent_key: str) -> DataFrame:
    """Every child with the values of its parent; nulls where the parent has none."""
    return children.join(parents, parent_key, "left")
