"""Parsed tables kept beside their files, so that a workbook or a boundary file is read once."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areaweave.sources.files import read_small, stored, traits, write_small

#: Columns of area weights whose names come from the boundary files, and what they are called by default.
WEIGHT_KEYS = ("sa2_code", "lga_code")


#: What a kept table was made of; the name begins with an underscore, so Spark reads past it.
MANIFEST = "_sources.json"


def manifest(spark: SparkSession, sources: Sequence[str]) -> str | None:
    """Place, length and time of change of every source file, as text; None if one of them is gone."""
    found = [traits(spark, s) for s in sources]
    return None if any(t is None for t in found) else json.dumps([[s, *t] for s, t in zip(sources, found)])


def fresh(spark: SparkSession, path: str, sources: Sequence[str]) -> bool:
    """Whether what is kept at a path is complete and made of just these files.

    Files that are gone can't be read again, so what was made of them stays as it is.
    """
    if not stored(spark, f"{path}/_SUCCESS"):
        return False
    now = manifest(spark, sources)
    return now is None or (stored(spark, f"{path}/{MANIFEST}") and read_small(spark, f"{path}/{MANIFEST}") == now)


def kept_files(spark: SparkSession, path: str, write: Callable[[str], None], sources: Sequence[str] = (), refresh: bool = False) -> str:
    """The folder at ``path``, written anew if it is not there, half-written, or made of other files than these."""
    if refresh or not fresh(spark, path, sources):
        now = manifest(spark, sources)  # before the files are read: one that changes meanwhile is read again next time
        write(path)
        if now is not None:
            write_small(spark, f"{path}/{MANIFEST}", now)
    return path


def kept(spark: SparkSession, path: str, make: Callable[[], DataFrame], refresh: bool = False, sources: Sequence[str] = ()) -> DataFrame:
    """The table at ``path``, made and written where `kept_files` says so."""
    return spark.read.parquet(kept_files(spark, path, lambda at: make().write.mode("overwrite").parquet(at), sources, refresh))


def release_path(root: str, dataset: str, release: str) -> str:
    return f"{root}/sidecars/dataset={dataset}/release={release}"


def write_weights(weights: DataFrame, path: str, sa2_column: str = WEIGHT_KEYS[0], lga_column: str = WEIGHT_KEYS[1]) -> None:
    """Write area weights with the names that their two boundary files give the codes."""
    weights.withColumn("__sa2_column", F.lit(sa2_column)).withColumn("__lga_column", F.lit(lga_column)).write.mode("overwrite").parquet(path)


def read_weights(spark: SparkSession, path: str) -> tuple[DataFrame, str, str]:
    """Area weights, and the names of the codes in their boundary files (the default ones if they were not kept)."""
    df = spark.read.parquet(path)
    if "__sa2_column" not in df.columns:
        return df, *WEIGHT_KEYS
    names = df.select("__sa2_column", "__lga_column").first() or WEIGHT_KEYS
    return df.drop("__sa2_column", "__lga_column"), *names


def weight_summary(weights: DataFrame) -> DataFrame:
    """One row: how many pairs, areas and councils the weights have."""
    return weights.agg(F.count("*").alias("pairs"), F.countDistinct("sa2_code").alias("sa2s"), F.countDistinct("lga_code").alias("lgas"))
