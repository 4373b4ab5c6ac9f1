"""Streams of rows enriched by static tables: the lookups of the batch operators hold for streams as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaweave.functions.temporal import Release, pick_release


def enrich_stream(stream: DataFrame, lookup: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """A stream left-joined to a static table, with a watermark so that later windows can close."""
    return stream.withWatermark(time, delay).join(lookup.withColumnRenamed(key, "__key"), F.col(key) == F.col("__key"), "left").drop("__key")


def release_stream(stream: DataFrame, time: str, releases: list[Release], rule: str = "closest_at_or_before") -> DataFrame:
    """Add the release of each event's date: one expression, no state."""
    return stream.withColumn("release", pick_release(F.to_date(time), releases, rule))


def windowed_counts(stream: DataFrame, time: str, keys: list[str], width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Rows of each key in each window of event time; windows close when the watermark has passed them."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"))
