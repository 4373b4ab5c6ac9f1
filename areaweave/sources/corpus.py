"""The address corpus: layout, releases, required columns."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areaweave.operators.geocode import corpus_from_files
from areaweave.sources.files import stored

REQUIRED = ("ADDRESS_DETAIL_PID", "ADDRESS_LABEL", "LATITUDE", "LONGITUDE", "MB_CODE", "POSTCODE")
MODES = ("cache", "remote", "official")
LOADER = "address_principals"


def check_columns(df: DataFrame) -> DataFrame:
    lacking = [c for c in REQUIRED if c not in df.columns]
    if lacking:
        raise ValueError(f"the address corpus lacks {', '.join(lacking)}")
    return df


def _releases(spark: SparkSession, root: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    return sorted(n for s in fs.listStatus(path) if re.fullmatch(r"\d{6}", n := s.getPath().getName()))


def releases(spark: SparkSession, root: str, cache: str | None = None, refresh: bool = False) -> list[str]:
    """The monthly releases (YYYYMM folders) of a store, oldest first, those of a cache folder included.

    With ``refresh`` only what the store itself has counts.
    """
    return sorted({*_releases(spark, root), *(_releases(spark, cache) if cache and not refresh else [])})


def listing(spark: SparkSession, base: str, pattern: str | None = None) -> DataFrame:
    """``key, size, path``: the parquet files under a folder, however deep, whose key (path below the folder) fits ``pattern``.

    Without a pattern only files right in the folder count. Keys that begin with a dot or an underscore never do.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(base).select("path", F.col("length").alias("size"))
    at = spark._jvm.org.apache.hadoop.fs.Path(base)
    whole = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/") + "/"
    keyed = files.withColumn("key", F.substring_index("path", whole.split(":", 1)[-1].lstrip("/"), -1)).where(~F.col("key").rlike(r"(^|/)[._]"))
    return keyed.where(F.col("key").rlike(pattern) if pattern else ~F.contains("key", F.lit("/"))).select("key", "size", "path")


def resolve_release(spark: SparkSession, root: str, release: str, cache: str | None = None, refresh: bool = False) -> str:
    """The release itself, or the latest one: of the cache folder if it has any (unless ``refresh``), else of the store."""
    if release != "latest":
        if not re.fullmatch(r"\d{6}", release):
            raise ValueError(f"a release looks like 202502, not {release!r}")
        return release
    found = (_releases(spark, cache) if cache and not refresh else []) or _releases(spark, root)
    if not found:
        raise FileNotFoundError(f"no release under {root}")
    return found[-1]


def read(spark: SparkSession, root: str, release: str = "latest", mode: str = "cache", census_year: int = 2021, name_filter: str | None = None, cache: str | None = None, refresh: bool = False) -> DataFrame:
    """``pid, label, lat, lon, mb_code, postcode`` of a release, from either layout of files.

    ``remote`` is a root in a store that Spark reads; a release that lies in the folder ``cache`` is read there instead,
    unless ``refresh`` is asked for. ``name_filter``, a regular expression on the key below the release's folder, picks files
    of the flat layout. ``official`` files are not supported.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    if mode == "official":
        raise NotImplementedError("official corpus files are not supported; use cache or remote")
    known = resolve_release(spark, root, release, cache, refresh)
    here = cache if cache and not refresh and known in _releases(spark, cache) else root
    base = f"{here.rstrip('/')}/{known}"
    if stored(spark, f"{base}/{LOADER}"):
        return corpus_from_files(spark.read.parquet(f"{base}/{LOADER}"), census_year)
    # as many paths as a release has files
    paths = sorted(r["path"] for r in listing(spark, base, name_filter).select("path").collect())
    if not paths:
        raise FileNotFoundError(f"no parquet files under {base}" + (f" fit {name_filter!r}" if name_filter else ""))
    df = check_columns(spark.read.parquet(*paths))
    return df.select(
        F.col("ADDRESS_DETAIL_PID").cast("string").alias("pid"), F.col("ADDRESS_LABEL").alias("label"), F.col("LATITUDE").cast("double").alias("lat"),
        F.col("LONGITUDE").cast("double").alias("lon"), F.col("MB_CODE").cast("string").alias("mb_code"), F.col("POSTCODE").cast("string").alias("postcode"),
    )
