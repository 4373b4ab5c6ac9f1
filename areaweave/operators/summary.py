"""What a run did, in one pass over its rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaweave.operators.geocode import SOURCES

RESOLUTIONS = ("mb_code", "spatial_join", "unmatched")


@dataclass(frozen=True)
class RunSummary:
    rows: int
    geocoded: int
    failed: int
    with_area: int
    without_area: int
    fully_enriched: int
    partially_enriched: int
    not_enriched: int
    sources: dict[str, int] = field(default_factory=dict)
    resolutions: dict[str, int] = field(default_factory=dict)
    nulls: dict[str, int] = field(default_factory=dict)
    unused_columns: list[str] = field(default_factory=list)

    def human_readable(self) -> str:
        lines = [f"Rows: {self.rows}", f"Coordinates: {self.geocoded} found, {self.failed} failed"]
        lines += [f"  {k}: {n}" for k, n in self.sources.items() if n]
        lines += [f"Areas: {self.with_area} found, {self.without_area} without"]
        lines += [f"  {k}: {n}" for k, n in self.resolutions.items() if n]
        lines += [f"Enriched: {self.fully_enriched} fully, {self.partially_enriched} in part, {self.not_enriched} not"]
        if self.unused_columns:
            lines.append(f"Columns not found: {', '.join(self.unused_columns)}")
        return "\n".join(lines)


def masks(df: DataFrame, columns: list[str], code: str = "sa2_code") -> DataFrame:
    """Add ``is_unmatched``, ``is_fully_enriched`` and ``is_partially_enriched`` to each row."""
    placed = F.col("geo_lat").isNotNull() & F.col("geo_lon").isNotNull()
    known = F.col(code).isNotNull()
    if columns:
        some = F.coalesce(*[F.col(c).cast("string") for c in columns]).isNotNull()
        every = F.lit(True)
        for c in columns:
            every = every & F.col(c).isNotNull()
    else:
        some = every = F.lit(True)
    return df.withColumns({"is_unmatched": placed & ~known, "is_fully_enriched": known & every, "is_partially_enriched": known & ~every & some})


def aggregates(df: DataFrame, columns: list[str], code: str = "sa2_code") -> DataFrame:
    """One row with all counts of a summary."""
    marked = masks(df, columns, code)
    counts = [F.count("*").alias("rows"), F.count_if(F.col(code).isNotNull()).alias("with_area")]
    counts += [F.count_if(F.col(m)).alias(m) for m in ("is_unmatched", "is_fully_enriched", "is_partially_enriched")]
    counts += [F.count_if(F.col("geo_source") == s).alias(f"source_{s}") for s in SOURCES]
    counts += [F.count_if(F.col("sa2_resolution") == r).alias(f"resolution_{r}") for r in RESOLUTIONS]
    counts += [F.count_if(F.col(code).isNotNull() & F.col(c).isNull()).alias(f"null_{c}") for c in columns]
    return marked.agg(*counts)


def summarise(df: DataFrame, columns: list[str], unused: list[str] | None = None) -> RunSummary:
    r = aggregates(df, columns).first()
    sources = {s: r[f"source_{s}"] for s in SOURCES}
    return RunSummary(
        rows=r["rows"], geocoded=r["rows"] - sources["failed"], failed=sources["failed"], with_area=r["with_area"], without_area=r["is_unmatched"],
        fully_enriched=r["is_fully_enriched"], partially_enriched=r["is_partially_enriched"], not_enriched=r["rows"] - r["is_fully_enriched"] - r["is_partially_enriched"],
        sources=sources, resolutions={k: r[f"resolution_{k}"] for k in RESOLUTIONS}, nulls={c: r[f"null_{c}"] for c in columns}, unused_columns=unused or [],
    )


def releases_used(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """One row: for each dataset the sorted releases that its rows took."""
    return df.agg(*[F.array_sort(F.collect_set(F.col(c))).alias(d) for d, c in columns.items()])
