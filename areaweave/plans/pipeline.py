"""The planner: a configuration and its sources to one DataFrame."""

from __future__ import annotations

import difflib
import logging
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areaweave.functions.features import compiled, out_of_bounds
from areaweave.functions.temporal import month_release, to_day
from areaweave.operators.asof import asof_release, check_range, cross_edition_join
from areaweave.operators.enrich import outer_concat, row_id
from areaweave.operators.geocode import Provider, resolve
from areaweave.operators.spatial import points_in_areas
from areaweave.operators.summary import RunSummary, masks, releases_used, summarise
from areaweave.plans.config import Config
from areaweave.plans.presets import FeatureRegistry
from areaweave.plans.registry import PRESET, Registry, VariableCatalog

log = logging.getLogger(__name__)
#: Names that the result adds; an input column of such a name is an error.
RESERVED = ("geo_lat", "geo_lon", "geo_source", "geo_match_score", "sa2_code", "sa2_name", "sa2_resolution")
UNSET = object()


@dataclass
class Sources:
    """What a run draws on. Everything but the boundaries of the reference edition may be absent."""

    boundaries: dict[int, DataFrame]
    registry: Registry
    providers: list[Provider] = field(default_factory=list)
    mesh_blocks: DataFrame | None = None
    features: FeatureRegistry = field(default_factory=FeatureRegistry)
    corpus_releases: list[str] = field(default_factory=list)


@dataclass
class AugmentResult:
    """The table, with its masks and summary on demand; nothing runs before it is asked for."""

    df: DataFrame
    added: list[str]
    release_columns: dict[str, str]
    unused: list[str]
    #: ``df`` with ``_row_id``, by which rows are brought back to the order in which they were read.
    numbered: DataFrame | None = None

    @cached_property
    def summary(self) -> RunSummary:
        return summarise(self.df, self.added, self.unused)

    def with_masks(self) -> DataFrame:
        return masks(self.df, self.added)

    def releases_used(self) -> dict[str, list[str]]:
        return releases_used(self.df, self.release_columns).first().asDict() if self.release_columns else {}


class Pipeline:
    def __init__(self, spark: SparkSession, config: Config, sources: Sources, cell: float = 0.25):
        self.spark, self.config, self.sources, self.cell = spark, config, sources, cell
        for w in config.warnings():
            log.warning(w)

    @classmethod
    def from_config(cls, spark: SparkSession, config: Config, root: str, cache: str | None = None, fetch=None, check: bool = True, ask=None, askers: int = 1) -> Pipeline:
        """A pipeline over a folder of published files (see `plans.loaders`).

        ``cache``: where outside geocodes are kept; ``ask``: one request to the outside geocoder, kept to the configured pace
        over ``askers`` tasks (``fetch``: the same with a pace of one's own). With ``check``, the variables of the census
        are looked up in its catalogue and tables before anything runs.
        """
        from areaweave.plans.wiring import sources_of

        made = cls(spark, config, sources_of(spark, config, root, cache, fetch, ask, askers))
        if check:
            made.check_variables()
        return made

    def check_variables(self) -> None:
        """Raise if a namespace, a preset or a census column that is asked for does not exist."""
        for dataset, refs in self.needed().items():
            loader = self.sources.registry.loaders.get(dataset)
            if dataset != "gcp" or loader is None:
                continue
            columns = loader.catalogue() if hasattr(loader, "catalogue") else None
            if columns is not None:
                VariableCatalog(columns).validate_variables(refs)
            self._table(dataset, refs, None)

    @classmethod
    def create(cls, spark: SparkSession, sources: Sources, variables: dict[str, str], prefix: str = "sa2_", **columns) -> Pipeline:
        """A pipeline for notebooks: variables and locator columns, defaults elsewhere."""
        return cls(spark, Config(input=columns, output={"prefix": prefix}, variables=variables), sources)

    # -- planning ---------------------------------------------------------------------------------------------
    def _plain(self) -> tuple[dict[str, str], dict[str, str]]:
        """Variables that are columns, and those that are presets."""
        presets = {n: r.split(".", 1)[1] for n, r in self.config.variables.items() if r.split(".", 1)[0] == PRESET}
        return {n: r for n, r in self.config.variables.items() if n not in presets}, presets

    def needed(self) -> dict[str, list[str]]:
        """Fields to read of each dataset, those of presets included, each once."""
        plain, presets = self._plain()
        refs = list(plain.values()) + [f for p in presets.values() for f in self.sources.features.get(p).source_fields()]
        out: dict[str, list[str]] = {}
        for ref in dict.fromkeys(refs):
            spec, _ = self.sources.registry.resolve_variable(ref)
            out.setdefault(spec.id, []).append(ref)
        return out

    def _table(self, dataset: str, refs: list[str], release: str | None) -> DataFrame:
        """``sa2_code`` and a column ``ref`` for each reference, pruned to what is asked for."""
        columns = {r: self.sources.registry.resolve_variable(r)[1] for r in refs}
        df = self.sources.registry.load(self.spark, dataset, release, list(columns.values()))
        missing = sorted(c for c in columns.values() if c not in df.columns)
        if missing:
            near = sorted({n for c in missing for n in difflib.get_close_matches(c, df.columns, 3, 0.6)})
            raise KeyError(f"{dataset} has no columns {missing}; near: {near}")
        return df.where(F.col("sa2_code").isNotNull()).select("sa2_code", *[F.col(f"`{c}`").alias(r) for r, c in columns.items()])

    def _finished(self, df: DataFrame) -> tuple[DataFrame, list[str]]:
        """Variables and presets from the joined fields, each an alias of its own."""
        plain, presets = self._plain()
        column = lambda ref: F.col(f"`{ref}`")
        added, out = [], {}
        for name, ref in self.config.variables.items():
            full = self.config.output.prefix + name
            out[full] = compiled(self.sources.features.get(presets[name]), column) if name in presets else column(ref)
            added.append(full)
        return df.withColumns(out).drop(*[r for refs in self.needed().values() for r in refs]), added

    # -- running ----------------------------------------------------------------------------------------------
    def augment(self, df: DataFrame, address_column=UNSET, latitude_column=UNSET, longitude_column=UNSET) -> AugmentResult:
        """Rows with coordinates, area and variables. Columns named in the configuration but absent are left out."""
        c = self.config.input
        pick = lambda given, own: own if given is UNSET else given
        asked = {"address": pick(address_column, c.address_column), "lat": pick(latitude_column, c.latitude_column), "lon": pick(longitude_column, c.longitude_column)}
        have = {k: v if v in df.columns else None for k, v in asked.items()}
        unused = [v for k, v in asked.items() if v and not have[k]]
        if not (have["lat"] and have["lon"]):
            have["lat"] = have["lon"] = None
        if not have["address"] and not have["lat"]:
            raise ValueError("no usable locator: an address column or both coordinate columns have to be there")
        temporal = c.date_column is not None and c.date_column in df.columns
        needed = self.needed()
        generated = [self.config.output.prefix + n for n in self.config.variables]
        if temporal:
            generated += ["sa2_code_edition", "gnaf_release", *[f"{d}_release" for d in needed], *[f"{d}_sa2_code_source" for d in needed]]
        if clash := sorted(set(df.columns) & {*RESERVED, *generated}):
            raise ValueError(f"input columns have names of the result: {clash}")

        original = df.columns
        rows = row_id(df)
        release = None
        if temporal:
            kind = dict(df.dtypes)[c.date_column]
            rows = rows.withColumn("__day", to_day(F.col(c.date_column), kind))
            if kind == "string" and (bad := rows.where(F.col(c.date_column).isNotNull() & F.col("__day").isNull()).limit(1).count()):
                raise ValueError(f"{bad} or more values of {c.date_column} are no dates")
            days = rows.select("__day").distinct()
            if self.sources.corpus_releases:
                release = "gnaf_release"
                t = self.config.temporal
                rows = asof_release(rows, "__day", [month_release(r) for r in self.sources.corpus_releases], t.rule("gnaf"), t.out_of_range, release)
                if t.out_of_range == "fail" and t.rule("gnaf") != "closest":
                    check_range(rows, "__day", release, "the address corpus")
        located = resolve(rows, have["address"], have["lat"], have["lon"], self.sources.providers, release)
        placed = self._place(located)
        release_columns: dict[str, str] = {}
        if temporal:
            joined, release_columns = self._temporal(placed, needed, days)
        else:
            joined = placed
            if needed:
                lookup = outer_concat([self._table(d, refs, None) for d, refs in needed.items()], "sa2_code")
                joined = placed.join(lookup.withColumnRenamed("sa2_code", "__of"), F.col("sa2_code") == F.col("__of"), "left").drop("__of")
        done, added = self._finished(joined)
        middle = [*RESERVED]
        if temporal:
            middle += ["sa2_code_edition", *([release] if release else []), *sorted(release_columns.values()), *sorted(f"{d}_sa2_code_source" for d in needed)]
        numbered = done.select("_row_id", *[F.col(f"`{x}`") for x in [*original, *middle, *added]])
        return AugmentResult(numbered.drop("_row_id"), added, release_columns, unused, numbered)

    def run(self) -> RunSummary:
        """From ``input.path`` to ``output.path``, rows in the order of the input, and what was done."""
        from areaweave.sources.files import read_csv, write_csv

        given, wanted = self.config.input.path, self.config.output.path
        if not given or not wanted:
            raise ValueError("run needs input.path and output.path; use augment for DataFrames")
        result = self.augment(read_csv(self.spark, given))
        write_csv(result.numbered, wanted, "_row_id")
        return result.summary

    def _place(self, rows: DataFrame) -> DataFrame:
        """Area of each row: by mesh block where an address gave one, else by the polygon its point is within."""
        boundaries = self.sources.boundaries[self._edition()]
        if self.sources.mesh_blocks is not None:
            mb = self.sources.mesh_blocks.select(F.col("mb_code").alias("__mb"), F.col("sa2_code").alias("__code"), F.col("sa2_name").alias("__name"))
            rows = rows.join(mb, F.col("mb_code") == F.col("__mb"), "left").drop("__mb")
        else:
            rows = rows.withColumn("__code", F.lit(None).cast("string")).withColumn("__name", F.lit(None).cast("string"))
        # only distinct points that no key has placed are tested
        points = rows.where(F.col("__code").isNull() & F.col("geo_lat").isNotNull()).select(F.struct("geo_lon", "geo_lat").alias("point"), "geo_lon", "geo_lat").distinct()
        hits = points_in_areas(points, boundaries, "point", "geo_lon", "geo_lat", self.cell)
        hits = hits.select(F.col("point.geo_lon").alias("__x"), F.col("point.geo_lat").alias("__y"), "area_code", "area_name")
        out = rows.join(hits, (F.col("geo_lon") == F.col("__x")) & (F.col("geo_lat") == F.col("__y")) & F.col("__code").isNull(), "left")
        how = F.when(F.col("__code").isNotNull(), "mb_code").when(F.col("area_code").isNotNull(), "spatial_join").when(F.col("geo_lat").isNotNull(), "unmatched")
        return out.withColumn("sa2_resolution", how).withColumn("sa2_code", F.coalesce("__code", "area_code")).withColumn("sa2_name", F.coalesce("__name", "area_name")).drop("__code", "__name", "__x", "__y", "area_code", "area_name")

    def _edition(self) -> int:
        return self.config.temporal.reference_edition if self.config.input.date_column else self.config.census.asgs_edition

    def _temporal(self, rows: DataFrame, needed: dict[str, list[str]], days: DataFrame) -> tuple[DataFrame, dict[str, str]]:
        """Each dataset joined by the release of the row's date, on the code of that release's boundary edition.

        One plan for all rows: the release is a Column, the code is chosen by edition, and the releases of a dataset
        are one table keyed by release and code. ``days``: the dates of the rows as they came (``__day``).
        """
        t, reference = self.config.temporal, self._edition()
        rows = rows.withColumn("sa2_code_edition", F.when(F.col("sa2_code").isNotNull(), F.lit(reference)))
        specs = {d: self.sources.registry.get(d) for d in needed}
        editions = sorted({e for s in specs.values() for e in s.editions.values()} - {reference})
        codes = {reference: "sa2_code"}
        for e in editions:
            if e not in self.sources.boundaries:
                log.warning("no boundaries of edition %s: its releases are joined on edition %s", e, reference)
                codes[e] = "sa2_code"
                continue
            points = rows.where(F.col("geo_lat").isNotNull()).select(F.struct("geo_lon", "geo_lat").alias("point"), "geo_lon", "geo_lat").distinct()
            hits = points_in_areas(points, self.sources.boundaries[e], "point", "geo_lon", "geo_lat", self.cell)
            hits = hits.select(F.col("point.geo_lon").alias("__x"), F.col("point.geo_lat").alias("__y"), F.col("area_code").alias(f"__sa2_{e}"))
            rows = rows.join(hits, (F.col("geo_lon") == F.col("__x")) & (F.col("geo_lat") == F.col("__y")), "left").drop("__x", "__y")
            codes[e] = f"__sa2_{e}"
        release_columns = {}
        for d, refs in needed.items():
            spec, column = specs[d], f"{d}_release"
            windows = spec.windows()
            pick = lambda df: asof_release(df, "__day", windows, t.rule(d), t.out_of_range, column)  # noqa: B023, E731
            taken = None
            if windows:
                rows = pick(rows)
                if t.out_of_range == "fail" and t.rule(d) != "closest":
                    check_range(days, "__day", column, d, pick)
                if len(windows) > 1:
                    # told from the dates alone, before anything is located; the list of known ones marks it as a filter
                    taken = pick(days).select(F.col(column).alias("release")).where(F.col("release").isin([w.id for w in windows])).distinct()
            else:
                log.warning("dataset %s has no release dates: its default release is used for all rows", d)
                rows = rows.withColumn(column, F.lit(spec.default_release or "default"))
            release_columns[d] = column
            wanted = {r: self.sources.registry.resolve_variable(r)[1] for r in refs}
            values, lacking = self.sources.registry.load_releases(self.spark, d, [w.id for w in windows] or [spec.default_release], list(wanted.values()))
            if values is None:
                raise FileNotFoundError(f"no files of {d}, releases {lacking}")
            if missing := sorted(c for c in wanted.values() if c not in values.columns):
                raise KeyError(f"{d} has no columns {missing}; near: {sorted({n for c in missing for n in difflib.get_close_matches(c, values.columns, 3, 0.6)})}")
            if lacking:
                # only a row that takes such a release is an error, and it is found when the row is
                say = F.raise_error(F.concat(F.lit(f"no files of {d}, release "), F.col(column))).cast("string")
                rows = rows.withColumn(column, F.when(F.col(column).isin(lacking), say).otherwise(F.col(column)))
            editions_of = {str(r): e for r, e in spec.editions.items()}
            rows = cross_edition_join(rows, values, column, editions_of, codes, wanted, reference, f"{d}_sa2_code_source", taken)
        return rows, release_columns

    def bound_warnings(self, result: AugmentResult) -> dict[str, int]:
        """How many values of each preset with the rule ``warn`` lie outside its bounds."""
        _, presets = self._plain()
        watched = {n: self.sources.features.get(p) for n, p in presets.items()}
        watched = {self.config.output.prefix + n: f for n, f in watched.items() if f.bounds and f.out_of_bounds == "warn"}
        if not watched:
            return {}
        return result.df.agg(*[F.count_if(out_of_bounds(F.col(n), f)).alias(n) for n, f in watched.items()]).first().asDict()
