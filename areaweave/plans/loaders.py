"""Loaders of the datasets over a folder of published files, in any store that Spark reads.

    <root>/boundaries/<year>/<file of the edition>     <root>/lga/LGA_<year>_AUST_GDA2020.zip
    <root>/mesh_blocks/<year>/*.zip                    <root>/census/<year>/*.csv (extracted) or *.zip
    <root>/datasets/<dataset>/<release>/*              <root>/gnaf/<release>/*
    <root>/short_codes.csv (short, sa2_code)           <root>/sidecars/... (written by us)

A loader resolves a release, parses its files, keeps the parsed table beside them, and then attaches what lies across:
areas for the density, parents for tables by region, weights for tables by council. What is attached is not kept, so
another boundary set does not need the files to be parsed again.
"""

from __future__ import annotations

import difflib
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areaweave.operators import downscale
from areaweave.operators.enrich import missing_keys
from areaweave.operators.spatial import areas, planar
from areaweave.plans.registry import DATASETS, Registry
from areaweave.sources import census, datasets
from areaweave.sources.editions import PARENT_SA4, Edition, edition, lga_edition
from areaweave.sources.files import boundary_file, folders, listed, mesh_block_file, read_bytes, read_csv, stored, workbook
from areaweave.sources.sidecars import fresh, kept, kept_files, read_weights, release_path, write_weights


@dataclass
class Store:
    """The folder of files, and the tables that several datasets draw on; each is made once and kept."""

    spark: SparkSession
    root: str
    year: int = 2021
    datum: str = "GDA2020"
    lga_year: int | str = "latest"
    cell: float = 25_000.0
    #: The data pack to read: a file of one's own instead of the staged one, and its kind of headers and region.
    local_zip: str | None = None
    descriptor: str = "short-header"
    region: str = "AUS"
    refresh: bool = False
    #: Stores to read boundaries, data packs and council boundaries from, in place of the folder; what is kept stays in the folder.
    boundaries_base: str | None = None
    census_base: str | None = None
    lga_base: str | None = None

    def boundary_source(self, e: Edition) -> str:
        """Where the file of an edition lies."""
        return f"{self.boundaries_base.rstrip('/')}/{e.file}" if self.boundaries_base else f"{self.root}/boundaries/{e.year}/{e.file}"

    def lga_source(self, e: Edition) -> str:
        return f"{(self.lga_base or self.root + '/lga').rstrip('/')}/{e.file}"

    def census_folder(self, year: int) -> str:
        return f"{(self.census_base or self.root + '/census').rstrip('/')}/{year}"

    def boundary_table(self, year: int, datum: str | None = None) -> DataFrame:
        """``code, name, rings, attributes`` of an edition, kept as parquet."""
        e = edition(year, datum or ("GDA94" if year < 2021 else self.datum))
        source = self.boundary_source(e)
        return kept(self.spark, f"{self.root}/sidecars/boundaries/{e.file}", lambda: boundary_file(self.spark, source, e.code, e.name), self.refresh, [source])

    @cached_property
    def sa2(self) -> DataFrame:
        return self.boundary_table(self.year)

    @cached_property
    def lga(self) -> DataFrame:
        e = lga_edition(self.lga_year)
        source = self.lga_source(e)
        return kept(self.spark, f"{self.root}/sidecars/boundaries/{e.file}", lambda: boundary_file(self.spark, source, e.code, e.name), self.refresh, [source])

    @cached_property
    def mesh(self) -> DataFrame | None:
        found = listed(self.spark, f"{self.root}/mesh_blocks/{self.year}", ".zip")
        return kept(self.spark, f"{self.root}/sidecars/mesh_blocks/{self.year}", lambda: mesh_block_file(self.spark, found[0]), self.refresh, found[:1]) if found else None

    @cached_property
    def sa2_areas(self) -> DataFrame:
        return areas(self.sa2)

    @cached_property
    def parents(self) -> DataFrame:
        """``sa2_code, sa4_code`` from the attributes of the boundaries; blank parents are left out."""
        column = PARENT_SA4[edition(self.year, "GDA94" if self.year < 2021 else self.datum).number]
        parent = F.trim(F.try_element_at("attributes", F.lit(column)))
        return self.sa2.select(F.col("code").alias("sa2_code"), parent.alias("sa4_code")).where((F.col("sa4_code") != "") & (F.lower("sa4_code") != "nan"))

    @cached_property
    def weights(self) -> DataFrame:
        """Area weights between councils and the areas of the edition, in the equal-area plane, kept."""
        e, g = edition(self.year, "GDA94" if self.year < 2021 else self.datum), lga_edition(self.lga_year)
        path = f"{self.root}/sidecars/correspondence/sa2_{self.year}_lga_{g.year}"
        sources = [self.boundary_source(e), self.lga_source(g)]
        kept_files(self.spark, path, lambda at: write_weights(downscale.correspondence(planar(self.sa2), planar(self.lga), self.cell), at, e.code, g.code), sources, self.refresh)
        return read_weights(self.spark, path)[0]

    @cached_property
    def short_codes(self) -> DataFrame | None:
        """``short, sa2_code``: five-digit codes of old payment files with their nine-digit ones.

        They come from the boundaries of 2016, which old files are coded by (the ones of the census year if the folder has
        no others): from their own column, or the digit of the state and the last four of the code. A table of the folder
        (``short_codes.csv``) goes before.
        """
        if found := [p for p in listed(self.spark, self.root, ".csv") if p.endswith("/short_codes.csv")]:
            return read_csv(self.spark, found[0], infer=False).select("short", "sa2_code")
        old = self.boundary_table(2016) if stored(self.spark, f"{self.root}/boundaries/2016") else self.sa2
        return datasets.code_map(old)

    def files(self, dataset: str, release: str) -> list[str]:
        found = listed(self.spark, f"{self.root}/datasets/{dataset}/{release}")
        if not found:
            raise FileNotFoundError(f"no files of {dataset}, release {release}, under {self.root}")
        return found

    def archive(self, year: int) -> str:
        """The data pack of a year: a file of one's own, or the staged one that fits kind of headers and region."""
        folder = self.census_folder(year)
        # packs of 2016 have short headers only
        kind = "short-header" if year == 2016 else self.descriptor
        staged = listed(self.spark, folder, ".zip")
        fits = [p for p in staged if kind in p.lower() and self.region.lower() in p.lower().rsplit("/", 1)[-1]] or (staged if len(staged) == 1 else [])
        path = self.local_zip if self.local_zip and year == self.year else fits[0] if fits else None
        if path is None:
            raise FileNotFoundError(f"no data pack of {year} under {folder}; staged are {staged}")
        if not stored(self.spark, path):
            raise FileNotFoundError(path)
        return path

    def datapack(self, year: int) -> dict[str, Callable[[], DataFrame]]:
        """Tables of a data pack by id: scans of extracted files, or of what is kept of the archive's members."""
        if extracted := {t: p for p in listed(self.spark, self.census_folder(year), ".csv") if (t := census.table_of(p))}:
            return {t: lambda p=p: census.table_file(self.spark, p) for t, p in extracted.items()}
        path = self.archive(year)
        folder = kept_files(self.spark, f"{self.root}/sidecars/census/{year}/{path.rsplit('/', 1)[-1]}", lambda at: census.extract(self.spark, path, at), [path], self.refresh)
        return {t: lambda t=t, names=names: census.extracted_table(self.spark, folder, t, names) for t, names in census.headers(self.spark, folder).items()}

    def catalogue(self, year: int) -> DataFrame | None:
        """``table_id, pos, code, description, table_name`` of a data pack, kept; None if no workbook describes it."""
        books = [p for p in listed(self.spark, self.census_folder(year), ".xlsx") if census.METADATA.search(p.rsplit("/", 1)[-1])]
        try:
            path = books[0] if books else self.archive(year)
        except FileNotFoundError:
            return None
        at = f"{self.root}/sidecars/catalogue/{year}/{self.descriptor}/{path.rsplit('/', 1)[-1]}"
        made = kept(self.spark, at, lambda: census.catalogue(self.spark, path, "short-header" if year == 2016 else self.descriptor), self.refresh, [path])
        return None if made.isEmpty() else made


def _books(s: Store, dataset: str, release: str) -> list[dict]:
    return [workbook(read_bytes(s.spark, p)) for p in s.files(dataset, release) if p.lower().endswith(".xlsx")]


def _first(s: Store, dataset: str, release: str, suffix: str) -> bytes:
    found = [p for p in s.files(dataset, release) if p.lower().endswith(suffix)]
    if not found:
        raise FileNotFoundError(f"no {suffix} file of {dataset}, release {release}")
    return read_bytes(s.spark, found[0])


def _seifa(s: Store, d: str, r: str) -> DataFrame:
    sheets: dict = {}
    for book in _books(s, d, r):
        sheets |= book
    return datasets.seifa(s.spark, sheets)


def _erp(s: Store, d: str, r: str) -> DataFrame:
    """Totals, and the workbook of age and sex (a file with ``age`` in its name) if there is one that can be read."""
    named = {p.rsplit("/", 1)[-1].lower(): p for p in s.files(d, r) if p.lower().endswith(".xlsx")}
    totals = datasets.erp_totals(s.spark, workbook(read_bytes(s.spark, next(p for n, p in named.items() if "age" not in n))))
    ages = None
    if by_age := [p for n, p in named.items() if "age" in n]:
        try:
            ages = datasets.erp_age_sex(s.spark, workbook(read_bytes(s.spark, by_age[0])))
        except datasets.LayoutError as e:
            datasets.log.warning("population without age and sex: %s", e)
    return datasets.erp(totals, ages, None, int(r))


def _businesses(s: Store, d: str, r: str) -> DataFrame:
    reasons = []
    for grid in (g for book in _books(s, d, r) for g in book.values()):
        try:
            return datasets.businesses(s.spark, grid, r)
        except datasets.LayoutError as e:
            reasons.append(str(e))
    raise datasets.LayoutError(f"no sheet of businesses: {reasons}")


#: How the files of a release become a table.
PARSERS: dict[str, Callable[[Store, str, str], DataFrame]] = {
    "seifa": _seifa,
    "erp_by_sa2": _erp,
    "dss_payments": lambda s, d, r: datasets.dss(s.spark, _books(s, d, r)[0], r, s.short_codes),
    "abs_personal_income": lambda s, d, r: datasets.pia(s.spark, _books(s, d, r)[0], r),
    "abs_building_approvals": lambda s, d, r: datasets.building_approvals(s.spark, _books(s, d, r), r),
    "abs_building_approvals_lga": lambda s, d, r: datasets.building_approvals(s.spark, _books(s, d, r), r, lga=True),
    "abs_business_counts": _businesses,
    "salm_labour_force": lambda s, d, r: datasets.labour_force(s.spark, _first(s, d, r, ".csv"), r),
    "aihw_social_housing": lambda s, d, r: datasets.social_housing(s.spark, _books(s, d, r)[0], r),
    **{i: lambda s, d, r, i=i: datasets.health(s.spark, _first(s, d, r, ".zip"), datasets.HEALTH[i], r) for i in datasets.HEALTH},
}


def attach(store: Store, dataset: str, level: str, df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """A parsed table by area: parents' values on their areas, councils' counts dealt by weight, densities added.

    A table of several releases has the columns ``by`` (its release) besides the code, and all go through at once; areas whose
    parent has no values have rows only in a table of one release.
    """
    if level == "SA4":
        if not by:
            return downscale.replicate(store.parents, df, "sa4_code").drop("sa4_code")
        return store.parents.join(df, "sa4_code").drop("sa4_code")
    if level == "LGA":
        counts = list(datasets.BA_COLUMNS)
        unknown = missing_keys(df, "lga_code", store.weights, "lga_code").count()
        if unknown:
            datasets.log.warning("%s: %s councils overlap no area and are left out", dataset, unknown)
        return downscale.counts(store.weights, df, counts, by)
    if dataset == "erp_by_sa2":
        return datasets.with_density(df, store.sa2_areas)
    return df


class DatasetLoader:
    """One dataset: ``loader(spark, release)`` gives its table by ``sa2_code``."""

    def __init__(self, store: Store, dataset: str, level: str, releases: tuple[str, ...]):
        self.store, self.dataset, self.level, self.releases = store, dataset, level, releases

    def latest(self) -> str:
        """The last known release that the folder has, else the last known one."""
        here = set(folders(self.store.spark, f"{self.store.root}/datasets/{self.dataset}"))
        return max([r for r in self.releases if r in here] or self.releases)

    def resolved_release(self, release: str | None = None) -> str:
        """The release that a request means."""
        return self.latest() if release in (None, "latest") else release

    def sources(self, release: str) -> list[str]:
        """The files that a release is parsed from."""
        s = self.store
        maps = [p for p in listed(s.spark, s.root, ".csv") if self.dataset == "dss_payments" and p.endswith("/short_codes.csv")]
        return listed(s.spark, f"{s.root}/datasets/{self.dataset}/{release}") + maps

    def is_cached(self, release: str | None = None) -> bool:
        """Whether a release is kept, and of the files that are there now."""
        release = self.resolved_release(release)
        return fresh(self.store.spark, release_path(self.store.root, self.dataset, release), self.sources(release))

    def parsed(self, release: str) -> DataFrame:
        """The table as published, kept beside its files and made anew when these change."""
        s = self.store
        return kept(s.spark, release_path(s.root, self.dataset, release), lambda: PARSERS[self.dataset](s, self.dataset, release), s.refresh, self.sources(release))

    def __call__(self, spark: SparkSession, release: str | None = None) -> DataFrame:
        release = self.resolved_release(release)
        made = attach(self.store, self.dataset, self.level, self.parsed(release))
        return made.withColumn("reference_financial_year", F.lit(release)) if self.level == "LGA" else made

    def load_releases(self, spark: SparkSession, releases: list[str]) -> tuple[DataFrame | None, list[str]]:
        """One table of the releases, parted by ``release``, and those of them that have no files.

        What is kept of a dataset is one table with a folder for each release, so a filter on ``release`` that is known only
        when the query runs leaves folders unread.
        """
        here = set(folders(spark, f"{self.store.root}/datasets/{self.dataset}")) | {p.removeprefix("release=") for p in folders(spark, f"{self.store.root}/sidecars/dataset={self.dataset}")}
        there = [r for r in releases if r in here]
        for r in there:
            self.parsed(r)
        lacking = [r for r in releases if r not in here]
        if not there:
            return None, lacking
        whole = release_path(self.store.root, self.dataset, "").removesuffix("/release=")
        # a column may be text in one release and a number in another: each is read by its own schema, which costs no job
        reads = [spark.read.option("basePath", whole).schema("release string, " + _ddl(spark.read.parquet(release_path(self.store.root, self.dataset, r)))).parquet(release_path(self.store.root, self.dataset, r)) for r in there]
        alike = all(x.schema == reads[0].schema for x in reads)
        df = spark.read.option("basePath", whole).schema(reads[0].schema).parquet(*[release_path(self.store.root, self.dataset, r) for r in there]) if alike else _united(reads)
        made = attach(self.store, self.dataset, self.level, df, ("release",))
        return (made.withColumn("reference_financial_year", F.col("release")) if self.level == "LGA" else made), lacking


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _united(frames: list[DataFrame]) -> DataFrame:
    """All rows; a column that has several types is text."""
    kinds: dict[str, set[str]] = {}
    for f in frames:
        for name, kind in f.dtypes:
            kinds.setdefault(name, set()).add(kind)
    out = None
    for f in frames:
        f = f.select(*[F.col(f"`{c}`").cast("string").alias(c) if len(kinds[c]) > 1 else F.col(f"`{c}`") for c in f.columns])
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out


class CensusLoader:
    """The census: columns ``<table>.<code>`` of the tables that are asked for, by ``sa2_code``."""

    wants_columns = True

    def __init__(self, store: Store):
        self.store = store

    def catalogue(self, release: str | None = None) -> DataFrame | None:
        """What the data pack says its columns are."""
        return self.store.catalogue(int(release or self.store.year))

    def __call__(self, spark: SparkSession, release: str | None = None, columns: list[str] | None = None) -> DataFrame:
        from areaweave.operators.enrich import outer_concat

        found = self.store.datapack(int(release or self.store.year))
        wanted = sorted(found) if columns is None else list(dict.fromkeys(c.split(".", 1)[0] for c in columns))
        if lacking := [t for t in wanted if t not in found]:
            raise KeyError(f"the data pack has no tables {lacking}; near: {sorted({n for t in lacking for n in difflib.get_close_matches(t, found, 3, 0.6)})}")
        made = []
        for t in wanted:
            df = found[t]()
            made.append(df.select("sa2_code", *[F.col(f"`{c}`").alias(f"{t}.{c}") for c in df.columns if c != "sa2_code"]))
        return outer_concat(made, "sa2_code")


def registry_of(store: Store) -> Registry:
    """All datasets with their loaders over a store."""
    out = Registry()
    for spec in DATASETS:
        out.register_loader(spec.id, CensusLoader(store) if spec.id == "gcp" else DatasetLoader(store, spec.id, spec.level, spec.releases))
    return out
