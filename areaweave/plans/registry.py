"""Datasets by namespace, and how a variable finds its table."""

from __future__ import annotations

import difflib
import logging
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areaweave.functions.temporal import Release, release

log = logging.getLogger(__name__)
CENSUS_TABLE = re.compile(r"^G\d+[A-Z]?$")
#: Words that a variable begins with if it is a preset.
PRESET = "PRESET"


class RegistryError(KeyError):
    pass


@dataclass(frozen=True)
class DatasetSpec:
    """What is known of a dataset: namespace, releases, the boundary edition of each, its columns."""

    id: str
    namespace: str
    basis: str | None = None
    releases: tuple[str, ...] = ()
    editions: dict[str, int] = field(default_factory=dict)
    columns: tuple[str, ...] = ()
    level: str = "SA2"

    def windows(self) -> list[Release]:
        return [release(r, self.basis) for r in self.releases] if self.basis else []

    @property
    def default_release(self) -> str | None:
        return max(self.releases) if self.releases else None


def _years(a: int, b: int) -> tuple[str, ...]:
    return tuple(str(y) for y in range(a, b + 1))


def _financial(a: int, b: int) -> tuple[str, ...]:
    return tuple(f"{y}-{(y + 1) % 100:02d}" for y in range(a, b + 1))


def _quarters(first: str, last: str) -> tuple[str, ...]:
    return tuple(q for q in (f"{y}-Q{n}" for y in range(2011, 2031) for n in range(1, 5)) if first <= q <= last)


_FY, _Q, _C = "financial_year_ending", "quarter_ending", "census_reference_date"
#: The datasets. A release without an edition counts as of the reference edition.
DATASETS = tuple(
    DatasetSpec(i, n, b, r, {x: e(x) for x in r}, (), lv)
    for i, n, b, r, e, lv in (
        ("gcp", "G", _C, ("2016", "2021"), lambda r: 2 if r == "2016" else 3, "SA2"),
        ("seifa", "SEIFA", _C, ("2011", "2016", "2021"), lambda r: {"2011": 1, "2016": 2}.get(r, 3), "SA2"),
        ("erp_by_sa2", "ERP", _FY, _years(2001, 2024), lambda r: 3, "SA2"),
        ("dss_payments", "DSS", _Q, _quarters("2022-Q4", "2025-Q3"), lambda r: 2 if r <= "2023-Q1" else 3, "SA2"),
        ("abs_personal_income", "ABS_PIA", _FY, _financial(2015, 2022), lambda r: 2 if r <= "2018-19" else 3, "SA2"),
        ("abs_building_approvals", "ABS_BA", _FY, _financial(2024, 2025), lambda r: 3, "SA2"),
        ("abs_building_approvals_lga", "ABS_BA_LGA", _FY, _financial(2024, 2025), lambda r: 3, "LGA"),
        ("abs_business_counts", "ABS_CAB", _FY, _years(2023, 2025), lambda r: 3, "SA2"),
        ("salm_labour_force", "SALM", _Q, ("2025-Q4",), lambda r: 3, "SA2"),
        ("aihw_mh_prescriptions", "AIHW_MHP", _FY, ("2024-25",), lambda r: 3, "SA4"),
        ("aihw_mh_admitted_patients", "AIHW_APC", _FY, ("2023-24",), lambda r: 3, "SA4"),
        ("aihw_mh_ed_presentations", "AIHW_ED", _FY, ("2023-24",), lambda r: 3, "SA4"),
        ("aihw_mh_medicare", "AIHW_MBS", _FY, ("2024-25",), lambda r: 3, "SA4"),
        ("aihw_mh_community", "AIHW_CMH", _FY, ("2023-24",), lambda r: 3, "SA4"),
        ("aihw_social_housing", "AIHW_SH", _FY, ("2023",), lambda r: 3, "SA4"),
    )
)

#: A loader gives a table with ``sa2_code`` (and the columns of its namespace) of a release; None: its default.
Loader = Callable[[SparkSession, str | None], DataFrame]


class Registry:
    """Specs and loaders by dataset id; the last registered of an id wins."""

    def __init__(self, specs=DATASETS):
        self.specs = {s.id: s for s in specs}
        self.loaders: dict[str, Loader] = {}

    def register_spec(self, spec: DatasetSpec) -> None:
        self.specs[spec.id] = spec

    def register_loader(self, id_: str, loader: Loader) -> None:
        if id_ not in self.specs:
            raise RegistryError(f"no dataset {id_!r}")
        self.loaders[id_] = loader

    def list_datasets(self) -> list[DatasetSpec]:
        return [self.specs[k] for k in sorted(self.specs)]

    def get(self, id_: str) -> DatasetSpec:
        if id_ not in self.specs:
            raise RegistryError(f"no dataset {id_!r}; there are {sorted(self.specs)}")
        return self.specs[id_]

    def resolve_variable(self, ref: str) -> tuple[DatasetSpec, str]:
        """The dataset and column of ``NAMESPACE.field``; a census table's field keeps its table."""
        namespace, _, column = ref.partition(".")
        for s in self.specs.values():
            if s.namespace == namespace:
                return s, column
        if CENSUS_TABLE.match(namespace):
            return self.get("gcp"), ref
        raise RegistryError(f"no dataset has the namespace {namespace!r}")

    def load(self, spark: SparkSession, id_: str, release_id: str | None = None, columns: list[str] | None = None) -> DataFrame:
        """A dataset's table; a loader that ``wants_columns`` is told which ones, so that it reads no others."""
        if id_ not in self.loaders:
            raise RegistryError(f"dataset {id_!r} has no loader")
        loader = self.loaders[id_]
        return loader(spark, release_id, columns) if getattr(loader, "wants_columns", False) else loader(spark, release_id)


    def load_releases(self, spark: SparkSession, id_: str, releases: list[str | None], columns: list[str] | None = None) -> tuple[DataFrame | None, list[str]]:
        """A dataset's table with a column ``release``, and the releases that are not to be had.

        A loader that has ``load_releases`` gives one table of all; of others each release is loaded, and nothing is read before
        the query runs.
        """
        loader = self.loaders.get(id_)
        if hasattr(loader, "load_releases"):
            return loader.load_releases(spark, releases)
        out, lacking = None, []
        for r in releases:
            try:
                one = self.load(spark, id_, r, columns).withColumn("release", F.lit(r or "default"))
            except FileNotFoundError:
                lacking.append(r)
                continue
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        return out, lacking


def parse_dataset_spec(text: str) -> DatasetSpec:
    """A dataset from a Markdown file: front matter, and the columns of its table of variables."""
    parts = text.split("---", 2)
    if len(parts) < 3 or parts[0].strip():
        raise ValueError("a dataset begins with front matter between --- lines")
    spec = yaml.safe_load(parts[1])
    t = spec.get("temporal") or {}
    found = tuple(dict.fromkeys(m[1] for m in re.finditer(rf"^\|\s*`{re.escape(spec['namespace'])}\.([A-Za-z0-9_]+)`", parts[2], re.M)))
    releases = tuple(str(r) for r in t.get("available_releases") or ())
    return DatasetSpec(spec["id"], spec["namespace"], t.get("cover_basis"), releases, {str(k): int(v) for k, v in (t.get("asgs_edition_by_release") or {}).items()}, found, spec.get("geography_level", "SA2"))


def read_specs(folder: Path, parse=parse_dataset_spec) -> list:
    """All specs of a folder; names that begin with ``_`` are templates, invalid files are logged and left out."""
    out = []
    for p in sorted(folder.glob("*.md")):
        if p.name.startswith("_"):
            continue
        try:
            out.append(parse(p.read_text(encoding="utf-8")))
        except (ValueError, KeyError, TypeError) as e:
            log.warning("left out %s: %s", p.name, e)
    return out


class CatalogError(ValueError):
    pass


class VariableCatalog:
    """Search and checks over a table of variables: ``table_id, pos, code, description``."""

    def __init__(self, columns: DataFrame):
        self.columns = columns

    def search(self, text: str, limit: int = 20) -> DataFrame:
        """Variables that hold a text, hits in the code before hits in the description, in catalogue order."""
        low = F.lower(F.lit(text))
        in_code, in_text = F.contains(F.lower("code"), low), F.contains(F.lower(F.coalesce("description", F.lit(""))), low)
        return self.columns.where(in_code | in_text).withColumn("rank", F.when(in_code, 0).otherwise(1)).orderBy("rank", "table_id", "pos", "code").limit(limit).select("table_id", "code", "description")

    def list_table(self, table: str) -> DataFrame:
        return self.columns.where(F.col("table_id") == table).orderBy("pos")

    def _known(self) -> dict[str, list[str]]:
        """Codes by table: a catalogue of column names, some tens of thousands at most."""
        return {r["table_id"]: r["codes"] for r in self.columns.groupBy("table_id").agg(F.collect_list("code").alias("codes")).collect()}

    def problems(self, refs: list[str]) -> list[str]:
        """What is wrong with references, with the nearest names."""
        known, out = self._known(), []
        for ref in refs:
            table, _, code = ref.partition(".")
            if table not in known:
                out.append(f"{ref}: no table {table}; near: {difflib.get_close_matches(table, known, 3, 0.6)}")
            elif code not in known[table]:
                out.append(f"{ref}: no column {code}; near: {difflib.get_close_matches(code, known[table], 3, 0.6)}")
        return out

    def validate_variables(self, refs: list[str]) -> None:
        if found := self.problems(refs):
            raise CatalogError("\n".join(found))

    def resolve(self, ref: str) -> tuple[str, str]:
        self.validate_variables([ref])
        table, _, code = ref.partition(".")
        return table, code
