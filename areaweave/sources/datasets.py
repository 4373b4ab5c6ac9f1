"""Parsers of published workbooks and text files to tables keyed by area code.

Sheets are a few thousand rows: their layout is found on the driver, and the cells then go through Column
expressions, so that every rule of coercion is the same in all of them.
"""

from __future__ import annotations

import logging
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from areaweave.functions.coerce import number, text_or_number, typed
from areaweave.functions.temporal import month_quarter
from areaweave.functions.text import area_code, is_code, plain_spaces, recipients_column, state_abbreviation, without_prefix
from areaweave.operators.enrich import outer_join_shared, require_unique, union_states
from areaweave.operators.pivot import first_values, group_sums
from areaweave.sources.files import csv_frame, grid_frame, zip_member

log = logging.getLogger(__name__)
Grid = list[list]


class LayoutError(ValueError):
    """A file does not look as its parser expects."""


def _sheet(sheets: dict[str, Grid], name: str) -> Grid:
    if name not in sheets:
        raise LayoutError(f"no sheet {name!r} among {list(sheets)}")
    return sheets[name]


def _low(v) -> str:
    return "" if v is None else " ".join(str(v).split()).lower()


def _row_where(grid: Grid, test, rows: int, what: str) -> int:
    for i, r in enumerate(grid[:rows]):
        if test(r):
            return i
    raise LayoutError(f"no {what} in the first {rows} rows")


def _coded(df: DataFrame, digits: int = 9, name: str = "sa2_code") -> DataFrame:
    """Rows whose code has so many digits; an error if there are none."""
    out = df.withColumn(name, area_code(F.col(name))).where(is_code(F.col(name), digits))
    if not out.limit(1).count():
        raise LayoutError(f"no rows with a code of {digits} digits")
    return out


# -- socio-economic indexes -------------------------------------------------------------------------------------------

# Sheets of the indexes, and the columns of a sheet (4 and 8 are blank).
SEIFA_SHEETS = {"Table 2": "irsd", "Table 3": "irsad", "Table 4": "ier", "Table 5": "ieo"}
SEIFA_COLUMNS = {
    "sa2_code": 0, "sa2_name": 1, "urp": 2, "score": 3, "aus_rank": 5, "aus_decile": 6, "aus_percentile": 7,
    "state_abbreviation": 9, "state_rank": 10, "state_decile": 11, "state_percentile": 12, "sa1_min": 13, "sa1_max": 14, "pct_urp_no_score": 15,
}
SEIFA_HEADERS = ("Statistical Area Level 2 (SA2) 9-Digit", "SA2 9-Digit", "SA2 9 Digit")


def seifa(spark: SparkSession, sheets: dict[str, Grid]) -> DataFrame:
    """Four indexes side by side; population and state are shared, from the first. Legacy files come as grids too."""
    tables = []
    for name, index in SEIFA_SHEETS.items():
        if name not in sheets:
            continue
        grid = sheets[name]
        head = next((i for i, r in enumerate(grid[:15]) if any(h in " ".join(str(c) for c in r if c is not None) for h in SEIFA_HEADERS)), 5)
        df = _coded(grid_frame(spark, grid, list(SEIFA_COLUMNS), head + 1, list(SEIFA_COLUMNS.values())))
        named = {c: c if c in ("urp", "state_abbreviation") else f"{index}_{c}" for c in SEIFA_COLUMNS if c != "sa2_code"}
        textual = ("sa2_name", "state_abbreviation")
        texts = {c: F.col(c) for c in named if c in textual}
        plain = typed(df, [c for c in named if c not in texts], "seifa")
        tables.append(df.select("sa2_code", *[(text_or_number(texts[c], "seifa") if c in texts else plain[c]).alias(n) for c, n in named.items()]))
    if not tables:
        raise LayoutError("no index sheet")
    return outer_join_shared(tables, "sa2_code")


# -- population -------------------------------------------------------------------------------------------------------

AGE_SEX = ("population_male", "population_female", "median_age", "population_0_14", "population_15_64", "population_65_plus")


def erp_totals(spark: SparkSession, sheets: dict[str, Grid]) -> DataFrame:
    """Population by year: code in column 8, years from column 10 on; the last year is the total."""
    grid = _sheet(sheets, "Table 1")
    year = lambda v: int(v) if isinstance(v, (int, float)) and 1900 < v < 2100 else int(v) if isinstance(v, str) and re.fullmatch(r"\s*(19|20)\d\d\s*", v) else None
    head = _row_where(grid, lambda r: any(year(v) for v in r[10:]), 10, "row of years")
    years = {year(v): i for i, v in enumerate(grid[head]) if i >= 10 and year(v)}
    names = [f"population_history_{y}" for y in years]
    df = _coded(grid_frame(spark, grid, ["state", "sa2_code", *names], head + 1, [1, 8, *years.values()]))
    last = max(years)
    return df.select(
        "sa2_code", state_abbreviation(F.coalesce("state", F.lit(""))).alias("state_abbreviation"), F.lit(last).alias("reference_year"),
        number(F.col(f"population_history_{last}"), "erp").alias("population_total"), *[number(F.col(n), "erp").alias(n) for n in names],
    )


def erp_age_sex(spark: SparkSession, sheets: dict[str, Grid]) -> DataFrame:
    """Sexes, median age, and three age bands counted from their percentages (halves to even)."""
    grid = _sheet(sheets, "Table 1")
    names = {"sa2_code": 8, "male": 10, "female": 11, "persons": 12, "median_age": 14, "p0": 15, "p15": 16, "p65": 17}
    df = _coded(grid_frame(spark, grid, list(names), 0, list(names.values())))
    n = lambda c: number(F.col(c), "erp")
    share = lambda c: band(n("persons"), n(c))
    return df.select("sa2_code", n("male").alias("population_male"), n("female").alias("population_female"), n("median_age").alias("median_age"), share("p0").alias("population_0_14"), share("p15").alias("population_15_64"), share("p65").alias("population_65_plus"))


def band(persons: Column, percent: Column) -> Column:
    """Persons in an age band, from its percentage; halves go to the even number."""
    return F.bround(persons * percent / 100, 0).cast("long")


def erp(totals: DataFrame, age_sex: DataFrame | None = None, areas: DataFrame | None = None, year: int | None = None) -> DataFrame:
    """Population with age and sex, and density where areas (km2) are known; an earlier year has totals alone."""
    out = totals.join(age_sex, "sa2_code", "left") if age_sex is not None else totals
    latest = totals.select("reference_year").first()
    if year is not None and latest is not None and year != latest[0]:
        column = f"population_history_{year}"
        if column not in out.columns:
            raise LayoutError(f"no population of {year}")
        out = out.withColumn("population_total", F.col(column)).withColumn("reference_year", F.lit(year))
        out = out.withColumns({c: F.lit(None).cast(out.schema[c].dataType) for c in AGE_SEX if c in out.columns})
    return out if areas is None else with_density(out, areas)


def with_density(df: DataFrame, areas: DataFrame) -> DataFrame:
    """Persons by km2; null where an area is unknown or has no extent."""
    return df.join(areas.select(F.col("code").alias("sa2_code"), "area"), "sa2_code", "left").withColumn("population_density_per_km2", F.try_divide("population_total", "area")).drop("area")


# -- payments, income, businesses -------------------------------------------------------------------------------------


def code_map(boundaries: DataFrame) -> DataFrame:
    """``short, sa2_code``: five-digit codes of the areas with their nine-digit ones, from the boundaries' attributes.

    A boundary file may have the short code as a column; else it is the digit of the state and the last four of the code.
    A short code that two areas share stands for neither.
    """
    named = F.map_filter("attributes", lambda k, v: F.upper(k).rlike("^SA2_5DIG"))
    short = F.coalesce(F.get(F.map_values(named), F.lit(0)), F.concat(F.substring("code", 1, 1), F.substring("code", 6, 4)))
    pairs = boundaries.where(F.length("code") == 9).select(short.alias("short"), F.col("code").alias("sa2_code")).distinct()
    return pairs.groupBy("short").agg(F.min("sa2_code").alias("sa2_code"), F.count("*").alias("n")).where("n = 1").drop("n")


def long_codes(df: DataFrame, short_codes: DataFrame, name: str = "sa2_code") -> DataFrame:
    """The table with nine-digit codes in place of the five-digit ones that are known."""
    known = short_codes.select(F.col("short").alias("__short"), F.col("sa2_code").alias("__long"))
    return df.join(known, F.col(name) == F.col("__short"), "left").withColumn(name, F.coalesce("__long", name)).drop("__short", "__long")


def dss(spark: SparkSession, sheets: dict[str, Grid], quarter: str, short_codes: DataFrame | None = None) -> DataFrame:
    """Recipients by payment. Codes of five digits are turned to nine by ``short_codes (short, sa2_code)``; unknown ones go."""
    grid = _sheet(sheets, "SA2")
    head = _row_where(grid, lambda r: len(r) > 1 and _low(r[0]) == "sa2" and "name" in _low(r[1]), 15, "header of areas")
    labels = [(i, str(v).strip()) for i, v in enumerate(grid[head]) if i >= 2 and v is not None and str(v).strip()]
    names = [r[0] for r in spark.createDataFrame([(v,) for _, v in labels], "v string").select(recipients_column(F.col("v"))).collect()]
    df = grid_frame(spark, grid, ["sa2_code", *names], head + 1, [0, *[i for i, _ in labels]]).withColumn("sa2_code", area_code(F.col("sa2_code")))
    if short_codes is not None:
        df = long_codes(df, short_codes)
        if unknown := df.where(is_code(F.col("sa2_code"), 5)).count():
            log.warning("payments of %s: %s five-digit codes have no area and are left out", quarter, unknown)
    df = _coded(df)
    plain = typed(df, names, "dss", "long")
    return df.select("sa2_code", *[plain[n].alias(n) for n in names], F.lit(quarter).alias("release_quarter"))


# Groups of the income sheet and their columns.
PIA_GROUPS = {
    "Earners (persons)": "income_earners_count", "Median age of earners (years)": "median_age_of_earners", "Sum ($)": "sum_total_income",
    "Median ($)": "median_total_income", "Mean ($)": "mean_total_income",
}


def pia(spark: SparkSession, sheets: dict[str, Grid], year: str | None = None) -> DataFrame:
    """Personal income: of each group the column of the year asked for, or its last."""
    grid = _sheet(sheets, "Table 1.4")
    head = _row_where(grid, lambda r: any(_low(v) in {g.lower() for g in PIA_GROUPS} for v in r), 10, "row of groups")
    starts = [(i, str(v).strip()) for i, v in enumerate(grid[head]) if v is not None and str(v).strip() in PIA_GROUPS]
    years, chosen = grid[head + 1], {}
    for (i, label), end in zip(starts, [*[s for s, _ in starts[1:]], len(years)]):
        found = {str(years[j]).strip(): j for j in range(i, min(end, len(years))) if years[j] is not None and re.fullmatch(r"\d{4}-\d{2}", str(years[j]).strip())}
        if found and (year is None or year in found):
            chosen[PIA_GROUPS[label]] = found[year or max(found, key=found.get)], year or max(found, key=found.get)
    if not chosen:
        raise LayoutError(f"no column of {year}")
    df = _coded(grid_frame(spark, grid, ["sa2_code", *chosen], head + 2, [0, *[i for i, _ in chosen.values()]]))
    return df.select("sa2_code", *[number(F.col(c), "pia").alias(c) for c in chosen], F.lit(next(iter(chosen.values()))[1]).alias("reference_financial_year"))


# Employment bands of the business sheet, in the order of its columns from 4 on.
CAB_HEADERS = ("non employing", "1-4", "5-19", "20-199", "200+", "total")
CAB_COLUMNS = (
    "business_count_non_employing", "business_count_1_4_employees", "business_count_5_19_employees", "business_count_20_199_employees",
    "business_count_200_plus_employees", "business_count_total",
)


def businesses(spark: SparkSession, grid: Grid, period: str) -> DataFrame:
    """Businesses by size, summed over industries; the title has to name the areas and the period."""
    title = " ".join(_low(v) for r in grid[:8] for v in r)
    if "sa2" not in title and "statistical area level 2" not in title or period.lower() not in title:
        raise LayoutError(f"the title does not name areas and {period}")
    fits = lambda r: len(r) >= 10 and all(_low(r[4 + k]).replace("–", "-").startswith(h) for k, h in enumerate(CAB_HEADERS))
    head = _row_where(grid, fits, 15, "header of employment bands")
    df = _coded(grid_frame(spark, grid, ["sa2_code", *CAB_COLUMNS], head + 1, [2, *range(4, 10)]))
    numbers = df.select("sa2_code", *[number(F.col(c), "cab", "long").alias(c) for c in CAB_COLUMNS])
    return group_sums(numbers, "sa2_code", list(CAB_COLUMNS)).withColumn("reference_period", F.lit(period))


# -- building approvals -----------------------------------------------------------------------------------------------

# The nine metrics and how their headers begin.
BA_COLUMNS = (
    "new_houses_count", "new_other_residential_building_count", "total_dwellings_count", "value_new_houses", "value_new_other_residential_building",
    "value_alterations_additions_conversions", "value_total_residential_building", "value_non_residential_building", "value_total_building",
)
BA_HEADERS = (
    "new houses", "new other residential", "total dwellings", "value of new houses", "value of new other residential", "value of alterations",
    "value of total residential", "value of non-residential", "value of total building",
)


def _approvals(spark: SparkSession, grid: Grid, digits: int, key: str) -> DataFrame:
    hits = lambda r: sum(any(_low(v).startswith(h) for v in r) for h in BA_HEADERS)
    head = _row_where(grid, lambda r: hits(r) >= 4, 15, "header of metrics")
    for k, h in enumerate(BA_HEADERS):
        if len(grid[head]) <= 2 + k or not _low(grid[head][2 + k]).startswith(h):
            raise LayoutError(f"column {2 + k} should begin with {h!r}")
    df = grid_frame(spark, grid, [key, *BA_COLUMNS], head + 1, [0, *range(2, 11)])
    df = df.withColumn(key, area_code(F.col(key))).where(is_code(F.col(key), digits))
    return df.select(key, *[number(F.col(c), "ba", "long" if c.endswith("_count") else "double").alias(c) for c in BA_COLUMNS])


def building_approvals(spark: SparkSession, cubes: list[dict[str, Grid]], year: str, lga: bool = False) -> DataFrame:
    """Approvals of all state cubes; an area in two of them is an error."""
    key, digits, sheet = ("lga_code", 5, "Table 1") if lga else ("sa2_code", 9, "Table_1")
    tables = [_approvals(spark, _sheet(c, sheet), digits, key) for c in cubes]
    out = require_unique(union_states(tables), [key])
    if not out.limit(1).count():
        raise LayoutError("all state cubes are empty")
    return out.withColumn("reference_financial_year", F.lit(year))


# -- labour force -----------------------------------------------------------------------------------------------------

# Data items and their columns.
SALM_ITEMS = {
    "Smoothed unemployment (persons)": "smoothed_unemployment_count", "Smoothed labour force (persons)": "smoothed_labour_force_count",
    "Smoothed unemployment rate (%)": "smoothed_unemployment_rate",
}


def labour_force(spark: SparkSession, data: bytes, quarter: str) -> DataFrame:
    """Smoothed labour market figures of the last quarter of the file, which has to be the one asked for."""
    df = csv_frame(spark, data, "utf-8-sig", skip_to="Data Item")
    quarters = [c for c in df.columns if re.fullmatch(r"[A-Za-z]{3}-\d{2}", c)]
    if not quarters:
        raise LayoutError("no column of a quarter")
    found = spark.range(1).select(month_quarter(F.lit(quarters[-1]))).first()[0]
    if found != quarter:
        raise LayoutError(f"the file ends with {found}, not {quarter}")
    long = df.select(F.col("SA2 Code (2021 ASGS)").alias("sa2_code"), F.col("Data Item").alias("item"), F.col(f"`{quarters[-1]}`").alias("value"), "line_no")
    long = _coded(long).withColumn("value", number(F.col("value"), "salm"))
    wide = first_values(long, "sa2_code", "item", "value", SALM_ITEMS, "line_no")
    for c in list(SALM_ITEMS.values())[:2]:
        wide = wide.withColumn(c, F.col(c).cast("long"))
    return wide.withColumn("reference_period", F.lit(quarter))


# -- health -----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class HealthSource:
    """How a health table is cut from its archive and turned to columns by region of level 4."""

    members: tuple[str, ...]
    measures: dict[str, str]
    counts: tuple[str, ...]
    filters: dict[str, str]
    code: str = "GeographicAreaCode"
    prefix: str | None = "^SA4"
    measure: str = "Measure"
    value: str = "Value"
    year: str | None = "FinancialYear"
    encoding: str = "cp1252"
    spaces: tuple[str, ...] = field(default=())


# The five health tables.
HEALTH = {
    "aihw_mh_prescriptions": HealthSource(
        ("prescriptions phn and sa4",),
        {"Patients": "mh_patients_count", "Patient rate per 1,000 population": "mh_patient_rate_per_1000", "Prescriptions": "mh_prescriptions_count", "Prescription rate per 1,000 population": "mh_prescription_rate_per_1000"},
        ("mh_patients_count", "mh_prescriptions_count"),
        {"GeographicAreaType": "SA4", "Demographic": "Total", "DemographicCategory": "Total"},
    ),
    "aihw_mh_admitted_patients": HealthSource(
        ("phn_sa4",),
        {
            "Hospitalisations": "mh_hospitalisations_count", "Patient days": "mh_patient_days_count", "Psychiatric care days": "mh_psychiatric_care_days_count", "Procedures": "mh_procedures_count",
            "Hospitalisations per 10,000 population": "mh_hospitalisations_per_10000", "Patient days per 10,000 population": "mh_patient_days_per_10000",
            "Psychiatric care days per 10,000 population": "mh_psychiatric_care_days_per_10000", "Procedures per 10,000 population": "mh_procedures_per_10000",
        },
        ("mh_hospitalisations_count", "mh_patient_days_count", "mh_psychiatric_care_days_count", "mh_procedures_count"),
        {"GeographicAreaType": "SA4", "SeparationType": "Total"},
        year=None, encoding="utf-8",
    ),
    "aihw_mh_ed_presentations": HealthSource(
        ("phn_sa4",),
        {"Number": "mh_ed_presentations_count", "Rate (per 10,000 population)": "mh_ed_presentations_per_10000"},
        ("mh_ed_presentations_count",),
        {"GeographicAreaType": "SA4", "PresentationType": "Mental health-related presentations"},
    ),
    "aihw_mh_medicare": HealthSource(
        ("phn", "sa4"),
        {"Patients": "mh_medicare_patients_count", "Patient rate per 1,000 population": "mh_medicare_patient_rate_per_1000", "Services": "mh_medicare_services_count", "Service rate per 1,000 population": "mh_medicare_service_rate_per_1000"},
        ("mh_medicare_patients_count", "mh_medicare_services_count"),
        {"GeographicAreaType": "SA4", "ProviderType": "All providers"},
        prefix="^SA4-", spaces=("ProviderType",),
    ),
    "aihw_mh_community": HealthSource(
        ("geospatial",),
        {
            "Number of patients": "mh_community_patients_count", "Number of patients per 10,000 population": "mh_community_patients_per_10000", "Number of contacts": "mh_community_contacts_count",
            "Number of contacts per 10,000 population": "mh_community_contacts_per_10000", "Number of treatment days per three-month period": "mh_community_treatment_days_per_3mo",
            "Average length of treatment (days)": "mh_community_avg_treatment_length_days", "Population": "mh_community_population",
        },
        ("mh_community_patients_count", "mh_community_contacts_count", "mh_community_population"),
        {"GeospatialType": "SA4", "DemographicCategory": "Total", "DemographicVariable": "Total"},
        code="GeospatialDivisionCode", prefix=None, measure="MeasureName", value="MeasureValue",
    ),
}


def all_equal(df: DataFrame, wanted: dict[str, Column]) -> DataFrame:
    """The rows that meet all conditions (by the column they are about), counted in one pass.

    If none is left, an error tells which column leaves nothing and what values it has.
    """
    both, steps = F.lit(True), {}
    for column, test in wanted.items():
        both = both & F.coalesce(test, F.lit(False))
        steps[column] = both
    if steps:
        left = df.agg(*[F.count_if(t).alias(f"c{k}") for k, t in enumerate(steps.values())]).first()
        for k, column in enumerate(steps):
            if not left[f"c{k}"]:
                raise ValueError(f"no rows with the {column} that is asked for; there are {[r[0] for r in df.select(F.col(f'`{column}`')).distinct().limit(10).collect()]}")
    return df.where(both)


def health(spark: SparkSession, archive: bytes, source: HealthSource, year: str) -> DataFrame:
    """``sa4_code`` and the measures of one financial year; a filter that leaves nothing tells what there is."""
    df = csv_frame(spark, zip_member(archive, source.members), source.encoding)
    needed = {source.code, source.measure, source.value, *source.filters, *([source.year] if source.year else [])}
    if lacking := sorted(needed - set(df.columns)):
        raise LayoutError(f"the table lacks {lacking}")
    df = df.withColumns({c: plain_spaces(F.col(c)) for c in source.spaces})
    wanted = {c: F.col(f"`{c}`") == F.lit(v) for c, v in source.filters.items()}
    if source.year:
        wanted[source.year] = plain_spaces(F.col(f"`{source.year}`")) == plain_spaces(F.lit(year))
    try:
        df = all_equal(df, wanted)
    except ValueError as e:
        raise LayoutError(str(e)) from e
    df = df.withColumn("sa4_code", without_prefix(F.col(source.code), source.prefix)).withColumn("__value", number(F.col(source.value), "aihw"))
    wide = first_values(df, "sa4_code", source.measure, "__value", source.measures, "line_no")
    wide = wide.withColumns({c: F.col(c).cast("long") for c in source.counts})
    return wide.withColumn("reference_financial_year", F.lit(year))


# Columns 3 to 6 of the dwellings sheet and how their headers begin.
HOUSING_HEADERS = ("public housing", "somih", "community housing", "total")
HOUSING_COLUMNS = ("social_housing_public_count", "social_housing_somih_count", "social_housing_community_count", "social_housing_total_count")


def social_housing(spark: SparkSession, sheets: dict[str, Grid], period: str) -> DataFrame:
    """Dwellings by region of level 4; the title has to name the level and the period."""
    grid = _sheet(sheets, "DWELLINGS.4")
    title = " ".join(_low(v) for r in grid[:5] for v in r)
    if not ("sa4" in title or "statistical area level 4" in title) or period.lower() not in title:
        raise LayoutError(f"the title does not name SA4 and {period}")
    head = _row_where(grid, lambda r: len(r) > 1 and _low(r[1]) == "region code", 15, "header of region codes")
    for k, h in enumerate(HOUSING_HEADERS):
        if len(grid[head]) <= 3 + k or not _low(grid[head][3 + k]).startswith(h):
            raise LayoutError(f"column {3 + k} should begin with {h!r}")
    df = _coded(grid_frame(spark, grid, ["sa4_code", *HOUSING_COLUMNS], head + 1, [1, *range(3, 7)]), 3, "sa4_code")
    return df.select("sa4_code", *[number(F.col(c), "social_housing", "long").alias(c) for c in HOUSING_COLUMNS], F.lit(period).alias("reference_period"))
