"""Boundary editions: which file, code and name column belong to a census year and datum."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Edition:
    """The boundary file of an edition and its columns."""

    number: int
    year: int
    datum: str
    file: str
    code: str
    name: str


# Years and editions, names of files and columns, and the years of council boundaries.
YEARS = {2011: 1, 2016: 2, 2021: 3}
FILES = {1: "1270055001_sa2_2011_aust_shape.zip", 2: "1270055001_sa2_2016_aust_shape.zip", 3: "SA2_2021_AUST_SHP_{datum}.zip"}
COLUMNS = {1: ("SA2_MAIN11", "SA2_NAME11"), 2: ("SA2_MAIN16", "SA2_NAME16"), 3: ("SA2_CODE21", "SA2_NAME21")}
PARENT_SA4 = {1: "SA4_CODE11", 2: "SA4_CODE16", 3: "SA4_CODE21"}
LGA_YEARS = (2021, 2022, 2023, 2024, 2025)


def edition(year: int, datum: str = "GDA2020") -> Edition:
    """The edition of a census year; years before 2021 are published in GDA94 only."""
    if year not in YEARS:
        raise ValueError(f"no boundaries of {year}; there are {sorted(YEARS)}")
    if datum not in ("GDA2020", "GDA94") or (year < 2021 and datum != "GDA94"):
        raise ValueError(f"boundaries of {year} are not published in {datum}")
    n = YEARS[year]
    return Edition(n, year, datum, FILES[n].format(datum=datum), *COLUMNS[n])


def lga_edition(year: int | str = "latest") -> Edition:
    """Council boundaries of a year; ``latest`` is the last one known."""
    y = max(LGA_YEARS) if year == "latest" else int(year)
    if y not in LGA_YEARS:
        raise ValueError(f"no council boundaries of {year}; there are {LGA_YEARS}")
    return Edition(3, y, "GDA2020", f"LGA_{y}_AUST_GDA2020.zip", f"LGA_CODE{y % 100}", f"LGA_NAME{y % 100}")
