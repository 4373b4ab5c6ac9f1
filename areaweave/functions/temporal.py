"""Release windows and the choice of a release for a date."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = ("census_reference_date", "financial_year_ending", "calendar_year_ending", "quarter_ending")


@dataclass(frozen=True)
class Release:
    """A published vintage and the days it covers."""

    id: str
    start: date
    end: date

    @property
    def midpoint(self) -> date:
        return self.start + timedelta((self.end - self.start).days // 2)


def release(release_id: str, basis: str) -> Release:
    """The days that a release covers: a census day (1 August), a year, or a quarter."""
    rid = release_id.strip()
    year = re.fullmatch(r"\d{4}", rid)
    if basis == "quarter_ending":
        if not (m := re.fullmatch(r"(\d{4})-Q([1-4])", rid)):
            raise ValueError(f"release {rid!r} of basis {basis} must look like 2024-Q3")
        y, q = int(m[1]), int(m[2])
        after = date(y + (q == 4), q * 3 % 12 + 1, 1)
        return Release(rid, date(y, 3 * q - 2, 1), after - timedelta(1))
    if basis == "financial_year_ending" and (m := re.fullmatch(r"(\d{4})-(\d{2})", rid)):
        first = int(m[1])
        last = first // 100 * 100 + int(m[2])
        return Release(rid, date(first, 7, 1), date(last + 100 * (last < first), 6, 30))
    if basis not in BASES or not year:
        raise ValueError(f"release {rid!r} does not suit basis {basis!r}")
    y = int(rid)
    if basis == "census_reference_date":
        return Release(rid, date(y, 8, 1), date(y, 8, 1))
    if basis == "financial_year_ending":
        return Release(rid, date(y - 1, 7, 1), date(y, 6, 30))
    return Release(rid, date(y, 1, 1), date(y, 12, 31))


def month_release(yyyymm: str) -> Release:
    """A monthly release of the address corpus, dated to the first of its month."""
    d = date(int(yyyymm[:4]), int(yyyymm[4:]), 1)
    return Release(yyyymm, d, d)


class OutOfRange(ValueError):
    """Dates before every release, where that is not allowed."""


def pick_release(day: Column, releases: list[Release], rule: str = "closest_at_or_before", out_of_range: str = "fail") -> Column:
    """The id of the release for each date, as one expression over constants; null dates have none.

    ``closest_at_or_before``: the latest window that starts by the date. ``closest``: the nearest midpoint, the
    earlier start of two as near. Only the first rule has dates out of range, those before all windows:
    null under ``fail`` (callers count them and raise), the first release under ``nearest``.
    """
    known = sorted(releases, key=lambda r: (r.start, r.id))
    if not known:
        return F.lit(None).cast("string")
    if rule == "closest":
        near = [F.struct(F.abs(F.datediff(day, F.lit(r.midpoint))).alias("d"), F.lit(i).alias("i")) for i, r in enumerate(known)]
        best = F.array_min(F.array(*near))["i"]
        chosen = F.element_at(F.array(*[F.lit(r.id) for r in known]), best + 1)
    else:
        chosen = F.when(F.lit(False), F.lit(None).cast("string"))
        for r in reversed(known):
            chosen = chosen.when(day >= F.lit(r.start), F.lit(r.id))
        if out_of_range == "nearest":
            chosen = chosen.when(day < F.lit(known[0].start), F.lit(known[0].id))
    return F.when(day.isNotNull(), chosen)


def to_day(c: Column, kind: str) -> Column:
    """A date column from a date, timestamp or ISO text; the time of day is dropped."""
    return F.to_date(c) if kind in ("date", "timestamp", "timestamp_ntz") else F.try_to_timestamp(c).cast("date")


def month_quarter(c: Column) -> Column:
    """``Dec-25`` or ``December 2025`` as ``2025-Q4``; null for other text."""
    m = F.regexp_extract(F.lower(F.trim(c)), r"^(mar|jun|sep|dec)[a-z]*[- ](\d{2,4})$", 1)
    y = F.regexp_extract(F.lower(F.trim(c)), r"^(mar|jun|sep|dec)[a-z]*[- ](\d{2,4})$", 2)
    q = F.when(m == "mar", "Q1").when(m == "jun", "Q2").when(m == "sep", "Q3").when(m == "dec", "Q4")
    return F.when(q.isNotNull(), F.concat(F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y), F.lit("-"), q))


def complete_financial_year(published: date) -> str:
    """The last financial year that was complete when something was published: ``2023-24``."""
    end = published.year if published.month >= 7 else published.year - 1
    return f"{end - 1}-{end % 100:02d}"


def complete_financial_year_of(published: Column) -> Column:
    """`complete_financial_year` of a date column."""
    end = F.year(published) - F.when(F.month(published) >= 7, 0).otherwise(1)
    return F.concat((end - 1).cast("string"), F.lit("-"), F.lpad((end % 100).cast("string"), 2, "0"))


def midpoint(start: Column, end: Column) -> Column:
    return F.date_add(start, F.floor(F.datediff(end, start) / 2).cast("int"))
