"""Text columns: headers, slugs, codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from areaweave.functions.address import STATE_NAMES


def header_key(c: Column) -> Column:
    """A header without any white space, in lower case."""
    return F.lower(F.regexp_replace(c, r"(?U)\s+", ""))


def recipients_column(c: Column) -> Column:
    """The column name of a payment: lower case words joined by ``_``, with ``_recipients`` at the end."""
    return F.concat(F.replace(F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " ")), F.lit(" "), F.lit("_")), F.lit("_recipients"))


def state_abbreviation(c: Column) -> Column:
    """A state's short name; of an unknown name its first three letters."""
    known = F.create_map(*[F.lit(x) for pair in STATE_NAMES.items() for x in pair])
    up = F.upper(F.trim(c))
    return F.coalesce(F.try_element_at(known, up), F.substring(up, 1, 3))


def without_prefix(c: Column, pattern: str | None) -> Column:
    return F.trim(F.regexp_replace(c, pattern, "")) if pattern else F.trim(c)


def plain_spaces(c: Column) -> Column:
    """Non-breaking blanks and en dashes as their plain forms."""
    return F.trim(F.replace(F.replace(c, F.lit(" "), F.lit(" ")), F.lit("–"), F.lit("-")))


def area_code(c: Column) -> Column:
    """A code that a sheet holds as a number, ``101021007.0``, as text."""
    return F.regexp_replace(F.trim(c.cast("string")), r"\.0+$", "")


def is_code(c: Column, digits: int) -> Column:
    """Whether a cell is a code of so many digits: keeps out totals, parents and footers."""
    return F.coalesce(F.trim(c).rlike(f"^[0-9]{{{digits}}}$"), F.lit(False))


def table_id(c: Column) -> Column:
    """The table (``G01``) named in a file name."""
    return F.nullif(F.regexp_extract(c, r"(?:^|[^A-Za-z])(G[0-9]+[A-Z]?)(?![A-Za-z0-9])", 1), F.lit(""))
