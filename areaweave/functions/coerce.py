"""Published cells to numbers: what a publisher writes for "no value" becomes null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marks of missing and suppressed cells.
BASIC = ("np", "na", "n/a", "-", "..", ".", "")
WITH_NULLS = (*BASIC, "nan", "null")
SENTINELS = {
    "seifa": WITH_NULLS,
    "erp": ("np", "na", "n/a", "-", "..", ".", ""),
    "dss": (*WITH_NULLS, "<20"),
    "pia": (*WITH_NULLS, "<5"),
    "ba": WITH_NULLS,
    "cab": WITH_NULLS,
    "social_housing": (*WITH_NULLS, ". .", "n.a."),
    "salm": (),
    "aihw": (),
}
NUMBER = r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$"


def missing(c: Column, source: str) -> Column:
    return F.lower(F.trim(c)).isin(*SENTINELS[source]) if SENTINELS[source] else F.trim(c) == ""


def number(c: Column, source: str, kind: str = "double") -> Column:
    """A cell as a number; null for marks of missing values and for what isn't a number (thousands marks aside)."""
    text = F.replace(F.trim(c.cast("string")), F.lit(","), F.lit(""))
    if source == "social_housing":
        text = F.replace(text, F.lit(" "), F.lit(""))
    value = F.when(text.rlike(NUMBER), text).try_cast("double")
    value = F.when(F.isnan(value), None).otherwise(value)
    return F.when(missing(c.cast("string"), source), None).otherwise(value.cast("long") if kind == "long" else value)


def text_or_number(c: Column, source: str) -> Column:
    """A cell of a column that may hold text: missing marks are null, anything else stays, numbers in plain form."""
    return F.when(missing(c.cast("string"), source), None).otherwise(F.trim(c.cast("string")))


def unparsed(c: Column, source: str) -> Column:
    """Whether a cell is neither missing nor a number."""
    return c.isNotNull() & ~missing(c.cast("string"), source) & number(c, source).isNull()


def typed(df: DataFrame, columns: list[str], source: str, kind: str = "double") -> dict[str, Column]:
    """Columns of a sheet as numbers; a column with a cell that is neither missing nor a number stays text."""
    if not columns:
        return {}
    odd = df.agg(*[F.coalesce(F.bool_or(unparsed(F.col(f"`{c}`"), source)), F.lit(False)).alias(c) for c in columns]).first()
    return {c: text_or_number(F.col(f"`{c}`"), source) if odd[c] else number(F.col(f"`{c}`"), source, kind) for c in columns}


def no_nan(c: Column) -> Column:
    """NaN as null, for double columns."""
    return F.when(F.isnan(c), None).otherwise(c)
