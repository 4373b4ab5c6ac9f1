"""Address normalising and parsing as Column expressions, so that they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaweave.functions.columns import once

# Street-type abbreviations, further street types, and state names in the order they are replaced.
STREET_ABBREVIATIONS = {
    "ST": "STREET", "AVE": "AVENUE", "AV": "AVENUE", "RD": "ROAD", "BLVD": "BOULEVARD", "BVD": "BOULEVARD",
    "CT": "COURT", "CRT": "COURT", "DR": "DRIVE", "DRV": "DRIVE", "HWY": "HIGHWAY", "HWAY": "HIGHWAY",
    "LA": "LANE", "LN": "LANE", "PL": "PLACE", "TCE": "TERRACE", "TER": "TERRACE", "CR": "CRESCENT",
    "CRES": "CRESCENT", "CCT": "CIRCUIT", "CIR": "CIRCUIT", "CL": "CLOSE", "GR": "GROVE", "GRV": "GROVE",
    "PDE": "PARADE", "PWY": "PARKWAY", "PKWY": "PARKWAY", "WY": "WAY", "TR": "TRAIL", "TRL": "TRAIL", "MWY": "MOTORWAY",
}
MORE_STREET_TYPES = (
    "WALK", "PROMENADE", "ESPLANADE", "QUAY", "MEWS", "GARDENS", "GREEN", "SQUARE", "ROW", "LINK",
    "RISE", "VIEW", "VISTA", "BAY", "POINT", "RIDGE", "RUN", "GULLY", "GLEN", "HILL",
)
STATE_NAMES = {
    "NEW SOUTH WALES": "NSW", "VICTORIA": "VIC", "QUEENSLAND": "QLD", "WESTERN AUSTRALIA": "WA", "SOUTH AUSTRALIA": "SA",
    "TASMANIA": "TAS", "NORTHERN TERRITORY": "NT", "AUSTRALIAN CAPITAL TERRITORY": "ACT",
}

STREET_TYPES = sorted({*STREET_ABBREVIATIONS.values(), *MORE_STREET_TYPES})
NUMBER = r"^[0-9]+[A-Z]?(-[0-9]+[A-Z]?)?$"
POSTCODE = r"\b([0-9]{4})\s*$"
#: White space as Unicode has it.
SPACE = r"(?U)\s+"


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda t: t != "")


def normalize_address(c: Column) -> Column:
    """Upper case, punctuation to blanks, state names and street types to their standard forms; null is empty."""
    s = F.trim(F.regexp_replace(F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[,.;:!?]", " "), SPACE, " "))
    for name, short in STATE_NAMES.items():
        s = F.replace(s, F.lit(name), F.lit(short))
    known = F.create_map(*[F.lit(x) for pair in STREET_ABBREVIATIONS.items() for x in pair])
    return F.array_join(F.transform(tokens(s), lambda t: F.coalesce(F.try_element_at(known, t), t)), " ")


PARTS = ("unit_number", "street_number", "street_name", "street_type", "locality", "state", "postcode")


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value worked out once: its expression is not repeated where it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def parsed_address(c: Column) -> Column:
    """The parts of a normalised address as a struct; null if it has no number, name, locality and postcode."""
    blank = lambda x: F.nullif(F.trim(x), F.lit(""))

    def ending(a: Column) -> Column:
        last = F.get(a["t"], F.size(a["t"]) - 1)
        state = F.when(last.isin(*STATE_NAMES.values()), last)
        rest = F.when(state.isNotNull(), F.slice(a["t"], F.lit(1), F.greatest(F.size(a["t"]) - 1, F.lit(0)))).otherwise(a["t"])
        return F.struct(a["pc"].alias("pc"), state.alias("state"), rest.alias("t"))

    def front(b: Column) -> Column:
        first = F.get(b["t"], F.lit(0))
        slashed = F.contains(first, F.lit("/"))
        head, tail = F.substring_index(first, "/", 1), F.substring(first, F.instr(first, "/") + 1, F.length(first))
        unit = F.when(slashed & head.rlike("^(U?[0-9]+|U)$"), head)
        number = F.when(slashed, F.when(head.rlike("^(U?[0-9]+|U)$") & tail.rlike(NUMBER), tail)).when(first.rlike(NUMBER), first)
        at = F.array_max(F.transform(b["t"], lambda t, i: F.when(t.isin(*STREET_TYPES), i)))
        return F.struct(b["pc"].alias("pc"), b["state"].alias("state"), b["t"].alias("t"), unit.alias("unit"), number.alias("no"), at.alias("at"))

    def finished(d: Column) -> Column:
        taken = F.when(d["no"].isNotNull(), 1).otherwise(0)
        typed = d["at"].isNotNull() & (d["at"] >= taken)
        name = F.when(typed, blank(F.array_join(F.slice(d["t"], taken + 1, F.greatest(d["at"] - taken, F.lit(0))), " ")))
        rest = F.slice(d["t"], F.when(typed, d["at"] + 2).otherwise(taken + 1), F.size(d["t"]) + 1)
        locality = blank(F.array_join(rest, " "))
        values = (d["unit"], d["no"], name, F.get(d["t"], d["at"]), locality, d["state"], d["pc"])
        return F.struct(*[v.alias(n) for v, n in zip(values, PARTS)])

    pc = F.nullif(F.regexp_extract(c, POSTCODE, 1), F.lit(""))
    start = F.struct(pc.alias("pc"), tokens(F.regexp_replace(c, POSTCODE, "")).alias("t"))
    made = _let(start, lambda a: _let(ending(a), lambda b: _let(front(b), finished)))
    return _let(made, lambda p: F.when(F.coalesce(p["street_number"], p["street_name"], p["locality"], p["postcode"]).isNotNull(), p))


def parse_address(df: DataFrame, normalized: str, out: str = "parsed") -> DataFrame:
    """Add the parts of a normalised address, worked out once for each row."""
    return df.withColumn(out, once(parsed_address(F.col(normalized))))


def cache_key_text(c: Column) -> Column:
    """The form of an address under which results are cached: lower case, single blanks, no trailing marks."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), SPACE, " ")), r"(?U)[^\w]+$", "")


def cache_key(c: Column) -> Column:
    return F.sha2(cache_key_text(c), 256)
