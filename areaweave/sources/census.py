"""Census data packs: tables of an archive and the workbook that describes them."""

from __future__ import annotations

import csv
import io
import re
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areaweave.sources.files import csv_frame, read_on_executors, stored, workbook

#: Names under which a table may hold the area code.
CODE_COLUMNS = ("SA2_CODE_2021", "SA2_CODE21", "SA2_MAINCODE_2021", "SA2_CODE_2016", "SA2_CODE16", "SA2_MAINCODE_2016", "SA2_CODE", "region_id")
_TABLE = re.compile(r"(?:^|[^A-Za-z])(G\d+[A-Z]?)(?![A-Za-z0-9])")


def tables(archive: bytes) -> dict[str, str]:
    """Member name by table id."""
    with zipfile.ZipFile(io.BytesIO(archive)) as z:
        found = {}
        for name in z.namelist():
            if name.lower().endswith(".csv") and (m := _TABLE.search(name.rsplit("/", 1)[-1])):
                found.setdefault(m[1], name)
        return found


def table_of(path: str) -> str | None:
    """The table id in a file's name."""
    m = _TABLE.search(path.rsplit("/", 1)[-1])
    return m[1] if m else None


def read_table(spark: SparkSession, archive: bytes, table: str) -> DataFrame:
    """A table with ``sa2_code`` as text and numbers elsewhere (text where a column holds some)."""
    name = tables(archive).get(table)
    if name is None:
        raise KeyError(f"no table {table}")
    with zipfile.ZipFile(io.BytesIO(archive)) as z:
        return table_frame(spark, z.read(name))


def table_frame(spark: SparkSession, data: bytes) -> DataFrame:
    """A table's text with ``sa2_code`` and numbers."""
    df = csv_frame(spark, data, "utf-8-sig").drop("line_no")
    return _typed(df, df.columns)


def _typed(df: DataFrame, columns: list[str]) -> DataFrame:
    """``sa2_code`` as text and numbers elsewhere; rows without a code are no areas."""
    code = next((c for c in CODE_COLUMNS if c in columns), None)
    if code is None:
        raise ValueError(f"no area code column among {columns[:5]}")
    return df.where(F.col(code).isNotNull()).select(F.col(code).alias("sa2_code"), *[F.col(f"`{c}`").try_cast("double").alias(c) for c in columns if c != code])


def names_of(header: str) -> list[str]:
    """The column names in a header line."""
    return [c.strip() for c in next(csv.reader([header.removeprefix("\ufeff")]))]


def table_file(spark: SparkSession, path: str) -> DataFrame:
    """A table from an extracted file: a scan of the columns that are asked for; only the header line is read before."""
    head = spark.read.text(path).first()
    if head is None:
        raise ValueError(f"{path} is empty")
    names = names_of(head[0])
    return _typed(spark.read.csv(path, header=True, schema=", ".join(f"`{n}` string" for n in names)), names)


def extract(spark: SparkSession, archive: str, folder: str) -> None:
    """Write the tables of an archive as text files, parted by table, with their header lines beside them.

    An archive can be read from its end only, so one task opens it and passes its members on line by line.
    """

    def rows(data: bytes):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for table, name in tables(data).items():
                with z.open(name) as raw:
                    lines = csv.reader(io.TextIOWrapper(raw, "utf-8-sig", newline=""))
                    for k, cells in enumerate(lines):
                        if any(cells):
                            out = io.StringIO()
                            csv.writer(out, lineterminator="").writerow([c.replace("\n", " ").replace("\r", " ") for c in cells])
                            yield "header" if k == 0 else "rows", table, out.getvalue()

    read_on_executors(spark, archive, "part string, table_id string, value string", rows).write.mode("overwrite").partitionBy("part", "table_id").text(folder)


def headers(spark: SparkSession, folder: str) -> dict[str, list[str]]:
    """The columns of each extracted table; as many lines as there are tables."""
    return {r["table_id"]: names_of(r["value"]) for r in spark.read.option("basePath", f"{folder}/part=header").text(f"{folder}/part=header").select("table_id", "value").collect()}


def extracted_table(spark: SparkSession, folder: str, table: str, names: list[str]) -> DataFrame:
    """A table that `extract` has written."""
    at = f"{folder}/part=rows/table_id={table}"
    schema = ", ".join(f"`{n}` string" for n in names)
    return _typed(spark.read.csv(at, schema=schema) if stored(spark, at) else spark.createDataFrame([], schema), names)


#: The workbook that describes a data pack.
METADATA = re.compile(r"metadata.*gcp.*datapack.*\.xlsx$", re.I)
COLUMNS = "table_id string, pos long, code string, description string, table_name string"


def described(data: bytes, descriptor: str = "short-header") -> list[tuple]:
    """Rows of `COLUMNS` from a describing workbook: the sheet of columns, bridged to that of table names by table.

    The header row is the first one that names short, long and data pack file; the code is taken from the column that
    the kind of data pack uses. Tables in several files carry a letter (``G04A``) and the name of their number.
    """
    wanted = {"short-header": "short", "long-header": "long", "sequential": "sequential"}[descriptor]
    names: dict[str, str] = {}
    found: list[tuple] = []
    for grid in workbook(data).values():
        keys = [[re.sub(r"\s+", "", str(c or "")).lower() for c in r] for r in grid]
        cell = lambda r, k: str(r[k]).strip() if k is not None and k < len(r) and r[k] is not None else ""
        if (head := next((i for i, r in enumerate(keys) if {"tablenumber", "tablename"} <= set(r)), None)) is not None:
            number, name = keys[head].index("tablenumber"), keys[head].index("tablename")
            names |= {cell(r, number): cell(r, name) for r in grid[head + 1 :] if cell(r, number) and cell(r, name)}
        if (head := next((i for i, r in enumerate(keys) if {"short", "long", "datapackfile"} <= set(r)), None)) is None or wanted not in keys[head]:
            continue
        at = {k: keys[head].index(k) for k in keys[head] if k}
        text = at.get("columnheadingdescriptioninprofile", at["long"])
        for r in grid[head + 1 :]:
            if cell(r, at[wanted]) and (m := _TABLE.search(cell(r, at["datapackfile"]))):
                found.append((m[1], len(found), cell(r, at[wanted]), cell(r, text)))
    if not found:
        raise ValueError("no sheet has the columns short, long and data pack file")
    return [(*f, names.get(f[0]) or names.get(f[0].rstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "")) for f in found]


def describe(spark: SparkSession, data: bytes, descriptor: str = "short-header") -> DataFrame:
    """`COLUMNS` of a workbook in memory."""
    return spark.createDataFrame(described(data, descriptor), COLUMNS)


def catalogue(spark: SparkSession, path: str, descriptor: str = "short-header") -> DataFrame:
    """`COLUMNS` of a describing workbook, or of the one in an archive; without one there are no rows."""

    def rows(data: bytes):
        if path.lower().endswith(".zip"):
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                books = sorted(n for n in z.namelist() if METADATA.search(n))
                data = z.read(books[0]) if books else b""
        yield from described(data, descriptor) if data else ()

    return read_on_executors(spark, path, COLUMNS, rows)
