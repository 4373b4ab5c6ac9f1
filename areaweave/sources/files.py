"""Tables from files: text with an unknown encoding, archives, workbooks, boundary files."""

from __future__ import annotations

import io
import re
import struct
import time
import zipfile
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from pathlib import Path
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENCODINGS = ("utf-8-sig", "utf-8", "cp1252")
#: Spark reads Latin-1; the 27 places where Windows text differs are put right in the columns.
_SPARK_NAMES = {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "cp1252": "ISO-8859-1"}
_WINDOWS = {chr(b): bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A small file's bytes through Spark's own file systems, so any store will do."""
    rows = spark.read.format("binaryFile").load(path).select("content").take(2)
    if len(rows) != 1:
        raise FileNotFoundError(path)
    return bytes(rows[0]["content"])


def _at(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def stored(spark: SparkSession, path: str) -> bool:
    """Whether something lies at a path, in any store."""
    fs, at = _at(spark, path)
    return fs.exists(at)


def traits(spark: SparkSession, path: str) -> tuple[int, int] | None:
    """Length and time of change of a file in any store; None if it is not there."""
    fs, at = _at(spark, path)
    if not fs.exists(at):
        return None
    status = fs.getFileStatus(at)
    return status.getLen(), status.getModificationTime()


def read_small(spark: SparkSession, path: str) -> str:
    """A small text in any store."""
    fs, at = _at(spark, path)
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_small(spark: SparkSession, path: str, text: str) -> None:
    """Put a small text in place of whatever lies there."""
    fs, at = _at(spark, path)
    stream = fs.create(at, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def listed(spark: SparkSession, folder: str, suffix: str = "") -> list[str]:
    """The files right in a folder, by name; none if there is no such folder."""
    fs, at = _at(spark, folder)
    if not fs.exists(at):
        return []
    return sorted(s.getPath().toString() for s in fs.listStatus(at) if s.isFile() and s.getPath().getName().lower().endswith(suffix) and s.getPath().getName()[0] not in "._")


def folders(spark: SparkSession, folder: str) -> list[str]:
    """The names of the folders right in a folder."""
    fs, at = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()) if fs.exists(at) else []


def encoding_of(spark: SparkSession, path: str) -> str:
    """The first encoding that fits every line of a text; lines are tested where they lie, not on the driver."""
    raw = spark.read.format("text").option("lineSep", "\n").load(path).select(F.col("value").cast("binary").alias("b"))
    flawed = raw.where(~F.is_valid_utf8(F.col("b").cast("string"))).limit(1).count()
    if not flawed:
        head = raw.limit(1).collect()
        return "utf-8-sig" if head and bytes(head[0]["b"]).startswith(b"\xef\xbb\xbf") else "utf-8"
    holes = [b"\x81", b"\x8d", b"\x8f", b"\x90", b"\x9d"]
    bad = F.lit(False)
    for h in holes:
        bad = bad | F.contains(F.col("b"), F.lit(h))
    if raw.where(bad).limit(1).count():
        raise ValueError(f"{path} is in none of the encodings {', '.join(ENCODINGS)}")
    return "cp1252"


def read_csv(spark: SparkSession, path: str, infer: bool = True, **options) -> DataFrame:
    """A CSV file with a header, its encoding found by trial; a byte-order mark is no part of the first name."""
    encoding = encoding_of(spark, path)
    df = spark.read.csv(path, header=True, inferSchema=infer, encoding=_SPARK_NAMES[encoding], multiLine=True, escape='"', **options)
    df = df.toDF(*[c.removeprefix("\ufeff").translate(str.maketrans(_WINDOWS) if encoding == "cp1252" else {}) for c in df.columns])
    if encoding == "cp1252":
        text = [c for c, kind in df.dtypes if kind == "string"]
        df = df.withColumns({c: F.translate(F.col(f"`{c}`"), "".join(_WINDOWS), "".join(_WINDOWS.values())) for c in text})
    return df


def write_csv(df: DataFrame, path: str, order: str | None = None, one_file: bool = True) -> None:
    """A CSV table with a header and no row numbers, in the order of ``order``, which is left out.

    One file is what a person expects of a small result; ``one_file=False`` keeps the parts of a large one.
    """
    if order:
        df = df.orderBy(order).drop(order)
    (df.coalesce(1) if one_file else df).write.mode("overwrite").csv(path, header=True, escape='"')


def grid_frame(spark: SparkSession, grid: list[list], names: list[str], first: int, columns: list[int]) -> DataFrame:
    """Rows of a sheet as text columns; the line number goes along for "first of several"."""
    text = lambda v: None if v is None else (str(int(v)) if isinstance(v, float) and v.is_integer() else str(v))
    rows = [(i, *[text(r[c]) if c < len(r) else None for c in columns]) for i, r in enumerate(grid[first:])]
    return spark.createDataFrame(rows, "line_no long, " + ", ".join(f"`{n}` string" for n in names))


# -- workbooks --------------------------------------------------------------------------------------------------------

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _place(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def workbook(data: bytes) -> dict[str, list[list]]:
    """The sheets of an XLSX file as grids; cells are text, float, bool or None, rows as long as their last cell."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        strings: list[str] = []
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si"):
                strings.append("".join(t.text or "" for t in item.iter(f"{_MAIN}t")))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = {}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            target = targets[sheet.get(f"{_REL}id")].lstrip("/")
            root = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            grid: list[list] = []
            for row in root.iter(f"{_MAIN}row"):
                at = int(row.get("r", len(grid) + 1)) - 1
                grid.extend([] for _ in range(at + 1 - len(grid)))
                for k, cell in enumerate(row.iter(f"{_MAIN}c")):
                    col = _place(cell.get("r")) if cell.get("r") else k
                    line = grid[at]
                    line.extend([None] * (col + 1 - len(line)))
                    line[col] = _value(cell, strings)
            out[sheet.get("name")] = grid
        return out


def _value(cell, strings: list[str]):
    kind, v = cell.get("t"), cell.find(f"{_MAIN}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
    if v is None or v.text is None:
        return None
    if kind == "s":
        return strings[int(v.text)]
    if kind == "b":
        return v.text == "1"
    return v.text if kind in ("str", "e") else float(v.text)


def write_workbook(sheets: dict[str, list[list]]) -> bytes:
    """A small XLSX file of grids, for tests and exports."""
    from xml.sax.saxutils import escape, quoteattr

    def letter(c: int) -> str:
        return (letter(c // 26 - 1) if c >= 26 else "") + chr(65 + c % 26)

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        head = '<?xml version="1.0" encoding="UTF-8"?>'
        ns = f'xmlns="{_MAIN[1:-1]}" xmlns:r="{_REL[1:-1]}"'
        z.writestr("xl/workbook.xml", f"{head}<workbook {ns}><sheets>" + "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f"{head}<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, grid in enumerate(sheets.values(), 1):
            lines = []
            for r, row in enumerate(grid, 1):
                cells = [f'<c r="{letter(c)}{r}"><v>{v}</v></c>' if isinstance(v, (int, float)) else f'<c r="{letter(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>' for c, v in enumerate(row) if v is not None]
                lines.append(f'<row r="{r}">{"".join(cells)}</row>')
            z.writestr(f"xl/worksheets/s{i}.xml", f"{head}<worksheet {ns}><sheetData>{''.join(lines)}</sheetData></worksheet>")
    return buffer.getvalue()


# -- archives ---------------------------------------------------------------------------------------------------------


def zip_member(data: bytes, parts: tuple[str, ...], suffix: str = ".csv") -> bytes:
    """The first member whose name, in lower case, holds all parts and has the suffix."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for name in z.namelist():
            low = name.lower()
            if low.endswith(suffix) and all(p in low for p in parts):
                return z.read(name)
    raise FileNotFoundError(f"no {suffix} member with {parts}")


def csv_frame(spark: SparkSession, data: bytes, encoding: str = "utf-8", skip_to: str | None = None) -> DataFrame:
    """A CSV text in memory as text columns with ``line_no``; ``skip_to``: the header is the line that begins so."""
    import csv

    text = data.decode(encoding, errors="replace" if skip_to else "strict").removeprefix("﻿")
    lines = list(csv.reader(io.StringIO(text)))
    start = 0
    if skip_to is not None:
        start = next((i for i, r in enumerate(lines) if r and r[0].strip().startswith(skip_to)), -1)
        if start < 0:
            raise ValueError(f"no line begins with {skip_to!r}")
    names = [c.strip() for c in lines[start]]
    rows = [(i, *[(r[k] if k < len(r) else None) or None for k in range(len(names))]) for i, r in enumerate(lines[start + 1 :]) if any(r)]
    return spark.createDataFrame(rows, "line_no long, " + ", ".join(f"`{n}` string" for n in names))


# -- boundary files ---------------------------------------------------------------------------------------------------


def read_dbf(data: bytes, encoding: str = "utf-8") -> list[dict[str, str | None]]:
    """The records of a dBASE file, as stripped text."""
    count, head, size = struct.unpack("<IHH", data[4:12])
    fields, at = [], 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode(), data[at + 16]))
        at += 32
    out = []
    for i in range(count):
        rec, k, row = data[head + i * size : head + (i + 1) * size], 1, {}
        if rec[:1] == b"*":
            continue
        for name, width in fields:
            row[name] = rec[k : k + width].decode(encoding, errors="replace").strip() or None
            k += width
        out.append(row)
    return out


def read_shp(data: bytes) -> list[list[list[tuple[float, float]]] | None]:
    """The rings of each shape of a polygon file; None for a shape without geometry."""
    out, at = [], 100
    while at < len(data):
        (length,) = struct.unpack(">i", data[at + 4 : at + 8])
        body = data[at + 8 : at + 8 + 2 * length]
        at += 8 + 2 * length
        (kind,) = struct.unpack("<i", body[:4])
        if kind not in (5, 15, 25):
            out.append(None)
            continue
        parts, points = struct.unpack("<ii", body[36:44])
        starts = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), points]
        flat = struct.unpack(f"<{2 * points}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * points])
        out.append([[(flat[2 * i], flat[2 * i + 1]) for i in range(a, b)] for a, b in zip(starts, starts[1:])])
    return out


def boundaries(spark: SparkSession, archive: bytes, code_column: str, name_column: str) -> DataFrame:
    """``code, name, rings`` and further attributes (as a map) of a zipped boundary file."""
    shapes = read_shp(zip_member(archive, (), ".shp"))
    records = read_dbf(zip_member(archive, (), ".dbf"))
    rows = [(r.get(code_column), r.get(name_column), s and [[{"x": x, "y": y} for x, y in ring] for ring in s], r) for r, s in zip(records, shapes)]
    return spark.createDataFrame(rows, "code string, name string, rings array<array<struct<x:double,y:double>>>, attributes map<string,string>")


#: Rows that a reader hands on at once.
BATCH = 2000


def read_on_executors(spark: SparkSession, path: str, schema: str, rows: Callable) -> DataFrame:
    """The rows (tuples) that ``rows(bytes of the file)`` yields, read and parsed where Spark puts the file."""
    from itertools import batched

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                for part in batched(rows(content.as_py()), BATCH):
                    yield pa.RecordBatch.from_arrays([pa.array(v, kinds.field(k).type) for k, v in enumerate(zip(*part))], schema=kinds)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def boundary_file(spark: SparkSession, path: str, code_column: str, name_column: str) -> DataFrame:
    """`boundaries` of a file in any store; the archive never passes the driver."""

    def rows(archive: bytes):
        shapes, records = read_shp(zip_member(archive, (), ".shp")), read_dbf(zip_member(archive, (), ".dbf"))
        for r, s in zip(records, shapes):
            yield r.get(code_column), r.get(name_column), s and [[{"x": x, "y": y} for x, y in ring] for ring in s], list(r.items())

    return read_on_executors(spark, path, "code string, name string, rings array<array<struct<x:double,y:double>>>, attributes map<string,string>", rows)


def mesh_block_file(spark: SparkSession, path: str) -> DataFrame:
    """`mesh_blocks` of a file in any store."""

    def rows(archive: bytes):
        records = read_dbf(zip_member(archive, (), ".dbf"))
        columns = mesh_columns(list(records[0]) if records else [])
        for r in records:
            if r[columns[0]]:
                yield tuple(r[c] for c in columns)

    return read_on_executors(spark, path, "mb_code string, sa2_code string, sa2_name string", rows)


def mesh_columns(names: list[str]) -> tuple[str, str, str]:
    """The columns of block, area and area name; of several years the highest suffix."""

    def column(pattern: str) -> str:
        found = sorted(n for n in names if re.fullmatch(pattern, n, re.I))
        if not found:
            raise ValueError(f"no column like {pattern} among {names}")
        return found[-1]

    return column(r"MB_CODE\d*"), column(r"SA2_(CODE|MAIN|MAINCODE_)\d*"), column(r"SA2_NAME\d*")


def mesh_blocks(spark: SparkSession, archive: bytes) -> DataFrame:
    """``mb_code, sa2_code, sa2_name`` from the attributes alone; of several years the highest suffix wins."""
    records = read_dbf(zip_member(archive, (), ".dbf"))
    mb, code, name = mesh_columns(list(records[0]) if records else [])
    return spark.createDataFrame([(r[mb], r[code], r[name]) for r in records if r[mb]], "mb_code string, sa2_code string, sa2_name string")


# -- network helpers --------------------------------------------------------------------------------------------------

#: Answers after which a request is tried again.
RETRY_STATUS = (502, 503, 504)


def with_retry(get: Callable[[], tuple[int, bytes]], tries: int = 3, wait: Callable[[float], None] = time.sleep) -> bytes:
    """A request's body; tried again after connection errors, timeouts and some answers, waiting 1, 2, 4 s."""
    for k in range(tries + 1):
        try:
            status, body = get()
        except (ConnectionError, TimeoutError):
            if k == tries:
                raise
            status = None
        else:
            if status < 400:
                return body
            if status not in RETRY_STATUS or k == tries:
                raise RuntimeError(f"request failed with status {status}")
        wait(2.0**k)
    raise AssertionError("unreachable")


def resume_file(path: Path, size: int, body: Callable[[], bytes]) -> Path:
    """Write a download once: a file of the right size is kept, a new one is put in place when complete."""
    if path.exists() and path.stat().st_size == size:
        return path
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_suffix(path.suffix + ".tmp")
    part.write_bytes(body())
    part.replace(path)
    return path


def page_links(pages: DataFrame, html: str, pattern: str) -> DataFrame:
    """The links of HTML pages whose address fits a pattern, with the release that its first group names."""
    links = F.regexp_extract_all(F.col(html), F.lit(r"""href\s*=\s*["']([^"']+)["']"""), F.lit(1))
    each = pages.select("*", F.explode(links).alias("link")).where(F.col("link").rlike(pattern))
    return each.withColumn("release", F.regexp_extract("link", pattern, 1))


@dataclass(frozen=True)
class ReleaseRule:
    """How a landing page names the releases of a dataset: ``pattern`` finds the link, its first group the release.

    ``keep`` is what of the group counts: all of it, or what stands before its first hyphen. Of several links of one
    release that of the rule with the lower ``precedence`` counts, then the first on the page.
    """

    dataset: str
    pattern: str
    keep: str = "all"
    precedence: int = 0


# Links on the landing pages of the publishers.
RELEASE_RULES = (
    ReleaseRule("erp_by_sa2", r"(?i)regional-population/(\d{4}-\d{2,4})/[^\"']*DS0003[^\"']*\.xlsx", "first year"),
    ReleaseRule("abs_personal_income", r"(?i)personal-income-australia/(\d{4}-\d{2,4})/[^\"']*Table%201[^\"']*\.xlsx"),
    ReleaseRule("abs_business_counts", r"(?i)counts-australian-businesses[^\"']*/[a-z]{3}\d{4}-[a-z]{3}(\d{4})/[^\"']*\.xlsx"),
    ReleaseRule("abs_building_approvals", r"(?i)building-approvals[^\"']*/([a-z]{3}-\d{4})/[^\"']*\.xlsx"),
)


def page_releases(pages: DataFrame, html: str, rules: Sequence[ReleaseRule] = RELEASE_RULES, key: str | None = None) -> DataFrame:
    """``dataset, release, link`` (with ``key``, of each page) of all links that a rule fits, one for each release."""
    links = F.regexp_extract_all(F.col(html), F.lit(r"""(?i)href\s*=\s*["']([^"']+)["']"""), F.lit(1))
    keys = [key] if key else []
    each = pages.select(*keys, F.posexplode(links).alias("at", "link"))

    def release(r: ReleaseRule):
        found = F.regexp_extract("link", r.pattern, 1)
        return F.substring_index(found, "-", 1) if r.keep == "first year" else found

    hits = F.array(*[F.when(F.col("link").rlike(r.pattern), F.struct(F.lit(r.dataset).alias("dataset"), release(r).alias("release"), F.lit(r.precedence).alias("precedence"))) for r in rules])
    met = each.withColumn("r", F.explode(F.array_compact(hits))).select(*keys, "at", "link", "r.*")
    return met.groupBy(*keys, "dataset", "release").agg(F.min_by("link", F.struct("precedence", "at")).alias("link"))


def newest_release(found: DataFrame, key: str | None = None, wanted: str = "latest") -> DataFrame:
    """Of each dataset (and page) the newest release, or the one that is wanted; releases ascend as text."""
    keys = [key, "dataset"] if key else ["dataset"]
    if wanted != "latest":
        return found.where(F.col("release") == wanted).select(*keys, "release", "link")
    return found.groupBy(*keys).agg(F.max(F.struct("release", "link")).alias("r")).select(*keys, "r.*")


def latest_resource(resources: DataFrame, json: str) -> DataFrame:
    """The newest resource of a catalogue answer (a JSON text with ``result.resources``): by quarter, then change."""
    from areaweave.functions.temporal import month_quarter

    schema = "result struct<resources: array<struct<name:string,url:string,format:string,last_modified:string>>>"
    each = resources.select(F.explode(F.from_json(json, schema)["result"]["resources"]).alias("r")).select("r.*")
    label = F.regexp_extract(F.lower("name"), r"((?:mar|jun|sep|dec)[a-z]* \d{4})", 1)
    dated = each.withColumn("release", month_quarter(label)).where("release is not null")
    return dated.groupBy().agg(F.max_by(F.struct("release", "name", "url", "last_modified"), F.struct("release", F.coalesce("last_modified", F.lit("")))).alias("r")).select("r.*")
