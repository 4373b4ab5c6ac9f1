"""Secret scans with multipart credential linking, in DataFrame operations only.

Strong spans are found by pattern alone: assignments to secret names, access key identifiers, long hexadecimal runs.
Weak parts (identifiers such as user names, key-like tokens, endpoints) say little alone: an interval join links parts
that start within ``SCOPE`` code points of each other, and a weak part is reported only if its complement is there:
an identifier with a secret, a key-like token with an identifier, an endpoint with both.

The join is on the row and a bin of the start, each side first reduced to the least and greatest start of each bin
and role, so a text full of parts yields a few rows for each part and never pairs of parts.

Defined cases: null text is an empty text, without spans. Spans are code points, end exclusive; matches of a kind are
leftmost and do not overlap. A weak part that overlaps a strong span is left out. Every row has its own spans, so
repeated rows and ids do not mix; extra columns pass through, and a column named ``spans`` is replaced. Texts and runs of
any length are read in full. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaweave.llm._common import cut, text_or_empty

#: Code points between the starts of parts that may belong together.
SCOPE = 200

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The longest run is taken at its first letter, so asking for the length at once finds the same spans.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
IDENT = r"""(?i:\b(client_?id|access_?key(?:_?id)?|user(?:_?name)?|login|account))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.-]{3,})"""
#: A whole run of key-like letters with a digit and a capital, of any length; it may follow a name and ``=``, and is not
#: itself such a name. Possessive, so a run is read once.
KEY = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])[A-Za-z0-9+/_-]{20,}+=*+(?![A-Za-z0-9+/_-])"
ENDPOINT = r"""\b(?:https?|s3|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]+"""

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "ident", "key", "endpoint")
STRONG = 3
_SPAN = "array<struct<start:int,rank:int,end:int,byte_start:int,byte_end:int>>"


def _running(a: Column, f) -> Column:
    """Running sums (or maxima) of an array of numbers from 0 on, by doubling: O(n log n), no array grown bit by bit."""
    n = F.size(a)
    steps = F.filter(F.sequence(F.lit(0), F.lit(30)), lambda s: F.expr("1").cast("long") * F.pow(F.lit(2.0), s) < n)

    def step(acc, s):
        by = F.pow(F.lit(2.0), s).cast("int")
        return F.zip_with(acc, F.concat(F.array_repeat(F.lit(0), by), F.slice(acc, F.lit(1), F.size(acc) - by)), f)

    return F.aggregate(steps, a, step)


def _spans(text: Column, pattern: str, rank: int, group: int = 0, least: int = 0) -> Column:
    """Spans of all matches whose ``group`` has ``least`` characters; Spark gives matches and what lies between."""
    p = F.lit(pattern)
    found = F.regexp_extract_all(text, p, F.lit(0))
    between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))

    def placed(measure) -> tuple[Column, Column]:
        lengths, gaps = F.transform(found, measure), F.transform(between, measure)
        before = F.concat(F.array(F.lit(0)), F.slice(lengths, F.lit(1), F.greatest(F.size(lengths) - 1, F.lit(0))))
        return _running(F.zip_with(gaps, before, lambda a, b: a + b), lambda x, y: x + y), lengths

    # code points, and bytes by which a text can be cut without reading it from its start
    (starts, lengths), (at, size) = placed(lambda m: F.length(m)), placed(lambda m: F.octet_length(m))
    kept = F.regexp_extract_all(text, p, F.lit(group)) if group else found
    rows = F.arrays_zip(starts.alias("s"), lengths.alias("n"), F.transform(kept, lambda g: F.length(g)).alias("g"), at.alias("b"), size.alias("m"))
    good = F.filter(rows, lambda r: r["g"] >= least)
    made = F.transform(good, lambda r: F.struct(r["s"].alias("start"), F.lit(rank).alias("rank"), (r["s"] + r["n"]).alias("end"), r["b"].alias("byte_start"), (r["b"] + r["m"]).alias("byte_end")))
    return F.when(F.regexp_like(text, p), made.cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def find(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, scope: int = SCOPE) -> DataFrame:
    """Add ``spans``: array of (kind, start, end, byte_start, byte_end) by start, then kind; ``keep`` names the columns that go along."""
    names = [c for c in (keep if keep is not None else docs.columns) if c != "spans"]
    text = F.col("__text")
    parts = docs.select(*[F.col(f"`{c}`") for c in names], text_or_empty(f"`{text_col}`").alias("__text"))
    strong = F.array_sort(F.concat(_spans(text, ASSIGN, 0, 2, 6), _spans(text, ACCESS, 1), _spans(text, HEX, 2)))
    weak = F.concat(_spans(text, IDENT, 3), _spans(text, KEY, 4), _spans(text, ENDPOINT, 5))
    parts = parts.withColumn("__strong", strong).withColumn("__weak", weak).drop("__text")
    apart = F.filter("__weak", lambda x: ~F.exists("__strong", lambda s: (s["start"] < x["end"]) & (x["start"] < s["end"])))
    # the row number is written with the spans, so every later reading sees the same one
    rows = cut(parts.withColumn("__weak", apart).withColumn("__row", F.monotonically_increasing_id()), "secret-parts")

    # roles: identifiers are access keys (1) and names (3), secrets are assignments (0) and key-like tokens (4)
    role = F.when(F.col("p.rank").isin(1, 3), "i").when(F.col("p.rank").isin(0, 4), "s").otherwise("e")
    linked = rows.where(F.size("__weak") > 0)
    points = linked.select("__row", F.explode(F.concat("__strong", "__weak")).alias("p")).select("__row", F.col("p.start").alias("at"), role.alias("role"), "p")
    here = F.floor(F.col("at") / scope).cast("int")
    binned = points.where("role <> 'e'").groupBy("__row", "role", here.alias("bin")).agg(F.min("at").alias("low"), F.max("at").alias("high"))
    probes = points.where(F.col("p.rank") >= STRONG).select("__row", "at", "p", F.explode(F.array(here - 1, here, here + 1)).alias("bin"))
    near = probes.join(binned, ["__row", "bin"]).where((F.col("low") <= F.col("at") + scope) & (F.col("high") >= F.col("at") - scope))
    met = near.groupBy("__row", "p").agg(F.max(F.col("role") == "i").alias("i"), F.max(F.col("role") == "s").alias("s"))
    rank = F.col("p.rank")
    told = met.where(F.when(rank == 3, F.col("s")).when(rank == 4, F.col("i")).otherwise(F.col("i") & F.col("s")))
    told = told.groupBy("__row").agg(F.collect_list("p").alias("__told"))
    rows = rows.join(told, "__row", "left")
    all_ = F.array_sort(F.concat("__strong", F.coalesce("__told", F.array().cast(_SPAN))))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    spans = F.transform(all_, lambda s: F.struct(F.element_at(kinds, s["rank"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["byte_start"].alias("byte_start"), s["byte_end"].alias("byte_end")))
    return rows.select(*[F.col(f"`{c}`") for c in names], spans.alias("spans"))


def printed(spans: Column) -> Column:
    """Spans as ``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(df: DataFrame, text_col: str = "text", spans_col: str = "spans", mask: str = "[SECRET]") -> DataFrame:
    """Replace each run of code points covered by spans with ``mask``; a text without spans stays as it is.

    Spans come by start. A span opens a run if it starts where all before it have ended; the text between runs is cut
    out by bytes, each piece once, and joined by the mask.
    """
    text, spans = F.col(f"`{text_col}`"), F.col(f"`{spans_col}`")
    low, n = F.transform(spans, lambda s: s["byte_start"]), F.size(spans)
    high = _running(F.transform(spans, lambda s: s["byte_end"]), lambda x, y: F.greatest(x, y))
    before = F.concat(F.array(F.lit(0)), F.slice(high, F.lit(1), n - 1))
    after = F.concat(F.slice(low, F.lit(2), n - 1), F.array(F.octet_length(text)))
    rows = F.arrays_zip(low.alias("low"), high.alias("high"), before.alias("before"), after.alias("after"), F.sequence(F.lit(1), n).alias("k"))
    opens = F.transform(F.filter(rows, lambda r: r["low"] >= r["before"]), lambda r: r["low"])
    closes = F.transform(F.filter(rows, lambda r: (r["after"] >= r["high"]) | (r["k"] == n)), lambda r: r["high"])
    pieces = F.zip_with(F.concat(F.array(F.lit(0)), closes), F.concat(opens, F.array(F.octet_length(text))), lambda a, b: F.substring(text.cast("binary"), a + 1, b - a).cast("string"))
    return df.withColumn(text_col, F.when(n > 0, F.array_join(pieces, mask)).otherwise(text))
