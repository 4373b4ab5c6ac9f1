"""Registered queries of the functions on cells, texts, dates and figures, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from areaweave.functions import coerce, geometry, temporal, text
from areaweave.functions.address import STATE_NAMES
from areaweave.operators import asof, downscale, enrich, spatial
from areaweave.plans.queries import _EDGES, _VALUES, _WEIGHTS, SQL, Q, _t, _tiles, _values, _weights, _windows_sql, query
from areaweave.sources import datasets
from areaweave.sources.files import page_links
from areaweave.sources.sidecars import weight_summary

# -- texts ------------------------------------------------------------------------------------------------------------


@query(r"SELECT p_partkey, lower(regexp_replace(p_type||' '||p_name, '\s+', '', 'g')) AS header FROM part")
def header_keys(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", text.header_key(F.concat_ws(" ", "p_type", "p_name")).alias("header"))


_STATES = sorted(STATE_NAMES)
_STATE_SQL = "CASE c_custkey%10 " + " ".join(f"WHEN {k} THEN '{n.title()}'" for k, n in enumerate(_STATES)) + " ELSE c_name END"
_SHORT_SQL = "CASE upper(trim(s)) " + " ".join(f"WHEN '{n}' THEN '{a}'" for n, a in STATE_NAMES.items()) + " ELSE substr(upper(trim(s)), 1, 3) END"


@query(f"SELECT c_custkey, {_SHORT_SQL} AS state FROM (SELECT c_custkey, {_STATE_SQL} AS s FROM customer)")
def state_abbreviations(spark, sf):
    name = F.col("c_name")
    for k, n in enumerate(_STATES):
        name = F.when(F.col("c_custkey") % 10 == k, n.title()).otherwise(name)
    return _t(spark, sf, "customer").select("c_custkey", text.state_abbreviation(name).alias("state"))


@query(r"SELECT s_suppkey, trim(regexp_replace('SA4-'||s_suppkey||' ', '^SA4-', '')) AS dashed, trim(regexp_replace('SA4'||s_suppkey, '^SA4', '')) AS plain, s_name AS kept FROM supplier")
def code_prefixes(spark, sf):
    key = F.col("s_suppkey").cast("string")
    return _t(spark, sf, "supplier").select("s_suppkey", text.without_prefix(F.concat(F.lit("SA4-"), key, F.lit(" ")), "^SA4-").alias("dashed"), text.without_prefix(F.concat(F.lit("SA4"), key), "^SA4").alias("plain"), text.without_prefix(F.col("s_name"), None).alias("kept"))


@query("SELECT p_partkey, trim(replace(replace(' '||replace(p_name, ' ', chr(160))||'–'||p_size||chr(160), chr(160), ' '), '–', '-')) AS label FROM part")
def plain_blanks(spark, sf):
    nbsp = F.lit(" ")
    return _t(spark, sf, "part").select("p_partkey", text.plain_spaces(F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), nbsp), F.lit("–"), F.col("p_size"), nbsp)).alias("label"))


@query(r"SELECT o_orderkey, regexp_replace(trim(CASE WHEN o_orderkey%3=0 THEN o_orderkey||'.0' WHEN o_orderkey%3=1 THEN ' '||o_orderkey||' ' ELSE o_orderkey||'.50' END), '\.0+$', '') AS code FROM orders")
def number_cells_as_codes(spark, sf):
    k = F.col("o_orderkey").cast("string")
    cell = F.when(F.col("o_orderkey") % 3 == 0, F.concat(k, F.lit(".0"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit(" "), k, F.lit(" "))).otherwise(F.concat(k, F.lit(".50")))
    return _t(spark, sf, "orders").select("o_orderkey", text.area_code(cell).alias("code"))


@query(r"SELECT p_partkey, CASE WHEN p_size%3=2 THEN NULL ELSE 'G'||lpad(CAST(p_size AS VARCHAR), 2, '0')||(CASE WHEN p_size%3=1 THEN 'A' ELSE '' END) END AS table_id FROM part")
def table_ids(spark, sf):
    size = F.lpad(F.col("p_size").cast("string"), 2, "0")
    name = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("2021Census_G"), size, F.lit("_AUS_SA2"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("x-G"), size, F.lit("A.csv"))).otherwise(F.concat(F.lit("LG"), size, F.lit("ab.csv")))
    return _t(spark, sf, "part").select("p_partkey", text.table_id(name).alias("table_id"))


for _digits, _name in ((5, "code_filter_lga"), (3, "code_filter_sa4")):

    def _code_query(spark, sf, digits=_digits):
        k = F.col("c_custkey")
        code = F.when(k % 3 == 0, F.lpad(k.cast("string"), digits, "1")).when(k % 3 == 1, F.concat(k.cast("string"), F.lit("x"))).otherwise(k.cast("string"))
        return _t(spark, sf, "customer").where(text.is_code(code, digits)).select("c_custkey")

    Q[_name] = _code_query
    SQL[_name] = rf"SELECT c_custkey FROM customer WHERE regexp_full_match(CASE WHEN c_custkey%3=0 THEN lpad(CAST(c_custkey AS VARCHAR), {_digits}, '1') WHEN c_custkey%3=1 THEN c_custkey||'x' ELSE CAST(c_custkey AS VARCHAR) END, '[0-9]{{{_digits}}}')"

# -- cells ------------------------------------------------------------------------------------------------------------

_MARKS = ("np", "NA", " n/a", "-", "..", ".", "", "nan", "null", "<20", "<5", ". .", "n.a.")
_MARK_SQL = "CASE o_orderkey%16 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(_MARKS)) + " WHEN 13 THEN CAST(o_orderkey AS VARCHAR) WHEN 14 THEN '-'||o_orderkey||'.25' ELSE '1,'||lpad(CAST(o_orderkey%1000 AS VARCHAR), 3, '0') END"


def _cell():
    k, out = F.col("o_orderkey"), None
    for i, m in enumerate(_MARKS):
        out = F.when(k % 16 == i, m) if out is None else out.when(k % 16 == i, m)
    return out.when(k % 16 == 13, k.cast("string")).when(k % 16 == 14, F.concat(F.lit("-"), k.cast("string"), F.lit(".25"))).otherwise(F.concat(F.lit("1,"), F.lpad((k % 1000).cast("string"), 3, "0")))


def _number_sql(source: str) -> str:
    marks = ", ".join(f"'{m}'" for m in (coerce.SENTINELS[source] or ("",)))
    body = "replace(replace(trim(c), ',', ''), ' ', '')" if source == "social_housing" else "replace(trim(c), ',', '')"
    return f"CASE WHEN lower(trim(c)) IN ({marks}) OR NOT regexp_matches({body}, '^-?[0-9]+([.][0-9]+)?$') THEN NULL ELSE CAST({body} AS DOUBLE) END"


for _source in ("erp", "pia", "ba", "cab", "social_housing", "salm", "aihw"):

    def _coerced(spark, sf, source=_source):
        return _t(spark, sf, "orders").select("o_orderkey", coerce.number(_cell(), source).alias("value"), coerce.number(_cell(), source, "long").alias("whole"))

    Q[f"coerce_{_source}"] = _coerced
    SQL[f"coerce_{_source}"] = f"SELECT o_orderkey, value, CAST(trunc(value) AS BIGINT) AS whole FROM (SELECT o_orderkey, {_number_sql(_source)} AS value FROM (SELECT o_orderkey, {_MARK_SQL} AS c FROM orders))"

_TEXT_SQL = "CASE WHEN lower(trim(c)) IN ({}) THEN NULL ELSE trim(c) END"
for _source in ("seifa", "dss"):

    def _kept_text(spark, sf, source=_source):
        """A column with cells that are neither missing nor numbers stays text; one without becomes a number."""
        k = F.col("o_orderkey")
        df = _t(spark, sf, "orders").select("o_orderkey", F.when(k % 7 == 1, "see note").when(k % 7 == 2, " n/a ").otherwise(k.cast("string")).alias("a"), F.when(k % 7 == 2, "np").otherwise(k.cast("string")).alias("b"))
        made = coerce.typed(df, ["a", "b"], source)
        return df.select("o_orderkey", made["a"].alias("a"), made["b"].alias("b"))

    Q[f"typed_columns_{_source}"] = _kept_text
    SQL[f"typed_columns_{_source}"] = "SELECT o_orderkey, CASE WHEN o_orderkey%7=1 THEN 'see note' WHEN o_orderkey%7=2 THEN NULL ELSE CAST(o_orderkey AS VARCHAR) END AS a, CASE WHEN o_orderkey%7=2 THEN NULL ELSE CAST(o_orderkey AS DOUBLE) END AS b FROM orders"

# -- dates ------------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, (year(o_orderdate)-CASE WHEN month(o_orderdate)>=7 THEN 1 ELSE 2 END)||'-'||lpad(CAST((year(o_orderdate)-CASE WHEN month(o_orderdate)>=7 THEN 0 ELSE 1 END)%100 AS VARCHAR), 2, '0') AS fy FROM orders")
def complete_financial_years(spark, sf):
    return _t(spark, sf, "orders").select("o_orderkey", temporal.complete_financial_year_of(F.to_date("o_orderdate")).alias("fy"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey%3=2 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS from_text, CAST(o_orderdate AS DATE) AS from_time FROM orders")
def dates_of_any_kind(spark, sf):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    written = F.when(F.col("o_orderkey") % 3 == 0, day).when(F.col("o_orderkey") % 3 == 1, F.concat(day, F.lit("T13:45:00"))).otherwise("no date")
    return _t(spark, sf, "orders").select("o_orderkey", temporal.to_day(written, "string").alias("from_text"), temporal.to_day(F.col("o_orderdate"), "timestamp").alias("from_time"))


_MONTHS = [temporal.month_release(f"{y}{m:02d}") for y in range(1996, 2001) for m in (2, 5, 8, 11)]


@query(f"WITH {_windows_sql(_MONTHS)} SELECT o_orderkey, coalesce((SELECT arg_max(release, start_) FROM w WHERE start_<=CAST(o_orderdate AS DATE)), '199602') AS release FROM orders")
def corpus_release_of_date(spark, sf):
    days = _t(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return asof.asof_release(days, "day", _MONTHS, out_of_range="nearest").select("o_orderkey", "release")


_DAILY = [temporal.Release(f"{y}-{m:02d}", temporal.date(y, m, 1), temporal.date(y, m, 28)) for y in range(1995, 2002) for m in range(1, 13)]


@query(f"WITH {_windows_sql(_DAILY)}, d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), r AS (SELECT day, release, row_number() OVER (PARTITION BY day ORDER BY abs(date_diff('day', mid, day)), start_) AS n FROM d, w) SELECT o_orderkey, release FROM orders JOIN r ON day=CAST(o_orderdate AS DATE) AND n=1")
def asof_closest_of_many_releases(spark, sf):
    days = _t(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return asof.asof_release(days, "day", _DAILY, "closest").select("o_orderkey", "release")


# -- figures ----------------------------------------------------------------------------------------------------------


@query("SELECT l_suppkey, CAST(round_even(persons*pct/100.0, 0) AS BIGINT) AS band FROM (SELECT l_suppkey, count(*) AS persons, (l_suppkey%41)*2.5 AS pct FROM lineitem GROUP BY 1)")
def age_band_counts(spark, sf):
    g = _t(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").cast("double").alias("persons")).withColumn("pct", (F.col("l_suppkey") % 41) * F.lit(2.5))
    return g.select("l_suppkey", datasets.band(F.col("persons"), F.col("pct")).alias("band"))


@query(f"WITH {_EDGES}, a AS (SELECT code, abs(sum(x1*y2-x2*y1)/2) AS area FROM edges GROUP BY code), p AS (SELECT lpad(CAST(c_nationkey AS VARCHAR), 9, '0') AS sa2_code, count(*) AS population_total FROM customer GROUP BY 1) SELECT sa2_code, population_total, round(population_total/CASE WHEN sa2_code<'000000020' THEN area END, 9) AS density FROM p LEFT JOIN a ON code=sa2_code")
def population_density(spark, sf):
    p = _t(spark, sf, "customer").groupBy(F.lpad(F.col("c_nationkey").cast("string"), 9, "0").alias("sa2_code")).agg(F.count("*").alias("population_total"))
    a = spatial.areas(_tiles(spark, sf), project=False).where("code < '000000020'")
    return datasets.with_density(p, a).select("sa2_code", "population_total", F.round("population_density_per_km2", 9).alias("density"))


@query("WITH t AS (SELECT lpad(CAST(c_nationkey AS VARCHAR), 9, '0') AS sa2_code, count(*) AS population_total, 2 AS population_history_2022, 1 AS y FROM customer GROUP BY c_nationkey), a AS (SELECT lpad(CAST(s_nationkey AS VARCHAR), 9, '0') AS sa2_code, count(*) AS population_male FROM supplier GROUP BY s_nationkey) SELECT sa2_code, population_total, population_male FROM t LEFT JOIN a USING (sa2_code)")
def totals_with_age_and_sex(spark, sf):
    code = lambda c: F.lpad(F.col(c).cast("string"), 9, "0").alias("sa2_code")
    totals = _t(spark, sf, "customer").groupBy(code("c_nationkey")).agg(F.count("*").alias("population_total")).withColumn("reference_year", F.lit(2023))
    ages = _t(spark, sf, "supplier").groupBy(code("s_nationkey")).agg(F.count("*").alias("population_male"))
    return datasets.erp(totals, ages, None, 2023).select("sa2_code", "population_total", "population_male")


_NINE = [f"n{k}" for k in range(1, 10)]


@query(f"WITH {_WEIGHTS}, {_VALUES} SELECT sa2_code, " + ", ".join(f"round(sum({k}*n*sa2_share_of_lga), 4) AS n{k}" for k in range(1, 10)) + " FROM weights JOIN v USING (lga_code) GROUP BY sa2_code")
def downscale_nine_columns(spark, sf):
    values = _values(spark, sf).select("lga_code", *[(F.col("n") * k).alias(f"n{k}") for k in range(1, 10)])
    return downscale.counts(_weights(spark, sf), values, _NINE).select("sa2_code", *[F.round(c, 4).alias(c) for c in _NINE])


@query(f"WITH {_WEIGHTS} SELECT count(*) AS pairs, count(DISTINCT sa2_code) AS sa2s, count(DISTINCT lga_code) AS lgas FROM weights")
def correspondence_counts(spark, sf):
    return weight_summary(_weights(spark, sf))


@query(f"WITH {_WEIGHTS}, known AS (SELECT 'B'||s_nationkey AS lga_code FROM supplier UNION SELECT 'ZZ' ) SELECT lga_code FROM known WHERE lga_code NOT IN (SELECT lga_code FROM weights)")
def councils_without_areas(spark, sf):
    known = _t(spark, sf, "supplier").select(F.concat(F.lit("B"), F.col("s_nationkey").cast("string")).alias("lga_code")).unionByName(spark.range(1).select(F.lit("ZZ").alias("lga_code")))
    return enrich.missing_keys(known, "lga_code", _weights(spark, sf), "lga_code")


_Q_SQL = "(1-{e2})*(sin(radians(lat))/(1-{e2}*sin(radians(lat))*sin(radians(lat)))-ln((1-{e}*sin(radians(lat)))/(1+{e}*sin(radians(lat))))/(2*{e}))".format(e2=repr(geometry._E2), e=repr(geometry._E))
_PLANE = f"""q AS (SELECT *, {_Q_SQL} AS q, ({geometry._N!r})*radians(lon-{geometry.ORIGIN_LON!r}) AS theta FROM v),
r AS (SELECT *, {geometry.SEMI_MAJOR!r}*sqrt(({geometry._C!r})-({geometry._N!r})*q)/({geometry._N!r}) AS rho FROM q),
p AS (SELECT k, i, rho*sin(theta) AS x, ({geometry._RHO0!r})-rho*cos(theta) AS y FROM r)"""


@query(f"""WITH b AS (SELECT n_nationkey AS k, 115.0+(n_nationkey%5)*6 AS x0, -42.0+(n_nationkey//5)*6 AS y0 FROM nation), c AS (SELECT * FROM (VALUES (0, 0, 0), (1, 5, 0), (2, 5, 4), (3, 0, 4)) t(i, dx, dy)),
v AS (SELECT k, i, x0+dx AS lon, y0+dy AS lat FROM b, c), {_PLANE}
SELECT CAST(a.k AS VARCHAR) AS code, round(abs(sum(a.x*z.y-z.x*a.y)/2)/1e6, 3) AS area FROM p a JOIN p z ON a.k=z.k AND z.i=(a.i+1)%4 GROUP BY a.k""")
def area_in_square_kilometres(spark, sf):
    x0, y0 = 115.0 + (F.col("n_nationkey") % 5) * 6, -42.0 + F.floor(F.col("n_nationkey") / 5) * 6
    corner = lambda dx, dy: F.struct((x0 + F.lit(float(dx))).alias("x"), (y0 + F.lit(float(dy))).alias("y"))
    b = _t(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("name"), F.array(F.array(corner(0, 0), corner(5, 0), corner(5, 4), corner(0, 4))).alias("rings"))
    return spatial.areas(b).select("code", F.round("area", 3).alias("area"))


# -- pages ------------------------------------------------------------------------------------------------------------


@query(r"""SELECT page_id, link, regexp_extract(link, '^/([a-z]{2})$', 1) AS release FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href\s*=\s*["'']([^"'']+)["'']', 1)) AS link FROM pages) WHERE regexp_matches(link, '^/([a-z]{2})$')""")
def release_links(spark, sf):
    return page_links(_t(spark, sf, "pages").select("page_id", "html"), "html", "^/([a-z]{2})$").select("page_id", "link", "release")
