"""Registered queries: each operator over the driver tables, with the SQL that says the same.

The tables carry no geography, so points, areas, addresses and releases are derived from their keys, alike on both
sides: a 5 x 5 tiling of a 100 x 100 plane by nation, some tiles cut to triangles; addresses by customer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areaweave.functions.address import cache_key, normalize_address, parse_address
from areaweave.functions.coerce import number
from areaweave.functions.columns import once
from areaweave.functions.features import Expression, Feature, compiled
from areaweave.functions.temporal import Release, month_quarter, release
from areaweave.functions.text import is_code, recipients_column
from areaweave.operators import asof, downscale, enrich, geocode, overlay, pivot, spatial, summary
from areaweave.plans.registry import VariableCatalog
from areaweave.sources.files import latest_resource

CELL = 7.5


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _xy(key: str):
    k = F.col(key)
    return ((k * 37) % 1000 / F.lit(10.0)).alias("x"), ((k * 61) % 1000 / F.lit(10.0)).alias("y")


def _xy_sql(key: str) -> str:
    return f"({key}*37)%1000/10.0 AS x, ({key}*61)%1000/10.0 AS y"


def _tiles(spark: SparkSession, sf: str) -> DataFrame:
    n = _t(spark, sf, "nation")
    x0, y0 = (F.col("n_nationkey") % 5) * 20.0, F.floor(F.col("n_nationkey") / 5) * 20.0
    p = lambda dx, dy: F.struct((x0 + float(dx)).alias("x"), (y0 + float(dy)).alias("y"))
    ring = F.when(F.col("n_nationkey") % 4 == 3, F.array(p(0, 0), p(20, 0), p(20, 20))).otherwise(F.array(p(0, 0), p(20, 0), p(20, 20), p(0, 20)))
    return n.select(F.lpad(F.col("n_nationkey").cast("string"), 9, "0").alias("code"), F.col("n_name").alias("name"), F.array(ring).alias("rings"))


_EDGES = """tiles AS (SELECT n_nationkey AS k, lpad(CAST(n_nationkey AS VARCHAR), 9, '0') AS code, n_name, (n_nationkey%5)*20.0 AS x0, (n_nationkey//5)*20.0 AS y0 FROM nation),
edges AS (
  SELECT k, code, n_name, x0 AS x1, y0 AS y1, x0+20 AS x2, y0 AS y2 FROM tiles
  UNION ALL SELECT k, code, n_name, x0+20, y0, x0+20, y0+20 FROM tiles
  UNION ALL SELECT k, code, n_name, x0+20, y0+20, x0, y0+20 FROM tiles WHERE k%4<>3
  UNION ALL SELECT k, code, n_name, x0, y0+20, x0, y0 FROM tiles WHERE k%4<>3
  UNION ALL SELECT k, code, n_name, x0+20, y0+20, x0, y0 FROM tiles WHERE k%4=3)"""


def _hits_sql(points: str) -> str:
    return f"""points AS ({points}),
tests AS (SELECT p.id, e.code, e.n_name,
  sum(CASE WHEN (e.y1>p.y) <> (e.y2>p.y) THEN CASE WHEN p.x < (e.x2-e.x1)*(p.y-e.y1)/(e.y2-e.y1)+e.x1 THEN 1 ELSE 0 END ELSE 0 END) AS crossings,
  max(CASE WHEN (e.x2-e.x1)*(p.y-e.y1)-(e.y2-e.y1)*(p.x-e.x1)=0 AND p.x BETWEEN least(e.x1,e.x2) AND greatest(e.x1,e.x2) AND p.y BETWEEN least(e.y1,e.y2) AND greatest(e.y1,e.y2) THEN 1 ELSE 0 END) AS touches
  FROM points p, edges e GROUP BY p.id, e.code, e.n_name),
hits AS (SELECT id, min(code) AS area_code, arg_min(n_name, code) AS area_name FROM tests WHERE crossings%2=1 AND touches=0 GROUP BY id)"""


Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def wrap(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return wrap


# -- places -----------------------------------------------------------------------------------------------------------


@query(f"WITH {_EDGES}, {_hits_sql('SELECT c_custkey AS id, ' + _xy_sql('c_custkey') + ' FROM customer')} SELECT c_custkey, area_code, area_name FROM customer LEFT JOIN hits ON c_custkey=id")
def pip_join(spark, sf):
    c = _t(spark, sf, "customer").select("c_custkey", *_xy("c_custkey"))
    hits = spatial.points_in_areas(c, _tiles(spark, sf), "c_custkey", "x", "y", CELL)
    return c.select("c_custkey").join(hits, "c_custkey", "left")


@query(f"WITH tiles AS (SELECT lpad(CAST(n_nationkey AS VARCHAR), 9, '0') AS area_code, (n_nationkey%5)*20.0 AS x0, (n_nationkey//5)*20.0 AS y0 FROM nation), p AS (SELECT event_id, {_xy_sql('event_id')} FROM events) SELECT event_id, area_code FROM p JOIN tiles ON x BETWEEN x0 AND x0+20 AND y BETWEEN y0 AND y0+20")
def bbox_grid_join(spark, sf):
    e = _t(spark, sf, "events").select("event_id", *_xy("event_id"))
    return spatial.candidates(e, _tiles(spark, sf), "x", "y", CELL).select("event_id", "area_code")


@query(f"""WITH {_EDGES}, {_hits_sql('SELECT c_custkey AS id, ' + _xy_sql('c_custkey') + ' FROM customer')},
keyed AS (SELECT c_custkey, CASE WHEN c_custkey%3=0 THEN n_nationkey END AS mb FROM customer JOIN nation ON n_nationkey=c_nationkey)
SELECT k.c_custkey, CASE WHEN mb IS NOT NULL THEN 'mb_code' WHEN area_code IS NOT NULL THEN 'spatial_join' ELSE 'unmatched' END AS resolution,
coalesce(lpad(CAST(mb AS VARCHAR), 9, '0'), area_code) AS area_code FROM keyed k LEFT JOIN hits ON id=k.c_custkey""")
def key_fast_path_then_spatial(spark, sf):
    c = _t(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_nationkey")).alias("mb"), *_xy("c_custkey"))
    hits = spatial.points_in_areas(c.where("mb is null"), _tiles(spark, sf), "c_custkey", "x", "y", CELL)
    lookup = _t(spark, sf, "nation").select("n_nationkey", F.lpad(F.col("n_nationkey").cast("string"), 9, "0").alias("code"))
    return enrich.key_then_points(c, lookup, "mb", "n_nationkey", "code", hits, "c_custkey").select("c_custkey", "resolution", "area_code")


@query(f"WITH {_EDGES} SELECT code, abs(sum(x1*y2-x2*y1)/2) AS area FROM edges GROUP BY code")
def polygon_area(spark, sf):
    return spatial.areas(_tiles(spark, sf), project=False)


def _boxes(spark, sf, shift: float, size: float, prefix: str) -> DataFrame:
    n = _t(spark, sf, "nation")
    x0, y0 = (F.col("n_nationkey") % 5) * 20.0 + shift, F.floor(F.col("n_nationkey") / 5) * 20.0 + shift
    p = lambda dx, dy: F.struct((x0 + dx).alias("x"), (y0 + dy).alias("y"))
    ring = F.array(p(0.0, 0.0), p(size, 0.0), p(size, size), p(0.0, size))
    return n.select(F.concat(F.lit(prefix), F.col("n_nationkey").cast("string")).alias("code"), F.col("n_name").alias("name"), F.array(ring).alias("rings"))


_WEIGHTS = """a AS (SELECT 'A'||n_nationkey AS a, (n_nationkey%5)*20.0 AS x, (n_nationkey//5)*20.0 AS y FROM nation),
b AS (SELECT 'B'||n_nationkey AS b, (n_nationkey%5)*20.0+7.0 AS u, (n_nationkey//5)*20.0+7.0 AS v FROM nation),
w AS (SELECT a AS sa2_code, b AS lga_code, (least(x+20,u+16)-greatest(x,u))*(least(y+20,v+16)-greatest(y,v)) AS area FROM a, b WHERE least(x+20,u+16)>greatest(x,u) AND least(y+20,v+16)>greatest(y,v)),
weights AS (SELECT sa2_code, lga_code, area, area/256.0 AS sa2_share_of_lga, area/400.0 AS lga_share_of_sa2 FROM w WHERE area>=1)"""


def _weights(spark, sf):
    return downscale.correspondence(_boxes(spark, sf, 0.0, 20.0, "A"), _boxes(spark, sf, 7.0, 16.0, "B"), 25.0)


@query(f"WITH {_WEIGHTS} SELECT sa2_code, lga_code, round(area, 6) AS area, round(sa2_share_of_lga, 9) AS sa2_share_of_lga, round(lga_share_of_sa2, 9) AS lga_share_of_sa2 FROM weights")
def rect_intersection_area(spark, sf):
    w = _weights(spark, sf)
    return w.select("sa2_code", "lga_code", F.round("intersection_area_m2", 6).alias("area"), F.round("sa2_share_of_lga", 9).alias("sa2_share_of_lga"), F.round("lga_share_of_sa2", 9).alias("lga_share_of_sa2"))


@query("""WITH t AS (SELECT lpad(CAST(n_nationkey AS VARCHAR), 9, '0') AS a_code, n_nationkey%4=3 AS cut, (n_nationkey%5)*20.0 AS x0, (n_nationkey//5)*20.0 AS y0 FROM nation),
b AS (SELECT 'B'||p_partkey AS b_code, (p_partkey*37)%1000/10.0 AS u, (p_partkey*61)%1000/10.0 AS v, 2.0+p_size/4.0 AS w FROM part),
m AS (SELECT a_code, b_code, cut, greatest(x0, u)-x0 AS l, least(x0+20, u+w)-x0 AS r, greatest(y0, v)-y0 AS d, least(y0+20, v+w)-y0 AS h FROM t, b WHERE least(x0+20, u+w)>greatest(x0, u) AND least(y0+20, v+w)>greatest(y0, v)),
s AS (SELECT a_code, b_code, CASE WHEN cut THEN (power(greatest(r-d, 0), 2)-power(greatest(r-h, 0), 2)-power(greatest(l-d, 0), 2)+power(greatest(l-h, 0), 2))/2 ELSE (r-l)*(h-d) END AS area FROM m)
SELECT a_code, b_code, round(area, 5) AS area FROM s WHERE area>=0.001""")
def polygon_overlap_area(spark, sf):
    """Tiles, a quarter of them triangles, against a box for each part."""
    part = _t(spark, sf, "part").select("p_partkey", *_xy("p_partkey"), (F.lit(2.0) + F.col("p_size") / 4.0).alias("w"))
    p = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    none, w = F.lit(0.0), F.col("w")
    boxes = part.select(F.concat(F.lit("B"), F.col("p_partkey")).alias("code"), F.lit("").alias("name"), F.array(F.array(p(none, none), p(w, none), p(w, w), p(none, w))).alias("rings"))
    return overlay.overlaps(_tiles(spark, sf), boxes, CELL, 0.001).select("a_code", "b_code", F.round("area", 5).alias("area"))


_VALUES = "v AS (SELECT 'B'||s_nationkey AS lga_code, CAST(count(*) AS DOUBLE) AS n, avg(s_acctbal) AS rate FROM supplier WHERE s_nationkey%7<>0 GROUP BY s_nationkey)"


def _values(spark, sf):
    s = _t(spark, sf, "supplier").where("s_nationkey % 7 <> 0")
    return s.groupBy(F.concat(F.lit("B"), F.col("s_nationkey").cast("string")).alias("lga_code")).agg(F.count("*").cast("double").alias("n"), F.avg("s_acctbal").alias("rate"))


@query(f"WITH {_WEIGHTS}, {_VALUES} SELECT sa2_code, round(sum(n*sa2_share_of_lga), 4) AS n FROM weights JOIN v USING (lga_code) GROUP BY sa2_code")
def downscale_counts(spark, sf):
    return downscale.counts(_weights(spark, sf), _values(spark, sf), ["n"]).select("sa2_code", F.round("n", 4).alias("n"))


@query(f"WITH {_WEIGHTS}, {_VALUES} SELECT sa2_code, round(sum(rate*lga_share_of_sa2)/sum(lga_share_of_sa2), 4) AS rate FROM weights JOIN v USING (lga_code) GROUP BY sa2_code")
def downscale_rates(spark, sf):
    return downscale.rates(_weights(spark, sf), _values(spark, sf), ["rate"]).select("sa2_code", F.round("rate", 4).alias("rate"))


@query("SELECT n_nationkey, n_regionkey, r_name FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey<>2) r ON n_regionkey=r_regionkey")
def replicate_parent(spark, sf):
    parents = _t(spark, sf, "region").where("r_regionkey <> 2").withColumnRenamed("r_regionkey", "n_regionkey")
    return downscale.replicate(_t(spark, sf, "nation").drop("n_name"), parents, "n_regionkey").select("n_nationkey", "n_regionkey", "r_name")


# -- enrichment -------------------------------------------------------------------------------------------------------


def _order_stats(spark, sf):
    o = _t(spark, sf, "orders").join(_t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy("c_nationkey").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("WITH s AS (SELECT c_nationkey AS k, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey=c_custkey GROUP BY 1) SELECT c_custkey, n AS sa2_orders, total AS sa2_total, total AS sa2_again FROM customer LEFT JOIN s ON k=c_nationkey")
def enrich_left_join(spark, sf):
    lookup = _order_stats(spark, sf).withColumnRenamed("c_nationkey", "k")
    out = enrich.left_enrich(_t(spark, sf, "customer"), lookup, "c_nationkey", "k", {"sa2_orders": "orders", "sa2_total": "total", "sa2_again": "total"})
    return out.select("c_custkey", "sa2_orders", "sa2_total", "sa2_again")


@query("""WITH o AS (SELECT c_nationkey AS k, count(*) AS orders FROM orders JOIN customer ON o_custkey=c_custkey WHERE c_nationkey%5<>1 GROUP BY 1),
s AS (SELECT s_nationkey AS k, count(*) AS suppliers, round(sum(s_acctbal), 2) AS balance FROM supplier GROUP BY 1), c AS (SELECT c_nationkey AS k, count(*) AS customers FROM customer WHERE c_nationkey%3=0 GROUP BY 1)
SELECT coalesce(o.k, s.k, c.k) AS k, orders, suppliers, balance, customers FROM o FULL JOIN s ON o.k=s.k FULL JOIN c ON c.k=coalesce(o.k, s.k)""")
def multi_dataset_outer_concat(spark, sf):
    o = _order_stats(spark, sf).where("c_nationkey % 5 <> 1").select(F.col("c_nationkey").alias("k"), "orders")
    s = _t(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"), F.round(F.sum("s_acctbal"), 2).alias("balance"))
    c = _t(spark, sf, "customer").where("c_nationkey % 3 = 0").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    return enrich.outer_concat([o, s, c], "k")


@query("""WITH o AS (SELECT s_nationkey AS k, count(*) AS n, min(s_name) AS name FROM supplier GROUP BY 1), c AS (SELECT c_nationkey AS k, count(*) AS m, min(c_name) AS name FROM customer WHERE c_nationkey<20 GROUP BY 1)
SELECT coalesce(o.k, c.k) AS k, n, o.name AS name, m FROM o FULL JOIN c ON o.k=c.k""")
def outer_join_shared_columns(spark, sf):
    o = _t(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n"), F.min("s_name").alias("name"))
    c = _t(spark, sf, "customer").where("c_nationkey < 20").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("m"), F.min("c_name").alias("name"))
    return enrich.outer_join_shared([o, c], "k")


def _feature(spark, sf, **rules):
    g = _t(spark, sf, "lineitem").groupBy("l_suppkey").agg(*[F.count_if(F.col("l_returnflag") == f).alias(n) for f, n in (("A", "a"), ("N", "n0"), ("R", "r"))], F.count("*").alias("n"), F.count_if(F.col("l_quantity") > 49).alias("big"))
    f = Feature(id="f", **rules)
    return g.select("l_suppkey", F.round(compiled(f, F.col), 6).alias("value"))


_FLAGS = "g AS (SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag='A') AS a, count(*) FILTER (WHERE l_returnflag='N') AS n0, count(*) FILTER (WHERE l_returnflag='R') AS r, count(*) AS n, count(*) FILTER (WHERE l_quantity>49) AS big FROM lineitem GROUP BY 1)"
_FIELD = lambda x: Expression(fields=[x])


@query(f"WITH {_FLAGS} SELECT l_suppkey, round(CASE WHEN n0<>0 THEN CAST(a AS DOUBLE)/n0 END, 6) AS value FROM g")
def preset_ratio(spark, sf):
    return _feature(spark, sf, numerator=_FIELD("a"), denominator=_FIELD("n0"))


@query(f"WITH {_FLAGS} SELECT l_suppkey, round(least(greatest(100.0*a/n, 20.0), 27.5), 6) AS value FROM g")
def preset_percentage_clip(spark, sf):
    return _feature(spark, sf, numerator=_FIELD("a"), denominator=_FIELD("n"), output_kind="percentage", bounds=(20, 27.5), out_of_bounds="clip")


@query(f"WITH {_FLAGS} SELECT l_suppkey, round(1000.0*(1.0*a+2.0*r+0.5*big)/n, 6) AS value FROM g")
def preset_weighted_sum(spark, sf):
    e = Expression(expression="weighted_sum", fields=["a", "r", "big"], weights=[1.0, 2.0, 0.5])
    return _feature(spark, sf, numerator=e, denominator=_FIELD("n"), output_kind="rate", scale=1000.0)


@query(f"WITH {_FLAGS} SELECT l_suppkey, round(CASE WHEN big<>0 THEN CAST(a+r AS DOUBLE)/big ELSE 0.0 END, 6) AS value FROM g")
def preset_zero_policy(spark, sf):
    return _feature(spark, sf, numerator=Expression(expression="sum", fields=["a", "r"]), denominator=_FIELD("big"), zero_denominator="zero")


# -- releases ---------------------------------------------------------------------------------------------------------

_YEARS = [release(str(y), "financial_year_ending") for y in range(1996, 2002)]
_QUARTERS = [release(f"{y}-Q{q}", "quarter_ending") for y in range(1996, 2001) for q in range(1, 5)]
_LATE = [release(str(y), "calendar_year_ending") for y in range(1997, 2001)]


def _windows_sql(releases: list[Release]) -> str:
    rows = ", ".join(f"('{r.id}', DATE '{r.start}', DATE '{r.end}', DATE '{r.midpoint}')" for r in releases)
    return f"w(release, start_, end_, mid) AS (VALUES {rows})"


def _days(spark, sf):
    return _t(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))


@query(f"WITH {_windows_sql(_YEARS)} SELECT o_orderkey, (SELECT arg_max(release, start_) FROM w WHERE start_<=CAST(o_orderdate AS DATE)) AS release FROM orders")
def asof_closest_at_or_before(spark, sf):
    return asof.asof_release(_days(spark, sf), "day", _YEARS).select("o_orderkey", "release")


@query(f"WITH {_windows_sql(_QUARTERS)}, d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), r AS (SELECT day, release, row_number() OVER (PARTITION BY day ORDER BY abs(date_diff('day', mid, day)), start_) AS n FROM d, w) SELECT o_orderkey, release FROM orders JOIN r ON day=CAST(o_orderdate AS DATE) AND n=1")
def asof_closest_midpoint(spark, sf):
    return asof.asof_release(_days(spark, sf), "day", _QUARTERS, "closest").select("o_orderkey", "release")


@query(f"WITH {_windows_sql(_LATE)} SELECT o_orderkey, coalesce((SELECT arg_max(release, start_) FROM w WHERE start_<=CAST(o_orderdate AS DATE)), '1997') AS release FROM orders")
def asof_out_of_range_nearest(spark, sf):
    return asof.asof_release(_days(spark, sf), "day", _LATE, out_of_range="nearest").select("o_orderkey", "release")


@query(f"""WITH {_windows_sql(_YEARS)}, o AS (SELECT o_orderkey, c_nationkey, (SELECT arg_max(release, start_) FROM w WHERE start_<=CAST(o_orderdate AS DATE)) AS release FROM orders JOIN customer ON o_custkey=c_custkey),
v AS (SELECT release, lpad(CAST(n_nationkey AS VARCHAR), 9, '0') AS code3, 'E2-'||((n_nationkey*7)%25) AS code2, n_nationkey*100+CAST(release AS INTEGER) AS value FROM nation, w)
SELECT o_orderkey, o.release, CAST(CASE WHEN o.release<='1998' THEN v2.value ELSE v3.value END AS BIGINT) AS value FROM o
LEFT JOIN v v3 ON o.release>'1998' AND v3.release=o.release AND v3.code3=lpad(CAST(c_nationkey AS VARCHAR), 9, '0')
LEFT JOIN v v2 ON o.release<='1998' AND v2.release=o.release AND v2.code2='E2-'||c_nationkey""")
def temporal_enrich_cross_edition(spark, sf):
    o = _t(spark, sf, "orders").join(_t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.select("o_orderkey", F.to_date("o_orderdate").alias("day"), F.lpad(F.col("c_nationkey").cast("string"), 9, "0").alias("e3"), F.concat(F.lit("E2-"), F.col("c_nationkey").cast("string")).alias("e2"))
    rows = asof.asof_release(o, "day", _YEARS)
    n = _t(spark, sf, "nation").select("n_nationkey", F.explode(F.array(*[F.lit(r.id) for r in _YEARS])).alias("release"))
    own = F.when(F.col("release") <= "1998", F.concat(F.lit("E2-"), ((F.col("n_nationkey") * 7) % 25).cast("string"))).otherwise(F.lpad(F.col("n_nationkey").cast("string"), 9, "0"))
    values = n.select("release", own.alias("sa2_code"), (F.col("n_nationkey") * 100 + F.col("release").cast("int")).cast("long").alias("v"))
    editions = {r.id: 2 if r.id <= "1998" else 3 for r in _YEARS}
    return asof.cross_edition_join(rows, values, "release", editions, {3: "e3", 2: "e2"}, {"value": "v"}).select("o_orderkey", "release", "value")


@query("""WITH y AS (SELECT c_nationkey AS k, year(o_orderdate) AS year, round(sum(o_totalprice), 2) AS value FROM orders JOIN customer ON o_custkey=c_custkey GROUP BY 1, 2),
n AS (SELECT n_nationkey AS k, u.year AS year FROM nation, (VALUES (1996), (1997), (1998)) u(year))
SELECT n.k, CAST(n.year AS INTEGER) AS year, value FROM n LEFT JOIN y ON y.k=n.k AND y.year=n.year""")
def historical_projection(spark, sf):
    o = _t(spark, sf, "orders").join(_t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    years = [1996, 1997, 1998]
    wide = o.groupBy(F.col("c_nationkey").alias("k")).agg(*[F.round(F.sum(F.when(F.year("o_orderdate") == y, F.col("o_totalprice"))), 2).alias(f"population_history_{y}") for y in years])
    every = _t(spark, sf, "nation").select(F.col("n_nationkey").alias("k")).join(wide, "k", "left")
    return pivot.history(every, "k", "population_history_", years)


@query(f"WITH {_windows_sql(_YEARS)} SELECT list_sort(list(DISTINCT r)) AS orders FROM (SELECT (SELECT arg_max(release, start_) FROM w WHERE start_<=CAST(o_orderdate AS DATE)) AS r FROM orders) WHERE r IS NOT NULL")
def releases_used(spark, sf):
    return summary.releases_used(asof.asof_release(_days(spark, sf), "day", _YEARS), {"orders": "release"})


# -- pivots and sums --------------------------------------------------------------------------------------------------

_TYPES = {"view": "views", "click": "clicks", "purchase": "purchases"}


@query("SELECT user_id, " + ", ".join(f"arg_min(value, event_id) FILTER (WHERE event_type='{m}' AND value IS NOT NULL) AS {n}" for m, n in _TYPES.items()) + " FROM events GROUP BY user_id")
def pivot_first(spark, sf):
    return pivot.first_values(_t(spark, sf, "events"), "user_id", "event_type", "value", _TYPES, "event_id")


@query("SELECT p_brand, CAST(coalesce(sum(CASE WHEN l_returnflag='A' THEN l_linenumber END), 0) AS BIGINT) AS a, CAST(coalesce(sum(CASE WHEN l_returnflag='R' THEN l_linenumber END), 0) AS BIGINT) AS r FROM lineitem JOIN part ON l_partkey=p_partkey GROUP BY p_brand")
def industry_group_sum(spark, sf):
    rows = _t(spark, sf, "lineitem").join(_t(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    flagged = rows.select("p_brand", *[F.when(F.col("l_returnflag") == f, F.col("l_linenumber")).alias(f.lower()) for f in "AR"])
    return pivot.group_sums(flagged, "p_brand", ["a", "r"])


@query("SELECT c_nationkey, arg_max(round(total, 2), y) AS total, CAST(max(y) AS INTEGER) AS y FROM (SELECT c_nationkey, year(o_orderdate) AS y, sum(o_totalprice) AS total FROM orders JOIN customer ON o_custkey=c_custkey GROUP BY 1, 2) GROUP BY 1")
def rightmost_year(spark, sf):
    o = _t(spark, sf, "orders").join(_t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    by = o.groupBy("c_nationkey", F.year("o_orderdate").alias("y")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return pivot.rightmost(by, "c_nationkey", "y", "total")


# -- addresses --------------------------------------------------------------------------------------------------------

_NUMBER = "(c_custkey%150+1)"
_LABEL = f"{_NUMBER}||' '||upper(c_mktsegment)||' STREET N'||c_nationkey||' NSW '||(2000+c_nationkey)"
_RAW = f"""CASE o_orderkey%4 WHEN 0 THEN {_NUMBER}||' '||c_mktsegment||' St,  N'||c_nationkey||', New South Wales '||(2000+c_nationkey)
 WHEN 1 THEN {_NUMBER}||' '||c_mktsegment||' STREET LEVEL 5 N'||c_nationkey||' NSW '||(2000+c_nationkey)
 WHEN 2 THEN {_NUMBER}||' '||c_mktsegment||'X STREET N'||c_nationkey||' NSW '||(2000+c_nationkey) ELSE '' END"""
_NORM = r"trim(replace(replace(regexp_replace(regexp_replace(upper(raw), '[,.;:!?]', ' ', 'g'), '\s+', ' ', 'g'), 'NEW SOUTH WALES', 'NSW'), ' ST ', ' STREET '))"
_ADDRESSES = f"""corpus AS (SELECT 'P'||lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS pid, {_LABEL} AS label, CAST(2000+c_nationkey AS VARCHAR) AS postcode FROM customer),
raw AS (SELECT o_orderkey, {_RAW} AS raw, {_NUMBER}||' '||upper(c_mktsegment)||' STREET' AS part, CAST(2000+c_nationkey AS VARCHAR) AS code FROM orders JOIN customer ON o_custkey=c_custkey),
addr AS (SELECT *, {_NORM} AS norm FROM raw)"""


def _corpus(spark, sf):
    c = _t(spark, sf, "customer")
    label = F.concat_ws(" ", (F.col("c_custkey") % 150 + 1).cast("string"), F.upper("c_mktsegment"), F.lit("STREET"), F.concat(F.lit("N"), F.col("c_nationkey")), F.lit("NSW"), (F.col("c_nationkey") + 2000).cast("string"))
    x, y = _xy("c_custkey")
    return c.select(F.concat(F.lit("P"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("pid"), label.alias("label"), y.alias("lat"), x.alias("lon"), F.concat(F.lit("M"), F.col("c_nationkey")).alias("mb_code"), (F.col("c_nationkey") + 2000).cast("string").alias("postcode"))


def _raw(spark, sf):
    # by its files customer looks small enough to broadcast, at any size the driver could not hold
    o = _t(spark, sf, "orders").join(_t(spark, sf, "customer").hint("merge"), F.col("o_custkey") == F.col("c_custkey"))
    n, seg, loc, code = (F.col("c_custkey") % 150 + 1).cast("string"), F.col("c_mktsegment"), F.concat(F.lit("N"), F.col("c_nationkey")), (F.col("c_nationkey") + 2000).cast("string")
    k = F.col("o_orderkey") % 4
    raw = (
        F.when(k == 0, F.concat(n, F.lit(" "), seg, F.lit(" St,  "), loc, F.lit(", New South Wales "), code))
        .when(k == 1, F.concat(n, F.lit(" "), seg, F.lit(" STREET LEVEL 5 "), loc, F.lit(" NSW "), code))
        .when(k == 2, F.concat(n, F.lit(" "), seg, F.lit("X STREET "), loc, F.lit(" NSW "), code))
        .otherwise("")
    )
    return o.select("o_orderkey", raw.alias("raw"))


def _norms(spark, sf):
    return _raw(spark, sf).withColumn("norm", once(normalize_address(F.col("raw"))))


@query(f"WITH {_ADDRESSES} SELECT o_orderkey, norm FROM addr")
def normalize_text(spark, sf):
    return _norms(spark, sf).select("o_orderkey", "norm")


@query(rf"""WITH {_ADDRESSES} SELECT o_orderkey, nullif(regexp_extract(norm, '^([0-9]+) ', 1), '') AS street_number, nullif(regexp_extract(norm, '^[0-9]+ (\w+) STREET', 1), '') AS street_name,
nullif(regexp_extract(norm, 'STREET (.*) NSW', 1), '') AS locality, nullif(regexp_extract(norm, ' ([0-9]{{4}})$', 1), '') AS postcode FROM addr""")
def parse_tokens(spark, sf):
    p = parse_address(_norms(spark, sf), "norm")
    return p.select("o_orderkey", *[F.col(f"parsed.{c}").alias(c) for c in ("street_number", "street_name", "locality", "postcode")])


@query(f"WITH {_ADDRESSES}, m AS (SELECT norm, min(pid) AS pid FROM (SELECT DISTINCT norm FROM addr) JOIN corpus ON label=norm GROUP BY norm) SELECT o_orderkey, pid FROM addr JOIN m USING (norm)")
def address_tier1_exact(spark, sf):
    rows = _norms(spark, sf)
    found = geocode.exact(rows.select("norm").distinct(), _corpus(spark, sf), ["norm"])
    return rows.join(found.select("norm", "pid"), "norm").select("o_orderkey", "pid")


_SECOND = "d AS (SELECT DISTINCT norm, regexp_extract(norm, '^([0-9]+ \\w+ STREET)', 1) AS part, regexp_extract(norm, ' ([0-9]{4})$', 1) AS code FROM addr WHERE norm<>''), m2 AS (SELECT norm, min(pid) AS pid FROM d JOIN corpus ON postcode=code AND contains(label, part) GROUP BY norm HAVING count(*)=1)"


@query(f"WITH {_ADDRESSES}, {_SECOND} SELECT o_orderkey, pid FROM addr JOIN m2 USING (norm)")
def address_tier2_component(spark, sf):
    rows = _norms(spark, sf)
    found = geocode.component(parse_address(rows.select("norm").distinct(), "norm"), _corpus(spark, sf), ["norm"])
    return rows.join(found.select("norm", "pid"), "norm").select("o_orderkey", "pid")


_CASCADE = f"""{_ADDRESSES}, m1 AS (SELECT norm, min(pid) AS pid FROM (SELECT DISTINCT norm FROM addr) JOIN corpus ON label=norm GROUP BY norm), {_SECOND},
c AS (SELECT o_orderkey, CASE WHEN m1.pid IS NOT NULL THEN 'gnaf_exact' WHEN m2.pid IS NOT NULL THEN 'gnaf_component' ELSE 'failed' END AS geo_source, coalesce(m1.pid, m2.pid) AS pid FROM addr LEFT JOIN m1 USING (norm) LEFT JOIN m2 USING (norm)),
f AS (SELECT o_orderkey, geo_source, (CAST(substr(pid, 2) AS BIGINT)*61)%1000/10.0 AS geo_lat, 'M'||c_nationkey AS mb_code FROM c LEFT JOIN customer ON CAST(substr(pid, 2) AS BIGINT)=c_custkey)"""


def _cascade(spark, sf):
    provider = geocode.CorpusProvider(_corpus(spark, sf), threshold=None)
    return geocode.resolve(_raw(spark, sf), "raw", None, None, [provider])


@query(f"WITH {_CASCADE} SELECT o_orderkey, geo_source, geo_lat, mb_code FROM f")
def address_cascade(spark, sf):
    return _cascade(spark, sf).select("o_orderkey", "geo_source", "geo_lat", "mb_code")


# of the labels of the postcode: the address itself, a label all of whose tokens it holds (its number, or the level's), or the one without the X
_THIRD = """d3 AS (SELECT DISTINCT norm, o_orderkey%4 AS k, split_part(part, ' ', 1) AS num, split_part(part, ' ', 2) AS seg, code FROM addr WHERE norm<>''),
c3 AS (SELECT pid, label, postcode, split_part(label, ' ', 1) AS num, split_part(label, ' ', 2) AS seg FROM corpus),
m3 AS (SELECT norm, min(pid) AS pid, max(CASE WHEN k=2 THEN round(1-1.0/(length(norm)+length(label)), 6) ELSE 1.0 END) AS score FROM d3 JOIN c3 ON postcode=code AND c3.seg=d3.seg AND (c3.num=d3.num OR (k=1 AND c3.num='5')) GROUP BY norm)"""


@query(f"WITH {_ADDRESSES}, {_THIRD} SELECT norm, pid, CAST(score AS DOUBLE) AS score FROM m3")
def address_tier3_fuzzy(spark, sf):
    rows = _norms(spark, sf).where("norm <> ''").select("norm").distinct()
    return geocode.fuzzy(parse_address(rows, "norm"), _corpus(spark, sf), ["norm"]).select("norm", "pid", F.round("match_score", 6).alias("score"))


@query(f"""{'WITH ' + _CASCADE[: _CASCADE.index('c AS (SELECT o_orderkey')]}{_THIRD},
c AS (SELECT o_orderkey, CASE WHEN m1.pid IS NOT NULL THEN 'gnaf_exact' WHEN m2.pid IS NOT NULL THEN 'gnaf_component' WHEN m3.pid IS NOT NULL THEN 'gnaf_fuzzy' ELSE 'failed' END AS geo_source, coalesce(m1.pid, m2.pid, m3.pid) AS pid FROM addr LEFT JOIN m1 USING (norm) LEFT JOIN m2 USING (norm) LEFT JOIN m3 USING (norm))
SELECT o_orderkey, geo_source, (CAST(substr(pid, 2) AS BIGINT)*61)%1000/10.0 AS geo_lat, 'M'||c_nationkey AS mb_code FROM c LEFT JOIN customer ON CAST(substr(pid, 2) AS BIGINT)=c_custkey""")
def address_cascade_three_tiers(spark, sf):
    found = geocode.resolve(_raw(spark, sf), "raw", None, None, [geocode.CorpusProvider(_corpus(spark, sf))])
    return found.select("o_orderkey", "geo_source", "geo_lat", "mb_code")


@query(f"WITH {_CASCADE} SELECT count(*) AS n, count(*) FILTER (WHERE geo_source='gnaf_exact') AS exact, count(*) FILTER (WHERE geo_source='gnaf_component') AS component, count(*) FILTER (WHERE geo_source='failed') AS failed, count(*) FILTER (WHERE mb_code IS NOT NULL) AS with_area, count(*) FILTER (WHERE mb_code IS NULL AND geo_lat IS NOT NULL) AS unmatched FROM f")
def geo_summary(spark, sf):
    df = _cascade(spark, sf).withColumn("sa2_code", F.col("mb_code")).withColumn("sa2_resolution", F.when(F.col("mb_code").isNotNull(), "mb_code"))
    a = summary.aggregates(df, ["geo_lat"])
    return a.select(F.col("rows").alias("n"), F.col("source_gnaf_exact").alias("exact"), F.col("source_gnaf_component").alias("component"), F.col("source_failed").alias("failed"), "with_area", F.col("is_unmatched").alias("unmatched"))


@query(f"WITH {_CASCADE} SELECT count(*) FILTER (WHERE geo_lat IS NULL) AS geo_lat_nulls, count(*) FILTER (WHERE mb_code IS NULL) AS mb_code_nulls FROM f WHERE geo_source<>'failed' OR o_orderkey%2=0")
def null_profile(spark, sf):
    return enrich.null_counts(_cascade(spark, sf), ["geo_lat", "mb_code"], (F.col("geo_source") != "failed") | (F.col("o_orderkey") % 2 == 0))


@query(r"""WITH k AS (SELECT doc_id, sha256(regexp_replace(trim(regexp_replace(lower(coalesce(text, '')), '[\s\v]+', ' ', 'g')), '[^\p{L}\p{M}\p{N}_]+$', '')) AS hash FROM documents), c AS (SELECT DISTINCT hash FROM k WHERE doc_id%3=0)
SELECT doc_id, k.hash, c.hash IS NOT NULL AS cached FROM k LEFT JOIN c ON c.hash=k.hash""")
def cache_lookup_sha256(spark, sf):
    k = _t(spark, sf, "documents").select("doc_id", cache_key(F.col("text")).alias("hash"))
    c = k.where("doc_id % 3 = 0").select(F.col("hash").alias("h")).distinct()
    return k.join(c, F.col("hash") == F.col("h"), "left").select("doc_id", "hash", F.col("h").isNotNull().alias("cached"))


# -- cells, keys, catalogue -------------------------------------------------------------------------------------------


@query(r"SELECT p_partkey, replace(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' ', '_')||'_recipients' AS slug FROM part")
def slug_column(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", recipients_column(F.col("p_name")).alias("slug"))


_CELL = "CASE o_orderkey%7 WHEN 0 THEN 'np' WHEN 1 THEN ' .. ' WHEN 2 THEN '<20' WHEN 3 THEN CAST(o_orderkey AS VARCHAR) WHEN 4 THEN '-'||o_orderkey||'.5' WHEN 5 THEN '1,'||lpad(CAST(o_orderkey%1000 AS VARCHAR), 3, '0') ELSE 'n/a' END"


@query(f"SELECT o_orderkey, CASE WHEN lower(trim(c)) IN ('np','na','n/a','-','..','.','','nan','null','<20') THEN NULL ELSE TRY_CAST(replace(trim(c), ',', '') AS DOUBLE) END AS value FROM (SELECT o_orderkey, {_CELL} AS c FROM orders)")
def sentinel_coercion(spark, sf):
    k = F.col("o_orderkey")
    cell = F.when(k % 7 == 0, "np").when(k % 7 == 1, " .. ").when(k % 7 == 2, "<20").when(k % 7 == 3, k.cast("string")).when(k % 7 == 4, F.concat(F.lit("-"), k.cast("string"), F.lit(".5"))).when(k % 7 == 5, F.concat(F.lit("1,"), F.lpad((k % 1000).cast("string"), 3, "0"))).otherwise("n/a")
    return _t(spark, sf, "orders").select("o_orderkey", number(cell, "dss").alias("value"))


@query(r"SELECT c_custkey FROM (SELECT c_custkey, CASE WHEN c_custkey%3=0 THEN lpad(CAST(c_custkey AS VARCHAR), 9, '1') WHEN c_custkey%3=1 THEN 'Total' ELSE CAST(c_custkey AS VARCHAR) END AS code FROM customer) WHERE regexp_full_match(code, '[0-9]{9}')")
def code_filter(spark, sf):
    k = F.col("c_custkey")
    code = F.when(k % 3 == 0, F.lpad(k.cast("string"), 9, "1")).when(k % 3 == 1, "Total").otherwise(k.cast("string"))
    return _t(spark, sf, "customer").where(is_code(code, 9)).select("c_custkey")


@query("SELECT o_orderkey, year(o_orderdate)||'-Q'||quarter(o_orderdate) AS quarter FROM orders WHERE month(o_orderdate)%3=0")
def quarter_labels(spark, sf):
    label = F.date_format("o_orderdate", "MMM-yyyy")
    return _t(spark, sf, "orders").where(F.month("o_orderdate") % 3 == 0).select("o_orderkey", month_quarter(label).alias("quarter"))


@query("SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*)>1")
def dup_key_check(spark, sf):
    return enrich.duplicates(_t(spark, sf, "lineitem"), ["l_orderkey", "l_partkey"])


@query("SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus='F')")
def missing_keys_anti(spark, sf):
    return enrich.missing_keys(_t(spark, sf, "lineitem"), "l_orderkey", _t(spark, sf, "orders").where("o_orderstatus = 'F'"), "o_orderkey")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus='O' UNION ALL SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus='F' UNION ALL SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus='P'")
def state_union(spark, sf):
    o = _t(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return enrich.union_states([o.where(F.col("o_orderstatus") == s) for s in "OFP"])


@query("SELECT table_id, code, description FROM (SELECT p_brand AS table_id, p_partkey AS pos, p_name AS code, p_type AS description FROM part) WHERE contains(lower(code), 'e') OR contains(lower(description), 'e') ORDER BY CASE WHEN contains(lower(code), 'e') THEN 0 ELSE 1 END, table_id, pos, code LIMIT 20")
def catalog_search(spark, sf):
    p = _t(spark, sf, "part").select(F.col("p_brand").alias("table_id"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("code"), F.col("p_type").alias("description"))
    return VariableCatalog(p).search("e")


_RESOURCE = "CASE WHEN event_id%5=0 THEN 'notes' ELSE 'Payments '||strftime(ts + INTERVAL 60 DAY, '%B %Y') END"


@query(f"""WITH e AS (SELECT event_id, ts, {_RESOURCE} AS name FROM events), q AS (SELECT *, strftime(ts + INTERVAL 60 DAY, '%Y')||'-Q'||quarter(ts + INTERVAL 60 DAY) AS release FROM e WHERE name<>'notes' AND month(ts + INTERVAL 60 DAY)%3=0)
SELECT release, name, 'u'||event_id AS url, lpad(CAST(event_id AS VARCHAR), 9, '0') AS last_modified FROM q ORDER BY release DESC, event_id DESC LIMIT 1""")
def json_resource_latest(spark, sf):
    month = F.date_format(F.col("ts") + F.expr("INTERVAL 60 DAY"), "MMMM yyyy")
    e = _t(spark, sf, "events").select(F.struct("user_id", F.to_date("ts")).alias("page"), F.when(F.col("event_id") % 5 == 0, "notes").otherwise(F.concat(F.lit("Payments "), month)).alias("name"), F.concat(F.lit("u"), F.col("event_id")).alias("url"), F.lpad(F.col("event_id").cast("string"), 9, "0").alias("last_modified"))
    # an answer for each page of resources, here of each user and day
    pages = e.groupBy("page").agg(F.to_json(F.struct(F.struct(F.collect_list(F.struct("name", "url", "last_modified")).alias("resources")).alias("result"))).alias("j"))
    return latest_resource(pages, "j").select("release", "name", "url", "last_modified")


from areaweave.plans import function_queries, run_queries, source_queries  # noqa: E402, F401  they register their queries here
