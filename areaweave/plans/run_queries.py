"""Registered queries of whole runs: points, addresses and dates to areas, datasets and presets, through the planner."""

from __future__ import annotations

from pyspark.sql import functions as F

from areaweave.functions.features import Expression, Feature
from areaweave.functions.temporal import release
from areaweave.operators import geocode, summary
from areaweave.plans.config import Config
from areaweave.plans.pipeline import Pipeline, Sources
from areaweave.plans.presets import FeatureRegistry
from areaweave.plans.queries import _ADDRESSES, _EDGES, _YEARS, CELL, _corpus, _hits_sql, _norms, _t, _tiles, _windows_sql, _xy, _xy_sql, query
from areaweave.plans.registry import DatasetSpec, Registry

_PAD = "lpad(CAST(n_nationkey AS VARCHAR), 9, '0')"


def _padded(c: str):
    return F.lpad(F.col(c).cast("string"), 9, "0")


def _registry(spark, sf) -> Registry:
    """Two census tables by nation, one of which lacks some nations, and a dataset by year."""
    n = _t(spark, sf, "nation")
    out = Registry()
    first = n.select(_padded("n_nationkey").alias("sa2_code"), (F.col("n_nationkey") * 10 + 5).cast("long").alias("G01.people"), F.col("n_regionkey").cast("long").alias("G01.region"))
    second = n.where("n_nationkey % 4 <> 2").select(_padded("n_nationkey").alias("sa2_code"), F.col("n_name").alias("G02.name"))
    out.register_loader("gcp", lambda s, r: first.join(second, "sa2_code", "left"))
    out.register_spec(DatasetSpec("yearly", "YEARLY", "financial_year_ending", tuple(r.id for r in _YEARS), {r.id: 3 for r in _YEARS}))
    out.register_loader("yearly", lambda s, r: n.where("n_nationkey % 5 <> 3").select(_padded("n_nationkey").alias("sa2_code"), (F.col("n_nationkey") + int(r or 0)).cast("long").alias("value")))
    return out


def _features() -> FeatureRegistry:
    out = FeatureRegistry({})
    out.register(Feature(id="share", output_kind="percentage", bounds=(0, 60), out_of_bounds="clip", numerator=Expression(fields=["G01.region"]), denominator=Expression(fields=["G01.people"])))
    return out


_PLACED = _hits_sql("SELECT c_custkey AS id, " + _xy_sql("c_custkey") + " FROM customer WHERE c_custkey%6<>1")


@query(f"""WITH {_EDGES}, {_PLACED}, g AS (SELECT {_PAD} AS sa2, CAST(n_nationkey*10+5 AS BIGINT) AS people, CAST(n_regionkey AS BIGINT) AS region, CASE WHEN n_nationkey%4<>2 THEN n_name END AS name FROM nation)
SELECT c_custkey, CASE WHEN c_custkey%6=1 THEN 'failed' ELSE 'input' END AS geo_source, area_code AS sa2_code, CASE WHEN c_custkey%6=1 THEN NULL WHEN area_code IS NULL THEN 'unmatched' ELSE 'spatial_join' END AS sa2_resolution,
people AS sa2_people, people AS sa2_again, name AS sa2_name_of, CASE WHEN people IS NOT NULL THEN round(least(greatest(100.0*region/people, 0), 60), 6) END AS sa2_share FROM customer LEFT JOIN hits ON id=c_custkey LEFT JOIN g ON sa2=area_code""")
def run_points(spark, sf):
    """Own coordinates (some lacking) to areas, census columns (one of them twice) and a preset over shared fields."""
    x, y = _xy("c_custkey")
    gone = F.col("c_custkey") % 6 == 1
    rows = _t(spark, sf, "customer").select("c_custkey", F.when(~gone, x).alias("lon"), y.alias("lat"))
    config = Config(input={"latitude_column": "lat", "longitude_column": "lon"}, variables={"people": "G01.people", "again": "G01.people", "name_of": "G02.name", "share": "PRESET.share"})
    made = Pipeline(spark, config, Sources({3: _tiles(spark, sf)}, _registry(spark, sf), features=_features()), CELL).augment(rows).df
    return made.select("c_custkey", "geo_source", "sa2_code", "sa2_resolution", "sa2_people", "sa2_again", "sa2_name_of", F.round("sa2_share", 6).alias("sa2_share"))


@query(f"""WITH {_EDGES}, {_hits_sql('SELECT o_orderkey AS id, ' + _xy_sql('o_orderkey') + ' FROM orders')}, {_windows_sql(_YEARS)},
o AS (SELECT o_orderkey, area_code, coalesce((SELECT arg_max(release, start_) FROM w WHERE start_<=CAST(o_orderdate AS DATE)), '1996') AS release FROM orders LEFT JOIN hits ON id=o_orderkey)
SELECT o_orderkey, area_code AS sa2_code, release AS yearly_release, area_code AS yearly_sa2_code_source, CASE WHEN CAST(area_code AS INTEGER)%5<>3 THEN CAST(CAST(area_code AS INTEGER)+CAST(release AS INTEGER) AS BIGINT) END AS sa2_value FROM o""")
def run_dated_points(spark, sf):
    """Dated rows, each with the dataset's release of its date."""
    x, y = _xy("o_orderkey")
    rows = _t(spark, sf, "orders").select("o_orderkey", x.alias("lon"), y.alias("lat"), F.to_date("o_orderdate").alias("day"))
    config = Config(input={"latitude_column": "lat", "longitude_column": "lon", "date_column": "day"}, variables={"value": "YEARLY.value"}, temporal={"out_of_range": "nearest"})
    made = Pipeline(spark, config, Sources({3: _tiles(spark, sf)}, _registry(spark, sf)), CELL).augment(rows).df
    return made.select("o_orderkey", "sa2_code", "yearly_release", "yearly_sa2_code_source", "sa2_value")


_MASKED = """m AS (SELECT c_custkey, c_custkey%6<>1 AS placed, c_custkey%4<>0 AND c_custkey%6<>1 AS known, c_custkey%3<>0 AS a, c_custkey%5<>0 AS b, CASE WHEN c_custkey%4=0 THEN 'unmatched' WHEN c_custkey%2=0 THEN 'mb_code' ELSE 'spatial_join' END AS how FROM customer)"""


def _marked(spark, sf):
    k = F.col("c_custkey")
    placed, known = k % 6 != 1, (k % 4 != 0) & (k % 6 != 1)
    how = F.when(k % 4 == 0, "unmatched").when(k % 2 == 0, "mb_code").otherwise("spatial_join")
    return _t(spark, sf, "customer").select("c_custkey", F.when(placed, 1.0).alias("geo_lat"), F.when(placed, 2.0).alias("geo_lon"), F.when(placed, "input").otherwise("failed").alias("geo_source"), F.when(known, "x").alias("sa2_code"), F.when(placed, how).alias("sa2_resolution"), F.when(k % 3 != 0, 1).alias("a"), F.when(k % 5 != 0, 1).alias("b"))


@query(f"WITH {_MASKED} SELECT c_custkey, placed AND NOT known AS is_unmatched, known AND a AND b AS is_fully_enriched, known AND NOT (a AND b) AND (a OR b) AS is_partially_enriched FROM m")
def result_masks(spark, sf):
    return summary.masks(_marked(spark, sf), ["a", "b"]).select("c_custkey", "is_unmatched", "is_fully_enriched", "is_partially_enriched")


@query(f"""WITH {_MASKED} SELECT count(*) FILTER (WHERE placed AND how='mb_code') AS resolution_mb_code, count(*) FILTER (WHERE placed AND how='spatial_join') AS resolution_spatial_join, count(*) FILTER (WHERE placed AND how='unmatched') AS resolution_unmatched,
CAST(0 AS BIGINT) AS source_nominatim_cache, count(*) FILTER (WHERE NOT placed) AS source_failed, count(*) FILTER (WHERE known AND a AND b) AS is_fully_enriched, count(*) FILTER (WHERE known AND NOT (a AND b) AND (a OR b)) AS is_partially_enriched, count(*) FILTER (WHERE known AND NOT a) AS null_a FROM m""")
def resolution_histogram(spark, sf):
    return summary.aggregates(_marked(spark, sf), ["a", "b"]).select("resolution_mb_code", "resolution_spatial_join", "resolution_unmatched", "source_nominatim_cache", "source_failed", "is_fully_enriched", "is_partially_enriched", "null_a")


@query(f"""WITH {_ADDRESSES}, every AS (SELECT pid, label, postcode, CASE WHEN CAST(substr(pid, 2) AS BIGINT)%3=0 THEN '202405' ELSE '202411' END AS release FROM corpus),
a AS (SELECT o_orderkey, norm, CASE WHEN o_orderkey%8<4 THEN '202405' ELSE '202411' END AS release FROM addr WHERE norm<>''), m AS (SELECT a.norm, a.release, min(pid) AS pid FROM (SELECT DISTINCT norm, release FROM a) a JOIN every e ON e.label=a.norm AND e.release=a.release GROUP BY 1, 2)
SELECT o_orderkey, a.release AS release, pid FROM a JOIN m ON a.norm=m.norm AND a.release=m.release""")
def address_by_release(spark, sf):
    """Each address is looked up in the corpus of its own release."""
    corpus = _corpus(spark, sf).withColumn("release", F.when(F.substring("pid", 2, 9).cast("long") % 3 == 0, "202405").otherwise("202411"))
    rows = _norms(spark, sf).where("norm <> ''").withColumn("release", F.when(F.col("o_orderkey") % 8 < 4, "202405").otherwise("202411"))
    found = geocode.exact(rows.select("norm", "release").distinct(), corpus, ["norm", "release"])
    return rows.join(found.select("norm", "release", "pid"), ["norm", "release"]).select("o_orderkey", "release", "pid")


_QUARTER = [release(f"{y}-Q{q}", "quarter_ending") for y in range(1996, 2001) for q in range(1, 5)]


@query(f"WITH {_windows_sql(_QUARTER)} SELECT o_orderkey, release, CAST(mid AS DATE) AS middle FROM orders JOIN w ON release=year(o_orderdate)||'-Q'||quarter(o_orderdate)")
def release_midpoints(spark, sf):
    """The middle of the quarter that each order lies in."""
    from areaweave.functions.temporal import midpoint
    from areaweave.operators.asof import releases_table

    middles = releases_table(spark, _QUARTER).select("release", midpoint(F.col("start"), F.col("end")).alias("middle"))
    orders = _t(spark, sf, "orders").select("o_orderkey", F.concat(F.year("o_orderdate").cast("string"), F.lit("-Q"), F.quarter("o_orderdate").cast("string")).alias("release"))
    return orders.join(middles, "release").select("o_orderkey", "release", "middle")


@query(f"""WITH {_EDGES}, {_hits_sql('SELECT o_orderkey AS id, ' + _xy_sql('o_orderkey') + ' FROM orders')}, {_windows_sql(_YEARS)},
whole AS (SELECT id, 'E2-'||k AS code2 FROM points JOIN tiles ON x>x0 AND x<x0+20 AND y>y0 AND y<y0+20),
o AS (SELECT o_orderkey, area_code, code2, coalesce((SELECT arg_max(release, start_) FROM w WHERE start_<=CAST(o_orderdate AS DATE)), '1996') AS release FROM orders LEFT JOIN hits ON hits.id=o_orderkey LEFT JOIN whole ON whole.id=o_orderkey),
s AS (SELECT *, CASE WHEN release<='1998' THEN code2 ELSE area_code END AS source FROM o), v AS (SELECT *, CAST(replace(source, 'E2-', '') AS INTEGER) AS k FROM s)
SELECT o_orderkey, area_code AS sa2_code, release AS yearly_release, source AS yearly_sa2_code_source, CASE WHEN k%5<>3 THEN CAST(k+CAST(release AS INTEGER) AS BIGINT) END AS sa2_value FROM v""")
def run_dated_points_two_editions(spark, sf):
    """Dated rows; releases up to 1998 are joined on the codes of older, simpler outlines."""
    x, y = _xy("o_orderkey")
    rows = _t(spark, sf, "orders").select("o_orderkey", x.alias("lon"), y.alias("lat"), F.to_date("o_orderdate").alias("day"))
    n = _t(spark, sf, "nation")
    west, south = (F.col("n_nationkey") % 5) * 20.0, F.floor(F.col("n_nationkey") / 5) * 20.0
    p = lambda dx, dy: F.struct((west + dx).alias("x"), (south + dy).alias("y"))
    old = n.select(F.concat(F.lit("E2-"), F.col("n_nationkey")).alias("code"), F.col("n_name").alias("name"), F.array(F.array(p(0.0, 0.0), p(20.0, 0.0), p(20.0, 20.0), p(0.0, 20.0))).alias("rings"))
    out = Registry()
    out.register_spec(DatasetSpec("yearly", "YEARLY", "financial_year_ending", tuple(r.id for r in _YEARS), {r.id: 2 if r.id <= "1998" else 3 for r in _YEARS}))
    code = lambda r: F.concat(F.lit("E2-"), F.col("n_nationkey")) if r <= "1998" else _padded("n_nationkey")
    out.register_loader("yearly", lambda s, r: n.where("n_nationkey % 5 <> 3").select(code(r).alias("sa2_code"), (F.col("n_nationkey") + int(r)).cast("long").alias("value")))
    config = Config(input={"latitude_column": "lat", "longitude_column": "lon", "date_column": "day"}, variables={"value": "YEARLY.value"}, temporal={"out_of_range": "nearest"})
    made = Pipeline(spark, config, Sources({3: _tiles(spark, sf), 2: old}, out), CELL).augment(rows).df
    return made.select("o_orderkey", "sa2_code", "yearly_release", "yearly_sa2_code_source", "sa2_value")
