"""Registered queries of what sources do to tables: code maps, attachments, outside geocodes, releases of pages, filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from areaweave.functions.address import cache_key
from areaweave.operators import asof, geocode, spatial
from areaweave.plans.queries import _ADDRESSES, _EDGES, _YEARS, _corpus, _norms, _t, _tiles, _windows_sql, query
from areaweave.plans.registry import DatasetSpec, Registry
from areaweave.sources import datasets, files

_CODE = "(1+{0}%8)||lpad(CAST({0}*7919%100000000 AS VARCHAR), 8, '0')"


def _nine(k):
    return F.concat((F.lit(1) + k % 8).cast("string"), F.lpad((k * 7919 % 100000000).cast("string"), 8, "0"))


@query(f"""WITH c AS (SELECT c_custkey, {_CODE.format('c_custkey')} AS code, CASE WHEN c_custkey%4=0 THEN 'S'||lpad(CAST(c_custkey AS VARCHAR), 4, '0') END AS own FROM customer),
m AS (SELECT coalesce(own, substr(code, 1, 1)||substr(code, 6, 4)) AS short, min(code) AS sa2_code FROM c GROUP BY 1 HAVING count(DISTINCT code)=1),
o AS (SELECT o_orderkey, CASE o_orderkey%3 WHEN 0 THEN code WHEN 1 THEN coalesce(own, substr(code, 1, 1)||substr(code, 6, 4)) ELSE '99999' END AS code FROM orders JOIN c ON o_custkey=c_custkey)
SELECT o_orderkey, coalesce(m.sa2_code, o.code) AS sa2_code FROM o LEFT JOIN m ON m.short=o.code""")
def short_codes_to_long(spark, sf):
    """Five-digit codes of rows, looked up in a map made of the boundaries' attributes; doubtful ones stay."""
    k = F.col("c_custkey")
    own = F.when(k % 4 == 0, F.concat(F.lit("S"), F.lpad(k.cast("string"), 4, "0")))
    c = _t(spark, sf, "customer").select("c_custkey", _nine(k).alias("code"), own.alias("own"))
    boundaries = c.select("code", F.when(F.col("own").isNotNull(), F.create_map(F.lit("SA2_5DIG16"), "own")).otherwise(F.create_map(F.lit("x"), F.lit("y"))).alias("attributes"))
    short = F.coalesce("own", F.concat(F.substring("code", 1, 1), F.substring("code", 6, 4)))
    kind = F.col("o_orderkey") % 3
    rows = _t(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.when(kind == 0, F.col("code")).when(kind == 1, short).otherwise("99999").alias("sa2_code"))
    return datasets.long_codes(rows, datasets.code_map(boundaries)).select("o_orderkey", "sa2_code")


@query(f"""WITH {_EDGES}, a AS (SELECT code, abs(sum(x1*y2-x2*y1)/2) AS area FROM edges GROUP BY code),
p AS (SELECT lpad(CAST(c_nationkey AS VARCHAR), 9, '0') AS sa2_code, count(*) AS population_total FROM customer GROUP BY 1)
SELECT sa2_code, population_total, round(population_total/area, 9) AS density FROM p LEFT JOIN a ON code=sa2_code""")
def attach_density(spark, sf):
    """Persons by area of the outline that a dataset's code stands for."""
    people = _t(spark, sf, "customer").groupBy(F.lpad(F.col("c_nationkey").cast("string"), 9, "0").alias("sa2_code")).agg(F.count("*").alias("population_total"))
    out = datasets.with_density(people, spatial.areas(_tiles(spark, sf), project=False))
    return out.select("sa2_code", "population_total", F.round("population_density_per_km2", 9).alias("density"))


@query(f"""WITH {_ADDRESSES}, d AS (SELECT DISTINCT norm FROM addr WHERE norm<>''), m1 AS (SELECT norm, min(pid) AS pid FROM d JOIN corpus ON label=norm GROUP BY norm),
k AS (SELECT DISTINCT norm FROM addr WHERE o_orderkey%8=2) SELECT o_orderkey, CASE WHEN m1.pid IS NOT NULL THEN 'gnaf_exact' WHEN k.norm IS NOT NULL THEN 'nominatim_cache' ELSE 'failed' END AS geo_source,
CASE WHEN m1.pid IS NOT NULL THEN (CAST(substr(m1.pid, 2) AS BIGINT)*61)%1000/10.0 WHEN k.norm IS NOT NULL THEN CAST(length(k.norm) AS DOUBLE) END AS geo_lat FROM addr LEFT JOIN m1 USING (norm) LEFT JOIN k USING (norm)""")
def address_outside_cache(spark, sf):
    """Addresses that the corpus does not have, looked up among kept results of an outside geocoder, some written twice."""
    kept = _norms(spark, sf).where("o_orderkey % 8 = 2").select(cache_key(F.col("norm")).alias("hash"), F.length("norm").cast("double").alias("lat"), F.lit(0.5).alias("lon")).distinct()

    class Exact:
        def resolve(self, addresses):
            return geocode.exact(addresses, _corpus(spark, sf), ["norm"])

    rows = _norms(spark, sf).select("o_orderkey", F.col("norm").alias("raw"))
    return geocode.resolve(rows, "raw", None, None, [Exact(), geocode.CachedProvider(kept)]).select("o_orderkey", "geo_source", "geo_lat")


@query(f"""WITH {_windows_sql(_YEARS)}, o AS (SELECT o_orderkey, c_nationkey AS k, (SELECT arg_max(release, start_) FROM w WHERE start_<=CAST(o_orderdate AS DATE)) AS release FROM orders JOIN customer ON o_custkey=c_custkey WHERE o_orderdate<DATE '1998-01-01')
SELECT o_orderkey, release, CASE WHEN release<>'1997' OR k%2=0 THEN CAST(k*10+CAST(release AS INTEGER) AS BIGINT) END AS value FROM o""")
def releases_taken_only(spark, sf):
    """All releases of a dataset as one table, of which a semi-join keeps those that the dates take."""
    n = _t(spark, sf, "nation")
    known = Registry()
    known.register_spec(DatasetSpec("yearly", "YEARLY", "financial_year_ending", tuple(r.id for r in _YEARS)))
    known.register_loader("yearly", lambda s, r: n.where("true" if r != "1997" else "n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("string").alias("sa2_code"), (F.col("n_nationkey") * 10 + int(r)).cast("long").alias("v")))
    values, lacking = known.load_releases(spark, "yearly", [r.id for r in _YEARS])
    assert not lacking
    o = _t(spark, sf, "orders").where("o_orderdate < '1998-01-01'").join(_t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = asof.asof_release(o.select("o_orderkey", F.to_date("o_orderdate").alias("day"), F.col("c_nationkey").cast("string").alias("code")), "day", _YEARS)
    taken = asof.asof_release(_t(spark, sf, "orders").where("o_orderdate < '1998-01-01'").select(F.to_date("o_orderdate").alias("day")).distinct(), "day", _YEARS).select("release").distinct()
    return asof.cross_edition_join(rows, values, "release", {}, {3: "code"}, {"value": "v"}, taken=taken).select("o_orderkey", "release", "value")


@query(r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href\s*=\s*["'']([^"'']+)["'']', 1)) AS link, generate_subscripts(regexp_extract_all(html, 'href\s*=\s*["'']([^"'']+)["'']', 1), 1) AS pos FROM pages),
r AS (SELECT page_id, 'short' AS dataset, regexp_extract(link, '^/([a-z]{2,3})[.,]?$', 1) AS release, 0 AS p, pos, link FROM l WHERE regexp_matches(link, '^/([a-z]{2,3})[.,]?$') UNION ALL SELECT page_id, 'title', regexp_extract(link, '^/([A-Z][^/]*)$', 1), 0, pos, link FROM l WHERE regexp_matches(link, '^/([A-Z][^/]*)$')
 UNION ALL SELECT page_id, 'title', regexp_extract(link, '^/([a-z]{5,})$', 1), 1, pos, link FROM l WHERE regexp_matches(link, '^/([a-z]{5,})$')),
f AS (SELECT page_id, dataset, release, arg_min(link, struct_pack(p:=p, pos:=pos)) AS link FROM r GROUP BY 1, 2, 3) SELECT page_id, dataset, max(release) AS release, arg_max(link, release) AS link FROM f GROUP BY 1, 2""")
def page_releases_newest(spark, sf):
    """Of the links on every page, those that rules fit, and of each rule's dataset the newest release."""
    rules = (files.ReleaseRule("short", r"^/([a-z]{2,3})[.,]?$"), files.ReleaseRule("title", r"^/([A-Z][^/]*)$"), files.ReleaseRule("title", r"^/([a-z]{5,})$", precedence=1))
    return files.newest_release(files.page_releases(_t(spark, sf, "pages").select("page_id", "html"), "html", rules, "page_id"), "page_id")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus='F' AND o_orderpriority='5-LOW' AND year(o_orderdate)=1997")
def conjunctive_filters(spark, sf):
    """Rows that meet all conditions of a sheet, with an error if none does."""
    o = _t(spark, sf, "orders")
    wanted = {"o_orderstatus": F.col("o_orderstatus") == "F", "o_orderpriority": F.col("o_orderpriority") == "5-LOW", "o_orderdate": F.year("o_orderdate") == 1997}
    return datasets.all_equal(o, wanted).select("o_orderkey", "o_totalprice")
