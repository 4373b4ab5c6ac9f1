from datetime import datetime

import pytest
from pyspark.sql import functions as F

from areaweave.operators.geocode import CorpusProvider
from areaweave.plans.config import Config, load_config
from areaweave.plans.pipeline import Pipeline, Sources
from areaweave.plans.presets import PRESETS, FeatureRegistry, parse_feature
from areaweave.plans.registry import CatalogError, DatasetSpec, Registry, VariableCatalog, parse_dataset_spec
from tests.test_operators import RINGS, areas, box, corpus  # noqa: F401


@pytest.fixture
def registry(spark):
    g01 = spark.createDataFrame([("117011326", 5000, 10200), ("117011327", 4500, 9300), ("117011328", 6000, 12300)], "sa2_code string, Tot_P_M int, Tot_P_P int")
    g02 = spark.createDataFrame([("117011326", 35, 1800), ("117011327", 38, 2200), ("117011328", 42, 2500)], "sa2_code string, Median_age_persons int, inc int")
    wide = g01.join(g02, "sa2_code", "full_outer").select("sa2_code", *[F.col(c).alias(f"G01.{c}") for c in ("Tot_P_M", "Tot_P_P")], F.col("Median_age_persons").alias("G02.Median_age_persons"))
    r = Registry()
    r.register_loader("gcp", lambda s, rel: wide)
    erp = lambda s, rel: spark.createDataFrame([(c, int(rel or 0) * 10 + k) for k, c in enumerate(("117011326", "117011327"))], "sa2_code string, population_total int")
    r.register_loader("erp_by_sa2", erp)
    seifa = lambda s, rel: spark.createDataFrame([("OLD1", 16.0), ("117011326", 21.0)], "sa2_code string, irsd_score double").withColumn("irsd_score", F.col("irsd_score") + F.lit(float(rel or 0)))
    r.register_loader("seifa", seifa)
    return r


def test_end_to_end(spark, areas, corpus, registry):  # noqa: F811
    mb = spark.createDataFrame([("11701132601", "117011326", "Sydney CBD"), ("11701132801", "117011328", "Eastern Suburbs")], "mb_code string, sa2_code string, sa2_name string")
    sources = Sources({3: areas}, registry, [CorpusProvider(corpus)], mb)
    p = Pipeline.create(spark, sources, {"age": "G02.Median_age_persons", "population": "G01.Tot_P_P", "again": "G01.Tot_P_P"}, address_column="addr", latitude_column="lat", longitude_column="lon")
    rows = spark.createDataFrame([(0, None, -33.86, 151.21), (1, "1 George St Sydney NSW 2000", None, None), (2, "gone", None, None)], "i int, addr string, lat double, lon double")
    r = p.augment(rows)
    assert r.df.columns == ["i", "addr", "lat", "lon", "geo_lat", "geo_lon", "geo_source", "geo_match_score", "sa2_code", "sa2_name", "sa2_resolution", "sa2_age", "sa2_population", "sa2_again"]
    got = r.df.orderBy("i").collect()
    assert [(x["geo_source"], x["sa2_code"], x["sa2_resolution"], x["sa2_age"], x["sa2_population"], x["sa2_again"]) for x in got] == [
        ("input", "117011326", "spatial_join", 35, 10200, 10200), ("gnaf_exact", "117011326", "mb_code", 35, 10200, 10200), ("failed", None, None, None, None, None)]
    assert r.summary.fully_enriched == 2 and r.summary.failed == 1
    assert p.augment(rows.limit(0)).df.columns == r.df.columns
    with pytest.raises(ValueError, match="locator"):
        p.augment(rows.select("i"))
    with pytest.raises(ValueError, match="names of the result"):
        p.augment(rows.withColumn("sa2_code", F.lit("x")))
    assert p.augment(rows.drop("addr")).unused == ["addr"]


def test_preset_only(spark, areas, registry):  # noqa: F811
    features = FeatureRegistry()
    features.register(parse_feature("---\nid: share\noutput_kind: percentage\nbounds: [0, 40]\nnumerator:\n  expression: field\n  field: G01.Tot_P_M\ndenominator:\n  expression: field\n  field: G01.Tot_P_P\nedge_cases:\n  zero_denominator: null\n---\ntext"))
    p = Pipeline.create(spark, Sources({3: areas}, registry, features=features), {"share": "PRESET.share"}, latitude_column="lat", longitude_column="lon")
    r = p.augment(spark.createDataFrame([(-33.86, 151.21)], "lat double, lon double"))
    assert r.df.first()["sa2_share"] == pytest.approx(100 * 5000 / 10200)
    assert p.bound_warnings(r) == {"sa2_share": 1}


def test_temporal_rows_keep_their_releases(spark, areas, registry):  # noqa: F811
    old = spark.createDataFrame([("OLD1", "old", [box(151.0, -34.0, 152.0, -33.0)])], RINGS)
    config = Config(input={"latitude_column": "lat", "longitude_column": "lon", "date_column": "d"}, variables={"pop": "ERP.population_total", "irsd": "SEIFA.irsd_score"})
    p = Pipeline(spark, config, Sources({3: areas, 2: old, 1: old}, registry))
    days = ["2023-04-01", "2023-04-02", "2024-06-01", "2018-06-01"]
    rows = spark.createDataFrame([(i, -33.86, 151.21, datetime.fromisoformat(d)) for i, d in enumerate(days)], "i int, lat double, lon double, d timestamp")
    r = p.augment(rows)
    got = r.df.orderBy("i").collect()
    assert [(x["erp_by_sa2_release"], x["sa2_pop"], x["seifa_release"], x["seifa_sa2_code_source"], x["sa2_irsd"]) for x in got] == [
        ("2023", 20230, "2021", "117011326", 2042.0), ("2023", 20230, "2021", "117011326", 2042.0), ("2024", 20240, "2021", "117011326", 2042.0), ("2018", 20180, "2016", "OLD1", 2032.0)]
    assert r.releases_used() == {"erp_by_sa2": ["2018", "2023", "2024"], "seifa": ["2016", "2021"]}
    with pytest.raises(ValueError, match="first release"):
        p.augment(rows.withColumn("d", F.lit("1990-01-01").cast("timestamp")))
    assert p.augment(rows.limit(0)).df.count() == 0


def test_registry_and_specs():
    r = Registry()
    assert len(r.list_datasets()) == 15 and len(PRESETS) == 23
    assert r.resolve_variable("ERP.population_total")[0].id == "erp_by_sa2"
    assert r.resolve_variable("G04A.x") == (r.get("gcp"), "G04A.x")
    for bad in ("NOPE.x",):
        with pytest.raises(KeyError):
            r.resolve_variable(bad)
    with pytest.raises(KeyError):
        r.register_loader("nope", None)
    spec = parse_dataset_spec("---\nid: d\nnamespace: D\ntemporal:\n  cover_basis: calendar_year_ending\n  available_releases: ['2023']\n  asgs_edition_by_release: {'2023': 3}\n---\n| `D.a` | int | x |\n| `D.b` | str | y |\n")
    assert spec == DatasetSpec("d", "D", "calendar_year_ending", ("2023",), {"2023": 3}, ("a", "b"))


def test_catalog(spark):
    c = VariableCatalog(spark.createDataFrame([("G01", 0, "Tot_P_P", "Total persons"), ("G01", 1, "Tot_P_M", "Males"), ("G02", 2, "Median_age", "tot words")], "table_id string, pos int, code string, description string"))
    assert [r["code"] for r in c.search("tot").collect()] == ["Tot_P_P", "Tot_P_M", "Median_age"]
    assert c.resolve("G01.Tot_P_P") == ("G01", "Tot_P_P")
    with pytest.raises(CatalogError, match="Tot_P_P"):
        c.validate_variables(["G01.Tot_P_X", "G99.x"])


def test_config():
    ok = load_config("input: {address_column: a}\nvariables: {x: G01.Tot_P_P}\n")
    assert ok.output.prefix == "sa2_" and ok.geocoding.gnaf.fuzzy_threshold == 0.85
    bad = [
        "input: {latitude_column: a}\nvariables: {x: G01.y}", "input: {}\nvariables: {x: G01.y}", "input: {address_column: a}\nvariables: {}", "input: {address_column: a}\nvariables: {X: G01.y}",
        "input: {address_column: a}\nvariables: {x: nodot}", "input: {address_column: a}\nvariables: {x: G01.y}\nother: 1", "input: {address_column: a}\nvariables: {x: G01.y}\ncensus: {year: 2016}",
        "input: {address_column: a}\nvariables: {x: G01.y}\ngeocoding: {providers: [nominatim]}", "input: {address_column: a}\nvariables: {x: G01.y}\noutput: {prefix: A}",
    ]
    for text in bad:
        with pytest.raises(ValueError):
            load_config(text)


def test_cli(tmp_path, capsys):
    from areaweave.cli import main

    good, bad = tmp_path / "a.yaml", tmp_path / "b.yaml"
    good.write_text("input: {address_column: a}\nvariables: {x: G01.Tot_P_P}\n")
    bad.write_text("input: {}\n")
    assert main(["validate", str(good)]) == 0 and main(["validate", str(bad)]) == 1 and main(["nope"]) == 2 and main(["discover", "seifa"]) == 0
    assert "SEIFA" in capsys.readouterr().out
