"""All datasets from files to pipeline results."""

import pytest
from pyspark.sql import functions as F

import areaweave
from areaweave.cli import main
from areaweave.plans.loaders import Store, registry_of
from areaweave.sources import corpus, datasets, editions, files, sidecars
from tests.test_sources import dbf, shp, zipped

CODE, OTHER = "117011326", "117011327"


def book(path, sheets):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(files.write_workbook(sheets))


def ring(x, y, size=0.5):
    return [(x, y), (x, y + size), (x + size, y + size), (x + size, y), (x, y)]


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("store")
    (d / "boundaries/2021").mkdir(parents=True)
    fields = ["SA2_CODE21", "SA2_NAME21", "SA4_CODE21"]
    shapes = shp([[ring(150.0, -34.0)], [ring(150.5, -34.0)]])
    (d / "boundaries/2021/SA2_2021_AUST_SHP_GDA2020.zip").write_bytes(zipped(**{"a.shp": shapes, "a.dbf": dbf(fields, [[CODE, "One", "101"], [OTHER, "Two", "102"]])}))
    (d / "boundaries/2016").mkdir()
    (d / "boundaries/2016/1270055001_sa2_2016_aust_shape.zip").write_bytes(zipped(**{"a.shp": shp([[ring(150.0, -34.0, 1.0)]]), "a.dbf": dbf(["SA2_MAIN16", "SA2_NAME16"], [["111111111", "Old"]])}))
    (d / "lga").mkdir()
    (d / "lga/LGA_2025_AUST_GDA2020.zip").write_bytes(zipped(**{"a.shp": shp([[[(150.0, -34.0), (150.0, -33.5), (151.0, -33.5), (151.0, -34.0), (150.0, -34.0)]]]), "a.dbf": dbf(["LGA_CODE25", "LGA_NAME25"], [["10050", "Both"]])}))
    (d / "mesh_blocks/2021").mkdir(parents=True)
    (d / "mesh_blocks/2021/mb.zip").write_bytes(zipped(**{"m.dbf": dbf(["MB_CODE21", "SA2_CODE21", "SA2_NAME21"], [["11701132601", CODE, "One"]])}))
    (d / "census/2021").mkdir(parents=True)
    (d / "census/2021/2021_GCP_SA2_AUS_short-header.zip").write_bytes(zipped(**{"2021Census_G01_AUS_SA2.csv": f"SA2_CODE_2021,Tot_P_P\n{CODE},10\n{OTHER},20\n", "2021Census_G02_AUS_SA2.csv": f"SA2_CODE_2021,Median_age_persons\n{CODE},35\n"}))
    (d / "census/2016").mkdir()
    (d / "census/2016/2016Census_G01_AUS_SA2.csv").write_text("SA2_MAINCODE_2016,Tot_P_P\n111111111,7\n")
    ds = d / "datasets"
    geo = ["1", "New South Wales", "", "", "", "", "", "", CODE, "One"]
    for year in ("2023", "2022"):
        book(ds / f"erp_by_sa2/{year}/totals.xlsx", {"Table 1": [[]] * 4 + [[None] * 10 + [2022.0, 2023.0], ["code"], [*geo, 90.0, 100.0]]})
    book(ds / "erp_by_sa2/2023/age_sex.xlsx", {"Table 1": [[]] * 5 + [[*geo, 50.0, 50.0, 100.0, 1.0, 38.5, 12.5, 70.5, 17.0]]})
    head = [["Title"]] + [[]] * 3 + [["2021 Statistical Area Level 2 (SA2) 9-Digit Code", "Name"]]
    for year, code in (("2021", CODE), ("2016", "111111111")):
        book(ds / f"seifa/{year}/s.xlsx", {f"Table {k}": head + [[float(code), "One", 100.0, float(year) + k, None, "see note" if k == 3 else 5.0, 1.0, "np", None, "NSW", 1.0, 2.0, 3.0, 4.0, 5.0, 6.0]] for k in range(2, 6)})
    book(ds / "dss_payments/2023-Q1/p.xlsx", {"SA2": [["SA2", "SA2 name", "Age Pension"], [CODE, "One", 10.0], ["11026", "Two", "<20"], ["99999", "?", 1.0]]})
    (d / "short_codes.csv").write_text(f"short,sa2_code\n11026,{OTHER}\n")
    book(ds / "abs_personal_income/2021-22/i.xlsx", {"Table 1.4": [["t"], [None, None, "Earners (persons)", None], [None, None, "2020-21", "2021-22"], [CODE, "n", 1.0, 2.0]]})
    top = ["Code", "Name", *[h.capitalize() for h in datasets.BA_HEADERS]]
    for name, sheet, code in (("abs_building_approvals", "Table_1", CODE), ("abs_building_approvals_lga", "Table 1", "10050")):
        book(ds / f"{name}/2024-25/1.xlsx", {sheet: [["t"], [], top, ["", "", "no."], [code, "n", *[100.0 * k for k in range(9)]]]})
    book(ds / "abs_business_counts/2024/b.xlsx", {"Notes": [["x"]], "Table": [["Businesses by SA2, June 2024"], ["Industry", "", "SA2", "", "Non employing", "1-4 Employees", "5-19", "20-199", "200+", "Total"], ["A", "a", CODE, "S", 1.0, 2.0, None, 0.0, 0.0, 3.0]]})
    (ds / "salm_labour_force/2025-Q4").mkdir(parents=True)
    (ds / "salm_labour_force/2025-Q4/s.csv").write_bytes(f'note\nData Item,SA2 name,SA2 Code (2021 ASGS),Dec-25\nSmoothed unemployment (persons),S,{CODE},"1,234"\n'.encode())
    for k, (i, source) in enumerate(datasets.HEALTH.items()):
        year = {"aihw_mh_admitted_patients": "2023-24", "aihw_mh_ed_presentations": "2023-24", "aihw_mh_community": "2023-24"}.get(i, "2024-25")
        columns = [source.code, source.measure, source.value, *source.filters, *([source.year] if source.year else [])]
        lines = [",".join(columns)] + [",".join([("SA4-" if source.prefix == "^SA4-" else "SA4" if source.prefix else "") + "101", m, str(10 * k + n), *source.filters.values(), *([year] if source.year else [])]) for n, m in enumerate(source.measures)]
        (ds / f"{i}/{year}").mkdir(parents=True)
        (ds / f"{i}/{year}/h.zip").write_bytes(zipped(**{f"Table {' '.join(source.members)}.csv": "\n".join(lines) + "\n"}))
    book(ds / "aihw_social_housing/2023/h.xlsx", {"DWELLINGS.4": [["Dwellings by SA4, June 2023"], [], ["State", "Region Code", "Region", "Public housing", "SOMIH", "Community housing", "Total"], ["NSW", "101", "r", 5.0, ". .", 1.0, 6.0]]})
    row = spark.createDataFrame([("P1", "1 GEORGE STREET", "SYDNEY", "NSW", "2000", -33.9, 150.1, "old", "11701132601")], "gnaf_pid string, address string, locality_name string, state string, postcode string, latitude double, longitude double, mb_2016_code string, mb_2021_code string")
    row.write.parquet(str(d / "gnaf/202405" / corpus.LOADER))
    return str(d)


def test_every_dataset_by_area(spark, root):
    r = registry_of(Store(spark, root))
    assert set(r.loaders) == {s.id for s in r.list_datasets()}
    given = {"erp_by_sa2": "2023", "dss_payments": "2023-Q1", "abs_personal_income": "2021-22", "abs_business_counts": "2024"}
    for spec in r.list_datasets():
        for _ in range(2):  # parsed, and as kept
            df = r.load(spark, spec.id, given.get(spec.id))
            assert df.columns[0] == "sa2_code" and {x[0] for x in df.select("sa2_code").collect()} <= {CODE, OTHER}, spec.id
    at = lambda i: {x["sa2_code"]: x for x in r.load(spark, i, given.get(i)).collect()}
    erp = at("erp_by_sa2")[CODE]
    assert erp["population_total"] == 100 and erp["population_0_14"] == 12 and erp["population_density_per_km2"] == pytest.approx(100 / 2566, rel=0.01)
    assert at("dss_payments")[OTHER]["age_pension_recipients"] is None and at("dss_payments")[CODE]["age_pension_recipients"] == 10
    # by region: every area is there, without values where the region has none
    med = at("aihw_mh_medicare")
    assert med[CODE]["mh_medicare_patients_count"] is not None and med[OTHER]["mh_medicare_patients_count"] is None
    assert at("aihw_social_housing")[CODE]["social_housing_total_count"] == 6
    # by council: nine columns dealt by area in one pass
    lga = at("abs_building_approvals_lga")
    # the council's long edges bulge a little against those of the areas in the plane
    assert [lga[CODE][c] + lga[OTHER][c] for c in datasets.BA_COLUMNS] == pytest.approx([100.0 * k for k in range(9)], rel=2e-3) and lga[CODE]["total_dwellings_count"] == pytest.approx(100, rel=2e-3)
    # a column with a cell that is neither missing nor a number stays text
    seifa = dict(r.load(spark, "seifa", "2021").dtypes)
    assert seifa["irsd_score"] == "double" and seifa["irsad_aus_rank"] == "string"
    assert files.stored(spark, sidecars.release_path(root, "seifa", "2021"))
    with pytest.raises(FileNotFoundError, match="2020"):
        r.load(spark, "erp_by_sa2", "2020")
    with pytest.raises(KeyError):
        r.load(spark, "gcp", "2021", ["G99.x"])


def test_weights_keep_their_names(spark, root, tmp_path):
    store = Store(spark, root)
    w, a, b = sidecars.read_weights(spark, f"{root}/sidecars/correspondence/sa2_2021_lga_2025") if store.weights else None
    assert (a, b) == ("SA2_CODE21", "LGA_CODE25") and sidecars.weight_summary(w).first().asDict() == {"pairs": 2, "sa2s": 2, "lgas": 1}
    w.write.parquet(str(tmp_path / "plain"))
    assert sidecars.read_weights(spark, str(tmp_path / "plain"))[1:] == ("sa2_code", "lga_code")


def test_editions():
    assert editions.edition(2016, "GDA94").code == "SA2_MAIN16" and editions.edition(2021, "GDA94").file == "SA2_2021_AUST_SHP_GDA94.zip"
    assert editions.lga_edition().code == "LGA_CODE25" and editions.lga_edition(2021).file == "LGA_2021_AUST_GDA2020.zip"
    for call in (lambda: editions.edition(2016), lambda: editions.edition(2006, "GDA94"), lambda: editions.lga_edition(2019)):
        with pytest.raises(ValueError):
            call()


def config(**more):
    base = {"input": {"address_column": "addr", "latitude_column": "lat", "longitude_column": "lon"}, "variables": {"people": "G01.Tot_P_P", "age": "G02.Median_age_persons", "pop": "ERP.population_total", "patients": "AIHW_MBS.mh_medicare_patients_count", "dwellings": "ABS_BA_LGA.total_dwellings_count"}}
    return areaweave.Config.model_validate(base | more)


def test_from_config_to_file(spark, root, tmp_path):
    (tmp_path / "in.csv").write_text("i,addr,lat,lon\n" + "".join(f"{i},{a},{y},{x}\n" for i, a, y, x in [(3, "1 George St Sydney NSW 2000", "", ""), (1, "", -33.9, 150.6), (2, "nowhere", "", ""), (0, "", -33.9, 150.2)]))
    # releases that the folder does not have are not asked for by default: the population of 2024 is missing
    c = config(input={"address_column": "addr", "latitude_column": "lat", "longitude_column": "lon", "path": str(tmp_path / "in.csv")}, output={"path": str(tmp_path / "out")}, variables={"people": "G01.Tot_P_P", "age": "G02.Median_age_persons", "patients": "AIHW_MBS.mh_medicare_patients_count", "dwellings": "ABS_BA_LGA.total_dwellings_count"})
    summary = areaweave.Pipeline.from_config(spark, c, root).run()
    assert (summary.rows, summary.failed, summary.sources["gnaf_exact"], summary.resolutions["mb_code"]) == (4, 1, 1, 1)
    out = spark.read.csv(str(tmp_path / "out"), header=True).collect()
    assert [r["i"] for r in out] == ["3", "1", "2", "0"] and [r["sa2_code"] for r in out] == [CODE, OTHER, None, CODE] and [r["sa2_people"] for r in out] == ["10.0", "20.0", None, "10.0"]
    with pytest.raises(KeyError):
        areaweave.Pipeline.from_config(spark, config(variables={"x": "G01.Nope"}), root)
    with pytest.raises(ValueError, match="input.path"):
        areaweave.Pipeline.from_config(spark, config(variables={"x": "G01.Tot_P_P"}), root).run()


def test_dated_rows_over_the_folder(spark, root):
    c = config(input={"latitude_column": "lat", "longitude_column": "lon", "date_column": "d"}, variables={"people": "G01.Tot_P_P", "irsd": "SEIFA.irsd_score", "pop": "ERP.population_total"}, temporal={"per_dataset": {"erp_by_sa2": {"resolution": "closest"}}})
    rows = spark.createDataFrame([(0, -33.9, 150.2, "2018-01-01"), (1, -33.9, 150.2, "2023-01-01")], "i int, lat double, lon double, d string").withColumn("d", F.to_date("d"))
    # only the releases that some row takes are read: the folder has no others
    p = areaweave.Pipeline.from_config(spark, c, root)
    for i in ("erp_by_sa2", "gcp", "seifa"):
        spec = p.sources.registry.get(i)
        kept = tuple(r for r in spec.releases if r in {"erp_by_sa2": ("2022", "2023"), "gcp": ("2016", "2021"), "seifa": ("2016", "2021")}[i])
        p.sources.registry.register_spec(type(spec)(spec.id, spec.namespace, spec.basis, kept, spec.editions, spec.columns, spec.level))
    got = p.augment(rows).df.orderBy("i").collect()
    assert [(r["gcp_sa2_code_source"], r["sa2_people"], r["sa2_irsd"], r["erp_by_sa2_release"], r["sa2_pop"]) for r in got] == [("111111111", 7.0, 2018.0, "2022", 90.0), (CODE, 10.0, 2023.0, "2023", 100.0)]


def test_releases_are_pruned_when_the_query_runs(spark, root):
    """The releases of a dataset are one parted table; which of them are read is told by the dates, in the plan."""
    r = registry_of(Store(spark, root))
    df, lacking = r.load_releases(spark, "seifa", ["2011", "2016", "2021"])
    assert lacking == ["2011"] and {(x["release"], x["sa2_code"], x["irsd_score"]) for x in df.select("release", "sa2_code", "irsd_score").collect()} == {("2016", "111111111", 2018.0), ("2021", CODE, 2023.0)}
    for i, level in (("abs_building_approvals_lga", "LGA"), ("aihw_mh_medicare", "SA4"), ("erp_by_sa2", "SA2")):
        # all levels: the one table of several releases has the rows of each
        spec = r.get(i)
        whole, _ = r.load_releases(spark, i, list(spec.releases))
        for release in {x["release"] for x in whole.select("release").distinct().collect()}:
            one = r.load(spark, i, release)
            want = {tuple(x) for x in one.where("sa2_code = '" + CODE + "'").select(*sorted(one.columns)).collect()}
            assert {tuple(x) for x in whole.where((F.col("release") == release) & (F.col("sa2_code") == CODE)).select(*sorted(one.columns)).collect()} == want and len(want) == 1
    c = config(input={"latitude_column": "lat", "longitude_column": "lon", "date_column": "d"}, variables={"irsd": "SEIFA.irsd_score"})
    p = areaweave.Pipeline.from_config(spark, c, root)
    spec = p.sources.registry.get("seifa")
    p.sources.registry.register_spec(type(spec)(spec.id, spec.namespace, spec.basis, ("2011", "2016", "2021"), spec.editions, spec.columns, spec.level))
    rows = spark.createDataFrame([(0, -33.9, 150.2, "2018-01-01"), (1, -33.9, 150.2, "2023-01-01")], "i int, lat double, lon double, d string").withColumn("d", F.to_date("d"))
    done = p.augment(rows).df
    assert [(x["sa2_irsd"], x["seifa_release"]) for x in done.orderBy("i").collect()] == [(2018.0, "2016"), (2023.0, "2021")]
    assert "dynamicpruning" in done._jdf.queryExecution().executedPlan().toString()
    # a row that takes a release without files is an error when it is read, and only then
    late = p.augment(rows.withColumn("d", F.lit("2012-06-01").cast("date"))).df
    with pytest.raises(Exception, match="no files of seifa, release 2011"):
        late.collect()


def test_old_codes_come_from_the_boundaries(spark, root):
    """Five-digit codes are those of the boundaries' own column, else state and last four digits; doubtful ones are left out."""
    store = Store(spark, root)
    store.__dict__["sa2"] = None
    frame = spark.createDataFrame([("117011326", {"SA2_5DIG16": "11326"}), ("217021326", {}), ("217031326", {"x": "y"}), ("317041329", None)], "code string, attributes map<string,string>")
    import areaweave.plans.loaders as loaders

    old, loaders.listed = loaders.listed, lambda *a: []
    try:
        store.boundary_table = lambda year: frame
        got = {r["short"]: r["sa2_code"] for r in store.short_codes.collect()}
    finally:
        loaders.listed = old
    assert got == {"11326": "117011326", "31329": "317041329"}


def test_variables_are_checked_by_the_catalogue(spark, root, tmp_path, capsys):
    cells = [["Short", "Long", "DataPackfile"], ["Tot_P_P", "Total persons", "G01"], ["Tot_P_M", "Total males", "G01"], ["Median_age_persons", "Median age", "G02"]]
    place = tmp_path / "store"
    import shutil

    shutil.copytree(root, place, ignore=shutil.ignore_patterns("sidecars"))
    book(place / "census/2021/Metadata_2021_GCP_DataPack.xlsx", {"Cells": cells})
    assert areaweave.VariableCatalog(Store(spark, str(place)).catalogue(2021)).list_table("G01").count() == 2
    with pytest.raises(areaweave.CatalogError, match="Tot_P_P"):
        areaweave.Pipeline.from_config(spark, config(variables={"x": "G01.Tot_P_Q"}), str(place))
    yaml = tmp_path / "c.yaml"
    for table, said, code in (("G01.Tot_P_X", "Tot_P_", 1), ("G04.x", "G01", 1), ("G02.Median_age_persons", "valid", 0)):
        yaml.write_text(f"input: {{address_column: a}}\nvariables: {{x: {table}}}\n")
        assert main(["validate", str(yaml), "--data-dir", str(place)]) == code
        out = capsys.readouterr()
        assert said in out.out + out.err
    # without a workbook the nearest columns of the table itself are named
    with pytest.raises(KeyError, match="Tot_P_P"):
        areaweave.Pipeline.from_config(spark, config(variables={"x": "G01.Tot_P_Q"}), root)


def test_a_replaced_boundary_file_is_read_again(spark, root, tmp_path):
    import shutil

    place = tmp_path / "store"
    shutil.copytree(f"{root}/boundaries", place / "boundaries")
    names = lambda: {r["name"] for r in Store(spark, str(place)).sa2.collect()}
    assert names() == {"One", "Two"}
    file = place / "boundaries/2021/SA2_2021_AUST_SHP_GDA2020.zip"
    file.write_bytes(zipped(**{"a.shp": shp([[ring(150.0, -34.0)]]), "a.dbf": dbf(["SA2_CODE21", "SA2_NAME21", "SA4_CODE21"], [[CODE, "Three", "101"]])}))
    assert names() == {"Three"}


def test_command_line(spark, root, tmp_path, capsys):
    (tmp_path / "c.yaml").write_text(f"input: {{address_column: addr, path: {tmp_path}/in.csv}}\noutput: {{path: {tmp_path}/out}}\nvariables: {{people: G01.Tot_P_P}}\ntemporal: {{per_dataset: {{seifa: {{resolution: closest}}}}}}\n")
    (tmp_path / "in.csv").write_text("i,addr\n1,1 George St Sydney NSW 2000\n")
    c = str(tmp_path / "c.yaml")
    assert main(["fetch", "-c", c, "--data-dir", root]) == 2
    assert main(["fetch", "-c", c, "--data-dir", root, "--boundaries", "--census", "--gnaf"]) == 0
    assert main(["gnaf-info", "-c", c, "--data-dir", root]) == 0
    assert main(["run", c]) == 2 and main(["run", c, "--data-dir", root]) == 0
    said = capsys.readouterr().out
    assert "Boundaries: 2 areas" in said and "release 202405" in said and "Resolved release: 202405" in said and "Rows: 1" in said


def test_filters_tell_what_leaves_nothing(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "x string, y int")
    assert datasets.all_equal(df, {"x": F.col("x") == "a", "y": F.col("y") == 1}).count() == 1 and datasets.all_equal(df, {}).count() == 3
    with pytest.raises(ValueError, match="the y that.*2"):
        datasets.all_equal(df, {"x": F.col("x") == "a", "y": F.col("y") == 2})


def test_stores_of_their_own_and_hooks(spark, root, tmp_path, monkeypatch):
    """Boundaries, data packs and councils may lie in other stores; loaders tell what a request means and what is kept."""
    import shutil

    from areaweave.plans.wiring import sources_of

    away, here = tmp_path / "away", tmp_path / "here"
    here.mkdir()
    shutil.copytree(f"{root}/boundaries/2021", away / "asgs")
    shutil.copytree(f"{root}/census", away / "packs")
    shutil.copytree(f"{root}/datasets/abs_personal_income", here / "datasets/abs_personal_income")
    c = config(input={"latitude_column": "lat", "longitude_column": "lon"}, variables={"people": "G01.Tot_P_P"}, data_sources={"boundaries_base_url": f"{away}/asgs/", "datapacks_base_url": str(away / "packs")})
    got = areaweave.Pipeline.from_config(spark, c, str(here)).augment(spark.createDataFrame([(-33.9, 150.2)], "lat double, lon double")).df.first()
    assert (got["sa2_code"], got["sa2_people"]) == (CODE, 10.0) and (here / "sidecars/boundaries").exists()
    loader = sources_of(spark, c, str(here)).registry.loaders["abs_personal_income"]
    assert loader.resolved_release("latest") == "2021-22" == loader.resolved_release() and not loader.is_cached()
    loader(spark).count()
    assert loader.is_cached() and loader.is_cached("2021-22") and not loader.is_cached("2020-21")
    monkeypatch.setenv("AREAWEAVE_DATAPACK_ZIP", str(tmp_path / "mine.zip"))
    (tmp_path / "mine.zip").write_bytes(zipped(**{"2021Census_G01_AUS_SA2.csv": f"SA2_CODE_2021,Tot_P_P\n{CODE},99\n"}))
    assert sources_of(spark, c, str(here)).registry.load(spark, "gcp", None, ["G01.Tot_P_P"]).first()["G01.Tot_P_P"] == 99.0
