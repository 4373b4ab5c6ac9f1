import io
import struct
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from areaweave.functions.temporal import release
from areaweave.sources import census, corpus, datasets, files, sidecars
from areaweave.streaming import release_stream, windowed_counts


def zipped(**members):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return b.getvalue()


def test_csv_encodings(spark, tmp_path):
    for i, (enc, text) in enumerate((("utf-8-sig", "näme,v\nä,1\n"), ("utf-8", "näme,v\nä,1\n"), ("cp1252", "näme,v\nä,1\n"))):
        p = tmp_path / f"{i}.csv"
        p.write_bytes(text.encode(enc))
        df = files.read_csv(spark, str(p))
        assert df.columns == ["näme", "v"] and df.first()[0] == "ä"
    (tmp_path / "bad.csv").write_bytes(b"a\n\x81\xff\n")
    with pytest.raises(ValueError, match="encodings"):
        files.read_csv(spark, str(tmp_path / "bad.csv"))
    files.write_csv(spark.createDataFrame([(2, "b"), (1, "a")], "o int, v string"), str(tmp_path / "out"), "o")
    assert [r[0] for r in spark.read.csv(str(tmp_path / "out"), header=True).collect()] == ["a", "b"]


def test_workbook_round_trip():
    grid = [["Title"], [], ["code", None, "x & <y>"], ["101021007", None, 1.5]]
    assert files.workbook(files.write_workbook({"Table 1": grid, "b": [[1.0]]})) == {"Table 1": [["Title"], [], ["code", None, "x & <y>"], ["101021007", None, 1.5]], "b": [[1.0]]}


def dbf(fields, rows):
    head = b"\x03" + bytes(3) + struct.pack("<IHH", len(rows), 33 + 32 * len(fields), 1 + 20 * len(fields)) + bytes(20)
    body = b"".join(f.encode().ljust(11, b"\0") + b"C" + bytes(4) + bytes([20]) + bytes(15) for f in fields) + b"\r"
    return head + body + b"".join(b" " + b"".join(v.encode().ljust(20) for v in r) for r in rows)


def shp(rings_list):
    out = bytes(100)
    for i, rings in enumerate(rings_list, 1):
        if rings is None:
            body = struct.pack("<i", 0)
        else:
            pts = [p for r in rings for p in r]
            starts = [sum(len(r) for r in rings[:k]) for k in range(len(rings))]
            body = struct.pack("<i4d", 5, 0, 0, 0, 0) + struct.pack("<ii", len(rings), len(pts)) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in pts)
        out += struct.pack(">ii", i, len(body) // 2) + body
    return out


def test_boundaries(spark):
    ring = [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (0.0, 0.0)]
    archive = zipped(**{"a.shp": shp([[ring], None]), "a.dbf": dbf(["SA2_CODE21", "SA2_NAME21", "MB_CODE21"], [["101", "One", "1"], ["102", "Two", "2"]])})
    df = files.boundaries(spark, archive, "SA2_CODE21", "SA2_NAME21").orderBy("code").collect()
    assert df[0]["name"] == "One" and [(p["x"], p["y"]) for p in df[0]["rings"][0]] == ring and df[1]["rings"] is None
    assert files.mesh_blocks(spark, archive).count() == 2


def test_retry(tmp_path):
    answers, waits = iter([(503, b""), (502, b""), (200, b"ok")]), []
    assert files.with_retry(lambda: next(answers), wait=waits.append) == b"ok" and waits == [1, 2]
    with pytest.raises(RuntimeError):
        files.with_retry(lambda: (500, b""), wait=waits.append)
    p = files.resume_file(tmp_path / "x" / "f", 2, lambda: b"ok")
    assert files.resume_file(p, 2, lambda: 1 / 0) == p


def test_links_and_catalogue(spark):
    pages = spark.createDataFrame([('<a href="/erp/2023-24.xlsx">x</a> <a href=\'/erp/2022-23.xlsx\'>y</a><a href="/z">',)], "html string")
    assert sorted(r["release"] for r in files.page_links(pages, "html", r"/erp/(\d{4}-\d\d)\.xlsx").collect()) == ["2022-23", "2023-24"]
    doc = '{"result":{"resources":[{"name":"Payments March 2024","url":"a","last_modified":"1"},{"name":"Payments Jun 2024","url":"b","last_modified":"1"},{"name":"Payments June 2024","url":"c","last_modified":"2"},{"name":"notes","url":"d"}]}}'
    r = files.latest_resource(spark.createDataFrame([(doc,)], "j string"), "j").first()
    assert (r["release"], r["url"]) == ("2024-Q2", "c")


def test_census(spark):
    archive = zipped(**{"x/2021Census_G01_AUS_SA2.csv": "SA2_CODE_2021,Tot_P_P\n117011326,10\n", "readme.txt": "x"})
    assert census.read_table(spark, archive, "G01").first().asDict() == {"sa2_code": "117011326", "Tot_P_P": 10.0}
    sheet = [["preamble"], ["Sequential", "Short", "Long", "DataPackfile"], ["G1", "Tot_P_P", "Total_Persons", "G01"], ["G2", "Tot_P_M", "Males", "G01"]]
    got = census.describe(spark, files.write_workbook({"Cells": sheet})).orderBy("pos").collect()
    assert [(r["table_id"], r["code"], r["description"]) for r in got] == [("G01", "Tot_P_P", "Total_Persons"), ("G01", "Tot_P_M", "Males")]


def test_corpus(spark, tmp_path):
    flat, loader = tmp_path / "202405", tmp_path / "202411"
    spark.createDataFrame([("P", "1 A STREET", 1.0, 2.0, "m", "2000")], "ADDRESS_DETAIL_PID string, ADDRESS_LABEL string, LATITUDE double, LONGITUDE double, MB_CODE string, POSTCODE string").write.parquet(str(flat))
    row = spark.createDataFrame([("P", "1 A STREET", "X", "NSW", "2000", 1.0, 2.0, "old", "new")], "gnaf_pid string, address string, locality_name string, state string, postcode string, latitude double, longitude double, mb_2016_code string, mb_2021_code string")
    row.write.parquet(str(loader / corpus.LOADER))
    assert corpus.releases(spark, str(tmp_path)) == ["202405", "202411"]
    assert corpus.read(spark, str(tmp_path)).first().asDict() == {"pid": "P", "label": "1 A STREET X NSW 2000", "lat": 1.0, "lon": 2.0, "mb_code": "new", "postcode": "2000"}
    assert corpus.read(spark, str(tmp_path), "202405").first()["label"] == "1 A STREET"
    with pytest.raises(NotImplementedError):
        corpus.read(spark, str(tmp_path), mode="official")
    with pytest.raises(ValueError):
        corpus.read(spark, str(tmp_path), "2024")


def test_corpus_from_store_and_cache(spark, tmp_path):
    """Cache first, unless refreshed; files of the flat layout by a pattern on their keys, however deep."""
    store, cache = tmp_path / "store", tmp_path / "cache"

    def put(at, label):
        spark.createDataFrame([("P", label, 1.0, 2.0, "m", "2000")], "ADDRESS_DETAIL_PID string, ADDRESS_LABEL string, LATITUDE double, LONGITUDE double, MB_CODE string, POSTCODE string").coalesce(1).write.mode("append").parquet(str(at))

    put(cache / "202405", "CACHED")
    put(store / "202405", "STORED")
    put(store / "202411", "NEW")
    put(store / "202411/custom/part", "DEEP")
    put(store / "202411/other", "OTHER")
    s, c = str(store), str(cache)
    assert corpus.releases(spark, s) == ["202405", "202411"] == corpus.releases(spark, s, c) and corpus.releases(spark, c, s, refresh=True) == ["202405"]
    assert corpus.resolve_release(spark, s, "latest", c) == "202405" and corpus.resolve_release(spark, s, "latest", c, refresh=True) == "202411" == corpus.resolve_release(spark, s, "latest")
    label = lambda *a, **k: sorted(r["label"] for r in corpus.read(spark, s, *a, **k).collect())
    assert label(cache=c) == ["CACHED"] and label(cache=c, refresh=True) == ["NEW"] and label("202405", cache=c, refresh=True) == ["STORED"] and label("202411", cache=c) == ["NEW"]
    assert label("202411", name_filter=r"^custom/.*\.parquet$") == ["DEEP"] and label("202411", name_filter="(custom|other)/") == ["DEEP", "OTHER"]
    keys = {r["key"].rsplit("/", 1)[0]: r["size"] for r in corpus.listing(spark, f"{s}/202411", "/").collect()}
    assert set(keys) == {"custom/part", "other"} and min(keys.values()) > 0
    with pytest.raises(FileNotFoundError, match="nothing"):
        corpus.read(spark, s, "202411", name_filter="nothing")


def test_sidecars_notice_other_files(spark, tmp_path):
    """What is kept is made again when a source changes, not when it stays, and outlives a source that is gone."""
    import os

    source, made = tmp_path / "in.txt", []
    source.write_text("one")

    def make():
        made.append(source.read_text())
        return spark.createDataFrame([(made[-1],)], "t string")

    read = lambda **k: sidecars.kept(spark, str(tmp_path / "kept"), make, sources=[str(source)], **k).first()["t"]
    assert read() == "one" == read() and made == ["one"]
    os.utime(source, ns=(1, 2))
    assert read() == "one" and made == ["one", "one"]
    source.write_text("two!")
    assert read() == "two!" == read() and len(made) == 3
    source.unlink()
    assert read() == "two!" and len(made) == 3
    source.write_text("three")
    assert read(refresh=True) == "three" and len(made) == 4
    # a table without a manifest, as older ones are, is made again
    (tmp_path / "kept" / sidecars.MANIFEST).unlink()
    assert read() == "three" and len(made) == 5


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_census_tables_are_scans(spark, tmp_path):
    """Tables of extracted files and of archives are read by executors, only the columns that are asked for."""
    text = "SA2_CODE_2021,Tot_P_P,Tot_P_M,Note\r\n117011326,10,4,np\r\n,,,\r\n117011327,,5,\"a, b\"\r\n"
    plain, packed = tmp_path / "2021Census_G01_AUS_SA2.csv", tmp_path / "pack.zip"
    plain.write_bytes(b"\xef\xbb\xbf" + text.encode())
    packed.write_bytes(zipped(**{"x/2021Census_G01_AUS_SA2.csv": text, "x/2021Census_G04A_AUS_SA2.csv": "SA2_CODE_2021,Age_0\n117011326,3\n", "x/2021Census_G05_AUS_SA2.csv": "SA2_CODE_2021,Nobody\n"}))
    census.extract(spark, str(packed), str(tmp_path / "out"))
    names = census.headers(spark, str(tmp_path / "out"))
    assert names == {"G01": ["SA2_CODE_2021", "Tot_P_P", "Tot_P_M", "Note"], "G04A": ["SA2_CODE_2021", "Age_0"], "G05": ["SA2_CODE_2021", "Nobody"]}
    for df in (census.table_file(spark, str(plain)), census.extracted_table(spark, str(tmp_path / "out"), "G01", names["G01"])):
        assert sorted(map(tuple, df.collect())) == [("117011326", 10.0, 4.0, None), ("117011327", None, 5.0, None)]
        plan = plan_of(df.select("sa2_code", "Tot_P_M"))
        assert "FileScan csv [SA2_CODE_2021" in plan and "ReadSchema: struct<SA2_CODE_2021:string,Tot_P_M:string>" in plan
    assert census.extracted_table(spark, str(tmp_path / "out"), "G05", names["G05"]).count() == 0
    assert "LocalTableScan" not in plan_of(census.table_file(spark, str(plain)))


def test_catalogue_bridges_two_sheets(spark, tmp_path):
    names = [["List of tables"], ["Table number", "Table name", "Population"], ["G01", "Selected Characteristics", "Persons"], ["G04", "Age by Sex", "Persons"]]
    cells = [["x"], ["Sequential", "Short", "Long", "DataPackfile", "Profiletable", "Columnheadingdescriptioninprofile"], ["G1", "Tot_P_P", "Total_Persons", "G01", "G01", "Total | Persons"], ["G2", "Age_0_M", "Age_0_Males", "G04A", "G04", "0 | Males"], ["G3", None, "x", "G04B", "G04", ""]]
    book = files.write_workbook({"Cell Descriptors Information": cells, "Table Number, Name, Population": names})
    (tmp_path / "Metadata_2021_GCP_DataPack_R1.xlsx").write_bytes(book)
    (tmp_path / "pack.zip").write_bytes(zipped(**{"m/Metadata_2021_GCP_DataPack_R1.xlsx": book, "m/other.xlsx": b"no"}))
    (tmp_path / "bare.zip").write_bytes(zipped(**{"readme.txt": "x"}))
    want = [("G01", 0, "Tot_P_P", "Total | Persons", "Selected Characteristics"), ("G04A", 1, "Age_0_M", "0 | Males", "Age by Sex")]
    for name in ("Metadata_2021_GCP_DataPack_R1.xlsx", "pack.zip"):
        assert sorted(map(tuple, census.catalogue(spark, str(tmp_path / name)).collect())) == want
    assert [r["code"] for r in census.catalogue(spark, str(tmp_path / "pack.zip"), "sequential").orderBy("pos").collect()] == ["G1", "G2", "G3"]
    assert census.catalogue(spark, str(tmp_path / "bare.zip")).count() == 0


def test_newest_release_of_pages(spark):
    """Each publisher's page: the links that its rule fits, one for each release, the newest of all."""
    pages = {
        "erp_by_sa2": '<a href="/regional-population/2023-24/32180DS0003_2001-24.xlsx">a</a><a href="/regional-population/2024-25/32180DS0001_x.xlsx">no</a><a href="https://x/regional-population/2022-23/32180DS0003_2001-23.xlsx">b</a>',
        "abs_personal_income": "<A HREF='/personal-income-australia/2020-21/Table%201%20-%20Total.xlsx'><a href=\"/personal-income-australia/2021-22/Table%201%20-%20Total.xlsx\"><a href='/personal-income-australia/2021-22/Table%202.xlsx'>",
        "abs_business_counts": '<a href="/counts-australian-businesses-including-entries-and-exits/jul2020-jun2024/81650DC09.xlsx"><a href="/counts-australian-businesses-including-entries-and-exits/jul2019-jun2023/81650DC09.xlsx">',
        "none": "<p>nothing</p>",
    }
    df = spark.createDataFrame([*pages.items(), ("null", None)], "page string, html string")
    found = files.page_releases(df, "html", key="page")
    got = {r["page"]: (r["dataset"], r["release"], r["link"]) for r in files.newest_release(found, "page").collect()}
    assert got == {
        "erp_by_sa2": ("erp_by_sa2", "2023", "/regional-population/2023-24/32180DS0003_2001-24.xlsx"), "abs_personal_income": ("abs_personal_income", "2021-22", "/personal-income-australia/2021-22/Table%201%20-%20Total.xlsx"),
        "abs_business_counts": ("abs_business_counts", "2024", "/counts-australian-businesses-including-entries-and-exits/jul2020-jun2024/81650DC09.xlsx"),
    }
    assert [r["link"] for r in files.newest_release(found, "page", "2020-21").collect()] == ["/personal-income-australia/2020-21/Table%201%20-%20Total.xlsx"]
    twice = [files.ReleaseRule("d", r"/(\d{4})/b\.csv", precedence=1), files.ReleaseRule("d", r"/(\d{4})/a\.csv")]
    page = spark.createDataFrame([('<a href="/2024/b.csv"><a href="/2024/a.csv"><a href="/2024/a.csv?2">',)], "html string")
    assert [r["link"] for r in files.page_releases(page, "html", twice).collect()] == ["/2024/a.csv"]


CODE = "117011326"


def test_seifa(spark):
    rows = [["Title"]] + [[]] * 3 + [["2021 Statistical Area Level 2 (SA2) 9-Digit Code", "Name"]]
    sheet = lambda v: rows + [[float(CODE), "Sydney", 100.0, v, None, 5.0, 1.0, "np", None, "NSW", 1.0, 2.0, 3.0, 4.0, 5.0, 6.0], ["Total", "x"]]
    r = datasets.seifa(spark, {f"Table {k}": sheet(900.0 + k) for k in range(2, 6)}).first()
    assert (r["sa2_code"], r["irsd_score"], r["ieo_score"], r["urp"], r["irsd_aus_percentile"], r["state_abbreviation"]) == (CODE, 902.0, 905.0, 100.0, None, "NSW")


def test_population(spark):
    geo = ["1", "New South Wales", "", "", "", "", "", "", CODE, "Sydney"]
    totals = datasets.erp_totals(spark, {"Table 1": [[]] * 4 + [[None] * 10 + [2022.0, 2023.0], ["code"], [*geo, 90.0, 100.0]]})
    ages = datasets.erp_age_sex(spark, {"Table 1": [[]] * 5 + [[*geo, 50.0, 50.0, 100.0, 1.0, 38.5, 12.5, 70.5, 17.0]]})
    area = spark.createDataFrame([(CODE, 4.0)], "code string, area double")
    r = datasets.erp(totals, ages, area).first()
    assert (r["population_total"], r["population_0_14"], r["population_15_64"], r["population_density_per_km2"], r["reference_year"], r["state_abbreviation"]) == (100.0, 12, 70, 25.0, 2023, "NSW")
    h = datasets.erp(totals, ages, None, 2022).first()
    assert (h["population_total"], h["median_age"], h["reference_year"]) == (90.0, None, 2022)


def test_payments_income_businesses(spark):
    grid = [["x"], ["SA2", "SA2 name", "Age Pension", "JobSeeker Payment"], [CODE, "Sydney", 10.0, "<20"], ["11026", "Old", 3.0, 4.0], ["99999", "?", 1.0, 1.0]]
    short = spark.createDataFrame([("11026", "101021007")], "short string, sa2_code string")
    got = {r["sa2_code"]: (r["age_pension_recipients"], r["jobseeker_payment_recipients"]) for r in datasets.dss(spark, {"SA2": grid}, "2023-Q1", short).collect()}
    assert got == {CODE: (10, None), "101021007": (3, 4)}
    pia = [["t"], [None, None, "Earners (persons)", None, "Median ($)", None], [None, None, "2020-21", "2021-22", "2020-21", "2021-22"], [CODE, "n", 1.0, 2.0, 3.0, "np"]]
    assert datasets.pia(spark, {"Table 1.4": pia}).first()["income_earners_count"] == 2.0
    assert datasets.pia(spark, {"Table 1.4": pia}, "2020-21").first()["median_total_income"] == 3.0
    cab = [["Businesses by SA2, June 2024"], ["Industry", "", "SA2", "", "Non employing", "1-4 Employees", "5-19", "20-199", "200+", "Total"], ["A", "a", CODE, "S", 1.0, 2.0, None, 0.0, 0.0, 3.0], ["B", "b", CODE, "S", 4.0, 1.0, None, 0.0, 0.0, 5.0], ["Total", "", "", "", 9.0]]
    r = datasets.businesses(spark, cab, "June 2024").first()
    assert (r["business_count_total"], r["business_count_5_19_employees"]) == (8, 0)
    with pytest.raises(datasets.LayoutError):
        datasets.businesses(spark, cab, "June 2023")


def test_approvals_labour_health_housing(spark):
    head = ["Code", "Name", *[h.capitalize() for h in datasets.BA_HEADERS]]
    cube = lambda code: {"Table_1": [["t"], [], head, ["", "", "no."], [code, "n", *[float(k) for k in range(9)]], ["1", "State", 99.0]]}
    ba = datasets.building_approvals(spark, [cube(CODE), cube("117011327")], "2024-25")
    assert ba.count() == 2 and ba.first()["value_total_building"] == 8.0
    with pytest.raises(ValueError, match="duplicate"):
        datasets.building_approvals(spark, [cube(CODE), cube(CODE)], "2024-25")
    salm = "﻿note\nData Item,SA2 name,SA2 Code (2021 ASGS),Sep-25,Dec-25\nSmoothed unemployment (persons),S,117011326,1,\"1,234\"\nSmoothed unemployment rate (%),S,117011326,1,-\n".encode()
    r = datasets.labour_force(spark, salm, "2025-Q4").first()
    assert (r["smoothed_unemployment_count"], r["smoothed_unemployment_rate"]) == (1234, None)
    with pytest.raises(datasets.LayoutError):
        datasets.labour_force(spark, salm, "2025-Q3")
    text = "FinancialYear,GeographicAreaType,GeographicAreaCode,Demographic,DemographicCategory,Measure,Value\n2024–25,SA4,SA4101,Total,Total,Patients,10\n2024–25,SA4,SA4101,Total,Total,Prescriptions,n.p.\n2024–25,PHN,X,Total,Total,Patients,1\n"
    archive = zipped(**{"Table prescriptions PHN and SA4.csv": text.encode("cp1252")})
    r = datasets.health(spark, archive, datasets.HEALTH["aihw_mh_prescriptions"], "2024-25").first()
    assert (r["sa4_code"], r["mh_patients_count"], r["mh_prescriptions_count"]) == ("101", 10, None)
    with pytest.raises(datasets.LayoutError, match="there are"):
        datasets.health(spark, archive, datasets.HEALTH["aihw_mh_prescriptions"], "2020-21")
    sh = {"DWELLINGS.4": [["Dwellings by SA4, June 2023"], [], ["State", "Region Code", "Region", "Public housing", "SOMIH", "Community housing", "Total"], ["NSW", "101", "r", 5.0, ". .", "1 234", 6.0]]}
    r = datasets.social_housing(spark, sh, "2023").first()
    assert (r["social_housing_public_count"], r["social_housing_somih_count"], r["social_housing_community_count"]) == (5, None, 1234)


def test_streams(spark, tmp_path):
    rows = [(i, datetime(2024, 1 + i % 3, 1, i), "k") for i in range(6)]
    spark.createDataFrame(rows, "i int, ts timestamp, k string").write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("i int, ts timestamp, k string").parquet(str(tmp_path / "in"))
    for name, df, mode in (("rel", release_stream(stream(), "ts", [release("2023-Q4", "quarter_ending"), release("2024-Q1", "quarter_ending")]), "append"), ("win", windowed_counts(stream(), "ts", ["k"], "30 days"), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(120)
    assert {r["release"] for r in spark.table("rel").collect()} == {"2024-Q1"}
    assert spark.table("win").agg(F.sum("n")).first()[0] == 6
