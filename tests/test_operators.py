import random

import pytest
from pyspark.sql import functions as F

from areaweave.functions.temporal import release
from areaweave.operators import asof, downscale, enrich, geocode, overlay, pivot, spatial, summary

RINGS = "code string, name string, rings array<array<struct<x:double,y:double>>>"


def box(x0, y0, x1, y1):
    return [{"x": float(x), "y": float(y)} for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]


@pytest.fixture(scope="module")
def areas(spark):
    rows = [("117011326", "Sydney CBD", [box(151.20, -33.87, 151.22, -33.85)]), ("117011327", "North Sydney", [box(151.19, -33.84, 151.21, -33.82)]), ("117011328", "Eastern Suburbs", [box(151.23, -33.89, 151.26, -33.86)]), ("none", "none", None)]
    return spark.createDataFrame(rows, RINGS)


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [
        ("GANSW000000001", "1 GEORGE STREET SYDNEY NSW 2000", -33.864, 151.211, "11701132601", "2000"),
        ("GANSW000000002", "100 PITT STREET SYDNEY NSW 2000", -33.866, 151.211, "11701132602", "2000"),
        ("GANSW000000003", "200 KENT STREET SYDNEY NSW 2000", -33.868, 151.205, "11701132603", "2000"),
        ("GANSW000000004", "10 BLUES POINT ROAD MCMAHONS POINT NSW 2060", -33.835, 151.200, "11701132701", "2060"),
        ("GANSW000000005", "5 BONDI ROAD BONDI NSW 2026", -33.880, 151.245, "11701132801", "2026"),
    ]
    return spark.createDataFrame(rows, "pid string, label string, lat double, lon double, mb_code string, postcode string")


def test_points_in_areas_random(spark):
    rng = random.Random(1)
    hole = [box(0, 0, 10, 10), box(3, 3, 6, 6)]
    shapes = {"a": hole, "b": [[{"x": 10.0, "y": 0.0}, {"x": 20.0, "y": 0.0}, {"x": 10.0, "y": 10.0}]], "c": [box(-9, -9, -5, -5), box(-3, -3, -1, -1)]}
    boundaries = spark.createDataFrame([(k, k, v) for k, v in shapes.items()], RINGS)
    pts = [(i, rng.choice([rng.uniform(-10, 20), float(rng.randint(-10, 20))]), rng.choice([rng.uniform(-10, 12), float(rng.randint(-10, 12))])) for i in range(400)]

    def inside(rings, x, y):
        odd = False
        for r in rings:
            for p, q in zip(r, r[1:] + r[:1]):
                x1, y1, x2, y2 = p["x"], p["y"], q["x"], q["y"]
                if (x2 - x1) * (y - y1) == (y2 - y1) * (x - x1) and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                    return False
                if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                    odd = not odd
        return odd

    want = {i: next((k for k in sorted(shapes) if inside(shapes[k], x, y)), None) for i, x, y in pts}
    got = spatial.points_in_areas(spark.createDataFrame(pts, "id int, x double, y double"), boundaries, "id", "x", "y", 2.5)
    assert {r["id"]: r["area_code"] for r in got.collect()} == {k: v for k, v in want.items() if v}


def test_area_and_overlaps(spark):
    one = spark.createDataFrame([("x", "x", [box(145, -32, 146, -31)])], RINGS)
    assert 8000 < spatial.areas(one).first()["area"] < 13000
    sa2 = spark.createDataFrame([("SA", "", [box(0, 0, 70, 100)]), ("SB", "", [box(70, 0, 100, 100)])], RINGS)
    lga = spark.createDataFrame([("L", "", [box(0, 0, 100, 100)]), ("S", "", [box(100, 0, 100.001, 100)])], RINGS)
    w = downscale.correspondence(sa2, lga, 40.0)
    assert sorted((r["sa2_code"], r["lga_code"], round(r["sa2_share_of_lga"], 9)) for r in w.collect()) == [("SA", "L", 0.7), ("SB", "L", 0.3)]
    values = spark.createDataFrame([("L", 500.0), ("unknown", 9.0)], "lga_code string, n double")
    assert {r[0]: round(r[1], 6) for r in downscale.counts(w, values, ["n"]).collect()} == {"SA": 350.0, "SB": 150.0}
    assert downscale.counts(w, values.where("lga_code = 'unknown'"), ["n"]).count() == 0
    assert downscale.sa2s_of(w, "L").count() == 2 and downscale.lgas_of(w, "SA").count() == 1


def test_triangle_overlap():
    import numpy as np

    tri = np.array([[0, 0, 4, 0], [4, 0, 0, 4], [0, 4, 0, 0]], float)
    sq = np.array([[1, 1, 3, 1], [3, 1, 3, 3], [3, 3, 1, 3], [1, 3, 1, 1]], float)
    assert overlay.overlap_area(tri, sq) == pytest.approx(2.0)


def star(rng, cx, cy, size, n, rough=0.7):
    """A polygon with n corners around a centre, as edges; corners are up to ``rough`` of its size nearer than the rest."""
    import numpy as np

    turn = np.sort(np.array([rng.random() for _ in range(n)])) * 2 * np.pi
    far = size * np.array([1 - rough * rng.random() for _ in range(n)])
    p = np.stack([cx + far * np.cos(turn), cy + far * np.sin(turn)], axis=1)
    return np.concatenate([p, np.roll(p, -1, axis=0)], axis=1)


def overlap_by_hand(a, b):
    """Slabs between all vertices and all crossings, one after another."""
    import numpy as np

    ys = {*a[:, 1], *a[:, 3], *b[:, 1], *b[:, 3]}
    for x1, y1, x2, y2 in a:
        for u1, v1, u2, v2 in b:
            det = (x2 - x1) * (v2 - v1) - (y2 - y1) * (u2 - u1)
            if det:
                t = ((u1 - x1) * (v2 - v1) - (v1 - y1) * (u2 - u1)) / det
                if 0 <= t <= 1:
                    ys.add(y1 + t * (y2 - y1))
    ys, total = sorted(ys), 0.0
    for lo, hi in zip(ys, ys[1:]):
        y = (lo + hi) / 2
        spans = [np.sort([x1 + (y - y1) * (x2 - x1) / (y2 - y1) for x1, y1, x2, y2 in e if (y1 > y) != (y2 > y)]).reshape(-1, 2) for e in (a, b)]
        total += sum(max(0.0, min(p[1], q[1]) - max(p[0], q[0])) for p in spans[0] for q in spans[1]) * (hi - lo)
    return total


@pytest.mark.parametrize("addresses,labels", [(2000, 20_000), (3, 4), (1, 1)])
def test_fuzzy_shards_against_every_label(spark, monkeypatch, addresses, labels):
    """However addresses and labels of a locality are dealt, each gets its best label; of equal ones the least id."""
    from areaweave.functions.address import parse_address
    from areaweave.functions.fuzzy import token_set_ratio

    monkeypatch.setattr(geocode, "ADDRESSES", addresses)
    monkeypatch.setattr(geocode, "LABELS", labels)
    rng = random.Random(9)
    names = ["GEORGE", "GEORGINA", "KING", "KINGSTON", "PITT", "ELIZA", "HIGH"]
    corpus = [(f"P{k:03}" if k else None, f"{rng.randint(1, 9)} {rng.choice(names)} {rng.choice(['STREET', 'ROAD'])} SYDNEY NSW {2000 + k % 2}", float(k), 1.0, f"M{k}", str(2000 + k % 2)) for k in range(60)]
    corpus += [("P900", corpus[7][1], 9.0, 9.0, "M", "2001")]
    asked = [f"{rng.randint(1, 9)} {rng.choice(names)[:-1]} {rng.choice(['STREET', 'ROAD'])} SYDNEY NSW {2000 + k % 2}" for k in range(20)] + ["5 HIGH STREET SYDNEY NSW"]
    c = spark.createDataFrame(corpus, "pid string, label string, lat double, lon double, mb_code string, postcode string")
    rows = parse_address(spark.createDataFrame([(a,) for a in asked], "norm string"), "norm")
    got = {r["norm"]: (r["pid"], round(r["match_score"], 9)) for r in geocode.fuzzy(rows, c, ["norm"], 0.8).collect()}
    want = {}
    for a in asked:
        of = [(-token_set_ratio(a, x[1]), x[0] is None, x[0] or "", x[0]) for x in corpus if not a[-1].isdigit() or x[5] == a[-4:]]
        if -min(of)[0] >= 0.8:
            want[a] = (min(of)[3], round(-min(of)[0], 9))
    assert got == want and len(want) > 10


def test_taken_apart_labels_are_not_broadcast(spark):
    """Labels by token outgrow what Spark takes them for, so no tier sends them through the driver."""
    from areaweave.functions.address import parse_address

    k = F.col("id")
    label = F.concat_ws(" ", k.cast("string"), F.lit("GEORGE STREET SYDNEY NSW 2000"))
    c = spark.range(20_000).select(k.cast("string").alias("pid"), label.alias("label"), F.lit(1.0).alias("lat"), F.lit(1.0).alias("lon"), F.lit("M").alias("mb_code"), F.lit("2000").alias("postcode"))
    rows = parse_address(spark.range(50_000).select(F.concat(k.cast("string"), F.lit(" GEORGE STREET SYDNEY NSW 2000")).alias("norm")), "norm")
    for tier, name in ((geocode.component, "__of#"), (geocode.fuzzy, "least#")):
        lines = tier(rows, c, ["norm"])._jdf.queryExecution().executedPlan().toString().split("\n")
        assert not [a for a, b in zip(lines, lines[1:]) if "BroadcastExchange" in a and name in b], tier


def test_copies_of_labels_are_one(spark):
    """Rows of an equal label are counted, and compared once: that of the least id; the component tier still sees several."""
    from areaweave.functions.address import parse_address

    rows = [(f"P{k:03}" if k else None, f"{k % 3 + 1} GEORGE STREET SYDNEY NSW 2000", float(k), 1.0, f"M{k}", "2000") for k in range(90)] + [("P100", "7 KING STREET SYDNEY NSW 2000", 100.0, 1.0, "M100", "2000")]
    c = spark.createDataFrame(rows, "pid string, label string, lat double, lon double, mb_code string, postcode string")
    got = {r["label"][0]: (r["held"], r["least"]["pid"], r["least"]["lat"]) for r in geocode._labels(c, ["norm"]).collect()}
    assert got == {"1": (30, "P003", 3.0), "2": (30, "P001", 1.0), "3": (30, "P002", 2.0), "7": (1, "P100", 100.0)}
    asked = parse_address(spark.createDataFrame([("1 GEORGE STREET SYDNEY NSW 2000",), ("7 KING STREET LEVEL 5 SYDNEY NSW 2000",), ("7 KINGX STREET SYDNEY NSW 2000",)], "norm string"), "norm")
    assert {r["norm"]: r["pid"] for r in geocode.fuzzy(asked, c, ["norm"]).collect()} == {"1 GEORGE STREET SYDNEY NSW 2000": "P003", "7 KING STREET LEVEL 5 SYDNEY NSW 2000": "P100", "7 KINGX STREET SYDNEY NSW 2000": "P100"}
    assert [r["pid"] for r in geocode.component(asked, c, ["norm"]).collect()] == ["P100"]
    assert [(r["pid"], r["lat"]) for r in geocode.exact(asked, c, ["norm"]).collect()] == [("P003", 3.0)]


@pytest.mark.parametrize("text", ["12 GEORGE", "2 GEORG", "2 PI", "2 PIT", "2 P", "2 X", "2 GEORGE STREET", "12 GEORGE STREET", "92 GEORGE"])
def test_component_by_whole_and_started_tokens(spark, text):
    c = spark.createDataFrame([("P1", "112 GEORGE STREET SYDNEY NSW 2000", 1.0, 1.0, "M", "2000"), ("P2", "2 PITT STREET SYDNEY NSW 2000", 1.0, 1.0, "M", "2000"), ("P3", "2 GEORGE STREET PERTH WA 6000", 1.0, 1.0, "M", "6000"), ("P4", "92 GEORGE STREET SYDNEY NSW 2000", 1.0, 1.0, "M", "2000")], "pid string, label string, lat double, lon double, mb_code string, postcode string")
    parts = text.split(" ")
    kind = "street_number string, street_name string, street_type string, locality string, state string, postcode string"
    row = spark.createDataFrame([(text, (parts[0], parts[1], parts[2] if len(parts) > 2 else None, None, None, "2000"))], f"norm string, parsed struct<{kind.replace(' string', ':string').replace(', ', ',')}>")
    fits = [p for p, label in (("P1", "112 GEORGE STREET SYDNEY NSW 2000"), ("P2", "2 PITT STREET SYDNEY NSW 2000"), ("P4", "92 GEORGE STREET SYDNEY NSW 2000")) if text in label]
    got = [r["pid"] for r in geocode.component(row, c, ["norm"]).collect()]
    assert got == (fits if len(fits) == 1 else [])


def test_overlay_against_slabs_by_hand():
    rng = random.Random(5)
    for n in (3, 8, 40, 150):
        a, b = star(rng, 0, 0, 10, n), star(rng, rng.uniform(-8, 8), rng.uniform(-8, 8), 8, n + 3)
        assert overlay.overlap_area(a, b) == pytest.approx(overlap_by_hand(a, b), rel=1e-9, abs=1e-9)


def test_overlay_of_long_outlines():
    """Two outlines of 10,000 corners within two seconds; the area is that of their pieces."""
    import time
    import tracemalloc

    import numpy as np

    rng = random.Random(6)
    a, b = star(rng, 0, 0, 10, 10_000, 0.05), star(rng, 1, 2, 10, 10_000, 0.05)
    began = time.process_time()
    area = overlay.overlap_area(a, b)
    assert time.process_time() - began < 2
    tracemalloc.start()
    total = 0.0
    for low in np.arange(-12.0, 12.0, 3.0):
        strip = [np.array([[-20, low, -20, low + 3], [20, low, 20, low + 3]], float), a]
        inside = overlay.overlap_area(*strip)
        assert inside >= 0
        total += inside
    assert tracemalloc.get_traced_memory()[1] < 1 << 29
    tracemalloc.stop()
    x1, y1, x2, y2 = a.T
    assert total == pytest.approx(abs((x1 * y2 - x2 * y1).sum()) / 2) and area < total


def test_overlays_of_many_pairs_at_once():
    """Pairs of a batch, some apart, some without edges, some long: each as by hand, and 20,000 small ones within two seconds."""
    import time

    np = overlay.np
    rng = random.Random(8)
    none = np.zeros((0, 4))
    pairs = [(star(rng, 0, 0, 10, rng.randint(3, 12)), star(rng, rng.uniform(-20, 20), rng.uniform(-8, 8), 8, rng.randint(3, 12))) for _ in range(60)]
    pairs[5:5] = [(none, star(rng, 0, 0, 5, 4)), (star(rng, 0, 0, 5, 4), none), (none, none), (star(rng, 0, 0, 10, 90), star(rng, 1, 1, 10, 30))]
    sides = lambda pairs: [f([p[k] for p in pairs]) for k in (0, 1) for f in (np.concatenate, lambda es: np.array([len(e) for e in es]))]
    want = [overlap_by_hand(a, b) if len(a) and len(b) else 0.0 for a, b in pairs]
    assert overlay.overlap_areas(*sides(pairs)) == pytest.approx(want, rel=1e-9, abs=1e-9)
    many = [pairs[k % 5] for k in range(20_000)]
    began = time.process_time()
    got = overlay.overlap_areas(*sides(many))
    assert time.process_time() - began < 2 and got == pytest.approx([want[k % 5] for k in range(20_000)], rel=1e-9, abs=1e-9)
    assert len(overlay.overlap_areas(none, np.zeros(0, int), none, np.zeros(0, int))) == 0


@pytest.mark.parametrize("cell", [0.7, 3.0, 50.0])
def test_overlaps_by_cells(spark, cell):
    """Outlines with holes, on and off the lines of the grid: pieces by cell add up to the overlay of the whole."""
    rng = random.Random(8)
    shapes = {}
    for side in "ab":
        for k in range(6):
            outer = star(rng, rng.uniform(0, 12), rng.uniform(0, 12), rng.uniform(1, 6), rng.randint(3, 30))
            shapes[f"{side}{k}"] = [outer] if k % 2 else [outer, star(rng, outer[:, 0].mean(), outer[:, 1].mean(), 0.5, 5)]
    corners = lambda e: [(float(x), float(y)) for x, y in e[:, :2]]
    shapes["a6"] = [overlay.np.array([[0, 0, 6, 0], [6, 0, 6, 6], [6, 6, 0, 6], [0, 6, 0, 0]], float)]
    shapes["b6"] = [overlay.np.array([[3, 3, 9, 3], [9, 3, 9, 9], [9, 9, 3, 9], [3, 9, 3, 3]], float)]
    table = {s: spark.createDataFrame([(k, k, [corners(r) for r in v]) for k, v in shapes.items() if k[0] == s], RINGS) for s in "ab"}
    got = {(r["a_code"], r["b_code"]): r["area"] for r in overlay.overlaps(table["a"], table["b"], cell, 1e-6).collect()}
    want = {}
    for p, a in shapes.items():
        for q, b in shapes.items():
            if p[0] == "a" and q[0] == "b" and (area := overlay.overlap_area(*(overlay.np.concatenate(x) for x in (a, b)))) >= 1e-6:
                want[p, q] = area
    assert got.keys() == want.keys() and got["a6", "b6"] == pytest.approx(9.0)
    assert all(got[k] == pytest.approx(v, rel=1e-8) for k, v in want.items())
    if cell == 0.7:
        # cells that a piece fills carry no edges
        full = overlay.pieces(table["a"].where("code = 'a6'"), cell).where("full")
        assert full.count() > 30 and full.where("size(edges) > 0").count() == 0


def test_rates(spark):
    w = spark.createDataFrame([("S", "A", 0.6), ("S", "B", 0.4)], "sa2_code string, lga_code string, lga_share_of_sa2 double")
    v = lambda rows: spark.createDataFrame(rows, "lga_code string, r double")
    rate = lambda rows: downscale.rates(w, v(rows), ["r"]).first()["r"]
    assert rate([("A", 80.0), ("B", 50.0)]) == pytest.approx(68) and rate([("A", 80.0)]) == pytest.approx(80)
    assert rate([("A", 80.0), ("B", None)]) is None


@pytest.mark.parametrize(
    ("address", "threshold", "source"),
    [
        ("1 George Street Sydney NSW 2000", 0.85, "gnaf_exact"), ("100 PITT STREET LEVEL 5 SYDNEY NSW 2000", 0.85, "gnaf_component"), ("1 GEROGE STREET SYDNEY NSW 2000", 0.7, "gnaf_fuzzy"),
        ("1 GEROGE STREET SYDNEY NSW", 0.7, "gnaf_fuzzy"), ("999 ZZZZZZZZ ZZZZZ ZZZZZZ NSW 2000", 0.95, "failed"), ("1 GEROGE STREET", 0.85, "failed"), (None, 0.85, "failed"),
    ],
)
def test_cascade(spark, corpus, address, threshold, source):
    rows = spark.createDataFrame([(address,)], "a string")
    r = geocode.resolve(rows, "a", None, None, [geocode.CorpusProvider(corpus, threshold)]).first()
    assert r["geo_source"] == source
    if source == "gnaf_fuzzy":
        assert r["mb_code"] == "11701132601" and 0.7 <= r["geo_match_score"] <= 1


def test_locator_precedence_and_cache(spark, corpus):
    from areaweave.functions.address import cache_key, normalize_address

    rows = spark.createDataFrame([(1, "nowhere", -33.0, 151.0), (2, "5 Bondi Rd, Bondi NSW 2026", None, 151.0), (3, "cached place", None, None), (4, "fresh place", None, None), (5, " ", None, None)], "i int, a string, la double, lo double")
    cache = spark.createDataFrame([("cached place",)], "a string").select(cache_key(normalize_address(F.col("a"))).alias("hash"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"))
    fetch = lambda it: ((3.0, 4.0) if "FRESH" in a else None for a in it)
    got = geocode.resolve(rows, "a", "la", "lo", [geocode.CorpusProvider(corpus), geocode.CachedProvider(cache, fetch)]).orderBy("i").collect()
    assert [r["geo_source"] for r in got] == ["input", "gnaf_exact", "nominatim_cache", "nominatim_fresh", "failed"]
    assert [r["geo_lat"] for r in got] == [-33.0, -33.88, 1.0, 3.0, None]


def test_outside_geocoder_is_asked_once(spark, tmp_path):
    """Fresh hits are kept before they are used: however often the result is run, and in a second run, nothing is asked again."""
    log, path = tmp_path / "asked", str(tmp_path / "cache")

    def ask(address):
        with open(log, "a") as f:
            f.write(address + "\n")
        return (200, {}, [{"lat": "3.5", "lon": "4.5"}]) if "PLACE" in address else (200, {}, [])

    rows = spark.createDataFrame([(1, "first place"), (2, "second place"), (3, "First  Place."), (4, "nowhere")], "i int, a string")
    provider = lambda: geocode.CachedProvider(fetch=geocode.Paced(ask, 1000.0), path=path, askers=3)
    asked = lambda: sorted(log.read_text().split("\n")[:-1])
    got = geocode.resolve(rows, "a", None, None, [provider()])
    for _ in range(2):
        assert [(r["geo_source"], r["geo_lat"]) for r in got.orderBy("i").collect()] == [("nominatim_fresh", 3.5)] * 3 + [("failed", None)]
    assert asked() == ["FIRST PLACE", "NOWHERE", "SECOND PLACE"]
    again = geocode.resolve(rows.where("i < 4"), "a", None, None, [provider()])
    assert {r["geo_source"] for r in again.collect()} == {"nominatim_cache"} and len(asked()) == 3
    # a hash that was written twice counts once
    geocode.write_cache(spark.createDataFrame([("FIRST PLACE", 9.0, 9.0, "nominatim_fresh")], "norm string, lat double, lon double, geo_source string"), path)
    assert geocode.read_cache(spark, path).count() == 2 and geocode.resolve(rows.where("i = 1"), "a", None, None, [geocode.CachedProvider(path=path)]).first()["geo_lat"] == 3.5
    assert geocode.read_cache(spark, str(tmp_path / "none")).count() == 0


def test_the_pace_holds_over_all_askers(spark, tmp_path):
    """Four askers at once stay within the pace that was asked for, and there are never more than four."""
    import time

    log = tmp_path / "times"

    def ask(address):
        with open(log, "a") as f:
            f.write(f"{time.time()}\n")
        return 200, {}, [{"lat": "1", "lon": "2"}]

    rows = spark.createDataFrame([(f"PLACE {k}",) for k in range(24)], "norm string").repartition(12)
    found = geocode.CachedProvider(fetch=geocode.Paced(ask, 20.0), askers=4).resolve(rows)
    assert found.rdd.getNumPartitions() == 4 and found.count() == 24
    times = sorted(map(float, log.read_text().split()))
    for k in range(len(times)):  # in any second, 20 and what each asker may begin with
        assert sum(times[k] <= t < times[k] + 1 for t in times) <= 20 + 4
    assert geocode.Paced(ask, 2.0).shared(4).gap == 2.0


def test_asof_table_equals_expression(spark):
    import areaweave.operators.asof as m

    years = [release(str(y), "financial_year_ending") for y in range(2015, 2025)]
    rng = random.Random(2)
    rows = spark.createDataFrame([(i, f"{rng.randint(2010, 2026)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}") for i in range(200)] + [(999, None)], "i int, d string").withColumn("d", F.col("d").cast("date"))
    for rule in ("closest_at_or_before", "closest"):
        small = {r["i"]: r["release"] for r in asof.asof_release(rows, "d", years, rule).collect()}
        old, m.LITERAL_RELEASES = m.LITERAL_RELEASES, 0
        try:
            large = {r["i"]: r["release"] for r in asof.asof_release(rows, "d", years, rule).collect()}
        finally:
            m.LITERAL_RELEASES = old
        assert small == large
    with pytest.raises(ValueError, match="first release"):
        asof.check_range(asof.asof_release(rows, "d", years), "d", "release", "x")


def test_enrich(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "z"), (3, None)], "i int, k string")
    lookup = spark.createDataFrame([("a", 5), (None, 9)], "k string, v int")
    got = enrich.left_enrich(rows, lookup, "k", "k", {"x": "v", "y": "v"}).orderBy("i").collect()
    assert [(r["x"], r["y"]) for r in got] == [(5, 5), (None, None), (None, None)]
    with pytest.raises(KeyError):
        enrich.left_enrich(rows, lookup, "k", "k", {"x": "nope"})
    both = enrich.outer_concat([lookup.where("k is not null"), spark.createDataFrame([("b", 1.0)], "k string, w double")], "k")
    assert {r["k"]: (r["v"], r["w"]) for r in both.collect()} == {"a": (5, None), "b": (None, 1.0)}
    with pytest.raises(ValueError, match="duplicate"):
        enrich.require_unique(rows.unionByName(rows), ["i"])


def test_pivot_and_sums(spark):
    long = spark.createDataFrame([("a", "m", None, 1), ("a", "m", 2.0, 2), ("a", "m", 3.0, 3), ("b", "other", 1.0, 4)], "k string, m string, v double, n int")
    assert {r["k"]: r["x"] for r in pivot.first_values(long, "k", "m", "v", {"m": "x"}, "n").collect()} == {"a": 2.0, "b": None}
    assert [r[0] for r in pivot.unknown_measures(long, "m", {"m": "x"}).collect()] == ["other"]
    assert pivot.group_sums(spark.createDataFrame([("a", None)], "k string, v long"), "k", ["v"]).first()["v"] == 0


def test_summary(spark):
    df = spark.createDataFrame([("input", 1.0, 1.0, "mb_code", "x", 1), ("failed", None, None, None, None, None), ("input", 1.0, 1.0, "unmatched", None, None)], "geo_source string, geo_lat double, geo_lon double, sa2_resolution string, sa2_code string, v int")
    s = summary.summarise(df, ["v"])
    assert (s.rows, s.failed, s.with_area, s.without_area, s.fully_enriched) == (3, 1, 1, 1, 1)
    assert "Rows: 3" in s.human_readable()
