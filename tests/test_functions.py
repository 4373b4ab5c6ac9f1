import math
from datetime import date

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from areaweave.functions.address import PARTS, cache_key_text, normalize_address, parse_address
from areaweave.functions.coerce import number
from areaweave.functions.features import Expression, Feature, compiled, out_of_bounds
from areaweave.functions.fuzzy import token_set_ratio
from areaweave.functions.geometry import albers
from areaweave.functions.temporal import complete_financial_year, month_quarter, pick_release, release
from areaweave.functions.text import area_code, is_code, plain_spaces, recipients_column, state_abbreviation, table_id

ADDRESSES = {
    "1 George Street, Sydney": "1 GEORGE STREET SYDNEY",
    "1 king st sydney New South Wales 2000": "1 KING STREET SYDNEY NSW 2000",
    "1 King WIBBLE": "1 KING WIBBLE",
    "1 Victoria Street": "1 VIC STREET",
    "St Kilda": "STREET KILDA",
    "1 Smith  Rd;Perth": "1 SMITH ROAD PERTH",
    "": "",
    None: "",
}


def column(spark, values, build, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(build(F.col("v"))).collect()]


def test_normalize_address(spark):
    assert column(spark, list(ADDRESSES), normalize_address) == list(ADDRESSES.values())
    once = column(spark, list(ADDRESSES), normalize_address)
    assert column(spark, once, normalize_address)[0] == once[0]


def test_parse_address(spark):
    cases = {
        "5/100 King George Avenue Bondi Beach NSW 2026": ("5", "100", "KING GEORGE", "AVENUE", "BONDI BEACH", "NSW", "2026"),
        "100-102 King St Melbourne VIC 3000": (None, "100-102", "KING", "STREET", "MELBOURNE", "VIC", "3000"),
        "1 Park Lane Macquarie Park NSW 2113": (None, "1", "PARK", "LANE", "MACQUARIE PARK", "NSW", "2113"),
        "Sydney NSW 2000": (None, None, None, None, "SYDNEY", "NSW", "2000"),
        "Bondi Junction NSW 2022": (None, None, None, None, "BONDI JUNCTION", "NSW", "2022"),
        "": None,
        "   ": None,
    }
    df = spark.createDataFrame([(i, a) for i, a in enumerate(cases)], "i int, a string").withColumn("n", normalize_address(F.col("a")))
    got = [r["parsed"] for r in parse_address(df, "n").orderBy("i").collect()]
    assert [None if g is None else tuple(g[p] for p in PARTS) for g in got] == list(cases.values())


def test_cache_key_text(spark):
    assert column(spark, [" 1  King ST.,", None], cache_key_text) == ["1 king st", ""]


def test_token_set_ratio():
    assert token_set_ratio("a b c", "c b a") == 1
    assert token_set_ratio("1 GEORGE STREET", "1 GEORGE STREET SYDNEY") == 1
    assert token_set_ratio("", "a") == 0 and token_set_ratio(None, "a") == 0
    assert 0.7 <= token_set_ratio("1 GEROGE STREET SYDNEY NSW 2000", "1 GEORGE STREET SYDNEY NSW 2000") < 1
    assert token_set_ratio("abc", "xyz") == 0


@pytest.mark.parametrize(
    ("source", "cell", "value"),
    [("seifa", "NP", None), ("seifa", " .. ", None), ("erp", "1,234", 1234.0), ("dss", "<20", None), ("pia", "<5", None), ("pia", "-3.5", -3.5), ("cab", "word", None), ("social_housing", "1 234", 1234.0), ("social_housing", ". .", None), ("salm", "", None), ("aihw", "n.p.", None)],
)
def test_number(spark, source, cell, value):
    assert column(spark, [cell], lambda c: number(c, source)) == [value]


def test_text(spark):
    assert column(spark, ["JobSeeker Payment (total)"], recipients_column) == ["jobseeker_payment_total_recipients"]
    assert column(spark, ["new south wales", "Other Territories"], state_abbreviation) == ["NSW", "OTH"]
    assert column(spark, ["101021007.0", "101021007"], area_code) == ["101021007"] * 2
    assert column(spark, ["101021007", "1GSYD", None], lambda c: is_code(c, 9)) == [True, False, False]
    assert column(spark, ["2023–24 "], plain_spaces) == ["2023-24"]
    assert column(spark, ["2021Census_G04A_AUS.csv", "none"], table_id) == ["G04A", None]
    assert column(spark, ["Dec-25", "March 2024", "Apr-25"], month_quarter) == ["2025-Q4", "2024-Q1", None]


def test_release_windows():
    assert (release("2022-23", "financial_year_ending").start, release("2022-23", "financial_year_ending").end) == (date(2022, 7, 1), date(2023, 6, 30))
    assert release("2022", "financial_year_ending").start == date(2021, 7, 1)
    assert (release("2024-Q3", "quarter_ending").start, release("2024-Q4", "quarter_ending").end) == (date(2024, 7, 1), date(2024, 12, 31))
    assert release("2021", "census_reference_date").midpoint == date(2021, 8, 1)
    assert release("1999-00", "financial_year_ending").end == date(2000, 6, 30)
    for bad in (("20x", "calendar_year_ending"), ("2024-Q5", "quarter_ending"), ("2024", "other")):
        with pytest.raises(ValueError):
            release(*bad)
    assert complete_financial_year(date(2024, 7, 1)) == "2023-24" and complete_financial_year(date(2024, 6, 30)) == "2022-23"


def test_pick_release(spark):
    years = [release(str(y), "financial_year_ending") for y in range(2018, 2025)]
    days = ["2022-09-01", "2022-07-01", "2010-01-01", None]
    pick = lambda **k: column(spark, days, lambda c: pick_release(c.cast("date"), years, **k))
    assert pick() == ["2023", "2023", None, None]
    assert pick(out_of_range="nearest") == ["2023", "2023", "2018", None]
    quarters = [release(f"2024-Q{q}", "quarter_ending") for q in range(1, 5)]
    near = lambda d, rs: column(spark, [d], lambda c: pick_release(c.cast("date"), rs, "closest"))[0]
    assert near("2024-04-01", quarters) == "2024-Q2" and near("2024-03-15", quarters[:2]) == "2024-Q1"
    assert near("2001-01-01", quarters) == "2024-Q1"


CASES = [
    (dict(output_kind="percentage"), (50, 100), 50.0), (dict(output_kind="percentage"), (30, 0), None),
    (dict(output_kind="percentage", zero_denominator="zero"), (30, 0), 0.0), (dict(output_kind="percentage", zero_denominator="zero"), (30, None), 0.0),
    (dict(), (1.5, 1), 1.5), (dict(output_kind="percentage", bounds=(0, 100), out_of_bounds="clip"), (120, 100), 100.0),
    (dict(output_kind="percentage", bounds=(0, 100)), (120, 100), 120.0), (dict(output_kind="rate", scale=1000), (5, 1000), 5.0),
    (dict(output_kind="percentage", scale=2), (50, 100), 100.0), (dict(output_kind="rate", scale=1000, bounds=(0, 10), out_of_bounds="clip"), (5, 1000), 5.0),
    (dict(), (None, 10), None), (dict(output_kind="percentage", bounds=(0, 100), out_of_bounds="clip"), (None, 10), None),
]


@pytest.mark.parametrize(("rules", "row", "want"), CASES)
def test_features(spark, rules, row, want):
    f = Feature(id="f", numerator=Expression(fields=["n"]), denominator=Expression(fields=["d"]), **rules)
    df = spark.createDataFrame([tuple(None if v is None else float(v) for v in row)], "n double, d double")
    assert df.select(compiled(f, F.col)).first()[0] == want


def test_feature_errors_and_sums(spark):
    df = spark.createDataFrame([(50.0, 0.0), (None, 3.0)], "n double, d double")
    f = Feature(id="f", numerator=Expression(fields=["n"]), denominator=Expression(fields=["d"]), zero_denominator="error")
    with pytest.raises(PySparkException):
        df.select(compiled(f, F.col)).collect()
    bounded = Feature(id="f", numerator=Expression(fields=["n"]), denominator=Expression(fields=["d"]), bounds=(0, 1), out_of_bounds="error")
    with pytest.raises(PySparkException):
        spark.createDataFrame([(50.0, 2.0)], "n double, d double").select(compiled(bounded, F.col)).collect()
    both = Feature(id="f", numerator=Expression(expression="weighted_sum", fields=["n", "d"], weights=[0, 2]))
    assert [r[0] for r in df.select(compiled(both, F.col)).collect()] == [0.0, None]
    assert df.select(out_of_bounds(F.col("n"), Feature(id="f", numerator=Expression(fields=["n"]), bounds=(0, 1)))).collect()[0][0]
    with pytest.raises(ValueError):
        Expression(expression="weighted_sum", fields=["a"])


def test_albers_keeps_areas(spark):
    ring = [(145.0, -32.0), (146.0, -32.0), (146.0, -31.0), (145.0, -31.0)]
    rows = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(ring)], "i int, x double, y double").orderBy("i")
    p = [tuple(r) for r in rows.select(*albers(F.col("x"), F.col("y"))).collect()]
    area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1]))) / 2e6
    cap = math.radians(1) * (math.sin(math.radians(-31)) - math.sin(math.radians(-32))) * 6371.0**2
    assert 8000 < area < 13000 and abs(area / cap - 1) < 0.01


def test_the_best_label_by_bounds_equals_all_scores():
    import random

    from areaweave.functions.fuzzy import Labels, token_set_ratio

    rng = random.Random(11)
    words = ["GEORGE", "GEROGE", "PITT", "STREET", "ST", "ROAD", "NSW", "2000", "1", "12", "112", "LEVEL", "5", "É"]
    make = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 7)))
    labels = [make() for _ in range(80)]
    ids = [f"P{rng.randint(0, 999):03d}{k:03d}" for k in range(80)]
    known = Labels(labels, ids)
    for _ in range(300):
        text, threshold = make(), rng.choice((0.5, 0.7, 0.85, 0.95))
        place = rng.choice((None, None, "STREET NSW"))
        scores = [(-token_set_ratio(text, x), i, k) for k, (x, i) in enumerate(zip(labels, ids)) if token_set_ratio(text, x) >= threshold and (place is None or place in x)]
        got = known.best(text, threshold, place)
        assert (got is None) == (not scores)
        if scores:
            assert (got[0], got[1]) == (min(scores)[2], -min(scores)[0])


def test_paced_requests():
    from areaweave.operators.geocode import Paced

    now, waits, asked = [0.0], [], []

    def wait(s):
        waits.append(round(s, 3))
        now[0] += s

    answers = {"a": [(200, {}, [{"lat": "1.5", "lon": "2"}])], "b": [(429, {"Retry-After": "7"}, None), (503, {"retry-after": "soon"}, None), (200, {}, [{"lat": 3, "lon": 4}])], "c": [(500, {}, None)], "d": [(200, {}, [])], "e": [(429, {}, None)] * 4}

    def ask(a):
        asked.append(a)
        if a == "f":
            raise TimeoutError
        return answers[a].pop(0)

    paced = Paced(ask, 1.0, wait=wait, clock=lambda: now[0])
    assert list(paced(iter("abcdef"))) == [(1.5, 2.0), (3.0, 4.0), None, None, None, None]
    assert asked == list("a" + "bbb" + "c" + "d" + "eeee" + "f") and 7 in waits and 2 in waits and max(waits) == 7


def test_costly_columns_are_worked_out_once(spark):
    """Filters on a normalised or parsed address stay above it, so its expression stands once in the plan."""
    from areaweave.functions.address import normalize_address, parse_address
    from areaweave.functions.columns import once

    df = spark.createDataFrame([("1 George St, Sydney NSW 2000",), (None,), ("",)], "a string").withColumn("norm", once(normalize_address(F.col("a"))))
    rows = parse_address(df.where("norm <> ''"), "norm").where("parsed.postcode is not null and parsed.street_number is not null")
    assert [r["parsed"]["postcode"] for r in rows.collect()] == ["2000"] and df.count() == 3
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 2 and plan.count("upper(") == 1
