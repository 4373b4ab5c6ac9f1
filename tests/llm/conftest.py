import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra int"
PASSAGE = " ".join(f"shared{i}" for i in range(60))


def words(rng, n, names):
    return " ".join(rng.choice(names) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Texts of two made-up languages with copies, near copies, a passage in many, empties, nulls and odd characters."""
    rng = random.Random(7)
    en = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    fr = ["".join(rng.choice("mnopqrstué") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    out = []
    for i in range(60):
        lang, names = ("en", en) if i % 2 else ("fr", fr)
        out.append((i, words(rng, rng.randint(30, 160), names), lang))
    base = out[5][1].split(" ")
    for i in range(60, 75):  # near copies of a text, and copies
        near = list(base)
        if i % 3:
            near[i % len(near)] = f"new{i}"
        out.append((i, " ".join(near), "en"))
    for i in range(75, 90):  # a passage that many share
        out.append((i, f"{words(rng, 20, en)} {PASSAGE} {words(rng, 25, en)}", "en"))
    out += [(90, None, "en"), (91, "", None), (92, " \n\t ", "fr"), (93, "a", "en"), (94, "42 !!", None), (95, "x " * 300, "en"), (96, "x " * 200, "en"), (97, "é" * 3000, "fr"), (98, "日本語 テキスト 😀 " * 40, None)]
    out += [(99, out[95 - 90 + 75][1] + " tail", "en"), (None, "no id here", "en"), (None, None, None), (95, "x " * 300, "en")]
    out.append((100, " ".join(en * 20), "en"))
    return [(i, t, lang, f"s{(i or 0) % 3}", len(t or ""), k) for k, (i, t, lang) in enumerate(out)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
