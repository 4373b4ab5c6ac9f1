"""Spelling variants against the comparison of all words with all words."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from areaweave.llm import variants


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:j] + b[j + 1 :] == a for j in range(len(b)))


def by_hand(count):
    out = {}
    for w, n in count.items():
        near = sorted((x for x in count if one_apart(w, x)), key=lambda x: (-count[x], x))
        fit = near and count[near[0]] >= 2 * n
        out[w] = (near[0] if fit else None, n, len(near), count[near[0]] if fit else None)
    def root(w):
        return root(out[w][0]) if out[w][0] else w
    return {w: (f, root(w), n, k, m) for w, (f, n, k, m) in out.items()}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=60), st.data())
def test_wavelet_reports_rectangles(_, data):
    n = len(_)
    values = np.array(data.draw(st.permutations(range(n))))
    tree = variants.Wavelet(values)
    box = [data.draw(st.integers(0, n)) for _ in range(4)]
    a, b, c, d = *sorted(box[:2]), *sorted(box[2:])
    who, got = tree.report(*(np.array([x, 0]) for x in (a, b, c, d)))
    assert sorted(got[who == 0]) == sorted(v for v in values[a:b] if c <= v < d)


def words_of(rng, n, letters="ab", low=5, high=9):
    return {"".join(rng.choice(letters) for _ in range(rng.randint(low, high))): rng.choice([3, 3, 4, 6, 9, 30, 100]) for _ in range(n)}


@pytest.mark.parametrize("crowd,shard,letters", [(20_000, 60_000, "ab"), (4, 50, "ab"), (1, 7, "abcé"), (3, 10**6, "a")])
def test_groups_against_all_pairs(spark, crowd, shard, letters):
    rng = random.Random(crowd)
    count = words_of(rng, 250, letters) | {"zz": 4, "x": 9, "zzé": 8, "y" * 60: 3, "y" * 61: 7}
    df = spark.createDataFrame(list(count.items()), "word string, n long").repartition(3)
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in variants.group(df, crowd=crowd, shard=shard).collect()}
    assert got == by_hand(count)


def test_long_chains_reach_their_root(spark):
    chain = {"b" * k + "a" * (12 - k): 3 * 2**k for k in range(13)}
    df = spark.createDataFrame(list(chain.items()), "word string, n long")
    assert {r["root"] for r in variants.group(df).collect()} == {"b" * 12}


def test_crowded_places_are_cut_until_none_is(spark):
    rng = random.Random(3)
    count = {"prefix" + "".join(rng.choice("abc") for _ in range(8)) + "suffix": 3 for _ in range(400)}
    df = spark.createDataFrame(list(count.items()), "word string, n long")
    made = variants.entries(df, crowd=12)
    worst = made.groupBy("m", "lo", "hi", "key").count().where("hi - lo > 1").agg(F.max("count")).first()[0]
    assert worst <= 12
    # the zones of a word cover every place of its index once
    cover = made.groupBy("word", "m").agg(F.sum(F.col("hi") - F.col("lo")).alias("n")).where("n <> m").count()
    assert cover == 0


def test_runs_and_counts(spark):
    texts = ["Ärger ÄRGER ärger x1y", None, "", "Straße-straße STRASSE", "é" * 50_000, "abcde " * 3]
    df = spark.createDataFrame([(k, t, "n") for k, t in enumerate(texts)], "doc_id long, text string, word string")
    got = {r["k"]: r["r"] for r in df.select(F.col("doc_id").alias("k"), variants.runs(F.col("text")).alias("r")).collect()}
    assert got == {0: ["Ärger", "Ärger", "ärger", "x", "y"], 1: None, 2: [], 3: ["straße", "straße", "strasse"], 4: ["é" * 50_000], 5: ["abcde"] * 3}
    tokens = df.select(F.explode(variants.runs(F.col("text"))).alias("word"))
    assert {r["word"]: r["n"] for r in variants.count(tokens).collect()} == {"abcde": 3}


def test_empty_tables(spark):
    df = spark.createDataFrame([], "word string, n long")
    assert variants.group(df).count() == 0
