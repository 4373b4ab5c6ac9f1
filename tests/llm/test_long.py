"""Texts of several MB, read whole, and columns whose names operators use themselves."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from areaweave.llm import bpe, decontam, jaccard, quality, secrets, urlrules, winnow
from areaweave.llm.queries import tokenizer_path

ITEM = "a question that stands at the very end of a text of several megabytes and is found there as well"


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(30_000)]
    return " ".join(rng.choice(words) for _ in range(450_000)) + f" key AKIA{'Q7' * 9} {ITEM}"


@pytest.fixture(scope="module")
def long_docs(spark, long_text):
    near = long_text.replace("a question", "the question", 1)
    assert len(long_text) > 3_000_000 and near != long_text
    return spark.createDataFrame([(1, long_text, 7, "h"), (2, near, 7, "h"), (3, "short and unlike", 7, "h")], "doc_id long, text string, seed int, item string").repartition(2)


def test_encoding_of_long_texts(long_docs, long_text):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    want = Tokenizer.from_file(path).encode(long_text, add_special_tokens=False).ids
    got = bpe.encode(long_docs, path, keep=["doc_id"]).where("doc_id = 1").select((F.octet_length("ids_le") / 4).cast("long").alias("n"), F.sha2("ids_le", 256).alias("h")).first()
    assert (got["n"], got["h"]) == (len(want), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in want)).hexdigest())


def test_leaks_at_the_end_of_long_texts(spark, long_docs):
    """Columns called ``h``, ``seed``, ``item`` and ``text_key`` beside the text change nothing."""
    bench = spark.createDataFrame([(5, ITEM, 1, 2), (6, "something that no document has in it at all, not even in part, nowhere", 1, 2)], "item_id long, text string, h int, seed int")
    docs = long_docs.withColumn("h", F.lit(1)).withColumn("text_key", F.lit("x")).withColumn("at", F.lit(0)).withColumn("shifts", F.lit(0))
    assert sorted((r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, bench).collect()) == [(1, 5), (2, 5)]
    left = decontam.clean(docs, bench)
    assert left.columns == docs.columns and [r["doc_id"] for r in left.collect()] == [3]


def test_fingerprints_links_and_spans_of_long_texts(long_docs):
    prints = {r["doc_id"]: r for r in winnow.fingerprint(long_docs.select("doc_id", "text"), "text", "fp").select("doc_id", F.size("fp").alias("n"), winnow.hashes(F.col("fp")).alias("own")).collect()}
    assert prints[1]["n"] > 40_000 and len(set(prints[1]["own"]) ^ set(prints[2]["own"])) <= 40
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.join(long_docs).collect()} == {1: (1, 1), 2: (1, 1), 3: (3, 0)}
    spans = {r["doc_id"]: [(s["kind"], s["start"]) for s in r["spans"]] for r in secrets.find(long_docs, keep=["doc_id"]).select("doc_id", "spans").collect()}
    assert [k for k, at in spans[1] if at > 3_000_000] == ["access"] and spans[3] == []


def test_grades_of_long_texts(spark, long_docs):
    rows = [(k, f"good calm words {k}" if k % 2 else f"bad loud noise {k}", k % 2 * 2) for k in range(200)]
    train = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    labels = train.select("doc_id", F.when(F.col("grade") == 2, 1).otherwise(0).alias("quality"), F.lit(0).alias("toxic"))
    model = quality.fit(train.select("doc_id", "text"), quality.grades(labels))
    got = {r["doc_id"]: r["p_top"] for r in quality.score(long_docs.select("doc_id", "text"), model).collect()}
    assert len(got) == 3 and all(0 <= p <= 1 for p in got.values())


def test_long_urls(spark):
    url = "https://WWW.example.net/en/" + "x/" * 1_000_000 + "?q"
    pages = spark.createDataFrame([(1, url, 1), (2, "http://" + "a." * 500_000 + "org/fr/", 1)], "page_id long, url string, url_key int")
    got = {r["page_id"]: r for r in urlrules.judge(pages, spark.createDataFrame([], "url string, blocked boolean")).collect()}
    assert (got[1]["host"], len(got[1]["path"]), got[1]["rule"], got[1]["verdict"]) == ("www.example.net", 2_000_004, "example.net/en/", "allow")
    assert (len(got[2]["host"]), got[2]["path"], got[2]["rule"]) == (1_000_003, "/fr/", "org/fr/")
