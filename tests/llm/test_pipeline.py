import re

import numpy as np
import pytest

import corpus_pipeline as cp
from areaweave.llm import quality, queries
from tests.llm.test_native import agrees, linked_by_hand
from tests.llm.test_repeats import shingles

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, docs, rows, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    more = [(200, "mail user: deploy key Zk9Qw3Rt5Yu7Io1Pa2Sd4Fg6 to all of us here", "en", None, None), (200, "mail user: deploy key Zk9Qw3Rt5Yu7Io1Pa2Sd4Fg6 to all of us here", "en", None, None), (5, "another text under a number that is taken already by some other one", None, "s", 3), (201, "password = hunter22 and nothing else to see in this one", "en", "s", 1)]
    docs = docs.select(COLUMNS).unionByName(spark.createDataFrame(more, docs.select(COLUMNS).schema))
    docs.select(COLUMNS).write.parquet(f"{d}/documents.parquet")
    labels = [(r[0], int(r[0] % 5 != 0), 0) for r in rows if r[0] is not None and r[0] < 60]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, " ".join(rows[20][1].split()[:20])), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages(spark, folder, rows):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == COLUMNS, name
        assert stage(spark, docs.limit(0), folder).count() == 0
    assert 20 not in {r["doc_id"] for r in cp.drop_leaks(spark, docs, folder).collect()}


def by_hand(spark, folder, texts):
    """What the stages leave of documents, each by brute force; the classifier's own decision is taken as it is."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.fit(docs, quality.grades(spark.read.parquet(f"{folder}/labels.parquet")))
    left = [tuple(r)[:5] for r in quality.score(docs, model).where("keep").collect()]
    sets, parent = [shingles(r[1]) for r in left], list(range(len(left)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) >= 0.8 * len(a | sets[j]) - 1e-9:
                parent[root(i)] = root(j)
    groups = {}
    for i in range(len(left)):
        groups.setdefault(root(i) if sets[i] else ("blank", i), []).append(i)
    # one of each group, of least id; which text of several under that id is the stage's choice
    tokens = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    items = [tokens(r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    lib, out = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json")), []
    for members in groups.values():
        first = min((left[i][0] is None, left[i][0] or 0) for i in members)
        options = []
        for i in members:
            doc_id, text = left[i][0], left[i][1] or ""
            if (doc_id is None, doc_id or 0) != first:
                continue
            if any(item and set(item) & set(tokens(text)) and agrees(tokens(text), item) for item in items):
                options.append(None)
                continue
            done, at = "", 0
            for _, a, b in linked_by_hand(text):
                if a >= at:
                    done += text[at:a] + "[SECRET]"
                at = max(at, b)
            options.append((doc_id, lib.encode(done + text[at:], add_special_tokens=False).ids))
        out.append(options)
    return out


def test_run(spark, folder, rows):
    """All five stages against brute force, over nulls, repeated ids and rows, copies, a leak and secrets."""
    left = [(r["doc_id"], np.frombuffer(r["ids_le"], "<u4").tolist(), r["n_tokens"]) for r in cp.run(spark, folder).collect()]
    assert left and all(n == len(ids) for _, ids, n in left)
    got = [(i, ids) for i, ids, _ in left]
    for options in by_hand(spark, folder, rows):
        hit = next((o for o in options if o in got), None)
        if None not in options or hit is not None:
            assert hit is not None
            got.remove(hit)
    assert got == []


def test_registered():
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in queries.queries()}
