"""Merkle manifests against trees built in one place."""

import hashlib

import pytest

from pyspark.sql import functions as F

from areaweave.llm import merkle


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def levels_by_hand(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def path_by_hand(levels, i):
    out = []
    for nodes in levels[:-1]:
        at = i // 16 * 16
        out.append((i - at, "".join(nodes[at:i] + nodes[i + 1 : at + 16])))
        i //= 16
    return out


@pytest.mark.parametrize("levels", [1, 2, 3])
@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 700])
def test_traversal_of_a_block(levels, n):
    if n > 16**levels:
        return
    leaves = [H(str(i)) for i in range(n)]
    for h in {merkle.levels_of(n, levels), levels}:
        want = levels_by_hand(leaves)
        while len(want) <= h:  # a lone last run is folded on
            want.append([H(want[-1][0])])
        assert merkle.fold(leaves, h) == want[h][0]
        for i, got in enumerate(merkle.paths(leaves, h)):
            assert [(at, "".join(o)) for at, o in got] == path_by_hand([*want[:h], []], i)


def proved(rows, **more):
    leaf = merkle.digest(*[F.col(c) for c in ("doc_id", "source", "text")])
    return merkle.prove(rows.select("doc_id", "source", F.col("doc_id").alias("order"), "text", leaf.alias("leaf")), **more)


def leaf_by_hand(*values):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


@pytest.mark.parametrize("levels", [1, 2])
def test_proofs_against_trees_by_hand(spark, levels):
    rows = [(i, f"s{i % 3}" if i % 7 else None, f"tëxt {i}" if i % 5 else None, "root") for i in range(90)] + [(900 + i, "big", "A" * (i % 9), None) for i in range(300)] + [(2000, "lone", "", "x"), (2001, "é", "z", "x")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, root string").repartition(4)
    got = {r["doc_id"]: r for r in proved(df, levels=levels).withColumn("again", merkle.folded(F.col("leaf"), F.col("proof"))).collect()}
    assert len(got) == len(rows)
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_by_hand([leaf_by_hand(*r[:3]) for r in sorted(by[s])]) for s in names}
    top = levels_by_hand([trees[s][-1][0] for s in names])
    for k, s in enumerate(names):
        for i, r in enumerate(sorted(by[s])):
            g = got[r[0]]
            assert (g["subroot"], g["root"], g["again"]) == (trees[s][-1][0], top[-1][0], top[-1][0])
            assert [(p["pos"], p["others"]) for p in g["proof"]] == path_by_hand(trees[s], i) + path_by_hand(top, k)
    kept = {r["source"]: (r["n"], r["subroot"]) for r in merkle.manifest(proved(df, levels=levels)).collect()}
    assert kept == {s: (len(by[s]), trees[s][-1][0]) for s in names}


def test_nulls_repeats_and_empty_tables(spark, docs, rows, empty):
    got = proved(docs).withColumn("ok", merkle.folded(F.col("leaf"), F.col("proof")) == F.col("root")).collect()
    assert len(got) == len(rows) and all(r["ok"] for r in got)
    assert proved(empty).count() == 0
    one = proved(docs.where("doc_id = 93")).collect()
    assert len(one) == 1 and one[0]["proof"] == [] and one[0]["leaf"] == one[0]["subroot"] == one[0]["root"]


def test_any_change_is_seen(spark):
    rows = spark.createDataFrame([(i, "s", f"t{i}") for i in range(40)], "doc_id long, source string, text string")
    claim = merkle.digest(F.col("doc_id"), F.col("source"), F.concat("text", F.when(F.col("doc_id") == 7, "!").otherwise("")))
    got = proved(rows).withColumn("ok", merkle.folded(claim, F.col("proof")) == F.col("root")).collect()
    assert [r["doc_id"] for r in got if not r["ok"]] == [7]


def test_digest_parts_are_told_apart(spark):
    df = spark.createDataFrame([("a", "b"), ("ab", ""), (None, "ab"), ("-", "ab"), ("é", "x" * 200_000)], "x string, y string")
    got = [r[0] for r in df.select(merkle.digest(F.col("x"), F.col("y"))).collect()]
    assert got == [leaf_by_hand(*v) for v in [("a", "b"), ("ab", ""), (None, "ab"), ("-", "ab"), ("é", "x" * 200_000)]] and len(set(got)) == 5
