"""Repeat detection against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from areaweave.llm import _hash, jaccard, phrases, suffixes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def covered(n, starts, size):
    mark = [False] * n
    for s in starts:
        mark[s : s + size] = [True] * size
    return mark


def test_phrases(docs, rows):
    size, count, all_words = 35, Counter(), {}
    for k, (_, t, *_) in enumerate(rows):
        w = all_words[k] = WORD.findall(t or "")
        count.update(tuple(w[s : s + size]) for s in range(len(w) - size + 1))
    want = Counter()
    for k, w in all_words.items():
        mark = covered(len(w), [s for s in range(len(w) - size + 1) if count[tuple(w[s : s + size])] > 1], size)
        want[rows[k][0], len(w), " ".join(x for x, m in zip(w, mark) if not m)] += 1
    for block, kinds, step in ((1 << 20, 1000, 1 << 20), (4000, 1000, 100), (4000, 1, 1 << 20)):  # one block; many, in steps; dealt again by cores
        got = Counter((r["doc_id"], r["n_words"], r["kept"]) for r in phrases.dedup(docs, block_bytes=block, kinds=kinds, step=step).collect())
        assert got == want
    assert any(r["removed"] for r in phrases.dedup(docs).collect())


def test_suffixes(docs, rows):
    size, count = 400, Counter()
    texts = [(t or "").encode() for _, t, *_ in rows]
    for t in texts:
        count.update(t[s : s + size] for s in range(len(t) - size + 1))
    want = Counter()
    for (i, *_), t in zip(rows, texts):
        mark = covered(len(t), [s for s in range(len(t) - size + 1) if count[t[s : s + size]] > 1], size)
        want[i, len(t), bytes(b for b, m in zip(t, mark) if not m)] += 1
    for kinds, block, step in ((1000, 1 << 20, 1 << 20), (1000, 5000, 700), (1, 5000, 1 << 20)):
        got = Counter((r["doc_id"], r["n_bytes"], bytes(r["kept"])) for r in suffixes.dedup(docs, kinds=kinds, block_bytes=block, step=step).collect())
        assert got == want


def test_suffix_array_random():
    rng = random.Random(0)
    for _ in range(500):
        s = np.array([rng.randint(1, 3) for _ in range(rng.randint(0, 40))], np.int64)
        assert suffixes.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_window_hashes():
    h = _hash.mix(np.array([1, 2, 3, 1, 2, 3, 9], np.uint64))
    for size in (1, 2, 3, 5):
        w = _hash.window_hashes(h, size)
        assert len(w) == 8 - size
        for i in range(len(w)):
            for j in range(len(w)):
                assert (w[i] == w[j]) == (h[i : i + size].tolist() == h[j : j + size].tolist())


def test_least_places():
    rng = np.random.default_rng(1)
    for n, width in ((1, 1), (5, 7), (50, 7), (200, 1), (300, 29), (64, 64)):
        h = rng.integers(0, 9, n).astype(np.uint64) << np.uint64(40)
        want = [i + int(np.argmin(h[i : i + width])) for i in range(n - width + 1)]
        assert _hash.least_places(h, width).tolist() == want


def test_word_hashes():
    """Equal words have equal hashes, wherever they stand, and no pattern of letters cancels out."""
    thue = "a"
    while len(thue) < 1024:
        thue += thue.translate(str.maketrans("ab", "ba"))
    names = ["a", "b", "ab", "abcdefgh", "abcdefgi", "abcdefghi", "é", "x" * 64, "x" * 65, "日本", thue, thue.translate(str.maketrans("ab", "ba"))]
    raw, offsets = _hash.text_bytes(pa.array([" ".join(names), " ".join(reversed(names))]))
    starts, ends, first = _hash.word_bounds(raw, offsets)
    h = _hash.word_hashes(raw, starts, ends).tolist()
    assert h[: len(names)] == h[len(names) :][::-1] and len(set(h)) == len(names)


def shingles(t):
    w = WORD.findall(t or "")
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    low = {}
    for i in range(len(rows)):
        if rows[i][0] is not None:
            low[root(i)] = min(low.get(root(i), rows[i][0]), rows[i][0])
    return Counter((rows[i][0], low.get(root(i)) if sets[i] else rows[i][0], links[i]) for i in range(len(rows)))


@pytest.mark.parametrize("block", [512, 3])
def test_jaccard(docs, rows, block):
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard.join(docs, block=block).collect())
    assert got == brute(rows)


def test_keep_one(docs, rows):
    """Of the rows with shingles, one of each class; the least id, then whatever text; blank rows all stay."""
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    sets, parent = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) >= 0.8 * len(a | sets[j]) - 1e-9:
                parent[root(i)] = root(j)
    got = kept.collect()
    blank = [r for r in rows if not shingles(r[1])]
    assert Counter(r["extra"] for r in got if not shingles(r["text"])) == Counter(r[5] for r in blank)
    left = [r for r in got if shingles(r["text"])]
    assert sorted(root(r["extra"]) for r in left) == sorted({root(i) for i, s in enumerate(sets) if s})
    least = {}
    for i, r in enumerate(rows):
        if sets[i]:
            least[root(i)] = min(least.get(root(i), (True, 0)), (r[0] is None, r[0] or 0))
    assert all((r["doc_id"] is None, r["doc_id"] or 0) == least[root(r["extra"])] for r in left)


def test_keep_one_with_repeated_ids(spark):
    a, b, c = ("one two three four five six " * 3, "seven eight nine ten eleven twelve " * 3, "red green blue black white grey " * 3)
    df = spark.createDataFrame([(5, a), (95, a), (95, b), (7, c), (7, c), (None, b), (8, None), (8, None)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"] or "") for r in jaccard.keep_one(df).collect()) == [(5, a), (7, c), (8, ""), (8, ""), (95, b)]


def test_prefixes_shorten_by_what_a_text_can_reach():
    assert jaccard.weakest(3) is None and jaccard.weakest(4) == 0.8 and jaccard.weakest(6) == pytest.approx(5 / 6) and jaccard.weakest(7) == pytest.approx(6 / 7)
    assert jaccard.prefix_depth(similarity=6 / 7) > jaccard.prefix_depth() == 5
    for s in (0.8, 5 / 6, 6 / 7):
        d = jaccard.prefix_depth(similarity=s)
        assert 1 - (1 - s**d) ** jaccard.TREES >= jaccard.RECALL
        assert d == jaccard.DEPTH or 1 - (1 - s ** (d + 1)) ** jaccard.TREES < jaccard.RECALL


def test_meetings():
    """Pairs that share the longer of their prefixes in some tree, against all pairs."""
    rng = np.random.default_rng(2)
    m, deep = rng.integers(0, 2, (40, 3, 8)), rng.integers(3, 7, 40)
    both = np.stack([jaccard.labels_of(x.ravel().astype(np.uint32), 3, 8) for x in m])
    met = jaccard.meetings(np.ascontiguousarray(both[:, :, 0].T), np.ascontiguousarray(both[:, :, 1].T), deep, 3)
    for i in range(40):
        for j in range(40):
            want = i != j and any((m[i, t, : max(deep[i], deep[j])] == m[j, t, : max(deep[i], deep[j])]).all() for t in range(3))
            assert met[i, j] == want


def test_empty(empty):
    assert phrases.dedup(empty).count() == suffixes.dedup(empty).count() == jaccard.join(empty).count() == 0


def test_dense_and_sparse_counts_agree():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, 30).astype(np.uint64)) for _ in range(80)]
    for left in (80, 30):
        for i, counts in jaccard.shared_counts(sets, left):
            assert counts.tolist() == [len(np.intersect1d(sets[i], s)) for s in sets]


def test_gatherings_of_hubs(spark):
    name = lambda k: k.to_bytes(4, "big")
    edges = [(5_000, k) for k in range(0, 1_000, 2)] + [(k, 3) for k in range(1, 300, 2)] + [(9_000 + k, 9_001 + k) for k in range(40)] + [(7, 7)]
    whole = {k: min(k for pair in part for k in pair) for part in (edges[:500], edges[500:650], edges[650:690]) for pair in part for k in pair}
    df = spark.createDataFrame([(name(a), name(b)) for a, b in edges], "u binary, v binary")
    got = {bytes(r["node"]): bytes(r["root"]) for r in jaccard.gatherings(df).collect()}
    assert got == {name(k): name(root) for k, root in whole.items() if k != root}


def test_a_context_in_every_block_is_dealt_to_many_tasks(spark):
    """One context in 5,000 blocks: hot keys are broadcast, and no join moves its rows by the bare key."""
    from areaweave.llm import _anchored, _common

    schema = "g long, c1 long, c2 long, block long, rel int, span int, n int, at array<int>"
    rows = [(7, 1, 2, b, 0, 3, 1, [0]) for b in range(5000)] + [(7, 3, 4, b, 0, 3, 1, [0]) for b in range(40)] + [(9, 5, 6, 1, 0, 3, 1, [0]), (9, 5, 6, 2, 0, 3, 2, [0, 9]), (8, 1, 1, 3, 0, 3, 1, [0])]
    known = _anchored.known_contexts(spark.createDataFrame(rows, schema).repartition(4))
    got = {(r["g"], r["block"]): (r["whole"], r["stands"]) for r in known.where("g = 9 or span = 3").collect() if r["g"] == 9}
    assert got == {(9, 1): (True, False), (9, 2): (True, False)}
    assert known.where("whole").count() == 5042 and known.where("stands").count() == 2

    table = spark.createDataFrame([(k, 5000 if k == 0 else 1) for k in range(50)], "k int, many long")
    left = spark.createDataFrame([(0, i) for i in range(5000)] + [(k, k) for k in range(1, 50)] + [(99, 0)], "k int, i int")
    joined = _common.salted_join(left, table, ["k"], "many", F.col("i"))
    assert joined.count() == 5049 and joined.where("k = 0").count() == 5000
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables of any size
    try:
        plan = _common.salted_join(left, table, ["k"], "many", F.col("i"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    exchanges = [x for x in plan.splitlines() if "hashpartitioning" in x]
    assert exchanges and all("__salt" in x for x in exchanges)
    # a smaller share of all rows than one in hot_keys is not hot
    assert _common.salted_join(left, table, ["k"], "many", F.col("i"), share=1, hot_keys=10).count() == 5049


def test_keep_one_of_equal_rows_is_told(spark):
    from areaweave.llm import jaccard

    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, "fr", "b", 5, {"x": 1}), (1, text, None, "b", 5, {"x": 2}), (1, text, "en", "a", 5, {"x": 3}), (2, text, "aa", "a", 5, {"x": 4}), (3, "", "en", "a", 0, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, extra map<string,int>").repartition(3)
    got = sorted((r["doc_id"], r["lang"], r["source"], r["extra"]) for r in jaccard.keep_one(df).collect())
    assert got == [(1, None, "b", {"x": 2}), (3, "en", "a", None)]
