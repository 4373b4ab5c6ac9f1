import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from areaweave.llm import bpe, langid, quality
from areaweave.llm.queries import tokenizer_path


def test_bpe_equals_library(docs, rows):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    odd = [(1000 + k, t) for k, t in enumerate(["ΑΣ ΣΑΣ", "a<|endoftext|>B <|startoftext|>", "it's we'll 12345 ½", "İstanbul", "x\x00y\x1c z\u0085w", "ab" * 3000, "'''''S't", "\0<|endoftext|>", "e\u0301"])]
    more = docs.sparkSession.createDataFrame([(i, t, None, None, None, None) for i, t in odd], docs.schema)
    got = bpe.encode(docs.unionByName(more), path, keep=["extra", "doc_id"]).collect()
    texts = {("r", k): r[1] for k, r in enumerate(rows)} | {("o", i): t for i, t in odd}
    assert len(got) == len(texts)
    for r in got:
        text = texts["r", r["extra"]] if r["extra"] is not None else texts["o", r["doc_id"]]
        ids = lib.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids_le"], "<u4").tolist() == ids
        assert r["decoded"] == lib.decode(ids, skip_special_tokens=False)


def test_bpe_decode_and_arrays(docs):
    path = tokenizer_path("word_bpe_49k.json")
    made = bpe.encode(docs, path, keep=["doc_id"])
    again = bpe.decode(made.select("doc_id", "ids_le", F.col("decoded").alias("was")), path)
    assert again.where("decoded <> was").count() == 0
    r = made.select(bpe.ids_array().alias("a"), "ids_le").collect()
    assert all(x["a"] == np.frombuffer(x["ids_le"], "<u4").tolist() for x in r)


def test_bpe_columns_and_empty(docs, empty):
    path = tokenizer_path("word_bpe_49k.json")
    clash = docs.withColumn("decoded", F.lit(1)).withColumn("ids_le", F.lit(2))
    assert bpe.encode(clash, path).columns == ["doc_id", "lang", "source", "n_chars", "extra", "ids_le", "decoded"]
    assert bpe.encode(empty, path).count() == 0


def test_bpe_task_leaves_no_words_behind():
    """A worker serves other stages after a task: it keeps the vocabulary alone, and the words of few texts stand in memory at once."""
    import pyarrow as pa

    b, seen = bpe.WordBpe(open(tokenizer_path("word_bpe_49k.json"), "rb").read()), []
    whole, texts = b.encode_batch, [f"{k} " + " ".join(f"w{k}x{i}" for i in range(20_000)) for k in range(12)]
    b.encode_batch = lambda part: (seen.append(sum(map(len, part))), whole(part))[1]
    batch = pa.RecordBatch.from_arrays([pa.array(range(12)), pa.array(texts)], names=["doc_id", "__text"])
    got = [r for out in bpe.encoded(b, iter([batch]), ["doc_id"]) for r in out.to_pylist()]
    assert [r["doc_id"] for r in got] == list(range(12)) and max(seen) < 1 << 20 < sum(seen)
    assert not b.index and not b.compatible and not b.decoded and not len(b.flat)
    ids, decoded = bpe.WordBpe.encode_batch(b, texts)
    assert [r["ids_le"] for r in got] == ids and [r["decoded"] for r in got] == decoded


def test_vectorised_merging_equals_scalar():
    b = bpe.WordBpe(open(tokenizer_path("word_bpe_49k.json"), "rb").read())
    rng = np.random.default_rng(2)
    ws = ["".join(rng.choice(list("abcdefnotshi"), rng.integers(1, 60))) for _ in range(300)]
    assert b.exact_many(ws) == [b.exact(w) for w in ws]
    codes = [(int(x) + 1) << 32 | int(y) for x, y in rng.integers(300, 40000, (500, 2))] + [int(y) for y in rng.integers(300, 40000, 200)]
    one = lambda c: [b.token[t] for t in ([(c >> 32) - 1] if c >> 32 else []) + [c & 0xFFFFFFFF]]
    assert b.check_pairs(codes) == [b.merge([p for t in one(c) for p in b.pieces(t)]) == one(c) for c in codes]
    assert b.merge_long(list("thethethe")) == b.merge(list("thethethe"))


def test_segmentations_are_all_summed():
    pieces = ["▁", "▁a", "a", "ab", "b", "▁ab"]
    table = np.array([[0.1], [0.2], [0.1], [0.3], [0.1], [0.2]])
    p = dict(zip(pieces, table[:, 0]))

    def total(s):
        return 1.0 if not s else sum(p[s[:k]] * total(s[k:]) for k in range(1, len(s) + 1) if s[:k] in p)

    m = langid.Unigrams(pieces, table)
    for w in ("ab", "aab", "abab", "ab" * 9):
        assert np.exp(m.log_prob([w])[0, 0]) == pytest.approx(total("▁" + w))
    for w in ("ab", "ab" * 30):
        uses = m.expected([w], np.array([[1.0]]))[:, 0]
        assert (uses * [len(x) for x in pieces]).sum() == pytest.approx(len(w) + 1)
    # far beyond what a double could hold unscaled, and without a cut
    assert m.log_prob(["ab" * 3000])[0, 0] == pytest.approx(m.log_prob(["ab" * 1500])[0, 0] * 2, rel=1e-2)


def test_signs_that_are_no_letters():
    assert langid.words_of("½ ² Ⅷ 42 _") == [] and langid.words_of("a½b Été") == ["a", "b", "été"]


def test_language_accuracy_and_cases(docs, rows, empty):
    pieces = langid.read_pieces(tokenizer_path("piece_bpe_32k.model"))
    train = docs.where("doc_id % 4 <> 2")
    langs, table = langid.fit(train, pieces)
    assert langs == ["en", "fr"] and table.sum(0) == pytest.approx([1, 1])
    got = {r["extra"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, pieces, langs, table, keep=["extra"]).collect()}
    assert len(got) == len(rows)
    held = [(r[2], got[r[5]][0]) for r in rows if r[0] is not None and r[0] % 4 == 2 and r[0] < 90]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    for r in rows:
        if not any(c.isalpha() for c in r[1] or ""):
            assert got[r[5]] == ("und", 0.0)
        assert 0 <= got[r[5]][1] <= 1
    nothing = langid.fit(empty, pieces)
    assert nothing[0] == [] and {r["lang_pred"] for r in langid.predict(docs, pieces, *nothing).collect()} == {"und"}


def test_quality(spark, docs, empty):
    rng = np.random.default_rng(4)
    names = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        kind = i % 3
        ws = list(rng.choice(names, 80))
        if kind == 0:
            ws = [w + "%%%" for w in ws]
        if kind == 1:
            ws[10:13] = ["vile", "awful", "nasty"]
        rows.append((i, " ".join(ws)))
        labels.append((i, int(kind != 0), int(kind == 1)))
    labels += [(None, 1, 0), (0, None, 0), (2, 1, 0)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    rated = quality.grades(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert rated.count() == 900
    model = quality.fit(table, rated.where("doc_id % 2 = 0"))
    assert (np.diff(model.thresholds) > 0).all()
    got = quality.score(table, model).where("doc_id % 2 = 1").collect()
    right = [r["keep"] == (r["doc_id"] % 3 == 2) for r in got]
    assert sum(right) / len(right) > 0.97
    assert all(0 <= r["expected_grade"] <= 2 and 0 <= r["p_top"] <= 1 for r in got)
    # probabilities are those of the rated texts, on rows that were not rated
    assert abs(np.mean([r["p_top"] for r in got]) - 1 / 3) < 0.05 and abs(np.mean([r["expected_grade"] for r in got]) - 1) < 0.1
    assert quality.score(docs.withColumn("keep", F.lit("x")), model).count() == docs.count()
    assert quality.score(empty, model).count() == 0
    assert quality.fit(table, rated.limit(0)) is None
    assert quality.score(docs, None).where("not keep").count() == 0


def test_many_rows_of_a_rated_id(spark):
    rows = [(1, f"good text number {k % 7}") for k in range(500)] + [(2, "bad %%% text")] + [(k, f"good {k}") for k in range(3, 20)] + [(k, f"bad %%% {k}") for k in range(20, 40)]
    rated = spark.createDataFrame([(k, 0 if k == 2 or k >= 20 else 2) for k in range(1, 40)], "doc_id long, grade int")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert quality.fit(df, rated, max_train=10) is not None
    assert quality.fit(df, rated).thresholds.shape == (2,)


def test_ordinal_gradient():
    rng = np.random.default_rng(5)
    rows = [np.unique(rng.integers(0, 30, 8)) for _ in range(200)]
    grade = np.array([int(3 in r) + int(7 in r) for r in rows])
    m = quality.Ordinal.fit(rows, grade, 3, tied=0, least=1)
    line = np.array([m.weights[r].sum() for r in rows])
    p = m.tails(line)
    assert (p[:, 0] >= p[:, 1]).all() and ((p > 0.5).sum(1) == grade).mean() > 0.95


def test_language_sample_counts_copies_once_and_loses_none(spark):
    """A language whose documents are copies of one text is learnt from that text, and copies don't outgrow the bound."""
    rng = random.Random(2)
    words = {"xx": "abab baba aab", "yy": "ccdd ddcc cdcd"}
    rows = [("xx", words["xx"])] * 300 + [("yy", " ".join(rng.choice(words["yy"].split()) for _ in range(6))) for _ in range(300)] + [("zz", "e f e f")]
    train = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(rows)], "doc_id long, text string, lang string")
    pieces = ["▁", "a", "b", "c", "d", "e", "f", "ab", "cd", "ef", "▁c"]
    langs, table = langid.fit(train, pieces, max_docs_per_lang=5)
    assert langs == ["xx", "yy", "zz"]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(train.select("doc_id", "text"), pieces, langs, table, keep=["doc_id"]).collect()}
    assert all(got[i] == x for i, (x, _) in enumerate(rows))
    once, _ = langid.fit(train.dropDuplicates(["text"]), pieces, max_docs_per_lang=5)
    assert once == langs and np.allclose(langid.fit(train.dropDuplicates(["text"]), pieces, max_docs_per_lang=5)[1], table)


def test_ordinal_fit_is_a_minimum_of_the_written_out_likelihood():
    """The penalised likelihood, written out row by row, is least at the fit; probabilities and expected grade follow from it."""
    import math

    rng = random.Random(8)
    n, levels = 240, 3
    rows = [np.array(sorted(rng.sample(range(12), rng.randint(1, 5)))) for _ in range(n)]
    grade = np.array([min(2, max(0, int(sum({0: 1.5, 1: -1.5, 2: 0.7}.get(int(x), 0) for x in r) + rng.gauss(1, 0.8)))) for r in rows])
    assert set(grade) == {0, 1, 2}
    model = quality.Ordinal.fit(rows, grade, levels, rounds=3000, ridge=0.5, rate=0.02)
    counts = [sum(g == k for g in grade) for k in range(levels)]
    heavy = [1 / counts[g] ** 0.75 for g in grade]
    heavy = [h * n / sum(heavy) for h in heavy]

    def sigma(v):
        return 1 / (1 + math.exp(-v))

    def chances(weights, thresholds, row):
        line = sum(float(weights[x]) for x in row)
        below = [0.0, *(sigma(t - line) for t in thresholds), 1.0]
        return [b - a for a, b in zip(below, below[1:])]

    def cost(weights, thresholds):
        return -sum(h * math.log(chances(weights, thresholds, r)[g]) for h, r, g in zip(heavy, rows, grade)) + 0.25 * sum(float(w) ** 2 for w in weights[:12])

    best = cost(model.weights, model.thresholds)
    assert list(model.thresholds) == sorted(model.thresholds) and best < cost(np.zeros(12), model.thresholds) - 10
    for _ in range(60):
        w, t = model.weights[:12].astype(float).copy(), model.thresholds.copy()
        if rng.random() < 0.7:
            w[rng.randrange(12)] += rng.choice([-0.1, 0.1])
        else:
            t[rng.randrange(2)] += rng.choice([-0.1, 0.1])
        assert cost(w, t) > best - 1e-3
    line = model.line(rows)
    tails = model.tails(line)
    for r, tail in zip(rows[:50], tails):
        p = chances(model.weights, model.thresholds, r)
        assert sum(p) == pytest.approx(1) and tail.tolist() == pytest.approx([p[1] + p[2], p[2]]) and tail.sum() == pytest.approx(p[1] + 2 * p[2])
