"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word is the sum
over all its segmentations into pieces, which a forward recursion computes; the score of a text is the sum of the
log probabilities of its words. The piece probabilities are fitted by expectation maximisation, whose expectation
step is the same recursion run forward and backward.

Defined cases: null text, or text without a letter, is ``und`` with score 0. With nothing to learn from, every text
is ``und`` with score 0. Ties between languages go to the first in alphabetical order. Words of any length are scored
whole, and very long texts in full. Every row is predicted on its own, so repeated rows and ids keep their results; extra
columns play no part. Empty tables give empty tables.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from areaweave.llm._common import cut, slices

UNKNOWN = "und"
#: Probability of a letter that no piece of a language covers.
FLOOR = 1e-6
#: Keeps products over a word within the range of doubles: the factor for each letter, and after how many letters the
#: sums are brought back to one.
SCALE, RESCALE = float(np.exp(5.0)), 16
CACHE_WORDS = 300_000

_WORD = re.compile(r"[^\W\d_]+")


def read_pieces(path: str) -> list[str]:
    """The distinct usable pieces of a sentencepiece vocabulary, read on the driver; word starts carry ``▁``."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    return sorted(p for p in pieces if p and all(c == "▁" or c.isalpha() for c in p) and "▁" not in p[1:])


def words_of(text: str) -> list[str]:
    """The words of a text: runs of letters, in lower case. Signs that count as numbers (``½``) are no letters."""
    found = _WORD.findall(text.lower())
    if text.isascii() or all(map(str.isalpha, found)):
        return found
    return [w for f in found for w in "".join([c if c.isalpha() else " " for c in f]).split()]


def by_length(words: list[str]) -> dict[int, tuple[list[int], list[str]]]:
    """The places and marked forms of the words of each length."""
    groups: dict[int, tuple[list[int], list[str]]] = {}
    for k, w in enumerate(words):
        at, texts = groups.setdefault(len(w) + 1, ([], []))
        at.append(k)
        texts.append("▁" + w)
    return groups


class Unigrams:
    """Piece probabilities by language, and the recursions over all segmentations."""

    def __init__(self, pieces: list[str], table: np.ndarray):
        self.row = {p: i for i, p in enumerate(pieces)}
        # the last row is for a letter that is no piece
        self.prob = np.vstack([table, np.full((1, table.shape[1]), FLOOR)])
        single = [i for i, p in enumerate(pieces) if len(p) == 1]
        self.prob[single] = np.maximum(self.prob[single], FLOOR)
        length = np.array([len(p) for p in pieces] + [1])
        self.scaled = self.prob * SCALE ** length[:, None]
        self.none = len(pieces)
        self.longest = max(map(len, pieces), default=1)
        # a piece that begins a word can stand at its start only
        self.inner = max((len(p) for p in pieces if p[0] != "▁"), default=1)

    def columns(self, words: list[str], i: int, j: int) -> np.ndarray:
        get = self.row.get
        default = self.none if j - i == 1 else -1
        return np.array([get(w[i:j], default) for w in words], np.int64)

    def forward(self, words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], dict]:
        """Forward sums of words of one length, the logarithm each was scaled by, and the piece rows of each span."""
        n, langs = len(words[0]), self.prob.shape[1]
        alpha = [np.ones((len(words), langs))]
        scale = [np.zeros((len(words), langs))]
        spans: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for j in range(1, n + 1):
            total = np.zeros((len(words), langs))
            for i in range(max(0, j - self.longest), j):
                if i and j - i > self.inner:
                    continue
                at = self.columns(words, i, j)
                hit = np.flatnonzero(at >= 0)
                if len(hit):
                    spans[i, j] = hit, at[hit]
                    total[hit] += alpha[i][hit] * self.scaled[at[hit]]
            alpha.append(total)
            scale.append(scale[-1])
            if j % RESCALE == 0:
                # the sums that the next letters reach back to go down together
                top = total
                for i in range(max(0, j + 1 - self.longest), j + 1):
                    alpha[i] = alpha[i] / top
                    scale[i] = scale[i] + np.log(top)
        return alpha, scale, spans

    def log_prob(self, words: list[str]) -> np.ndarray:
        """Log probability of each word under each language."""
        out = np.zeros((len(words), self.prob.shape[1]))
        for n, (at, texts) in by_length(words).items():
            # many words of one length at a time, but not more letters than a batch should hold
            few = max(1, 2_000_000 // (n * self.prob.shape[1]))
            for k in range(0, len(at), few):
                alpha, scale, _ = self.forward(texts[k : k + few])
                out[at[k : k + few]] = np.log(alpha[-1]) + scale[-1] - n * np.log(SCALE)
        return out

    def expected(self, words: list[str], weight: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, by language; weight: uses of each word by language."""
        out = np.zeros_like(self.prob)
        for n, (at, texts) in by_length(words).items():
            few = max(1, 2_000_000 // (n * self.prob.shape[1]))
            for k in range(0, len(at), few):
                part = at[k : k + few]
                alpha, scale, spans = self.forward(texts[k : k + few])
                beta = [np.zeros_like(alpha[0]) for _ in range(n)] + [np.ones_like(alpha[0])]
                back = [np.zeros_like(alpha[0]) for _ in range(n + 1)]
                ends: dict[int, list[int]] = {}
                for i, j in spans:
                    ends.setdefault(i, []).append(j)
                for i in range(n - 1, -1, -1):
                    back[i] = back[i + 1]
                    for j in ends.get(i, ()):
                        hit, rows = spans[i, j]
                        beta[i][hit] += beta[j][hit] * self.scaled[rows]
                    if (n - i) % RESCALE == 0:
                        top = beta[i]
                        for j in range(i, min(n, i + self.longest)):
                            beta[j] = beta[j] / top
                            back[j] = back[j] + np.log(top)
                share = weight[part] / alpha[-1]
                for (i, j), (hit, rows) in spans.items():
                    shift = np.exp(scale[i][hit] + back[j][hit] - scale[-1][hit])
                    np.add.at(out, rows, alpha[i][hit] * self.scaled[rows] * beta[j][hit] * share[hit] * shift)
        return out[:-1]


def fit(
    train: DataFrame,
    pieces: list[str],
    text_col: str = "text",
    lang_col: str = "lang",
    max_docs_per_lang: int = 500,
    rounds: int = 2,
) -> tuple[list[str], np.ndarray]:
    """Languages and a (piece, language) table of probabilities.

    Learns from a bounded sample: about ``max_docs_per_lang`` different texts of each language, picked by a hash of the text,
    so that the sample is the same for the same rows in any order, copies count once, and every language has a text in it.
    The words of the sample are counted and the expectation step runs on the executors; what comes to the driver is one row
    per piece and language.
    """
    spark = train.sparkSession
    rows = train.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    found = {r["lang"]: r for r in rows.groupBy("lang").agg(F.approx_count_distinct("hash", 0.01).alias("n"), F.min("hash").alias("least")).collect()}
    langs = sorted(found)
    if not langs:
        return [], np.zeros((len(pieces), 0))
    by_lang = lambda value: F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(value(found[k])))])[F.col("lang")]
    # the share of the range of a hash that a text has to fall into, and the text of least hash whatever the share
    share = by_lang(lambda r: min(1.0, max_docs_per_lang / max(1, r["n"])))
    inside = F.pmod("hash", F.lit(1 << 20)) / float(1 << 20) < share
    picked = rows.where(inside | (F.col("hash") == by_lang(lambda r: r["least"]))).groupBy("lang", "hash").agg(F.first("text").alias("text")).select("lang", "text")

    def count(batches):
        for b in batches:
            for part in slices(b, "text", 4 << 20):
                tally: dict[tuple[str, str], int] = {}
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for w in words_of(text):
                        tally[lang, w] = tally.get((lang, w), 0) + 1
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in tally], pa.string()), pa.array([k[1] for k in tally], pa.string()), pa.array(list(tally.values()), pa.int64())], names=["lang", "word", "n"])

    words = cut(picked.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "langid-words")
    where = {k: i for i, k in enumerate(langs)}
    table = np.full((len(pieces), len(langs)), 1.0 / len(pieces))
    for _ in range(rounds):
        shipped = spark.sparkContext.broadcast((pieces, table))  # bounded: vocabulary x languages

        def expect(batches, shipped=shipped, k=len(langs)):
            model = Unigrams(*shipped.value)
            total = np.zeros((len(model.row), k))
            for b in batches:
                for start in range(0, b.num_rows, 20_000):
                    part = b.slice(start, 20_000)
                    ls, ws, ns = (part.column(i).to_pylist() for i in range(3))
                    weight = np.zeros((len(ws), k))
                    weight[np.arange(len(ws)), [where[x] for x in ls]] = ns
                    total += model.expected(ws, weight)
            at, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(lang, pa.int64()), pa.array(total[at, lang])], names=["piece", "lang", "n"])

        got = words.mapInArrow(expect, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        new = np.full(table.shape, 0.01)
        new[got["piece"], got["lang"]] += got["n"]
        table = new / new.sum(0)
    return langs, table


def predict(docs: DataFrame, pieces: list[str], langs: list[str], table: np.ndarray, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``lang_pred`` (string) and ``score`` (double, 0 to 1: the posterior under equal priors).

    Texts stream through Arrow batches without a shuffle; the table is bounded by vocabulary and languages.
    """
    names = keep if keep is not None else [c for c in docs.columns if c != text_col]
    fields = [f for f in docs.schema.fields if f.name in names and f.name.lower() not in ("lang_pred", "score")]
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shipped = docs.sparkSession.sparkContext.broadcast((pieces, langs, table))
    n = len(fields)

    def run(batches):
        pieces, langs, table = shipped.value
        model = Unigrams(pieces, table) if langs else None
        index: dict[str, int] = {}
        logs = np.zeros((0, len(langs)))
        for whole in batches:
            for part in slices(whole, "__text", 4 << 20):
                split = [words_of(t or "") for t in part.column(n).to_pylist()]
                labels, scores = [UNKNOWN] * len(split), [0.0] * len(split)
                if model is not None:
                    new = set().union(*split).difference(index)
                    if len(index) + len(new) > CACHE_WORDS and index:
                        index, logs, new = {}, logs[:0], set().union(*split)
                    fresh = sorted(new)
                    index.update(zip(fresh, range(len(index), len(index) + len(fresh))))
                    if fresh:
                        logs = np.concatenate([logs, model.log_prob(fresh)])
                    for k, ws in enumerate(split):
                        if ws:
                            total = logs[np.fromiter(map(index.__getitem__, ws), np.int64, len(ws))].sum(0)
                            odds = np.exp(total - total.max())
                            best = int(total.argmax())
                            labels[k], scores[k] = langs[best], float(odds[best] / odds.sum())
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return docs.select(*[F.col(f"`{f.name}`") for f in fields], F.col(f"`{text_col}`").alias("__text")).mapInArrow(run, schema)
