"""Quality selection by ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered thresholds cut the line it projects a
text onto: ``P(grade <= k) = sigmoid(threshold_k - w.x)``. The model yields the expected grade and the tail
probability ``P(grade >= k)``, by which documents are selected.

Rare grades weigh more while the weights are learnt. So that probabilities are those of the rated texts all the same,
slope and thresholds are fitted anew without such weights, on every fifth rated text and the line of a model that has
not seen these; the line at which the weighted model is undecided stays the one that selects, and is told as a
probability (``cut``).

Defined cases: null text is an empty text. Ratings with a null are left out; a document rated more than once has the
lowest of its grades. With no ratings, or only one grade among them, nothing can be learnt and every document is
kept with tail probability 1. Each row is scored on its own: repeated rows and ids keep their results, extra columns
go along, and result columns replace input columns of the same name. Texts of any length are read in full. An empty
table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaweave.llm._common import slices

#: Hashed feature space.
DIMENSIONS = 1 << 22
#: Rated documents the model is fitted on at most.
MAX_TRAIN = 6000
CACHE_WORDS = 300_000

_WORD = re.compile(r"\w+")
_SYMBOL = re.compile(r"[^\w\s.,;:!?'\"()-]")


def grades(labels: DataFrame, quality: str = "quality", toxic: str = "toxic", key: str = "doc_id") -> DataFrame:
    """``(doc_id, grade)`` of each rated document: 0 poor, 1 sound but toxic, 2 sound and clean."""
    grade = F.when(F.col(quality) <= 0, 0).when(F.col(toxic) > 0, 1).otherwise(2)
    rated = labels.where(F.col(key).isNotNull() & F.col(quality).isNotNull() & F.col(toxic).isNotNull())
    return rated.groupBy(F.col(key).alias("doc_id")).agg(F.min(grade).alias("grade"))


class Features:
    """Hashed presence of words, and of coarse shape figures, of a text."""

    def __init__(self):
        self.index: dict[str, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        words = _WORD.findall(text.lower())
        seen = Counter(words)
        new = [w for w in seen if w not in self.index]
        if len(self.index) + len(new) > CACHE_WORDS:
            self.index, new = {}, list(seen)
        self.index.update((w, 16 * 64 + zlib.crc32(w.encode()) % (DIMENSIONS - 16 * 64)) for w in new)
        out = list(map(self.index.__getitem__, seen))
        n, tokens = max(1, len(words)), max(1, len(text.split()))
        symbols = len(_SYMBOL.findall(text))
        lines = text.split("\n")
        shape = (
            20 * len(seen) / n,
            20 * max(seen.values(), default=0) / n,
            20 * min(1.0, symbols / tokens),
            20 * len(set(lines)) / max(1, len(lines)),
            2 * np.log2(n),
            20 * sum(a == b for a, b in zip(words, words[1:])) / n,
            20 * sum(c.isdigit() for c in text) / max(1, len(text)),
            20 * sum(c.isupper() for c in text) / max(1, len(text)),
            20 * min(1.0, text.count("|") / tokens),
            np.log2(len(text) + 1) if tokens == 1 else 0,
        )
        out += [64 * k + min(63, int(v)) for k, v in enumerate(shape)]
        return np.unique(np.array(out, np.int64))


class Ordinal:
    """Shared weights and ordered thresholds of a cumulative logistic link."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, cut: float = 0.5):
        self.weights, self.thresholds, self.cut = weights, thresholds, cut

    def line(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([float(self.weights[x].sum(dtype=np.float64)) for x in rows])

    def tails(self, line: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ...: a column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - line[:, None], -60, 60)))

    @classmethod
    def fit(cls, rows: list[np.ndarray], grade: np.ndarray, levels: int, rounds: int = 300, ridge: float = 0.5, rate: float = 0.1, least: int = 8, tied: float = 6.0) -> Ordinal:
        """Full-batch Adam on the penalised likelihood.

        A word gets a weight only if at least ``least`` texts hold it and its presence is tied to one of the cuts
        between grades by a score of ``tied`` standard deviations: hashed words are many and most say nothing.
        """
        flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        used, at = np.unique(flat, return_inverse=True)
        n, held = len(rows), np.bincount(at)
        enough, tie = held >= least, np.zeros(len(used), bool)
        for k in range(1, levels):
            above = (grade >= k).astype(float)
            rate_above = above.mean()
            spread = np.sqrt(np.maximum(held * (1 - held / n) * rate_above * (1 - rate_above), 1e-9))
            tie |= np.abs(np.bincount(at, above[owner]) - held * rate_above) >= tied * spread
        enough &= tie | (used < 16 * 64)
        place = np.cumsum(enough) - 1
        inside = enough[at]
        col, row, d = place[at[inside]], owner[inside], int(enough.sum())
        # rare grades weigh more by row, so that they are heard: held-out rows of rare grades are then told far better
        heavy = (1 / np.bincount(grade, minlength=levels).clip(1) ** 0.75)[grade]
        heavy *= n / heavy.sum()
        share = np.cumsum(np.bincount(grade, minlength=levels) + 1.0)[:-1] / (n + levels)
        cuts = np.log(share / (1 - share))
        step = np.log(np.maximum(np.diff(cuts), 1e-3))
        x = np.concatenate([np.zeros(d), cuts[:1], step])
        m, v = np.zeros_like(x), np.zeros_like(x)
        rows_at = np.arange(n)
        for k in range(1, rounds + 1):
            theta = x[d] + np.concatenate([[0], np.cumsum(np.exp(x[d + 1 :]))])
            line = np.bincount(row, x[:d][col], minlength=n)
            below = 1 / (1 + np.exp(-np.clip(theta[None, :] - line[:, None], -60, 60)))
            full = np.hstack([np.zeros((n, 1)), below, np.ones((n, 1))])
            slope = full * (1 - full)
            p = np.maximum(full[rows_at, grade + 1] - full[rows_at, grade], 1e-9)
            up, low = slope[rows_at, grade + 1] / p, slope[rows_at, grade] / p
            g_line = heavy * (up - low)
            g_theta = np.zeros((n, levels + 1))
            np.add.at(g_theta, (rows_at, grade + 1), -heavy * up)
            np.add.at(g_theta, (rows_at, grade), heavy * low)
            g_theta = g_theta[:, 1:-1].sum(0)
            g_step = np.cumsum(g_theta[::-1])[::-1]
            g = np.concatenate([np.bincount(col, g_line[row], minlength=d) + ridge * x[:d], g_step[:1], g_step[1:] * np.exp(x[d + 1 :])]) / n
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            x = x - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        weights = np.zeros(DIMENSIONS, np.float32)
        weights[used[enough]] = x[:d]
        return cls(weights, x[d] + np.concatenate([[0], np.cumsum(np.exp(x[d + 1 :]))]))


def ranked_fit(line: np.ndarray, grade: np.ndarray, levels: int, rounds: int = 400, rate: float = 0.05, hold: float = 1.0) -> tuple[float, np.ndarray]:
    """Slope and ordered thresholds of the link on a given line, each grade as frequent as it is.

    Every grade counts ``hold`` times more, spread over the line, so that one that is lacking does not run away.
    """
    line = np.concatenate([line, np.linspace(line.min(), line.max(), levels)])
    grade = np.concatenate([grade, np.arange(levels)])
    heavy = np.concatenate([np.ones(len(line) - levels), np.full(levels, hold)])
    spread = max(float(line.std()), 1e-6)
    z, n = (line - line.mean()) / spread, len(line)
    share = np.cumsum(np.bincount(grade, heavy, minlength=levels))[:-1] / heavy.sum()
    cuts = np.log(share / (1 - share))
    x = np.concatenate([[0.0], cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-3))])
    m, v, at = np.zeros_like(x), np.zeros_like(x), np.arange(n)
    for k in range(1, rounds + 1):
        slope = np.exp(x[0])
        theta = x[1] + np.concatenate([[0], np.cumsum(np.exp(x[2:]))])
        below = 1 / (1 + np.exp(-np.clip(theta[None, :] - slope * z[:, None], -60, 60)))
        full = np.hstack([np.zeros((n, 1)), below, np.ones((n, 1))])
        p = np.maximum(full[at, grade + 1] - full[at, grade], 1e-9)
        bend = full * (1 - full)
        up, low = heavy * bend[at, grade + 1] / p, heavy * bend[at, grade] / p
        g_theta = np.zeros((n, levels + 1))
        np.add.at(g_theta, (at, grade + 1), -up)
        np.add.at(g_theta, (at, grade), low)
        g_theta = g_theta[:, 1:-1].sum(0)
        tail = np.cumsum(g_theta[::-1])[::-1]
        g = np.concatenate([[((up - low) * z * slope).sum()], tail[:1], tail[1:] * np.exp(x[2:])]) / n
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    slope = np.exp(x[0]) / spread
    return float(slope), x[1] + np.concatenate([[0], np.cumsum(np.exp(x[2:]))]) + slope * line.mean()


def calibrated(model: Ordinal, part: Ordinal, rows: list[np.ndarray], grade: np.ndarray, levels: int) -> Ordinal:
    """The model with probabilities as frequent as the grades of ``rows``, and the same decisions.

    ``part`` was fitted without ``rows``: its line tells how sure a model of this kind may be.
    """
    slope, thresholds = ranked_fit(part.line(rows), grade, levels)
    thresholds = thresholds + slope * (model.thresholds[-1] - part.thresholds[-1])
    cut = 1 / (1 + np.exp(np.clip(thresholds[-1] - slope * model.thresholds[-1], -60, 60)))
    return Ordinal((model.weights * slope).astype(np.float32), thresholds, float(cut))


def fit(docs: DataFrame, rated: DataFrame, text_col: str = "text", max_train: int = MAX_TRAIN) -> Ordinal | None:
    """Fit on at most ``max_train`` rated documents, those of the least hash of their id.

    The sample of ids is bounded, hence broadcast to one scan of the documents; only its hashed features (whole
    texts are read) come to the driver, for as many different texts. ``docs`` needs ``doc_id`` and the text, ``rated``
    is the result of `grades`.
    """
    spark = docs.sparkSession
    picked = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = docs.select("doc_id", F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    # rows of one id may be many: each text counts once, and again no more than the bound
    rows = rows.groupBy(F.xxhash64("text").alias("__key")).agg(F.min("grade").alias("grade"), F.first("text").alias("text")).orderBy("__key").limit(max_train).select("grade", "text")

    def run(batches):
        features = Features()
        for b in batches:
            for part in slices(b, "text", 4 << 20):
                packed = [features(t).astype("<i4").tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary())], names=["grade", "x"])

    got = rows.mapInArrow(run, "grade int, x binary").collect()
    if len({r["grade"] for r in got}) < 2:
        return None
    # copies of a text count once, with its lowest grade; sorted, the same rows in any order give the same model
    lowest: dict[bytes, int] = {}
    for r in got:
        lowest[bytes(r["x"])] = min(r["grade"], lowest.get(bytes(r["x"]), r["grade"]))
    rows_x = sorted(lowest)
    grade = np.array([lowest[x] for x in rows_x])
    sets, levels = [np.frombuffer(x, "<i4").astype(np.int64) for x in rows_x], int(grade.max()) + 1
    aside = np.array([zlib.crc32(x) % 5 == 0 for x in rows_x])
    model = Ordinal.fit(sets, grade, levels)
    if len(set(grade[~aside])) < 2 or not aside.any():
        return model
    part = Ordinal.fit([x for x, a in zip(sets, aside) if not a], grade[~aside], levels)
    return calibrated(model, part, [x for x, a in zip(sets, aside) if a], grade[aside], levels)


def score(docs: DataFrame, model: Ordinal | None, text_col: str = "text", keep_col: str = "keep", at_least: float | None = None) -> DataFrame:
    """Add ``expected_grade``, ``p_top`` (tail probability of the best grade) and ``keep`` (``p_top >= at_least``).

    ``at_least`` is the model's own cut unless it is given. Only the texts go to Python, and only numbers come back.
    """
    others = [F.col(f"`{f.name}`") for f in docs.schema.fields if f.name.lower() not in ("expected_grade", "p_top", keep_col.lower())]
    if model is None:
        return docs.select(*others, F.lit(0.0).alias("expected_grade"), F.lit(1.0).alias("p_top"), F.lit(True).alias(keep_col))
    used = np.flatnonzero(model.weights)
    shipped = docs.sparkSession.sparkContext.broadcast((used, model.weights[used], model.thresholds))

    @F.arrow_udf("expected_grade double, p_top double")
    def told(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        used, weights, thresholds = shipped.value
        dense = np.zeros(DIMENSIONS, np.float32)
        dense[used] = weights
        own, features = Ordinal(dense, thresholds), Features()
        for column in columns:
            lines = [own.line([features(t.as_py() or "")]) for t in column]
            tails = own.tails(np.concatenate(lines) if lines else np.zeros(0))
            yield pa.StructArray.from_arrays([pa.array(tails.sum(1)), pa.array(tails[:, -1])], names=["expected_grade", "p_top"])

    # the column is named once more so that the text is scored once, whatever is asked of its result
    scored = docs.select(*others, told(F.col(f"`{text_col}`")).alias("__told"))
    return scored.select(*others, F.col("__told.expected_grade").alias("expected_grade"), F.col("__told.p_top").alias("p_top"), (F.col("__told.p_top") >= F.lit(model.cut if at_least is None else at_least)).alias(keep_col))
