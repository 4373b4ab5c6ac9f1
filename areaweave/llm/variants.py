"""Spelling variants: words that differ by one code point, grouped by following each word to its most frequent form.

A word of ``m`` code points that differs from another in one place shares with it what stands before and after that place.
So for each place the prefix picks an interval of the words in forward order and the suffix an interval of the words in
reverse order, and the words in both intervals are the answer: a rectangle of points (forward rank, reverse rank), which a
wavelet tree reports. Words one longer are found in the same way, with prefix and suffix next to each other.

How it runs. An index holds words of one length. By the pigeonhole, two near words agree before or behind the middle, so
every word goes to the places that share its first half (to look for differences in the second) and those that share its
second half. A half that more than `CROWD` words share is dealt again, the zone where the difference may lie cut in two, until no
place is crowded: with a zone of one code point only that many words can meet as there are letters. Places are then dealt
to tasks by hash. Each pair is found exactly once (a doubled letter counts at its first place), and a task sends on one
row for each word it has met: how many near words there are, and the best. Chains of forms are followed by doubling, each
round a join of the words that are still on their way. All rounds are written, so a lost executor repeats one round.

Defined cases: a null text has no words; a null id counts as an empty one; words are compared by code points, so letters
that look alike are different; of forms with equal counts the first in code-point order wins; a word without near words is
its own root. Repeated rows count as often as they stand there. An empty table gives an empty table. Long texts are read
whole (a document is one array of runs); other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaweave.llm._common import cut

#: Entries of one shared part that are dealt to one place; a crowded place is cut in two again.
CROWD = 20_000
#: Entries of a task, about.
SHARD = 60_000
RUN = "([A-Za-zÀ-ÿ]+)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(text: Column) -> Column:
    """The maximal runs of letters, only A-Z lower-cased."""
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(RUN), F.lit(1))


def count(tokens: DataFrame, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """``word, n`` of the tokens (column ``word``) that are long and frequent enough."""
    tally = tokens.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return tally.where(F.col("n") >= least_count)


class Wavelet:
    """A permutation in a wavelet tree, level by level from the highest bit, for range reporting."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros, self.ranks = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (values >> level & 1).astype(bool)
            self.ranks.append(np.concatenate([[0], np.cumsum(~bit)]).astype(np.int64))  # zeros before a place
            self.zeros.append(int(self.ranks[-1][-1]))
            values = np.concatenate([values[~bit], values[bit]])  # the level below: zeros first, in order

    def report(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(rectangle, value)`` of all values in [c, d) at places in [a, b), for arrays of rectangles."""
        who, value = np.arange(len(a)), np.zeros(len(a), np.int64)
        for k, (zeros, rank) in enumerate(zip(self.zeros, self.ranks)):
            width = 1 << (self.bits - 1 - k)
            za, zb = rank[a], rank[b]
            halves = []
            for lo, hi, base in ((za, zb, value), (zeros + a - za, zeros + b - zb, value + width)):
                on = (lo < hi) & (base < d[who]) & (base + width > c[who])
                halves.append((who[on], lo[on], hi[on], base[on]))
            who, a, b, value = (np.concatenate(x) for x in zip(*halves))
        return who, value


def intervals(codes: np.ndarray, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of codes (short ones end in zeros): their order, and per row and length the interval of its prefix.

    Intervals are in ranks among the ``counted`` rows only, so ``[first, last)`` is empty if none of these has the prefix.
    """
    n, m = codes.shape
    order = np.lexsort(codes.T[::-1])
    row = codes[order]
    differs = np.ones((n, m), bool)
    differs[1:] = row[1:] != row[:-1]
    shared = np.where(differs.any(1), differs.argmax(1), m)  # letters shared with the row before
    shared[0] = -1
    lengths = np.arange(m + 1)
    opens = shared[:, None] < lengths[None, :]  # a prefix of this length starts anew here
    opens[0] = True
    at = np.arange(n)[:, None]
    first = np.maximum.accumulate(np.where(opens, at, 0), axis=0)
    closes = np.concatenate([opens[1:], np.ones((1, m + 1), bool)])
    last = np.minimum.accumulate(np.where(closes, at + 1, n)[::-1], axis=0)[::-1]
    rank = np.concatenate([[0], np.cumsum(counted[order])])
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    return back, rank[first], rank[last]


def _codes(words: list[str], m: int) -> np.ndarray:
    """A row of code points for each word, short ones with zeros at the end."""
    return np.array(words, dtype=f"<U{m}").view(np.uint32).reshape(len(words), m)


def near_pairs(words: list[str], lengths: np.ndarray, m: int, who: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``(asking, found)`` of places in ``words``, distinct words of length ``m`` (the index) and ``m - 1``.

    ``who`` asks for words of length ``m`` that differ from it at a place in ``[lo, hi)``.
    """
    codes = _codes(words, m)
    full = lengths == m
    flipped = codes[:, ::-1].copy()
    short = np.flatnonzero(~full)
    flipped[short] = np.concatenate([flipped[short, 1:], np.zeros((len(short), 1), np.uint32)], axis=1)
    ahead, f_first, f_last = intervals(codes, full)
    behind, r_first, r_last = intervals(flipped, full)
    named = np.flatnonzero(full)
    if not len(named) or not len(who):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    by_rank = named[np.argsort(ahead[named])]
    by_reverse = named[np.argsort(behind[named])]
    place = np.empty(len(words), np.int64)
    place[by_reverse] = np.arange(len(named))
    tree = Wavelet(place[by_rank])
    wide = (hi - lo).astype(np.int64)
    asks = np.repeat(who, wide)
    j = np.arange(int(wide.sum())) - np.repeat(np.cumsum(wide) - wide, wide) + np.repeat(lo, wide)
    x, y = ahead[asks], behind[asks]
    a, b, c, d = f_first[x, j], f_last[x, j], r_first[y, m - 1 - j], r_last[y, m - 1 - j]
    own = full[asks].astype(np.int64)  # a word of the index meets itself in its own rectangles
    on = (b - a > own) & (d - c > own)
    asks, j, a, b, c, d = (v[on] for v in (asks, j, a, b, c, d))
    hit, value = tree.report(a, b, c, d)
    asks, j, found = asks[hit], j[hit], by_reverse[value]
    # an inserted letter counts at the first place of its run
    same = ~full[asks] & (j > 0) & (codes[found, j] == codes[found, np.maximum(j - 1, 0)])
    on = (asks != found) & ~same
    return asks[on], found[on]


def _search(table: pa.Table) -> pa.Table:
    """One shard (word, n, m, lo, hi) to the near words of each word met: ``word, n_near, best_n, best``."""
    words = table.column("word").to_pylist()
    n, m, lo, hi = (table.column(c).to_numpy() for c in ("n", "m", "lo", "hi"))
    names = sorted(set(words))
    at_of = {w: k for k, w in enumerate(names)}
    where = np.array([at_of[w] for w in words], np.int64)
    count_of = np.zeros(len(names), np.int64)
    count_of[where] = n
    length = np.array([len(w) for w in names], np.int64)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for size in np.unique(m):
        on = m == size
        here, at = np.unique(where[on], return_inverse=True)
        a, b = near_pairs([names[k] for k in here], length[here], int(size), at, lo[on], hi[on])
        a, b = here[a], here[b]
        grown = length[a] < length[b]  # the shorter word is near to the longer one as well
        left += [a, b[grown]]
        right += [b, a[grown]]
    left, right = np.concatenate(left), np.concatenate(right)
    order = np.lexsort((right, -count_of[right], left))  # names are sorted, so the least place is the first word
    left, right = left[order], right[order]
    first = np.flatnonzero(np.concatenate([[True], left[1:] != left[:-1]])) if len(left) else np.zeros(0, np.int64)
    many = np.diff(np.concatenate([first, [len(left)]]))
    return pa.table({"word": [names[k] for k in left[first]], "n_near": many.astype(np.int64), "best_n": count_of[right[first]], "best": [names[k] for k in right[first]]}, schema=pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())]))


def _keyed(df: DataFrame) -> DataFrame:
    """Add what all words of a place share: the length of the index, the zone, and all letters outside of it."""
    after = F.length("word") - (F.col("m") - F.col("hi"))  # as many letters from the end as the index has behind the zone
    return df.withColumn("key", F.concat_ws("|", F.substring("word", F.lit(1), F.col("lo")), F.substring("word", after + 1, F.col("m") - F.col("hi"))))


def entries(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``word, n, m, lo, hi, key``: every word as an entry and as a question, in no crowded place."""
    size, spot = F.length("word"), ["m", "lo", "hi", "key"]
    both = words.withColumn("m", F.explode(F.array(size, size + 1)))
    half = F.floor(F.col("m") / 2).cast("int")
    zones = F.array(F.struct(half.alias("lo"), F.col("m").alias("hi")), F.struct(F.lit(0).alias("lo"), half.alias("hi")))
    left = _keyed(both.withColumn("z", F.explode(zones)).select("word", "n", "m", "z.lo", "z.hi"))
    done = None
    while True:
        left = cut(left, "variants-entries")
        crowded = cut(left.groupBy(*spot).agg(F.count("*").alias("__c")).where((F.col("__c") > crowd) & (F.col("hi") - F.col("lo") > 1)).drop("__c"), "variants-crowded")
        if crowded.isEmpty():
            return left if done is None else done.unionByName(left)
        calm = left.join(crowded, spot, "left_anti")
        done = calm if done is None else done.unionByName(calm)
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        parts = F.array(F.struct(F.col("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), F.col("hi")))
        left = _keyed(left.join(crowded, spot, "left_semi").withColumn("z", F.explode(parts)).select("word", "n", "m", "z.lo", "z.hi"))


def near(words: DataFrame, crowd: int = CROWD, shard: int = SHARD) -> DataFrame:
    """``word, n_near, best, best_n`` of the words (word, n) that have a near word."""
    all_entries = entries(words, crowd)
    shards = max(1, -(-all_entries.count() // shard))
    dealt = all_entries.withColumn("shard", F.pmod(F.xxhash64("m", "lo", "hi", "key"), F.lit(shards)))
    met = dealt.select("shard", "word", "n", "m", "lo", "hi").groupBy("shard").applyInArrow(_search, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("k"), F.col("best").alias("w")))
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.w").alias("best"), (-F.col("b.k")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: where each word (word, form) gets by following forms; forms never lead back."""
    going = cut(forms.select("word", F.col("form").alias("root")), "variants-going")
    while True:
        step = going.select(F.col("word").alias("root"), F.col("root").alias("next"))
        going = cut(going.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variants-roots")
        if going.where("moved").isEmpty():
            return going.select("word", "root")
        going = going.drop("moved")


def group(words: DataFrame, times: float = 2.0, crowd: int = CROWD, shard: int = SHARD) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of all ``words`` (word, n).

    The form is the most frequent near word, if it is at least ``times`` as frequent.
    """
    words = cut(words, "variants-words")
    found = near(words, crowd, shard)
    fits = F.col("best_n") >= F.lit(times) * F.col("n")
    rows = words.join(found, "word", "left").select("word", F.when(fits, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best_n")).alias("form_n"))
    rows = cut(rows, "variants-forms")
    ends = roots(rows.where("form is not null"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
