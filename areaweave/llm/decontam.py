"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

Fixed masks look at some of the tokens of a stretch and ignore the rest, so a substituted token under an ignored place
leaves the hash as it is. Test and training hashes are joined; around every hit the benchmark item is laid over the
text on the diagonal of the hit, and the tokens that agree are counted: a document leaks an item if some stretch of
``STRETCH`` tokens of the item (or the whole item, if shorter) agrees in at least ``AGREE`` of its places.

Only rows whose hashes meet a benchmark hash go on. The benchmark side is broadcast if its hashes are few enough
(their number is counted first), and otherwise joined by shuffle.

Defined cases: null text is an empty text. A short item is found anywhere in a text, by masks of its own length, and all
its tokens have to agree if it has three or fewer. Items without tokens match nothing. Very long texts are compared in full. An empty benchmark leaves every
document clean. Rows of equal id and text are decided alike; a document is named once for each item. Columns other than
id and text play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaweave.llm._common import cut, text_or_empty

#: Places that each mask looks at, by the length of an item (the greatest holds for all longer ones). Every way to
#: substitute as many tokens as ``AGREE`` allows leaves a place of some mask untouched; the tests enumerate them.
_LONG = ((0, 1, 2, 4), (0, 3, 4, 5))
MASKS = {
    1: ((0,),), 2: ((0, 1),), 3: ((0, 1, 2),), 4: ((0, 1, 2), (0, 1, 3), (0, 2, 3)), 5: ((0, 1, 2), (0, 1, 3)),
    6: ((0, 1, 2, 3), (0, 1, 3, 4)), 7: ((0, 1, 3, 4),), 8: (*_LONG, (0, 2, 5, 6)), 9: _LONG,
}
#: Tokens of an item that are compared at a time, and the share of them that has to agree.
STRETCH, AGREE = 13, 0.75
#: Benchmark hashes (16 bytes each) up to which they are sent to every executor.
BROADCAST_HASHES = 2_000_000


def token_hashes(text: Column) -> Column:
    """Hashes of the tokens of a text: runs of letters and digits, in lower case."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda t: F.xxhash64(t))


def _seed_array(h: Column, mask: tuple[int, ...]) -> Column:
    """The hash under a mask at every place of a text; none if the text is shorter than the mask."""
    n = F.size(h) - mask[-1]
    cut_ = lambda k: F.slice(h, F.lit(1 + k), F.greatest(n, F.lit(0)))
    out = cut_(mask[0])
    for k in mask[1:]:
        out = F.zip_with(out, cut_(k), lambda a, b: F.xxhash64(a, b))
    return out


def seeds(df: DataFrame, keys: list[str], h: str, masks: dict[tuple[int, ...], Column | None]) -> DataFrame:
    """``keys``, ``at``, ``seed``: a row for each place and mask; a mask may hold for some rows only."""
    none = F.array().cast("array<struct<at:int,seed:bigint>>")

    def placed(mask: tuple[int, ...], fits: Column | None) -> Column:
        tag = F.lit(",".join(map(str, mask)))
        made = F.transform(_seed_array(F.col(h), mask), lambda s, i: F.struct(i.alias("at"), F.xxhash64(s, tag).alias("seed")))
        return made if fits is None else F.when(fits, made).otherwise(none)

    every = F.concat(none, *[placed(m, fits) for m, fits in masks.items()])
    return df.select(*keys, F.explode(every).alias("x")).select(*keys, F.col("x.at").alias("at"), F.col("x.seed").alias("seed"))


def _holds(value: Column, test) -> Column:
    """``test`` of a value that is worked out once: the optimizer puts a plain column's expression wherever it is named."""
    return F.exists(F.array(value), test)


def _agrees(own: Column, item: Column, shift: Column) -> Column:
    """Whether an item, laid over a text from token ``shift`` on, agrees with it in some stretch."""
    laid = F.transform(item, lambda x, i: F.when(F.get(own, shift + i) == x, F.lit(1)).otherwise(F.lit(0)))
    size = F.least(F.size(item), F.lit(STRETCH))
    starts = F.sequence(F.lit(0), F.size(item) - size)
    total = lambda same, s: F.aggregate(F.slice(same, s + 1, size), F.lit(0), lambda a, b: a + b)
    return _holds(laid, lambda same: F.exists(starts, lambda s: total(same, s) >= F.ceil(size * AGREE)))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(doc_id, text_key, item_id)``: each document, by id and hash of its text, with each item it leaks."""
    items = benchmark.select(F.col(f"`{item_col}`").alias("item_id"), token_hashes(text_or_empty(f"`{item_text}`")).alias("item"))
    items = items.where(F.size("item") > 0).withColumn("item_key", F.xxhash64("item")).dropDuplicates(["item_id", "item_key"])
    # items of equal tokens are one item to the join
    bodies = items.select("item_key", "item").dropDuplicates(["item_key"])
    length = F.least(F.size("item"), F.lit(max(MASKS)))
    lengths = [r[0] for r in bodies.select(length).distinct().collect()]
    # documents are hashed only under the masks of lengths that the benchmark has
    used = sorted({m for n in lengths for m in MASKS[n]})
    fits = {m: length.isin([n for n in MASKS if m in MASKS[n]]) for m in used}
    # a hit of an item that has to agree in all its tokens is found anew wherever it stands: one place is enough
    whole = F.size("item") == F.ceil(F.size("item") * AGREE)
    probes = cut(seeds(bodies.withColumn("whole", whole), ["item_key", "whole"], "item", fits).withColumnRenamed("at", "item_at"), "benchmark-seeds")
    # all that would be sent is counted: places of masks (more than tokens), and ids, which may share their tokens
    small = max(probes.count(), items.count()) <= BROADCAST_HASHES
    sent = F.broadcast if small else (lambda df: df)

    keyed = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(f"`{text_col}`").alias("text"))
    keyed = keyed.withColumn("text_key", F.xxhash64("text"))
    own = keyed.withColumn("h", token_hashes(F.col("text")))
    hits = seeds(own, ["doc_id", "text_key"], "h", dict.fromkeys(used)).join(sent(probes), "seed")
    shift = F.col("at") - F.col("item_at")
    pairs = hits.groupBy("doc_id", "text_key", "item_key", F.when(~F.col("whole"), shift).alias("each")).agg(F.min(shift).alias("shift"))
    candidates = pairs.groupBy("doc_id", "text_key", "item_key").agg(F.collect_set("shift").alias("shifts"))
    # the texts of candidates are read again and laid under their items; by shuffle at every size, as candidates grow
    same = (candidates["doc_id"].eqNullSafe(keyed["doc_id"])) & (candidates["text_key"] == keyed["text_key"])
    laid = candidates.join(keyed.hint("merge"), same).select(candidates["doc_id"], candidates["text_key"], "item_key", "shifts", "text")
    laid = laid.join(sent(bodies), "item_key")
    found = laid.where(_holds(token_hashes(F.col("text")), lambda h: F.exists("shifts", lambda s: _agrees(h, F.col("item"), s)))).select("doc_id", "text_key", "item_key").distinct()
    return found.join(sent(items.select("item_id", "item_key")), "item_key").select("doc_id", "text_key", "item_id").distinct()


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that leak no item, with all their columns."""
    bad = leaks(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    same = F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (F.xxhash64(text_or_empty(f"`{text_col}`")) == F.col("__key"))
    return docs.hint("merge").join(bad, same, "left_anti")
