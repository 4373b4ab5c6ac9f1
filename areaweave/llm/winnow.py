"""Document fingerprints by winnowing, in DataFrame operations only.

A text is cut into tokens (runs without white space, long runs in stretches of 16). Every k-gram of tokens is hashed;
from each window of w consecutive hashes the least is chosen, the rightmost of equals, and its position is kept. Two
texts that share k + w - 1 tokens in a row share at least one chosen hash; a shared run shorter than k shares none.

Hashes and windows are built by doubling (a gram of four from two grams of two, a window of sixteen from two of
eight), so a text of n tokens takes O(n) steps in one row and nothing is exploded or shuffled.

Defined cases: null text is an empty text. An empty text has an empty fingerprint; a text of fewer than k tokens has
the hash of all its tokens; fewer than w grams form one window. Two empty fingerprints have likeness 1, an empty and
another 0. Equal texts have equal fingerprints. Hashes have 32 bits and positions 31, as many as an array has places, so
texts of any length follow one rule. An empty table gives an empty table. Extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areaweave.llm._common import text_or_empty

#: Tokens in a gram, and grams in a window; both powers of two.
GRAM, WINDOW = 4, 16
_POSITION_BITS = 31
_HASH_MASK = (1 << 32) - 1
_TOP = (1 << _POSITION_BITS) - 1


def _pairs(a: Column, step: int, f) -> Column:
    """Combine each element with the one ``step`` places on."""
    n = F.greatest(F.size(a) - step, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(1 + step), n), f)


def fingerprint(df: DataFrame, text_col: str, out: str, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Add ``out``: array<bigint> of chosen grams, in order, hash in the upper bits and position in the lower."""
    tmp = f"__{out}"
    df = df.withColumn(tmp, F.transform(F.regexp_extract_all(text_or_empty(text_col), F.lit(r"\S{1,16}"), F.lit(0)), lambda t: F.xxhash64(t)))
    step = 1
    short = F.when(F.size(tmp) == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(F.col(tmp))))
    df = df.withColumn(f"{tmp}s", F.when(F.size(tmp) < gram, short))
    while step < gram:
        df = df.withColumn(tmp, _pairs(F.col(tmp), step, lambda a, b: F.xxhash64(a, b)))
        step *= 2
    packed = lambda h, i: F.shiftleft(h.bitwiseAND(F.lit(_HASH_MASK)), _POSITION_BITS).bitwiseOR(F.lit(_TOP).cast("long") - i)
    df = df.withColumn(tmp, F.transform(F.coalesce(F.col(f"{tmp}s"), F.col(tmp)), packed)).drop(f"{tmp}s")
    # fewer grams than a window: all of them are one window
    df = df.withColumn(f"{tmp}s", F.when((F.size(tmp) > 0) & (F.size(tmp) < window), F.array(F.array_min(tmp))))
    step = 1
    while step < window:
        df = df.withColumn(tmp, _pairs(F.col(tmp), step, lambda a, b: F.least(a, b)))
        step *= 2
    return df.withColumn(out, F.array_distinct(F.coalesce(F.col(f"{tmp}s"), F.col(tmp)))).drop(tmp, f"{tmp}s")


def hashes(fp: Column) -> Column:
    """The distinct hashes of a fingerprint, without positions."""
    return F.array_distinct(F.transform(fp, lambda v: F.shiftright(v, _POSITION_BITS)))


def printed(fp: Column) -> Column:
    """A fingerprint as text: ``hash:position`` of each chosen gram, joined by commas."""
    return F.array_join(F.transform(fp, lambda v: F.concat(F.lower(F.hex(F.shiftright(v, _POSITION_BITS))), F.lit(":"), (F.lit(_TOP) - v.bitwiseAND(F.lit(_TOP))).cast("string"))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two sets of hashes, 0 to 1."""
    both = F.size(F.array_intersect(a, b))
    all_ = F.size(a) + F.size(b) - both
    return F.when(all_ == 0, F.lit(1.0)).otherwise(both / F.greatest(all_, F.lit(1)))


#: Bits of an id that tell rows of a block apart, and further bits that each level of blocks takes.
_LEVELS = (6, 18, 30, 42, 54)


def _followers(blocks: DataFrame) -> DataFrame:
    """``b, nb``: for each block (ids without their last bits) the next one that exists; after the last, the first.

    Within a group of at most 4,096 blocks a window finds the next; the last of a group takes the first block of the next
    group, which is found in the same way one level up. At the top at most 1,024 groups are left, so no window holds more.
    """
    names = [f"g{k}" for k in range(len(_LEVELS))]
    nodes = blocks.select(F.col("b").alias("g0"), F.col("b").alias("first"))
    tables = []
    for k in range(1, len(_LEVELS)):
        tables.append(nodes.withColumn(names[k], F.shiftright(names[k - 1], _LEVELS[k] - _LEVELS[k - 1])))
        nodes = tables[-1].groupBy(names[k]).agg(F.min("first").alias("first"))
    top = Window.orderBy(names[-1])
    after = nodes.withColumn("after", F.coalesce(F.lead("first").over(top), F.min("first").over(top.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))).select(names[-1], "after")
    for k in range(len(_LEVELS) - 2, -1, -1):
        inside = tables[k].withColumn("next", F.lead("first").over(Window.partitionBy(names[k + 1]).orderBy(names[k])))
        after = inside.join(after, names[k + 1]).select(names[k], F.coalesce("next", "after").alias("after"))
    return after.select(F.col("g0").alias("b"), F.col("after").alias("nb"))


def with_next(df: DataFrame, id_col: str, carried: list[str], order: list[str]) -> DataFrame:
    """Add ``next_<c>`` for each carried column: its value in the next row by ascending id; after the last, the first.

    Ids are dealt in blocks of 64 consecutive values, so the rows move once and no task holds more than its blocks,
    however far apart the ids lie. The last row of a block takes its follower from a table of first rows (one for each
    block). A row without an id has no place in the order and no next row. Rows of equal id follow each other by
    ``order``. Names of the input that clash with ``next_<c>`` are replaced.
    """
    # flat columns of our own names: nothing clashes, and no text is copied for the window
    kept = [c for c in df.columns if c not in {f"next_{x}" for x in carried}]
    own = {c: f"in_{k}" for k, c in enumerate(kept)}
    block = F.shiftright(F.col(f"`{id_col}`").cast("long"), _LEVELS[0])
    lone = F.concat(F.lit("x"), F.xxhash64(*[F.col(f"`{c}`") for c in order]).cast("string"))
    rows = df.select(*[F.col(f"`{c}`").alias(own[c]) for c in kept], block.alias("block"), F.coalesce(block.cast("string"), lone).alias("key"))
    w = Window.partitionBy("key").orderBy(own[id_col], *[own[c] for c in order])
    first = rows.withColumn("first", F.row_number().over(w) == 1).where("first and block is not null").select(F.col("block").alias("of"), *[F.col(own[c]).alias(f"first_{own[c]}") for c in carried])
    rows = rows.select("*", F.lead(F.lit(True)).over(w).alias("has"), *[F.lead(own[c]).over(w).alias(f"after_{own[c]}") for c in carried])
    blocks = df.where(F.col(f"`{id_col}`").isNotNull()).select(block.alias("b")).distinct()
    follow = _followers(blocks).join(first, F.col("nb") == F.col("of")).drop("nb", "of").withColumn("b", F.col("b").cast("string"))
    rows = rows.join(follow, F.col("key") == F.col("b"), "left")
    after = lambda c: F.when(F.col("has"), F.col(f"after_{own[c]}")).when(F.col("block").isNotNull(), F.col(f"first_{own[c]}"))
    return rows.select(*[F.col(own[c]).alias(c) for c in kept], *[after(c).alias(f"next_{c}") for c in carried])


def edited(text: Column, following: Column) -> Column:
    """A text whose last floor(n/2) code points give way to the first as many of the following text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(F.coalesce(following, F.lit("")), F.lit(1), half))
