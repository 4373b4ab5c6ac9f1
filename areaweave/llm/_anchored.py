"""Which strings of a fixed length occur again, found without moving every string.

Of the grams in a string the one of least hash is its anchor, and equal strings have equal anchors at equal places. The
symbols of all strings in a row that share an anchor are its context. What is sent for each distinct context of a block
is the hash of its gram and a digest of 128 bits; then

* a gram that occurs once: none of its strings repeats;
* equal contexts, wherever they are: all their strings repeat, and nothing has to be compared;
* one gram, different contexts: one of each kind goes on, with its bytes, and is dealt by gram so that all places where
  a string may stand meet. A solver (the caller's) finds what repeats among the contexts of a task.

A gram with more kinds of contexts than one task takes is dealt again by longer cores: the strings that start within a
few places of each other share all but those few symbols, so the shared core is the new key. Contexts equal over such a
stretch are settled at once, and at a stretch of one place the core is the string. All rounds do the same at any size.

Blocks count each of their contexts once, so a text that a third of all rows hold is one row for each block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaweave.llm import _blocks
from areaweave.llm._common import cut, salted_join
from areaweave.llm._hash import digest, least_places

#: Symbols that are looked at in one go; a longer text is taken in steps of this many starts.
STEP = 1 << 20
#: Different contexts under one key that one task compares; more are dealt by longer cores.
KINDS = 500
ITEM = "key binary, block long, start int, span int, rel int, whole boolean, bytes binary"
RANGE = "block long, first int, last int"


def steps(offsets: np.ndarray, length: int, step: int = STEP) -> Iterator[tuple[int, int, np.ndarray]]:
    """``(begin, end, starts)``: stretches of symbols with the starts of strings to find in them.

    Short texts go together; a long text is cut at places counted from its own start, so copies are cut alike.
    """
    d, n = 0, len(offsets) - 1
    while d < n:
        e = max(d + 1, int(np.searchsorted(offsets, offsets[d] + step, side="right")) - 1)
        if e == d + 1 and offsets[e] - offsets[d] > step:
            usable = int(offsets[e] - offsets[d]) - length + 1
            for a in range(0, max(usable, 0), step):
                b = min(a + step, usable)
                base = int(offsets[d]) + a
                yield base, base + (b - a) + length - 1, np.arange(b - a)
        else:
            own = offsets[d : e + 1] - offsets[d]
            usable = np.maximum(np.diff(own) - length + 1, 0)
            total = int(usable.sum())
            if total:
                yield int(offsets[d]), int(offsets[e]), np.arange(total) + np.repeat(own[:-1] - (np.cumsum(usable) - usable), usable)
        d = e


def anchors(offsets: np.ndarray, length: int, gram: int, hashes: Callable[[int, int], np.ndarray], step: int = STEP) -> Iterator[tuple[np.ndarray, ...]]:
    """For each stretch: first and last starts, gram hashes, and anchor places, in symbols of the block.

    ``hashes(begin, end)`` gives the gram hashes of a stretch.
    """
    for begin, end, start in steps(offsets, length, step):
        h = hashes(begin, end)
        place = least_places(h, length - gram + 1)[start]
        fresh = np.ones(len(start), bool)
        fresh[1:] = (place[1:] != place[:-1]) | (np.diff(start) != 1)
        p = place[fresh]
        yield start[fresh] + begin, start[np.append(fresh[1:], True)] + begin, h[p], p + begin


def send(length: int, gram: int, view: Callable, places: bool, step: int = STEP):
    """Blocks to ``g, c1, c2, block, rel, span, n, at``: a row for each distinct context of a block.

    ``view(raw, offsets)`` gives the gram hashes of a stretch, and the bytes of symbols a to b. ``n`` counts the
    occurrences in the block, ``at`` holds their first starts (the first only, unless ``places``).
    """

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                block, _, raw, offsets = _blocks.unpack(b, i)
                hashes, cut_out = view(raw, offsets)
                seen: dict[bytes, list] = {}
                for lo, hi, g, p in anchors(offsets, length, gram, hashes, step):
                    for x, y, own, q in zip(lo.tolist(), hi.tolist(), g.view(np.int64).tolist(), p.tolist()):
                        c = digest(cut_out(x, y + length) + (q - x).to_bytes(4, "little"))
                        known = seen.get(c)
                        if known is None:
                            seen[c] = [own, x - q, y - x, 1, [x]]
                        else:
                            known[3] += 1
                            if places:
                                known[4].append(x)
                both = np.frombuffer(b"".join(seen), "<i8").reshape(-1, 2)
                kinds, columns = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32())), list(zip(*seen.values())) or [()] * 5
                g, rel, span, n, at = (pa.array(v, k) for v, k in zip(columns, kinds))
                yield pa.RecordBatch.from_arrays([g, pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(np.full(len(seen), block, np.int64)), rel, span, n, at], names=["g", "c1", "c2", "block", "rel", "span", "n", "at"])

    return run, "g long, c1 long, c2 long, block long, rel int, span int, n int, at array<int>"


def known_contexts(sent: DataFrame) -> DataFrame:
    """The contexts that matter: ``whole`` ones (they occur again) and those that ``stand`` for their kind in a sort."""
    every = cut(sent, "anchors")
    # no group is heavy: sums and extremes are taken before anything moves
    grams = every.groupBy("g").agg(F.sum("n").alias("total"), F.count("*").alias("rows"), (F.min("c1") != F.max("c1")).alias("mixed")).where("total > 1").drop("total")
    again = cut(salted_join(every, grams, ["g"], "rows", F.col("c1")).drop("rows"), "anchors-again")
    contexts = again.groupBy("c1", "c2").agg(F.sum("n").alias("total"), F.min("block").alias("one"), F.count("*").alias("rows"))
    # a context that every block holds is dealt by block
    told = salted_join(again, contexts, ["c1", "c2"], "rows", F.col("block"))
    told = told.select("block", "g", "rel", "span", "at", (F.col("total") > 1).alias("whole"), (F.col("mixed") & (F.col("one") == F.col("block"))).alias("stands"))
    return cut(told.where("whole or stands"), "anchors-known")


def _by_block(blocks: DataFrame, rows: DataFrame, columns: list[str], name: str) -> DataFrame:
    listed = rows.groupBy(F.col("block").alias("__of")).agg(F.collect_list(F.struct(*columns)).alias(name))
    return blocks.join(listed, F.col("block") == F.col("__of"), "left").drop("__of")


def _items(length: int, view: Callable):
    """Contexts that stand for their kind, with their bytes; the key is the gram."""

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index("told")
            for i in range(b.num_rows):
                told = b.column(at)[i].as_py()
                if not told:
                    continue
                block, _, raw, offsets = _blocks.unpack(b, i)
                _, cut_out = view(raw, offsets)
                rows = [(t["g"].to_bytes(8, "little", signed=True), block, t["at"][0], t["span"], t["rel"], t["whole"], cut_out(t["at"][0], t["at"][0] + t["span"] + length)) for t in told]
                yield _rows(rows)

    return run


_KINDS = (pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
_NAMES = ["key", "block", "start", "span", "rel", "whole", "bytes"]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS)], names=_NAMES)


def _solved(solve: Callable, size: int):
    """Items in order of their keys to runs of starts of repeated strings; whole groups, as many as fit in ``size`` bytes."""

    def settled(rows):
        out: list[tuple[int, int, int]] = []
        for r, at in zip(rows, solve([r[6] for r in rows], np.array([r[5] for r in rows]), [r[0] for r in rows])):
            if len(at):
                cuts = np.flatnonzero(np.diff(at) != 1)
                for x, y in zip(np.append(at[0], at[cuts + 1]).tolist(), np.append(at[cuts], at[-1]).tolist()):
                    out.append((r[1], r[2] + x, r[2] + y))
        columns = list(zip(*out)) if out else [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int32()))], names=["block", "first", "last"])

    def run(batches):
        held: list[tuple] = []
        total = 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held and total > size and row[0] != held[-1][0]:
                    yield settled(held)
                    held, total = [], 0
                held.append(row)
                total += len(row[6])
        if held:
            yield settled(held)

    return run


def _cells(length: int, width: int, symbols: Callable):
    """Items cut at every ``width`` places before their gram: the key is the core that all strings of a cell share."""

    def run(batches):
        for b in batches:
            out = []
            for _, block, start, span, rel, whole, data in zip(*(c.to_pylist() for c in b.columns)):
                piece = symbols(data)
                for q in range(rel // width, (rel + span) // width + 1):
                    a, z = max(0, q * width - rel), min(span, (q + 1) * width - 1 - rel)
                    core = piece((q + 1) * width - 1 - rel, q * width + length - rel)
                    key = digest(core + q.to_bytes(4, "little", signed=True))
                    out.append((key, block, start + a, z - a, rel + a, whole, piece(a, z + length)))
            yield _rows(out)

    return run


def find(blocks: DataFrame, known: DataFrame, length: int, view: Callable, symbols: Callable, solve: Callable, widths: tuple[int, ...], size: int, kinds: int = KINDS) -> DataFrame:
    """``block, first, last``: runs of starts of strings that repeat among different contexts.

    ``symbols(data)`` gives the bytes of symbols a to b of a context, ``solve(contexts, whole, keys)`` the starts that
    repeat in each; a context that is ``whole`` repeats whatever else is there.
    """
    told = _by_block(blocks, known.where("stands"), ["g", "rel", "span", "at", "whole"], "told").where("told is not null")
    items = cut(told.mapInArrow(_items(length, view), ITEM), "anchor-contexts")
    found = []
    for width in (*widths, None):
        crowded = cut(items.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > kinds).select("key"), "anchor-crowded")
        fits = items if width is None else items.join(crowded, "key", "left_anti")
        dealt = fits.repartition("key").sortWithinPartitions("key", "block", "start")
        found.append(cut(dealt.mapInArrow(_solved(solve, size), RANGE), "anchor-ranges"))
        if width is None or not crowded.limit(1).count():
            break
        cells = cut(items.join(crowded, "key", "left_semi").select(*_NAMES).mapInArrow(_cells(length, width, symbols), ITEM), "anchor-cells").withColumn("same", F.sha2(F.concat(F.col("bytes"), F.col("rel").cast("string").cast("binary")), 256))
        # stretches that are equal repeat as a whole; one of each kind goes on
        alike = cells.groupBy("key", "same").agg(F.count("*").alias("n"), F.max("whole").alias("any"), F.min(F.struct("block", "start")).alias("one"))
        both = salted_join(cells.drop("whole"), alike, ["key", "same"], "n", F.xxhash64("block", "start"))
        both = cut(both.withColumn("whole", (F.col("n") > 1) | F.col("any")), "anchor-alike")
        found.append(both.where("whole").select("block", F.col("start").alias("first"), (F.col("start") + F.col("span")).alias("last")))
        ones = both.where((F.col("one.block") == F.col("block")) & (F.col("one.start") == F.col("start")))
        shared = ones.groupBy("key").agg(F.count("*").alias("__n")).where("__n > 1")
        items = cut(ones.join(shared, "key").select(*_NAMES), "anchor-contexts")
    return reduce(DataFrame.unionByName, found)


def told(blocks: DataFrame, known: DataFrame, ranges: DataFrame) -> DataFrame:
    """The blocks with ``whole`` (starts and spans of contexts that repeat) and ``ranges`` (runs of starts that do)."""
    out = _by_block(blocks, known.where("whole"), ["at", "span"], "whole")
    return _by_block(out, ranges, ["first", "last"], "ranges")
