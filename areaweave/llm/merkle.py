"""Merkle manifests of a table: digests of rows, of groups and of the whole, with a proof for every row.

Every row is a leaf. The leaves of a group stand in a given order, and while there are several nodes, every `ARITY`
consecutive ones become the digest of their digests. What remains is the group's subroot; the subroots, in the order of
their groups, make the root in the same way. A proof is the path from a leaf to the root: at each level the place of the
own node in its run and the digests of the others.

How it runs. Leaves get their rank by one sort over ranges of (group, order), whatever a group's size, and aligned blocks
of ``ARITY ** LEVELS`` ranks are the unit of work. On the way up, each block is folded into one node by a treehash
stack and the nodes are the leaves of the next round, 256 times fewer. On the way down, a block meets the path of its node, walks
its leaves in order and puts the block's part before the part that all its leaves share. The walk is a scheduled
traversal: each level holds the run of nodes that the current leaf is in, and a stack that builds the next run by one leaf
a step, so a path is there when its leaf comes up and, beside the block's own leaves, no more than ``2 * ARITY * LEVELS``
digests are held. Everything is written
between rounds, so a lost executor reads again and ranks don't change.

Defined cases: a null value counts as ``-``; a null group is a group of its own and comes first; rows of equal order
(repeated ids; nulls first) are told apart by their leaf, and rows equal in that too are interchangeable. An empty table gives
empty tables. A single row is its own subroot and root, with an empty proof. Other columns play no part, whatever their
names; very long values are hashed whole and don't leave the scan.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areaweave.llm._common import cut

#: Nodes of a run.
ARITY = 16
#: Levels that a block folds: ``ARITY ** LEVELS`` leaves are one task's unit.
LEVELS = 2
PATH = "array<struct<pos:int,others:string>>"
_PATH = pa.list_(pa.struct([("pos", pa.int32()), ("others", pa.string())]))


def digest(*values: Column) -> Column:
    """The leaf of some values: each as its length in bytes, ``:`` and itself, or ``-`` if it is null."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def node(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


class Treehash:
    """The nodes over leaves that come one by one; no level ever holds a whole run."""

    def __init__(self, levels: int, done: callable = lambda level, digest: None):
        self.stack: list[list[str]] = [[] for _ in range(levels + 1)]
        self.done = done

    def add(self, digest: str, level: int = 0) -> None:
        """Push a node; a run that is full becomes a node of the next level."""
        while True:
            self.done(level, digest)
            self.stack[level].append(digest)
            if level + 1 == len(self.stack) or len(self.stack[level]) < ARITY:
                return
            digest, level = node(self.stack[level]), level + 1
            self.stack[level - 1] = []

    def close(self) -> None:
        """Fold what is left of the last runs."""
        for level in range(len(self.stack) - 1):
            if rest := self.stack[level]:
                self.stack[level] = []
                self.add(node(rest), level + 1)


def levels_of(n: int, levels: int = LEVELS) -> int:
    """How many levels a block folds: all, unless its ``n`` nodes are all there are and need fewer."""
    h = 0
    while h < levels and ARITY**h < n:
        h += 1
    return h


def fold(leaves: list[str], levels: int) -> str:
    """The one node of a block."""
    tree = Treehash(levels)
    for x in leaves:
        tree.add(x)
    tree.close()
    return tree.stack[levels][0]


def paths(leaves: list[str], levels: int):
    """For each leaf in order: ``(place, digests of the others)`` by level, of the run that its node is in."""
    n = len(leaves)
    run = [[] for _ in range(levels)]  # at each level the run that the current leaf's node is in

    def keep(into: list[list[str]], level: int):
        def done(at: int, digest: str) -> None:
            if at == level and len(into[level]) < ARITY:
                into[level].append(digest)

        return done

    for level in range(levels):
        first = Treehash(levels, keep(run, level))
        for x in leaves[: ARITY ** (level + 1)]:
            first.add(x)
        first.close()
    ahead: list[list[str]] = [[] for _ in range(levels)]  # the runs after them, as far as they are built
    build = [Treehash(level, keep(ahead, level)) for level in range(levels)]
    for i in range(n):
        yield [(at := i // ARITY**level % ARITY, [*run[level][:at], *run[level][at + 1 :]]) for level in range(levels)]
        for level in range(levels):
            wide = ARITY ** (level + 1)
            nxt = (i // wide + 1) * wide + i % wide  # the leaf of the next run that stands where this one does in its own
            if nxt < n:
                build[level].add(leaves[nxt])
            if (i + 1) % wide == 0:
                build[level].close()
                run[level], ahead[level] = ahead[level], []
                build[level] = Treehash(level, keep(ahead, level))


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Add ``rank`` (from 0, within the group) and ``n`` (rows of the group); a group may span any number of partitions.

    ``rows`` has to be a written table: its rows are numbered to part equal ones.
    """
    by = [F.col(group).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order], F.col("__row")]
    dealt = rows.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("__row")
    placed = cut(dealt.withColumn("__at", F.monotonically_increasing_id()), "merkle-placed")
    placed = placed.withColumn("__part", F.shiftright("__at", 33))
    # one row for each partition and group: what the partitions before hold of it
    parts = placed.groupBy(group, "__part").agg(F.count("*").alias("__c"), F.min("__at").alias("__first"))
    whole, before = Window.partitionBy(group), Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(group, "__part", (F.coalesce(F.sum("__c").over(before), F.lit(0)) - F.col("__first")).alias("__shift"), F.sum("__c").over(whole).alias("n"))
    return placed.join(parts, [group, "__part"]).withColumn("rank", F.col("__at") + F.col("__shift")).drop("__at", "__part", "__shift")


def _up(nodes: DataFrame, levels: int) -> DataFrame:
    """The next round: one node for each block of ``nodes`` (g, rank, n, digest)."""
    size = ARITY**levels

    def one(key, table):
        table = table.sort_by("rank")
        n = table.column("n")[0].as_py()
        top = fold(table.column("digest").to_pylist(), levels_of(n, levels))
        return pa.table({"g": [key[0].as_py()], "rank": [key[1].as_py()], "n": [-(-n // size)], "digest": [top]}, schema=pa.schema([("g", pa.string()), ("rank", pa.int64()), ("n", pa.int64()), ("digest", pa.string())]))

    blocks = nodes.select("g", "rank", "n", "digest", F.floor(F.col("rank") / size).alias("block"))
    return blocks.groupBy("g", "block").applyInArrow(one, "g string, rank long, n long, digest string")


def climb(leaves: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """The tables of all rounds, ``leaves`` (g, rank, n, digest) first; the last has one node for each group."""
    tables = [leaves]
    left = leaves.agg(F.max("n")).first()[0] or 0
    while left > 1:
        tables.append(cut(_up(tables[-1], levels), "merkle-nodes"))
        left = -(-left // ARITY**levels)
    return tables


def _walker(own: list[str], shared: list[str], levels: int):
    """A block's rows and the one row above them to the rows with their paths."""

    def walk(key, below, above):
        below = below.sort_by("rank")
        n, rest = below.column("n")[0].as_py(), above.column("proof")[0].as_py()
        made = [[*({"pos": at, "others": "".join(others)} for at, others in path), *rest] for path in paths(below.column("digest").to_pylist(), levels_of(n, levels))]
        cols = {c: below.column(c) for c in ("g", "rank", *own)} | {"proof": pa.array(made, _PATH)}
        return pa.table(cols | {c: pa.array([above.column(c)[0].as_py()] * len(made), pa.string()) for c in shared})

    return walk


def descend(tables: list[DataFrame], tops: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The first table's rows with ``proof``, and with whatever else ``tops`` (g, proof, ...) has for their group."""
    shared = [c for c in tops.columns if c not in ("g", "proof")]
    top = tables[-1].join(tops, "g")
    for nodes in reversed(tables[:-1]):
        own = [c for c in nodes.columns if c not in ("g", "rank")]
        schema = nodes.schema

        kinds = ", ".join([f"`{c}` {schema[c].dataType.simpleString()}" for c in ("g", "rank", *own)] + [f"proof {PATH}"] + [f"`{c}` string" for c in shared])
        blocks = nodes.withColumn("block", F.floor(F.col("rank") / ARITY**levels))
        above = top.select("g", F.col("rank").alias("block"), "proof", *shared)
        top = blocks.groupBy("g", "block").cogroup(above.groupBy("g", "block")).applyInArrow(_walker(own, shared, levels), kinds)
    return top


def prove(rows: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``rows`` (name, source, order, leaf, ...) with ``rank``, ``subroot``, ``root`` and ``proof``.

    ``source`` is the group, ``order`` what its leaves ascend by; ``proof`` has a level in each element, from the
    leaf up through the subroot to the root.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))  # null first, then by UTF-8 bytes
    written = cut(rows.withColumn("g", key).withColumnRenamed("leaf", "digest"), "merkle-leaves")
    leaves = ranked(written, "g", ["order", "digest"])
    tables = climb(cut(leaves, "merkle-ranked"), levels)
    subroots = cut(tables[-1].select(F.lit("").alias("all"), F.col("g").alias("name"), "digest"), "merkle-subroots")
    upper = climb(cut(ranked(subroots, "all", ["name"]).withColumnRenamed("all", "g"), "merkle-sources"), levels)
    roots = upper[-1].select("g", F.array().cast(PATH).alias("proof"), F.col("digest").alias("root"))
    above = descend(upper, roots, levels).select(F.col("name").alias("g"), "proof", "root", F.col("digest").alias("subroot"))
    return descend(tables, above, levels).withColumnRenamed("digest", "leaf").drop("g", "n")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    level = lambda d, p: F.sha2(F.concat(F.substring(p["others"], F.lit(1), p["pos"] * 64), d, F.substring(p["others"], p["pos"] * 64 + 1, F.length(p["others"]))).cast("binary"), 256)
    return F.aggregate(proof, leaf, level)


def siblings(proof: Column) -> Column:
    """The digests of a proof, one after another."""
    return F.array_join(F.transform(proof, lambda p: p["others"]), "")


def manifest(proved: DataFrame) -> DataFrame:
    """``source, n, subroot, root``: what has to be kept to check any row or any source later."""
    return proved.groupBy("source").agg(F.count("*").alias("n"), F.first("subroot").alias("subroot"), F.first("root").alias("root"))
