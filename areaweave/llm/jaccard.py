"""Jaccard self-join on word shingles: a MinHash LSH forest proposes, exact comparison decides.

Each distinct set of shingles has a label of ``DEPTH`` hashes for each of ``TREES`` trees. A tree is the sorted list of
its labels, and a prefix of a label is a node of its trie. A text starts at its longest prefix and shortens it until the
chance to meet a partner of the weakest similarity it can have reaches the target recall: a long text at the threshold
goes back to five hashes, a short one, whose possible similarities lie apart, stays deeper, and one that can equal
copies alone meets nobody. Two texts meet if their labels share, in some tree, the longer of their two prefixes.

Neighbours in the sorted lists that share the shortest prefix in use are linked, which brings what may meet to one place
(a gathering); each text's shingles move there once for each pair of blocks. There the tries are sorted again, pairs
that meet in a node are marked, once for all trees, and exactly those are compared, by counts of an inverted index.
Pairs never become rows: a text comes back with its number of links and its class.

Defined cases: words are runs without white space (space, tab to carriage return); a text of fewer than five words has
one shingle of all its words. Null, empty and blank texts have no shingles, no links, and a class of their own for
each row. Very long texts are hashed whole, by themselves. Rows of equal shingle sets are copies: they share a class,
and each counts the others as links. The class id is the least ``doc_id`` of the class, null ids last (a class of null
ids has a null id). An empty table gives an empty table. Columns other than id and text play no part.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaweave.llm._common import cut, salted_join, slices
from areaweave.llm._hash import MULTIPLIER, digest, mix, text_bytes, window_hashes, word_bounds, word_hashes

#: Words in a shingle, and the similarity from which two texts are linked.
SHINGLE, THRESHOLD = 5, 0.8
#: Trees of the forest, and hashes (16 bits each) of a label.
TREES, DEPTH = 24, 8
#: Chance that a pair of the weakest possible similarity meets in some tree.
RECALL = 0.9999
#: Texts of a gathering that are compared at a time.
BLOCK = 512
#: Tasks that the edges of one node are dealt to while gatherings are found.
PARTS = 64
#: Bytes of text that are hashed at a time.
SLICE_BYTES = 1 << 20


def prefix_depth(trees: int = TREES, depth: int = DEPTH, similarity: float = THRESHOLD, recall: float = RECALL) -> int:
    """The longest prefix with which the forest reaches the recall for pairs of a similarity."""
    while depth > 1 and 1 - (1 - similarity**depth) ** trees < recall:
        depth -= 1
    return depth


def weakest(size: int, threshold: float = THRESHOLD) -> float | None:
    """The least similarity, from the threshold on, of a set of so many shingles to another one; None if there is none."""
    if size > 100_000:  # steps between possible values are too small to matter
        return threshold
    found = None
    for union in range(size, int(size / threshold + 1e-9) + 1):
        both = max(0, int(np.ceil(threshold * union - 1e-9)))
        if both <= size and (both, union) != (size, size):
            found = min(found or 1.0, both / union)
    return found


def shingle_sets(column: pa.Array, size: int = SHINGLE):
    """The sorted distinct shingle hashes of each text of a column."""
    raw, offsets = text_bytes(column)
    starts, ends, first = word_bounds(raw, offsets)
    h = word_hashes(raw, starts, ends)
    grams = window_hashes(h, size)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            yield np.unique(grams[a : b - size + 1])
        elif b > a:
            yield mix(window_hashes(h[a:b], b - a) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * MULTIPLIER)
    return (x[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (x[n:] >> np.uint64(32)).astype(np.uint32)


def signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of the set under each of the hash functions ``a x + b``, in 32 bits."""
    low = (s >> np.uint64(32)).astype(np.uint32) ^ s.astype(np.uint32)
    least = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 2048):
        part = low[i : i + 2048]
        v = a[:, None] * part[None, :] + b[:, None]
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        np.minimum(least, v.min(axis=1), out=least)
    return least


def labels_of(m: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """A label for each tree: up to eight hashes of 16 bits, in two numbers whose order is that of the hashes."""
    short = (mix(m.astype(np.uint64)) >> np.uint64(48)).reshape(trees, depth)
    out = np.zeros((trees, 2), np.uint64)
    for d in range(depth):
        out[:, d // 4] |= short[:, d] << np.uint64(48 - 16 * (d % 4))
    # sorted as signed numbers elsewhere
    return (out ^ np.uint64(1 << 63)).view(np.int64)


_PLACE = pa.struct([("hi", pa.int64()), ("lo", pa.int64())])


def _sketch(trees: int, depth: int, threshold: float, recall: float):
    """Texts to a digest of their shingle set, its size, the depth of its prefixes, and a label for each tree."""

    def run(batches):
        a, b = _factors(trees * depth)
        depths: dict[int, int] = {}
        for whole in batches:
            for part in slices(whole, "text", SLICE_BYTES):
                keys, sizes, deep, labels = [], [], [], []
                for s in shingle_sets(part.column(2)):
                    n = len(s)
                    if n not in depths:
                        weak = weakest(n, threshold) if n else None
                        depths[n] = 0 if weak is None else prefix_depth(trees, depth, weak, recall)
                    keys.append(digest(s.tobytes()) if n else None), sizes.append(n), deep.append(depths[n])
                    labels.append(labels_of(signature(s, a, b), trees, depth) if depths[n] else np.zeros((0, 2), np.int64))
                flat = np.concatenate(labels) if labels else np.zeros((0, 2), np.int64)
                offsets = np.cumsum([0, *map(len, labels)]).astype(np.int32)
                places = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], fields=list(_PLACE))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:2], pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(deep, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), places)],
                    names=["doc_id", "text_key", "node", "size", "depth", "labels"],
                )

    return run


def common_prefix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many hashes two labels share from the front, from the differing bits of their halves."""
    x, y = x.view(np.uint64), y.view(np.uint64)
    same = lambda v: sum((v < np.uint64(1 << k)).astype(np.int8) for k in (48, 32, 16, 0))
    return np.where(x != 0, same(x), 4 + same(y))


def _neighbours(base: int):
    """Places in order of (tree, label) to edges from each run of neighbours that share ``base`` hashes to its first.

    The first and last place of a partition also come out without a partner, to be linked across partitions.
    """

    def run(batches):
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            tree, hi, lo = (b.column(k).to_numpy() for k in range(3))
            node = b.column(3).to_pylist()
            if last is not None:
                tree, hi, lo, node = np.append(last[0], tree), np.append(last[1], hi), np.append(last[2], lo), [last[3], *node]
            else:
                yield _edges([(node[0], None, int(tree[0]), int(hi[0]), int(lo[0]))])
            apart = np.ones(len(node), bool)
            apart[1:] = (tree[1:] != tree[:-1]) | (common_prefix(hi[1:] ^ hi[:-1], lo[1:] ^ lo[:-1]) < base)
            first = np.maximum.accumulate(np.where(apart, np.arange(len(node)), 0))
            yield _edges([(node[k], node[h], None, None, None) for k, h in enumerate(first.tolist()) if k != h])
            # what comes next is linked to the first of the run that is open
            last = tree[-1:], hi[-1:], lo[-1:], node[first[-1]]
            end = node[-1]
        if last is not None:
            yield _edges([(end, None, int(last[0][0]), int(last[1][0]), int(last[2][0]))])

    return run


def _edges(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 5
    kinds = (pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["u", "v", "tree", "hi", "lo"])


def forest_edges(texts: DataFrame, base: int) -> DataFrame:
    """``(u, v)``: texts linked so that all that share a node of ``base`` hashes in some tree hang together."""
    places = texts.select(F.posexplode("labels").alias("tree", "label"), "node").select(F.col("tree").cast("int").alias("tree"), "label.hi", "label.lo", "node")
    ordered = places.repartitionByRange("tree", "hi", "lo").sortWithinPartitions("tree", "hi", "lo")
    found = cut(ordered.mapInArrow(_neighbours(base), "u binary, v binary, tree int, hi long, lo long"), "join-neighbours")
    # a node cut by a border between partitions shows at the ends of each of them
    front = F.col("hi") if base >= 4 else F.shiftright("hi", 16 * (4 - base))
    rest = F.shiftright("lo", 16 * (8 - base)) if base > 4 else F.lit(0)
    ends = found.where("v is null").select("u", "tree", front.alias("f"), rest.alias("r"))
    heads = ends.groupBy("tree", "f", "r").agg(F.min("u").alias("v"))
    return found.where("v is not null").select("u", "v").unionByName(ends.join(heads, ["tree", "f", "r"]).select("u", "v"))


def meetings(hi: np.ndarray, lo: np.ndarray, depth: np.ndarray, base: int) -> np.ndarray:
    """Which pairs of texts meet in a node: ``hi`` and ``lo`` are labels by tree and text.

    In a sorted list, what two texts share is the least that neighbours between them share; the distance between them
    grows by one at a time, in all trees at once, until nothing is shared any more.
    """
    n = hi.shape[1]
    met = np.zeros((n, n), bool)
    order = np.lexsort((lo, hi), axis=-1)
    h, low = np.take_along_axis(hi, order, 1), np.take_along_axis(lo, order, 1)
    step = common_prefix(h[:, 1:] ^ h[:, :-1], low[:, 1:] ^ low[:, :-1])
    now, k = step, 1
    while now.shape[1] and (now >= base).any():
        a, b = order[:, : n - k], order[:, k:]
        hit = now >= np.maximum(depth[a], depth[b])
        met[a[hit], b[hit]] = True
        now = np.minimum(now[:, :-1], step[:, k:])
        k += 1
    return met | met.T


def _with_least(edges: DataFrame) -> DataFrame:
    """``edges (u, v)`` with the least ``v`` of each ``u`` as ``m``; the edges of one ``u`` are dealt to several tasks.

    The least is told from one row for each part of a node, and sent back to those parts that have edges.
    """
    dealt = edges.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(PARTS)).cast("int"))
    parts = dealt.groupBy("u", "s").agg(F.min("v").alias("m"))
    least = parts.groupBy("u").agg(F.min("m").alias("m"), F.collect_list("s").alias("of"))
    return dealt.join(least.select("u", F.explode("of").alias("s"), "m"), ["u", "s"]).select("u", "v", "m")


def gatherings(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of each node of ``edges (u, v)``: connected parts, by alternating shared-minimum steps.

    Every round joins each node's neighbours to the least of them (large star), then each node to the least below it
    (small star); degrees fall, and the rounds are few. Rounds are written to the shared folder.
    """
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "join-edges")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = large.where("u <> v").distinct()
        small = _with_least(large).select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = small.unionByName(large.groupBy("u").agg(F.min("v").alias("v")))
        new = cut(new.where("u <> v").distinct(), "join-edges")
        # a star forest: every node points to one root, and no root points on
        if new.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() == 0:
            if new.select("v").distinct().join(new.select(F.col("u").alias("r")), F.col("v") == F.col("r"), "left_semi").limit(1).count() == 0:
                return new.select(F.col("u").alias("node"), F.col("v").alias("root"))
        now = new


def shared_counts(sets: list[np.ndarray], left: int):
    """Counts of shared shingles: ``(i, counts against all sets)`` for each of the first ``left`` sets.

    Only shingles of two sets or more can be shared. Where they are few for the pairs that share them, the counts are
    a product of 0/1 matrices, taken in column blocks; otherwise each set looks up its shingles in an inverted index.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    _, group, degree = np.unique(flat, return_inverse=True, return_counts=True)
    common = degree[group] > 1
    group, owner = group[common], owner[common]
    used, group = np.unique(group, return_inverse=True)
    degree = degree[used]
    if n >= 64 and 5e-9 * float((degree.astype(float) ** 2).sum()) > 1e-10 * float(left) * n * len(used):
        total = np.zeros((left, n), np.float32)
        for k in range(0, len(used), 4096):
            inside = (group >= k) & (group < k + 4096)
            m = np.zeros((n, min(4096, len(used) - k)), np.float32)
            m[owner[inside], group[inside] - k] = 1
            total += m[:left] @ m.T
        for i in range(left):
            yield i, total[i].astype(np.int64)
        return
    order = np.argsort(group, kind="stable")
    posting, begin = owner[order], np.concatenate([[0], np.cumsum(degree)])
    first = np.searchsorted(owner, np.arange(n + 1))  # owners are in order
    for i in range(left):
        g = group[first[i] : first[i + 1]]
        spans = degree[g]
        at = np.arange(int(spans.sum())) + np.repeat(begin[g] - (np.cumsum(spans) - spans), spans)
        yield i, np.bincount(posting[at], minlength=n)


def count_links(sets: list[np.ndarray], weight: np.ndarray, left: int, threshold: float, met: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each set, weighted by copies, and the first set of the linked part each belongs to.

    Only pairs that have ``met`` are looked at. ``left`` < number of sets: two blocks, of which only pairs across are
    compared; otherwise all pairs.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    links, parent = np.zeros(n, np.int64), list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, shared in shared_counts(sets, left):
        shared[: max(i + 1, left if left < n else 0)] = 0
        near = np.flatnonzero((shared > 0) & met[i])
        near = near[shared[near] >= threshold * (sizes[i] + sizes[near] - shared[near]) - 1e-9]
        if len(near):
            links[i] += weight[near].sum()
            links[near] += weight[i]
            for j in near.tolist():
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return links, np.array([root(i) for i in range(n)])


def _compare(threshold: float, trees: int, base: int):
    """Rows sorted by (root, bi, bj, part) to ``(node, links, head, blocks)``: whole groups, one at a time."""

    def run(batches):
        def rows():
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns))

        out: list[tuple] = []
        for (_, bi, bj), group in itertools.groupby(rows(), key=lambda r: r[:3]):
            nodes, parts, weights, sets, depths, signs, seen = [], [], [], [], [], [], set()
            for _, _, _, part, node, copies, depth, sign, packed, blocks in group:
                if node not in seen:
                    seen.add(node), nodes.append(node), parts.append(part), weights.append(copies), depths.append(depth)
                    sets.append(np.frombuffer(packed, np.uint64)), signs.append(np.frombuffer(sign, np.int64))
            left = len(nodes) if bi == bj else sum(p == bi for p in parts)
            if 0 < left and len(nodes) > 1 and (bi == bj or left < len(nodes)):
                both = np.stack(signs).reshape(len(nodes), trees, 2)
                met = meetings(np.ascontiguousarray(both[:, :, 0].T), np.ascontiguousarray(both[:, :, 1].T), np.array(depths), base)
                links, head = count_links(sets, np.array(weights, np.int64), left, threshold, met)
                out += [(nodes[k], int(links[k]), nodes[int(head[k])], blocks) for k in np.flatnonzero(links).tolist()]
            if len(out) > 10_000:
                yield _packed(out)
                out = []
        yield _packed(out)

    return run


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 4
    kinds = (pa.binary(), pa.int64(), pa.binary(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["node", "links", "head", "blocks"])


def _first(id_col: str = "doc_id") -> list:
    """What a row is ordered by in its class: rows without an id come last."""
    return [F.col(id_col).isNull().alias("lacks"), F.col(id_col).alias("doc_id"), F.col("text_key").alias("text_key")]


def classes(docs: DataFrame, id_col: str, text_col: str, threshold: float, trees: int, depth: int, recall: float, block: int) -> DataFrame:
    """``doc_id, text_key, node, head (of the class: lacks, doc_id, text_key), n_links`` of every row; blank rows have no node."""
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    source = source.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    rows = cut(source.mapInArrow(_sketch(trees, depth, threshold, recall), "doc_id long, text_key long, node binary, size long, depth int, labels array<struct<hi:long,lo:long>>"), "join-sketches")
    # equal shingle sets are one text; its first row brings its shingles
    texts = rows.where("node is not null").groupBy("node").agg(
        F.count("*").alias("copies"), F.min(F.struct(*_first())).alias("first"), F.first("size").alias("size"), F.first("depth").alias("depth"), F.first("labels").alias("labels")
    )
    texts = cut(texts, "join-texts")
    base = prefix_depth(trees, depth, threshold, recall)
    met = gatherings(forest_edges(texts.where("depth > 0"), base))
    member = met.unionByName(met.select(F.col("root").alias("node"), "root").distinct()).join(texts, "node")
    # a gathering is cut into blocks of about ``block`` texts, or as many shingles as such a block usually has
    blocks = member.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("size") / (block * 500))).cast("int").alias("blocks"), F.count("*").alias("members"))
    dealt = salted_join(member, blocks, ["root"], "members", F.xxhash64("node")).withColumn("part", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int"))
    # joined by shuffle at every size: the members grow with the corpus
    brought = source.hint("merge").join(
        dealt.select("root", "blocks", "part", "node", "copies", "depth", "labels", F.col("first.doc_id").alias("id"), F.col("first.text_key").alias("key")),
        F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")),
    )

    def shingled(batches):
        for whole in batches:
            for part in slices(whole, "text", SLICE_BYTES):
                packed = [s.tobytes() for s in shingle_sets(part.column(7))]
                signs = [np.array([(x["hi"], x["lo"]) for x in row], np.int64).tobytes() for row in part.column(6).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:6], pa.array(signs, pa.binary()), pa.array(packed, pa.binary())], names=["root", "blocks", "part", "node", "copies", "depth", "sign", "shingles"])

    sets = brought.select("root", "blocks", "part", "node", "copies", "depth", "labels", "text").mapInArrow(shingled, "root binary, blocks int, part int, node binary, copies long, depth int, sign binary, shingles binary")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("part")).alias("bi"), F.greatest(o, F.col("part")).alias("bj")))
    spread = sets.select("root", "blocks", F.explode(pairs).alias("b"), "part", "node", "copies", "depth", "sign", "shingles").select("root", "b.bi", "b.bj", "part", "node", "copies", "depth", "sign", "shingles", "blocks")
    # within a pair of blocks, those of the first come first
    grouped = spread.repartition("root", "bi", "bj").sortWithinPartitions("root", "bi", "bj", "part", "node")
    compared = cut(grouped.mapInArrow(_compare(threshold, trees, base), "node binary, links long, head binary, blocks int"), "join-links")

    links = compared.groupBy("node").agg(F.sum("links").alias("links"))
    single = compared.where("blocks = 1").select("node", "head")
    across = compared.where("blocks > 1").select(F.col("node").alias("u"), F.col("head").alias("v")).where("u <> v")
    joined = gatherings(across)
    found = single.unionByName(joined.select("node", F.col("root").alias("head")))
    named = texts.select("node", "copies", "first").join(found, "node", "left").join(links, "node", "left")
    named = named.withColumn("of", F.coalesce("head", "node")).drop("head")
    firsts = named.groupBy("of").agg(F.min("first").alias("head"), F.count("*").alias("members"))
    named = salted_join(named, firsts, ["of"], "members", F.xxhash64("node")).select(F.col("node").alias("__node"), "head", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    # rows without shingles meet nothing
    keyed = rows.select("doc_id", "text_key", "node")
    return keyed.join(named, F.col("node") == F.col("__node"), "left").drop("__node")


def join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    trees: int = TREES,
    depth: int = DEPTH,
    recall: float = RECALL,
    block: int = BLOCK,
) -> DataFrame:
    """``(doc_id, class_id, n_links)``: for each document its class (what links connect) and its number of links."""
    out = classes(docs, id_col, text_col, threshold, trees, depth, recall, block)
    return out.select("doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row of each class, with all its columns: that of least id (null ids last), then text; blank rows all stay.

    A row is told by its id and its text, so texts that share an id are told apart. Of rows that share both, the one whose
    other columns (those that can be ordered) come first stays, nulls before all.
    """
    found = classes(docs, id_col, text_col, threshold, trees, depth, recall, block)
    heads = found.where("node is not null").select("head.*").distinct()
    heads = heads.select(F.col("lacks").alias("__lacks"), F.coalesce("doc_id", F.lit(0)).alias("__id"), F.col("text_key").alias("__key"))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    blank = ~text.rlike(r"[^\x20\x09-\x0D]")
    own = docs.where(~blank).withColumn("__lacks", F.col(f"`{id_col}`").isNull()).withColumn("__id", F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(0))).withColumn("__key", F.xxhash64(text))
    keys = ["__lacks", "__id", "__key"]
    rest = [c for c in docs.columns if c != text_col]
    plain = [c for c, kind in docs.dtypes if c != text_col and not kind.startswith(("map", "variant"))]
    least = F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*[F.col(f"`{c}`") for c in plain])).alias("__row")
    kept = own.hint("merge").join(heads, keys, "left_semi").groupBy(*keys).agg(F.first(f"`{text_col}`").alias("__text"), least)
    kept = kept.select(*[F.col("__text").alias(c) if c == text_col else F.col("__row")[c].alias(c) for c in docs.columns])
    return docs.where(blank).unionByName(kept)
