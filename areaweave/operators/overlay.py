"""Overlaps of polygons: outlines are cut to the cells of a grid, cells are overlaid, and their areas summed.

A piece is what a polygon covers of one cell: the edges within it and, where the outline has left the cell, the cell's own
sides. Pieces of both tables meet by cell, so a large outline never travels as a whole, and a cell that a piece fills takes the
other's area without a look at its edges. What is left is the overlay of two short lists of edges, of which a batch holds
thousands: they are worked out together, not one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaweave.operators.spatial import with_edges

#: Edges that a strip of an overlay has, about; and numbers that a matrix in it may hold.
STRIP_EDGES, MOST_NUMBERS = 96, 1 << 20


def row_edges(boundaries: DataFrame, cell: float) -> DataFrame:
    """``code, cy, x1, y1, x2, y2``: edges cut at the lines between the grid's rows, upwards.

    Level edges bound no width at any height, so they are left out.
    """
    e = with_edges(boundaries).select("code", F.explode("edges").alias("e")).select("code", "e.*").where("y1 <> y2")
    up = F.col("y1") < F.col("y2")
    e = e.select("code", *[F.when(up, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in (("x1", "x2"), ("y1", "y2"))], *[F.when(up, F.col(b)).otherwise(F.col(a)).alias(b) for a, b in (("x1", "x2"), ("y1", "y2"))])
    step = F.lit(float(cell))
    e = e.withColumn("cy", F.explode(F.sequence(F.floor(F.col("y1") / step), F.greatest(F.ceil(F.col("y2") / step) - 1, F.floor(F.col("y1") / step)))))
    low, high = F.greatest(F.col("y1"), F.col("cy") * step), F.least(F.col("y2"), (F.col("cy") + 1) * step)
    at = lambda y: F.when(y == F.col("y1"), F.col("x1")).when(y == F.col("y2"), F.col("x2")).otherwise(F.col("x1") + (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / (F.col("y2") - F.col("y1")))
    return e.select("code", "cy", at(low).alias("x1"), low.alias("y1"), at(high).alias("x2"), high.alias("y2")).where("y1 < y2")


def counted(many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of these sizes in a row: the group of each member, and its place in it."""
    group = np.repeat(np.arange(len(many)), many)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(many) - many, many)


def odd_spans(owner: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The heights (n x 2) that an odd number of an owner's spans cover, by owner: all ends in order, two by two."""
    who, y = np.repeat(owner, 2), spans.reshape(-1)
    order = np.lexsort((y, who))
    who, spans = who[order][::2], y[order].reshape(-1, 2)
    kept = spans[:, 0] < spans[:, 1]
    return who[kept], spans[kept]


def cell_edges(e: np.ndarray, cell: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges cut at the lines between columns, the column of each, and the edge it is of."""
    x1, y1, x2, y2 = e.T
    left, right = np.minimum(x1, x2), np.maximum(x1, x2)
    first = np.floor(left / cell).astype(np.int64)
    k, column = counted(np.maximum(np.ceil(right / cell).astype(np.int64) - 1, first) - first + 1)
    column += first[k]

    def at(line):
        """Where the edge is at a column's line, or its end if it does not get there; alike from both sides."""
        x = np.clip(line * cell, left[k], right[k])
        with np.errstate(divide="ignore", invalid="ignore"):
            y = y1[k] + (y2[k] - y1[k]) * (x - x1[k]) / (x2[k] - x1[k])
        return x, np.where(x == x1[k], y1[k], np.where(x == x2[k], y2[k], np.clip(y, y1[k], y2[k])))

    (xa, ya), (xb, yb) = at(column), at(column + 1)
    upright = x1[k] == x2[k]
    ya, yb = np.where(upright, y1[k], ya), np.where(upright, y2[k], yb)
    turned = ya > yb
    cut = np.stack([np.where(turned, xb, xa), np.minimum(ya, yb), np.where(turned, xa, xb), np.maximum(ya, yb)], axis=1)
    return cut, column, k


def run_pieces(e: np.ndarray, run: np.ndarray, row: np.ndarray, cell: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``run, column, full, size, edges`` of the cells that many runs meet; a run is what a polygon has of one row of the grid.

    ``run`` numbers the run of each edge, ``row`` is the row of each run. The first cells of all runs are made together,
    then the second ones, and so on.
    """
    edges, column, k = cell_edges(e, cell)
    owner = run[k]
    order = np.lexsort((column, owner))
    edges, column, owner = edges[order], column[order], owner[order]
    start = np.flatnonzero(np.concatenate([[True], (column[1:] != column[:-1]) | (owner[1:] != owner[:-1])]))
    size = np.diff(np.append(start, len(edges)))
    column, owner = column[start], owner[start]  # from here on of cells that hold edges
    followed = np.append(owner[1:] == owner[:-1], False)
    gap = np.where(followed, np.append(column[1:], 0) - column - 1, 0)
    turn = counted(np.bincount(owner))[1]
    by_turn = np.argsort(turn, kind="stable")
    cells, sides = [], []  # (run, column, full) of cells; (cell, edges)
    made = 0

    def upright(x, spans):
        return np.stack([x, spans[:, 0], x, spans[:, 1]], axis=1)

    open_of, open_ = np.zeros(0, np.int64), np.zeros((0, 2))  # what of the line on the left of the next cell is inside, by run
    ends = np.cumsum(np.bincount(turn))
    for a, b in zip(np.concatenate([[0], ends[:-1]]), ends):
        now = by_turn[a:b]
        number = np.full(len(row), -1)  # of the cell that a run is at
        number[owner[now]] = np.arange(len(now))
        of, place = counted(size[now])
        inner = edges[start[now][of] + place]
        still = number[open_of] >= 0
        open_of, open_ = open_of[still], open_[still]
        after_of, after = odd_spans(np.concatenate([open_of, owner[now][of]]), np.concatenate([open_, inner[:, [1, 3]]]))
        left, right = number[open_of], number[after_of]
        cells.append((owner[now], column[now], np.zeros(len(now), bool)))
        sides += [(made + left, upright(column[now][left] * cell, open_)), (made + of, inner), (made + right, upright((column[now][right] + 1) * cell, after))]
        made += len(now)
        spans = np.bincount(right, minlength=len(now))
        whole = np.bincount(right[(after[:, 0] == row[after_of] * cell) & (after[:, 1] == (row[after_of] + 1) * cell)], minlength=len(now))
        at, place = counted(np.where(spans > 0, gap[now], 0))
        full = ((spans == 1) & (whole == 1))[at]
        between = column[now][at] + 1 + place
        cells.append((owner[now][at], between, full))
        first = np.searchsorted(right, np.arange(len(now)))
        which, place = counted(np.where(full, 0, spans[at]))
        span = after[first[at[which]] + place]
        sides += [(made + which, upright((between[which] + d) * cell, span)) for d in (0, 1)]
        made += len(at)
        open_of, open_ = after_of, after
    of, held = np.concatenate([c for c, _ in sides]), np.concatenate([x for _, x in sides])
    return (*(np.concatenate(x) for x in zip(*cells)), np.bincount(of, minlength=made), held[np.argsort(of, kind="stable")])


def _strip(a: np.ndarray, b: np.ndarray, low: float, high: float) -> float:
    """Area that both cover between two heights: no edges cross between neighbouring vertices and crossings."""
    ys = [np.array([low, high]), a[:, [1, 3]].ravel(), b[:, [1, 3]].ravel()]
    block = max(1, MOST_NUMBERS // max(1, len(b)))
    for k in range(0, len(a), block):
        ex, ey, edx, edy = (v[:, None] for v in (a[k : k + block, 0], a[k : k + block, 1], a[k : k + block, 2] - a[k : k + block, 0], a[k : k + block, 3] - a[k : k + block, 1]))
        fx, fy, fdx, fdy = (v[None, :] for v in (b[:, 0], b[:, 1], b[:, 2] - b[:, 0], b[:, 3] - b[:, 1]))
        det = edx * fdy - edy * fdx
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = ((fx - ex) * fdy - (fy - ey) * fdx) / det, ((fx - ex) * edy - (fy - ey) * edx) / det
        hit = (det != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
        ys.append((ey + np.where(hit, t, 0) * edy)[hit])
    y = np.unique(np.concatenate(ys))
    y = y[(y >= low) & (y <= high)]
    both = np.concatenate([a, b])
    of_a = np.arange(len(both)) < len(a)
    dx, dy = both[:, 2] - both[:, 0], both[:, 3] - both[:, 1]
    total, block = 0.0, max(1, MOST_NUMBERS // len(both))
    for k in range(0, len(y) - 1, block):
        y0, y1 = y[k : k + block + 1][:-1], y[k : k + block + 1][1:]
        mid = ((y0 + y1) / 2)[:, None]
        on = (both[None, :, 1] > mid) != (both[None, :, 3] > mid)
        with np.errstate(divide="ignore", invalid="ignore"):
            x = np.where(on, both[None, :, 0] + (mid - both[None, :, 1]) * dx / dy, np.inf)
        order = np.argsort(x, axis=1, kind="stable")
        x = np.take_along_axis(x, order, axis=1)
        ours = of_a[order]
        inside = (np.cumsum(ours, axis=1) % 2 == 1) & (np.cumsum(~ours, axis=1) % 2 == 1) & np.isfinite(x)
        after = np.concatenate([x[:, 1:], np.full((len(x), 1), np.inf)], axis=1)
        wide = np.where(inside & np.isfinite(after), after - np.where(np.isfinite(x), x, 0.0), 0.0).sum(axis=1)
        total += float((wide * (y1 - y0)).sum())
    return total


def overlap_area(a: np.ndarray, b: np.ndarray) -> float:
    """Area shared by two polygons given by edges (n x 4 arrays), by the even-odd rule.

    The heights both reach are cut into strips of about `STRIP_EDGES` vertices each, and only the edges of a strip meet.
    """
    if not len(a) or not len(b):
        return 0.0
    low, high = max(a[:, [1, 3]].min(), b[:, [1, 3]].min()), min(a[:, [1, 3]].max(), b[:, [1, 3]].max())
    if low >= high:
        return 0.0
    a, b = (e[(np.minimum(e[:, 1], e[:, 3]) < high) & (np.maximum(e[:, 1], e[:, 3]) > low)] for e in (a, b))
    y = np.sort(np.concatenate([a[:, 1], b[:, 1]]))
    y = y[(y > low) & (y < high)]
    lines = np.unique(np.concatenate([[low, high], y[STRIP_EDGES::STRIP_EDGES]]))
    total = 0.0
    for y0, y1 in zip(lines[:-1], lines[1:]):
        p, q = (e[(np.minimum(e[:, 1], e[:, 3]) < y1) & (np.maximum(e[:, 1], e[:, 3]) > y0)] for e in (a, b))
        if len(p) and len(q):
            total += _strip(p, q, y0, y1)
    return total


def overlap_areas(a: np.ndarray, many_a: np.ndarray, b: np.ndarray, many_b: np.ndarray) -> np.ndarray:
    """`overlap_area` of many pairs: all edges of one side and of the other in a row, and how many each pair has of them.

    Pairs of few edges are worked out together, as many as make `MOST_NUMBERS` numbers; others one by one in strips.
    """
    area = np.zeros(len(many_a))
    from_a, from_b = np.cumsum(many_a) - many_a, np.cumsum(many_b) - many_b
    some = np.flatnonzero((many_a > 0) & (many_b > 0))
    both = (many_a + many_b)[some]
    for k in some[both > STRIP_EDGES].tolist():
        area[k] = overlap_area(a[from_a[k] : from_a[k] + many_a[k]], b[from_b[k] : from_b[k] + many_b[k]])
    some, both = some[both <= STRIP_EDGES], both[both <= STRIP_EDGES]
    load = np.cumsum(3 * both**2) // MOST_NUMBERS
    for few in np.split(some, np.flatnonzero(load[1:] != load[:-1]) + 1):
        (of_a, place_a), (of_b, place_b) = counted(many_a[few]), counted(many_b[few])
        area[few] = _together(a[from_a[few][of_a] + place_a], of_a, b[from_b[few][of_b] + place_b], of_b, len(few))
    return area


def _together(a: np.ndarray, of_a: np.ndarray, b: np.ndarray, of_b: np.ndarray, n: int) -> np.ndarray:
    """Areas of ``n`` pairs that have edges on both sides, given with the number of their pair, in its order."""
    if not n:
        return np.zeros(0)

    def reach(e, of, least, k):
        at = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        return np.minimum.reduceat(np.minimum(e[:, k], e[:, k + 2]), at) if least else np.maximum.reduceat(np.maximum(e[:, k], e[:, k + 2]), at)

    left, low = (np.maximum(reach(a, of_a, True, k), reach(b, of_b, True, k)) for k in (0, 1))
    right, high = (np.minimum(reach(a, of_a, False, k), reach(b, of_b, False, k)) for k in (0, 1))
    meet = (left < right) & (low < high)

    def near(e, of):
        kept = meet[of] & (np.minimum(e[:, 1], e[:, 3]) < high[of]) & (np.maximum(e[:, 1], e[:, 3]) > low[of])
        return e[kept], of[kept]

    (a, of_a), (b, of_b) = near(a, of_a), near(b, of_b)
    many_a, many_b = np.bincount(of_a, minlength=n), np.bincount(of_b, minlength=n)
    # every edge of one side with every one of the other: where they cross
    of, place = counted(many_a * many_b)
    e, f = a[(np.cumsum(many_a) - many_a)[of] + place // many_b[of]], b[(np.cumsum(many_b) - many_b)[of] + place % many_b[of]]
    (ex, ey, edx, edy), (fx, fy, fdx, fdy) = ((v[:, 0], v[:, 1], v[:, 2] - v[:, 0], v[:, 3] - v[:, 1]) for v in (e, f))
    det = edx * fdy - edy * fdx
    with np.errstate(divide="ignore", invalid="ignore"):
        t, u = ((fx - ex) * fdy - (fy - ey) * fdx) / det, ((fx - ex) * edy - (fy - ey) * edx) / det
    hit = (det != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
    # strips between neighbouring vertices and crossings of a pair
    pair = np.concatenate([np.arange(n), np.arange(n), of_a, of_a, of_b, of_b, of[hit]])
    y = np.concatenate([low, high, a[:, 1], a[:, 3], b[:, 1], b[:, 3], ey[hit] + t[hit] * edy[hit]])
    kept = meet[pair] & (y >= low[pair]) & (y <= high[pair])
    pair, y = pair[kept], y[kept]
    order = np.lexsort((y, pair))
    pair, y = pair[order], y[order]
    strip = np.flatnonzero((pair[1:] == pair[:-1]) & (y[1:] > y[:-1]))
    pair, y0, y1 = pair[strip], y[strip], y[strip + 1]
    # the edges that a strip's middle meets, from left to right
    order = np.argsort(np.concatenate([of_a, of_b]), kind="stable")
    edges, ours = np.concatenate([a, b])[order], order < len(a)
    many = many_a + many_b
    s, place = counted(many[pair])
    k = (np.cumsum(many) - many)[pair][s] + place
    mid = ((y0 + y1) / 2)[s]
    on = (edges[k, 1] > mid) != (edges[k, 3] > mid)
    s, k, mid = s[on], k[on], mid[on]
    x1, v1, x2, v2 = edges[k].T
    x = x1 + (mid - v1) * (x2 - x1) / (v2 - v1)
    order = np.lexsort((x, s))
    s, x, ours = s[order], x[order], ours[k][order]
    first = np.searchsorted(s, s)
    odd = lambda m: (np.cumsum(m) - (np.cumsum(m) - m)[first]) % 2 == 1
    inside = np.flatnonzero((odd(ours) & odd(~ours))[:-1] & (s[1:] == s[:-1]))
    s, wide = s[inside], x[inside + 1] - x[inside]
    return np.bincount(pair[s], weights=wide * (y1 - y0)[s], minlength=n)


def pieces(boundaries: DataFrame, cell: float) -> DataFrame:
    """``code, cx, cy, full, edges``: what each polygon covers of each cell; edges are flat, four numbers each.

    The edges of a polygon in a row of the grid come one after another, and a task cuts all such runs of a batch together.
    """

    def changes(t):
        """Where a row's code or row of the grid is not that of the row before."""
        codes, rows = t.column("code").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(), t.column("cy").to_numpy()
        return np.flatnonzero((codes[1:] != codes[:-1]) | (rows[1:] != rows[:-1])) + 1

    def cut(t):
        """Cells of all runs of equal code and row."""
        start = np.concatenate([[0], changes(t)])
        run = counted(np.diff(np.append(start, t.num_rows)))[0]
        row = t.column("cy").to_numpy()[start]
        of, column, full, size, edges = run_pieces(np.stack([t.column(c).to_numpy() for c in ("x1", "y1", "x2", "y2")], axis=1), run, row, cell)
        ends = pa.array(np.concatenate([[0], np.cumsum(4 * size)]), pa.int32())
        codes = t.column("code").combine_chunks().take(pa.array(start[of]))
        found = [codes, pa.array(column, pa.int64()), pa.array(row[of], pa.int64()), pa.array(full), pa.ListArray.from_arrays(ends, pa.array(edges.ravel(), pa.float64()))]
        return pa.RecordBatch.from_arrays(found, names=["code", "cx", "cy", "full", "edges"])

    def run(batches):
        held = None  # a run may go on in the next batch
        for batch in batches:
            now = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if not now.num_rows:
                continue
            marks = changes(now)
            if len(marks):
                yield cut(now.slice(0, marks[-1]))
                now = now.slice(marks[-1])
            held = now
        if held is not None:
            yield cut(held)

    rows = row_edges(boundaries, cell).repartition("code", "cy").sortWithinPartitions("code", "cy")
    return rows.mapInArrow(run, "code string, cx long, cy long, full boolean, edges array<double>")


def overlaps(left: DataFrame, right: DataFrame, cell: float, least: float = 1.0) -> DataFrame:
    """``a_code, b_code, area`` of overlapping areas in plane coordinates; slivers below ``least`` are left out."""

    def sides(edges):
        """Whether a piece fills the cell, its number of edges, and all edges."""
        return edges.is_null().to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(edges), 0).to_numpy() // 4, edges.flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)

    def filled(full, many, edges, other, e):
        """The edges of one side where the other may fill the cell: there, the sides of what the first reaches."""
        alone = full & (other > 0)
        if not alone.any():
            return many, edges
        start = (np.cumsum(other) - other)[other > 0]
        reach = [(np.minimum if k < 2 else np.maximum).reduceat(f(e[:, k % 2], e[:, k % 2 + 2]), start) for k, f in ((0, np.minimum), (1, np.minimum), (2, np.maximum), (3, np.maximum))]
        x0, y0, x1, y1 = (r[alone[other > 0]] for r in reach)
        new = np.stack([x0, y0, x0, y1, x1, y0, x1, y1], axis=1).reshape(-1, 4)
        of = np.concatenate([counted(many)[0], np.repeat(np.flatnonzero(alone), 2)])
        return many + 2 * alone, np.concatenate([edges, new])[np.argsort(of, kind="stable")]

    @F.arrow_udf("double")
    def shared(a: pa.Array, b: pa.Array) -> pa.Array:
        (full_a, many_a, a), (full_b, many_b, b) = sides(a), sides(b)
        with_a, with_b = filled(full_a, many_a, a, many_b, b), filled(full_b, many_b, b, many_a, a)
        area = overlap_areas(with_a[1], with_a[0], with_b[1], with_b[0])
        return pa.array(np.where(full_a & full_b, cell * cell, area), pa.float64())

    a, b = (pieces(d, cell).select("cx", "cy", F.col("code").alias(f"{p}_code"), F.when(~F.col("full"), F.col("edges")).alias(f"{p}_edges")) for d, p in ((left, "a"), (right, "b")))
    met = a.join(b, ["cx", "cy"]).select("a_code", "b_code", shared("a_edges", "b_edges").alias("area"))
    return met.groupBy("a_code", "b_code").agg(F.sum("area").alias("area")).where((F.col("area") >= least) & (F.col("area") > 0))
