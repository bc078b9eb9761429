"""Polygons near each other: exact distances behind an adaptive grid.

A polygon is an array of rings (the outer one first, then its holes), a ring an array of points [x, y], closed or not.
Two polygons are near if they touch, cross, contain one another or come within `buffer`; one that lies in a hole of
another is as far from it as the hole's edge.

The plane is cut into cells that follow the data: a cell with more than PER_CELL polygons is cut into sixteen, until it
has fewer, is as fine as half the buffer, or holds polygons so wide that they would come to COPIES of the pieces each, so
a dense town costs cells and not the square of its size. Polygons meet in the cells that their boxes cover with half the
buffer around them, and a pair counts in the cell that holds the lower corner of what the boxes share, so it comes once.
Cells that stay crowded are dealt in blocks, so that a task compares PER_CELL polygons with PER_CELL others at once.

Rows without rings, with a ring of under three points, or with a coordinate that is missing or not finite, are near
nothing. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.operators.components import components
from terrane.sources.storage import stored

PER_CELL = 4096
COPIES = 4
AT_ONCE = 1 << 15  # pairs of edges compared in one step; arrays of a quarter MB stay in a core's cache
SMALL, TOGETHER = 64, 1 << 13  # polygons of one ring whose edges make no more pairs are compared side by side, so many pairs of polygons in one step
PAIRS, LINKED = 1 << 15, 1 << 11  # pairs of polygons compared in one step, where all count and where those linked by then are left out
BOXES = 1 << 16  # pairs of boxes looked at in one step
A_TASK, MOST_TASKS = 1 << 25, 1 << 14  # pairs of boxes that a task looks at, some seconds of work, and how many tasks there may be
LEFT, RIGHT, BOTH = 0, 1, 2
BLOCK = ["group", "size", "cx", "cy", "block_left", "block_right"]


class Space:
    """Arrays to write to, by name, in memory that is asked for once: new pages for every step cost a third of the time of what is computed in them."""

    def __init__(self) -> None:
        self.kept: dict[str, np.ndarray] = {}

    def __call__(self, name: str, *shape: int, of: type = np.float64) -> np.ndarray:
        size = math.prod(shape)
        if name not in self.kept or self.kept[name].size < size:
            self.kept[name] = np.empty(size, of)
        return self.kept[name][:size].reshape(shape)


class Shapes:
    """The polygons of an Arrow table's rings, with all edges in one array: x0, y0, x1, y1.

    box holds the bounds of x and y, turned those of x + y and x - y.
    """

    def __init__(self, rings: pa.ChunkedArray) -> None:
        points, n_rings = pc.list_flatten(rings), _lengths(rings)
        n_points = _lengths(points)
        xy = pc.list_flatten(points)
        n_xy = _lengths(xy)
        flat = pc.list_flatten(xy).to_numpy().astype(np.float64)
        at = np.cumsum(n_xy) - n_xy
        x, y = flat[at], flat[at + 1]
        last = np.cumsum(n_points) - 1
        after = np.arange(1, len(x) + 1)
        after[last] = last - n_points + 1
        self.x, self.y, self.edges = x, y, np.stack([x, y, x[after], y[after]], axis=1)
        self.n = np.add.reduceat(n_points, np.cumsum(n_rings) - n_rings) if len(n_rings) else n_points
        self.first = np.cumsum(self.n) - self.n
        self.single, self.space = n_rings == 1, Space()
        bound = lambda f, c: f.reduceat(c, self.first) if len(self.n) else c
        bounds = lambda x, y: np.stack([bound(np.minimum, x), bound(np.minimum, y), bound(np.maximum, x), bound(np.maximum, y)], axis=1)
        self.box, self.turned = bounds(x, y), bounds(x + y, x - y)

    def corners(self, of: np.ndarray, side: str) -> tuple[np.ndarray, ...]:
        """x and y of the points of polygons of one ring and the same number of points, the first again at the end; dx and dy of their edges."""
        n, at = int(self.n[of[0]]), self.first[of]
        x, y = self.space(side + "x", n + 1, len(of)), self.space(side + "y", n + 1, len(of))
        for k in range(n + 1):
            of_k = at + k % n
            np.take(self.x, of_k, out=x[k], mode="clip")
            np.take(self.y, of_k, out=y[k], mode="clip")
        return x, y, np.subtract(x[1:], x[:-1], out=self.space(side + "dx", n, len(of))), np.subtract(y[1:], y[:-1], out=self.space(side + "dy", n, len(of)))

    def holds(self, of: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether polygon of[k] holds the point (x[k], y[k]): an odd number of edges lie to its right."""
        inside = np.zeros(len(of), bool)
        for rows, e in _spread(self.n[of], self.first[of]):
            x0, y0, x1, y1 = self.edges[e].T
            px, py = x[rows], y[rows]
            spans = (y0 > py) != (y1 > py)
            cross = spans & (px < x0 + (py - y0) * (x1 - x0) / np.where(spans, y1 - y0, 1.0))
            np.logical_xor.at(inside, rows[cross], True)
        return inside


def _lengths(a) -> np.ndarray:
    return np.asarray(pc.list_value_length(a)).astype(np.int64)


def _spread(n: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and, for each, the n[row] numbers from first[row] on; about AT_ONCE at a time."""
    upto, k = np.cumsum(n), 0
    while k < len(n):
        stop = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + AT_ONCE, "right")))
        rows = np.repeat(np.arange(k, stop), n[k:stop])
        starts = np.cumsum(n[k:stop]) - n[k:stop]
        yield rows, np.arange(len(rows)) - np.repeat(starts - first[k:stop], n[k:stop])
        k = stop


def _span(x0, y0, x1, y1):
    """dx, dy and the squared length of segments, 1 for those without any."""
    dx, dy = x1 - x0, y1 - y0
    long = dx * dx + dy * dy
    return dx, dy, np.where(long > 0, long, 1.0)


def _to_segment(px, py, x0, y0, x1, y1, span=None, space=None):
    """Squared distance of points to segments."""
    dx, dy, long = span or _span(x0, y0, x1, y1)
    space = space or Space()
    t, u = space("t", *dx.shape), space("u", *dx.shape)
    np.subtract(px, x0, out=t)
    t *= dx
    np.subtract(py, y0, out=u)
    u *= dy
    t += u
    t /= long
    np.clip(t, 0.0, 1.0, out=t)
    np.multiply(t, dx, out=u)
    u += x0
    np.subtract(px, u, out=u)
    u *= u
    t *= dy
    t += y0
    np.subtract(py, t, out=t)
    t *= t
    u += t
    return u


def _turn(ax, ay, bx, by, cx, cy):
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether segments cross."""
    (ax, ay, bx, by), (cx, cy, dx, dy) = a.T, b.T
    return (_turn(ax, ay, bx, by, cx, cy) * _turn(ax, ay, bx, by, dx, dy) < 0) & (_turn(cx, cy, dx, dy, ax, ay) * _turn(cx, cy, dx, dy, bx, by) < 0)


def _ends(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distance of segments that do not cross."""
    (ax, ay, bx, by), (cx, cy, dx, dy) = a.T, b.T
    return np.minimum(np.minimum(_to_segment(ax, ay, *b.T), _to_segment(bx, by, *b.T)), np.minimum(_to_segment(cx, cy, *a.T), _to_segment(dx, dy, *a.T)))


def distances(shapes: Shapes, i: np.ndarray, j: np.ndarray, buffer: float) -> np.ndarray:
    """The distance of polygons i[k] and j[k]; infinity where it is more than buffer."""
    out = np.empty(len(i))
    n, m = shapes.n[i], shapes.n[j]
    kind = np.where(shapes.single[i] & shapes.single[j] & (n * m <= SMALL), n * (SMALL + 1) + m, 0)
    for of in np.unique(kind):
        (at,) = np.nonzero(kind == of)
        step, compared = (TOGETHER, _side_by_side) if of else (len(at), _edge_by_edge)
        for k in range(0, len(at), step):
            some = at[k : k + step]
            out[some] = compared(shapes, i[some], j[some], buffer)
    return out


def _side_by_side(shapes: Shapes, i: np.ndarray, j: np.ndarray, buffer: float) -> np.ndarray:
    """distances of polygons of one ring; all i have the same number of points, and all j: arrays are of points (or edges) and pairs."""
    space = shapes.space
    a, b = shapes.corners(i, "a"), shapes.corners(j, "b")
    crossed = _crossed(a, b, space)
    out = np.zeros(len(i))
    (open_,) = np.nonzero(~crossed)  # of pairs whose edges cross nothing more is asked
    a, b = (tuple(np.take(c, open_, axis=1, out=space(f"open{side}{k}", len(c), len(open_)), mode="clip") for k, c in enumerate(of)) for side, of in (("a", a), ("b", b)))
    best = np.sqrt(np.minimum(_to_edges(*a[:2], b, space), _to_edges(*b[:2], a, space)))
    held = (best > 0) & (_inside(a[0][0], a[1][0], b, space) | _inside(b[0][0], b[1][0], a, space))  # edges do not meet, so one holds a point of the other if it holds any
    out[open_] = np.where(held, 0.0, np.where(best <= buffer, best, np.inf))
    return out


def _crossed(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], space: Space) -> np.ndarray:
    """Whether edges of the polygons of each pair cross: _cross, where the turns to a point serve both of its edges."""
    (ax, ay, adx, ady), (bx, by, bdx, bdy) = a, b
    more, edges = bx.shape, bdx.shape
    crossed, some = np.zeros(edges[1], bool), space("some", *edges)
    own, straddles, other = space("own", *more), space("straddles", *edges, of=bool), space("other", *edges, of=bool)
    for k in range(len(ax)):
        dx, dy = np.subtract(bx, ax[k], out=space(f"dx{k % 2}", *more)), np.subtract(by, ay[k], out=space(f"dy{k % 2}", *more))
        turn = np.multiply(bdy, dx[:-1], out=space(f"turn{k % 2}", *edges))  # of the other's edges to this point
        turn -= np.multiply(bdx, dy[:-1], out=some)
        if k:
            np.multiply(adx[k - 1], old_dy, out=own)  # of the edge that ends here to the other's points
            own -= np.multiply(ady[k - 1], old_dx, out=old_dx)
            np.less(np.multiply(own[:-1], own[1:], out=some), 0, out=straddles)
            straddles &= np.less(np.multiply(before, turn, out=before), 0, out=other)
            crossed |= straddles.any(axis=0)
        before, old_dx, old_dy = turn, dx, dy
    return crossed


def _to_edges(px: np.ndarray, py: np.ndarray, of: tuple[np.ndarray, ...], space: Space) -> np.ndarray:
    """The least squared distance of the points of one polygon to the edges of another, for each pair."""
    x, y = of[:2]
    segments = x[:-1], y[:-1], x[1:], y[1:]
    span, best = _span(*segments), np.full(px.shape[1], np.inf)
    for qx, qy in zip(px[:-1], py[:-1], strict=True):
        np.minimum(best, _to_segment(qx, qy, *segments, span, space).min(axis=0), out=best)
    return best


def _inside(px: np.ndarray, py: np.ndarray, of: tuple[np.ndarray, ...], space: Space) -> np.ndarray:
    """Whether the polygon of each pair holds the point: an odd number of edges lie to its right."""
    x, y, dx, dy = of
    above = y > py
    spans = above[:-1] != above[1:]
    at = np.subtract(py, y[:-1], out=space("t", *dx.shape))
    at *= dx
    np.divide(at, dy, out=at, where=spans)
    at += x[:-1]
    spans &= px < at
    return np.logical_xor.reduce(spans)


def _edge_by_edge(shapes: Shapes, i: np.ndarray, j: np.ndarray, buffer: float) -> np.ndarray:
    """distances of polygons of any edges, which are compared only where they come near the other polygon's box."""
    best = np.full(len(i), np.inf)
    for rows, e in _spread(shapes.n[i], shapes.first[i]):  # edges of i that come near the box of j
        edge, box = shapes.edges[e], shapes.box[j[rows]]
        near = (np.minimum(edge[:, 0], edge[:, 2]) <= box[:, 2] + buffer) & (np.maximum(edge[:, 0], edge[:, 2]) >= box[:, 0] - buffer)
        near &= (np.minimum(edge[:, 1], edge[:, 3]) <= box[:, 3] + buffer) & (np.maximum(edge[:, 1], edge[:, 3]) >= box[:, 1] - buffer)
        rows, e = rows[near], e[near]
        for k, other in _spread(shapes.n[j[rows]], shapes.first[j[rows]]):
            pair, a, b = rows[k], shapes.edges[e[k]], shapes.edges[other]
            best[pair[_cross(a, b)]] = 0.0
            open_ = np.flatnonzero(best[pair] > 0)  # of pairs that are known to cross nothing more is asked
            np.minimum.at(best, pair[open_], _ends(a[open_], b[open_]))
    out = np.sqrt(best)
    apart = np.flatnonzero(out > 0)  # their edges do not meet, so one holds a point of the other if it holds any
    xi, yi = shapes.edges[shapes.first[i[apart]], :2].T
    xj, yj = shapes.edges[shapes.first[j[apart]], :2].T
    out[apart] = np.where(shapes.holds(j[apart], xi, yi) | shapes.holds(i[apart], xj, yj), 0.0, np.where(out[apart] <= buffer, out[apart], np.inf))
    return out


def _usable(rings: Column) -> Column:
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    point = lambda p: (F.size(p) >= 2) & finite(F.get(p, F.lit(0))) & finite(F.get(p, F.lit(1)))
    return F.coalesce((F.size(rings) > 0) & F.forall(rings, lambda r: (F.size(r) >= 3) & F.forall(r, point)), F.lit(False))


def _cell_range(low: str, high: str, size: float) -> Column:
    return F.sequence(F.floor(F.col(low) / F.lit(size)), F.floor(F.col(high) / F.lit(size)))


def adaptive_cells(boxes: DataFrame, cell: float, finest: float, per_cell: int) -> DataFrame:
    """boxes (group string, x0, y0, x1, y1, more) for each cell that they cover, with size, cx, cy and n, the cell's boxes.

    Cells of more than per_cell boxes are cut into sixteen until their size is finest or less; those whose boxes would
    come to COPIES pieces or more on average stay whole.
    """
    size, done = cell, []
    piece = lambda c, low, high, size: F.sequence(F.greatest(F.floor(F.col(low) / F.lit(size)), F.col(c) * 4), F.least(F.floor(F.col(high) / F.lit(size)), F.col(c) * 4 + 3))
    rows = boxes.withColumn("cx", F.explode(_cell_range("x0", "x1", size))).withColumn("cy", F.explode(_cell_range("y0", "y1", size)))
    while True:
        key = ["group", "cx", "cy"]
        xs, ys = piece("cx", "x0", "x1", size / 4), piece("cy", "y0", "y1", size / 4)
        counted = rows.groupBy(*key).agg(F.count("*").alias("n"), F.sum(F.size(xs) * F.size(ys)).alias("pieces"))
        rows = stored(rows.join(counted, key), "cells").withColumn("size", F.lit(size))
        cut = (F.col("n") > per_cell) & (F.col("pieces") < F.col("n") * COPIES) if size > finest else F.lit(False)
        done.append(rows.where(~cut).drop("pieces"))
        if size <= finest or rows.where(cut).isEmpty():
            break
        size = size / 4
        rows = rows.where(cut).drop("n", "size", "pieces").withColumns({"xs": piece("cx", "x0", "x1", size), "ys": piece("cy", "y0", "y1", size)})
        rows = rows.withColumn("cx", F.explode("xs")).withColumn("cy", F.explode("ys")).drop("xs", "ys")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _placed(polygons: DataFrame, same: list[str], buffer: float, cell: float, per_cell: int) -> DataFrame:
    """id, group, rings and the cells of every usable polygon."""
    xs, ys = (F.transform(F.flatten("rings"), lambda p: F.get(p, F.lit(c))) for c in (0, 1))
    half = F.lit(buffer / 2)
    boxes = polygons.select("id", F.to_json(F.struct(F.lit(0).alias("all_"), *same)).alias("group"), "rings", (F.array_min(xs) - half).alias("x0"), (F.array_min(ys) - half).alias("y0"), (F.array_max(xs) + half).alias("x1"), (F.array_max(ys) + half).alias("y1"), _usable(F.col("rings")).alias("usable"))
    known = stored(boxes, "boxes").where("usable").drop("usable")  # asked once, and not before rows are spread, where Spark would move a filter to
    return adaptive_cells(known, cell, buffer / 2 if buffer > 0 else cell / 4**8, per_cell)


def _meeting(shapes: Shapes, role: np.ndarray, of_left: np.ndarray, of_right: np.ndarray, buffer: float, tests: list[tuple[Callable, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """i, j: numbers of polygons whose boxes, turned ones too, come within buffer and that meet the tests; some BOXES pairs are looked at in a step.

    Where all polygons stand on both sides a pair comes once, else i is of the left, j of the right and of_left[i] less than
    of_right[j]. A test is a function of two arrays, and the array that it takes values of i and j from.
    """
    left, right = (of[np.argsort(shapes.box[of, 0], kind="stable")] for of in (np.flatnonzero(role != RIGHT), np.flatnonzero(role != LEFT)))
    if not len(left) or not len(right):
        return
    x = shapes.box[right, 0]
    stops = np.searchsorted(x, np.maximum.accumulate(shapes.box[left, 2]) + buffer, "right")
    if (role == BOTH).all():  # left and right are the same: each is compared with those after it
        place = np.argsort(left)
        starts, pairs = np.arange(1, len(left) + 1), (np.less, place, place)
    else:
        starts, pairs = np.searchsorted(x, shapes.box[left, 0] - (shapes.box[right, 2] - x).max() - buffer, "left"), (np.less, of_left, of_right)
    asked = [pairs, *((f, c, c) for f, c in tests)]
    slack = buffer * 2**0.5 + 1e-12 * (np.abs(shapes.turned).max() + buffer)  # wider than the buffer by what rounding may move
    for bounds, gap in ((shapes.box, buffer), (shapes.turned, slack)):
        for c in (0, 1):
            low, high = bounds[:, c], bounds[:, c + 2]
            asked += [(np.greater_equal, high, low - gap), (np.less_equal, low - gap, high)]
    asked = [(f, a[left][:, None], b[right]) for f, a, b in asked]
    k = 0
    while k < len(left):
        start, some = starts[k], stops[k : k + BOXES]
        stop = k + max(1, int(np.searchsorted((some - start) * np.arange(1, len(some) + 1), BOXES, "right")))
        end = stops[stop - 1]
        near, met = (shapes.space(name, stop - k, end - start, of=bool) for name in ("near", "met"))
        near[:] = True
        for f, a, b in asked:
            near &= f(a[k:stop], b[start:end], out=met)
        i, j = np.divmod(np.flatnonzero(near), max(end - start, 1))
        yield left[k + i], right[start + j]
        k = stop


def _gathered(pairs: Iterator[tuple[np.ndarray, np.ndarray]], at_once: int, counts: Callable | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """pairs for which counts(i, j) holds, about at_once at a time; counts is asked no earlier, so it may follow from what was given out."""
    found, n = [], 0
    for i, j in pairs:
        for s in range(0, len(i), at_once):
            a, b = i[s : s + at_once], j[s : s + at_once]
            if counts:
                counted = counts(a, b)
                a, b = a[counted], b[counted]
            found.append((a, b))
            n += len(a)
            if n >= at_once:
                yield tuple(np.concatenate(f) for f in zip(*found, strict=True))
                found, n = [], 0
    if n:
        yield tuple(np.concatenate(f) for f in zip(*found, strict=True))


def _compared(rows: DataFrame, buffer: float) -> DataFrame:
    """a, b (a < b), distance of near pairs within each cell and block; rows: id, rings, size, cx, cy, role and the keys.

    A pair counts in the cell that holds the lower corner of what its widened boxes share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(batches)
        shapes, ident, role = Shapes(group["rings"]), group["id"].to_numpy(), group["role"].to_numpy()
        size, cx, cy = (group[c][0].as_py() for c in ("size", "cx", "cy"))
        begins = [np.floor((shapes.box[:, c] - buffer / 2) / size) == at for c, at in ((0, cx), (1, cy))]  # the corner lies here if one of the pair begins here
        for i, j in _gathered(_meeting(shapes, role, ident, ident, buffer, [(np.logical_or, here) for here in begins]), PAIRS):
            d = distances(shapes, i, j, buffer)
            near = (d <= buffer) & (ident[i] != ident[j])
            a, b = ident[i[near]], ident[j[near]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64()), pa.array(d[near])], ["a", "b", "distance"])

    return rows.groupBy(*BLOCK).applyInArrow(run, "a long, b long, distance double")


def _linked(rows: DataFrame, buffer: float) -> DataFrame:
    """u, v: links that join what is near within each cell and block, one fewer than it joins; rows: id, rings, cluster, role, the keys.

    Rows of one cluster count as linked, so polygons are compared only where they are not in one cluster by then.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(batches)
        shapes, ident, role = Shapes(group["rings"]), group["id"].to_numpy(), group["role"].to_numpy()
        first, label = np.unique(group["cluster"].to_numpy(), return_index=True, return_inverse=True)[1:]
        root = first[label]
        after = np.where(role == RIGHT, np.iinfo(np.int64).max, ident)
        for i, j in _gathered(_meeting(shapes, role, ident, after, buffer, []), LINKED, lambda i, j: root[j] != root[i]):
            near = distances(shapes, i, j, buffer) <= buffer
            links, up = [], {}
            for a, b in zip(root[i[near]].tolist(), root[j[near]].tolist(), strict=True):
                while a in up:
                    a = up[a]
                while b in up:
                    b = up[b]
                if a != b:
                    up[max(a, b)] = min(a, b)
                    links.append((a, b))
            for a in sorted(up):  # a root goes to a smaller one, which has its own by then
                up[a] = up.get(up[a], up[a])
            if up:
                to = np.arange(len(root))
                to[list(up)] = list(up.values())
                root[:] = to[root]
                u, v = np.array(links).T
                yield pa.RecordBatch.from_arrays([pa.array(ident[u], pa.int64()), pa.array(ident[v], pa.int64())], ["u", "v"])

    return rows.groupBy(*BLOCK).applyInArrow(run, "u long, v long")


def _dealt(rows: DataFrame, n_left: Column, per_cell: int, is_left: Column) -> DataFrame:
    """rows once for each block that they are compared in; those with is_left on the left, all on the right."""
    blocks = lambda n: F.greatest(F.ceil(n / F.lit(per_cell)), F.lit(1)).cast("int")
    mine = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "id"), blocks(n)).cast("int")
    other = lambda n: F.sequence(F.lit(0), blocks(n) - 1)
    whole = (F.col("n") <= per_cell) & (n_left <= per_cell)
    pair = lambda role, a, b: F.struct(F.lit(role).alias("role"), a.cast("int").alias("block_left"), b.cast("int").alias("block_right"))
    single = F.array(F.when(is_left, pair(BOTH, F.lit(0), F.lit(0))).otherwise(pair(RIGHT, F.lit(0), F.lit(0))))
    lefts = F.when(is_left, F.transform(other(F.col("n")), lambda b: pair(LEFT, mine(n_left, 1), b))).otherwise(F.array().cast("array<struct<role:int,block_left:int,block_right:int>>"))
    rights = F.transform(other(n_left), lambda a: pair(RIGHT, a, mine(F.col("n"), 2)))
    return rows.withColumn("at", F.explode(F.when(whole, single).otherwise(F.concat(lefts, rights)))).select(*rows.columns, "at.*")


def near_polygons(polygons: DataFrame, same: list[str], buffer: float, cell: float, per_cell: int = PER_CELL) -> DataFrame:
    """a, b (a < b), distance: the pairs of polygons (id, rings and the columns in same) that are at most buffer apart."""
    placed = _placed(polygons, same, buffer, cell, per_cell)
    return _compared(_by_work(_dealt(placed, F.col("n"), per_cell, F.lit(True)), placed), buffer)


def _by_work(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """rows dealt to tasks by what there is to compare in the cells of placed: few bytes make many pairs, and Spark would gather by bytes."""
    spark = rows.sparkSession
    tasks = math.ceil((placed.agg(F.sum("n")).first()[0] or 0) / A_TASK)
    if tasks <= spark.sparkContext.defaultParallelism:
        return rows
    return rows.repartition(max(min(tasks, MOST_TASKS), int(spark.conf.get("spark.sql.shuffle.partitions"))), *BLOCK)


def polygon_clusters(polygons: DataFrame, same: list[str], buffer: float, cell: float, per_cell: int = PER_CELL) -> DataFrame:
    """(id, cluster) of polygons that reach others through near ones; cluster is the smallest id, single polygons are left out.

    Every block gives a link for each polygon at most, whatever its pairs are. The polygons of a crowded cell are dealt to
    blocks twice, each time otherwise, and compared within them, so that piles come together through the blocks that they
    share. Then those outside the cluster that most of their cell is in are compared with the others of the cell; two
    crowds that face each other just beyond the buffer do cost their product, in blocks.
    """
    placed = _placed(polygons, same, buffer, cell, per_cell).select("id", "group", "rings", "n", "size", "cx", "cy")
    blocks = F.ceil(F.col("n") / F.lit(per_cell)).cast("int")
    dealt = F.array(*[F.struct(F.lit(k).alias("block_left"), F.pmod(F.xxhash64(F.lit(k), "id"), blocks).cast("int").alias("block_right")) for k in (0, 1)])
    whole = F.array(F.struct(F.lit(0).alias("block_left"), F.lit(0).alias("block_right")))
    parts = placed.withColumns({"cluster": F.col("id"), "role": F.lit(BOTH), "at": F.explode(F.when(blocks > 1, dealt).otherwise(whole))})
    links = _linked(parts.select("id", "group", "rings", "size", "cx", "cy", "cluster", "role", "at.*"), buffer)
    crowded = placed.where(F.col("n") > per_cell)
    if crowded.isEmpty():
        return _clusters(links)
    first = stored(_clusters(links), "clusters")
    key = ["group", "size", "cx", "cy"]
    known = crowded.join(first, "id", "left").withColumn("cluster", F.coalesce("cluster", "id"))
    sizes = known.groupBy(*key, "cluster").agg(F.count("*").alias("of"))
    main = sizes.groupBy(*key).agg(F.max_by("cluster", "of").alias("main"), (F.sum("of") - F.max("of")).alias("n_left"))
    rest = known.join(main.where("n_left > 0"), key)
    more = _linked(_dealt(rest, F.col("n_left"), per_cell, F.col("cluster") != F.col("main")), buffer)
    return _clusters(first.select(F.col("cluster").alias("u"), F.col("id").alias("v")).unionByName(more))


def _clusters(links: DataFrame) -> DataFrame:
    return components(links).select(F.col("node").alias("id"), F.col("root").alias("cluster"))


# rings that cross themselves


def simple_loops(ring: list) -> list[list[tuple[float, float]]]:
    """The simple loops that a ring falls into where it crosses or touches itself, open; parts without area are left out.

    Edges are swept by their smaller x, so that only those whose spans overlap are compared; where two meet, both get the
    point. The ring is then walked, and comes off in a loop whenever a point comes again.
    """
    points = [(float(p[0]), float(p[1])) for p in ring]
    points = [p for k, p in enumerate(points) if p != points[k - 1]]
    n = len(points)
    edges = [(points[k], points[(k + 1) % n]) for k in range(n)]
    met: list[dict[tuple[float, float], float]] = [{} for _ in edges]
    active: list[int] = []
    for k in sorted(range(n), key=lambda k: min(edges[k][0][0], edges[k][1][0])):
        low = min(edges[k][0][0], edges[k][1][0])
        active = [a for a in active if max(edges[a][0][0], edges[a][1][0]) >= low]
        for a in active:
            for p in _meetings(*edges[a], *edges[k]):
                for e in (a, k):
                    met[e][p] = _along(p, *edges[e])
        active.append(k)
    loops, path, place = [], [], {}
    for k in range(n):
        between = sorted((t, p) for p, t in met[k].items() if 0 < t < 1 and p not in edges[k])
        for p in [edges[k][0], *(p for _, p in between)]:
            if p in place:
                loop = path[place[p] :]
                for q in loop:
                    del place[q]
                del path[-len(loop) :]
                loops.append(loop)
            place[p] = len(path)
            path.append(p)
    return [x for x in [*loops, path] if len(x) > 2 and _area(x) > 0]


def _along(p, a, b) -> float:
    """Where on a segment a point of it lies, from 0 to 1."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    return (p[0] - a[0]) / dx if abs(dx) >= abs(dy) else (p[1] - a[1]) / dy


def _meetings(a, b, c, d) -> Iterator[tuple[float, float]]:
    """The point where two segments cross, or the ends of one that lie on the other."""
    turns = _turn(*a, *b, *c), _turn(*a, *b, *d), _turn(*c, *d, *a), _turn(*c, *d, *b)
    if turns[0] * turns[1] < 0 and turns[2] * turns[3] < 0:
        t = turns[2] / (turns[2] - turns[3])
        yield (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1]))
    for turn, p, e in ((turns[0], c, (a, b)), (turns[1], d, (a, b)), (turns[2], a, (c, d)), (turns[3], b, (c, d))):
        if turn == 0 and 0 <= _along(p, *e) <= 1:
            yield p


def _area(loop: list[tuple[float, float]]) -> float:
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(loop, [*loop[1:], loop[0]], strict=True))) / 2


def valid_rings(df: DataFrame, ident: str, ring: str) -> DataFrame:
    """id, ring (closed) and area: of every ring the largest simple part; null where it has none."""

    def largest(points: list | None) -> tuple:
        usable = points and all(p and len(p) > 1 and None not in p and np.isfinite(p[:2]).all() for p in points)
        loops = simple_loops(points) if usable else []
        best = max(loops, key=_area, default=None)
        return ([list(p) for p in [*best, best[0]]], _area(best)) if best else (None, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [largest(r) for r in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.list_(pa.list_(pa.float64()))), pa.array([r[1] for r in rows], pa.float64())], ["id", "ring", "area"])

    return df.select(F.col(ident).cast("long").alias("id"), F.col(ring).cast("array<array<double>>").alias("ring")).mapInArrow(run, "id long, ring array<array<double>>, area double")
