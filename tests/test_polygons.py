"""Near polygons against brute force, and piles of them."""

import math
import random

import pytest

from terrane.operators import polygons

SHAPE = "id long, kind string, rings array<array<array<double>>>"


def segment(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    n = dx * dx + dy * dy
    t = min(max(((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / n, 0.0), 1.0) if n else 0.0
    return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)


def edges(rings):
    return [(r[k], r[(k + 1) % len(r)]) for r in rings for k in range(len(r))]


def turn(a, b, c):
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def inside(p, rings):
    return sum((a[1] > p[1]) != (b[1] > p[1]) and p[0] < a[0] + (p[1] - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for a, b in edges(rings)) % 2 == 1


def distance(r, s):
    if any(inside(p, s) for p in r[0]) or any(inside(p, r) for p in s[0]):
        return 0.0
    best = math.inf
    for a, b in edges(r):
        for c, d in edges(s):
            if turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0:
                return 0.0
            best = min(best, segment(a, c, d), segment(b, c, d), segment(c, a, b), segment(d, a, b))
    return best


def star(rnd, x, y, r, n):
    turns = sorted(rnd.uniform(0, 2 * math.pi) for _ in range(n))
    return [[x + r * rnd.uniform(0.4, 1) * math.cos(t), y + r * rnd.uniform(0.4, 1) * math.sin(t)] for t in turns]


def square(x, y, w):
    return [[float(a), float(b)] for a, b in ((x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y))]


def some(seed, n, wide):
    rnd = random.Random(seed)
    rows = [(k, rnd.choice(["a", "b", None]), [star(rnd, rnd.uniform(0, wide), rnd.uniform(0, wide), rnd.uniform(0.2, 3), rnd.randint(3, 9))]) for k in range(n)]
    planted = [[square(100, 0, 2)], [square(102, 0, 2)], [square(104.3, 0, 1)], [square(105.8, 0, 1)], [square(200, 0, 20), square(204, 4, 12)], [square(209, 9, 1)], [square(204.2, 4.2, 1)], [square(218, 1, 1)], [[[300.0, 0.0], [310.0, 10.0], [310.0, 9.0]]], [[[303.0, 0.0], [304.0, 10.0], [305.0, 10.0]]], [square(209, 9, 1)]]
    return rows + [(n + k, "a", p) for k, p in enumerate(planted)]


@pytest.mark.parametrize(("cell", "per_cell"), [(8.0, 256), (50.0, 6), (3.0, 4)])
def test_pairs_equal_brute_force(spark, cell, per_cell):
    rows = some(4, 160, 30.0)
    odd = [(900, "a", None), (901, "a", []), (902, "a", [[[0.0, 0.0], [1.0, 1.0]]]), (903, "a", [[[0.0, 0.0], [1.0, None], [2.0, 2.0]]]), (904, "a", [[[0.0, 0.0], [1.0, float("nan")], [2.0, 2.0]]])]
    got = {(r.a, r.b): r.distance for r in polygons.near_polygons(spark.createDataFrame(rows + odd, SHAPE), ["kind"], 0.5, cell, per_cell).collect()}
    want = {(i, j): distance(r, s) for i, k, r in rows for j, m, s in rows if i < j and k == m}
    want = {k: d for k, d in want.items() if d <= 0.5}
    assert set(got) == set(want) and len(want) > 60
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("per_cell", [256, 5])
def test_clusters_equal_union_find(spark, per_cell):
    rows = some(7, 150, 60.0) + [(500 + k, "a", [square(30 + k % 7 * 0.01, 30 + k // 7 * 0.01, 0.3)]) for k in range(60)]
    root = {i: i for i, _, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, k, r in rows:
        for j, m, s in rows:
            if i < j and k == m and distance(r, s) <= 0.5:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    sizes = {}
    for i in root:
        sizes.setdefault(find(i), []).append(i)
    want = {(i, c) for c, of in sizes.items() if len(of) > 1 for i in of}
    got = {tuple(r) for r in polygons.polygon_clusters(spark.createDataFrame(rows, SHAPE), ["kind"], 0.5, 16.0, per_cell).collect()}
    assert got == want


def test_crowded_cell_is_cut(spark):
    """40,000 boxes that start in one cell: no cell that is left holds more than a few hundred, and pairs are linear."""
    from pyspark.sql import functions as F

    n = 40_000
    x, y = F.col("id") % 250 * 0.02, F.floor(F.col("id") / 250) * 0.02
    p = lambda a, b: F.array(a, b)
    w = F.lit(0.012)
    boxes = spark.range(n).select("id", F.array(F.array(p(x, y), p(x + w, y), p(x + w, y + w), p(x, y + w))).alias("rings"))
    placed = polygons._placed(boxes, [], 0.001, 8.0, 256)
    assert placed.agg(F.max("n")).first()[0] <= 256
    assert placed.count() < 2 * n
    assert polygons.near_polygons(boxes, [], 0.001, 8.0).count() == 0


def test_pile_of_different_boxes_links_in_its_number(spark):
    """5,000 boxes over one point: a cell cannot part them, so they are linked without being compared."""
    from pyspark.sql import functions as F

    n = 5_000
    w = 1 + F.col("id") * 1e-7
    p = lambda a, b: F.array(a, b)
    boxes = spark.range(n).select("id", F.array(F.array(p(-w, -w), p(w, -w), p(w, w), p(-w, w))).alias("rings"))
    got = polygons.polygon_clusters(boxes, [], 4.0, 8.0)
    assert got.where("cluster = 0").count() == n


def test_empty_table(spark):
    none = spark.createDataFrame([], SHAPE)
    assert polygons.near_polygons(none, ["kind"], 1.0, 8.0).count() == 0
    assert polygons.polygon_clusters(none, ["kind"], 1.0, 8.0).count() == 0


def test_crowd_of_wide_polygons(spark):
    """6,000 squares of width 4 over a square of 20: cells are not cut where all pieces hold the same squares, links are fewer than squares and blocks."""
    from pyspark.sql import functions as F

    n, per_cell = 6_000, 500
    x, y = F.col("id") * 7919 % 10007 * 0.002, F.col("id") * 6007 % 10009 * 0.002
    p = lambda a, b: F.array(a, b)
    boxes = spark.range(n).select("id", F.array(F.array(p(x, y), p(x + 4, y), p(x + 4, y + 4), p(x, y + 4))).alias("rings"))
    placed = polygons._placed(boxes, [], 0.25, 16.0, per_cell)
    assert placed.count() < 10 * n
    rows = placed.withColumns({"cluster": F.col("id"), "role": F.lit(polygons.BOTH), "block_left": F.lit(0), "block_right": F.lit(0)})
    assert polygons._linked(rows, 0.25).count() < placed.count()
    got = polygons.polygon_clusters(boxes, [], 0.25, 16.0, per_cell)
    assert got.where("cluster = 0").count() == n


def test_pairs_of_a_crowd_in_large_cells(spark):
    """2,000 squares of width 4 over a square of 20: all near pairs come once from few rows."""
    import numpy as np
    from pyspark.sql import functions as F

    n, per_cell = 2_000, 150
    x, y = F.col("id") * 7919 % 10007 * 0.002, F.col("id") * 6007 % 10009 * 0.002
    p = lambda a, b: F.array(a, b)
    boxes = spark.range(n).select("id", F.array(F.array(p(x, y), p(x + 4, y), p(x + 4, y + 4), p(x, y + 4))).alias("rings"))
    assert polygons._placed(boxes, [], 0.2511, 16.0, per_cell).count() < 10 * n
    k = np.arange(n)
    gap = lambda c: np.maximum(np.abs(c[:, None] - c[None, :]) - 4, 0)
    near = np.hypot(gap(k * 7919 % 10007 * 0.002), gap(k * 6007 % 10009 * 0.002)) <= 0.2511
    got = polygons.near_polygons(boxes, [], 0.2511, 16.0, per_cell)
    assert got.count() == got.distinct().count() == int(np.triu(near, 1).sum())


def test_polygons_that_cross_ask_no_distances(monkeypatch):
    """80 diamonds along a line, each across all others: their edges are tested for crossing, and no distances are computed."""
    import numpy as np
    import pyarrow as pa

    asked, plain = [], polygons._to_segment
    monkeypatch.setattr(polygons, "_to_segment", lambda *a: asked.append(len(a[0])) or plain(*a))
    shift = lambda k: [[[k * 0.01, 1.0], [k * 0.01 - 1, 0.0], [k * 0.01, -1.0], [k * 0.01 + 1, 0.0]]]
    rings = pa.array([shift(k) for k in range(80)] + [shift(1000)], pa.list_(pa.list_(pa.list_(pa.float64()))))
    shapes = polygons.Shapes(pa.chunked_array([rings]))
    i, j = np.triu_indices(80, 1)
    assert not polygons.distances(shapes, i, j, 0.25).any() and sum(asked) == 0
    one = np.array([0])
    assert polygons.distances(shapes, one, one + 80, 9.0)[0] == pytest.approx(8.0) and sum(asked) > 0


def test_polygons_side_by_side_equal_those_edge_by_edge():
    """Polygons of few points are compared side by side, to the last bit as edge by edge; those with holes or many points are not."""
    import numpy as np
    import pyarrow as pa

    rnd = random.Random(11)
    rings = [r for _, _, r in some(11, 120, 14.0)] + [[star(rnd, rnd.uniform(0, 14), rnd.uniform(0, 14), 2, 40)] for _ in range(10)]
    shapes = polygons.Shapes(pa.chunked_array([pa.array(rings, pa.list_(pa.list_(pa.list_(pa.float64()))))]))
    i, j = np.triu_indices(len(rings), 1)
    asked, plain = [], polygons._edge_by_edge
    want = plain(shapes, i, j, 0.7)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(polygons, "_edge_by_edge", lambda s, i, j, b: asked.append(len(i)) or plain(s, i, j, b))
        got = polygons.distances(shapes, i, j, 0.7)
    assert (got == want).all() and np.isfinite(want).sum() > 500 and (want[np.isfinite(want)] > 0).sum() > 50
    few = shapes.single[i] & shapes.single[j] & (shapes.n[i] * shapes.n[j] <= polygons.SMALL)
    assert sum(asked) == (~few).sum() < len(i) / 2


def test_work_is_dealt_to_tasks_by_pairs_not_bytes(spark, monkeypatch):
    """3,000 small squares in 36 cells are few bytes; with some 20,000 pairs of boxes to a task they still go to many tasks, and pairs stay the same."""
    from pyspark.sql import functions as F

    n = 3_000
    x, y = F.col("id") * 7919 % 10007 * 0.0047, F.col("id") * 6007 % 10009 * 0.0047
    p = lambda a, b: F.array(a, b)
    boxes = spark.range(n).select("id", F.array(F.array(p(x, y), p(x + 1, y), p(x + 1, y + 1), p(x, y + 1))).alias("rings"))
    plain = polygons.near_polygons(boxes, [], 0.1, 8.0)
    monkeypatch.setattr(polygons, "A_TASK", 20_000)
    dealt = polygons.near_polygons(boxes, [], 0.1, 8.0)
    assert plain.rdd.getNumPartitions() <= 4 < 12 < dealt.rdd.getNumPartitions()
    assert dealt.count() == dealt.distinct().count() == plain.count() > n
    assert dealt.exceptAll(plain).isEmpty()
