"""Rings that cross themselves: their loops against what must hold for any of them."""

import random

from terrane.operators import polygons


def signed(r):
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(r, [*r[1:], r[0]], strict=True)) / 2


def crosses(loop):
    edges = list(zip(loop, [*loop[1:], loop[0]], strict=True))
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    return any(turn(a, b, c) * turn(a, b, d) < -1e-6 and turn(c, d, a) * turn(c, d, b) < -1e-6 for i, (a, b) in enumerate(edges) for c, d in edges[i + 2 :])


def test_known_shapes():
    assert polygons.simple_loops([[0, 0], [2, 2], [2, 0], [0, 2]]) == [[(1.0, 1.0), (2.0, 2.0), (2.0, 0.0)], [(0.0, 0.0), (1.0, 1.0), (0.0, 2.0)]]
    assert sorted(map(len, polygons.simple_loops([[0, 0], [4, 0], [9, 0], [4, 0], [4, 4], [0, 4], [0, 0]]))) == [4]  # a spike
    assert polygons.simple_loops([[0, 0], [1, 1], [2, 2]]) == [] and polygons.simple_loops([[0, 0]]) == []
    square = [(0.0, 0.0), (3.0, 0.0), (3.0, 3.0), (0.0, 3.0)]
    assert polygons.simple_loops(square) == [square]
    touching = polygons.simple_loops([[0, 0], [4, 0], [4, 4], [2, 0], [0, 4]])  # a corner on an edge
    assert sorted(polygons._area(x) for x in touching) == [4.0, 4.0]


def test_loops_are_simple_and_keep_the_area():
    rnd = random.Random(3)
    for n in range(4, 11):
        for _ in range(60):
            ring = [(rnd.random() * 10, rnd.random() * 10) for _ in range(n)]
            loops = polygons.simple_loops(ring)
            assert not any(crosses(x) for x in loops)
            assert abs(sum(signed(x) for x in loops) - signed(ring)) < 1e-9


def test_rows_without_a_ring_keep_null(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [[0.0, 0.0], [1.0, None]]), (4, [[0.0, 0.0], [2.0, 2.0], [2.0, 0.0], [0.0, 2.0]])], "id long, ring array<array<double>>")
    got = {r.id: (r.area, r.ring and len(r.ring)) for r in polygons.valid_rings(df, "id", "ring").collect()}
    assert got == {1: (None, None), 2: (None, None), 3: (None, None), 4: (1.0, 4)}
