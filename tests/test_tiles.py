"""Map tiles: bytes written by hand and from rows, read back."""

import gzip
import struct

from terrane.sources import tiles

SQUARE = [[10, 10], [20, 10], [20, 20], [10, 20]]
HOLE = [[12, 12], [12, 14], [14, 14], [14, 12]]


def test_values_of_all_kinds():
    values = [tiles._held(1, "яр".encode()), b"\x15" + struct.pack("<f", 0.5), b"\x19" + struct.pack("<d", 2.25), b"\x20" + tiles._number((1 << 64) - 3), b"\x28\x07", b"\x30\x05", b"\x38\x01"]
    assert [tiles._value(v) for v in values] == ["яр", "0.5", "2.25", "-3", "7", "-3", "true"]


def test_rings_holes_and_extent():
    data = tiles.polygon_layer("land", [(5, [SQUARE, HOLE], {"a": "1", "b": "1"}), (6, [SQUARE], {})], 100)
    want = [("land", 100, [(5, "polygon", [[tuple(p) for p in SQUARE], [tuple(p) for p in HOLE]], {"a": "1", "b": "1"}), (6, "polygon", [[tuple(p) for p in SQUARE]], {})])]
    assert tiles.layers(data) == want == tiles.layers(gzip.compress(data))
    assert tiles.layers(data + data) == want * 2  # parts of a tile


def test_points_and_lines():
    assert tiles.drawn([17, 10, 14, 3, 9], 1) == [[(5, 7)], [(3, 2)]]
    assert tiles.drawn([9, 4, 4, 18, 0, 16, 16, 0, 9, 17, 17, 10, 4, 8], 2) == [[(2, 2), (2, 10), (10, 10)], [(1, 1), (3, 5)]]


def test_broken_tiles_have_no_features():
    data = tiles.polygon_layer("land", [(5, [SQUARE], {"a": "1"})])
    for cut in range(1, len(data)):
        assert tiles.layers(data[:cut]) == []
    assert tiles.layers(None) == tiles.layers(b"") == tiles.layers(b"\xff" * 20) == tiles.layers(b"\x1f\x8bno") == []


def test_places():
    assert tiles.place(0, 0, 1, 4096, (4096, 4096)) == [0.0, 0.0]
    assert abs(tiles.place(0, 0, 0, 4096, (0, 0))[1] - 85.0511287798) < 1e-9


def test_parcels_across_tiles(spark):
    layer = lambda name, *features: tiles.polygon_layer(name, list(features))
    wide = [[0, 10], [900, 10], [900, 20], [0, 20]]
    rows = [
        (1, 1, 12, layer("land_polygons", (1, [SQUARE], {"cadnum": "A", "area": "0,5"}), (2, [wide, SQUARE], {"cadnum": " B ", "purpose": "01"}), (3, [SQUARE], {"area": "7"}))),
        (2, 1, 12, layer("Polygons", (2, [SQUARE], {"number": "B", "purpose": "other"})) + layer("roads", (9, [SQUARE], {"cadnum": "C"}))),
        (3, 1, 12, None), (4, 1, 12, b"\x1a\x7f"), (None, 1, 12, layer("polygons", (1, [SQUARE], {"cadnum": "D"}))), (5, 1, 12, layer("polygons", (1, [SQUARE[:2]], {"cadnum": "E"}))),
    ]
    features = tiles.tile_features(spark.createDataFrame(rows, "x int, y int, zoom int, data binary"), "data", "x", "y", "zoom")
    assert features.count() == 6
    got = {r.number: r for r in tiles.tile_parcels(features).collect()}
    assert sorted(got) == ["A", "B"]
    assert got["A"].area == 5000.0 and got["A"].purpose is None and len(got["A"].ring) == 5
    assert (got["B"].purpose, got["B"].purpose_label, got["B"].area) == ("01", "01", None)
    assert got["B"].x0 == tiles.place(1, 1, 12, 4096, (0, 10))[0] and got["B"].x1 == tiles.place(1, 1, 12, 4096, (900, 10))[0]


def test_parts_from_rows(spark):
    rows = [(k % 3, 7, k, [SQUARE], {"cadnum": str(k), "area": None}) for k in range(50)]
    parts = tiles.tile_parts(spark.createDataFrame(rows, "x int, y int, id long, rings array<array<array<int>>>, properties map<string,string>"), "polygons")
    got = tiles.tile_parcels(tiles.tile_features(parts.selectExpr("*", "4 as z"), "data", "x", "y", "z"))
    assert sorted(int(r.number) for r in got.collect()) == list(range(50))


def test_parts_are_sorted_in_partitions_of_bounded_size(spark):
    """One input partition of many polygons is dealt before it is sorted."""
    from pyspark.sql import functions as F

    ring = F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in ((0, 0), (9, 0), (9, 9))])
    rows = spark.range(0, 2000, 1, 1).select((F.col("id") % 7).alias("x"), F.lit(3).alias("y"), "id", F.array(ring).alias("rings"), F.create_map(F.lit("cadnum"), F.col("id").cast("string")).alias("properties"))
    parts = tiles.tile_parts(rows, "land_polygons")
    assert "REBALANCE" in parts._jdf.queryExecution().executedPlan().toString().upper()
    found = tiles.tile_parcels(tiles.tile_features(parts.withColumn("zoom", F.lit(12)), "data", "x", "y", "zoom"))
    assert found.count() == found.select("number").distinct().count() == 2000
