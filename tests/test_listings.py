"""Listing functions and entity operators on inline rows, nulls and empty tables among them."""

import datetime
import itertools
import random

import pytest
from pyspark.sql import functions as F

from terrane.functions import listings as L
from terrane.functions import places as P
from terrane.operators import entities
from terrane.sources import files


def values(spark, rows, schema, column):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r.v for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def test_best_address_prefers_a_complete_one(spark):
    schema = "a array<struct<n:int,is_complete:boolean>>"
    rows = [([(1, False), (2, True), (3, True)],), ([(1, None), (2, False)],), ([],), (None,)]
    assert values(spark, rows, schema, L.best_address(F.col("a"))["n"]) == [2, 1, None, None]


def test_addresses_text_skips_what_is_empty(spark):
    schema = "a array<struct<x:string,y:string>>"
    rows = [([("Київ", None), ("", ""), ("Львів", "Зелена")],), ([],), (None,)]
    assert values(spark, rows, schema, L.addresses_text(F.col("a"), ["x", "y"])) == ["Київ; Львів, Зелена", "", ""]


@pytest.mark.parametrize(
    ("text", "want"),
    [("Земля С/Г призначення", L.FARMLAND), ("ділянка 10 соток, склад", L.LAND_AND_BUILDING), ("земельна ділянка", L.LAND), ("нежитлове приміщення", L.BUILDING), ("телефон", L.OTHER), ("", L.OTHER), (None, L.OTHER)],
)
def test_kind_of_text(spark, text, want):
    assert values(spark, [(text,)], "t string", L.kind_of_text(F.col("t"))) == [want]


def test_stored_kind_comes_before_the_text(spark):
    rows = [("Земля сільськогосподарська", "офіс"), ("Земельна ділянка, будівлі", ""), ("земля", "офіс"), ("Нерухомість", "ділянка"), (" ", "ділянка"), ("квартира", "офіс"), (None, None)]
    assert values(spark, rows, "s string, t string", L.kind_of_listing(F.col("s"), F.col("t"))) == [L.FARMLAND, L.LAND_AND_BUILDING, L.LAND, L.BUILDING, L.LAND, L.BUILDING, L.OTHER]


def test_item_facts_of_missing_items(spark):
    schema = "item struct<cadastral_number:string,utilities:boolean,encumbered:boolean,region:string,locality:string,street:string>"
    got = values(spark, [(None,), ((" 4610100000:01:001:0001 ", False, None, "", None, None),), (("no number", None, False, None, " ", ""),)], schema, P.item_facts(F.col("item")))
    assert [tuple(x) for x in got] == [(None,) * 8, ("4610100000:01:001:0001", "Львівська", None, None, None, None, "відсутні", None), ("no number", None, None, None, None, None, None, None)]


def test_kind_of_items(spark):
    schema = "x array<struct<code:string,props:string,land_area:double,building_area:double,unit:string>>"
    none = (None,) * 5
    rows = [([("05", None, None, None, None)],), ([none, ("9", "Land", None, None, None)],), ([("9", None, 0.0, 3.0, None)],), ([("9", None, None, None, "га"), ("04", None, None, None, None)],), ([none],), ([],), (None,)]
    assert values(spark, rows, schema, L.kind_of_items(F.col("x"))) == [L.LAND_AND_BUILDING, L.LAND, L.BUILDING, L.LAND_AND_BUILDING, L.OTHER, L.OTHER, L.OTHER]


def test_lease_rules_in_their_order(spark):
    schema = "l string, s string, p string, c array<string>, t string"
    rows = [("x", "y", None, None, None), (None, "y", "lease", None, None), (None, None, "LeaseEnglish", None, None), (None, None, None, ["PA01-7"], None), (None, None, None, [], "Оренда складу"), (None, None, None, None, "Оренда або продаж"), (None, None, None, None, None)]
    assert values(spark, rows, schema, L.is_lease(*[F.col(c) for c in "lspct"])) == [True, False, True, True, True, False, False]


def test_open_lots_count_whole_days(spark):
    schema = "s string, at timestamp_ntz, c array<string>, e array<string>"
    now = datetime.datetime(2026, 1, 10, 12)
    day = datetime.timedelta(days=1)
    rows = [("active", now - 7.9 * day, ["0610"], []), ("active_x", now - 8 * day, ["0610"], None), ("complete", now, ["0610"], []), ("active", None, ["0610"], ["PA01-7"]), ("active", now + day, ["99"], []), ("active", None, None, None), (None, now, ["0610"], [])]
    assert values(spark, rows, schema, L.is_open_lot(F.col("s"), F.col("at"), F.lit(now), F.col("c"), F.col("e"), ["06"])) == [True] + [False] * 6


def test_ranked_uses_without_area_or_places(spark):
    schema = "k array<string>, a double, m map<string,int>"
    got = values(spark, [(["салон"], None, {}), ([], 10.0, {"hospital": 50})], schema, L.ranked_uses(F.col("k"), F.col("a"), F.col("m")))
    assert [(x.score, x.use) for x in got[0]][:3] == [(85, "салон"), (80, "аптека"), (75, "кафе")] and len(got[0]) == 8
    assert [(x.score, x.use) for x in got[1]] == [(85, "аптека"), (80, "клініка"), (65, "кафе"), (65, "магазин"), (60, "офіс"), (55, "склад"), (50, "виробництво")]


@pytest.mark.parametrize(
    ("text", "want"),
    [("04 лютого 2026 р.", (2026, 2, 4)), ("Сьогодні о 07:28", (2026, 3, 1)), ("Вчора о 12:00", (2026, 2, 28)), ("31 лютого 2026", None), ("скоро", None), ("", None), (None, None)],
)
def test_listed_date(spark, text, want):
    got = values(spark, [(text,)], "t string", L.listed_date(F.col("t"), F.lit("2026-03-01").cast("date")))
    assert got == [datetime.date(*want) if want else None]


def test_sotky_and_scale(spark):
    texts = [("12 соток, 12 сотки та 3,5 сотки",), ("сотня 5 сотень",), ("",), (None,)]
    assert values(spark, texts, "t string", L.sotky_sqm(F.col("t"))) == [1550.0, 0.0, 0.0, 0.0]
    rows = [(1000.0, 1000.0), (10.0, 1000.0), (None, 1000.0), (800.0, 1000.0), (6000.0, 1000.0), (5.0, 0.0), (5.0, None)]
    assert values(spark, rows, "c double, e double", L.wrong_scale(F.col("c"), F.col("e"))) == [False, True, True, False, True, False, False]


def test_agreement(spark):
    pairs = [(F.col("a"), F.col("b")), (F.col("c"), F.col("d"))]
    rows = [("x", "x ", "y", None), (None, "", None, None), ("x", "x", "1", "1")]
    assert values(spark, rows, "a string, b string, c string, d string", L.agreement(pairs)) == [0.5, 1.0, 1.0]


def test_near_boxes_against_all_pairs(spark):
    rnd = random.Random(3)
    rows = [(i, i % 2, float(x := rnd.randint(-20, 20)), float(y := rnd.randint(-20, 20)), x + rnd.randint(0, 5) * 1.0, y + rnd.randint(0, 5) * 1.0) for i in range(120)]
    rows += [(200 + i, *rows[7][1:]) for i in range(5)] + [(300, 0, None, 1.0, 2.0, 2.0)]
    df = spark.createDataFrame(rows, "id long, same int, x0 double, y0 double, x1 double, y1 double")
    got = [(r.a, r.b) for r in entities.near_boxes(df, ["same"], 0.5, 3.0).collect()]
    assert len(got) == len(set(got))
    near = lambda p, q: p[1] == q[1] and all(p[k] <= q[k + 2] + 0.5 and q[k] <= p[k + 2] + 0.5 for k in (2, 3))
    full = [r for r in rows if r[2] is not None]
    firsts = {}
    for r in full:
        firsts.setdefault(r[1:], r[0])
    want = {(p[0], q[0]) for p, q in itertools.combinations(full, 2) if near(p, q) and firsts[p[1:]] == p[0] and firsts[q[1:]] == q[0]}
    want |= {(firsts[r[1:]], r[0]) for r in full if firsts[r[1:]] != r[0]}
    assert set(got) == want
    assert entities.near_boxes(df.where("id < 0"), ["same"], 0.5, 3.0).count() == 0


def test_near_box_pairs_of_piles(spark):
    boxes = [(0.0, 0.0, 2.0, 2.0), (2.5, 0.0, 4.0, 2.0), (9.0, 9.0, 9.5, 9.5)]
    rows = [(i, same, *boxes[k]) for i, (same, k) in enumerate([(1, 0), (1, 1), (1, 0), (None, 0), (None, 0), (1, 1), (None, 1), (1, 2), (1, 0)])] + [(20, 1, None, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, same int, x0 double, y0 double, x1 double, y1 double")
    got = [(r.a, r.b) for r in entities.near_box_pairs(df, ["same"], 0.5, 3.0).collect()]
    near = lambda p, q: p[1] == q[1] and all(p[k] <= q[k + 2] + 0.5 and q[k] <= p[k + 2] + 0.5 for k in (2, 3))
    assert sorted(got) == [(p[0], q[0]) for p, q in itertools.combinations([r for r in rows if r[2] is not None], 2) if near(p, q)]


def test_objects_share_their_first_filled_key(spark):
    df = spark.createDataFrame([(1, "x", "7", None), (2, "x", None, "b"), (3, None, "7", "c"), (4, "", "7", "d"), (5, None, None, None), (6, None, None, "f")], "id int, addr string, num string, v string")
    out = entities.objects_by_key(df, [F.col("addr"), F.col("num")], F.col("id"), ["v"])
    assert sorted((r.first_ref, r.n_refs, r.v) for r in out.collect()) == [(1, 2, "b"), (3, 2, "c"), (5, 1, None), (6, 1, "f")]


def test_merge_attributes(spark):
    a = spark.createDataFrame([(1, 100.0, None), (2, None, "x"), (3, 100.0, None)], "k int, area double, use string")
    b = spark.createDataFrame([(1, 200.0, "farm"), (2, 5.0, "farm")], "k int, area double, use string")
    out = entities.merge_attributes(a, b, ["k"], ["area", "use"], "area", 50.0)
    assert sorted(tuple(r) for r in out.collect()) == [(1, 100.0, "farm", 200.0), (2, 5.0, "x", None), (3, 100.0, None, None)]


def test_majority_address_takes_complete_ones_first(spark):
    df = spark.createDataFrame([(1, "a", False, 1), (1, "a", False, 2), (1, "b", True, 3), (2, "a", False, 1), (2, "b", False, 2)], "doc int, place string, full boolean, at int")
    assert sorted(map(tuple, entities.majority_address(df, ["doc"], ["place"], "full", "at").collect())) == [(1, "b"), (2, "a")]


def test_geojson_closes_rings_and_leaves_other_shapes_out(spark):
    shape = '{"features":[{"geometry":{"type":"Polygon","coordinates":[[[0,0],[2,0],[2,1]]]},"properties":{"number":"n","area":3}},{"geometry":{"type":"Point","coordinates":[1,2]},"properties":{}}]}'
    df = spark.createDataFrame([(shape,), ("no json",), (None,)], "doc string")
    rows = files.geojson_parcels(df, "doc").collect()
    assert [(r.number, r.ring[0] == r.ring[-1], len(r.ring), r.x1, r.y1) for r in rows] == [("n", True, 4, 2.0, 1.0)]
