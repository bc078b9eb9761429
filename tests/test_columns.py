"""Column functions on inline rows, one table of cases for each."""

import math

import pytest
from pyspark.sql import functions as F

from terrane.functions import columns as C
from terrane.functions import listings as L
from terrane.functions import places as P


def values(spark, rows, schema, column):
    df = spark.createDataFrame([(i, *r) if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r[0] for r in df.select("i", column.alias("v")).orderBy("i").select("v").collect()]


def test_negations_keep_nulls(spark):
    rows = ["a", "b", None]
    assert values(spark, rows, "x string", C.differs(F.col("x"), "a")) == [False, True, True]
    assert values(spark, rows, "x string", C.not_in(F.col("x"), ["a"])) == [False, True, True]
    assert values(spark, rows, "x string", C.none_of(F.col("x") == "a", F.col("x") == "b")) == [False, False, True]
    assert values(spark, rows, "x string", C.lacks(F.col("x"), "A")) == [False, True, True]


def test_a_filter_and_its_negation_split_the_rows(spark):
    c = F.col("x") == "a"
    rows = ["a", "b", None, ""]
    yes, no = values(spark, rows, "x string", F.coalesce(c, F.lit(False))), values(spark, rows, "x string", C.negated(c))
    assert [a != b for a, b in zip(yes, no, strict=True)] == [True] * 4


def test_filled_and_empty(spark):
    assert values(spark, ["x", "", None], "x string", F.coalesce(C.filled(F.col("x")), F.lit(False))) == [True, False, False]
    assert values(spark, ["x", "", None], "x string", C.empty(F.col("x"))) == [False, True, True]


def test_contains_folds_every_alphabet_and_takes_text_literally(spark):
    assert values(spark, ["КИЇВ", "Львів", "a.b"], "x string", C.contains(F.col("x"), "київ")) == [True, False, False]
    assert values(spark, ["axb", "a.b"], "x string", C.contains(F.col("x"), "a.b")) == [False, True]


def test_elem_match_on_missing_arrays(spark):
    assert values(spark, [([1, 5],), ([],), (None,)], "x array<int>", C.elem_match(F.col("x"), lambda v: v > 4)) == [True, False, False]


@pytest.mark.parametrize(("text", "want"), [("12 500,50", 12500.5), ("12 500", 12500.0), ("", None), ("договірна", None), (None, None), ("7.25", 7.25)])
def test_number(spark, text, want):
    assert values(spark, [text], "x string", C.number(F.col("x"))) == [want]


def test_unit_price_needs_both_positive(spark):
    assert values(spark, [(100.0, 4.0), (100.0, 0.0), (100.0, -1.0), (100.0, None), (0.0, 5.0)], "p double, a double", C.unit_price(F.col("p"), F.col("a"))) == [25.0, None, None, None, None]


def test_square_metres(spark):
    rows = [(2.0, "соток"), (0.5, "га"), (3.0, None), (1.0, "акр"), (7.0, "кв.м")]
    assert values(spark, rows, "v double, u string", C.square_metres(F.col("v"), F.col("u"))) == [200.0, 5000.0, 3.0, 4046.86, 7.0]


def test_week_key_at_year_ends(spark):
    assert values(spark, ["2026-12-31", "2027-01-01", "2024-12-30"], "x string", C.week_key(F.to_date("x"))) == ["2026-W53", "2026-W53", "2025-W01"]


def test_position_label_on_each_fence(spark):
    q = [F.lit(float(x)) for x in (100, 200, 300, 500)]
    label = C.position_label(F.col("x"), *q)
    rows = [-200.1, -200.0, 100.0, 250.0, 400.0, 600.0, 600.1]
    assert values(spark, rows, "x double", label) == ["abnormally_low", "good", "good", "below_average", "average", "above_average", "abnormally_high"]
    same = C.position_label(F.col("x"), *[F.lit(100.0)] * 4)
    assert values(spark, [92.0, 100.0, 108.0], "x double", same) == ["abnormally_low", "good", "abnormally_high"]


@pytest.mark.parametrize(
    ("code", "want"),
    [
        ("6310138500:10:012:0045", ("63", "10", "012", "0045")),
        (" 6310138500 : 10 : 012 : 0045 ", ("63", "10", "012", "0045")),
        ("3200000000:00:001:0001", ("32", "00", "001", "0001")),
        ("6310138500100120045", ("63", "10", "012", "0045")),
        ("6310138500:10:012", ("63", "10", "012", None)),
        ("123", (None, None, None, None)),
        (None, (None, None, None, None)),
    ],
)
def test_cadastral_parts(spark, code, want):
    p = C.cadastral_parts(F.col("x"))
    got = values(spark, [code], "x string", F.struct(p["oblast_code"], p["zone"], p["quarter"], p["parcel"]))
    assert tuple(got[0]) == want


def test_description_hash_ignores_blank_lines_and_indents(spark):
    a, b, c = values(spark, ["x\n\n  y ", "x\ny", "x y"], "x string", C.description_hash(F.col("x")))
    assert a == b != c


def test_urls_and_phones(spark):
    assert values(spark, ["https://a/b?c=1#d", "https://a/b"], "x string", C.canonical_url(F.col("x"))) == ["https://a/b"] * 2
    assert values(spark, ["(067) 123-45-67", "380671234567", "12"], "x string", C.phone(F.col("x"))) == ["+380671234567", "+380671234567", None]


def test_names_of_places(spark):
    assert values(spark, ["Волинській області", "Київська область", "Львівська"], "x string", P.region_name(F.col("x"))) == ["Волинська", "Київська", "Львівська"]
    assert values(spark, ["м. Київ", "село Гора", "Київ"], "x string", P.settlement_name(F.col("x"))) == ["Київ", "Гора", "Київ"]


def test_areas_in_text(spark):
    rows = ["будинок 65 м², ділянка 0,5 га", "10 соток та 2,5 сотки", "без площі", None]
    assert values(spark, rows, "x string", C.building_area(F.col("x"))) == [65.0, None, None, None]
    assert values(spark, rows, "x string", F.round(C.land_hectares(F.col("x")), 6)) == [0.5, 0.125, None, None]
    more = ["1 200 м²", "1\u00a0200,5 кв.м та 20 м2", "кв. 5 65 м²", "площа: 85", "площа 85 соток", "м² 12"]
    assert values(spark, more, "x string", C.building_area(F.col("x"))) == [1200.0, 1220.5, 65.0, 85.0, None, None]


def test_short_words_stand_alone(spark):
    texts = ["Продам дім, місто Київ, простора кухня", "Станція СТО", "Барвінок біля бару", "цех, склад", None]
    assert values(spark, texts, "x string", F.array_join(L.uses_in_text(F.col("x")), ",")) == ["", "автосервіс", "", "склад,виробництво", ""]


def test_place_tree(spark):
    schema = "city string, region string, addresses array<struct<settlement:string,region:string,latitude:double,longitude:double>>"
    rows = [("Київ", None, None), (None, "Одеська", [("Київ", "Київська", 50.4, 30.5)]), ("Суми", "Сумська", []), (None, None, None)]
    tree = lambda p: values(spark, rows, schema, P.located(p, F.col("city"), F.col("region"), F.col("addresses")))
    assert tree(P.Places(["Київ"])) == [True, True, False, False]
    assert tree(P.Places([], ["Одеська", "Сумська"])) == [False, True, True, False]
    assert tree(P.Places(not_regions=["Одеська"])) == [True, False, True, True]
    assert tree(P.Places(["Київ"], [], [], [], (50.45, 30.52, 10.0))) == [False, True, False, False]
    assert tree(P.Places()) == [True] * 4


def test_distances(spark):
    km = values(spark, [(50.45, 30.52)], "a double, b double", C.kilometres(F.col("a"), F.col("b"), F.lit(49.84), F.lit(24.03)))[0]
    assert math.isclose(km, 468, rel_tol=0.01)
    near = C.nearest_address_km(F.col("x"), F.lit(50.45), F.lit(30.52))
    assert values(spark, [([(50.45, 30.52), (49.84, 24.03)],), ([],), (None,)], "x array<struct<latitude:double,longitude:double>>", near) == [0.0, None, None]


def test_place_predicates_use_root_or_any_address(spark):
    schema = "city string, addresses array<struct<settlement:string>>"
    rows = [("Київ", None), (None, [("Львів",), ("Київ",)]), ("Львів", [("Львів",)]), (None, None)]
    yes = C.inside(F.col("city"), F.col("addresses"), "settlement", "київ")
    assert values(spark, rows, schema, yes) == [True, True, False, False]
    assert values(spark, rows, schema, C.not_inside(F.col("city"), F.col("addresses"), "settlement", "київ")) == [False, False, True, True]


def test_changes_within_a_tolerance(spark):
    rows = [(1.0, 1.0000001), (1.0, 1.1), (None, 1.0), (None, None)]
    assert values(spark, rows, "a double, b double", C.changed(F.col("a"), F.col("b"), 1e-6)) == [False, True, True, False]


def test_currency_and_type(spark):
    rows = [(10.0, "USD"), (10.0, "EUR"), (10.0, "UAH"), (10.0, None)]
    assert values(spark, rows, "a double, c string", F.round(C.in_home_currency(F.col("a"), F.col("c"), F.lit(40.0)), 6)) == [400.0, 440.0, 10.0, 10.0]
    assert values(spark, [(1.0, 1.0), (0.0, 1.0), (1.0, None), (None, None)], "b double, l double", C.listing_type(F.col("b"), F.col("l"))) == ["mixed", "land", "real_estate", "general"]


def test_prices_places_and_streets_in_text(spark):
    assert values(spark, ["від 12 500,50 грн до 99", "50", None], "x string", C.price_in_text(F.col("x"))) == [12500.5, None, None]
    p = C.place_and_date(F.col("x"))
    assert [tuple(v) for v in values(spark, ["Київ - Центр - Сьогодні", "Львів"], "x string", F.struct(p["place"], p["date"]))] == [("Київ - Центр", "Сьогодні"), ("Львів", None)]
    s = P.street_and_house(F.col("x"))
    assert [tuple(v) for v in values(spark, ["вул. Незалежності, 12а", "вул. Нова"], "x string", F.struct(s["street"], s["house"]))] == [("Незалежності", "12а"), ("Нова", None)]
