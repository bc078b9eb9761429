"""Ads and lots under one schema, and the flat extract: fields that are missing, of another type, or told in several places."""

import datetime

import pytest
from pyspark.sql import functions as F

from terrane.functions import listings as L
from terrane.operators import unified as U

RATE, AT = 40.0, datetime.datetime(2024, 5, 6)
ADDRESS = "struct<region:string,district:string,settlement:string,city_district:string,settlement_type:string,street:struct<street_type:string,name:string>,building:string,is_complete:boolean>"
AD = f"url string, updated_at string, is_active boolean, search_data struct<title:string,price_value:string,currency:string,area_m2:string>, addresses array<{ADDRESS}>, cadastral_numbers array<string>, detail struct<description:string,price:struct<value:string,currency:string>,llm:struct<property_type:string,building_area_sqm:string,land_area_sqm:string,land_area_ha:string,floor:string,tags:array<string>>>, price_uah double"
ITEM = "struct<code:string,props:string,land_area:double,building_area:double,unit:string>"
LOT = f"auction_id string, addresses array<{ADDRESS}>, auction_data struct<dateModified:string,status:string,title:struct<uk_UA:string,en_US:string,ru_RU:string>,id:string,value:struct<amount:double>,items:array<{ITEM}>>"


def at(region=None, city=None, complete=False, house=None, street=None, kind=None):
    return (region, None, city, None, kind, street, house, complete)


def ad(url, price=(None, None), card=(None, None), areas=(None, None, None), card_area=None, active=None, updated=None, addresses=None, tags=None, kind=None, floor=None):
    return (url, updated, active, ("дім", *card, card_area), addresses, None, (None, price, (kind, *areas, floor, tags)), -1.0)


def test_ads(spark):
    rows = [
        ad("usd", price=("100", " usd "), card=("5", "UAH"), areas=("50", None, "2"), updated="2024-01-02T03:04:05Z"),
        ad("eur", card=("10", "EUR"), card_area="30", active=False),
        ad("other", card=("7", "PLN"), areas=("", "500", "9"), card_area="30"),
        ad("none", price=("-1", "UAH"), card=("5", "UAH"), updated="soon", kind="Земля с/г"),
        ad("none", price=("dear", None), floor="3", tags=["a"]),
    ]
    got = U.from_ads(spark.createDataFrame(rows, AD), "ads", RATE, AT).collect()
    by = {r.source_id: r for r in got[:3]}
    assert len(got) == 5 and [r.source_id for r in got].count("none") == 2
    assert (by["usd"].price_uah, by["usd"].price_usd, by["usd"].price_per_m2_uah, by["usd"].price_per_ha_usd) == (4000, 100, 80, 50)
    assert (by["usd"].building_area_sqm, by["usd"].land_area_sqm, by["usd"].source_updated_at.year) == (50, 20_000, 2024)
    assert (by["eur"].price_uah, by["eur"].building_area_sqm, by["eur"].status) == (pytest.approx(440), 30, U.INACTIVE)
    assert (by["other"].price_uah, by["other"].building_area_sqm, by["other"].land_area_sqm, by["other"].status) == (7, None, 500, U.ACTIVE)
    priced = [(r.price_uah, r.currency_rate, r.floor, r.tags, r.source_updated_at) for r in got[3:]]
    assert priced == [(None, None, "", [], datetime.datetime(2024, 5, 6)), (None, None, "3", ["a"], datetime.datetime(2024, 5, 6))]
    assert got[3].property_type == L.FARMLAND


def test_lots(spark):
    land, house = ("06", None, 2.0, None, "га"), ("04", None, None, 70.0, "м²")
    rows = [
        ("a", [at("Р", "М")], ("2024-02-03", "active.tendering", (None, "lot", None), "i", (100.0,), [land, land, house])),
        ("b", None, ("", "complete", (None, "", None), "i", (0.0,), [None, (None, None, -1.0, None, None)])),
        ("c", None, (None, None, None, None, None, None)),
        ("d", None, None),
    ]
    a, b, c, d = U.from_lots(spark.createDataFrame(rows, LOT), "lots", RATE, "https://x/", AT).orderBy("source_id").collect()
    assert (a.land_area_sqm, a.building_area_sqm, a.price_per_ha_uah, a.title, a.status, a.property_type) == (40_000, 70, 25, "lot", U.ACTIVE, L.LAND_AND_BUILDING)
    assert (a.page_url, a.region, a.city) == ("https://x/a", "Р", "М")
    assert (b.land_area_sqm, b.price_uah, b.title, b.status) == (None, None, "i", U.INACTIVE)
    assert [(r.status, r.title, r.description, r.land_area_sqm, r.property_type) for r in (c, d)] == [(U.INACTIVE, "", "", None, L.OTHER)] * 2


@pytest.mark.parametrize("addresses,region", [
    (None, None), ([], None), ([at(" ")], None), ([at("А"), at("Б"), at(" Б")], "Б"), ([at("А"), at("Б")], "А"),
    ([at("А"), at("А"), at("Б", complete=True)], "Б"), ([at("А"), at(None, complete=True)], "А"), ([None, at("А")], "А"), ([at("Б"), at("А"), at("А"), at("Б")], "Б"),
])
def test_root_place(spark, addresses, region):
    df = spark.createDataFrame([(addresses,)], f"addresses array<{ADDRESS}>")
    assert df.select(U.root_place(F.col("addresses"), "region")).first()[0] == region


def test_fields_that_a_source_lacks(spark):
    ads = spark.createDataFrame([("u", 3)], "url string, detail int")
    lots = spark.createDataFrame([("l", ("t", 9.0))], "auction_id string, auction_data struct<title:string,value:double>")
    (x,), (y,) = U.from_ads(ads, "ads", RATE, AT).collect(), U.from_lots(lots, "lots", RATE, at=AT).collect()
    assert (x.source_id, x.price_uah, x.region, x.tags, x.status) == ("u", None, None, [], U.ACTIVE)
    assert (y.title, y.price_uah, y.price_usd, y.city) == ("t", 9, 0.225, None)
    assert U.flat_extract(U.from_ads(ads, "ads", RATE, AT)).first().street == ""


def test_flat_extract(spark):
    rows = [
        ad("u", addresses=[at("А", "В"), at("Б", "Г", True, "7", ("вулиця", "Тиха"), "село")], floor="2"),
        ad("none", areas=(None, "0", None)), ad(""), ad(None),
    ]
    got = {r.source_id: r for r in U.flat_extract(U.from_ads(spark.createDataFrame(rows, AD), "ads", RATE, AT)).collect()}
    u, none = got["u"], got["none"]
    assert set(got) == {"u", "none"}
    assert (u.region, u.city, u.settlement, u.settlement_type, u.street_type, u.street, u.building, u.floor) == ("Б", "Г", "Г", "село", "вулиця", "Тиха", "7", "2")
    assert (none.region, none.street, none.building, none.floor, none.land_area_sqm, none.source_date, none.listing_url) == ("", "", "", None, None, "2024-05-06", "none")


def test_plain_streets_and_empty_tables(spark):
    df = spark.createDataFrame([("u", [("А", "вул. Тиха", True)])], "url string, addresses array<struct<region:string,street:string,is_complete:boolean>>")
    assert U.flat_extract(U.from_ads(df, "ads", RATE, AT)).select("region", "street_type", "street").first()[:] == ("А", "", "вул. Тиха")
    assert U.flat_extract(U.from_lots(spark.createDataFrame([], LOT), "lots", RATE)).collect() == []


def test_places_of_documents(spark):
    ref = "struct<region:struct<name:string>,city:struct<name:string>>"
    schema = f"url string, search_data struct<location:string>, detail struct<address_refs:array<{ref}>,resolved_locations:array<struct<results:array<struct<address_structured:struct<region:string,settlement:string>>>>>>"
    rows = [
        ("ref", None, ([None, (("Львівська область",), ("Стрий",))], None)),
        ("text", ("стрий, Львівська",), None),
        ("deep", (None,), (None, [None, ([None, (None,), (("Львівська", "Стрий"),)],)])),
        ("other", ("Київ",), ([((None,), None)], [])),
        ("none", None, None),
    ]
    df = spark.createDataFrame(rows, schema)
    found = lambda cities, regions: {r.url for r in df.where(U.in_places(df, U.AD_PLACES, cities, regions)).collect()}
    assert found([], ["Львівська область"]) == found([], [" львівська "]) == found(["Стрий"], []) == {"ref", "text", "deep"}
    assert found(["Київ"], ["Львівська"]) == {"ref", "text", "deep", "other"}
    assert found([], []) == found([" "], []) == {"ref", "text", "deep", "other", "none"}
    assert found(["К.їв"], []) == found(["Одеса"], ["Одеська"]) == set()


def test_places_where_no_path_is_present(spark):
    df = spark.createDataFrame([("a",)], "auction_id string")
    assert df.where(U.in_places(df, U.LOT_PLACES, ["Київ"], [])).count() == 0 and df.where(U.in_places(df, U.LOT_PLACES, [], [])).count() == 1
