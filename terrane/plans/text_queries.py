"""What descriptions, parameters and names of places say, over texts made from the driver's tables, with their SQL.

Each text is chosen by a row's key from a few that differ in what matters, so that a wrong reading shows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.functions import columns as C
from terrane.functions import listings as L
from terrane.functions import places as P
from terrane.functions import texts as X
from terrane.plans.market_queries import ORACLE_SQL, QUERIES
from terrane.plans.queries import query
from terrane.sources import files
from terrane.sources.storage import table

__all__ = ["ORACLE_SQL", "QUERIES"]


def said(spark, d, *texts: str | None):
    """p_partkey, p_size and text: the texts in turn by p_partkey, with %d for p_size."""
    i = (F.col("p_partkey") % len(texts)).cast("int")
    text = F.get(F.array(*[F.lit(t) for t in texts]), i)
    return table(spark, d, "part").select("p_partkey", "p_size", F.replace(text, F.lit("%d"), F.col("p_size").cast("string")).alias("text"))


def cases(name: str, *values: str, kind: str = "varchar") -> str:
    """SQL of the value for each text."""
    return f"(case p_partkey % {len(values)} " + " ".join(f"when {i} then {v}" for i, v in enumerate(values)) + f" end)::{kind} as {name}"


@query(f"select p_partkey, {cases('price', 'p_size * 1000 + 500.0', '25000.5', 'null', '900000.0', kind="double")} from part")
def t2_price_in_text(spark, d):
    t = table(spark, d, "part")
    return t.select("p_partkey", C.price_in_text(F.get(F.array(F.concat(F.lit("Ціна "), (F.col("p_size") * 1000 + 500).cast("string"), F.lit(" грн, тел. 12")), F.lit("25 000,5 грн (торг 300)"), F.lit("договірна, 99"), F.lit("від 450 000 до 900 000")), (F.col("p_partkey") % 4).cast("int"))).alias("price")).select("p_partkey", "price")


@query(f"select p_partkey, {cases('sqm', '1200.0', 'p_size + 65.5', 'p_size::double', 'null', '85.0', '45.0', kind="double")} from part")
def t3_t8_building_area(spark, d):
    t = said(spark, d, "Будівля 1 200 м² у центрі", "Площа 65,5 м2, склад %d кв. м", "загальна площа: %d кв.м", "ділянка 5 соток", "площею 85, перший поверх", "кв. 5, кімната 20 м², кухня 25м2")
    return t.select("p_partkey", C.building_area(F.col("text")).alias("sqm"))


@query(f"select p_partkey, {cases('ha', '0.5', 'p_size * 0.01', '2.25', 'null', '1.1', '3.0', kind="double")} from part")
def t8_land_hectares(spark, d):
    t = said(spark, d, "Земля 0,5 га біля лісу", "Ділянка %d соток", "2 га та 25 сотих", "будинок 120 м²", "1 гектар і 10 сотками більше", "площа ділянки 3, рівна")
    return t.select("p_partkey", F.round(C.land_hectares(F.col("text")), 6).alias("ha"))


@query(f"select p_partkey, {cases('place', repr('Київ, Печерський'), repr('Львів - центр'), repr('Одеса'), 'null')}, {cases('day', repr('04 лютого 2026 р.'), repr('Сьогодні о 07:28'), 'null', 'null')} from part")
def t4_place_and_date(spark, d):
    t = said(spark, d, "Київ, Печерський - 04 лютого 2026 р.", "Львів - центр - Сьогодні о 07:28", "Одеса", None)
    parts = C.place_and_date(F.col("text"))
    return t.select("p_partkey", parts["place"].alias("place"), parts["date"].alias("day"))


@query(f"""select p_partkey, {cases('total_area_m2', '80.5', 'p_size', 'null', kind="double")}, {cases('floor', '3', 'null', 'null', kind="int")}, {cases('floors_total', '9', 'p_size', 'null', kind="int")},
{cases('object_type', repr('Офіс'), 'null', 'null')}, {cases('heating', 'null', repr('Газове'), 'null')}, {cases('is_business', 'true', 'false', 'false', kind="bool")}, {cases('no_commission', 'false', 'true', 'false', kind="bool")}, {cases('n_flags', '1', '2', '0', kind="int")} from part""")
def t7_parameters(spark, d):
    pair = lambda a, b: F.struct(F.lit(a).alias("label"), F.lit(b).cast("string").alias("value"))
    size = F.col("p_size").cast("string")
    first = F.array(pair("Загальна площа:", "80,5 м²"), pair("Поверх", "3 з 9"), pair("Поверховість", "9"), pair("Тип об'єкта", " Офіс "), pair("Бізнес", None))
    second = F.array(pair("загальна площа", F.concat(size, F.lit(" м²"))), pair("Поверх", "цоколь"), pair("Поверховість", size), pair("Опалення", "Газове"), pair("Без комісії", ""), pair("Торг", None))
    k = F.col("p_partkey") % 3
    items = F.when(k == 0, first).when(k == 1, second)
    out = table(spark, d, "part").select("p_partkey", X.parameters(items).alias("x"))
    return out.select("p_partkey", "x.total_area_m2", "x.floor", "x.floors_total", "x.object_type", "x.heating", "x.is_business", "x.no_commission", F.coalesce(F.size("x.raw_flags"), F.lit(0)).alias("n_flags"))


@query(f"""select p_partkey, {cases('number', repr('6310138500:10:012:0045'), repr(''), repr(''), repr(''))}, {cases('region', repr('Харківська'), repr(''), repr('Волинська'), 'null')}, {cases('settlement', repr('Чугуїв'), repr('Київ'), repr(''), 'null')},
{cases('street', repr('Незалежності'), repr('Івана Богуна'), repr(''), 'null')}, {cases('building', repr('5'), 'p_size::varchar', repr(''), 'null')}, {cases('floor', repr(''), repr('3'), repr(''), repr('2'))},
{cases('property_type', repr('Земля під будівництво'), repr(''), repr('Землі с/г призначення'), repr('Нерухомість'))}, {cases('utilities', repr('електрика, вода'), repr('газ'), repr('відсутні'), repr('опалення'))}, {cases('tags', repr('вода,електрика'), repr('офіс,газ'), repr('газ'), repr('склад,опалення'))} from part""")
def t8_described(spark, d):
    t = said(
        spark, d,
        "Земельна ділянка 6310138500:10:012:0045, Харківська область, м. Чугуїв, вул. Незалежності, 5. Світло, вода.",
        "Офіс на 3 поверсі, м. Київ, вулиця Івана Богуна %d, газ",
        "Пай с/г призначення, Волинська обл., газ не підведені",
        "Нерухомість: склад, 2-й поверх, опалення",
    )
    t = t.repartition(spark.sparkContext.defaultParallelism)  # a small file is one partition, its patterns take long
    out = t.select("p_partkey", X.described(F.col("text")).alias("x"))
    a = F.col("x.address")
    return out.select("p_partkey", F.col("x.cadastral_number").alias("number"), a["region"].alias("region"), a["settlement"].alias("settlement"), a["street"].alias("street"), a["building"].alias("building"), "x.floor", "x.property_type", "x.utilities", F.array_join("x.tags", ",").alias("tags"))


@query(f"select p_partkey, {cases('enough', 'true', 'true', 'true', 'false', kind="bool")} from part")
def t9_told_enough(spark, d):
    t = said(spark, d, "склад 40 м²", "5 соток", "вул. Тиха, 3", "гарний вид")
    x = X.described(F.col("text"))
    return t.select("p_partkey", L.told_enough(x["building_area_sqm"], x["land_area_ha"], F.when(x["address"].isNotNull(), F.array(x["address"]))).alias("enough"))


@query(f"select p_partkey, {cases('name', repr('Волинська'), repr('Київська'), repr('Вінницька'), repr('Львівська'), 'null', repr('Одеська'))}, {cases('canonical', repr('Волинська область'), repr('Київська область'), repr('Вінницька область'), repr('Львівська область'), 'null', repr('Одеська область'))} from part")
def t12_region_names(spark, d):
    t = said(spark, d, "Волинській області", "Київська обл.", "Вінницьку", "Львівської  область", " ", "Одеською обл")
    return t.select("p_partkey", P.region_name(F.col("text")).alias("name"), P.canonical_region(F.col("text")).alias("canonical"))


@query(f"select p_partkey, {cases('canonical', repr('м. Київ'), repr('м. Севастополь'), repr('АР Крим'), repr('Івано-Франківська область'), 'null', repr('Чернігівська область'), repr('АР Крим'))} from part")
def t12_special_regions(spark, d):
    t = said(spark, d, "Київ місто", "м.Севастополь", "Автономна Республіка Крим", "івано франківська обл.", "Мордор", "о. Чернігівська", "АР Крим")
    return t.select("p_partkey", P.canonical_region(F.col("text")).alias("canonical"))


@query(f"select p_partkey, {cases('name', repr('Київ'), repr('Львів'), repr('Гора'), repr('Івано-Франківськ'), repr('Бровари'), 'null', repr('Місточко'))} from part")
def t13_settlement_names(spark, d):
    t = said(spark, d, "у Києві", "м. Львів", "село Гора", "в Івано-Франківську", "смт. Бровари", "", "Місточко")
    return t.select("p_partkey", P.settlement_name(F.col("text")).alias("name"))


@query(f"select p_partkey, {cases('chernihiv', 'true', 'true', 'true', 'false', 'false', 'false', kind="bool")}, {cases('crimea', 'false', 'false', 'false', 'true', 'false', 'false', kind="bool")}, {cases('kyiv', 'false', 'false', 'false', 'false', 'true', 'false', kind="bool")} from part")
def t14_region_patterns(spark, d):
    t = said(spark, d, "Ділянка, Чернігівська обл., ліс", "о. Чернігівська", "у ЧЕРНІГІВСЬКІЙ області", "АР Крим, Ялта", "м. Київ", "Київська область, Чернігів")
    has = lambda region: P.names_region(F.col("text"), region)
    return t.select("p_partkey", has("Чернігівська область").alias("chernihiv"), has("АР Крим").alias("crimea"), has("м. Київ").alias("kyiv"))


@query(f"""select p_partkey, {cases('name', repr("Солом''янський").replace('"', "'"), repr('Печерський'), 'null', repr('Дніпровський'), 'null', 'null')}, {cases('found', repr("Солом''янський").replace('"', "'"), repr('Печерський'), repr('Оболонський'), repr('Дніпровський'), 'null', repr("Солом''янський").replace('"', "'"))} from part""")
def t15_districts(spark, d):
    t = said(spark, d, "в Соломянському районі", "Печерський район", "квартира, Оболонський район, метро", "дніпровського", "центр", "Київ, Солом’янський")
    return t.select("p_partkey", P.district_name(F.col("text")).alias("name"), P.district_in_text(F.col("text")).alias("found"))


@query(f"""select p_partkey, {cases('city', repr('Київ'), repr('Львів'), repr('Одеса'), 'null')}, {cases('district', repr("Солом''янський").replace('"', "'"), repr('Сихів'), 'null', 'null')}, {cases('same', 'true', 'false', 'false', 'null', kind="bool")} from part""")
def t15_city_and_district(spark, d):
    t = said(spark, d, "Київ, Соломянський", "Львів, Сихів", "Одеса", None)
    parts = P.city_and_district(F.col("text"))
    return t.select("p_partkey", parts["city"].alias("city"), parts["district"].alias("district"), F.trim(F.regexp_replace("text", "^[^,]*,", "")).rlike(P.district_pattern("Солом'янський")).alias("same"))


@query(f"select p_partkey, {cases('street', repr('Соборності'), repr('Соборності'), repr('Івана Богуна'), repr('Хрещатик'), repr('Тиха'), 'null')}, {cases('house', repr('7'), 'p_size::varchar', 'null', repr('15а'), 'null', 'null')} from part")
def t16_street_address(spark, d):
    t = said(spark, d, "вул. Соборності, 7 корпус А", "вул. Соборності %d", "вулиця Івана Богуна", "Хрещатик, 15а", "пров. Тиха, корпус Б", "")
    parts = P.street_and_house(F.col("text"))
    return t.select("p_partkey", parts["street"].alias("street"), parts["house"].alias("house"))


@query("select p_partkey, md5(concat_ws('|', lower(trim(p_name)), p_brand, p_size::varchar, p_type)) as card, md5(lower(trim(regexp_replace(p_name || '  , Київ', '\\s+', ' ', 'g')))) as geocode from part")
def t18_card_and_query_hashes(spark, d):
    t = table(spark, d, "part")
    card = C.card_hash(F.lower(F.trim("p_name")), F.col("p_brand"), F.col("p_size").cast("string"), F.col("p_type"))
    return t.select("p_partkey", card.alias("card"), C.query_hash(F.concat(F.col("p_name"), F.lit("  , Київ"))).alias("geocode"))


@query("select o_orderkey, case when o_orderkey % 4 = 1 then 'A' || o_orderkey when o_orderkey % 4 in (2, 3) then 'B' || o_orderkey else o_orderkey::varchar end as id from orders")
def t19_id_by_priority(spark, d):
    k = F.col("o_orderkey")
    first, second = F.when(k % 4 == 1, F.concat(F.lit("A"), k)).when(k % 4 == 2, ""), F.when(k % 4 > 1, F.concat(F.lit("B"), k))
    return table(spark, d, "orders").select("o_orderkey", C.first_filled(first, second, k.cast("string")).alias("id"))


@query("select event_id, strftime(date_trunc('day', ts), '%Y-%m-%dT%H:%M:%S') as day_start, strftime(ts + interval 2 hours, '%d.%m.%Y %H:%M') as kyiv from events")
def t20_day_range_and_zone(spark, d):
    """Event times are UTC; January in Kyiv is two hours ahead."""
    ts = F.col("ts").cast("timestamp")
    return table(spark, d, "events").select("event_id", F.date_format(F.date_trunc("day", ts), "yyyy-MM-dd'T'HH:mm:ss").alias("day_start"), F.date_format(F.from_utc_timestamp(ts, "Europe/Kyiv"), "dd.MM.yyyy HH:mm").alias("kyiv"))


@query("select o_custkey, string_agg(distinct o_orderpriority, ',' order by o_orderpriority) as found from orders group by 1")
def t23_values_at_path(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.struct(F.array(F.struct("o_orderpriority"), F.struct(F.lit(None).cast("string").alias("o_orderpriority"))).alias("parts")).alias("doc"))
    nested = o.groupBy("o_custkey").agg(F.collect_list("doc").alias("docs"))
    return nested.select("o_custkey", F.array_join(F.array_sort(F.array_distinct(C.values_at(F.col("docs"), "parts", "o_orderpriority"))), ",").alias("found"))


@query(f"select p_partkey, {cases('first', 'date ' + repr('2024-01-05'), 'date ' + repr('2024-01-05'), 'null', kind="date")}, {cases('last', 'date ' + repr('2024-02-01'), 'date ' + repr('2024-02-01'), 'null', kind="date")} from part")
def t25_dates_in_file_names(spark, d):
    t = said(spark, d, "auctions_2024-01-05_2024-02-01.json", "лоти 05.01.2024-01.02.2024.xlsx", "latest.json")
    parts = files.dates_in_name(F.col("text"))
    return t.select("p_partkey", parts["first"].alias("first"), parts["last"].alias("last"))
