"""Searches, reports, profiles and state over unified listings, shown on the driver's tables, with their SQL.

Reading of the tables: an order is a listing; its customer's key gives its places, its own key its areas and its address.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrane.functions import columns as C
from terrane.functions import listings as L
from terrane.functions import places as P
from terrane.operators import changes, entities, groups, joins, profiles, search, stats
from terrane.plans.listing_queries import ORACLE_SQL, QUERIES, TILES_SQL, bounds, points
from terrane.plans.queries import placed, query
from terrane.sources import files
from terrane.sources.storage import scratch, stored, table
from terrane.sources.versions import Versions
from terrane.streaming import events as ev

__all__ = ["ORACLE_SQL", "QUERIES"]

REGIONS, CITIES = ["Київська", "Волинська", "Львівська", "Одеська"], ["Київ", "Луцьк", "Львів", "Одеса", "Суми"]
USD = 41.5


def _pick(values: list[str], index) -> F:
    """The value at index, or null beyond the list."""
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def unified(spark, d):
    """Listings under the common schema, from orders."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    address = F.struct(_pick(REGIONS, (c + 1) % 4).alias("region"), _pick(CITIES, (c + 2) % 5).alias("settlement"), (48 + k % 40 / 10.0).alias("latitude"), (24 + k % 70 / 10.0).alias("longitude"), (k % 2 == 0).alias("is_complete"), F.concat(F.lit("вул. Тиха, "), (k % 30).cast("string")).alias("street"))
    rows = table(spark, d, "orders").select(
        F.when(k % 2 == 0, "even").otherwise("odd").alias("source"),
        k.alias("source_id"),
        F.col("o_orderdate").alias("source_updated_at"),
        F.when(F.col("o_orderstatus") == "P", "неактивне").otherwise(search.ACTIVE).alias("status"),
        F.concat(F.lit("Лот "), "o_orderpriority").alias("title"),
        F.concat(F.lit("Опис "), F.col("o_orderpriority"), F.lit(" газ")).alias("description"),
        F.when(k % 4 == 0, L.LAND).when(k % 4 == 1, L.BUILDING).when(k % 4 == 2, L.LAND_AND_BUILDING).otherwise(L.OTHER).alias("property_type"),
        _pick(REGIONS, c % 5).alias("region"),
        _pick(CITIES, c % 6).alias("city"),
        F.when(k % 3 > 0, F.array(address)).otherwise(F.array().cast("array<struct<region:string,settlement:string,latitude:double,longitude:double,is_complete:boolean,street:string>>")).alias("addresses"),
        F.col("o_totalprice").alias("price_uah"),
        (10 + k % 90).cast("double").alias("building_area_sqm"),
        F.nullif((k % 7) * 1000.0, F.lit(0.0)).alias("land_area_sqm"),
        F.filter(F.array(F.col("o_custkey"), F.when(k % 2 == 0, F.col("o_custkey") + 1)), lambda x: x.isNotNull()).alias("real_estate_object_refs"),
    )
    return rows.withColumns(C.price_metrics(F.col("price_uah"), F.col("building_area_sqm"), F.col("land_area_sqm"), F.lit(USD)))


_LIST = lambda v: "[" + ", ".join(f"'{x}'" for x in v) + "]"
U = f"""u as (select if(o_orderkey % 2 = 0, 'even', 'odd') as source, o_orderkey as source_id, o_orderdate as source_updated_at, if(o_orderstatus = 'P', 'неактивне', 'активне') as status, 'Лот ' || o_orderpriority as title,
 'Опис ' || o_orderpriority || ' газ' as description, case o_orderkey % 4 when 0 then '{L.LAND}' when 1 then '{L.BUILDING}' when 2 then '{L.LAND_AND_BUILDING}' else '{L.OTHER}' end as property_type,
 {_LIST(REGIONS)}[o_custkey % 5 + 1] as region, {_LIST(CITIES)}[o_custkey % 6 + 1] as city, o_orderkey % 3 > 0 as placed, {_LIST(REGIONS)}[(o_custkey + 1) % 4 + 1] as a_region, {_LIST(CITIES)}[(o_custkey + 2) % 5 + 1] as a_city,
 48 + o_orderkey % 40 / 10.0 as lat, 24 + o_orderkey % 70 / 10.0 as lon, o_totalprice as price_uah, (10 + o_orderkey % 90)::double as building_area_sqm, nullif((o_orderkey % 7) * 1000.0, 0)::double as land_area_sqm, o_custkey as cust from orders)"""
LATEST = "(select max(o_orderdate) from orders)"


# scans and searches


@query("select c_custkey, c_name from customer where c_custkey = 7")
def s3_point_lookup(spark, d):
    return table(spark, d, "customer").where("c_custkey = 7").select("c_custkey", "c_name").limit(1)


@query("select exists(select 1 from orders where o_totalprice > 400000) as dear, exists(select 1 from orders where o_totalprice < 0) as negative")
def s5_exists(spark, d):
    o = table(spark, d, "orders")
    return spark.range(1).select(F.lit(search.exists(o, F.col("o_totalprice") > 400_000)).alias("dear"), F.lit(search.exists(o, F.col("o_totalprice") < 0)).alias("negative"))


@query("with p as (select o_orderkey, o_totalprice, count(*) over () as total from orders where o_orderstatus = 'F') select * from p order by o_totalprice desc, o_orderkey limit 20 offset 20")
def s6_o6_page_with_total(spark, d):
    rows, total = search.page(table(spark, d, "orders").where("o_orderstatus = 'F'"), [F.desc("o_totalprice"), F.col("o_orderkey")], 20, 20)
    return rows.select("o_orderkey", "o_totalprice").join(F.broadcast(total))


@query("select 'orders' as name, count(*) as n_rows, 'ok' as state from orders union all select 'part', count(*), 'ok' from part union all select 'nothing', 0, 'empty' union all select 'absent', null, 'missing'")
def s7_a34_table_counts(spark, d):
    o = table(spark, d, "orders")
    return profiles.table_counts(spark, {"orders": o, "part": table(spark, d, "part"), "nothing": o.limit(0), "absent": None})


@query("select n_nationkey, n_name from nation where n_regionkey = (select max(n_regionkey) from nation)")
def s13_latest_file(spark, d):
    """The regions' nations are exported one after another, and the export that was written last is read."""
    path, nations = scratch(spark, "files"), table(spark, d, "nation")
    for (region,) in nations.select("n_regionkey").distinct().orderBy("n_regionkey").collect():
        nations.where(F.col("n_regionkey") == region).coalesce(1).write.parquet(f"{path}/export={region}")
    newest = files.newest_file(spark, f"{path}/*", "^part-.*parquet$").first()["path"]
    return spark.read.parquet(newest).select("n_nationkey", "n_name")


_RELEVANT = "status = 'активне' and price_uah >= 50000 and price_uah <= 250000 and building_area_sqm >= 30 and land_area_sqm <= 0.4 * 10000 and title ilike '%low%' and price_uah / building_area_sqm >= 900 and (city ilike '%Львів%' or region ilike '%Волинська%' or (placed and (a_city ilike '%Львів%' or a_region ilike '%Волинська%')))"


@query(f"with {U} select source_id, price_uah from u where {_RELEVANT} and source_updated_at >= {LATEST} - interval 900 days and source = 'odd'")
def f14_search(spark, d):
    s = search.Search(region="Волинська", city="Львів", price_min=50_000.0, price_max=250_000.0, source="odd", building_area_sqm=("gte", 30.0), land_area_ha=("lte", 0.4), updated_days=900, title_contains="low", price_per_m2_min=900.0)
    u = unified(spark, d)
    now = table(spark, d, "orders").agg(F.max("o_orderdate").alias("now"))
    return u.join(F.broadcast(now)).where(search.predicate(s, F.col("now"))).select("source_id", "price_uah")


@query(f"with {U} select source_id, status from u where price_uah > 300000 and status = 'активне' union all select source_id, status from u where price_uah > 300000 and status = 'неактивне'")
def f13_default_status(spark, d):
    u = unified(spark, d)
    dear = {"price": F.col("price_uah") > 300_000}
    given = search.default_status(dear | {"status": F.col("status") == "неактивне"}, F.col("status"))
    return u.where(search.default_status(dear, F.col("status"))).unionByName(u.where(given)).select("source_id", "status")


@query("select o_custkey, count(*) = 3 as three from orders group by 1")
def f10_count_is(spark, d):
    sets = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("refs"))
    return sets.select("o_custkey", C.count_is(F.col("refs"), 3).alias("three"))


@query("select l_orderkey, l_linenumber from lineitem where (l_returnflag = 'A' or (l_quantity > 40 and l_tax > 0.04)) and not (l_discount = 0 or l_linestatus = 'F' or l_tax = 0.08)")
def f11_filter_tree(spark, d):
    c = F.col
    tree = P.all_of(P.any_of(c("l_returnflag") == "A", P.all_of(c("l_quantity") > 40, c("l_tax") > 0.04)), C.none_of(c("l_discount") == 0, c("l_linestatus") == "F", c("l_tax") == 0.08))
    return table(spark, d, "lineitem").where(tree).select("l_orderkey", "l_linenumber")


@query("select o_orderkey from orders where o_orderdate >= timestamp '1997-03-01' and o_orderdate <= timestamp '1997-03-20'")
def f12_date_between(spark, d):
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return table(spark, d, "orders").where(C.date_between(at("1997-03-01"), at("1997-03-20"), F.col("o_orderdate"))).select("o_orderkey")


@query("select event_type, count(*) filter (try_cast(regexp_extract(props, '[0-9]+') as double) is not null) as n_numbers, count(*) filter (try_cast(event_type as double) is not null) as n_named from events group by 1")
def f17_e12_is_number(spark, d):
    k = F.regexp_extract("props", "[0-9]+", 0)
    return table(spark, d, "events").groupBy("event_type").agg(F.count_if(C.is_number(k)).alias("n_numbers"), F.count_if(C.is_number(F.col("event_type"))).alias("n_named"))


@query(f"with {U}, r as (select * from u where price_uah > 100000) select 'excluded place' as rule, count(*) as count from r where region ilike '%Одеська%' or (placed and a_region ilike '%Одеська%') union all select 'no land_area_sqm', count(*) from r where land_area_sqm is null")
def f27_compliance(spark, d):
    u = unified(spark, d).where("price_uah > 100000")
    return search.violations(u, C.inside(F.col("region"), F.col("addresses"), "region", "Одеська"), ["price_uah", "land_area_sqm"])


@query("select p_partkey, p_brand from part where starts_with(p_brand, 'Brand#1') and p_name ilike '%1%'")
def f29_prefix_and_name(spark, d):
    return table(spark, d, "part").where(F.col("p_brand").startswith("Brand#1") & C.contains(F.col("p_name"), "1")).select("p_partkey", "p_brand")


@query("select l_orderkey, count(*) as n from lineitem group by 1 having bool_or(l_suppkey = 5) or (count(*) >= 6 and min(l_returnflag) = 'N')")
def f30_members(spark, d):
    sets = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("members"), F.count("*").alias("n"), F.min("l_returnflag").alias("flag"))
    return sets.where(F.array_contains("members", F.lit(5).cast("long")) | ((F.col("n") >= 6) & (F.col("flag") == "N"))).select("l_orderkey", "n")


# places

_CAP = "2 * 6378.1 * asin(sqrt(pow(sin((radians(50.45) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(50.45)) * pow(sin((radians(30.52) - radians(lon)) / 2), 2)))"


@query(f"with {U} select source_id from u where placed and {_CAP} <= 150")
def g3_in_radius(spark, d):
    return unified(spark, d).where(C.elem_match(F.col("addresses"), lambda a: P.within(a["latitude"], a["longitude"], (50.45, 30.52, 150.0)))).select("source_id")


@query("select c_custkey from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'EUROPE'")
def g4_in_hierarchy(spark, d):
    """Rows whose place lies anywhere below a place of the geography dimension."""
    below = table(spark, d, "nation").join(table(spark, d, "region").where("r_name = 'EUROPE'"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"))
    return table(spark, d, "customer").join(below, "c_nationkey", "left_semi").select("c_custkey")


_IN = "(city ilike '%{0}%' or (placed and a_city ilike '%{0}%'))"


@query(f"with {U} select source_id from u where coalesce({_IN.format('Київ')} or region ilike '%Львівська%' or (placed and a_region ilike '%Львівська%'), false) and not coalesce({_IN.format('Суми')}, false) and placed and {_CAP} <= 500")
def g5_g6_place_tree(spark, d):
    where = P.Places(["Київ"], ["Львівська"], ["Суми"], [], (50.45, 30.52, 500.0))
    return unified(spark, d).where(P.located(where, F.col("city"), F.col("region"), F.col("addresses"))).select("source_id")


@query(f"with {U} select source_id, source from u where case when source = 'even' then coalesce({_IN.format('Одеса')}, false) else coalesce(city ilike '%Одеса%', false) end")
def g7_g8_places_by_source(spark, d):
    """One source tells places in addresses as well, the other only at the root; a test on elements keeps rows single."""
    by_source = P.any_of((F.col("source") == "even") & C.inside(F.col("city"), F.col("addresses"), "settlement", "Одеса"), (F.col("source") == "odd") & C.contains(F.col("city"), "Одеса"))
    return unified(spark, d).where(by_source).select("source_id", "source")


@query(f"with {U} select source_id from u where price_uah > 400000")
def g9_retry_without_region(spark, d):
    u = unified(spark, d)
    return search.without_region_if_none(u, F.col("price_uah") > 400_000, F.col("region") == "Немає такої").select("source_id")


@query("select s_suppkey as id, 5 as n_points, (s_suppkey % 9 + 2)::double as width from supplier")
def g14_largest_ring(spark, d):
    k = F.col("s_suppkey")
    p = lambda x, y: F.array(x.cast("double"), y.cast("double"))
    box = lambda x, w: F.array(p(x, F.lit(0)), p(x + w, F.lit(0)), p(x + w, w), p(x, w))
    rings = F.array(box(k, F.lit(1.0)), box(k, k % 9 + 2.0), F.array(p(k, k), p(k, k)))
    ring = files.largest_ring(rings)
    return table(spark, d, "supplier").select(k.alias("id"), F.size(ring).alias("n_points"), (ring[1][0] - ring[0][0]).alias("width"))


@query(f"""with {TILES_SQL}, f as (select floor((min(lon) + 180) / 360 * 256) as x0, ceil((max(lon) + 180) / 360 * 256) - 1 as x1, floor((1 - asinh(tan(radians(max(lat)))) / pi()) / 2 * 256) as y0, ceil((1 - asinh(tan(radians(min(lat)))) / pi()) / 2 * 256) - 1 as y1 from p where lon < 30 and lat < 47)
select g.x, g.y, if(g.x between f.x0 and f.x1 and g.y between f.y0 and f.y1, 0, 1) as priority from g, f""")
def s14_tile_priority(spark, d):
    """The tiles over all customers' points; those that meet the box of the points in the south-west come first."""
    at = points(spark, d)
    return files.tile_cells(spark, *bounds(at), 8, bounds(at.where("lon < 30 and lat < 47"))).select("x", "y", "priority")


# state and reports


@query("select o_orderkey, o_orderstatus from orders")
def k1_append(spark, d):
    o, path = table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), scratch(spark, "append")
    o.where("o_orderkey % 2 = 0").write.parquet(path)
    o.where("o_orderkey % 2 = 1").write.mode("append").parquet(path)
    return spark.read.parquet(path)


@query("select o_orderstatus, count(*) as n from orders where o_orderkey % 3 = 0 group by 1")
def k8_rebuild(spark, d):
    """A new version replaces the old one whole; a reader of the old path still finds it."""
    path = scratch(spark, "rebuilt")
    for k in (2, 3):
        version = files.rebuild(table(spark, d, "orders").where(F.col("o_orderkey") % k == 0).groupBy("o_orderstatus").agg(F.count("*").alias("n")), path)
    return spark.read.parquet(version)


@query("select c_custkey::varchar as c_custkey, coalesce(case when c_custkey % 4 > 0 then c_name end, '') as c_name from customer")
def k11_report_csv(spark, d):
    path = scratch(spark, "report")
    files.write_csv(table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 > 0, F.col("c_name")).alias("c_name")), path, ",")
    return files.read_csv(spark, path, ",").na.fill("")


@query("select o_orderkey::varchar as source_id, o_custkey::varchar as first_ref, if(o_orderkey % 2 = 0, '[' || o_custkey || ',' || (o_custkey + 1) || ']', '[' || o_custkey || ']') as refs from orders where o_custkey = 3")
def k15_t24_flat_rows(spark, d):
    ids = table(spark, d, "orders").where("o_custkey = 3").select("o_orderkey")
    rows = files.rows_by_ids(unified(spark, d), "source_id", ids).select("source_id", F.col("real_estate_object_refs")[0].alias("first_ref"), F.col("real_estate_object_refs").alias("refs"))
    return files.flat(rows)


@query("select o_orderstatus as status, count(*) as n from orders group by 1")
def k16_report(spark, d):
    o = table(spark, d, "orders")
    parts = files.report([("states", o.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))), ("dear", groups.top_n(o, F.col("o_totalprice"), ["o_orderkey"], 10))], scratch(spark, "report"))
    return files.read_csv(spark, parts["states"], ",").select("status", F.col("n").cast("long").alias("n"))


@query("select p_partkey, p_brand from part where not starts_with(p_brand, 'Brand#2')")
def k19_delete_prefix(spark, d):
    return changes.delete_prefix(table(spark, d, "part"), "p_brand", "Brand#2").select("p_partkey", "p_brand")


@query("select event_id from events where event_id % 5 = 0 or ts + interval 3 days > (select max(ts) from events)")
def r13_expiry(spark, d):
    e = table(spark, d, "events")
    now = e.agg(F.max("ts").alias("now"))
    rows = e.withColumn("expires", F.when(F.col("event_id") % 5 > 0, F.col("ts") + F.expr("interval 3 days"))).join(F.broadcast(now))
    return changes.unexpired(rows, "expires", F.col("now")).select("event_id")


@query("select o_orderkey, o_totalprice + (o_orderkey % 10 = 5)::int as o_totalprice, if(o_orderkey % 10 in (0, 1, 2, 3, 4, 6), 1, 2) as batch from orders")
def r1_r6_promote(spark, d):
    """Raw rows move to the main table where they are new or changed; the others keep what they had."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    last = F.col("o_orderkey") % 10
    empty = o.limit(0).withColumns({"version_hash": F.lit(""), "promoted_at": F.lit(0)})
    main = stored(changes.promote(o.where(last < 7), empty, ["o_orderkey"], ["o_totalprice"], F.lit(1)), "main")
    raw = o.where(last > 3).withColumn("o_totalprice", F.col("o_totalprice") + (last == 5).cast("int"))
    return changes.promote(raw, main, ["o_orderkey"], ["o_totalprice"], F.lit(2)).select("o_orderkey", "o_totalprice", F.col("promoted_at").alias("batch"))


@query("select event_type, count(*) as n from events where ts >= (select max(ts) from events) - interval 10 days group by 1")
def r2_not_older(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    now = e.agg(F.max("ts").alias("now"))
    return ev.not_older(e.join(F.broadcast(now)), "ts", F.col("now"), 10).groupBy("event_type").agg(F.count("*").alias("n"))


@query("select count(distinct regexp_replace(trim(url), '[?#].*$', '')) as n from pages")
def r5_first_of_url(spark, d):
    p = table(spark, d, "pages").withColumns({"url": C.canonical_url(F.col("url")), "ts": F.timestamp_seconds("page_id")})
    return ev.first_of_key(p, ["url"], "ts").agg(F.count("*").alias("n"))


@query("select user_id, count(*) as n, max(event_id) as last from events group by 1")
def r1_micro_batches(spark, d):
    """The whole feed through a stream: each micro-batch is merged into the state's next version."""
    src, state = scratch(spark, "feed"), Versions(spark, scratch(spark, "state"))
    table(spark, d, "events").withColumn("part", F.col("event_id") % 3).write.partitionBy("part").parquet(src)

    def merge(batch, number):
        if state.entry()["batch"] >= number:  # it ran before, and its entry is there
            return
        new, old = batch.groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last")), state.read()
        both = new if old is None else old.unionByName(new)
        state.publish(both.groupBy("user_id").agg(F.sum("n").alias("n"), F.max("last").alias("last")), number)

    ev.run_available(ev.read_stream(spark, src), merge, scratch(spark, "offsets"))
    return state.read()


# projections


@query("select o_custkey, min(o_orderkey) as first_ref from orders group by 1 union all select -1, -1")
def p5_first_element(spark, d):
    sets = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("refs"))
    none = spark.range(1).select((F.col("id") - 1).alias("o_custkey"), F.array().cast("array<long>").alias("refs"))
    return sets.unionByName(none).select("o_custkey", C.first_of(F.col("refs"), -1).alias("first_ref"))


@query(f"with {U} select source_id, price_uah / {USD} as price_usd, price_uah / building_area_sqm as price_per_m2_uah, price_uah / {USD} / building_area_sqm as price_per_m2_usd, price_uah / (land_area_sqm / 10000.0) as price_per_ha_uah, price_uah / {USD} / (land_area_sqm / 10000.0) as price_per_ha_usd, land_area_sqm / 100.0 as sotky from u")
def p8_document_metrics(spark, d):
    return unified(spark, d).select("source_id", "price_usd", "price_per_m2_uah", "price_per_m2_usd", "price_per_ha_uah", "price_per_ha_usd", (F.col("land_area_sqm") / 100.0).alias("sotky"))


@query(f"""with {U} select source, source_id, 'https://x/' || source_id as listing_url, property_type, strftime(source_updated_at, '%Y-%m-%d') as source_date, coalesce(region, if(placed, a_region, null), '') as region, coalesce(city, if(placed, a_city, null), '') as settlement,
if(placed, 'Тиха', '') as street, if(placed, (source_id % 30)::varchar, '') as building, land_area_sqm, building_area_sqm, price_uah, price_uah / {USD} as price_usd, price_uah / building_area_sqm as price_per_m2_uah from u""")
def p13_extract_all_fields(spark, d):
    u = unified(spark, d).withColumns({"page_url": F.concat(F.lit("https://x/"), "source_id"), "best": L.best_address(F.col("addresses"))})
    parts = P.street_and_house(F.col("best.street"))
    return u.select(
        "source", "source_id", C.first_filled(F.col("page_url"), F.lit("")).alias("listing_url"), "property_type", C.day_key(F.col("source_updated_at")).alias("source_date"),
        L.root_or_address(F.col("region"), F.col("best"), "region").alias("region"), L.root_or_address(F.col("city"), F.col("best"), "settlement").alias("settlement"),
        F.coalesce(parts["street"], F.lit("")).alias("street"), F.coalesce(parts["house"], F.lit("")).alias("building"),
        F.when(F.col("land_area_sqm") > 0, F.col("land_area_sqm")).alias("land_area_sqm"), "building_area_sqm", "price_uah", "price_usd", "price_per_m2_uah",
    )


@query(f"""with a as (select 'market' as source, c_custkey::varchar as source_id, if(c_custkey % 6 = 0, 'неактивне', 'активне') as status, c_name as title, greatest(c_acctbal, 0) as price_uah, n_name as region, (20 + c_custkey % 80)::double as building_area_sqm, null::double as land_area_sqm from customer join nation on c_nationkey = n_nationkey),
b as (select 'auction', 'lot-' || s_suppkey, if(s_suppkey % 3 = 0, 'неактивне', 'активне'), s_name, greatest(s_acctbal * {USD}, 0), n_name, null::double, (s_suppkey % 9 + 1) * 100.0::double from supplier join nation on s_nationkey = n_nationkey)
select *, case when price_uah > 0 then price_uah / {USD} end as price_usd, case when price_uah > 0 and building_area_sqm > 0 then price_uah / building_area_sqm end as price_per_m2_uah, case when price_uah > 0 and land_area_sqm > 0 then price_uah / (land_area_sqm / 10000.0) end as price_per_ha_uah from (select * from a union all select * from b)""")
def p12_common_schema(spark, d):
    """Two sources under one schema, with prices in one currency, areas in square metres and the metrics of both."""
    n, k, s = table(spark, d, "nation"), F.col("c_custkey"), F.col("s_suppkey")
    none = F.lit(None).cast("double")
    price = lambda c, currency: F.greatest(C.in_home_currency(c, F.lit(currency), F.lit(USD)), F.lit(0.0)).alias("price_uah")
    market = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(k.cast("string").alias("source_id"), F.when(k % 6 == 0, "неактивне").otherwise(search.ACTIVE).alias("status"), F.col("c_name").alias("title"), price(F.col("c_acctbal"), "UAH"), F.col("n_name").alias("region"), C.square_metres((20 + k % 80).cast("double"), F.lit("м²")).alias("building_area_sqm"), none.alias("land_area_sqm"))
    auction = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("lot-"), s).alias("source_id"), F.when(s % 3 == 0, "неактивне").otherwise(search.ACTIVE).alias("status"), F.col("s_name").alias("title"), price(F.col("s_acctbal"), "USD"), F.col("n_name").alias("region"), none.alias("building_area_sqm"), C.square_metres((s % 9 + 1).cast("double"), F.lit("соток")).alias("land_area_sqm"))
    both = groups.union_tagged({"market": market, "auction": auction})
    m = C.price_metrics(F.col("price_uah"), F.col("building_area_sqm"), F.col("land_area_sqm"), F.lit(USD))
    return both.withColumns({c: m[c] for c in ("price_usd", "price_per_m2_uah", "price_per_ha_uah")})


@query("""with i as (select l_orderkey, sum(case when l_returnflag = 'A' then l_quantity * 100 when l_returnflag = 'N' then l_quantity * 10000 end) as items from lineitem where l_linenumber <= 2 group by 1)
select l_orderkey as o_orderkey, coalesce(items, l_orderkey % 50 + 1.0)::double as sqm from i""")
def p15_area_with_fallbacks(spark, d):
    """The sum of a lot's items in their units, else the number that its text names."""
    li = table(spark, d, "lineitem").where("l_linenumber <= 2")
    unit = F.when(F.col("l_returnflag") == "A", "соток").when(F.col("l_returnflag") == "N", "га")
    items = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.when(unit.isNotNull(), C.square_metres(F.col("l_quantity"), unit))).alias("items"))
    text = F.concat(F.lit("Площа "), (F.col("o_orderkey") % 50 + 1).cast("string"), F.lit(" кв.м"))
    return items.select("o_orderkey", F.coalesce("items", C.building_area(text)).alias("sqm"))


@query(f"with {U} select source_id as id, title, if(placed, a_region, null) as region, if(placed, a_city, null) as city, land_area_sqm / 100.0 as land_area_sotky, strftime(source_updated_at, '%Y-%m-%dT%H:%M:%S') as updated_at, if(source_id % 2 = 0, 2, 1) as related_objects_count from u")
def p19_display_rows(spark, d):
    first = lambda f: F.get(F.filter(F.transform("addresses", lambda a: a[f]), lambda x: C.filled(x)), F.lit(0))
    return unified(spark, d).select(F.col("source_id").alias("id"), F.coalesce("title", F.lit("")).alias("title"), first("region").alias("region"), first("settlement").alias("city"), (F.col("land_area_sqm") / 100.0).alias("land_area_sotky"), F.date_format("source_updated_at", "yyyy-MM-dd'T'HH:mm:ss").alias("updated_at"), F.size(F.coalesce("real_estate_object_refs", F.array().cast("array<long>"))).alias("related_objects_count"))


@query("""with a as (select o_custkey, o_orderpriority || ', ' || o_orderstatus as shown, min(o_orderkey) as met from orders group by 1, 2)
select c_custkey, coalesce((select string_agg(shown, '; ' order by met) from a where o_custkey = c_custkey), c_mktsegment) as address from customer""")
def p25_x4_reference_addresses(spark, d):
    """Addresses that references name, each once and in their order; the source's own text where they name none."""
    refs = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", F.concat_ws(", ", "o_orderpriority", "o_orderstatus").alias("shown")))).alias("refs"))
    text = F.array_join(F.array_distinct("refs.shown"), "; ")
    return table(spark, d, "customer").join(refs, "c_custkey", "left").select("c_custkey", C.first_filled(text, F.col("c_mktsegment")).alias("address"))


@query("""select s_suppkey, if(s_suppkey % 5 = 0, null, 'Київська') as region, 'Буча' as settlement, if(s_suppkey % 3 = 0, null, 'Соборності') as street, if(s_suppkey % 3 = 1, (s_suppkey % 40)::varchar, null) as building,
concat_ws(', ', if(s_suppkey % 5 = 0, null, 'Київська'), 'Буча', case s_suppkey % 3 when 1 then 'вул. Соборності, ' || s_suppkey % 40 || ' корпус А' when 2 then 'вулиця Соборності' end) as formatted_address from supplier""")
def p26_t16_item_addresses(spark, d):
    k = F.col("s_suppkey")
    street = F.when(k % 3 == 1, F.concat(F.lit("вул. Соборності, "), (k % 40).cast("string"), F.lit(" корпус А"))).when(k % 3 == 2, "вулиця Соборності")
    address = P.item_address(F.when(k % 5 > 0, "Київська область"), F.lit(" Буча"), street)
    return table(spark, d, "supplier").select("s_suppkey", address.alias("a")).select("s_suppkey", "a.*")


@query("select p_partkey, case p_partkey % 4 when 0 then '' when 1 then 'автосервіс' when 2 then 'кафе' else 'магазин' end as uses from part")
def p27_short_words_stand_alone(spark, d):
    texts = ["Продам дім, місто Київ, простора кухня, барвінок", "Приміщення під СТО, центр", "Затишний бар.", "КРАМНИЦЯ у місті"]
    return table(spark, d, "part").select("p_partkey", F.array_join(L.uses_in_text(_pick(texts, F.col("p_partkey") % 4)), ",").alias("uses"))


@query("select o_orderkey, case o_orderkey % 3 when 0 then true when 1 then false else true end as lease from orders")
def f22_lease_by_code_text(spark, d):
    k = F.col("o_orderkey")
    texts = F.when(k % 3 == 0, F.array(F.lit("Оренда нерухомості"))).otherwise(F.array(F.lit("Продаж")))
    rule = L.is_lease(F.lit(None).cast("string"), F.lit(""), F.when(k % 3 == 2, "rentalEnglish"), F.array(F.lit("x")), F.lit("Будинок"), texts)
    return table(spark, d, "orders").select("o_orderkey", rule.alias("lease"))


@query("select page_id, case page_id % 5 when 0 then 'blocked' when 1 then 'inactive' when 2 then 'empty' when 3 then 'empty' else 'ok' end as state from pages where length(html) > 500 and not regexp_matches(lower(html), 'captcha|cloudflare|please wait|ray id|turnstile')")
def f28_page_states(spark, d):
    k, html = F.col("page_id"), F.col("html")
    shown = F.when(k % 5 == 0, F.concat(F.lit("<html>Just a moment</html>"), html)).when(k % 5 == 1, F.concat(html, F.lit("<p>Оголошення неактивне</p>"))).when(k % 5 == 2, " ").when(k % 5 == 3, "<html><body><p>hi</p></body></html>").otherwise(html)
    pages = table(spark, d, "pages").where((F.length("html") > 500) & ~F.lower("html").rlike("captcha|cloudflare|please wait|ray id|turnstile"))
    return pages.select("page_id", files.page_state(shown).alias("state"))


@query("select c_custkey, i::int as place, '/l/' || c_custkey || '-' || i as link, 'Дім ' || i || ' за ' || (1000 * i + c_custkey % 100) || ' грн' as title, (1000 * i + c_custkey % 100)::double as price from customer, range(1, 4) as q(i)")
def s9_cards_with_prices(spark, d):
    k = F.col("c_custkey")
    card = lambda i: F.format_string("<div><a class=\"c\" href=\"/l/%d-%d\">\n<b>Дім %d</b> за <i>%d</i> грн</a></div>", k, F.lit(i), F.lit(i), 1000 * i + k % 100)
    page = F.concat(F.lit("<html><a name=x>x</a>"), *[card(i) for i in (1, 2, 3)])
    cards = table(spark, d, "customer").select("c_custkey", F.explode(files.html_cards(page)).alias("c"))
    return cards.select("c_custkey", "c.place", "c.link", "c.title", "c.price")


# joins


@query("select o_orderkey, n as n_tags from orders left join (select md5(o_orderpriority) as h, count(*) as n from orders where o_orderpriority not like '1%' group by 1) on md5(o_orderpriority) = h")
def j3_enrichment(spark, d):
    o = table(spark, d, "orders").withColumn("h", C.description_hash(F.col("o_orderpriority")))
    cache = o.where(~F.col("o_orderpriority").startswith("1")).groupBy("h").agg(F.count("*").alias("n_tags"))
    return o.join(F.broadcast(cache), "h", "left").select("o_orderkey", "n_tags")  # one row for each distinct priority


_Q = "select {k} as key, quantile_cont(l_extendedprice, 0.25) as q1, quantile_cont(l_extendedprice, 0.5) as q2, quantile_cont(l_extendedprice, 0.75) as q3, max(l_extendedprice) as q4, count(*) as n from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1"


@query(f"""with k as ({_Q.format(k="'n:' || n_name")} having count(*) >= 2400 union all {_Q.format(k="'r:' || r_name")}),
p as (select l_orderkey, l_linenumber, l_extendedprice as v, n_name, r_name, l_suppkey, l_partkey from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey order by l_extendedprice desc, l_orderkey, l_linenumber, l_suppkey, l_partkey limit 200),
m as (select p.*, coalesce(a.key, b.key) as used, coalesce(a.q1, b.q1) as q1, coalesce(a.q2, b.q2) as q2, coalesce(a.q3, b.q3) as q3, coalesce(a.q4, b.q4) as q4 from p left join k a on a.key = 'n:' || n_name left join k b on b.key = 'r:' || r_name),
s as (select *, greatest(q3 - q1, 0.05 * q2, 1) as s from m)
select l_orderkey, l_linenumber, used, case when v < q1 - 1.5 * s then 'abnormally_low' when v <= q1 then 'good' when v <= (q2 + q3) / 2 then 'below_average' when v <= (q3 + q4) / 2 then 'average' when v <= q3 + 1.5 * s then 'above_average' else 'abnormally_high' end as label from s""")
def j7_page_with_indicators(spark, d):
    """A page of rows with the indicator of its settlement, or of its region, and where each price stands in it: one join for all."""
    b = placed(spark, d)
    level = lambda p, c: stats.quartiles(b.withColumn("ind_key", F.concat(F.lit(p), c)), ["ind_key"], F.col("l_extendedprice"))
    ind = level("n:", F.col("n_name")).where("n >= 2400").unionByName(level("r:", F.col("r_name"))).withColumn("used", F.col("ind_key")).drop("n")
    ident = ["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"]
    rows, _ = search.page(b.select(*ident, "l_extendedprice", "n_name", "r_name"), [F.desc("l_extendedprice"), *[F.col(c) for c in ident]], 0, 200)
    out = joins.first_match(stored(rows, "page"), ind, [F.concat(F.lit("n:"), "n_name"), F.concat(F.lit("r:"), "r_name")], "ind_key", ident)
    label = C.position_label(F.col("l_extendedprice"), *[F.col(q) for q in ("q1", "q2", "q3", "q4")])
    return out.select("l_orderkey", "l_linenumber", "used", label.alias("label"))


@query(f"with {U} select region, city, property_type, count(*) as n from u group by all")
def j12_snowflake_round_trip(spark, d):
    """Three levels found or created, in two loads; counts by key, named again through the tables."""
    u = unified(spark, d).select("region", "city", "property_type", "source_id")
    _, known = entities.resolve_snowflake({}, u.where("source_id % 2 = 0"), ["region", "city", "property_type"])
    known = {n: stored(t, n) for n, t in known.items()}
    rows, tables = entities.resolve_snowflake(known, u, ["region", "city", "property_type"])
    n = rows.groupBy("region_id", "city_id", "property_type_id", *[F.when(F.col(f"{c}_id").isNull(), F.col(c)).alias(f"{c}_loose") for c in ("region", "city", "property_type")]).agg(F.count("*").alias("n"))
    for c in ("region", "city", "property_type"):
        n = n.join(tables[c].select(F.col("id").alias(f"{c}_id"), F.col("name").alias(c)), f"{c}_id", "left").withColumn(c, F.coalesce(c, f"{c}_loose"))
    return n.select("region", "city", "property_type", "n")


@query("select event_id, rate from events left join (select ts::date as day, round(avg(value), 6) as rate from events where event_type = 'purchase' and day(ts) % 2 = 0 group by 1) on ts::date = day")
def j13_rate_of_the_day(spark, d):
    """The rate of exactly that day; days without one have none, and none is carried over."""
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    rates = e.where((F.col("event_type") == "purchase") & (F.dayofmonth("ts") % 2 == 0)).groupBy("day").agg(F.round(F.avg("value"), 6).alias("rate"))
    return e.join(rates, "day", "left").select("event_id", "rate")


@query("""with k as (select o_orderkey as id, o_custkey as k, case when o_orderkey % 9 > 0 then o_orderdate end as t from orders)
select a.id, count(b.id) > 0 as is_repeat, count(b.id) as n_earlier from k a left join k b on a.k = b.k and a.id <> b.id and (b.t < a.t or a.t is null or b.t is null) group by 1""")
def j16_repeats_without_dates(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", F.when(F.col("o_orderkey") % 9 > 0, F.col("o_orderdate")).alias("t"))
    return entities.earlier_repeats(o, F.col("o_custkey"), "id", "t")


@query(f"""with {U}, m as (select region, city, strftime(source_updated_at, '%Y-%m') as month, avg(price_uah) as mean, count(*) as n from u where region is not null and city is not null group by all),
l as (select region, city, sum(n)::bigint as n_similar, arg_max(mean, month) as local from m group by all), w as (select region, month, sum(mean * n) / sum(n) as mean from m group by all), r as (select region, arg_max(mean, month) as regional from w group by 1)
select source_id, coalesce(n_similar, 0) as n_similar, case when local is null then 'region only' when abs(price_uah - local) - abs(price_uah - regional) <= 0 then 'as the settlement' else 'as the region' end as note
from u left join l on u.region = l.region and u.city = l.city left join r on u.region = r.region""")
def j17_local_and_regional(spark, d):
    u = unified(spark, d).select("source_id", "region", "city", "price_uah", "source_updated_at")
    months = u.where("region is not null and city is not null").groupBy("region", "city", C.month_key(F.col("source_updated_at")).alias("month")).agg(F.avg("price_uah").alias("mean"), F.count("*").alias("n"))
    return entities.region_and_local_context(u, months, "region", "city", "price_uah").select("source_id", "n_similar", "note")


# aggregations


@query(f"with {U} select region, round(avg(price_uah / building_area_sqm), 4) as price_per_m2_uah, round(sum(price_uah), 2) as price_uah from u group by 1")
def a3_bound_aggregates(spark, d):
    u = unified(spark, d)
    return u.groupBy("region").agg(*[F.round(groups.AGGREGATES[profiles.bound_aggregate(m)](m), n).alias(m) for m, n in (("price_per_m2_uah", 4), ("price_uah", 2))])


@query(f"with {U} select strftime(source_updated_at, '%Y-%m-%d') as day, region, city, round(avg(price_uah / building_area_sqm) + 3e-7, 2) as value, count(*) as count from u where region is not null and city is not null group by all")
def a4_price_by_day_and_place(spark, d):
    u = unified(spark, d).where("region is not null and city is not null")
    out = groups.by_metric(u, F.col("price_per_m2_uah"), "avg", [C.day_key(F.col("source_updated_at")).alias("day"), F.col("region"), F.col("city")])
    return out.withColumn("value", F.round(F.col("value") + 3e-7, 2))


@query(f"with {U} select region, city, round(avg(price_uah), 4) as mean, round(sum(price_uah), 2) as sum, min(price_uah) as min, max(price_uah) as max, count(price_uah) as count, arg_min(price_uah, source_id) as first from u where region is not null and city is not null group by all")
def a11_group_first(spark, d):
    v = F.col("price_uah")
    u = unified(spark, d).dropna(subset=["region", "city"])
    return u.groupBy("region", "city").agg(F.round(F.avg(v), 4).alias("mean"), F.round(F.sum(v), 2).alias("sum"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("count"), F.min_by(v, "source_id").alias("first"))


@query("""with b as (select l_returnflag as kind, l_extendedprice as v from lineitem where l_shipdate >= (select max(l_shipdate) from lineitem) - interval 400 days),
q as (select kind, quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.5) as q2, quantile_cont(v, 0.75) as q3 from b group by 1 having count(*) >= 10)
select kind, round(q1 - w * greatest(q3 - q1, 0.05 * q2) + 3e-7, 4) as lo, round(q3 + w * greatest(q3 - q1, 0.05 * q2) + 3e-7, 4) as hi from (select *, if(kind = 'R', 2.5, 1.5) as w from q)""")
def a18_fences_of_recent_rows(spark, d):
    """Fences over the last days, wider for mixed property; the days are 400 here, as the tables are sparse."""
    li = table(spark, d, "lineitem")
    now = li.agg(F.max("l_shipdate").alias("now"))
    recent = li.join(F.broadcast(now)).where(F.col("l_shipdate") >= F.col("now") - F.expr("interval 400 days")).withColumn("kind", F.col("l_returnflag"))
    counts = stats.positive(recent, ["kind"], F.col("l_extendedprice"))
    out = stats.fences_of(counts, ["kind"], F.when(F.col("kind") == "R", 2.5).otherwise(1.5), 0.05, 10)
    return out.select("kind", *[F.round(F.col(c) + 3e-7, 4).alias(c) for c in ("lo", "hi")])


@query(f"with {U} select distinct a_city as value from u where placed")
def a20_first_filled_source(spark, d):
    """Cities from the first of several sources that has any."""
    u = unified(spark, d)
    return groups.first_non_empty([u.where("city = 'none such'").select(F.col("city").alias("value")), u.select(F.explode("addresses.settlement").alias("value")), u.select(F.col("city").alias("value"))]).distinct()


@query("select strftime(ts, '%Y-%m-%d') as day, count(*) as n from events where coalesce(try_cast(json_extract_string(props, '$.k') as int), 0) % 2 = 1 group by 1")
def a27_misses_by_day(spark, d):
    miss = F.coalesce(F.get_json_object("props", "$.k").try_cast("int"), F.lit(0)) % 2 == 1
    return table(spark, d, "events").where(miss).groupBy(C.day_key(F.col("ts")).alias("day")).agg(F.count("*").alias("n"))


@query(f"with {U} select region, city, a_city, count(*) as count from u where placed group by all")
def a29_unique_places(spark, d):
    u = unified(spark, d).where(F.size("addresses") > 0).withColumn("a_city", F.col("addresses")[0]["settlement"])
    return groups.count_rows(u, [F.col("region"), F.col("city"), F.col("a_city")])


@query("""with b as (select o_orderkey, o_orderstatus, if(o_orderkey % 3 = 0, null, o_totalprice) as price from orders)
select 'o_orderkey' as path, 'bigint' as type, false as nullable, count(*) as n_values, 1.0::double as rate, 3 as n_examples from b union all select 'price', 'double', true, count(price), round(count(price) / count(*), 6), 3 from b
union all select 'tags', 'array', false, count(*), 1.0, 0 from b union all select 'tags[]', 'string', false, 2 * count(*), 1.0, 3 from b union all select 'at', 'struct', false, count(*), 1.0, 0 from b union all select 'at.status', 'string', false, count(*), 1.0, 3 from b""")
def a32_schema_with_nesting(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice")).alias("price"), F.array(F.lit("x"), "o_orderstatus").alias("tags"), F.struct(F.col("o_orderstatus").alias("status")).alias("at"))
    out = profiles.schema_profile(o)
    return out.select("path", "type", "nullable", "n_values", F.round("rate", 6).alias("rate"), F.size("examples").alias("n_examples"))


@query(f"""with {U}, t as (select region, count(*) as n, avg(price_uah) as avg, min(price_uah) as lo, max(price_uah) as hi from u where region is not null group by 1 order by n desc, region limit 3)
select null as region, count(*) as n, round(avg(price_uah), 4) as avg, min(price_uah) as lo, max(price_uah) as hi from u union all select region, n, round(avg, 4), lo, hi from t""")
def a35_result_summary(spark, d):
    return profiles.summary(unified(spark, d), "price_uah", "region", 3).withColumn("avg", F.round("avg", 4)).select("region", "n", "avg", "lo", "hi")


@query(f"with {U}, m as (select city, avg(price_uah) as mean from u where city is not null group by 1) select arg_max(city, mean) as best, arg_min(city, mean) as worst from m")
def a37_best_and_worst(spark, d):
    return profiles.extremes(unified(spark, d).where("city is not null"), "city", "price_uah")


@query("select b as bucket, count(*) as n, min(p_retailprice) as lo, max(p_retailprice) as hi from (select p_retailprice, ntile(7) over (order by p_retailprice, p_partkey) as b from part) group by 1")
def a40_seven_buckets(spark, d):
    return groups.auto_buckets(table(spark, d, "part"), "p_retailprice", "p_partkey", 7)


@query("select true as sampled, true as repeatable, count(*) as total from part")
def a40_sample_and_count(spark, d):
    """A sample of a tenth by a hash of the key, within four deviations of its size, and the same again; the count stage is an aggregate."""
    p = table(spark, d, "part")
    pick = lambda: groups.sampled(p, "p_partkey", 0.1, 7)
    both = pick().join(pick(), "p_partkey", "full_outer").agg(F.count("*").alias("n"))
    once, total = pick().agg(F.count("*").alias("m")), p.agg(F.count("*").alias("total"))
    near = F.abs(F.col("n") - F.col("total") * 0.1) <= 4 * F.sqrt(F.col("total") * 0.09)
    return both.join(once).join(total).select(near.alias("sampled"), (F.col("n") == F.col("m")).alias("repeatable"), "total")


# windows, orders


@query("select event_id, ts from events where user_id = (select min(user_id) from events) order by ts desc, event_id desc limit 1")
def w2_latest_of_one_key(spark, d):
    e = table(spark, d, "events")
    one = e.join(F.broadcast(e.agg(F.min("user_id").alias("user_id"))), "user_id", "left_semi")
    return one.orderBy(F.desc("ts"), F.desc("event_id")).limit(1).select("event_id", "ts")


@query("select n_nationkey, case n_nationkey when 7 then 0 when 3 then 1 when 11 then 2 else n_nationkey + 3 end::bigint as place from nation")
def w6_reorder(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_nationkey").cast("long").alias("place"))
    return changes.reordered(n, "n_nationkey", [7, 3, 11], "place")


@query("select o_orderkey, row_number() over (order by coalesce(case when o_orderkey % 4 > 0 then o_orderdate end, case when o_orderkey % 3 > 0 then timestamp '1996-06-01' end) desc nulls last, o_orderkey)::int as place from orders qualify place <= 500")
def o11_newest_first(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select("o_orderkey", F.when(k % 4 > 0, F.col("o_orderdate")).alias("seen"), F.when(k % 3 > 0, F.lit("1996-06-01").cast("timestamp_ntz")).alias("made"))
    top = o.orderBy(*search.newest_first("seen", "made"), "o_orderkey").limit(500)
    return top.select("o_orderkey", F.row_number().over(Window.orderBy(*search.newest_first("seen", "made"), "o_orderkey")).alias("place"))  # of a page


@query("select o_orderkey, f as flag from orders left join (select l_orderkey, l_returnflag as f from lineitem where l_quantity > 45) on l_orderkey = o_orderkey")
def e14_unwind_outer(spark, d):
    li = table(spark, d, "lineitem").where("l_quantity > 45").groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("flags"))
    o = table(spark, d, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.select("o_orderkey", F.explode_outer("flags").alias("flag"))


# entities


@query("""with recursive k as (select c_custkey as id, case when c_custkey % 4 > 0 then 'a' || c_custkey % 60 end as a, case when c_custkey % 5 = 0 then 'b' || c_custkey % 35 end as b from customer),
m as (select id, a as key from k where a is not null union all select id, b from k where b is not null), e as (select distinct x.id as u, y.id as v from m x join m y on x.key = y.key),
r(id, root) as (select id, id from k union select e.v, r.root from r join e on e.u = r.id where r.root < e.v), f as (select id, min(root) as first_ref from r group by 1)
select first_ref, count(*) as n_refs, arg_min(c_mktsegment, c_custkey) as c_mktsegment from f join customer on c_custkey = id group by 1""")
def n2_linked_objects(spark, d):
    k = F.col("c_custkey")
    keys = [F.when(k % 4 > 0, k % 60), F.when(k % 5 == 0, k % 35)]
    return entities.linked_objects(table(spark, d, "customer"), keys, k, ["c_mktsegment"])


@query(f"with {U} select property_type, count(*) as n from u where property_type <> '{L.OTHER}' group by 1")
def n6_without_junk(spark, d):
    return changes.delete_where(unified(spark, d), F.col("property_type") == L.OTHER).groupBy("property_type").agg(F.count("*").alias("n"))


@query("select case p_partkey % 3 when 0 then 'Вінницька' when 1 then 'Київська' else 'Харківська' end as region, (p_size % 5)::varchar as zone, count(*) as n, min(p_partkey) as first_parcel from part group by all")
def n7_t17_location_index(spark, d):
    """Where parcels lie, from their numbers alone: region by the code's beginning, zone, how many."""
    code = F.concat(_pick(["05", "32", "63"], F.col("p_partkey") % 3), F.format_string("%08d:%d:%03d:%04d", F.col("p_partkey"), F.col("p_size") % 5, F.lit(7), F.col("p_partkey") % 1000))
    parcels = table(spark, d, "part").select("p_partkey", code.alias("code"))
    return parcels.groupBy(P.region_of_parcel(F.col("code")).alias("region"), C.cadastral_parts(F.col("code"))["zone"].alias("zone")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_parcel"))
