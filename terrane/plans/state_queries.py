"""Tables that follow a feed: rebuilt and swapped, fed in batches that may run again, rolled up by what came."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.functions import listings as L
from terrane.operators import changes, entities, unified
from terrane.operators.rollups import Rollup
from terrane.plans.queries import query
from terrane.plans.shape_queries import ORACLE_SQL, QUERIES
from terrane.sources.storage import scratch, table
from terrane.sources.versions import Versions
from terrane.streaming import events, sessions
from terrane.streaming.phases import Feed

__all__ = ["ORACLE_SQL", "QUERIES"]

# Cents, so that sums and quarters of them are whole numbers and both sides give the same.
_FIGURES = "count(*) as count, sum(v)::bigint as total, " + ", ".join(f"(4 * quantile_cont(v, {q}))::bigint as q{k}_x4" for k, q in enumerate((0.25, 0.5, 0.75), 1)) + ", max(v)::bigint as q4"


def _shown(df, *by: str):
    total = F.round(F.col("avg") * F.col("count")).cast("long").alias("total")
    return df.select(*by, "count", total, *[(F.col(f"q{k}") * 4).cast("long").alias(f"q{k}_x4") for k in (1, 2, 3)], F.col("q4").cast("long").alias("q4"))


def _cents(c):
    return F.floor(c * 100)


@query("select c_mktsegment, count(*) as n, max(c_custkey) as last from customer group by 1")
def k8_swapped_rebuild(spark, d):
    """A table that is rebuilt while a reader holds the version before; both are whole."""
    counted = lambda rows: rows.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.max("c_custkey").alias("last"))
    customers, kept = table(spark, d, "customer"), Versions(spark, scratch(spark, "rebuilt"))
    kept.publish(counted(customers.where("c_custkey % 2 = 0")))
    kept.publish(counted(customers))
    kept.clear(1)
    return kept.read()


@query(f"""with f as (select o_orderpriority as priority, date_trunc('month', o_orderdate)::date as month, floor((case when o_orderkey % 7 = 0 then o_totalprice * 2 else o_totalprice end) * 100) as v from orders)
select priority, month, {_FIGURES} from f where v > 0 group by 1, 2""")
def r1_three_phases(spark, d):
    """Orders come in two batches, then some again, unchanged or with another price; one batch runs twice."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate", "o_totalprice")
    feed = Feed(spark, scratch(spark, "feed"), "o_orderkey", "seen", ["o_orderpriority", "o_orderdate", "o_totalprice"], {"priority": F.col("o_orderpriority"), "month": F.trunc(F.col("o_orderdate").cast("date"), "month")}, _cents(F.col("o_totalprice")))
    changed = orders.where("o_orderkey % 7 = 0").withColumn("o_totalprice", F.col("o_totalprice") * 2)
    batches = [orders.where(F.col("o_orderkey") % 2 == k) for k in range(2)] + [orders.where("o_orderkey % 5 = 0 and o_orderkey % 7 != 0").unionByName(changed)]
    for number, batch in enumerate(batches):
        for _ in range(2 if number == 1 else 1):
            feed.apply(batch.withColumn("seen", F.lit(number)), number)
    return _shown(feed.rollup.current(), "priority", "month")


@query(f"select l_returnflag, date_trunc('week', l_shipdate)::date as week, {_FIGURES} from (select *, floor(l_extendedprice / l_quantity * 100) as v from lineitem) where v > 0 group by 1, 2")
def a17_incremental_weeks(spark, d):
    """Weekly figures of unit prices, kept up by three loads of which each brings the days of its years."""
    lines = table(spark, d, "lineitem").select("l_returnflag", F.trunc(F.col("l_shipdate").cast("date"), "week").alias("week"), _cents(F.col("l_extendedprice") / F.col("l_quantity")).alias("v"), F.year("l_shipdate").alias("year"))
    rollup = Rollup(spark, scratch(spark, "rollup"), ["l_returnflag", "week"])
    for number, part in enumerate((F.col("year") < 1995, F.col("year") == 1995, F.col("year") > 1995)):
        rollup.load(lines.where(part).groupBy("l_returnflag", "week", "v").agg(F.count("*").alias("n")), number)
    return _shown(rollup.current(), "l_returnflag", "week")


@query("""with o as (select o_orderkey as id, case when o_custkey % 11 = 0 then null else o_custkey end as k, o_orderdate as t from orders),
l as (select a.id, b.id as earlier, row_number() over (partition by a.id order by b.t desc, b.id desc) as place from o a join o b on a.k = b.k and b.t < a.t)
select o.id, coalesce(string_agg(l.earlier::varchar, ',' order by place) filter (place <= 3), '') as earlier, count(l.earlier) as n_earlier from o left join l on o.id = l.id where o.k is not null group by o.id""")
def j16_repeat_links(spark, d):
    """The three orders of the same customer before each order, with how many there are; some orders have no customer."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") % 11 != 0, F.col("o_custkey")).alias("k"), F.col("o_orderdate").alias("t"))
    links = entities.repeat_links(o, F.col("k"), "id", "t", 3)
    return links.select("id", F.array_join(F.coalesce(F.col("earlier"), F.array()).cast("array<string>"), ",").alias("earlier"), "n_earlier")


@query("""with p as (select conv_id, turn, text, role, lead(role) over w as next_role, lead(text) over w as reply from conversations window w as (partition by conv_id order by turn))
select conv_id, turn::bigint as turn, text, reply, row_number() over (partition by conv_id order by turn desc)::int as n_back from p where role = 'user' and next_role = 'assistant' qualify row_number() over (partition by conv_id order by turn desc) <= 2""")
def w4_live_exchanges(spark, d):
    """All conversations through a stream with state; each micro-batch's sessions replace those of the version before."""
    src, state = scratch(spark, "turns"), Versions(spark, scratch(spark, "sessions"))
    table(spark, d, "conversations").select("conv_id", "turn", "role", "text", F.timestamp_seconds(1_700_000_000 + F.col("turn") * 60).alias("ts")).write.parquet(src)

    def merge(batch, number):
        if state.entry()["batch"] < number:
            old = state.read()
            state.publish(batch if old is None else changes.replace_rows(old, batch, ["session"]), number)

    live = sessions.live_exchanges(events.read_stream(spark, src), "conv_id", "turn", "ts", 2, 100_000_000)
    events.run_available(live, merge, scratch(spark, "offsets"), "update")
    found = state.read().select(F.col("session").cast("long").alias("conv_id"), F.posexplode("exchanges").alias("k", "x"))
    return found.select("conv_id", "x.turn", "x.text", "x.reply", (F.col("k") + 1).alias("n_back"))


USD = 41.5
_AREAS = "sum(if(l_returnflag = 'A', l_quantity * 10000, if(l_returnflag = 'R', l_quantity * 100, 0)))::double as land, sum(if(l_returnflag = 'N', l_quantity, 0))::double as building"
# the two sources under one schema; customers have three addresses, of which two may agree and one may be complete
_BOTH = f"""a as (select *, 'A' || c_custkey % 3 as p1, 'A' || c_custkey % 4 as p2, 'A' || c_custkey % 5 as p3 from customer join nation on c_nationkey = n_nationkey),
ads as (select 'ads' as source, 'u' || c_custkey as source_id, '2024-03-' || lpad((c_custkey % 28 + 1)::varchar, 2, '0') as source_date, if(c_custkey % 6 = 0, 'неактивне', 'активне') as status, 'u' || c_custkey as page_url, c_name as title,
 case c_custkey % 3 when 0 then '{L.LAND}' when 1 then '{L.BUILDING}' else '{L.OTHER}' end as property_type, if(c_custkey % 2 = 0, p2, if(p2 = p3 and p1 <> p2, p2, p1)) as region, if(c_custkey % 2 = 0, n_name, null) as street,
 case when c_acctbal > 0 then case c_custkey % 4 when 1 then c_acctbal * {USD} when 2 then c_acctbal * {USD} * 1.1 else c_acctbal end end::double as price_uah, if(c_custkey % 5 = 0, null, (20 + c_custkey % 80)::double) as building_area_sqm, if(c_custkey % 5 = 1, 5000.0, null)::double as land_area_sqm, if(c_custkey % 7 = 0, null, (c_custkey % 7)::varchar) as floor from a),
k as (select l_orderkey, {_AREAS} from lineitem group by 1),
lots as (select 'lots', o_orderkey::varchar, strftime(o_orderdate, '%Y-%m-%d'), if(o_orderstatus = 'O', 'активне', 'неактивне'), 'https://x/' || o_orderkey, if(o_custkey % 2 = 0, o_orderpriority, 'lot ' || o_orderkey),
 case when land > 0 and building > 0 then '{L.LAND_AND_BUILDING}' when land > 0 then '{L.LAND}' when building > 0 then '{L.BUILDING}' else '{L.OTHER}' end, null, null, o_totalprice::double, nullif(building, 0), nullif(land, 0), null from orders join k on l_orderkey = o_orderkey),
both_sources as (select * from ads union all select * from lots),
v as (select *, price_uah / {USD} as price_usd, price_uah / building_area_sqm as price_per_m2_uah, price_uah / {USD} / building_area_sqm as price_per_m2_usd, price_uah / (land_area_sqm / 10000) as price_per_ha_uah, price_uah / {USD} / (land_area_sqm / 10000) as price_per_ha_usd from both_sources)"""


def _listings(spark, d):
    """Ads told by customers and lots told by orders with their lines as items, each in its source's own shape, under one schema."""
    c, text = F.col("c_custkey"), lambda x: x.cast("string")
    address = lambda n, full: F.struct(F.concat(F.lit("A"), text(c % n)).alias("region"), F.struct(F.when(F.lit(full), F.col("n_name")).alias("name")).alias("street"), (F.lit(full) & (c % 2 == 0)).alias("is_complete"))
    currency = F.get(F.array(F.lit("UAH"), F.lit("usd"), F.lit("EUR"), F.lit("?")), c % 4)
    price = F.when(c % 2 == 0, F.struct(text(F.col("c_acctbal")).alias("value"), currency.alias("currency")))
    kind = F.get(F.array(F.lit("Ділянка"), F.lit("Нерухомість")), c % 3)
    llm = F.struct(kind.alias("property_type"), F.when((c % 5 != 0) & (c % 5 != 2), 20 + c % 80).alias("building_area_sqm"), F.when(c % 5 == 1, F.lit("0.5")).alias("land_area_ha"), F.nullif(c % 7, F.lit(0)).alias("floor"))
    ads = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("u"), c).alias("url"), F.concat(F.lit("2024-03-"), F.lpad(text(c % 28 + 1), 2, "0")).alias("updated_at"), F.nullif(c % 6 != 0, F.lit(True)).alias("is_active"),
        F.struct(F.col("c_name").alias("title"), text(F.col("c_acctbal")).alias("price_value"), currency.alias("currency"), F.when(c % 5 == 2, 20 + c % 80).alias("area_m2")).alias("search_data"),
        F.struct(price.alias("price"), llm.alias("llm")).alias("detail"), F.array(address(3, False), address(4, True), address(5, False)).alias("addresses"),
    )
    flag, units = F.col("l_returnflag"), F.create_map(*[F.lit(x) for x in ("A", "га", "R", "соток", "N", "м²")])
    item = F.struct(F.get(F.array(F.lit("04"), F.lit("06")), (flag != "N").cast("int")).alias("code"), F.lit(None).cast("string").alias("props"), F.when(flag != "N", F.col("l_quantity").cast("double")).alias("land_area"), F.when(flag == "N", F.col("l_quantity").cast("double")).alias("building_area"), units[flag].alias("unit"))
    items = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(item).alias("items"))  # the lines of one order, a handful
    o = table(spark, d, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    title = F.struct(F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderpriority")).alias("en_US"))
    data = F.struct(text(F.col("o_orderdate")).alias("dateModified"), F.when(F.col("o_orderstatus") == "O", "active.tendering").otherwise("complete").alias("status"), title.alias("title"), F.concat(F.lit("lot "), "o_orderkey").alias("id"), F.struct(F.col("o_totalprice").alias("amount")).alias("value"), "items")
    lots = o.select(text(F.col("o_orderkey")).alias("auction_id"), data.alias("auction_data"))
    return unified.from_ads(ads, "ads", USD).unionByName(unified.from_lots(lots, "lots", USD, "https://x/"), allowMissingColumns=True)


@query(f"with {_BOTH} select source, source_id, status, page_url, title, property_type, region, price_uah, price_usd, price_per_m2_uah, price_per_m2_usd, price_per_ha_uah, price_per_ha_usd, building_area_sqm, land_area_sqm, coalesce(floor, '') as floor, if(price_uah > 0, {USD}, null)::double as currency_rate from v")
def p12_two_sources(spark, d):
    """All fields of the common schema that the sources tell, from whole tables."""
    return _listings(spark, d).drop("source_updated_at", "identifier", "description", "oblast_raion", "city", "city_district", "addresses", "cadastral_numbers", "tags")


@query(f"with {_BOTH} select source, source_id, page_url as listing_url, property_type, source_date, coalesce(region, '') as region, coalesce(street, '') as street, floor, land_area_sqm, building_area_sqm, price_per_m2_uah, price_per_m2_usd, price_per_ha_uah, price_per_ha_usd, price_uah, price_usd, '' as oblast_raion, '' as city, '' as city_district, '' as settlement, '' as settlement_type, '' as street_type, '' as building from v")
def p13_whole_extract(spark, d):
    """The flat extract, with all its fields, of both sources' listings."""
    return unified.flat_extract(_listings(spark, d))


@query("""with o as (select l_orderkey, bool_or(n_name in ('NATION_3', 'NATION_7')) as told from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by 1)
select 'ads' as source, 'u' || c_custkey as id from customer join nation on c_nationkey = n_nationkey where n_name in ('NATION_3', 'NATION_7')
union all select 'lots', o_orderkey::varchar from orders left join o on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where told or (o_orderkey % 3 = 0 and n_name in ('NATION_3', 'NATION_7'))""")
def g7_places_by_kind_of_document(spark, d):
    """Each kind of document asked for places where it tells them: ads by references or the card's text, lots by references or any item's address."""
    n, text, c, o = table(spark, d, "nation"), lambda x: x.cast("string"), F.col("c_custkey"), F.col("o_orderkey")
    name = F.concat(F.lit("Край "), F.lower("n_name"), F.lit(" область"))
    customers = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    refs = lambda when: F.array(F.struct(F.struct(F.when(when, name).alias("name")).alias("region")))
    ads = customers.select(F.concat(F.lit("u"), c).alias("id"), F.struct(refs(c % 2 == 0).alias("address_refs")).alias("detail"), F.struct(F.when(c % 2 == 1, name).alias("location")).alias("search_data"))
    item = F.struct(F.struct(F.struct(name.alias("uk_UA")).alias("region")).alias("address"))
    items = table(spark, d, "lineitem").join(table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_orderkey").agg(F.collect_list(item).alias("items"))
    orders = table(spark, d, "orders").join(customers, F.col("o_custkey") == c).join(items, o == F.col("l_orderkey"), "left")
    lots = orders.select(text(o).alias("id"), F.struct(refs(o % 3 == 0).alias("address_refs"), "items").alias("auction_data"))
    wanted = ["nation_3 область", "NATION_7"]
    parts = [("ads", ads, unified.AD_PLACES), ("lots", lots, unified.LOT_PLACES)]
    found = [df.where(unified.in_places(df, told, [], wanted)).select(F.lit(source).alias("source"), "id") for source, df, told in parts]
    return found[0].unionByName(found[1])
