"""Polygons and pages over the driver's tables, with their SQL: a customer is a parcel, of four points around a place made from its key."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.functions import listings as L
from terrane.functions import places as P
from terrane.operators import polygons
from terrane.plans.queries import query
from terrane.plans.text_queries import ORACLE_SQL, QUERIES
from terrane.sources import pages, tiles
from terrane.sources.storage import table

__all__ = ["ORACLE_SQL", "QUERIES"]

BUFFER = 0.25


def parcels(spark, d):
    """id, kind, rings, area: diamonds, and arrowheads for odd keys."""
    k = F.col("c_custkey")
    odd, r = k % 2, 0.5 + k % 4 * 0.5
    x, y = k * 7919 % 10007 * 0.013, k * 6007 % 10009 * 0.013
    ring = F.array(F.array(x, y + r), F.array(x - r, y - r * odd), F.array(x, y - r * (1 - 0.5 * odd)), F.array(x + r, y - r * odd))
    rows = table(spark, d, "customer").repartition("c_custkey")  # a small file is one partition, its rings and boxes take long
    return rows.select(k.alias("id"), (F.col("c_nationkey") % 5).alias("kind"), F.array(ring).alias("rings"), "c_acctbal")


def _to_segment(px: str, py: str, s: str) -> str:
    long = f"(({s}.bx - {s}.ax) * ({s}.bx - {s}.ax) + ({s}.by - {s}.ay) * ({s}.by - {s}.ay))"
    t = f"greatest(0.0, least(1.0, (({px} - {s}.ax) * ({s}.bx - {s}.ax) + ({py} - {s}.ay) * ({s}.by - {s}.ay)) / {long}))"
    return f"(pow({px} - ({s}.ax + {t} * ({s}.bx - {s}.ax)), 2) + pow({py} - ({s}.ay + {t} * ({s}.by - {s}.ay)), 2))"


def _turn(s: str, px: str, py: str) -> str:
    return f"(({s}.bx - {s}.ax) * ({py} - {s}.ay) - ({s}.by - {s}.ay) * ({px} - {s}.ax))"


_ENDS = ", ".join(_to_segment(f"{a}.{p}x", f"{a}.{p}y", b) for a, b in (("e", "f"), ("f", "e")) for p in "ab")
_CROSS = " and ".join(f"{_turn(a, f'{b}.ax', f'{b}.ay')} * {_turn(a, f'{b}.bx', f'{b}.by')} < 0" for a, b in (("e", "f"), ("f", "e")))
_HOLDS = "(select count(*) % 2 = 1 from e where e.id = {q}.id and (e.ay > {p}.y + {p}.r) <> (e.by > {p}.y + {p}.r) and {p}.x < e.ax + ({p}.y + {p}.r - e.ay) * (e.bx - e.ax) / (e.by - e.ay))"
_NEAR_POLYGONS = f"""
p as (select c_custkey as id, c_nationkey % 5 as kind, c_custkey % 2 as odd, 0.5::double + c_custkey % 4 * 0.5::double as r, c_custkey * 7919 % 10007 * 0.013::double as x, c_custkey * 6007 % 10009 * 0.013::double as y from customer),
v as (select id, 0 as k, x as vx, y + r as vy from p union all select id, 1, x - r, y - r * odd from p union all select id, 2, x, y - r * (1 - 0.5::double * odd) from p union all select id, 3, x + r, y - r * odd from p),
e as (select a.id, a.vx as ax, a.vy as ay, b.vx as bx, b.vy as by from v a join v b on a.id = b.id and b.k = (a.k + 1) % 4),
c as (select p.id as a, q.id as b, {_HOLDS.format(p="p", q="q")} or {_HOLDS.format(p="q", q="p")} as held from p join p q on p.kind = q.kind and p.id < q.id and abs(p.x - q.x) <= p.r + q.r + {BUFFER} and abs(p.y - q.y) <= p.r + q.r + {BUFFER}),
m as (select a, b, bool_or(held) as held, min(case when {_CROSS} then 0 else sqrt(least({_ENDS})) end) as d from c join e on e.id = a join e f on f.id = b group by a, b),
n as (select a, b, case when held then 0 else d end as distance from m where held or d <= {BUFFER})"""


@query(f"with {_NEAR_POLYGONS} select a, b, round(distance, 6) as distance from n")
def g13_near_polygons(spark, d):
    near = polygons.near_polygons(parcels(spark, d), ["kind"], BUFFER, 16.0)
    return near.select("a", "b", F.when(F.col("distance") > 0, F.round("distance", 6)).otherwise(F.col("distance")).alias("distance"))  # rounding goes by decimals, most pairs need none


@query(f"""with recursive {_NEAR_POLYGONS}, g as (select a as u, b as v from n union all select b, a from n), t(id, root) as (select u, u from g union select g.v, t.root from t join g on g.u = t.id),
k as (select id, min(root) as cluster from t group by id) select cluster, count(*) as n, round(sum(c_acctbal), 2) as balance, min(id) as first_id, max(id) as last_id from k join customer on c_custkey = id group by 1""")
def a39_polygon_clusters(spark, d):
    rows = parcels(spark, d)
    found = polygons.polygon_clusters(rows, ["kind"], BUFFER, 16.0).join(rows, "id")
    return found.groupBy("cluster").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


# pages: the given ones, and listings and lists of results made of their articles and links

_TEXT = "trim(regexp_replace(replace(replace(replace(replace(regexp_replace({c}, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), '\\s+', ' ', 'g'))"
_ARTICLE = "regexp_extract(html, '(?s)<article>(.*?)</article>', 1)"


@query(f"""select page_id, nullif({_TEXT.format(c="regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}, '') as title, regexp_extract(html, '<html lang="([^"]*)"', 1) as lang,
{_TEXT.format(c="regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} as heading, nullif({_TEXT.format(c=_ARTICLE)}, '') as description from pages""")
def s10_page_details(spark, d):
    rows = pages.page_details(table(spark, d, "pages"))
    return rows.select("page_id", "title", "lang", F.coalesce(F.get("headings", F.lit(0)), F.lit("")).alias("heading"), "description")


@query(f"""select page_id, 'Ділянка ' || page_id as title, (page_id * 10 + 1000)::double as price, case page_id % 3 when 0 then 'UAH' when 1 then 'USD' else 'EUR' end as currency, nullif({_TEXT.format(c="'Опис ' || " + _ARTICLE)}, '') as description,
'Площа=' || (page_id % 40 + 2) || ' соток|Поверх=' || (page_id % 9) || ' з 9' as parameters, case page_id % 4 when 0 then 'Біла Церква' else 'Львів' end as city, case page_id % 4 when 0 then 'Київська область' else 'Львівська область' end as region,
'Олена' as seller, '+380' || lpad(page_id::varchar, 9, '0') as phone from pages""")
def s10_listing_details(spark, d):
    """Listings whose descriptions are the articles of the pages, with tags left open in them."""
    k = F.col("page_id")
    says = lambda *c: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in c])
    sign = F.when(k % 3 == 0, "грн.").when(k % 3 == 1, "$").otherwise("€")
    place = F.when(k % 4 == 0, "<p>Біла Церква<p>Київська область").otherwise("<p>Львів</p><p>Київська область</p>".replace("Київська", "Львівська"))
    html = says(
        "<html lang=uk><head><title>Ділянка ", k.cast("string"), "</title><script>if (a < b) { '<div data-cy=\"ad-price\">1</div>' }</script></head><body><!-- <h3 data-cy='ad-price'>2 грн</h3> -->",
        "<ul data-cy='ad_parameters'><li><p>Площа: ", (k % 40 + 2).cast("string"), " соток<li>Поверх:<b> ", (k % 9).cast("string"), " з 9</b></ul>",
        "<div class=box><h3 data-cy=\"ad-price\"><span>", (k * 10 + 1000).cast("string"), "</span> ", sign, "</h3>",
        "<div data-cy=\"ad_description\"><h4>Опис</h4><div>", F.regexp_extract("html", "(?s)<article>(.*?)</article>", 1), "</div></div></div>",
        "<section><p>Місцезнаходження</p>", place, "</section><h4>Олена</h4><a href='/list/user/7'>Профіль</a><a href='tel:+380", F.lpad(k.cast("string"), 9, "0"), "'>xxx</a>",
    )
    rows = pages.page_details(table(spark, d, "pages").select("page_id", html.alias("html")))
    said = F.array_join(F.transform("parameters", lambda p: F.concat(p["label"], F.lit("="), p["value"])), "|")
    return rows.select("page_id", "title", "price", "currency", "description", said.alias("parameters"), "city", "region", "seller", F.get("phones", F.lit(0)).alias("phone"))


@query("""with l as (select page_id, regexp_extract_all(html, '<li><a href="/([^"]*)"', 1) as links from pages), c as (select page_id, unnest(links) as link, generate_subscripts(links, 1) as place from l)
select page_id, place::int as place, '/uk/d/' || place || '-' || page_id as url, 'Лот ' || place as title, (page_id + place * 1000)::double as price, 'UAH' as currency, 'Нові Петрівці' as location,
case when place % 2 = 0 then date '2026-02-04' else date '2026-03-09' end as listed, (place + 40)::double as area from c""")
def s9_page_cards(spark, d):
    """A list of results with a card for each link of a page; every second one is marked, or none are."""
    k = F.col("page_id").cast("string")

    def card(link, i):
        n = (i + 1).cast("string")
        day = F.when((i + 1) % 2 == 0, "04 лютого 2026 р.").otherwise("Вчора о 12:00")
        mark = F.when(F.col("page_id") % 2 == 0, " data-cy='l-card'").otherwise("")
        return F.concat(F.lit("<div"), mark, F.lit("><div><a href='/uk/d/"), n, F.lit("-"), k, F.lit("'><h6>Лот "), n, F.lit("</h6></a><p data-cy=ad-price>"), (F.col("page_id") + (i + 1) * 1000).cast("string"), F.lit(" грн<p><span class='css-location'>Нові Петрівці - "), day, F.lit("</span><span>"), (i + 41).cast("string"), F.lit(" м²</span></div></div>"))

    links = F.regexp_extract_all("html", F.lit('<li><a href="/([^"]*)"'), F.lit(1))
    html = F.concat(F.lit("<body><main>"), F.array_join(F.transform(links, card), "\n"), F.lit("</main><a href='/help'>?</a>"))
    rows = pages.page_cards(table(spark, d, "pages").select("page_id", html.alias("html")), F.to_date(F.lit("2026-03-10")))
    return rows.select("page_id", "place", "url", "title", "price", "currency", "location", "listed", "area")


@query("select s_suppkey as id, round((1 + s_suppkey % 4) * (1 + s_suppkey % 4) * 2 * (4 - 4.0::double * (1 + s_suppkey % 3) / (5 + s_suppkey % 3)), 6) as area, 4 as n_points from supplier")
def g14_repaired_rings(spark, d):
    """Bow ties with a spike: the larger wing is what is left."""
    k = F.col("s_suppkey")
    w, v = 1 + k % 4, 1 + k % 3
    p = lambda x, y: F.array((k + x * w).cast("double"), (k + y * w).cast("double"))
    zero, four = F.lit(0), F.lit(4)
    ring = F.array(p(zero, zero), p(four, four), p(four, zero), p(F.lit(6), zero), p(four, zero), p(zero, v), p(zero, zero))
    found = polygons.valid_rings(table(spark, d, "supplier").select("s_suppkey", ring.alias("ring")), "s_suppkey", "ring")
    return found.select("id", F.round("area", 6).alias("area"), F.size("ring").alias("n_points"))


_LAT = "degrees(atan((exp(pi() * (1 - 2 * (ty + ({0}) / 4096.0::double) / 4096)) - exp(-pi() * (1 - 2 * (ty + ({0}) / 4096.0::double) / 4096))) / 2))"


@query(f"""with p as (select c_custkey, 2300 + c_custkey * 7919 % 97 as tx, 1380 + c_custkey * 6007 % 89 as ty, 100 + c_custkey % 3000 as px, 200 + c_custkey * 31 % 3000 as py, 4 + c_custkey % 50 as r from customer)
select '3200000000:' || c_custkey as number, case when c_custkey % 7 = 0 then 2500.0::double else (c_custkey % 900 + 1)::double end as area, case when c_custkey % 3 > 0 then '01.0' || c_custkey % 3 end as purpose,
round((tx + (px - r) / 4096.0::double) / 4096 * 360 - 180, 7) as x0, round({_LAT.format("py + r")}, 7) as y0, round((tx + (px + r) / 4096.0::double) / 4096 * 360 - 180, 7) as x1, round({_LAT.format("py - r")}, 7) as y1 from p""")
def s11_map_tiles(spark, d):
    """Every customer is a parcel with a hole, written to the tile that its key gives and read back from there."""
    k = F.col("c_custkey")
    px, py, r = 100 + k % 3000, 200 + k * 31 % 3000, 4 + k % 50
    p = lambda dx, dy: F.array(px + dx, py + dy)
    zero = F.lit(0)
    rings = F.array(F.array(p(zero, zero - 2), p(zero - 2, zero), p(zero, zero + 2), p(zero + 2, zero)), F.array(p(zero, -r), p(r, zero), p(zero, r), p(-r, zero)))
    area = F.when(k % 7 == 0, "0.25").otherwise((k % 900 + 1).cast("string"))
    purpose = F.when(k % 3 > 0, F.concat(F.lit("01.0"), (k % 3).cast("string")))
    said = F.create_map(F.lit("cadnum"), F.concat(F.lit("3200000000:"), k.cast("string")), F.lit("area"), area, F.lit("purpose_code"), purpose)
    rows = table(spark, d, "customer").select((2300 + k * 7919 % 97).alias("x"), (1380 + k * 6007 % 89).alias("y"), k.alias("id"), rings.alias("rings"), said.alias("properties"))
    parts = tiles.tile_parts(rows, "land_polygons").withColumn("zoom", F.lit(12))
    found = tiles.tile_parcels(tiles.tile_features(parts, "data", "x", "y", "zoom"))
    return found.select("number", "area", "purpose", *[F.round(c, 7).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("""select p_partkey, case p_size % 6 when 0 then 'Землі с/г призначення' when 1 then 'Земельна ділянка з нерухомістю' when 2 then 'Комерційна нерухомість' when 3 then 'Земельна ділянка' when 4 then 'Земельна ділянка' else 'інше' end as kind from part""")
def p17_stored_kind(spark, d):
    """The stored kind decides where it says something (0 to 3), the text where it does not."""
    stored = F.element_at(F.array(*[F.lit(x) for x in ("Земля С/Г", "Ділянка з будівлею", "нерухомість", "ЗЕМЛЯ", "  ", None)]), (F.col("p_size") % 6 + 1).cast("int"))
    text = F.concat(F.when(F.col("p_size") % 6 == 5, "").otherwise("10 соток "), F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", L.kind_of_listing(stored, text).alias("kind"))


@query("""select s_suppkey, if(s_suppkey % 2 = 0, '3221400000:01:001:' || lpad((s_suppkey % 10000)::varchar, 4, '0'), null) as cadastral_number, case when s_suppkey % 3 = 0 then 'Львівська' when s_suppkey % 2 = 0 then 'Київська' end as region, 'Буча' as settlement,
'Соборності' as street, (s_suppkey % 40)::varchar as building, case s_suppkey % 4 when 0 then 'електрика, вода, газ, опалення' when 1 then 'відсутні' end as utilities, if(s_suppkey % 5 = 0, 'Є обтяження', null) as encumbrances from supplier""")
def p26_item_facts(spark, d):
    k = F.col("s_suppkey")
    number = F.when(k % 2 == 0, F.concat(F.lit(" 3221400000:01:001:"), F.lpad((k % 10000).cast("string"), 4, "0"))).otherwise("")
    item = F.struct(number.alias("cadastral_number"), F.when(k % 4 < 2, k % 4 == 0).alias("utilities"), (k % 5 == 0).alias("encumbered"), F.when(k % 3 == 0, "Львівська обл.").alias("region"), F.lit("Буча").alias("locality"), F.concat(F.lit("вул. Соборності, "), (k % 40).cast("string")).alias("street"))
    return table(spark, d, "supplier").select("s_suppkey", P.item_facts(item).alias("i")).select("s_suppkey", "i.*").drop("formatted_address")
