"""Every operator shown on the driver's tables, with the SQL that gives the same rows.

Reading of the tables: l_extendedprice is a price, l_quantity an area, their ratio a unit price; p_type a property type;
l_returnflag a source; nation and region a settlement and its region, by the supplier; events is the log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrane.functions import columns as C
from terrane.operators import changes, groups, joins, stats
from terrane.operators.components import components
from terrane.sources import files
from terrane.sources.storage import table
from terrane.streaming import events as ev

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def placed(spark: SparkSession, d: str) -> DataFrame:
    """lineitem with its supplier's nation and region."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    s = s.join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "n_name", "r_name")
    return table(spark, d, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey"))


PLACED = "lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey"


def typed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))


# scans, filters, projections


@query("select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity >= 45 and l_discount <> 0.05 and l_returnflag = 'R' and l_tax < 0.06")
def f2_compare(spark, d):
    li = table(spark, d, "lineitem")
    return li.where((F.col("l_quantity") >= 45) & C.differs(F.col("l_discount"), 0.05) & (F.col("l_returnflag") == "R") & (F.col("l_tax") < 0.06)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("select p_partkey, p_brand, p_size from part where p_size in (1, 5, 9, 14) and (p_type is null or p_type not in (select min(p_type) from part))")
def f3_in_nin(spark, d):
    p = table(spark, d, "part")
    first = p.agg(F.min("p_type")).first()[0]
    return p.where(F.col("p_size").isin(1, 5, 9, 14) & C.not_in(F.col("p_type"), [first])).select("p_partkey", "p_brand", "p_size")


@query("select l_orderkey, l_linenumber from lineitem where (l_quantity > 48 or (l_discount = 0.1 and l_tax = 0)) and not (l_returnflag = 'N' or l_linestatus = 'O')")
def f5_nested_or_not(spark, d):
    li = table(spark, d, "lineitem")
    keep = ((F.col("l_quantity") > 48) | ((F.col("l_discount") == 0.1) & (F.col("l_tax") == 0))) & C.none_of(F.col("l_returnflag") == "N", F.col("l_linestatus") == "O")
    return li.where(keep).select("l_orderkey", "l_linenumber")


@query("select o_orderkey, o_orderstatus from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 45 and l_returnflag = 'R')")
def f6_elem_match(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return joins.with_any(o, table(spark, d, "lineitem"), ("o_orderkey", "l_orderkey"), (F.col("l_quantity") > 45) & (F.col("l_returnflag") == "R"))


@query("select doc_id, lang from documents where contains(lower(text), 'license')")
def f8_contains_ci(spark, d):
    return table(spark, d, "documents").where(C.contains(F.col("text"), "LICENSE")).select("doc_id", "lang")


@query("select lang, count(*) filter (text is not null and text <> '') as n_filled, count(*) filter (text is null or text = '') as n_empty from documents group by lang")
def f9_filled_empty(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count_if(C.filled(F.col("text"))).alias("n_filled"), F.count_if(C.empty(F.col("text"))).alias("n_empty"))


@query("select o_orderkey, l_linenumber from orders join lineitem on o_orderkey = l_orderkey where o_orderdate between timestamp '1997-01-01' and timestamp '1997-02-01' or l_shipdate between timestamp '1997-01-01' and timestamp '1997-02-01'")
def f19_two_dates(spark, d):
    both = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    at = lambda s: F.to_timestamp_ntz(F.lit(s))
    lo, hi = at("1997-01-01 00:00:00"), at("1997-02-01 00:00:00")
    return both.where(F.col("o_orderdate").between(lo, hi) | F.col("l_shipdate").between(lo, hi)).select("o_orderkey", "l_linenumber")


@query("select event_type, count(*) as n from events, (select max(ts) as now from events) where ts >= date_trunc('day', now - interval 7 days) group by event_type")
def f18_since(spark, d):
    e = table(spark, d, "events")
    now = e.agg(F.max("ts").alias("now"))
    return e.join(F.broadcast(now)).where(F.col("ts") >= F.date_trunc("day", F.col("now") - F.expr("interval 7 days")).cast("timestamp_ntz")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("select l_orderkey, l_linenumber, l_extendedprice, case when l_extendedprice > 0 and l_quantity > 0 then l_extendedprice / l_quantity end as unit_price, l_extendedprice * (1 - l_discount) as net from lineitem")
def p3_addfields(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", C.unit_price(F.col("l_extendedprice"), F.col("l_quantity")).alias("unit_price"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))


@query("select event_id, coalesce(try_cast(json_extract_string(props, '$.price') as double), try_cast(json_extract_string(props, '$.k') as double), value) as amount from events")
def p6_coalesce_chain(spark, d):
    pick = C.first_number(F.get_json_object("props", "$.price"), F.get_json_object("props", "$.k"), F.col("value"))
    return table(spark, d, "events").select("event_id", pick.alias("amount"))


@query("""select l_orderkey, l_linenumber, l_extendedprice / 41.5 as price_usd, l_extendedprice / l_quantity as price_per_m2_uah, (l_extendedprice / 41.5) / l_quantity as price_per_m2_usd,
          l_extendedprice / ((l_quantity * 37) / 10000.0) as price_per_ha_uah, (l_extendedprice / 41.5) / ((l_quantity * 37) / 10000.0) as price_per_ha_usd from lineitem""")
def p10_price_metrics(spark, d):
    m = C.price_metrics(F.col("l_extendedprice"), F.col("l_quantity"), F.col("l_quantity") * 37, F.lit(41.5))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[c.alias(n) for n, c in m.items()])


@query("""with v as (select l_orderkey, l_returnflag, count(*) as n, min(l_linenumber) as met from lineitem group by all)
          select l_orderkey, l_returnflag, n as n_votes from v qualify row_number() over (partition by l_orderkey order by n desc, met, l_returnflag) = 1""")
def p11_majority_vote(spark, d):
    return groups.majority(table(spark, d, "lineitem"), ["l_orderkey"], "l_returnflag", F.col("l_linenumber"))


@query("select l_orderkey, l_linenumber, case when l_tax > 0 and l_discount > 0 then 'mixed' when l_discount > 0 then 'land' when l_tax > 0 then 'real_estate' else 'general' end as kind, case l_returnflag when 'A' then l_quantity * 100.0 when 'N' then l_quantity * 10000.0 else l_quantity * 1.0 end as sqm from lineitem")
def p15_p16_area_and_kind(spark, d):
    unit = F.when(F.col("l_returnflag") == "A", "sotky").when(F.col("l_returnflag") == "N", "hectares").otherwise("sqm")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", C.listing_type(F.col("l_tax"), F.col("l_discount")).alias("kind"), C.square_metres(F.col("l_quantity") * 1.0, unit).alias("sqm"))


# joins


@query("select c_custkey, (select count(*) from orders where o_custkey = c_custkey) as n_orders from customer")
def j1_lookup_array(spark, d):
    return joins.lookup_count(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders"), ("c_custkey", "o_custkey"), "n_orders")


@query("select c_custkey, coalesce((select string_agg(o_orderkey::varchar, ',' order by o_orderkey) from orders where o_custkey = c_custkey), '') as orders from customer")
def j1_lookup_elements(spark, d):
    out = joins.lookup_array(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select("o_custkey", "o_orderkey"), ("c_custkey", "o_custkey"), "orders")
    return out.select("c_custkey", F.array_join(F.array_sort("orders.o_orderkey").cast("array<string>"), ",").alias("orders"))


@query("select c_custkey, o_orderkey from customer left join orders on o_custkey = c_custkey")
def j2_lookup_unwind(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("select doc_id, lang from documents where doc_id in (select doc_id from labels where quality = 1)")
def j4_semi(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels").where("quality = 1"), "doc_id", "left_semi").select("doc_id", "lang")


@query("select doc_id, lang from documents where doc_id not in (select doc_id from labels)")
def j8_anti(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "lang")


@query("""select coalesce(c_nationkey, s_nationkey) as nation, round(c, 4) as bal_a, round(s, 4) as bal_b, round(c - s, 4) as difference from
          (select c_nationkey, avg(c_acctbal) as c from customer where c_mktsegment = (select min(c_mktsegment) from customer) group by 1) full join (select s_nationkey, avg(s_acctbal) as s from supplier group by 1) on c_nationkey = s_nationkey""")
def j5_full_outer_diff(spark, d):
    c = table(spark, d, "customer")
    first = c.agg(F.min("c_mktsegment").alias("m"))
    a = c.join(F.broadcast(first), F.col("c_mktsegment") == F.col("m")).groupBy(F.col("c_nationkey").alias("nation")).agg(F.avg("c_acctbal").alias("bal"))
    b = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.avg("s_acctbal").alias("bal"))
    out = joins.full_outer_difference(a, b, "nation", "bal")
    return out.select("nation", *[F.round(x, 4).alias(x) for x in ("bal_a", "bal_b", "difference")])


_J6 = f"""with b as (select *, l_extendedprice / l_quantity as v from {PLACED}),
k as (select 'n:' || n_name as key, quantile_cont(v, 0.5) as q2, count(*) as n from b group by n_name having count(*) >= {{least}} union all
      select 'r:' || r_name, quantile_cont(v, 0.5), count(*) from b group by r_name)
select s_suppkey, coalesce(kn.key, kr.key) as used, round(coalesce(kn.q2, kr.q2), 6) as q2 from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
left join k kn on kn.key = 'n:' || n_name left join k kr on kr.key = 'r:' || r_name"""


@query(_J6.format(least=2400))
def j6_priority_fallback(spark, d):
    b = placed(spark, d).withColumn("v", F.col("l_extendedprice") / F.col("l_quantity"))
    level = lambda p, c: stats.quartiles(b.withColumn("ind_key", F.concat(F.lit(p), c)), ["ind_key"], F.col("v")).select("ind_key", "q2", "n")
    ind = level("n:", F.col("n_name")).where("n >= 2400").unionByName(level("r:", F.col("r_name"))).withColumn("used", F.col("ind_key"))
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    out = joins.first_match(s.select("s_suppkey", "n_name", "r_name"), ind, [F.concat(F.lit("n:"), "n_name"), F.concat(F.lit("r:"), "r_name")], "ind_key", ["s_suppkey"])
    return out.select("s_suppkey", "used", F.round("q2", 6).alias("q2"))


@query("select doc_id, row_number() over w - 1 as n_earlier, case when row_number() over w > 1 then first(doc_id) over w else -1 end as first_id from documents window w as (partition by md5(text) order by doc_id)")
def j16_repeat_posting(spark, d):
    out = joins.repeats(table(spark, d, "documents"), F.md5(F.col("text").cast("binary")), "doc_id", "doc_id")
    return out.withColumn("first_id", F.coalesce("first_id", F.lit(-1)))


@query("select c_custkey, max(o_orderkey) filter (o_orderdate = (select max(o_orderdate) from orders o2 where o2.o_custkey = c_custkey and o2.o_orderdate <= timestamp '1998-01-01')) as last_order from customer join orders on o_custkey = c_custkey where o_orderdate <= timestamp '1998-01-01' group by c_custkey")
def j13_as_of(spark, d):
    o = table(spark, d, "orders").where(F.col("o_orderdate") <= F.to_timestamp_ntz(F.lit("1998-01-01 00:00:00")))
    return o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_order"))


@query("""with s as (select s_suppkey as a, s_nationkey as n, s_acctbal as x from supplier) select s1.a as a, s2.a as b from s s1 join s s2 on s1.n = s2.n and s1.a < s2.a and abs(s1.x - s2.x) <= 500""")
def j14_near_self_join(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("a"), F.col("s_nationkey").alias("n"), F.col("s_acctbal").alias("x"), F.floor(F.col("s_acctbal") / 500).alias("cell"))
    other = s.select(F.col("a").alias("b"), "n", F.col("x").alias("y"), F.explode(F.array(*[F.col("cell") + k for k in (-1, 0, 1)])).alias("cell"))
    return s.join(other, ["n", "cell"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("x") - F.col("y")) <= 500)).select("a", "b")


# aggregations


@query("""select p_brand, round(avg(l_extendedprice / l_quantity), 4) as value, count(*) as count from lineitem join part on l_partkey = p_partkey
          where l_extendedprice / l_quantity > 0 and l_returnflag <> 'R' group by p_brand order by avg(l_extendedprice / l_quantity) desc, p_brand limit 100""")
def a5_extract_avg(spark, d):
    rows = typed(spark, d).where(C.differs(F.col("l_returnflag"), "R"))
    out = groups.by_metric(rows, C.unit_price(F.col("l_extendedprice"), F.col("l_quantity")), "avg", [F.coalesce("p_brand", F.lit("")).alias("p_brand")], True, 100)
    return out.withColumn("value", F.round("value", 4))


def _extract(how: str):
    def run(spark, d):
        out = groups.by_metric(typed(spark, d), F.col("l_extendedprice"), how, [F.coalesce("p_type", F.lit("")).alias("p_type")], True)
        return out.withColumn("value", F.round(F.col("value").cast("double"), 2))

    return run


for _how in ("sum", "min", "max", "count"):
    QUERIES[f"a5_extract_{_how}"] = _extract(_how)
    ORACLE_SQL[f"a5_extract_{_how}"] = f"select p_type, round({_how}(l_extendedprice)::double, 2) as value, count(*) as count from lineitem join part on l_partkey = p_partkey where l_extendedprice > 0 group by p_type"

_PARTS = {"year": "year(o_orderdate)", "month": "month(o_orderdate)", "quarter": "quarter(o_orderdate)"}


def _by_part(part: str):
    def run(spark, d):
        out = groups.by_metric(table(spark, d, "orders"), F.col("o_totalprice"), "avg", [F.expr(_PARTS[part]).alias("key")])
        return out.select("key", F.round("value", 4).alias("value"), "count")

    return run


for _part, _sql in _PARTS.items():
    QUERIES[f"a2_metric_group_{_part}"] = _by_part(_part)
    ORACLE_SQL[f"a2_metric_group_{_part}"] = f"select {_sql}::int as key, round(avg(o_totalprice), 4) as value, count(*) as count from orders group by 1"


@query("select o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) as value, count(*) as count from orders group by all")
def a2_metric_group_status(spark, d):
    out = groups.by_metric(table(spark, d, "orders"), F.col("o_totalprice"), "sum", [F.col("o_orderstatus"), F.col("o_orderpriority")])
    return out.withColumn("value", F.round("value", 2))


@query("""select l_returnflag, round(sum(l_quantity), 2) as s, round(avg(l_quantity), 6) as a, min(l_quantity) as lo, max(l_quantity) as hi, round(stddev_pop(l_quantity), 6) as sp, round(stddev_samp(l_quantity), 6) as ss,
          count(*) as n, count(distinct l_suppkey) as n_set, arg_min(l_extendedprice, l_orderkey * 100 + l_linenumber) as first_price, arg_max(l_extendedprice, l_orderkey * 100 + l_linenumber) as last_price from lineitem group by 1""")
def a1_accumulators(spark, d):
    q, order = F.col("l_quantity"), F.col("l_orderkey") * 100 + F.col("l_linenumber")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(q), 2).alias("s"), F.round(F.avg(q), 6).alias("a"), F.min(q).alias("lo"), F.max(q).alias("hi"), F.round(F.stddev_pop(q), 6).alias("sp"), F.round(F.stddev_samp(q), 6).alias("ss"), F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("n_set"), F.min_by("l_extendedprice", order).alias("first_price"), F.max_by("l_extendedprice", order).alias("last_price"))


@query("select o_orderstatus, count(*) as count from orders group by 1")
def a6_count(spark, d):
    return groups.count_rows(table(spark, d, "orders"), [F.col("o_orderstatus")])


@query("select p_size as value, count(*) as count from part group by 1 order by 2 desc, 1 limit 50")
def a9_histogram(spark, d):
    return groups.histogram(table(spark, d, "part"), F.col("p_size"))


@query("select strftime(ts, '%Y-%m-%d') as day, count(*) as n, round(avg(value), 6) as mean from events group by 1")
def a10_time_series(spark, d):
    return table(spark, d, "events").groupBy(C.day_key(F.col("ts")).alias("day")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("""select p_type, round(quantile_cont(l_extendedprice, 0.25), 6) as q1, round(quantile_cont(l_extendedprice, 0.5), 6) as q2, round(quantile_cont(l_extendedprice, 0.75), 6) as q3, max(l_extendedprice) as q4,
          round(stddev_pop(l_extendedprice), 4) as std from lineitem join part on l_partkey = p_partkey where l_extendedprice > 0 group by 1""")
def a12_quartiles(spark, d):
    counts = stats.positive(typed(spark, d), ["p_type"], F.col("l_extendedprice"))
    out = stats.with_moments(counts, ["p_type"], stats.quartiles_of(counts, ["p_type"])).drop("n", "avg")
    return out.withColumns({q: F.round(q, 6) for q in ("q1", "q2", "q3")}).withColumn("std", F.round("std", 4))


@query(f"""with b as (select l_returnflag as kind, r_name, n_name, l_extendedprice / l_quantity as v from {PLACED}),
f as (select kind, quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.5) as q2, quantile_cont(v, 0.75) as q3, max(v) as q4 from b where v > 0 group by 1 having count(*) >= 3),
t as (select b.* from b join f using (kind) where v > 0 and v >= q1 - 2 * greatest(q3 - q1, 0.05 * q2) and v <= q4 + 2 * greatest(q3 - q1, 0.05 * q2))
select kind, r_name, n_name, round(quantile_cont(v, 0.25), 6) as q1, round(quantile_cont(v, 0.5), 6) as q2, round(quantile_cont(v, 0.75), 6) as q3, round(max(v), 6) as q4, count(*) as count from t group by 1, 2, 3 having count(*) >= 5
union all select kind, r_name, null, round(quantile_cont(v, 0.25), 6), round(quantile_cont(v, 0.5), 6), round(quantile_cont(v, 0.75), 6), round(max(v), 6), count(*) from t group by 1, 2 having count(*) >= 3""")
def a15_indicators(spark, d):
    b = placed(spark, d).select(F.col("l_returnflag").alias("kind"), "r_name", "n_name", (F.col("l_extendedprice") / F.col("l_quantity")).alias("v"))
    out = stats.indicators(b, "v", "kind", "r_name", "n_name")
    return out.withColumns({q: F.round(q, 6) for q in ("q1", "q2", "q3", "q4")})


_METRICS = {"price": "l_extendedprice", "unit_price": "l_extendedprice / l_quantity", "usd": "l_extendedprice / 41.5", "unit_usd": "l_extendedprice / 41.5 / l_quantity", "per_ha": "l_extendedprice / (l_quantity / 10000.0)", "per_ha_usd": "l_extendedprice / 41.5 / (l_quantity / 10000.0)"}
_KEYS = {"day": "strftime(l_shipdate, '%Y-%m-%d')", "week": "strftime(l_shipdate, '%G-W%V')", "month": "strftime(l_shipdate, '%Y-%m')"}


def _rollup_sql(dims: str, metrics: list[str], keys: list[str]) -> str:
    one = "select '{m}' as metric, '{p}' as period_type, {k} as period_key, {dims}, avg(v) as avg, stddev_pop(v) as std, count(*) as count, quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.5) as q2, quantile_cont(v, 0.75) as q3, max(v) as q4 from (select *, {v} as v from b) group by all"
    parts = [one.format(m=m, p=p, k=_KEYS[p], v=_METRICS[m], dims=dims) for m in metrics for p in keys]
    rounded = ", ".join(f"round({c} + 3e-7, 4) as {c}" for c in ("avg", "std", "q1", "q2", "q3", "q4"))
    return f"with b as (select * from {PLACED} join part on l_partkey = p_partkey), r as ({' union all '.join(parts)}) select metric, period_type, period_key, {dims}, count, {rounded} from r"


def _periods(keys: list[str]) -> dict:
    at = F.col("l_shipdate")
    return {k: {"day": C.day_key, "week": C.week_key, "month": C.month_key}[k](at) for k in keys}


def _rounded(df: DataFrame) -> DataFrame:
    """To four places, off the halves that a mean of two prices falls on."""
    return df.withColumns({q: F.round(F.col(q) + 3e-7, 4) for q in ("avg", "std", "q1", "q2", "q3", "q4")})


@query(_rollup_sql("p_type", ["unit_price"], ["day", "week", "month"]))
def a17_period_rollup(spark, d):
    b = typed(spark, d).withColumn("unit_price", F.expr(_METRICS["unit_price"]))
    return _rounded(stats.period_rollup(b, _periods(["day", "week", "month"]), ["p_type"], ["unit_price"]))


@query(_rollup_sql("l_returnflag, p_type, r_name, n_name", list(_METRICS), ["month"]))
def a17_all_metrics(spark, d):
    """Six metrics by source, type, region and settlement."""
    b = placed(spark, d).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    b = b.withColumns({m: F.expr(e) for m, e in _METRICS.items()})
    return _rounded(stats.period_rollup(b, _periods(["month"]), ["l_returnflag", "p_type", "r_name", "n_name"], list(_METRICS)))


@query("""with q as (select l_suppkey, quantile_cont(l_extendedprice, 0.25) as q1, quantile_cont(l_extendedprice, 0.5) as q2, quantile_cont(l_extendedprice, 0.75) as q3, max(l_extendedprice) as q4 from lineitem group by 1)
select l_orderkey, l_linenumber, case when l_extendedprice < q1 - 1.5 * s then 'abnormally_low' when l_extendedprice <= q1 then 'good' when l_extendedprice <= (q2 + q3) / 2 then 'below_average'
 when l_extendedprice <= (q3 + q4) / 2 then 'average' when l_extendedprice <= q3 + 1.5 * s then 'above_average' else 'abnormally_high' end as label
from lineitem join (select *, greatest(q3 - q1, 0.05 * q2, 1) as s from q) using (l_suppkey)""")
def w8_price_label(spark, d):
    li = table(spark, d, "lineitem")
    q = stats.quartiles(li, ["l_suppkey"], F.col("l_extendedprice"))
    label = C.position_label(F.col("l_extendedprice"), *[F.col(x) for x in ("q1", "q2", "q3", "q4")])
    return li.join(q, "l_suppkey").select("l_orderkey", "l_linenumber", label.alias("label"))


@query("""with b as (select l_orderkey, l_linenumber, l_returnflag, l_extendedprice * (1 + 9 * (l_orderkey % 997 = 0)::int) as v from lineitem),
a as (select quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.5) as q2, quantile_cont(v, 0.75) as q3 from b), g as (select l_returnflag, quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.5) as q2, quantile_cont(v, 0.75) as q3 from b group by 1),
x as (select b.*, a.q1 - 1.5 * greatest(a.q3 - a.q1, 0.05 * a.q2) as al, a.q3 + 1.5 * greatest(a.q3 - a.q1, 0.05 * a.q2) as ah, g.q1 - 1.5 * greatest(g.q3 - g.q1, 0.05 * g.q2) as gl, g.q3 + 1.5 * greatest(g.q3 - g.q1, 0.05 * g.q2) as gh from b, a, g where b.l_returnflag = g.l_returnflag)
select l_orderkey, l_linenumber, case when v < al or v > ah then 'global' else 'local' end as scope, round(case when v < al then al - v when v > ah then v - ah when v < gl then gl - v else v - gh end, 4) as distance from x where v < al or v > ah or v < gl or v > gh""")
def n5_anomalies(spark, d):
    v = F.col("l_extendedprice") * (1 + 9 * (F.col("l_orderkey") % 997 == 0).cast("int"))
    out = stats.anomalies(table(spark, d, "lineitem").withColumn("v", v), "v", ["l_returnflag"])
    return out.select("l_orderkey", "l_linenumber", "scope", F.round("distance", 4).alias("distance"))


@query("select distinct p_brand as value from part where p_brand <> '' order by 1 limit 500")
def a19_distinct(spark, d):
    return groups.distinct_values(table(spark, d, "part"), F.col("p_brand"))


@query("select n_name as value from nation union select r_name from region")
def a20_union_distinct(spark, d):
    return table(spark, d, "nation").select(F.col("n_name").alias("value")).union(table(spark, d, "region").select("r_name")).distinct()


@query("select l_orderkey, count(distinct l_suppkey) as n_bidders from lineitem group by 1")
def a21_unique_nested(spark, d):
    bids = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_suppkey")).alias("bids"))
    return bids.select("l_orderkey", F.size(F.array_distinct("bids.l_suppkey")).cast("long").alias("n_bidders"))


@query("select l_suppkey, count(distinct l_orderkey) as n_orders from lineitem group by 1 having count(distinct l_orderkey) > 590")
def a22_multi_participant(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_orderkey").alias("n_orders")).where("n_orders > 590")


@query("select strftime(ts, '%Y-%m-%d') as day, count(*) as n, coalesce(sum(try_cast(json_extract_string(props, '$.k') as bigint)), 0)::bigint as total from events group by 1")
def a23_daily_counts(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, d, "events").groupBy(C.day_key(F.col("ts")).alias("day")).agg(F.count("*").alias("n"), F.coalesce(F.sum(k), F.lit(0)).alias("total"))


@query("select coalesce(nullif(event_type, ''), 'unknown') as source, count(*) as n, round(sum(value), 4) as total from events group by 1")
def a25_by_source(spark, d):
    return table(spark, d, "events").groupBy(F.coalesce(F.nullif("event_type", F.lit("")), F.lit("unknown")).alias("source")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("select user_id, count(*) filter (event_type = 'click') as click, count(*) filter (event_type = 'view') as view, count(*) filter (event_type = 'purchase') as purchase, count(*) as total from events group by 1")
def a26_status_pivot(spark, d):
    return groups.status_counts(table(spark, d, "events"), ["user_id"], "event_type", ["click", "view", "purchase"])


@query("select count(*) filter (event_type = 'error') as errors, count(*) as total, round(count(*) filter (event_type = 'error') / count(*), 6) as ratio, round(count(*) / (count(distinct ts::date)) * 30, 4) as per_month from events")
def a28_ratio(spark, d):
    n, bad = F.count("*"), F.count_if(F.col("event_type") == "error")
    return table(spark, d, "events").agg(bad.alias("errors"), n.alias("total"), F.round(bad / n, 6).alias("ratio"), F.round(n / F.count_distinct(F.to_date("ts")) * 30, 4).alias("per_month"))


@query("select p_brand, min(p_retailprice) as lo, max(p_retailprice) as hi, round(avg(p_retailprice), 6) as mean, count(p_retailprice) as n from part group by 1")
def a30_numeric_profile(spark, d):
    v = F.col("p_retailprice")
    return table(spark, d, "part").groupBy("p_brand").agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.round(F.avg(v), 6).alias("mean"), F.count(v).alias("n"))


@query("select source as value, count(*) as count from documents group by 1 order by 2 desc, 1 limit 50")
def a31_categorical_profile(spark, d):
    return groups.histogram(table(spark, d, "documents"), F.col("source"))


@query("select unnest(['doc_id', 'text', 'lang', 'source']) as field, unnest([count(doc_id), count(text), count(lang), count(source)]) as present, 1.0::double as rate from documents")
def a32_schema_profile(spark, d):
    return groups.unpivot_counts(table(spark, d, "documents"), ["doc_id", "text", "lang", "source"])


@query("select case when l_quantity >= 0 and l_quantity < 10 then '0' when l_quantity < 25 then '10' when l_quantity < 50 then '25' else 'other' end as bucket, count(*) as n from lineitem group by 1")
def a40_bucket(spark, d):
    return table(spark, d, "lineitem").groupBy(groups.buckets(F.col("l_quantity"), [0, 10, 25, 50]).alias("bucket")).agg(F.count("*").alias("n"))


@query("select q as bucket, count(*) as n, min(l_extendedprice) as lo, max(l_extendedprice) as hi from (select l_extendedprice, width_bucket_4 as q from (select l_extendedprice, case when l_extendedprice <= a then 1 when l_extendedprice <= b then 2 when l_extendedprice <= c then 3 else 4 end as width_bucket_4 from lineitem, (select quantile_cont(l_extendedprice, 0.25) as a, quantile_cont(l_extendedprice, 0.5) as b, quantile_cont(l_extendedprice, 0.75) as c from lineitem))) group by 1")
def a40_bucket_auto(spark, d):
    li = table(spark, d, "lineitem")
    q = stats.quartiles(li, [], F.col("l_extendedprice"))
    v = F.col("l_extendedprice")
    bucket = F.when(v <= F.col("q1"), 1).when(v <= F.col("q2"), 2).when(v <= F.col("q3"), 3).otherwise(4)
    return li.join(F.broadcast(q)).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"))


@query("select 'flag' as facet, l_returnflag as value, count(*) as n from lineitem group by 2 union all select 'status', l_linestatus, count(*) from lineitem group by 2")
def a40_facet(spark, d):
    li = table(spark, d, "lineitem").groupingSets([["l_returnflag"], ["l_linestatus"]], "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping("l_returnflag").alias("g"))
    return li.select(F.when(F.col("g") == 0, "flag").otherwise("status").alias("facet"), F.when(F.col("g") == 0, F.col("l_returnflag")).otherwise(F.col("l_linestatus")).alias("value"), "n")


@query("with k as (select strftime(ts, '%Y-%m-%d') as day, sum(value) as v from events where event_type = 'purchase' group by 1 order by 1 desc limit 5) select count(*) as n_days, round(sum(v), 6) as total from k")
def a41_last_n_days(spark, d):
    k = table(spark, d, "events").where("event_type = 'purchase'").groupBy(C.day_key(F.col("ts")).alias("day")).agg(F.sum("value").alias("v"))
    return k.orderBy(F.desc("day")).limit(5).agg(F.count("*").alias("n_days"), F.round(F.sum("v"), 6).alias("total"))


@query("with c as (select event_type, count(*) as n from events group by 1) select event_type, n, round((least(n, 500) * 0.005 + least(greatest(n - 500, 0), 1000) * 0.004 + greatest(n - 1500, 0) * 0.003)::double, 6) as cost from c")
def a42_tiered_cost(spark, d):
    c = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return c.select("event_type", "n", F.round(stats.tiered_cost(F.col("n"), [(0, 500, 0.005), (500, 1500, 0.004), (1500, None, 0.003)]), 6).alias("cost"))


@query("with k as (select * from documents join labels using (doc_id) order by doc_id desc limit 200) select lang, round(avg((quality = 1)::int), 6) as good, count(*) as n from k group by 1")
def a43_quality_ratio(spark, d):
    k = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").orderBy(F.desc("doc_id")).limit(200)
    return k.groupBy("lang").agg(F.round(F.avg((F.col("quality") == 1).cast("int")), 6).alias("good"), F.count("*").alias("n"))


@query("select r_name, n_name, l_returnflag, round(sum(l_quantity), 2) as q, grouping(r_name, n_name, l_returnflag)::bigint as level from " + PLACED + " group by rollup (r_name, n_name, l_returnflag)")
def a32_rollup(spark, d):
    return placed(spark, d).rollup("r_name", "n_name", "l_returnflag").agg(F.round(F.sum("l_quantity"), 2).alias("q"), F.grouping_id().alias("level"))


# windows, orders, sets


@query("select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def w1_latest_per_key(spark, d):
    return groups.latest(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("""with p as (select conv_id, turn, text, role, lead(role) over w as next_role, lead(text) over w as reply from conversations window w as (partition by conv_id order by turn))
select conv_id, turn, text, reply, row_number() over (partition by conv_id order by turn desc)::int as n_back from p where role = 'user' and next_role = 'assistant' qualify row_number() over (partition by conv_id order by turn desc) <= 2""")
def w3_last_pairs(spark, d):
    return groups.last_exchanges(table(spark, d, "conversations"), "conv_id", "turn", 2)


@query("select regexp_replace(trim(url), '[?#].*$', '') as url, page_id from pages qualify row_number() over (partition by regexp_replace(trim(url), '[?#].*$', '') order by length(html) desc, page_id) = 1")
def w5_dedup_keep_fuller(spark, d):
    p = table(spark, d, "pages").withColumn("url", C.canonical_url(F.col("url")))
    return groups.latest(p, ["url"], [F.length("html").desc(), F.col("page_id")]).select("url", "page_id")


@query("select user_id, event_id, row_number() over (partition by user_id order by ts, event_id)::int as place, round(sum(value) over (partition by user_id order by ts, event_id rows unbounded preceding), 4) as running, lag(event_type) over (partition by user_id order by ts, event_id) as before from events")
def w6_running_order(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("user_id", "event_id", F.row_number().over(w).alias("place"), F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("running"), F.lag("event_type").over(w).alias("before"))


@query("select o_orderkey, o_totalprice from orders where o_totalprice is not null order by o_totalprice desc, o_orderkey limit 25")
def o3_top_n(spark, d):
    return groups.top_n(table(spark, d, "orders"), F.col("o_totalprice"), ["o_orderkey"], 25).select("o_orderkey", "o_totalprice")


@query("select 'customer' as source, c_custkey as key, c_acctbal as bal from customer union all select 'supplier', s_suppkey, s_acctbal from supplier order by bal desc, source, key limit 40")
def o4_multi_source_topk(spark, d):
    parts = {"customer": table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("bal")), "supplier": table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("bal"))}
    return groups.union_tagged(parts).orderBy(F.desc("bal"), "source", "key").limit(40).select("source", "key", "bal")


@query("select p_partkey, p_name from part order by lower(p_name), p_partkey limit 20 offset 40")
def o10_paging(spark, d):
    return table(spark, d, "part").orderBy(F.lower("p_name"), "p_partkey").offset(40).limit(20).select("p_partkey", "p_name")


@query("with q as (select embedding::double[] as q from embeddings where vec_id = 0) select vec_id, round(list_cosine_similarity(embedding::double[], q), 6) as score from embeddings, q where vec_id <> 0 order by list_cosine_similarity(embedding::double[], q) desc, vec_id limit 10")
def o8_cosine_topk(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    q = e.where("vec_id = 0").select(F.col("v").alias("q"))
    scored = e.where("vec_id <> 0").join(F.broadcast(q)).select("vec_id", C.cosine(F.col("v"), F.col("q")).alias("score"))
    return scored.orderBy(F.desc("score"), "vec_id").limit(10).select("vec_id", F.round("score", 6).alias("score"))


@query("(select c_nationkey as nation from customer intersect select s_nationkey from supplier) except select n_nationkey from nation where n_regionkey = 0")
def x_intersect_except(spark, d):
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation")).intersect(table(spark, d, "supplier").select("s_nationkey"))
    return a.subtract(table(spark, d, "nation").where("n_regionkey = 0").select("n_nationkey"))


# places and texts

_HAV = "2 * 6371.0 * asin(sqrt(pow(sin((radians(50.45) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(50.45)) * pow(sin((radians(30.52) - radians(lon)) / 2), 2)))"


@query(f"with s as (select s_suppkey, 44.0 + (s_suppkey % 80) / 10.0 as lat, 22.0 + (s_suppkey * 7 % 180) / 10.0 as lon from supplier) select s_suppkey, round({_HAV}, 4) as km from s where {_HAV} <= 300")
def g10_haversine_radius(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", (44.0 + F.col("s_suppkey") % 80 / 10.0).alias("lat"), (22.0 + F.col("s_suppkey") * 7 % 180 / 10.0).alias("lon"))
    km = C.kilometres(F.col("lat"), F.col("lon"), F.lit(50.45), F.lit(30.52))
    return s.withColumn("km", km).where("km <= 300").select("s_suppkey", F.round("km", 4).alias("km"))


@query("select page_id, regexp_replace(trim(url), '[?#].*$', '') as url from pages")
def t6_url(spark, d):
    return table(spark, d, "pages").select("page_id", C.canonical_url(F.col("url")).alias("url"))


@query("select doc_id, md5(array_to_string(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10))) as hash from documents")
def t18_description_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", C.description_hash(F.col("text")).alias("hash"))


@query("select min(doc_id) as doc_id, count(*) as n from documents group by md5(text) having count(*) > 1")
def n4_dup_by_hash(spark, d):
    return table(spark, d, "documents").groupBy(F.md5(F.col("text").cast("binary"))).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).where("n > 1").select("doc_id", "n")


@query("select c_custkey, try_cast(replace(regexp_replace(replace(format('{:.2f}', c_acctbal), '.', ' ,'), '\\s', '', 'g'), ',', '.') as double) as amount from customer")
def t1_number(spark, d):
    shown = F.replace(F.format_string("%.2f", F.col("c_acctbal")), F.lit("."), F.lit(" ,"))
    return table(spark, d, "customer").select("c_custkey", C.number(shown).alias("amount"))


_TEXT = r"trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"
_SAYS = lambda phrases: "regexp_matches(low, '" + "|".join(p.replace("'", "''") for p in phrases) + "')"


@query(rf"""with p as (select page_id, html, translate(lower(html), chr(160) || chr(8239), '  ') as low, {_TEXT} as text from pages)
select page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) as title, regexp_extract(html, '(?i)<html[^>]*\blang="([^"]*)"', 1) as lang, len(regexp_extract_all(html, '(?i)<a\s'))::int as n_links, length(text)::int as n_text,
case when trim(html) = '' then 'empty' when {_SAYS(files.BLOCKED)} then 'blocked' when {_SAYS(files.INACTIVE)} then 'inactive' when length(text) < 40 then 'empty' else 'ok' end as state from p""")
def s10_html_fields(spark, d):
    f = files.page_fields(F.col("html"))
    return table(spark, d, "pages").select("page_id", f["title"].alias("title"), f["lang"].alias("lang"), f["n_links"].alias("n_links"), F.length(f["text"]).alias("n_text"), files.page_state(F.col("html")).alias("state"))


# state, entities, streams


@query("""with o as (select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderkey % 10 < 7), n as (select o_orderkey, o_orderstatus, o_totalprice + (o_orderkey % 10 = 5)::int as o_totalprice from orders where o_orderkey % 10 > 3)
select coalesce(o.o_orderkey, n.o_orderkey) as o_orderkey, case when o.o_orderkey is null then 'new' when n.o_orderkey is null then 'gone' when o.o_totalprice = n.o_totalprice and o.o_orderstatus = n.o_orderstatus then 'same' else 'changed' end as change from o full join n on o.o_orderkey = n.o_orderkey""")
def r4_change_flags(spark, d):
    old, new = _snapshots(spark, d)
    return changes.compare(old, new, ["o_orderkey"], ["o_orderstatus", "o_totalprice"])


def _snapshots(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    last = F.col("o_orderkey") % 10
    return o.where(last < 7), o.where(last > 3).withColumn("o_totalprice", F.col("o_totalprice") + (last == 5).cast("int"))


@query("select o_orderkey, o_orderstatus, o_totalprice + (o_orderkey % 10 = 5)::int as o_totalprice from orders")
def k3_upsert_state(spark, d):
    return changes.upsert(*_snapshots(spark, d), ["o_orderkey"])


@query("select o_orderkey, o_orderstatus, o_totalprice + 0.0 as o_totalprice from orders")
def k5_insert_absent(spark, d):
    return changes.insert_absent(*_snapshots(spark, d), ["o_orderkey"])


@query("select o_orderkey, case when o_orderstatus = 'P' and o_totalprice < 100000 then 'X' else o_orderstatus end as o_orderstatus from orders where not (o_orderpriority like '5%')")
def k7_state_flip(spark, d):
    o = changes.delete_where(table(spark, d, "orders"), F.col("o_orderpriority").startswith("5"))
    return changes.update_where(o, (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") < 100000), {"o_orderstatus": F.lit("X")}).select("o_orderkey", "o_orderstatus")


def _components_sql(rounds: int) -> str:
    """Smallest labels of neighbours, taken on in rounds: exact where no node is farther than that from its smallest one."""
    out = "with e as (select distinct l_partkey * 2 as a, l_suppkey * 2 + 1 as b from lineitem), s as (select a, b from e union select b, a from e), l0 as (select distinct a as node, a as root from s)"
    for k in range(rounds):
        out += f", l{k + 1} as (select l.node, least(min(l.root), min(n.root)) as root from l{k} l join s on s.a = l.node join l{k} n on n.node = s.b group by l.node)"
    return out + f" select node, root from l{rounds}"


@query(_components_sql(8))
def n1_components(spark, d):
    """All part-supplier edges."""
    return components(table(spark, d, "lineitem").select((F.col("l_partkey") * 2).alias("u"), (F.col("l_suppkey") * 2 + 1).alias("v")))


QUERIES["n1_components_all"], ORACLE_SQL["n1_components_all"] = n1_components, ORACLE_SQL["n1_components"]


@query("select min(v) as v, count(*) as n from (select distinct l_suppkey as v from lineitem where l_quantity = 50)")
def n1_component_of_large_orders(spark, d):
    """Edges from one hub to all suppliers of the largest quantity make one component, however many they are."""
    big = table(spark, d, "lineitem").where("l_quantity = 50").select(F.col("l_suppkey").alias("v"))
    found = components(big.select(F.lit(-1).cast("long").alias("u"), "v"))
    return found.where("node >= 0").groupBy("root").agg(F.min("node").alias("v"), F.count("*").alias("n")).drop("root")


@query("select time_bucket(interval 1 day, ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def r11_tumbling(spark, d):
    out = ev.windows(table(spark, d, "events"), "ts", "1 day", None, ["event_type"], {"n": F.count("*"), "total": F.round(F.sum("value"), 4)})
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("select s as start, count(*) as n from (select unnest(generate_series(date_trunc('day', ts) - interval 2 days, date_trunc('day', ts), interval 1 day)) as s, ts from events) where ts >= s and ts < s + interval 3 days group by 1")
def r12_sliding(spark, d):
    out = ev.windows(table(spark, d, "events"), "ts", "3 days", "1 day", [], {"n": F.count("*")})
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""with g as (select *, (coalesce(epoch(ts - lag(ts) over w), 1e9) >= 6 * 3600)::int as fresh from events window w as (partition by user_id order by ts)),
k as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as s from g) select min(ts) as start, max(ts) + interval 6 hours as end, user_id, count(*) as n from k group by user_id, s""")
def r_session(spark, d):
    out = ev.sessions(table(spark, d, "events"), "ts", "6 hours", ["user_id"], {"n": F.count("*")})
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})
