"""Price statistics: quartiles, fences, indicators, roll-ups, anomalies.

Groups of up to IN_LIST values are sorted lists, which takes one shuffle of the rows. Larger groups go by slices:

Quartiles are exact and need no buffer that grows with a group. Slices of the value range, narrow enough to be small, are
summed and ranked; the slices that hold a wanted rank, six to a group at most, are opened and their values counted and
ranked in turn. So a hot group is spread over its slices, whatever it holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrane.sources.storage import stored

SLICES = 4096  # for each factor e of a value
PARTS = (0.25, 0.5, 0.75)
IN_LIST = 120_000  # values of a group that are sorted in one piece, all its metrics together


def positive(df: DataFrame, by: list[str], value: Column) -> DataFrame:
    """by, v, n: the positive values of each group, one row for each that came (n is 1), so that nothing is shuffled by values."""
    return df.withColumn("v", value.cast("double")).where("v > 0").select(*by, "v", F.lit(1).cast("long").alias("n"))


def value_counts(df: DataFrame, by: list[str], value: Column) -> DataFrame:
    """by, v, n: the positive values of each group, counted."""
    return positive(df, by, value).groupBy(*by, "v").agg(F.sum("n").alias("n"))


def _group(by: list[str]) -> Column:
    """The key of a group as one value, in which nulls are equal."""
    return F.struct(*[F.col(c) for c in by], F.lit(0).alias("of all")).alias("g")


def quartiles_of(counts: DataFrame, by: list[str]) -> DataFrame:
    """by, n, q1, q2, q3 by linear interpolation and q4, the maximum, of counted values (by, v, n); null keys are groups.

    A value may come in several rows. Rows are summed into slices where they lie; only those of opened slices are moved.
    """
    sliced = counts.select(_group(by), F.floor(F.log("v") * SLICES).alias("s"), "v", "n")
    slices = sliced.groupBy("g", "s").agg(F.sum("n").alias("held"), F.max("v").alias("top"))
    whole = Window.partitionBy("g")
    upto = whole.orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    placed = slices.select("g", "s", "held", (F.sum("held").over(upto) - F.col("held")).alias("before"), F.sum("held").over(whole).alias("total"), F.max("top").over(whole).alias("q4"))
    at = [F.lit(p) * (F.col("total") - 1) for p in PARTS]
    ranks = F.array(*[f(x).cast("long") for x in at for f in (F.floor, F.ceil)])
    wanted = F.transform(ranks, lambda r, i: F.struct(i.alias("i"), r.alias("r")))
    opened = stored(placed.withColumn("wanted", F.filter(wanted, lambda x: (x["r"] >= F.col("before")) & (x["r"] < F.col("before") + F.col("held")))).where(F.size("wanted") > 0), "opened")
    met = sliced.join(opened.select("g", "s"), ["g", "s"]).groupBy("g", "s", "v").agg(F.sum("n").alias("n")).join(opened, ["g", "s"])
    running = F.col("before") + F.sum("n").over(Window.partitionBy("g", "s").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    hits = met.withColumn("upto", running).select("g", "total", "q4", "v", F.explode(F.filter("wanted", lambda x: (x["r"] >= F.col("upto") - F.col("n")) & (x["r"] < F.col("upto")))).alias("x"))
    found = hits.groupBy("g").agg(F.first("total").alias("total"), F.first("q4").alias("q4"), *[F.max(F.when(F.col("x.i") == i, F.col("v"))).alias(f"v{i}") for i in range(6)])
    low = lambda k: F.col(f"v{2 * k}")
    quartile = [(low(k) + (F.col(f"v{2 * k + 1}") - low(k)) * (at[k] - F.floor(at[k]))).alias(f"q{k + 1}") for k in range(3)]
    return found.select(*[F.col("g")[c].alias(c) for c in by], F.col("total").alias("n"), *quartile, "q4")


def _hash(by: list[str]) -> Column:
    return F.xxhash64(*by, F.lit(0))


def _without(rows: DataFrame, by: list[str], hashes: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(hashes), _hash(by) == F.col("hash"), "left_anti")


def small_and_large(rows: DataFrame, by: list[str], values: int) -> tuple[DataFrame, DataFrame | None]:
    """rows of groups that hold at most IN_LIST values, `values` to a row, and those of the others (None without any).

    Groups are told apart by a hash: where two share one, both may count as large, which changes no result.
    """
    key = _hash(by)
    large = stored(rows.select(key.alias("hash")).groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") > IN_LIST // values).select("hash"), "large")
    if large.isEmpty():
        return rows, None
    split = lambda how: rows.join(F.broadcast(large), key == F.col("hash"), how)
    return split("left_anti"), split("left_semi")


def _of_list(sorted_: Column) -> list[Column]:
    """q1 .. q4 of a sorted list."""
    n = F.size(sorted_)
    at = [F.lit(p) * (n - 1) for p in PARTS]
    item = lambda k: F.get(sorted_, k.cast("int"))
    return [*[(item(F.floor(x)) + (item(F.ceil(x)) - item(F.floor(x))) * (x - F.floor(x))).alias(f"q{k}") for k, x in enumerate(at, 1)], item(n - 1).alias("q4")]


def quartiles(df: DataFrame, by: list[str], value: Column) -> DataFrame:
    """by, n, q1 .. q4 of the positive values of each group; groups without any are left out."""
    rows = df.select(*by, value.cast("double").alias("v")).where("v > 0")
    small, large = small_and_large(rows, by, 1)
    lists = small.groupBy(*by).agg(F.sort_array(F.collect_list("v")).alias("list")).where(F.size("list") > 0)
    out = lists.select(*by, F.size("list").cast("long").alias("n"), *_of_list(F.col("list")))
    return out if large is None else out.unionByName(quartiles_of(positive(large, by, F.col("v")), by))


def fences_of(counts: DataFrame, by: list[str], width: Column | float, floor: float = 0.0, least: int = 1) -> DataFrame:
    """by, lo, hi, top: quartiles widened by `width` spreads, a spread being at least `floor` of the median."""
    width = width if isinstance(width, Column) else F.lit(width)
    spread = width * F.greatest(F.col("q3") - F.col("q1"), F.col("q2") * floor)
    q = quartiles_of(counts, by).where(F.col("n") >= least)
    return q.select(*by, (F.col("q1") - spread).alias("lo"), (F.col("q3") + spread).alias("hi"), (F.col("q4") + spread).alias("top"))


def indicators(df: DataFrame, value: str, kind: str, region: str, place: str, least_place: int = 5, least_region: int = 3) -> DataFrame:
    """Quartiles per (kind, region, place) and per (kind, region), after trimming by the kind's fences over all rows.

    place is null at the level of regions.
    """
    levels = [[kind, region, place], [kind, region], [kind]]
    counts = stored(positive(df, levels[0], F.col(value)), "values")
    bounds = stored(fences_of(counts, levels[2], 2.0, 0.05, 3), "bounds")
    kept = counts.join(bounds, kind).where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("top"))).select(*levels[0], "v", "n")
    places = quartiles_of(kept, levels[0]).where(F.col("n") >= least_place)
    regions = quartiles_of(kept, levels[1]).where(F.col("n") >= least_region)
    return places.unionByName(regions, allowMissingColumns=True).withColumnRenamed("n", "count")


def _with(x: Column, v: Column) -> Column:
    """Number, mean and squared deviations of what came so far and one value more."""
    n = x["n"] + 1
    mean = x["mean"] + (v - x["mean"]) / n
    return F.struct(n.alias("n"), mean.alias("mean"), (x["apart"] + (v - x["mean"]) * (v - mean)).alias("apart"))


def _large_periods(rows: DataFrame, least: list[str], each: Column, by: list[str], values: int) -> tuple[DataFrame | None, DataFrame | None]:
    """hash of the groups by least that alone are large, and of the groups of periods that are; None without any.

    The periods of a group that alone is large are all large, also where it only shares its hash with one.
    """
    most = IN_LIST // values
    counts = stored(rows.groupBy(*least).agg(F.count("*").alias("n")), "counts").withColumn("hash", _hash(least))
    whole = stored(counts.groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") > most).select("hash"), "whole")
    marked = counts.join(F.broadcast(whole).withColumn("alone", F.lit(True)), "hash", "left").select(each, *by[2:], "n", "alone").select("p.*", *by[2:], "n", "alone")
    large = stored(marked.groupBy(_hash(by).alias("hash")).agg(F.sum("n").alias("n"), F.max("alone").alias("alone")).where((F.col("n") > most) | F.col("alone")).select("hash"), "large")
    if large.isEmpty():
        return None, None
    return whole, large


def period_rollup(df: DataFrame, periods: dict[str, Column], dims: list[str], values: list[str]) -> DataFrame:
    """metric, period_type, period_key, dims, avg, population std, count and quartiles of the positive values.

    Rows are gathered once, in lists by dims and all periods together; it is these lists that go to each of their periods'
    groups. A group that is not large is a list there; of large ones the values are counted and cut into slices.
    """
    keys = {p: f"period{k}" for k, p in enumerate(periods)}
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("period_type"), F.col(k).alias("period_key")) for p, k in keys.items()])).alias("p")
    numbers = [F.col(v).cast("double") for v in values]
    kept = [F.when(x > 0, x).alias(f"v{k}") for k, x in enumerate(numbers)]
    found = [f"v{k}" for k in range(len(values))]
    rows = df.select(*dims, *kept, *[c.alias(keys[p]) for p, c in periods.items()]).where(F.coalesce(*found).isNotNull())
    least, by = [*keys.values(), *dims], ["period_type", "period_key", *dims]
    named = lambda made: F.explode(F.array(*[F.struct(F.lit(v).alias("metric"), made(f"v{k}")) for k, v in enumerate(values)])).alias("m")
    whole, large = _large_periods(rows, least, each, by, len(values))
    lists = (rows if whole is None else _without(rows, least, whole)).groupBy(*least).agg(*[F.collect_list(v).alias(v) for v in found])
    lists = lists.select(each, *dims, *found).select("p.*", *dims, *found)
    lists = lists if large is None else _without(lists, by, large)
    if len(periods) > 1:
        lists = lists.groupBy(*by).agg(*[F.flatten(F.collect_list(v)).alias(v) for v in found])
    lists = lists.select(*by, named(lambda name: F.sort_array(name).alias("list"))).select(*by, "m.*").where(F.size("list") > 0)
    sum_ = F.aggregate("list", F.lit(0.0), lambda so_far, v: so_far + v)
    std = F.aggregate("list", F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("apart")), _with, lambda x: F.sqrt(x["apart"] / x["n"]))
    lists = lists.withColumns({"avg": sum_ / F.size("list"), "std": std})
    names = ["metric", *by, "avg", "std", "count", "q1", "q2", "q3", "q4"]
    out = lists.select("metric", *by, "avg", "std", F.size("list").cast("long").alias("count"), *_of_list(F.col("list"))).select(*names)
    if large is None:
        return out
    rows = rows.select(each, *dims, *found).select("p.*", *dims, *found)
    rows = rows.join(F.broadcast(large), _hash(by) == F.col("hash"), "left_semi")
    counts = positive(rows.select(*by, named(lambda name: F.col(name).alias("value"))).select(*by, "m.*"), ["metric", *by], F.col("value"))
    sliced = with_moments(counts, ["metric", *by], quartiles_of(counts, ["metric", *by])).withColumnRenamed("n", "count")
    return out.unionByName(sliced.select(*names))


def with_moments(counts: DataFrame, by: list[str], groups: DataFrame) -> DataFrame:
    """groups (one row for each by) with avg and population std of counted values."""
    keyed = counts.select(_group(by), "v", "n")
    means = keyed.groupBy("g").agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("avg"))
    apart = keyed.join(means, "g").withColumn("d", F.pow(F.col("v") - F.col("avg"), F.lit(2.0)) * F.col("n"))
    moments = apart.groupBy("g").agg(F.first("avg").alias("avg"), F.sqrt(F.sum("d") / F.sum("n")).alias("std"))
    return groups.withColumn("g", _group(by)).join(moments, "g").drop("g")


def anomalies(df: DataFrame, value: str, group: list[str], width: float = 1.5, least: int = 10) -> DataFrame:
    """Rows outside the fences of all rows or, failing that, of their group; scope says which, distance how far."""
    counts = positive(df, group, F.col(value))
    whole = fences_of(counts, [], width, 0.05, least).select(F.col("lo").alias("all_lo"), F.col("hi").alias("all_hi"))
    local = fences_of(counts, group, width, 0.05, least).select(*group, "lo", "hi")
    both = df.where(F.col(value) > 0).join(F.broadcast(whole), how="left").join(local, group, "left")  # whole is one row
    v = F.col(value)
    beyond = lambda lo, hi: F.when(v < lo, lo - v).when(v > hi, v - hi)
    globally, locally = beyond(F.col("all_lo"), F.col("all_hi")), beyond(F.col("lo"), F.col("hi"))
    scope = F.when(globally.isNotNull(), "global").when(locally.isNotNull(), "local")
    return both.withColumns({"scope": scope, "distance": F.coalesce(globally, locally)}).where("scope is not null").drop("all_lo", "all_hi", "lo", "hi")


def tiered_cost(n: Column, tiers: list[tuple[float, float | None, float]]) -> Column:
    """Progressive price of n events; tiers are (from, to or None, price of one)."""
    cost = F.lit(0.0)
    for lo, hi, price in tiers:
        part = F.greatest(n - lo, F.lit(0))
        cost = cost + (F.least(part, F.lit(hi - lo)) if hi is not None else part) * price
    return cost
