"""Groups, windows and top lists of the document queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrane.sources.storage import stored

AGGREGATES = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "std": F.stddev_pop, "std_samp": F.stddev_samp, "set_size": F.count_distinct}
MOST_ROWS = 5000  # of a page that goes to a caller; never inside an aggregation


def by_metric(df: DataFrame, metric: Column, how: str, dims: list[Column], positive: bool = False, limit: int | None = None) -> DataFrame:
    """dims, value, count of the rows that have the metric, largest value first; null dims become ''."""
    rows = df.withColumn("metric", metric)
    rows = rows.where(F.col("metric") > 0) if positive else rows.where(F.col("metric").isNotNull())
    out = rows.groupBy(*dims).agg(AGGREGATES[how]("metric").alias("value"), F.count("*").alias("count"))
    return out.orderBy(F.col("value").desc(), *[F.col(c) for c in out.columns[:-2]]).limit(min(limit, MOST_ROWS)) if limit else out


def count_rows(df: DataFrame, dims: list[Column] | None = None) -> DataFrame:
    """Counts per group; without dims one row, and none for an empty input."""
    return df.groupBy(*(dims or [])).agg(F.count("*").alias("count")).where("count > 0")


def histogram(df: DataFrame, value: Column, most: int = 50) -> DataFrame:
    return df.groupBy(value.alias("value")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "value").limit(most)


def distinct_values(df: DataFrame, value: Column, array: bool = False, most: int = 500) -> DataFrame:
    """Distinct filled values in order; arrays are taken apart."""
    rows = df.select((F.explode(value) if array else value).alias("value")).where(F.col("value").isNotNull() & (F.col("value").cast("string") != ""))
    return rows.distinct().orderBy("value").limit(most)


def top_n(df: DataFrame, by: Column, ties: list[str], n: int) -> DataFrame:
    return df.where(by.isNotNull()).orderBy(by.desc(), *ties).limit(min(n, MOST_ROWS))


def top_in_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    return top_in_group(df, key, order, 1).drop("place")


def majority(df: DataFrame, key: list[str], vote: str, first: Column) -> DataFrame:
    """The most frequent vote of each key; of equals the one met first, then the smallest."""
    votes = df.groupBy(*key, vote).agg(F.count("*").alias("n"), F.min(first).alias("met"))
    return votes.groupBy(*key).agg(F.min_by(vote, F.struct((-F.col("n")).alias("n"), "met", vote)).alias(vote), F.max("n").alias("n_votes"))


def last_exchanges(turns: DataFrame, session: str, order: str, most: int) -> DataFrame:
    """The last (user, assistant) pairs of neighbouring turns of each session, latest first in n_back."""
    w = Window.partitionBy(session).orderBy(order)
    pairs = turns.withColumns({"next_role": F.lead("role").over(w), "reply": F.lead("text").over(w)}).where("role = 'user' and next_role = 'assistant'")
    back = Window.partitionBy(session).orderBy(F.desc(order))
    return pairs.withColumn("n_back", F.row_number().over(back)).where(F.col("n_back") <= most).select(session, order, "text", "reply", "n_back")


def status_counts(df: DataFrame, by: list[str], status: str, known: list[str]) -> DataFrame:
    """A column of counts for each known status, and the total."""
    return df.groupBy(*by).agg(*[F.count_if(F.col(status) == s).alias(s) for s in known], F.count("*").alias("total"))


def buckets(value: Column, bounds: list[float], default: str = "other") -> Column:
    """The lower bound of the interval that holds the value."""
    out = F.lit(default)
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        out = F.when((value >= lo) & (value < hi), F.lit(str(lo))).otherwise(out)
    return out


def union_tagged(parts: dict[str, DataFrame], tag: str = "source") -> DataFrame:
    """All rows of several sources under the union of their columns."""
    frames = [df.withColumn(tag, F.lit(name)) for name, df in parts.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def unpivot_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """field, present, rate: how many rows have each column."""
    counts = df.agg(F.count("*").alias("n"), *[F.count(c).alias(c) for c in columns])
    return counts.unpivot(["n"], columns, "field", "present").select("field", "present", F.try_divide("present", "n").alias("rate"))


def broken_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, count: how many rows break each rule (a rule that is null for a row is broken)."""
    names = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(F.explode(names).alias("rule")).groupBy("rule").agg(F.count("*").alias("count"))


def first_non_empty(candidates: list[DataFrame]) -> DataFrame:
    """The first of several tables that has a row; the last where none has."""
    for df in candidates[:-1]:
        if not df.isEmpty():
            return df
    return candidates[-1]


def auto_buckets(df: DataFrame, value: str, tie: str, n: int) -> DataFrame:
    """bucket, n, lo, hi: n buckets of rows as equal in number as can be, the first ones a row larger, in the order of value and tie.

    A sort over partitions numbers the rows: places within a partition, and the rows of the partitions before it. Which
    partition a row is in is written down, since it is asked for twice.
    """
    dealt = df.select(value, tie).repartitionByRange(F.col(value), F.col(tie)).withColumn("part", F.spark_partition_id())
    dealt = stored(dealt, "parts")
    sizes = dealt.groupBy("part").agg(F.count("*").alias("held"))
    before = sizes.select("part", (F.sum("held").over(Window.orderBy("part")) - F.col("held")).alias("before"), F.sum("held").over(Window.partitionBy()).alias("total"))  # a row for each partition
    place = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(value, tie)) - 1
    large, small = F.floor(F.col("total") / n) + 1, F.greatest(F.floor(F.col("total") / n), F.lit(1))
    first = F.col("total") % n * large
    bucket = F.when(F.col("place") < first, F.floor(F.col("place") / large)).otherwise(F.col("total") % n + F.floor((F.col("place") - first) / small)) + 1
    rows = dealt.join(before, "part").withColumn("place", place)
    return rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))


def sampled(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """About a share of the rows, the same on every run: those whose key's hash is low."""
    return df.where(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)) < int(share * 1_000_000))
