"""Joins of the document queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup_array(left: DataFrame, right: DataFrame, on: tuple[str, str], name: str) -> DataFrame:
    """left with an array of its matching rows of right; rows without a match keep an empty array."""
    key = "key_of_lookup"
    grouped = right.groupBy(F.col(on[1]).alias(key)).agg(F.collect_list(F.struct("*")).alias(name))
    kind = grouped.schema[name].dataType
    out = left.join(grouped, left[on[0]].eqNullSafe(grouped[key]), "left").drop(key)
    return out.withColumn(name, F.coalesce(name, F.array().cast(kind)))


def lookup_count(left: DataFrame, right: DataFrame, on: tuple[str, str], name: str) -> DataFrame:
    """left with the number of its matching rows of right, counted before the join."""
    counted = right.groupBy(F.col(on[1]).alias("key_of_lookup")).agg(F.count("*").alias(name))
    out = left.join(counted, left[on[0]].eqNullSafe(counted["key_of_lookup"]), "left").drop("key_of_lookup")
    return out.withColumn(name, F.coalesce(name, F.lit(0)))


def with_any(left: DataFrame, right: DataFrame, on: tuple[str, str], test: Column) -> DataFrame:
    """The rows of left of which a matching row of right passes the test."""
    passed = right.where(test).select(F.col(on[1]).alias("key_of_lookup"))
    return left.join(passed, left[on[0]].eqNullSafe(passed["key_of_lookup"]), "left_semi")


def full_outer_difference(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """key, value_a, value_b and their difference, null where either side lacks the key."""
    left, right = a.select(key, F.col(value).alias(f"{value}_a")), b.select(key, F.col(value).alias(f"{value}_b"))
    return left.join(right, key, "full_outer").withColumn("difference", F.col(f"{value}_a") - F.col(f"{value}_b"))


def first_match(left: DataFrame, right: DataFrame, candidates: list[Column], right_key: str, ident: list[str]) -> DataFrame:
    """left with the row of right for the first of its candidate keys that right has; all candidates in one join.

    match_rank says which candidate it was (from 0); it is null for rows without any match.
    """
    keys = F.posexplode(F.array(*[c.cast("string") for c in candidates])).alias("match_rank", "match_key")
    asked = left.select(*ident, keys)
    hit = asked.join(right, asked["match_key"] == right[right_key].cast("string"))
    values = [c for c in right.columns if c != right_key]
    best = hit.groupBy(*ident).agg(F.min_by(F.struct("match_rank", *values), "match_rank").alias("best"))
    return left.join(best, ident, "left").select(left["*"], "best.*")


def repeats(df: DataFrame, same: Column, ident: str, earlier_than: str) -> DataFrame:
    """Each row with how many earlier rows are the same, and the first of them.

    A running count in the order of `earlier_than` replaces a self-join, which would grow with the square of a group. A row
    without a key repeats nothing.
    """
    from pyspark.sql.window import Window

    w = Window.partitionBy("same_key").orderBy(earlier_than)
    keyed = df.withColumn("same_key", same)
    alone = keyed.where("same_key is null").select(ident, F.lit(0).cast("long").alias("n_earlier"), F.lit(None).cast(df.schema[ident].dataType).alias("first_id"))
    keyed = keyed.where("same_key is not null")
    told = keyed.select(ident, (F.row_number().over(w) - 1).cast("long").alias("n_earlier"), F.when(F.row_number().over(w) > 1, F.first(ident).over(w)).alias("first_id"))
    return told.unionByName(alone)
