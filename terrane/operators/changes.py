"""State that follows a feed: change detection, upserts, inserts of what is new. Every function returns the new state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_hash(columns: list[str]) -> Column:
    return F.md5(F.to_json(F.struct(*sorted(columns))).cast("binary"))


def _same(a: str, b: str, key: list[str]) -> Column:
    """Whether the keys of two aliased tables are equal; nulls are equal to nulls."""
    out = F.lit(True)
    for k in key:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def compare(old: DataFrame, new: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """key and change: 'new', 'changed', 'same' or 'gone', by a hash of columns. A null in a key is a value like others."""
    a, b = old.select(*key, content_hash(columns).alias("old_hash")), new.select(*key, content_hash(columns).alias("new_hash"))
    change = F.when(F.col("old_hash").isNull(), "new").when(F.col("new_hash").isNull(), "gone").when(F.col("old_hash") == F.col("new_hash"), "same").otherwise("changed")
    both = a.alias("a").join(b.alias("b"), _same("a", "b", key), "full_outer")
    return both.select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in key], change.alias("change"))


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep: list[str] = ()) -> DataFrame:
    """Rows of both; where a key is in both the new values win, but for the columns in keep (such as created_at). Nulls in keys are equal."""
    rest = [c for c in old.columns if c not in key]
    a, b = old.withColumn("in_old", F.lit(True)).alias("a"), new.withColumn("in_new", F.lit(True)).alias("b")
    both = a.join(b, _same("a", "b", key), "full_outer")
    pick = lambda c: F.when(F.col("in_old") & F.lit(c in keep), F.col(f"a.{c}")).when(F.col("in_new"), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))
    return both.select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in key], *[pick(c).alias(c) for c in rest])


def replace_rows(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return old.alias("a").join(new.select(key).alias("b"), _same("a", "b", key), "left_anti").unionByName(new)


def insert_absent(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return old.unionByName(new.alias("a").join(old.select(key).alias("b"), _same("a", "b", key), "left_anti").dropDuplicates(key))


def update_where(df: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    hit = F.coalesce(condition, F.lit(False))
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(~F.coalesce(condition, F.lit(False)))


def add_to_sets(df: DataFrame, additions: DataFrame, key: list[str], column: str) -> DataFrame:
    """column, an array, with the elements that additions (key, column) hold for the row."""
    more = additions.groupBy(*key).agg(F.collect_set(column).alias("more"))
    return df.join(more, key, "left").withColumn(column, F.array_union(F.coalesce(column, F.col("more")), F.coalesce("more", F.col(column)))).drop("more")


def add_counts(old: DataFrame, new: DataFrame, key: list[str], count: str) -> DataFrame:
    """Counters with what came since."""
    return old.select(*key, count).unionByName(new.select(*key, count)).groupBy(*key).agg(F.sum(count).alias(count))


def dimension(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct members of a dimension with a key made from their values, the same on every run."""
    return df.select(*columns).distinct().withColumn("id", F.xxhash64(*columns))


def delete_prefix(df: DataFrame, key: str, prefix: str) -> DataFrame:
    return delete_where(df, F.col(key).startswith(prefix))


def unexpired(df: DataFrame, expires: str, now: Column) -> DataFrame:
    """Rows whose time has not come; rows without one stay."""
    return df.where(F.col(expires).isNull() | (F.col(expires) > now))


def promote(raw: DataFrame, main: DataFrame, key: list[str], columns: list[str], now: Column, order: str | None = None) -> DataFrame:
    """main with the raw rows that are new or changed, by a hash of columns kept in version_hash; promoted_at says when.

    Of raw rows with one key the last by order counts, without an order (and where it is the same) the one of the largest hash.
    """
    hashed = raw.withColumn("version_hash", content_hash(columns))
    last = F.max_by(F.struct(*columns, "version_hash"), F.struct(F.col(order), F.col("version_hash")) if order else F.col("version_hash"))
    fresh = hashed.groupBy(*key).agg(last.alias("x")).select(*key, *[F.col(f"x.{c}").alias(c) for c in [*columns, "version_hash"]])
    known = main.select(*key, F.col("version_hash").alias("known"))
    met = fresh.alias("a").join(known.alias("b"), _same("a", "b", key), "left").where(~F.col("version_hash").eqNullSafe(F.col("known")))
    moved = met.select(*[F.col(f"a.{c}").alias(c) for c in fresh.columns]).withColumn("promoted_at", now)
    return replace_rows(main, moved, key)


def reordered(df: DataFrame, key: str, ids: list, order: str) -> DataFrame:
    """df with order from the places of ids (from 0); rows that are not listed follow in their former order."""
    listed = F.array_position(F.array(*[F.lit(i) for i in ids]), F.col(key)) if ids else F.lit(0)
    return df.withColumn(order, F.when(listed > 0, listed - 1).otherwise(F.col(order) + len(ids)))
