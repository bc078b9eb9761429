"""What a table holds: fields with types, examples and nesting, counts of tables, summaries of a result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

# Metrics that are averaged; all others are summed.
AVERAGED = ("price_per_m2", "price_per_m2_uah", "price_per_m2_usd", "price_per_ha_uah", "price_per_ha_usd", "price_per_sqm")


def _paths(kind: T.DataType, name: str, value: Column, inside: bool = False) -> list[tuple[str, str, Column]]:
    """(path, type, array of the path's values in a row) of a field and of what is nested in it; [] marks an array."""
    values = value if inside else F.array(value)
    if isinstance(kind, T.StructType):
        out = [(name, "struct", values)]
        for f in kind:
            out += _paths(f.dataType, f"{name}.{f.name}", F.transform(values, _getter(f.name)), True)
        return out
    if isinstance(kind, T.ArrayType):
        return [(name, "array", values), *_paths(kind.elementType, f"{name}[]", F.flatten(F.filter(values, lambda x: x.isNotNull())), True)]
    return [(name, kind.simpleString(), values)]


def _getter(name: str):
    return lambda x: x[name]


def schema_profile(df: DataFrame, examples: int = 3) -> DataFrame:
    """path, type, nullable (some value is missing), n_values, rate (of rows that have a value), examples (smallest values as text).

    All paths are counted in one pass; a task keeps the few smallest distinct examples of a path, never a whole column.
    """
    paths = [p for f in df.schema for p in _paths(f.dataType, f.name, F.col(f.name))]
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.size(F.filter(v, lambda x: x.isNotNull())).alias("n"), F.exists(v, lambda x: x.isNull()).alias("missing"), _example(k, v).alias("example")) for i, (_, k, v) in enumerate(paths)])
    told = df.select(F.explode(rows).alias("p")).select("p.*")
    counts = told.groupBy("i").agg(F.sum("n").cast("long").alias("n_values"), F.max(F.coalesce("missing", F.lit(False))).alias("nullable"), F.avg((F.col("n") > 0).cast("double")).alias("rate"))
    shown = told.where("example is not null").groupBy("i", "example").count()
    first = shown.withColumn("place", F.row_number().over(Window.partitionBy("i").orderBy("example"))).where(F.col("place") <= examples)
    shown = first.groupBy("i").agg(F.array_sort(F.collect_list("example")).alias("examples"))
    names = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("path"), F.lit(k).alias("type")) for i, (n, k, _) in enumerate(paths)])
    named = df.sparkSession.range(1).select(F.explode(names).alias("p")).select("p.*")
    out = named.join(counts, "i").join(shown, "i", "left")
    return out.select("path", "type", "nullable", "n_values", "rate", F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))


def _example(kind: str, values: Column) -> Column:
    return F.lit(None).cast("string") if kind in ("struct", "array") else F.substring(F.array_min(values).cast("string"), 1, 100)


def table_counts(spark: SparkSession, tables: dict[str, DataFrame | None]) -> DataFrame:
    """name, n_rows, state ('ok', 'empty' or 'missing') of tables; a count without a filter reads no column."""
    parts = [df.agg(F.lit(n).alias("name"), F.count("*").alias("n_rows")) if df is not None else spark.range(1).select(F.lit(n).alias("name"), F.lit(None).cast("long").alias("n_rows")) for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("state", F.when(F.col("n_rows").isNull(), "missing").when(F.col("n_rows") == 0, "empty").otherwise("ok"))


def bound_aggregate(metric: str) -> str:
    """avg for prices per area, sum for everything else."""
    return "avg" if metric in AVERAGED else "sum"


def summary(df: DataFrame, value: str, place: str, most: int = 5) -> DataFrame:
    """place, n, avg, lo, hi: one row for all (place null), and one for each of the most frequent places."""
    stats = [F.count(value).alias("n"), F.avg(value).alias("avg"), F.min(value).alias("lo"), F.max(value).alias("hi")]
    top = df.where(F.col(place).isNotNull()).groupBy(place).agg(*stats).orderBy(F.desc("n"), place).limit(most)
    return df.agg(*stats).withColumn(place, F.lit(None).cast(df.schema[place].dataType)).unionByName(top)


def extremes(df: DataFrame, by: str, value: str) -> DataFrame:
    """The groups of the largest and of the smallest mean, ties to the smaller name: best, worst."""
    means = df.groupBy(by).agg(F.avg(value).alias("mean"))
    return means.agg(F.min_by(by, F.struct(-F.col("mean"), by)).alias("best"), F.min_by(by, F.struct("mean", by)).alias("worst"))
