"""Queries over all rows of their tables, on small fixtures."""

from pyspark.sql import functions as F

from terrane.plans.queries import QUERIES


def test_components_of_all_edges_equal_union_find(spark, tmp_path):
    edges = [(1, 1, 3.0), (2, 1, 50.0), (2, 2, 7.0), (5, 3, 50.0), (6, 3, 1.0), (7, 4, 9.0), (5, 3, 50.0)]
    d = f"file://{tmp_path}"
    spark.createDataFrame(edges, "l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{d}/lineitem.parquet")
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for p, s, _ in edges:
        a, b = find(2 * p), find(2 * s + 1)
        root[max(a, b)] = min(a, b)
    got = {(r.node, r.root) for r in QUERIES["n1_components"](spark, d).collect()}
    assert got == {(x, find(x)) for x in list(root)}


def test_extract_keeps_every_group(spark, tmp_path):
    d = f"file://{tmp_path}"
    n = spark.range(150)
    n.select(F.col("id").alias("p_partkey"), F.format_string("t%d", "id").alias("p_type"), F.lit("b").alias("p_brand")).write.parquet(f"{d}/part.parquet")
    line = n.select(F.col("id").alias("l_partkey"), (F.col("id") + 1.0).alias("l_extendedprice"), F.lit(1.0).alias("l_quantity"), F.lit("N").alias("l_returnflag"))
    line.write.parquet(f"{d}/lineitem.parquet")
    for how in ("sum", "min", "max", "count"):
        assert QUERIES[f"a5_extract_{how}"](spark, d).count() == 150
