"""Connected components of an edge table, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from terrane.sources.storage import forget, scratch, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over rows (u, v). large: neighbours above u go to u's smallest; small: u's neighbours below do, and u."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lows = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    near = both.join(lows, "u")
    out = near.where("v > u" if large else "v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.unionByName(lows.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (u, v); root is the smallest node of its component.

    Minima are aggregated before they are joined back, so a node with very many edges is not gathered in one task. Each
    round is written to the shared folder, and its count and checksum are observed as it is written. An empty table gives
    no rows; loops and repeated edges do no harm.
    """
    spark = edges.sparkSession
    path = scratch(spark, "edges")
    now, sign = stored(edges.where("u != v").distinct(), "edges", path), None
    for _ in range(most_rounds):
        new_path = scratch(spark, "edges")
        seen = Observation()
        new = _star(_star(now, True), False).observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"))
        new = stored(new, "edges", new_path)
        forget(spark, path)
        now, path = new, new_path
        if seen.get == sign:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        sign = seen.get
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
