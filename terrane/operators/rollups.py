"""Price statistics of periods that are kept up to date by what came, not computed anew.

The state is the counted values of each group (by, v, n), which can be added up: a load appends its own counts, a changed
row takes its old value out and puts the new one in. Figures come from the counts, for the groups that a load touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.operators import stats
from terrane.sources.versions import Versions


def merged(counts: DataFrame, by: list[str]) -> DataFrame:
    """Counts added up; values that are gone are left out."""
    return counts.groupBy(*by, "v").agg(F.sum("n").alias("n")).where("n > 0")


def figures(counts: DataFrame, by: list[str]) -> DataFrame:
    """by, avg, std, count, q1 .. q4 of merged counts."""
    return stats.with_moments(counts, by, stats.quartiles_of(counts, by)).withColumnRenamed("n", "count").select(*by, "avg", "std", "count", "q1", "q2", "q3", "q4")


def same(by: list[str], a: str, b: str) -> Column:
    """Whether the groups of two aliased tables are equal, nulls included."""
    out = F.lit(True)
    for c in by:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


class Rollup:
    """Counts and figures of groups as versioned tables under path; loads are numbered, and one that is there is skipped."""

    def __init__(self, spark, path: str, by: list[str]) -> None:
        self.by, self.counts, self.figures = by, Versions(spark, f"{path}/counts"), Versions(spark, f"{path}/figures")

    def load(self, changes: DataFrame, number: int) -> None:
        """changes: by, v, n; n counts rows that came, and is below zero for rows that went. Values up to 0 do not count."""
        self.counts.append(changes.where("v > 0").groupBy(*self.by, "v").agg(F.sum("n").alias("n")).where("n != 0"), number)
        touched = self.counts.read(only=number).select(*self.by).distinct()
        here = self.counts.read(before=number + 1).alias("c").join(touched.alias("t"), same(self.by, "c", "t"), "left_semi")
        new = figures(merged(here, self.by), self.by)
        gone = touched.alias("t").join(new.alias("f"), same(self.by, "t", "f"), "left_anti")
        self.figures.append(new.unionByName(gone, allowMissingColumns=True).withColumn("load", F.lit(number)), number)

    def current(self) -> DataFrame | None:
        """The figures of all groups, each of the last load that touched it; groups that lost all their rows are left out."""
        rows = self.figures.read()
        if rows is None:
            return None
        values = [c for c in rows.columns if c not in (*self.by, "load")]
        last = rows.groupBy(*self.by).agg(F.max_by(F.struct(*values), "load").alias("x"))
        return last.select(*self.by, "x.*").where("count is not null")

    def compact(self) -> None:
        self.counts.compact(lambda df: merged(df, self.by))
