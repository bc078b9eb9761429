"""A feed in three phases: raw rows are kept, what is new or changed goes to the main table, figures follow.

All tables are versioned by batch number. Each phase of a batch is committed on its own and reads what the phase before it
committed, so a batch that was killed anywhere is run again as a whole: what is there is skipped, the rest is made from
the same rows. Batches must come in order, one at a time, as foreachBatch gives them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.operators.changes import content_hash
from terrane.operators.rollups import Rollup
from terrane.sources.versions import Versions


class Feed:
    """raw, main and a roll-up under path. Of rows of one key the last by order counts; a row without a key counts nowhere.

    columns decide whether a row changed; group and value (over columns) say what the roll-up counts.
    """

    def __init__(self, spark, path: str, key: str, order: str, columns: list[str], group: dict[str, Column], value: Column) -> None:
        self.key, self.order, self.columns, self.group, self.value = key, order, columns, group, value
        self.raw, self.main = Versions(spark, f"{path}/raw"), Versions(spark, f"{path}/main")
        self.rollup = Rollup(spark, f"{path}/rollup", list(group))

    def _last(self, rows: DataFrame, by: str) -> DataFrame:
        """The last row of each key."""
        rest = [c for c in rows.columns if c != self.key]
        return rows.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.max_by(F.struct(*rest), by).alias("x")).select(self.key, "x.*")

    def _counted(self, rows: DataFrame, n: int) -> DataFrame:
        return rows.select(*[c.alias(g) for g, c in self.group.items()], self.value.cast("double").alias("v"), F.lit(n).cast("long").alias("n"))

    def apply(self, batch: DataFrame, number: int) -> None:
        """One batch; fit for foreachBatch."""
        self.raw.append(batch.select(self.key, self.order, *self.columns), number)
        if self.main.entry()["batch"] < number:
            fresh = self._last(self.raw.read(only=number), self.order).withColumn("version_hash", content_hash(self.columns))
            known = self.main.read(before=number)
            if known is not None:
                old = self._last(known.select(self.key, "batch", "version_hash").join(fresh.select(self.key), self.key, "left_semi"), "batch").select(self.key, F.col("version_hash").alias("known"))
                fresh = fresh.join(old, self.key, "left").where(~F.col("version_hash").eqNullSafe(F.col("known"))).drop("known")
            self.main.append(fresh.withColumn("batch", F.lit(number)), number)
        moved, known = self.main.read(only=number), self.main.read(before=number)
        changes = self._counted(moved, 1)
        if known is not None:
            replaced = self._last(known.join(moved.select(self.key), self.key, "left_semi"), "batch")
            changes = changes.unionByName(self._counted(replaced, -1))
        self.rollup.load(changes, number)

    def current(self) -> DataFrame | None:
        """The main table: the last version of each key's row."""
        rows = self.main.read()
        return None if rows is None else self._last(rows, "batch").drop("batch", "version_hash")
