"""The feed's incremental work as Structured Streaming; each function takes a streaming (or a batch) DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def _timed(df: DataFrame, ts: str, late: str) -> DataFrame:
    df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return df.withWatermark(ts, late) if df.isStreaming else df


def windows(df: DataFrame, ts: str, width: str, slide: str | None, by: list[str], aggregates: dict[str, Column], late: str = "1 day") -> DataFrame:
    """Tumbling or sliding windows; rows later than `late` are dropped."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return _timed(df, ts, late).groupBy(w.alias("w"), *by).agg(*[c.alias(n) for n, c in aggregates.items()]).select(F.col("w.start").alias("start"), *by, *aggregates)


def sessions(df: DataFrame, ts: str, gap: str, by: list[str], aggregates: dict[str, Column], late: str = "1 day") -> DataFrame:
    """Windows that end after a pause."""
    out = _timed(df, ts, late).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, *aggregates)


def first_of_key(df: DataFrame, key: list[str], ts: str, late: str = "1 day") -> DataFrame:
    """Rows whose key did not come within the watermark before."""
    timed = _timed(df, ts, late)
    return timed.dropDuplicatesWithinWatermark(key) if timed.isStreaming else timed.dropDuplicates(key)


def not_older(df: DataFrame, ts: str, now: Column, days: int) -> DataFrame:
    return df.where(F.col(ts) >= now - F.make_dt_interval(F.lit(days)))


def run_available(df: DataFrame, merge, checkpoint: str, mode: str = "append") -> None:
    """Process all that is there, a micro-batch at a time: merge(batch, number) updates the state, as in changes.upsert."""
    df.writeStream.outputMode(mode).foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
