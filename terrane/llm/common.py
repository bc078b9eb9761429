"""What the operators of this subpackage share: tables, the shared folder, byte helpers."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.sources.storage import forget, scratch, stored, table

__all__ = ["bounded_batches", "fold", "forget", "kept_by", "partitions", "rows_in", "scratch", "stored", "table", "text_key", "words"]

BROADCAST_KEYS = 500_000  # of 16 bytes each
BATCH_ROWS = 1_000  # of whole texts that go to a Python worker at once
_kept: dict[str, dict[Any, Any]] = {}


def fold(id_col: str, n: int):
    """crc32 of the id as text, modulo n: the held-out rule that labels and language models use."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def bounded_batches(spark: SparkSession) -> None:
    """Rows that hold whole texts go to Python workers BATCH_ROWS at a time at most, which bounds what both sides hold of them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def kept_by(owner: str, key: Any = None, make: Callable[[Any], Any] | None = None) -> Any:
    """What an operator keeps in a Python worker from task to task, made when first asked for.

    Workers outlive the stages of a pipeline, so what other operators keep is dropped here; one that keeps nothing calls
    this for that alone.
    """
    if owner not in _kept:
        _kept.clear()
        _kept[owner] = {}
    if make and key not in _kept[owner]:
        _kept[owner][key] = make(key)
    return _kept[owner].get(key)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: str | None) -> list[bytes]:
    """Maximal runs of bytes other than space and tab to carriage return, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def text_key(text: str = "text") -> Column:
    """Tells texts of one doc_id apart; null is not ''."""
    return F.xxhash64(text)


def rows_in(docs: DataFrame, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of docs whose (doc_id, text_key) are in keys, or with how="left_anti" those that are not.

    keys is written and counted first: up to BROADCAST_KEYS go to the rows, so that no text is shuffled; beyond that the
    rows go to the keys.
    """
    keys = stored(keys.select(F.col("doc_id").alias("id_in"), F.col("text_key").alias("key_in")).distinct(), "keys")
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    return docs.join(keys, docs["doc_id"].cast("long").eqNullSafe(keys["id_in"]) & (F.xxhash64(docs["text"]) == keys["key_in"]), how)
