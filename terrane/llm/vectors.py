"""Vector tables: which rows take part, and the grid of query blocks against candidate blocks."""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

CANDIDATE_BLOCK = 16_384
QUERY_BLOCK = 8_192
#: f(query ids, query vectors, candidate ids, candidate vectors) -> (query number, candidate number, score)
Search = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, v (array<double>) of the rows that take part.

    Rows with a null id, a null or empty vector, or a null or non-finite component take no part. Rows that repeat an id
    are one row, of the smallest vector among them.
    """
    v = F.col("embedding").cast("array<double>")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where((F.size("v") > 0) & F.col("vec_id").isNotNull())
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(finite).groupBy("vec_id").agg(F.min("v").alias("v"))


def matrix(column: pa.ListArray | pa.ChunkedArray) -> np.ndarray:
    """The vectors as rows; shorter ones are padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if len(ends) and (ends == ends[0]).all():
        return flat.reshape(len(ends), ends[0])
    out = np.zeros((len(ends), ends.max(initial=0)), flat.dtype)
    out[np.arange(out.shape[1]) < ends[:, None]] = flat
    return out


def grid(queries: DataFrame, candidates: DataFrame):
    """Groups of one query block and one candidate block each, in which asks tells the rows apart.

    Both are dealt into blocks of bounded size by a hash of their id, and a task gets one block of each, so memory does
    not grow with the table. The candidates' columns should be few bytes: each goes to every block of queries.
    """
    n, m = max(1, ceil(candidates.count() / CANDIDATE_BLOCK)), max(1, ceil(queries.count() / QUERY_BLOCK))
    block = lambda k: F.pmod(F.xxhash64("vec_id"), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = queries.select(every(n).alias("cand"), block(m).alias("quer"), F.lit(True).alias("asks"), "*")
    right = candidates.select(block(n).alias("cand"), every(m).alias("quer"), F.lit(False).alias("asks"), "*")
    return left.unionByName(right, allowMissingColumns=True).groupBy("cand", "quer")


def best(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each query; ties go to the smaller vec_id."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_in_blocks(vectors: DataFrame, is_query: Column, search: Search, k: int) -> DataFrame:
    """The k best of each query over all candidate blocks, by search on whole vectors; scores are integers."""
    vectors = stored(vectors, "vectors")

    def run(groups: pa.Table) -> pa.Table:
        asks = groups["asks"].to_numpy()
        ids, rows = groups["vec_id"].to_numpy(), matrix(groups["v"])
        q, c = np.flatnonzero(asks), np.flatnonzero(~asks)
        q, c = q[np.argsort(ids[q], kind="stable")], c[np.argsort(ids[c], kind="stable")]
        a, b, score = search(ids[q], rows[q], ids[c], rows[c]) if len(q) and len(c) else (np.zeros(0, np.int64),) * 3
        return pa.table({"query_id": pa.array(ids[q][a]), "vec_id": pa.array(ids[c][b]), "score": pa.array(score, pa.int64())})

    found = grid(vectors.where(is_query), vectors).applyInArrow(run, "query_id long, vec_id long, score long")
    return best(found, k)
