"""Exact top-k inner products by aggregation over sorted lists without random access.

Components are turned into integers. Within a block of candidates each dimension has a list sorted by component. For a
query the lists are read from their better end and only onwards, all down to the same contribution; that level goes down
in rounds. Each candidate has two bounds: what was read of it, plus for each list where it was not met yet the worst
contribution that any list holds (lower), or the level (upper). Reading in full stops when no more than a few candidates
have an upper bound that reaches the k-th best lower bound: all others, those never met included, cannot qualify. The
lists are then read to their ends for those few alone, which resolves their scores. No candidate is ever looked up.

Edge cases: see ``vectors.usable``; a query without other rows has no result; fewer than k candidates are all returned;
vectors of unequal length are padded with zeros; a query of zeros scores 0 everywhere, so the smallest ids win.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import search_in_blocks, usable

FEW = 16  # reading in full stops when at most 1/FEW of a block can still qualify
DEPTHS = (0.4, 0.55, 0.7, 0.85, 1.0)  # levels of the rounds, from the best contribution (0) to the worst (1)


class SortedLists:
    """A list for each dimension: candidates (numbers within the block) by component."""

    def __init__(self, rows: np.ndarray) -> None:
        self.n = len(rows)
        order = np.argsort(rows.T, axis=1, kind="stable")
        self.order = order.astype(np.int32)
        self.values = np.take_along_axis(rows.T, order, axis=1)

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and scores of the k best candidates other than own; ties to the smaller number."""
        n, dims = self.n, np.flatnonzero(query)
        weight = query[dims]
        ends = np.stack([self.values[dims, 0] * weight, self.values[dims, -1] * weight])
        best, worst = float(ends.max(initial=0)), float(ends.min(initial=0))
        unread = [(0, n)] * len(dims)
        seen, met = np.zeros(n), np.zeros(n)
        others = np.ones(n, bool)
        if own >= 0:
            others[own] = False
        alive = others
        for depth in DEPTHS if len(dims) else ():
            level = best - depth * (best - worst)
            ids, parts = self._read(dims, weight, unread, level if depth < 1 else -np.inf)
            if alive is not others:  # only these few are wanted from here on
                wanted = alive[ids]
                ids, parts = ids[wanted], parts[wanted]
            seen += np.bincount(ids, parts, n)
            met += np.bincount(ids, minlength=n)
            missing = len(dims) - met
            lower = np.where(alive, seen + missing * worst, -np.inf)
            bound = np.partition(lower, n - k)[n - k] if n > k else -np.inf
            can = alive & (seen + missing * level >= bound)
            if alive is not others or can.sum() * FEW <= n:
                alive = can
        left = np.flatnonzero(alive)
        best_ = np.lexsort((left, -seen[left]))[:k]
        return left[best_], seen[left[best_]]

    def _read(self, dims: np.ndarray, weight: np.ndarray, unread: list[tuple[int, int]], level: float) -> tuple[np.ndarray, np.ndarray]:
        """What the lists hold from where each was left down to level: candidates and contributions."""
        ids, parts = [], []
        for i, (d, w) in enumerate(zip(dims.tolist(), weight.tolist(), strict=True)):
            values, (lo, hi) = self.values[d], unread[i]
            if w > 0:
                at = min(hi, max(lo, int(np.searchsorted(values, level / w, "left"))))
                got, unread[i] = (at, hi), (lo, at)
            else:
                at = max(lo, min(hi, int(np.searchsorted(values, level / w, "right"))))
                got, unread[i] = (lo, at), (at, hi)
            ids.append(self.order[d, got[0] : got[1]])
            parts.append(values[got[0] : got[1]] * w)
        return np.concatenate(ids), np.concatenate(parts)


def integers(v):
    """Each component x as floor(256 * x)."""
    return F.transform(v, lambda x: F.floor(F.lit(256.0) * x).cast("double"))


def top_inner_products(embeddings: DataFrame, is_query, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score. Sums are exact while they stay below 2 ** 53."""

    def search(qids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        lists, out = SortedLists(rows), []
        own = np.searchsorted(ids, qids)
        for i, q in enumerate(queries):
            mine = int(own[i]) if own[i] < len(ids) and ids[own[i]] == qids[i] else -1
            got, score = lists.top(q, mine, k)
            out.append((np.full(len(got), i), got, score))
        a, b, s = (np.concatenate(x) for x in zip(*out, strict=True))
        return a, b, s.astype(np.int64)

    vectors = usable(embeddings).select("vec_id", integers(F.col("v")).alias("v"))
    return search_in_blocks(vectors, is_query, search, k)
