"""Approximate nearest neighbours by score-aware anisotropic quantisation (Guo et al., 2020).

Unit vectors are cut into pairs of dimensions, each with 16 codewords: four bits a pair. Codes and codewords minimise
``|r|^2 + (eta - 1) * <r, x/|x|>^2`` for the residual r, which weighs the error parallel to the vector eta times: that
is the part which disturbs large inner products. A query builds a table of its inner products with all codewords, two
codes are looked up at once as a byte, and the sums rank a block. The FIRST of them meet the original vectors. That also
tells how far sums are from scores, for these rows and for the query itself; every other candidate of the block whose
sum comes within MARGIN times the largest such error of the k-th best score meets them too, until none is left. So rows
that codes hardly tell apart (tight clusters, copies, vectors around a common offset) are told apart by the originals.

The codebook is fitted on a bounded sample, the SAMPLE rows whose ids have the smallest hashes; every row is indexed
once, as its codes in a stored table. Rows are dealt to the blocks of queries with their codes, and a block puts forward
its k best.

Edge cases: see ``vectors.usable``; zero vectors take no part; fewer than k candidates are all returned; ties go to the
smaller vec_id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .vectors import best, grid, matrix, usable

SAMPLE = 8_192
WORDS = 16
THRESHOLD = 0.2  # scores from here on are to be kept accurate
FIRST = 192  # candidates of a block that are scored exactly before errors are known
MARGIN = 1.5  # errors that the others may be off by: recall of 0.97 and more on tight clusters, where 1 gave 0.91
AT_ONCE = 4_096  # vectors scored at once


def eta(dims: int, threshold: float = THRESHOLD) -> float:
    return max(1.0, (dims - 1) * threshold**2 / (1 - threshold**2))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one, in pairs of dimensions: (n, pairs, 2)."""
    rows = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    if rows.shape[1] % 2:
        rows = np.pad(rows, ((0, 0), (0, 1)))
    return rows.reshape(len(rows), -1, 2)


def encode(x: np.ndarray, book: np.ndarray, weight: float, sweeps: int = 2) -> np.ndarray:
    """Codes (n, pairs) by coordinate descent on the anisotropic loss, from the nearest codewords."""
    n, pairs, _ = x.shape
    codes = np.empty((n, pairs), np.uint8)
    for m in range(pairs):
        codes[:, m] = (((x[:, m, None, :] - book[m]) ** 2).sum(axis=2)).argmin(axis=1)
    off = ((x - book[np.arange(pairs), codes]) * x).sum(axis=2)  # each pair's part of <r, x>
    total = off.sum(axis=1)
    for _ in range(sweeps):
        for m in range(pairs):
            r = x[:, m, None, :] - book[m]
            along = (r * x[:, m, None, :]).sum(axis=2)
            rest = total - off[:, m]
            codes[:, m] = ((r**2).sum(axis=2) + (weight - 1) * (rest[:, None] + along) ** 2).argmin(axis=1)
            off[:, m] = along[np.arange(n), codes[:, m]]
            total = rest + off[:, m]
    return codes


def fit(x: np.ndarray, rounds: int = 6, seed: int = 5) -> np.ndarray:
    """Codewords (pairs, WORDS, 2): assignments and weighted least squares in turn."""
    n, pairs, _ = x.shape
    weight = eta(2 * pairs)
    pick = np.random.default_rng(seed).integers(0, n, WORDS)
    book = x[pick].transpose(1, 0, 2).copy() + np.arange(WORDS)[None, :, None] * 1e-9
    for _ in range(rounds):
        codes = encode(x, book, weight, 1)
        r = x - book[np.arange(pairs), codes]
        off = (r * x).sum(axis=2)
        for m in range(pairs):
            u, rest = x[:, m], off.sum(axis=1) - off[:, m]
            lhs = np.eye(2) + (weight - 1) * u[:, :, None] * u[:, None, :]
            rhs = u + (weight - 1) * u * (rest + (u * u).sum(axis=1))[:, None]
            for c in range(WORDS):
                mine = codes[:, m] == c
                if mine.any():
                    book[m, c] = np.linalg.solve(lhs[mine].sum(axis=0), rhs[mine].sum(axis=0))
            off[:, m] = ((u - book[m, codes[:, m]]) * u).sum(axis=1)
    return book


def packed(rows: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The codes of rows, two to a byte: (n, bytes)."""
    codes = encode(unit(rows), book, eta(2 * len(book)))
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    return codes[:, ::2] << 4 | codes[:, 1::2]


def scan(codes: np.ndarray, query: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The sum of every candidate of a block; codes are (bytes, n)."""
    table = np.einsum("mwd,md->mw", book, unit(query[None])[0])
    if len(table) % 2:
        table = np.pad(table, ((0, 1), (0, 0)))
    both = (table[::2, :, None] + table[1::2, None, :]).reshape(len(table) // 2, WORDS * WORDS).astype(np.float32)
    sums = np.zeros(codes.shape[1], np.float32)
    for t, b in zip(both, codes, strict=True):
        sums += t[b]
    return sums


def scaled(rows: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that their squares neither overflow nor vanish; cosines stay what they are."""
    _, e = np.frexp(np.abs(rows).max(axis=1, keepdims=True, initial=0))
    return np.ldexp(rows, -e)


def cosines(rows: np.ndarray, norms: np.ndarray, query: np.ndarray) -> np.ndarray:
    return (rows * query).sum(axis=1) / (norms * np.sqrt((query * query).sum()))


def closest(codes: np.ndarray, rows: np.ndarray, norms: np.ndarray, query: np.ndarray, book: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and scores of a block's k best candidates other than own; ties to the smaller number."""
    sums, n = scan(codes, query, book), len(rows)
    error = 0.0
    if own >= 0:
        error = abs(1.0 - float(sums[own]))
        sums[own] = -np.inf
    new = np.argpartition(-sums, FIRST)[:FIRST] if n > FIRST else np.arange(n)
    new = new[new != own]
    scores = np.full(n, -np.inf)
    met = np.zeros(n, bool)
    while len(new):
        met[new] = True
        for at in range(0, len(new), AT_ONCE):
            part = new[at : at + AT_ONCE]
            scores[part] = cosines(rows[part], norms[part], query)
        error = max(error, float(np.abs(scores[new] - sums[new]).max()))
        bound = np.partition(scores, n - k)[n - k] if n > k else -np.inf
        new = np.flatnonzero((sums >= bound - MARGIN * error) & ~met & (sums > -np.inf))
    got = np.flatnonzero(met)
    got = got[np.lexsort((got, -scores[got]))[:k]]
    return got, scores[got]


def wide(rows: np.ndarray, width: int) -> np.ndarray:
    """Rows padded with zeros."""
    return np.pad(rows, ((0, 0), (0, width - rows.shape[1])))


def nearest(embeddings: DataFrame, is_query, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score (cosine on the original vectors)."""
    vectors = stored(usable(embeddings).where(F.exists("v", lambda x: x != 0)), "usable")
    width = vectors.agg(F.max(F.size("v"))).first()[0] or 2
    width += width % 2
    sample = matrix(vectors.orderBy(F.xxhash64("vec_id")).limit(SAMPLE).select("v").toArrow()["v"])
    book = fit(unit(scaled(wide(sample, width)))) if len(sample) else np.zeros((width // 2, WORDS, 2))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                codes = packed(scaled(wide(matrix(b.column(1)), width)), book)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.tobytes() for c in codes], pa.binary())], ["vec_id", "v", "code"])

    def search(groups: pa.Table) -> pa.Table:
        asks, ids = groups["asks"].to_numpy(), groups["vec_id"].to_numpy()
        q, c = np.flatnonzero(asks), np.flatnonzero(~asks)
        c = c[np.argsort(ids[c], kind="stable")]
        out: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(q) and len(c):
            codes = np.ascontiguousarray(np.frombuffer(b"".join(groups["code"].take(pa.array(c)).to_pylist()), np.uint8).reshape(len(c), -1).T)
            queries, rows = (scaled(wide(matrix(groups["v"].take(pa.array(x))), width)) for x in (q, c))
            norms = np.sqrt((rows * rows).sum(axis=1))
            own = np.minimum(np.searchsorted(ids[c], ids[q]), len(c) - 1)
            for i, (at, v) in enumerate(zip(own.tolist(), queries, strict=True)):
                got, score = closest(codes, rows, norms, v, book, at if ids[c[at]] == ids[q[i]] else -1, k)
                out.append((np.full(len(got), ids[q[i]]), ids[c[got]], score))
        a, b, s = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"query_id": pa.array(a), "vec_id": pa.array(b), "score": pa.array(s)})

    codes = stored(vectors.mapInArrow(index, "vec_id long, v array<double>, code binary"), "codes")
    found = grid(codes.where(is_query), codes).applyInArrow(search, "query_id long, vec_id long, score double")
    return best(found, k)
