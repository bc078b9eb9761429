"""Exact and approximate vector search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.llm import ann_search, topk_search, vectors


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], "vec_id long, embedding array<float>, label int")


def brute(rows, score, k=5):
    out = {}
    for i, v in rows:
        if i % 10 == 0:
            all_ = sorted(((-score(v, w), j) for j, w in rows if j != i))[:k]
            out[i] = [(j, -s) for s, j in all_]
    return out


@pytest.mark.parametrize("block", [16_384, 40])
def test_top_inner_products(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "CANDIDATE_BLOCK", block)
    rng = np.random.default_rng(0)
    x = rng.normal(0, 0.2, (150, 8)).astype(np.float32)
    x[30:60] = x[0]
    x[70] = 0
    good = [(i, x[i]) for i in range(150)]
    odd = [(200, None), (201, [1.0, None, 1, 1, 1, 1, 1, 1]), (202, [float("nan")] * 8), (203, [float("inf")] * 8), (210, [])]
    got = {}
    for r in topk_search.top_inner_products(frame(spark, [*good, *odd, good[5]]), F.col("vec_id") % 10 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    ints = [(i, np.floor(256 * v.astype(np.float64))) for i, v in good]
    assert got == brute(ints, lambda a, b: int(a @ b))


def test_few_candidates_and_empty(spark):
    df = frame(spark, [(0, [1.0, 0]), (1, [0.5, 1]), (2, [-1, 0])])
    for f in (topk_search.top_inner_products, ann_search.nearest):
        out = f(df, F.col("vec_id") == 0).orderBy("rank").collect()
        assert [(r.rank, r.vec_id) for r in out] == [(1, 1), (2, 2)]
        assert f(df.where("vec_id = 0"), F.col("vec_id") == 0).count() == 0
        assert f(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_approximate_search_finds_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (1500, 16)).astype(np.float32)
    x[100:400] = x[0] + rng.normal(0, 1e-3, (300, 16)).astype(np.float32)
    rows = [(i, x[i]) for i in range(len(x))]
    got = {}
    for r in ann_search.nearest(frame(spark, [*rows, (5000, [0.0] * 16), (5010, None)]), F.col("vec_id") % 10 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute([(i, v.astype(np.float64) / np.linalg.norm(v.astype(np.float64))) for i, v in rows], lambda a, b: float(a @ b))
    assert set(got) == set(want)
    recall = np.mean([len({j for j, _ in got[q]} & {j for j, _ in want[q]}) / 5 for q in want])
    assert recall >= 0.9
    assert all(abs(dict(want[q])[j] - s) < 1e-9 for q in want for j, s in got[q] if j in dict(want[q]))


@pytest.mark.parametrize("kind", ["tight", "offset", "copies", "huge"])
def test_approximate_search_where_codes_tell_little(spark, kind):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (3000, 16))
    if kind == "tight":
        x = np.repeat(x[:4], 750, axis=0) + rng.normal(0, 0.01, (3000, 16))
    elif kind == "offset":
        x = 3 + 0.05 * x
    elif kind == "copies":
        x[:1500] = x[0]
    else:
        x *= 1e30
    x = x.astype(np.float32)[rng.permutation(3000)]
    got = {}
    for r in ann_search.nearest(frame(spark, enumerate(x)), F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    recall = []
    for i in range(0, 3000, 50):
        s = (u * u[i]).sum(axis=1)
        s[i] = -2
        recall.append(len(got[i] & set(np.argsort(-np.round(s, 12), kind="stable")[:5].tolist())) / 5)
    assert np.mean(recall) >= 0.95


def test_anisotropic_loss_weighs_the_parallel_error():
    rng = np.random.default_rng(3)
    x = ann_search.unit(rng.normal(0, 1, (800, 16)))
    book = ann_search.fit(x)
    parallel = {}
    for weight in (1.0, ann_search.eta(16, 0.5)):
        codes = ann_search.encode(x, book, weight)
        r = x - book[np.arange(8), codes]
        parallel[weight] = ((r * x).sum(axis=(1, 2)) ** 2).mean()
    assert parallel[ann_search.eta(16, 0.5)] < parallel[1.0]
