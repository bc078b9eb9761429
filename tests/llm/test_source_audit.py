"""Divergences of sources against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.llm import source_audit


def brute(rows, least=10, top=10):
    docs, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        low = re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")
        found = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", low)
        docs[lang].update(set(found))
        count[lang, source].update(found)
    out, byte = [], lambda x: (-x[1], x[0].encode())
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        v, total = len(kept), {s: sum(count[lang, s][t] for t in kept) for s in sources}
        share = lambda n, size: 1 + 1000000000 * (n + 2) // (size + 2 * v)  # noqa: B023, E731
        f = lambda p, q: (p - q) ** 2 // (p + q)
        p = {s: {t: share(count[lang, s][t], total[s]) for t in kept} for s in sources}
        q = {t: share(sum(count[lang, s][t] for s in sources), sum(total.values())) for t in kept}
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, rows_ in (("pair", sorted(pairs, key=byte)), ("term", sorted(terms, key=byte)[:top])):
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(rows_, 1)]
    return sorted(out)


def rows(seed=2, n=500):
    rnd = random.Random(seed)
    vocab = [f"{rnd.choice(['Wort', 'mot', 'ÉTÉ', 'éa'])}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    out = []
    for _ in range(n):
        k = rnd.randint(0, 6)
        words = [vocab[(min(int(rnd.expovariate(0.02)), 199) + 7 * k) % 200] for _ in range(rnd.randint(0, 40))]
        out.append((rnd.choice(["en", "en", "en", "de", None]), f"s{k}", rnd.choice([" ", "-", "1", "\x00\n", "]["]).join(words)))
    return out + [("en", None, "lonely"), ("en", "", None), ("xx", "a", "b c"), ("xx", "b", "c"), ("yy", "only", "w " * 50), *[("en", "hot", "Worta Aaa")] * 300]


@pytest.mark.parametrize(("salt", "block", "held"), [(50_000, 256, 300_000), (20, 3, 40)])
def test_equals_brute_force(spark, monkeypatch, salt, block, held):
    for k, v in (("SALT_ROWS", salt), ("BLOCK", block), ("HELD_TERMS", held), ("PAIRS_AT_ONCE", block * 100)):
        monkeypatch.setattr(source_audit, k, v)
    data = rows()
    docs = spark.createDataFrame(data, "lang string, source string, text string").withColumns({c: F.lit(1) for c in ("term", "v", "docs", "salt")}).repartition(3)
    assert sorted(tuple(r) for r in source_audit.audit(docs).collect()) == brute(data)


def test_sums_by_vector_equal_sums_by_term():
    rnd = np.random.default_rng(5)
    dense = rnd.poisson(0.7, (60, 9)) * rnd.integers(1, 2_000_000_000_000, (60, 9))
    size = dense.sum(axis=0) + 2 * 60
    p = np.stack([source_audit.shares(dense[:, j], np.full(60, size[j])) for j in range(9)], axis=1)
    assert p[3, 4] == 1 + 10**9 * (int(dense[3, 4]) + 2) // int(size[4])
    want = np.array([[source_audit.divergence(p[:, i], p[:, j]).sum() for j in range(9)] for i in range(9)])
    places = [np.flatnonzero(r) for r in dense]
    parts = [source_audit.pair_sums([r[k] for r, k in zip(dense, places, strict=True)], places, np.ones(60, np.int64), size, s) for s in (slice(0, 4), slice(4, 9))]
    alone, both = (np.vstack([x[k] for x in parts]) for k in (0, 1))
    zero = source_audit.shares(np.zeros(9, np.int64), size)
    got = 60 * source_audit.divergence(zero[:, None], zero[None, :]) + alone + alone.T + both
    np.fill_diagonal(got, 0)
    assert (got == want).all()


def test_empty_table(spark):
    assert source_audit.audit(spark.createDataFrame([], "lang string, source string, text string")).collect() == []
