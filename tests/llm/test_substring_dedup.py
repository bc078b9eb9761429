"""Windows of 13 words against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from terrane.llm import packed_words, substring_dedup


def brute(rows, n=13):
    first = {}
    for i, text in rows:
        w = (text or "").split()
        for k in range(len(w) - n + 1):
            if i is not None:
                key = tuple(w[k : k + n])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, text in rows:
        w = (text or "").split()
        gone = {k + j for k in range(len(w) - n + 1) if i is not None and first[tuple(w[k : k + n])] < i for j in range(n)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def texts(seed, n):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 4))) for _ in range(300)]
    some = lambda k: " ".join(rnd.choices(vocab, k=k))
    shared = [some(k) for k in (12, 13, 14, 40, 200)]
    rows = [(i, f"{some(rnd.randint(0, 60))}\t{rnd.choice(shared)} \n{some(rnd.randint(0, 30))}") for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(40)]  # a group of copies
    rows += [(5, rows[9][1]), (7, None), (None, rows[3][1]), (900, ""), (901, shared[3] + " " + shared[3]), (-4, shared[4]), (902, some(3000))]
    return rows


@pytest.mark.parametrize("words", [packed_words.BATCH_WORDS, 300])
def test_equals_brute_force(spark, words):
    rows = texts(words, 150)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("batch", "kept", "bin")}).repartition(5)
    got = [tuple(r) for r in substring_dedup.without_repeats(docs, batch_words=words).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_crowded_sketch_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "WIDTH", 0.02)
    rows = texts(3, 60)
    got = [tuple(r) for r in substring_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_empty_table(spark):
    assert substring_dedup.without_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
