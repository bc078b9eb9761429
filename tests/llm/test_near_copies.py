"""Near copies of the pipeline's stage against brute force."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from terrane.llm import near_copies, simhash

DOCS = "doc_id long, text string"


def brute(texts):
    """Whether each text is the first of its component."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return [i for i, r in enumerate(root) if i == r]


def edited(rnd, text, n):
    ws = text.split()
    for i in rnd.sample(range(len(ws)), n):
        ws[i] = f"new{rnd.random()}"
    return " ".join(ws)


def test_planted_near_copies_are_linked_as_by_brute_force(spark):
    rnd = random.Random(11)
    vocab = [f"w{i}" for i in range(400)]
    common = " ".join(rnd.choices(vocab, k=40))
    texts = [" ".join(rnd.choices(vocab, k=rnd.randint(30, 120))) for _ in range(40)]
    texts += [t + " " + common for t in texts[:15]]
    for t in list(texts[:40]):
        texts += [edited(rnd, t, k) for k in (1, 2, 3)]
    base = " ".join(rnd.choices(vocab, k=200))
    texts += [edited(rnd, base, 3) for _ in range(30)] + ["a b", "A  b", "a b c", base.upper()]
    want = brute(texts)
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = sorted(r.doc_id for r in corpus_pipeline.simhash_stage(spark, df, "").collect())
    assert got == want
    assert len(simhash.one_of_each(df).collect()) > len(want)  # 3 bits of 3-word shingles miss some of them


def test_null_empty_and_repeated_rows(spark):
    rows = [(1, None), (2, ""), (3, " "), (4, "a b c d e f"), (4, "a b c d e f"), (None, "a b c d e f"), (None, "z")]
    df = spark.createDataFrame(rows, DOCS)
    got = near_copies.one_of_each(df).orderBy(F.col("doc_id").asc_nulls_first()).collect()
    assert [tuple(r) for r in got] == [(None, "z"), (1, None), (4, "a b c d e f")]
    assert near_copies.one_of_each(df.limit(0)).count() == 0
