"""Passages of over 50 words that repeat, against brute force over words."""

import random
from collections import Counter

import corpus_pipeline
from terrane.llm import suffix_dedup

DOCS = "doc_id long, text string, n_chars long"


def brute(texts, n=51):
    """The words that no repeated stretch of n words covers, text by text."""
    split = [t.split() for t in texts]
    seen = Counter(tuple(w[i : i + n]) for w in split for i in range(len(w) - n + 1))
    out = []
    for w in split:
        gone = {i + k for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for k in range(n)}
        out.append([x for i, x in enumerate(w) if i not in gone])
    return out


def test_shared_passages_of_51_words_go_and_of_50_stay(spark):
    rnd = random.Random(3)
    vocab = ["".join(rnd.choice("abcdefé") for _ in range(rnd.randint(1, 5))) for _ in range(900)]
    some = lambda n: " ".join(rnd.choices(vocab, k=n))
    p50, p51, p80 = some(50), some(51), some(80)
    texts = [f"{some(20)}\n{p}  {some(rnd.randint(5, 90))}" for p in (p50, p51, p80) for _ in range(3)]
    texts += [some(rnd.randint(1, 200)) for _ in range(30)] + [p51, f"{some(9)} {p80[: len(p80) * 9 // 10]} {some(3)}", f"{p80} {some(4)} {p80}", "", some(60)]
    assert len(p51.encode()) < 400
    rows = [(i, t, len(t)) for i, t in enumerate(texts)] + [(99, None, None)]
    got = {r.doc_id: r for r in corpus_pipeline.suffix_stage(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    want = brute(texts)
    for i, words in enumerate(want):
        if words or not texts[i]:
            assert got[i].text.split() == words and got[i].n_chars == len(got[i].text)
            if words == texts[i].split():
                assert got[i].text == texts[i]
        else:
            assert i not in got
    assert got[99].text is None
    assert sum(w != t.split() for w, t in zip(want, texts, strict=True)) == 9
    # the byte rule reaches none of these, but says how much of a text stands in such passages
    df = spark.createDataFrame(rows, DOCS)
    told = {r.doc_id: r for r in suffix_dedup.remove_repeats(df, passages=suffix_dedup.WORDS).collect()}
    for i, (words, t) in enumerate(zip(want, texts, strict=True)):
        left = got[i].text if i in got else ""
        assert told[i].n_passage == len(t.encode()) - len((left or "").encode()) and bytes(told[i].kept).decode() == t
    assert told[99].n_passage == 0 and told[99].n_bytes == 0
