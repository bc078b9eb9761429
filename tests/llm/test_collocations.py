"""Phrases against brute force."""

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from terrane.llm import collocations


def brute(rows, least, share=100, top=2000):
    f, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = {p[i:j] for p, b in often.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * b >= share * counts[p[i:j]]}
        scored = []
        for p, a in often.items():
            if p not in gone:
                cuts = [(1000 * a * total[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))]
                s, _, x, y = min(cuts)
                scored.append((-s, -a, " ".join(p).encode(), x, y))
        for rank, (s, a, p, x, y) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, x, y, total[lang], -s))
    return sorted(out)


def rows(seed=1, n=400):
    rnd = random.Random(seed)
    vocab = [f"w{i}é" if i % 3 else f"W{i}" for i in range(40)]
    fixed = ["New York City", "a b c d e f", "x x x", "Of The", "of the"]
    some = lambda: rnd.choice(fixed) if rnd.random() < 0.3 else vocab[min(int(rnd.expovariate(0.15)), 39)]
    texts = [rnd.choice(["", ". ", "\n\t", "!?"]).join(" ".join(some() for _ in range(rnd.randint(0, 12))) + rnd.choice(["", ",", " ; "]) for _ in range(4)) for _ in range(n)]
    return [(rnd.choice(["en", "en", "de", "", None]), t) for t in texts] + [("en", None), ("fr", ""), ("fr", " . ,"), ("zz", "x " * 5000)]


def test_equals_brute_force(spark):
    data = rows()
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "doc_id long, lang string, text string").withColumns({c: F.lit(1) for c in ("batch", "ids", "n", "phrase")}).repartition(3)
    for least, top in ((20, 2000), (9, 15)):
        got = sorted(tuple(r) for r in collocations.collocations(docs, least=least, top=top).collect())
        want = brute(data, least, top=top)
        assert len(want) > 20
        assert got == want


def test_counts_past_64_bits(spark):
    big = 4_000_000_000_000
    names = [spark.createDataFrame([("en", 1, b"a", big), ("en", 2, b"b", big)], "lang string, id long, word binary, n long")]
    names.append(spark.createDataFrame([("en", 1, 1, 2, big - 1)], "lang string, id long, left long, right long, n long"))
    (row,) = collocations.phrases(names)[0].collect()
    assert (row.phrase, row.first, row.rest) == ("a b", [big], [big])


def test_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], "doc_id long, lang string, text string")).collect() == []
