"""The pipeline from end to end against plain Python, and its stages on odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: names that the operators use for columns of their own
CLASHING = ["n_mix", "copy_mix", "order_mix", "row_mix", "src_mix", "row", "spans", "text_key", "set_key", "id_in", "key_in", "score", "component_id", "key of row", "n"]


def near_groups(texts):
    """The place of the first text of each text's group: 5-word shingles at a similarity of 4/5."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def without_passages(texts, n=51):
    """Texts without words that a repeated stretch of n words covers, each with the space after it."""
    pieces = [re.findall(r"[^ \t-\r]+[ \t-\r]*", t) for t in texts]
    split = [[p.split()[0] for p in ps] for ps in pieces]
    seen = Counter(tuple(w[i : i + n]) for w in split for i in range(len(w) - n + 1))
    out = []
    for ps, w in zip(pieces, split, strict=True):
        gone = {i + k for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for k in range(n)}
        out.append("".join(p for i, p in enumerate(ps) if i not in gone))
    return out


def copies(docs, alpha=0.7, seed=17):
    """doc_id and text, as often as a Poisson draw by md5 says."""
    size = defaultdict(int)
    for _, t, s in docs:
        size[s] += max(1, len(t))
    shares, chars = {s: n**alpha for s, n in size.items()}, sum(size.values())
    out = []
    for i, t, s in docs:
        mean = shares[s] * (chars / sum(shares.values())) / size[s]
        u = int(hashlib.md5(f"{seed}|{i}|{s}|{hashlib.md5(t.encode()).hexdigest()}|0".encode()).hexdigest()[:13], 16) / 2**52
        k, p, c = 0, math.exp(-mean), math.exp(-mean)
        while c <= u:
            k += 1
            p *= mean / k
            c += p
        out += [(i, t)] * k
    return out


def test_run_equals_plain_python(spark, tmp_path):
    import sentencepiece

    rnd = random.Random(21)
    vocab = ["".join(rnd.choice("abcdefghé") for _ in range(rnd.randint(2, 6))) for _ in range(1500)]
    some = lambda n: " ".join(rnd.choices(vocab, k=n))
    clean = [some(rnd.randint(60, 160)) for _ in range(110)]
    near = []
    for t in clean[:15]:
        ws = t.split()
        ws[rnd.randrange(len(ws))] = "changed"
        near.append(" ".join(ws))
    passage = some(55)
    shared = [f"{some(40)} {passage} {some(30)}" for _ in range(6)]
    toxic = [" ".join(w + " zuggoth" if i % 6 == 0 else w for i, w in enumerate(some(80).split())) for _ in range(60)]
    texts = [*clean, *near, *shared, *toxic, clean[20], clean[21], "", some(3)]
    rows = [(i, t, "en", "abc"[i % 3] if i % 7 else "d", len(t)) for i, t in enumerate(texts)]
    bad = {i for i, t in enumerate(texts) if "zuggoth" in t}
    d = f"file://{tmp_path}"
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in bad)) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")

    kept = [r for r in rows if r[0] not in bad]
    root = near_groups([r[1] for r in kept])
    kept = [r for i, r in enumerate(kept) if root[i] == i]
    cut = without_passages([r[1] for r in kept])
    kept = [(r[0], t, r[3]) for r, t in zip(kept, cut, strict=True) if t or not r[1]]
    assert len(near) + 2 <= len(rows) - len(bad) - len(kept) and sum(t != rows[i][1] for i, t, _ in kept) == 6
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    want = Counter((i, zlib.crc32(np.array(sp.encode(t), "<i4").tobytes())) for i, t in copies(kept))
    got = Counter((r.doc_id, r.ids_crc32) for r in corpus_pipeline.run(spark, d).collect())
    assert got == want


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES if s[0] != "piece_coding"], ids=lambda s: s[0])
def test_stages_on_odd_tables(spark, tmp_path, stage):
    d, words = f"file://{tmp_path}", " ".join(f"w{i}" for i in range(70))
    extra = [(f"x{i}",) for i in range(len(CLASHING))]
    texts = [(1, "clean text of some words"), (1, "clean text of some words"), (2, None), (None, "no id"), (3, ""), (4, words), (5, "start " + words), (6, "w " * 30_000)]
    rows = [(i, t, None, None, None, *[x[0] for x in extra]) for i, t in texts]
    df = spark.createDataFrame(rows, DOCS + "".join(f", `{c}` string" for c in CLASHING))
    spark.createDataFrame([(1, 0, 0), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    out = stage[1](spark, df, d)
    assert out.columns == df.columns and dict(out.dtypes) == dict(df.dtypes)
    got = out.collect()
    assert got and all(tuple(r)[5:] == tuple(x[0] for x in extra) for r in got)
    assert stage[1](spark, df.limit(0), d).count() == 0
