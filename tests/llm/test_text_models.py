"""Toxicity, language-model scores, piece coding, SimHash and suffix dedup against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from terrane.llm import lm_score, piece_coding, simhash, suffix_dedup, toxicity
from terrane.llm.common import words

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, fp int, spans int"


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, None, None, None, "k", 1, 2) for i, t in zip(ids or range(len(texts)), texts, strict=True)], DOCS)


def some_texts(rnd, n, vocabulary=60):
    vocab = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6))) for _ in range(vocabulary)]
    return [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 30))) for _ in range(n)]


def test_toxic_words_are_learned_and_nothing_else(spark):
    rnd = random.Random(4)
    texts = some_texts(rnd, 600)
    toxic = [int(i % 5 == 0) for i in range(600)]
    texts = [t + " zug" + rnd.choice(["x", "y", "zz", "q"]) + " w" if y else t + " w w" for t, y in zip(texts, toxic, strict=True)]
    df = docs(spark, [*texts, None, "", "zugnew " * 3], [*range(600), 1000, 1001, None])
    labels = spark.createDataFrame([*((i, y) for i, y in enumerate(toxic)), (None, 1), (3, None), (7, 0)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.scores(df, labels).collect()}
    assert len(got) == 603 and all(0 <= r.score <= 1 for r in got.values())
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i in held)
    assert np.mean([(got[i].score >= 0.5) == bool(toxic[i]) for i in held]) > 0.97
    assert got[None].score > 0.5 and got[1000].score < 0.5
    kept = toxicity.without_toxic(df, labels)
    assert kept.columns == df.columns and 470 < kept.count() < 490
    none = toxicity.scores(df, labels.limit(0)).agg(F.max("score")).first()[0]
    assert none == 0.0 and toxicity.without_toxic(df, labels.limit(0)).count() == 603
    assert toxicity.scores(df.limit(0), labels).count() == 0


def test_kneser_ney_sums_to_one():
    ws = [b"aab", b"ab", b"ba", b"aab"]
    g, _ = toxicity.grams(ws)
    keys, of = np.unique(g, return_inverse=True)
    model = toxicity.KneserNey(keys, np.stack([np.bincount(of), np.bincount(of, np.arange(len(of)) % 2)], axis=1))
    for ctx in (b"     ", b"    a", b"   aa", b"zzzzz"):
        p = np.full((256, 2), 1 / 256)
        g = np.array([int.from_bytes(ctx + bytes([b]), "big") for b in range(256)], np.uint64)
        for order, (k, kept, c, left) in enumerate(model.levels, 1):
            key = g & np.uint64((1 << (8 * order)) - 1)
            p = p * model._at(c, left, key >> np.uint64(8), 1.0) + model._at(k, kept, key, 0.0)
        assert np.allclose(p.sum(axis=0), 1, atol=1e-5)


def plain_evidence(counts, word):
    """Toxic minus ordinary log-likelihood of a word by dictionaries; counts: (word, class) to number."""
    order, shared, d = toxicity.ORDER, toxicity.SHARED, toxicity.DISCOUNT
    grams_of = lambda w: [(b" " * (order - 1) + w + b" ")[i : i + order] for i in range(len(w) + 1)]
    n = Counter()
    for (w, c), k in counts.items():
        for g in grams_of(w):
            n[g, c] += k
    levels = {}
    for size in range(order, 0, -1):
        if size == shared:
            both = Counter()
            for (g, _), k in n.items():
                both[g, 0] += k
                both[g, 1] += k
            n = both
        total, kinds = Counter(), Counter()
        for (g, c), k in n.items():
            total[g[:-1], c] += k
            kinds[g[:-1], c] += k > 0
        levels[size] = (n, total, kinds)
        n = Counter((g[1:], c) for (g, c), k in n.items() if k > 0)
    p = [1.0, 1.0]
    for g in grams_of(word):
        for c in (0, 1):
            q = 1 / 256
            for size in range(1, order + 1):
                n, total, kinds = levels[size]
                h = g[order - size :]
                t = total[h[:-1], c]
                if t:
                    q = q * d * kinds[h[:-1], c] / t + max(n[h, c] - d, 0) / t
            p[c] *= q
    return math.log(p[1]) - math.log(p[0])


def test_evidence_equals_a_plain_model(spark):
    texts = [(0, "aab ab ba aab"), (1, "zug ab zugg"), (0, "ba abc"), (1, "zug é")]
    df = spark.createDataFrame(texts, "toxic int, text string")
    got = toxicity.gram_counts(df).na.fill(0).toArrow()
    model = toxicity.KneserNey(got["gram"].to_numpy().view(np.uint64), np.stack([got[c].to_numpy() for c in ("0", "1")], axis=1))
    counts = Counter((w, c) for c, t in texts for w in words(t))
    asked = [b"zug", b"zu", b"ab", b"aab", b"new", "é".encode(), b"zuggg"]
    assert np.allclose(model.evidence(asked), [plain_evidence(counts, w) for w in asked], atol=1e-4)


def test_scores_mix_with_the_learnt_weights(spark):
    texts = some_texts(random.Random(9), 400, 40)
    df = docs(spark, texts)
    role = {r.doc_id: r.deleted for r in df.select("doc_id", (F.pmod(F.xxhash64(F.lit("deleted"), "doc_id"), F.lit(10)) == 0).alias("deleted")).collect()}
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))]
    split = [[*words(t), b" "] for t in texts]
    before = lambda ws: list(zip([b" ", *ws], ws, strict=False))

    def counted(which):
        one, two = Counter(), Counter()
        for i in which:
            one.update(split[i])
            two.update(before(split[i]))
        return one, two, sum(one.values())

    train = [i for i in range(len(texts)) if not held[i]]
    one, two, n = counted([i for i in train if not role[i]])
    cell = lambda p: round(lm_score.GRID * math.log2(p)) if p > 0 else lm_score.NONE
    bucket = lambda c: int(math.log2(c)) + 1 if c else 0
    events = Counter((bucket(one[v]), cell(two[v, w] / max(one[v], 1)), cell(one[w] / n)) for i in train if role[i] for v, w in before(split[i]))
    weights = lm_score.learn(np.array([(*k, e) for k, e in events.items()]), len(one))
    one, two, n = counted(train)
    got = {r.doc_id: r.score for r in lm_score.scores(df).collect()}
    for i, ws in enumerate(split):
        want = 0.0
        for v, w in before(ws):
            l2, l1, l0 = weights[bucket(one[v])]
            want += math.log10(l2 * two[v, w] / max(one[v], 1) + l1 * one[w] / n + l0 / (len(one) + 1))
        assert math.isclose(got[i], want, rel_tol=1e-6)


def test_language_model_counts_and_scores(spark, monkeypatch):
    texts = [*some_texts(random.Random(1), 300), None, "", "A\tb\x0bc  D", "b " * 3000]
    df = docs(spark, texts).repartition(3)
    got = {r.doc_id: r for r in lm_score.scores(df).collect()}
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))]
    split = [[*words(t), b" "] for t in texts]
    c = Counter(w for ws, h in zip(split, held, strict=True) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in enumerate(split):
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert r.score < 0
    # the pair counts behind the scores: one weight on pairs only gives the plain conditional estimate
    monkeypatch.setattr(lm_score, "learn", lambda cells, kinds: np.tile([1.0, 0.0, 0.0], (64, 1)))
    pairs = Counter(p for ws, h in zip(split, held, strict=True) if not h for p in zip([b" ", *ws], ws, strict=False))
    got = {r.doc_id: r for r in lm_score.scores(df).collect()}
    for i, ws in enumerate(split):
        if not held[i]:
            want = sum(math.log10(pairs[p] / c[p[0]]) for p in zip([b" ", *ws], ws, strict=False))
            assert math.isclose(got[i].score, want, rel_tol=1e-9)
    assert lm_score.scores(df.limit(0)).count() == 0


def test_weights_follow_the_events():
    cells = np.array([[3, -4, -40, 100], [3, lm_score.NONE, -8, 10], [0, lm_score.NONE, -8, 50]])
    w = lm_score.learn(cells, 100)
    assert np.allclose(w.sum(axis=1), 1) and w[3, 0] > 0.7 and w[0, 1] > w[0, 0]


def test_pieces_equal_the_library_and_come_back(spark):
    P = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp, coder, rnd = sentencepiece.SentencePieceProcessor(model_file=path), piece_coding.PieceCoder(path), random.Random(2)
    texts = ["".join(rnd.choice("ab  \n.,eth<0x>é日🙂in\t'") for _ in range(rnd.randint(0, 40))) for _ in range(500)]
    texts += ["the quick brown fox", "a" * 3000, "etaoin" * 900, " " * 300, "\n" * 40, ""]
    assert [coder.encode(t).tolist() for t in texts] == sp.encode(texts)
    whole = " ".join(rnd.choice([*texts, "etaoinshr" * 700, "?!" * 500]) for _ in range(400)) + "\n" + "x" * 5000
    for size in (1, 7, 41, 1000):  # any parts give the library's ids, and little text is retained between them
        stream, ids, most = piece_coding.Stream(coder), b"", 0
        text = whole[: 40_000 * size] if size < 7 else whole
        for k in range(0, len(text), size):
            ids += stream.feed(text[k : k + size], k + size >= len(text))
            most = max(most, len(stream.rest) + len(stream.lattice.text if stream.lattice else ""))
        assert np.frombuffer(ids, "<i4").tolist() == sp.encode(text) and most < 6 * coder.longest + piece_coding.SHORT + size
    out = {r.doc_id: r for r in piece_coding.encode_documents(docs(spark, [*texts, None]), path).collect()}
    assert all(r.same for r in out.values()) and out[len(texts)].n_ids == 0
    back = {r.doc_id: r.text for r in piece_coding.decode_documents(spark.createDataFrame(list(out.values())), path).collect()}
    assert [back[i] for i in range(len(texts))] == texts
    assert set(coder.decode([coder.bytes[0xE6], coder.bytes[0x97]])) == {"\ufffd"}
    assert piece_coding.encode_documents(docs(spark, []), path).count() == 0


def test_new_steps_of_known_characters_go_through_no_pieces():
    """Steps that are not kept are searched by moves and pairs that were met, one move a character, not by trying pieces from each place."""
    P = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    coder, rnd = piece_coding.PieceCoder(path), random.Random(3)
    text = " ".join("".join(rnd.choice("etaoins.é日🙂") for _ in range(rnd.randint(1, 60))) for _ in range(300))
    want = sentencepiece.SentencePieceProcessor(model_file=path).encode(text)
    assert coder.encode(text).tolist() == want
    coder.memo.clear()
    coder.scores = coder.heads = None
    coder.merge = None
    assert coder.encode(text).tolist() == want


def test_fingerprints_are_sparks_hashes(spark):
    text = "One two  three\tTWO one two three é"
    ws = words(text)
    hs = [xxhash.xxh64_intdigest(b" ".join(ws[i : i + 3]), 42) for i in range(len(ws) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    assert simhash.fingerprint(text) & (2**64 - 1) == want
    assert spark.range(1).select(F.xxhash64(F.lit("one two three"))).first()[0] & (2**64 - 1) == hs[0]
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def reach(codes, groups, bits=3):
    root = list(range(len(codes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(codes)):
        for j in range(i):
            if groups[i] == groups[j] and bin(int(codes[i]) ^ int(codes[j])).count("1") <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(codes))]


@pytest.mark.parametrize(("n", "centres", "most"), [(300, 4, 1 << 20), (300, 1, 200), (1, 1, 200), (200, 200, 1 << 20)])
def test_gray_index_finds_every_component(monkeypatch, n, centres, most):
    monkeypatch.setattr(simhash, "MOST_PAIRS", most)
    rng = np.random.default_rng(n + centres)
    codes = rng.integers(0, 2**63, centres, np.uint64)[rng.integers(0, centres, n)]
    for _ in range(4):
        codes = codes ^ np.where(rng.random(n) < 0.6, np.uint64(1) << rng.integers(0, 64, n, np.uint64), np.uint64(0))
    groups = rng.integers(0, 2, n)
    gray = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        gray = gray ^ (gray >> np.uint64(s))
    order = np.lexsort((gray, groups))
    codes, groups = codes[order], groups[order]
    assert simhash.GrayIndex(groups, codes).forest().tolist() == reach(codes, groups)


def test_near_duplicates_and_one_of_each(spark):
    rnd = random.Random(7)
    base = [" ".join(rnd.choice(["ab", "cd", "ef", "gh", "ij", "kl"]) + str(rnd.randint(0, 99)) for _ in range(200)) for _ in range(12)]
    texts = [*base, base[0], base[1] + " tail", base[2].replace("ab", "ab", 1), None, "", "x", "x", "x y"]
    ids = [*range(50, 50 + len(texts) - 1), None]
    df = docs(spark, texts, ids)
    fps = [simhash.fingerprint(t) & (2**64 - 1) for t in texts]
    root = reach(fps, [0] * len(fps))
    want = {}
    for i, r in zip(ids, root, strict=True):
        want[i] = min(j for j, q in zip(ids, root, strict=True) if q == r and j is not None) if any(j is not None for j, q in zip(ids, root, strict=True) if q == r) else None
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    assert got == want
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns and kept.count() == len(set(root))
    twice = df.unionByName(df)
    assert simhash.one_of_each(twice).count() == len(set(root))
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def removed(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = np.frombuffer(r, np.uint8)[~gone].tobytes()
        out.append((len(r), int(gone.sum()), len(suffix_dedup._runs(gone)), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("most", [2000, 1])
def test_repeats_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST_CONTEXTS", most)
    rng = np.random.default_rng(1)
    blocks = ["".join(chr(97 + x) for x in rng.integers(0, 3, int(n))) for n in rng.integers(5, 120, 40)]
    texts = ["".join(blocks[i] for i in rng.integers(0, 40, int(rng.integers(0, 8)))) for _ in range(40)]
    texts += ["a" * 300, "ab" * 200, None, "", "é" * 90, texts[0], texts[0]]
    df = docs(spark, texts)
    df = df.unionByName(df.where("doc_id = 3"))
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.remove_repeats(df, suffix_dedup.Symbols(40, 10), 3).collect())
    want = removed([*texts, texts[3]], 40)
    assert got == sorted((i, *w) for i, w in zip([*range(len(texts)), 3], want, strict=True))


def test_long_texts_are_cut_in_chunks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    text = "".join(chr(97 + x) for x in rng.integers(0, 26, 3000))
    monkeypatch.setattr(suffix_dedup, "CHUNK", 500)
    texts = [text, "zz" + text[700:2300] + "yy", "other" * 3]
    got = [(r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(docs(spark, texts), suffix_dedup.Symbols(40, 10)).orderBy("doc_id").collect()]
    assert got == [w[:2] for w in removed(texts, 40)]


def test_cutting_keeps_columns_and_drops_what_is_left_empty(spark):
    p = "".join(chr(97 + i % 23) + str(i) for i in range(60))
    df = docs(spark, ["start " + p, p + " end é", p, None, "clean"])
    out = suffix_dedup.without_repeats(df, suffix_dedup.Symbols(40, 10), 2)
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert out.columns == df.columns
    assert got == {0: ("start ", 6), 1: (" end é", 6), 3: (None, None), 4: ("clean", None)}
    assert suffix_dedup.without_repeats(df.limit(0), suffix_dedup.Symbols(40, 10), 2).count() == 0
