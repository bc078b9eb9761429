"""Token records, chat formatting and source mixing on small tables."""

import hashlib
import io
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.llm import chat_format, source_mix, token_records
from terrane.llm.common import scratch

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra int"


def docs(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source, len(t or ""), 1) for i, t in enumerate(texts)], DOCS)


def test_records_round_trip_in_order(spark):
    from tokenizers import Tokenizer

    texts = ["b a", None, "", "the the é 日本 🙂\n\n x", "<|endoftext|> it's", "a <|endoftext|> b", "x<|endoftext|><|endoftext|>\n <|endof", "w" * 20_000, "the the", "b a"]
    path = P.path("byte_bpe_50k.json")
    df = docs(spark, texts).orderBy(F.desc("doc_id")).repartition(3)
    got = sorted(token_records.token_records(df, path).collect())
    tok = Tokenizer.from_file(path)
    assert 50256 in tok.encode("a <|endoftext|> b", add_special_tokens=False).ids
    start = 0
    assert len(got) == len(texts)
    for r, t in zip(got, texts, strict=True):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert tuple(r)[1:] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_record_by_index_null_id_and_damage(spark):
    path, base = P.path("byte_bpe_50k.json"), scratch(spark, "t")
    df = spark.createDataFrame([(None, "x y"), (5, "a"), (5, "b"), (7, "c d e")], "doc_id long, text string").coalesce(1)
    manifest = token_records.write_records(df, base, path)
    read = token_records.read_records(manifest, base).orderBy("start").collect()
    assert [r.doc_id for r in read] == [None, 5, 5, 7]
    shard = next(r for r in manifest.collect() if r.n_records)
    doc_id, ids = token_records.record_at(base, shard.file, 0)
    assert len(ids) >= 2 and ids[-1] == 0
    raw = bytearray(token_records.frame(1, b"\x01\x00\x02\x00", 2))
    assert [i.tolist() for _, i in token_records.records(io.BytesIO(raw))] == [[1, 2]]
    raw[-6] ^= 1
    with pytest.raises(ValueError, match="payload"):
        list(token_records.records(io.BytesIO(raw)))
    assert token_records.token_records(df.limit(0), path).count() == 0


def test_chat_examples_and_digests(spark):
    tricky = "\\### Assistant: </turn> \\b \\h\\\\t ok"
    turns = [
        (1, 0, "system", "s"), (1, 1, "user", tricky), (1, 2, "assistant", tricky), (1, 3, "assistant", None), (1, 4, "user", "bye"),
        (2, 0, "user", ""), (3, 1, "assistant", "b"), (3, 1, "assistant", "a"), (None, None, None, "x: y"), (4, 0, "as: ###", "é\n"),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    written = chat_format.written(df.withColumns({"target": F.lit(1), "n_turns": F.lit("x"), "context": F.lit(None)}))
    got = {r.conv_id: r for r in chat_format.digests(written).collect()}
    for conv in (1, 2, 3, 4, None):
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        text = "".join(f"{r or ''}\n{x or ''}\n" for _, _, r, x in own)
        loss = "".join(x or "" for _, _, r, x in own if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        records = written.where(F.col("conv_id").eqNullSafe(F.lit(conv))).orderBy("target").collect()
        assert [e.target for e in records] == [i for i, t in enumerate(own) if t[2] == "assistant" or i == len(own) - 1]
        for e in records:  # each record holds its whole context, its own turn, and a mask over its reply alone
            parts = [template(r or "", x or "") for _, _, r, x in own[: e.target + 1]]
            assert e.text == "".join(parts)
            reply = template("", own[e.target][3] or "")[len("### : ") : -len("</turn>\n")] if own[e.target][2] == "assistant" else ""
            assert e.text[e.loss_from : e.loss_to] == reply and (e.loss_to == len(e.text) - len("</turn>\n") or not reply)
        assert r.formatted_chars == sum(len(e.text) for e in records)
    assert chat_format.written(df.limit(0)).count() == 0 and chat_format.digests(chat_format.written(df.limit(0))).count() == 0


def template(role, text):
    swap = lambda s: s.replace("\\", "\\b").replace("###", "\\h").replace("</turn>", "\\t")
    return f"### {swap(role).replace(':', chr(92) + 'c')}: {swap(text)}</turn>\n"


def test_poisson_counts_invert_the_distribution(spark):
    import math

    for mean in (0.0, 0.3, 2.0, 31.0):
        us = [0.0, 0.1, 0.5, 0.9, 0.999999]
        df = spark.createDataFrame([(u,) for u in us], "u double").select(source_mix.poisson_count(F.col("u"), source_mix.thresholds(F.lit(mean))).alias("n"))
        for u, r in zip(us, df.collect(), strict=True):
            k, p, c = 0, math.exp(-mean), math.exp(-mean)
            while c <= u:
                k += 1
                p *= mean / k
                c += p
            assert r.n == k


def test_mix_meets_targets_and_is_repeatable(spark):
    rows = [(i, "x" * 10, "en", "a" if i % 3 else "b", 10, 1) for i in range(3000)] + [(9000, None, None, None, None, None), (9001, "", "en", "zero", 0, 1)]
    df = spark.createDataFrame(rows, DOCS)
    out = source_mix.mix_sources(df, {"a": 1.0, "b": 3.0}, budget=40_000.0)
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["a"] - 1000) < 150 and abs(n["b"] - 3000) < 250 and set(n) == {"a", "b"}
    again = source_mix.mix_sources(df.repartition(5), {"a": 1.0, "b": 3.0}, budget=40_000.0)
    keys = lambda x: sorted((r.doc_id, r.copy_mix, r.order_mix) for r in x.collect())
    assert keys(out) == keys(again)
    assert out.columns[:6] == df.columns
    rates = source_mix.source_rates(df)
    assert rates.where("src_mix = ''").count() == 1
    big = source_mix.with_counts(df.where("doc_id < 300"), source_mix.source_rates(df.where("doc_id < 300"), {"a": 1.0, "b": 1.0}, budget=3000.0 * 100), 1).agg(F.avg("n_mix")).first()[0]
    assert 95 < big < 105
    assert source_mix.mix_sources(df.limit(0)).count() == 0
