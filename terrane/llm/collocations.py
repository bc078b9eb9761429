"""Collocations: phrases of 2 to MOST_WORDS words that occur more often than their parts would by chance.

Phrases are named in a hierarchy. Frequent words get ids; a phrase of k words is the pair of the ids of its first and of
its last k - 1 words, where both are frequent, and gets an id of its own if it is frequent too. Each level replaces the
words' positions by the ids of the phrases that begin there. A pair names its two parents, so the counts of all prefixes
and suffixes, which cuts need, and the longer phrases that contain it are found by following ids, level by level.

Counting and naming is one exchange for a level: a batch of texts sends its distinct pairs with their counts, sorted and
packed, dealt over bins by a hash; a bin adds up what all batches send, names what is frequent, and answers each batch with ids in the order
in which it asked (0: not frequent). No table of phrases is broadcast or held whole, and a pair that occurs everywhere is
one entry of each batch. A phrase can only be frequent if both its parents are, so the levels shrink.

A phrase is subsumed if a longer one contains it and occurs SHARE percent as often. Of the longer phrases the ones by
one word occur most often, so the children of a pair decide.

Edge cases: a null text is empty; a null lang is ``und``, an empty one is a lang of its own; pieces without words and texts
without pieces count nothing; equal rows count each; other columns take no part; a lang without frequent phrases, and an
empty table, give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, partitions, stored
from .lm_score import pack, unpack
from .packed_words import packed

LEAST, MOST_WORDS, SHARE, TOP = 100, 5, 100, 2000
BIN_BYTES = 24_000_000  # of text for each bin
STOP = b"."
PARTED = bytes.maketrans(b",;:!?\n\x0b\x0c\r", STOP * 9)
ASK = "lang string, batch long, bin long, words binary, left binary, right binary, n binary, n_words long, codes binary"
NAME = "lang string, batch long, bin long, ids binary, id long, word binary, left long, right long, n long"


def split(raw: bytes) -> list[bytes]:
    """The words of a text in lower case, with STOP between pieces and at the end; no word holds it."""
    return raw.lower().translate(PARTED).replace(STOP, b" . ").split() + [STOP]


def _record(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    kind = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kind[t]) for (_, t), c in zip(fields, columns, strict=True)], [n for n, _ in fields])


def _joined(words: list[bytes]) -> bytes:
    return pack(np.frombuffer(b" ".join(words), np.uint8))


def _ordered(bins: np.ndarray, *then: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The order of entries by their bins and within them, and each bin with its entries."""
    order = np.lexsort((*then, bins))
    edges = np.flatnonzero(np.diff(bins[order])) + 1
    parts = np.split(order, edges) if len(order) else []
    return order, [(int(bins[p[0]]), p) for p in parts]


def _codes(order: np.ndarray, of: np.ndarray) -> np.ndarray:
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return rank[of]


def words_asked(docs: DataFrame, bins: int) -> DataFrame:
    """Level 1: rows that ask for words, and for each batch one (bin -1) with the place of each position's word in the asking order."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in packed(rows, split):
            words = [w for w in b.words if w != STOP]
            if not words:
                continue
            stop = b.words.index(STOP)
            of = np.where(b.ids > stop, b.ids - 1, b.ids)
            n = np.bincount(of[b.ids != stop], minlength=len(words))
            bin_ = np.array([xxhash.xxh64_intdigest(w) % bins for w in words], np.int64)
            order, parts = _ordered(bin_)
            codes = np.full(len(b.ids), -1, np.int32)
            codes[b.ids != stop] = _codes(order, of[b.ids != stop])
            asks = [(b.part, b.batch, k, _joined([words[i] for i in p.tolist()]), None, None, pack(n[p]), None, None) for k, p in parts]
            yield _record([*asks, (b.part, b.batch, -1, None, None, None, None, int(n.sum()), pack(codes))], ASK)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("part"), F.col("text").cast("string").alias("text")).mapInArrow(run, ASK)


def named(asks: DataFrame, least: int) -> DataFrame:
    """What each bin answers (rows with a batch), and the phrases that it names (rows with an id)."""

    def name(group: pa.Table) -> pa.Table:
        lang, bin_ = group["lang"][0].as_py(), group["bin"][0].as_py()
        counts = [unpack(x.as_py(), "<i8") for x in group["n"]]
        sizes, n = [len(x) for x in counts], np.concatenate(counts)
        is_word = group["words"].null_count == 0
        if is_word:
            coded = pa.array([w for x in group["words"] for w in unpack(x.as_py(), "u1").tobytes().split(b" ")], pa.binary()).dictionary_encode()
            of, words = coded.indices.to_numpy(), coded.dictionary
            total = np.zeros(len(words), np.int64)
            np.add.at(total, of, n)
            by_name = np.argsort(np.array([xxhash.xxh64_intdigest(w.as_py()) for w in words], np.uint64), kind="stable")
        else:
            left = np.concatenate([np.cumsum(unpack(x.as_py(), "<i8")) for x in group["left"]])
            right = np.concatenate([unpack(x.as_py(), "<i8") for x in group["right"]])
            order = np.lexsort((right, left))
            first = np.r_[True, (left[order][1:] != left[order][:-1]) | (right[order][1:] != right[order][:-1])]
            of = np.empty(len(order), np.int64)
            of[order] = np.cumsum(first) - 1
            total = np.add.reduceat(n[order], np.flatnonzero(first))
            left, right = left[order][first], right[order][first]
            by_name = np.arange(len(total))
        often = by_name[total[by_name] >= least]
        ids = np.zeros(len(total), np.int64)
        ids[often] = (bin_ << 32) + 1 + np.arange(len(often))
        answers = [(lang, b, bin_, pack(part), None, None, None, None, None) for b, part in zip(group["batch"].to_pylist(), np.split(ids[of], np.cumsum(sizes)[:-1]), strict=True)]
        names = [(lang, None, bin_, None, ids[i], words[i].as_py() if is_word else None, None if is_word else left[i], None if is_word else right[i], total[i]) for i in often.tolist()]
        return pa.Table.from_batches([_record(answers + names, NAME)])

    return asks.groupBy("lang", "bin").applyInArrow(name, NAME)


def pairs_asked(states: DataFrame, answers: DataFrame, bins: int) -> DataFrame:
    """The next level: adjacent named phrases are pairs, which are asked for in their turn."""

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_batches([_record([], ASK)])
        lang, batch = left["lang"][0].as_py(), left["batch"][0].as_py()
        heard = sorted(zip(right["bin"].to_pylist(), right["ids"], strict=True), key=lambda x: x[0])
        id_of = np.concatenate([np.zeros(0, np.int64), *(unpack(x.as_py(), "<i8") for _, x in heard)])
        codes = unpack(left["codes"][0].as_py(), "<i4")
        named_ = np.r_[id_of, np.int64(0)][codes] > 0  # code -1 meets the zero
        at = np.flatnonzero(named_[:-1] & named_[1:])
        if not len(at):
            return pa.Table.from_batches([_record([], ASK)])
        pairs, of, n = np.unique(codes[at].astype(np.int64) * len(id_of) + codes[at + 1], return_inverse=True, return_counts=True)
        a, b = id_of[pairs // len(id_of)], id_of[pairs % len(id_of)]
        mixed = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ ((b.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))
        mixed ^= mixed >> np.uint64(32)
        order, parts = _ordered((mixed * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(20)).astype(np.int64) % bins, b, a)
        out = np.full(len(codes), -1, np.int32)
        out[at] = _codes(order, of)
        asks = [(lang, batch, k, None, pack(np.diff(a[p], prepend=0)), pack(b[p]), pack(n[p]), None, None) for k, p in parts]
        return pa.Table.from_batches([_record([*asks, (lang, batch, -1, None, None, None, None, None, pack(out))], ASK)])

    keys = ("lang", "batch")
    return states.select(*keys, "codes").groupBy(*keys).cogroup(answers.select(*keys, "bin", "ids").groupBy(*keys)).applyInArrow(pair, ASK)


def levels(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS) -> tuple[DataFrame, list[DataFrame]]:
    """The number of words of each lang, and the names of each level: (lang, id, word, n), then (lang, id, left, right, n)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    n_bytes = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    bins = max(partitions(spark), ceil(n_bytes / BIN_BYTES))
    asked, out = stored(words_asked(docs, bins), "asked"), []
    totals = asked.where("bin = -1").groupBy("lang").agg(F.sum("n_words").alias("n_lang"))
    for level in range(1, most_words + 1):
        names = stored(named(asked.where("bin >= 0").select("lang", "batch", "bin", "words", "left", "right", "n"), least), "named")
        out.append(names.where("id is not null").select("lang", "id", *(["word"] if level == 1 else ["left", "right"]), "n"))
        if level < most_words:
            asked = stored(pairs_asked(asked.where("bin = -1"), names.where("batch is not null"), bins), "asked")
    return totals, out


def phrases(named_: list[DataFrame]) -> list[DataFrame]:
    """lang, id, phrase, n, first and rest (the counts on both sides of each cut) of the levels from 2 on."""
    none = F.array().cast("array<long>")
    below = named_[0].select("lang", "id", F.col("word").cast("string").alias("phrase"), F.col("word").cast("string").alias("last"), "n", none.alias("first"), none.alias("rest"))
    out = []
    for level in named_[1:]:
        a = below.select("lang", F.col("id").alias("left"), F.col("phrase").alias("begin"), F.concat("first", F.array("n")).alias("first"))
        b = below.select("lang", F.col("id").alias("right"), "last", F.concat(F.array("n"), "rest").alias("rest"))
        below = level.join(a, ["lang", "left"]).join(b, ["lang", "right"]).select("lang", "id", F.concat_ws(" ", "begin", "last").alias("phrase"), "last", "n", "first", "rest")
        below = stored(below, "phrases")
        out.append(below)
    return out


def collocations(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, share: int = SHARE, top: int = TOP) -> DataFrame:
    """Each lang's first phrases by score: lang, rank, phrase, a, l, r, n, score."""
    totals, named_ = levels(docs, least, most_words)
    found = phrases(named_)
    kept = []
    for k, level in enumerate(found):
        if k + 1 < len(found):
            children = named_[k + 2]
            longest = children.select("lang", F.col("left").alias("id"), "n").unionByName(children.select("lang", F.col("right").alias("id"), "n")).groupBy("lang", "id").agg(F.max("n").alias("n_longer"))
            level = level.join(longest, ["lang", "id"], "left").where((F.col("n_longer") * 100 < F.col("n") * share) | F.col("n_longer").isNull())
        kept.append(level.select("lang", "phrase", F.col("n").alias("a"), "first", "rest"))
    rows = kept[0]
    for more in kept[1:]:
        rows = rows.unionByName(more)
    rows = rows.join(totals, "lang").select("lang", "phrase", "a", F.col("n_lang").alias("n"), F.posexplode(F.arrays_zip("first", "rest")).alias("k", "cut"))
    rows = rows.select("lang", "phrase", "a", "n", "k", F.col("cut.first").alias("l"), F.col("cut.rest").alias("r"))
    score = F.expr("cast(cast(1000 as decimal(38,0)) * cast(a as decimal(38,0)) * cast(n as decimal(38,0)) as decimal(38,0)) div cast(cast(l as decimal(38,0)) * cast(r as decimal(38,0)) as decimal(38,0))")
    cut = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    best = rows.groupBy("lang", "phrase", "a", "n").agg(cut).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
