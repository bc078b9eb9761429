"""Language-model scores by deleted interpolation.

    P(w | v) = l2(b) * c(v, w) / c(v) + l1(b) * c(w) / N + l0(b) / (V + 1)

mixes maximum-likelihood estimates. The weights l depend on the bucket b of the context's frequency, one bucket for each
doubling of c(v), and are learned by expectation-maximisation on counts of training texts that were deleted from the
estimates (a tenth of them); scores then use the counts of all training texts. A text's first context is the end token.

Neither the n-gram table nor the corpus fits anywhere whole, so both meet in blocks. A task turns its texts into batches
of about BATCH_TOKENS tokens, each a row: token numbers within the batch's sorted vocabulary, compressed. A batch asks
for the counts of its distinct words and pairs, one row for each bucket of a hash of them; a bucket adds up what all
batches bring and answers each in its own order; a batch puts the answers together and scores its texts. Words and pairs
travel once for each batch instead of once for each occurrence. What the driver sees is totals and the histogram of held
out events over a grid of quantised estimates, whose size does not depend on the corpus.

Words and pairs are 64-bit hashes. Edge cases: a null or empty text is the end token alone; with no training text every
probability is the uniform one, 1 / (V + 1) with V = 0; rows that share a doc_id are scored each; an empty table gives
no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, stored, words

BATCH_TOKENS = 1_000_000
BUCKET_KEYS = 1_500_000
COUNTED, DELETED, TEST = 0, 1, 2
END = b" "  # no word holds a space
GRID = 4  # cells of the held-out histogram for each doubling of an estimate
NONE = -10_000
BATCH = "batch long, role int, n_keys long, n_tokens long, doc_ids array<long>, sizes array<int>, words binary, ids binary"
ANSWER = "batch long, kind int, bucket int, every binary, counted binary, kinds_every long, kinds_counted long, n_every long, n_counted long"


def pack(values: np.ndarray) -> bytes:
    """Numbers as byte planes under zstd."""
    wide = values.view(np.uint8).reshape(len(values), values.itemsize) if len(values) else np.zeros((0, values.itemsize), np.uint8)
    return zstandard.ZstdCompressor(3).compress(wide.T.tobytes())


def unpack(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of a pair of hashes."""
    h = a * np.uint64(0x9E3779B97F4A7C15) ^ (b + np.uint64(0x632BE59BD9B4E019))
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def pairs_of(ids: np.ndarray, end: int, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (context, word) pairs of a batch: their hashes, contexts and words, and the pair of each token."""
    before = np.empty_like(ids)
    before[0], before[1:] = end, ids[:-1]
    codes, of = np.unique(before.astype(np.int64) * len(vocabulary) + ids, return_inverse=True)
    v, w = codes // len(vocabulary), codes % len(vocabulary)
    return mixed(vocabulary[v], vocabulary[w]), v, w, of


class Batcher:
    """Texts of one role on their way into a row."""

    def __init__(self, role: int) -> None:
        self.role = role
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = defaultdict(count().__next__)
        self.parts: list[np.ndarray] = []
        self.docs: list[int | None] = []
        self.tokens = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        ws = words(text)
        ws.append(END)
        self.parts.append(np.fromiter(map(self.number.__getitem__, ws), np.int32, len(ws)))
        self.docs.append(doc_id)
        self.tokens += len(ws)

    def row(self, batch: int) -> tuple:
        keys = np.array([xxhash.xxh64_intdigest(w, 7) for w in self.number], np.uint64)
        order = np.argsort(keys)
        rank = np.empty(len(keys), np.int32)
        rank[order] = np.arange(len(keys), dtype=np.int32)
        ids, sizes = rank[np.concatenate(self.parts)], [len(p) for p in self.parts]
        vocabulary = keys[order]
        end = int(ids[sizes[0] - 1])
        n = len(pairs_of(ids, end, vocabulary)[0])
        out = (batch, self.role, n, self.tokens, self.docs, sizes, pack(np.diff(vocabulary, prepend=np.uint64(0))), pack(ids))
        self.clear()
        return out


def batches_of(docs: DataFrame, folds: int) -> DataFrame:
    """One row for each batch of texts of one role (BATCH)."""
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary())
    names = [f.split()[0] for f in BATCH.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made = count(TaskContext.get().partitionId() << 32)
        open_ = [Batcher(r) for r in (COUNTED, DELETED, TEST)]
        to_batch = lambda row: pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)
        for b in batches:
            for doc_id, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                batcher = open_[role]
                batcher.add(doc_id, text)
                if batcher.tokens >= BATCH_TOKENS:
                    yield to_batch(batcher.row(next(made)))
        for batcher in open_:
            if batcher.tokens:
                yield to_batch(batcher.row(next(made)))

    deleted = F.pmod(F.xxhash64(F.lit("deleted"), "doc_id"), F.lit(10)) == 0
    role = F.when(fold("doc_id", folds) == 0, TEST).when(deleted, DELETED).otherwise(COUNTED)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), role.alias("role"), "text").mapInArrow(run, BATCH)


def _opened(words_: bytes, ids_: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(unpack(words_, "<u8"), dtype=np.uint64), unpack(ids_, "<i4")


def _dealt(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each bucket the positions of its keys, in the keys' order: the one rule that asking and answering share."""
    order = np.lexsort((keys, keys % np.uint64(buckets)))
    of = (keys % np.uint64(buckets))[order]
    for part in np.split(order, np.flatnonzero(np.diff(of)) + 1) if len(order) else []:
        yield int(keys[part[0]] % np.uint64(buckets)), part


def asked(batches: DataFrame, buckets: int) -> DataFrame:
    """batch, role, kind (0 words, 1 pairs), bucket, keys, n: what each batch holds, for each bucket."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["batch", "role", "kind", "bucket", "keys", "n"]
        for b in rows:
            for batch, role, words_, ids_ in zip(*(c.to_pylist() for c in b.columns), strict=True):
                vocabulary, ids = _opened(words_, ids_)
                end = int(np.searchsorted(vocabulary, np.uint64(xxhash.xxh64_intdigest(END, 7))))
                pair, _, _, of = pairs_of(ids, end, vocabulary)
                for kind, keys, n in ((0, vocabulary, np.bincount(ids, minlength=len(vocabulary))), (1, pair, np.bincount(of, minlength=len(pair)))):
                    got = [(k, pack(np.diff(keys[p], prepend=np.uint64(0))), pack(n[p].astype(np.int32))) for k, p in _dealt(keys, buckets)]
                    same = [pa.array(np.full(len(got), x, t)) for x, t in ((batch, np.int64), (role, np.int32), (kind, np.int32))]
                    cols = [pa.array(c, t) for c, t in zip(zip(*got, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)]
                    yield pa.RecordBatch.from_arrays([*same, *cols], names)

    return batches.select("batch", "role", "words", "ids").mapInArrow(run, "batch long, role int, kind int, bucket int, keys binary, n binary")


def answered(asks: DataFrame) -> DataFrame:
    """ANSWER: for each asking row the counts of its keys, in all training texts and in those not deleted."""
    names = [f.split()[0] for f in ANSWER.split(", ")]
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 4)

    def answer(group: list[tuple]) -> pa.RecordBatch:
        keys = [np.cumsum(unpack(g[4], "<u8"), dtype=np.uint64) for g in group]
        distinct, of = np.unique(np.concatenate(keys), return_inverse=True)
        every, counted = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        parts = np.split(of, np.cumsum([len(k) for k in keys])[:-1])
        for g, p in zip(group, parts, strict=True):
            if g[1] != TEST:
                n = unpack(g[5], "<i4")
                every[p] += n
                if g[1] == COUNTED:
                    counted[p] += n
        sums = (int((every > 0).sum()), int((counted > 0).sum()), int(every.sum()), int(counted.sum()))
        rows = [(g[0], g[2], g[3], pack(every[p]), pack(counted[p]) if g[1] == DELETED else b"", *(sums if i == 0 else (0, 0, 0, 0))) for i, (g, p) in enumerate(zip(group, parts, strict=True))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for b in rows:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if group and r[2:4] != group[0][2:4]:
                    yield answer(group)
                    group = []
                group.append(r)
        if group:
            yield answer(group)

    return asks.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket", "batch").mapInArrow(run, ANSWER)


class Together:
    """A batch with the counts that its words and pairs have."""

    def __init__(self, words_: bytes, ids_: bytes, answers: dict[tuple[int, int], tuple[bytes, bytes]], buckets: int, counted: bool) -> None:
        self.vocabulary, self.ids = _opened(words_, ids_)
        end = int(np.searchsorted(self.vocabulary, np.uint64(xxhash.xxh64_intdigest(END, 7))))
        pair, self.v, self.w, self.of = pairs_of(self.ids, end, self.vocabulary)
        self.word_n, self.pair_n = (self._filled(keys, kind, answers, buckets, counted) for kind, keys in ((0, self.vocabulary), (1, pair)))

    @staticmethod
    def _filled(keys: np.ndarray, kind: int, answers: dict, buckets: int, counted: bool) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        for k, p in _dealt(keys, buckets):
            out[p] = unpack(answers[kind, k][counted], "<i8")
        return out

    def estimates(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each pair: the context's bucket, c(v, w) / c(v), c(w) / n."""
        c = self.word_n[self.v]
        return bucket_of(c), self.pair_n / np.maximum(c, 1), self.word_n[self.w] / max(n, 1)


def bucket_of(c: np.ndarray) -> np.ndarray:
    """0 for a context not seen, else 1 + the whole part of its logarithm to base 2."""
    return np.where(c > 0, np.floor(np.log2(np.maximum(c, 1))).astype(np.int64) + 1, 0)


def met(batches: DataFrame, answers: DataFrame, buckets: int, work, schema: str, counted: bool) -> DataFrame:
    """work(row of batches, Together) for each batch, with the answers it got."""
    left = batches.select("batch", F.lit(-1).alias("kind"), F.lit(-1).alias("bucket"), "role", "doc_ids", "sizes", F.col("words").alias("a"), F.col("ids").alias("b"))
    right = answers.select("batch", "kind", "bucket", F.lit(0).alias("role"), F.lit(None).cast("array<long>").alias("doc_ids"), F.lit(None).cast("array<int>").alias("sizes"), F.col("every").alias("a"), F.col("counted").alias("b"))
    both = left.unionByName(right).repartition("batch").sortWithinPartitions("batch", "kind", "bucket")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, got = None, {}
        for b in rows:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r[1] == -1:
                    if head:
                        yield work(head, Together(head[6], head[7], got, buckets, counted))
                    head, got = r, {}
                elif head and r[0] == head[0]:
                    got[r[1], r[2]] = (r[6], r[7])
        if head:
            yield work(head, Together(head[6], head[7], got, buckets, counted))

    return both.mapInArrow(run, schema)


def histogram(deleted: DataFrame, answers: DataFrame, buckets: int, n: int) -> np.ndarray:
    """Rows (bucket, cell of c(v, w) / c(v), cell of c(w) / n, events) of the deleted texts' tokens."""

    def work(row: tuple, t: Together) -> pa.RecordBatch:
        b, p2, p1 = t.estimates(n)
        cell = lambda p: np.where(p > 0, np.round(GRID * np.log2(np.maximum(p, 1e-300))).astype(np.int64), NONE)
        cells, of = np.unique(np.stack([b, cell(p2), cell(p1)], axis=1), axis=0, return_inverse=True)
        events = np.bincount(of.ravel(), np.bincount(t.of, minlength=len(t.v)), len(cells)).astype(np.int64)
        return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(cells[:, k])) for k in range(3)), pa.array(events)], ["b", "p2", "p1", "events"])

    got = met(deleted, answers.join(deleted.select("batch"), "batch", "left_semi"), buckets, work, "b long, p2 long, p1 long, events long", True)
    rows = got.groupBy("b", "p2", "p1").agg(F.sum("events").alias("events")).collect()
    return np.array([tuple(r) for r in rows], np.int64).reshape(-1, 4)


def learn(cells: np.ndarray, kinds: int, rounds: int = 60) -> np.ndarray:
    """Weights (l2, l1, l0) of each of 64 buckets, by expectation-maximisation; a bucket leans on the whole by one event."""
    value = lambda c: np.where(c == NONE, 0.0, np.exp2(c / GRID))
    p = np.stack([value(cells[:, 1]), value(cells[:, 2]), np.full(len(cells), 1 / (kinds + 1))], axis=1)
    events = cells[:, 3].astype(float)

    def run(own: np.ndarray, start: np.ndarray) -> np.ndarray:
        w = start.copy()
        for _ in range(rounds):
            part = p[own] * w
            share = part / part.sum(axis=1, keepdims=True)
            w = (share * events[own, None]).sum(axis=0) + start
            w /= w.sum()
        return w

    start = np.array([0.4, 0.5, 0.1])
    if not len(cells):
        return np.tile(start, (64, 1))
    whole = run(np.ones(len(cells), bool), start)
    out = np.tile(whole, (64, 1))
    for b in np.unique(cells[:, 0]):
        out[b] = run(cells[:, 0] == b, whole)
    return out


def scores(docs: DataFrame, folds: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; fold 0 is held out of training."""
    batches = stored(batches_of(docs, folds), "batches")
    total = batches.agg(F.sum("n_keys").alias("n")).first().n or 0
    buckets = max(1, ceil(total / BUCKET_KEYS))
    answers = stored(answered(asked(batches, buckets)), "answers")
    s = answers.where("kind = 0").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("kinds_every", "kinds_counted", "n_every", "n_counted")]).first()
    kinds, n = s.kinds_every, s.n_every
    weights = learn(histogram(batches.where(F.col("role") == DELETED), answers, buckets, s.n_counted), s.kinds_counted)

    def work(row: tuple, t: Together) -> pa.RecordBatch:
        b, p2, p1 = t.estimates(n)
        w = weights[b]
        p = w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] / (kinds + 1)
        base = np.log10((t.word_n + 0.1) / (n + 0.1 * (kinds + 1)))
        sizes = np.array(row[5])
        at = np.cumsum(sizes) - sizes
        per = [np.add.reduceat(x, at) for x in ((t.word_n > 0)[t.ids].astype(np.int64), base[t.ids], np.log10(p)[t.of])]
        cols = [pa.array(row[4], pa.int64()), pa.array(np.full(len(sizes), row[3] == TEST)), pa.array(sizes.astype(np.int64)), pa.array(per[0]), pa.array(np.full(len(sizes), n, np.int64)), pa.array(per[1]), pa.array(per[2])]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return met(batches, answers, buckets, work, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double", False)
