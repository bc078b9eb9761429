"""Removal of repeated word windows behind a count-min sketch.

A window is LENGTH consecutive words of one document. A word goes when a window that covers it has a word sequence that
also starts in a document with a smaller doc_id, so that the first document keeps every passage.

Most windows of a corpus occur once, and grouping them all is what such a search costs. A first pass therefore only
counts, in a count-min sketch of DEPTH lines whose width follows the number of words. No task holds the sketch: every
batch of texts sends its own, sorted cells for each shard of the sketch; a shard merges what all batches send, and
answers each with one bit for each of its cells, whether the count is two or more (counters stop there). A window whose
cells all say so is estimated to be repeated. Counts are never too low, so none that is repeated is lost. The second pass
groups the estimated windows exactly, by 96 bits of hash, in the same way: a batch sends each once, with the smallest
doc_id it has there, and hears whether another batch has a smaller one. The last pass cuts.

What travels is a byte or two for a window, 12 to 20 for one that is estimated, and bits back; a shard has about
SHARD_WINDOWS windows whatever the corpus. A window in thousands of documents is one entry of each batch.

Edge cases: a null or empty text has no words; texts under LENGTH words lose nothing; rows that share a doc_id lose
nothing to each other and have a row each; a row without doc_id neither loses words nor takes them; a passage that occurs
again within one document stays; other columns take no part, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, partitions, stored
from .lm_score import pack, unpack
from .packed_words import BATCH_WORDS, Batch, packed

LENGTH = 13
DEPTH, WIDTH = 2, 4  # lines of the sketch, and cells of a line for each window
SHARD_WINDOWS = 4_000_000
SKETCH, EXACT = 0, 1
ODD = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
BATCHES = "batch long, doc_ids array<long>, sizes array<int>, words binary, ids binary"
ASKS = "batch long, bin long, cells binary"
GROUPS = "batch long, bin long, hash binary, check binary, doc binary"
BITS = "batch long, kind int, bin long, bits binary"
KEPT = "doc_id long, n_words long, n_removed long, kept string"
_INT = {"batch": pa.int64(), "kind": pa.int32(), "bin": pa.int64()}


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [f.split()[0] for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _INT.get(n, pa.binary())) for n, c in zip(names, columns, strict=True)], names)


def batches_of(docs: DataFrame, batch_words: int) -> DataFrame:
    """docs as rows of numbered words (BATCHES)."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary())
        for b in packed(rows, bytes.split, batch_words):
            row = (b.batch, b.doc_ids, b.sizes, pack(np.frombuffer(b" ".join(b.words), np.uint8)), pack(b.ids))
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [f.split()[0] for f in BATCHES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit("").alias("part"), F.col("text").cast("string").alias("text")).mapInArrow(run, BATCHES)


def opened(row: dict) -> Batch:
    words = unpack(row["words"], "u1").tobytes().split(b" ")
    return Batch(row["batch"], "", row["doc_ids"], np.array(row["sizes"], np.int64), words, unpack(row["ids"], "<i4"))


class Windows:
    """The windows of a batch: where each starts, its document's id, and two hashes, of 64 and 32 bits."""

    def __init__(self, b: Batch, length: int) -> None:
        known = np.array([i is not None for i in b.doc_ids], bool)
        ends = np.cumsum(b.sizes)
        left = np.repeat(ends, b.sizes) - np.arange(len(b.ids))
        self.at = np.flatnonzero((left >= length) & np.repeat(known, b.sizes))
        self.doc = np.repeat(np.array([i or 0 for i in b.doc_ids], np.int64), b.sizes)[self.at]
        word = np.array([xxhash.xxh3_64_intdigest(w) for w in b.words], np.uint64)[b.ids]
        self.hash = self._rolled(word, ODD[2], length)
        self.check = (self._rolled(word ^ (word >> np.uint64(31)), ODD[3], length) >> np.uint64(32)).astype(np.uint32)

    def _rolled(self, word: np.ndarray, base: np.uint64, length: int) -> np.ndarray:
        n = len(word) - length + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        h = np.zeros(n, np.uint64)
        for k in range(length):
            h *= base
            h += word[k : k + n]
        h = h[self.at]
        h ^= h >> np.uint64(32)
        h *= ODD[1]
        return h ^ (h >> np.uint64(29))


class Sketch:
    """Where windows count: shards, the bits of a shard's width, and the bin of each shard's line."""

    def __init__(self, n_words: int, shards: int) -> None:
        self.shards = np.uint64(shards)
        self.bits = np.uint64(max(8, ceil(log2(WIDTH * max(n_words, 1) / shards))))

    def keys(self, w: Windows, line: int) -> np.ndarray:
        """shard and cell of each window as one number."""
        return ((w.hash % self.shards) << self.bits) | ((w.hash // self.shards * ODD[line]) >> (np.uint64(64) - self.bits))

    def asks(self, b: Batch, w: Windows) -> list[tuple]:
        """For each shard and line the batch's cells in order, each twice if it has two windows or more."""
        out = []
        for line in range(DEPTH):
            key = np.sort(self.keys(w, line))
            key = key[np.r_[np.ones(min(2, len(key)), bool), key[2:] != key[:-2]]]
            shard = (key >> self.bits).astype(np.int64)
            cell = (key & ((np.uint64(1) << self.bits) - np.uint64(1))).astype(np.uint32)
            for s, part in _cut(shard, cell):
                out.append((b.batch, s * DEPTH + line, pack(np.diff(part, prepend=np.uint32(0)))))
        return out

    def estimated(self, w: Windows, bits: dict[tuple[int, int], bytes]) -> np.ndarray:
        """Which windows may be repeated."""
        out = np.ones(len(w.at), bool)
        for line in range(DEPTH):
            key, of = np.unique(self.keys(w, line), return_inverse=True)
            out &= _answers((key >> self.bits).astype(np.int64), lambda s, line=line: bits[SKETCH, s * DEPTH + line])[of]
        return out


def _cut(sorted_: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """values, cut where the number beside them changes."""
    edges = np.flatnonzero(np.diff(sorted_)) + 1
    if len(values):
        yield from zip(sorted_[np.r_[0, edges]].tolist(), np.split(values, edges), strict=True)


def _answers(shard: np.ndarray, bits) -> np.ndarray:
    """The bits that shards sent for entries that stand in their order."""
    got = [np.unpackbits(np.frombuffer(bits(s), np.uint8), count=len(part)) for s, part in _cut(shard, shard)]
    return np.concatenate(got).astype(bool) if got else np.zeros(0, bool)


class Groups:
    """The distinct estimated windows of a batch in their shards' order, with the smallest document of each."""

    def __init__(self, w: Windows, estimated: np.ndarray, shards: np.uint64) -> None:
        at = np.flatnonzero(estimated)
        shard = (w.hash[at] % shards).astype(np.int64)
        self.order = at[np.lexsort((w.doc[at], w.check[at], w.hash[at], shard))]
        h, c = w.hash[self.order], w.check[self.order]
        first = np.r_[np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (c[1:] != c[:-1])]
        self.of = np.cumsum(first) - 1
        self.hash, self.check, self.doc = h[first], c[first], w.doc[self.order][first]
        self.shard = (self.hash % shards).astype(np.int64)

    def asks(self, batch: int) -> list[tuple]:
        rows = np.arange(len(self.hash))
        return [(batch, s, pack(np.diff(self.hash[r], prepend=np.uint64(0))), pack(self.check[r]), pack(self.doc[r])) for s, r in _cut(self.shard, rows)]

    def repeated(self, w: Windows, bits: dict[tuple[int, int], bytes]) -> np.ndarray:
        """Where windows start that a smaller document has too."""
        elsewhere = _answers(self.shard, lambda s: bits[EXACT, s])
        return w.at[self.order[elsewhere[self.of] | (w.doc[self.order] > self.doc[self.of])]]


def merged_sketch(asks: DataFrame, bits: int) -> DataFrame:
    """BITS for each batch: which of its cells count two or more over all batches."""

    def merge(group: pa.Table) -> pa.Table:
        counters = np.zeros(1 << bits, np.uint8)
        cells = [np.cumsum(unpack(c.as_py(), "<u4"), dtype=np.int64) for c in group["cells"]]
        for c in cells:
            u, n = np.unique(c, return_counts=True)
            counters[u] = np.minimum(counters[u] + n, 2)
        rows = [(b.as_py(), SKETCH, k.as_py(), np.packbits(counters[np.unique(c)] > 1).tobytes()) for b, k, c in zip(group["batch"], group["bin"], cells, strict=True)]
        return pa.Table.from_batches([_table(rows, BITS)])

    return asks.groupBy("bin").applyInArrow(merge, BITS)


def grouped(asks: DataFrame) -> DataFrame:
    """BITS for each batch: which of its windows another batch has in a smaller document."""

    def resolve(group: pa.Table) -> pa.Table:
        parts = [(np.cumsum(unpack(h, "<u8"), dtype=np.uint64), unpack(c, "<u4"), unpack(d, "<i8")) for h, c, d in zip(*(group[k].to_pylist() for k in ("hash", "check", "doc")), strict=True)]
        h, c, d = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((d, c, h))
        first = np.r_[True, (h[order][1:] != h[order][:-1]) | (c[order][1:] != c[order][:-1])]
        smaller = np.empty(len(h), bool)
        smaller[order] = d[order] > d[order][first][np.cumsum(first) - 1]
        flags = np.split(smaller, np.cumsum([len(p[0]) for p in parts])[:-1])
        rows = [(b, EXACT, k, np.packbits(f).tobytes()) for b, k, f in zip(group["batch"].to_pylist(), group["bin"].to_pylist(), flags, strict=True)]
        return pa.Table.from_batches([_table(rows, BITS)])

    return asks.groupBy("bin").applyInArrow(resolve, BITS)


def _by_batch(batches: DataFrame, bits: DataFrame, run, schema: str) -> DataFrame:
    """run(batch, its bits) for every batch."""

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        got = {(k, n): b for k, n, b in zip(*(right[c].to_pylist() for c in ("kind", "bin", "bits")), strict=True)}
        return pa.Table.from_batches([run(opened(row), got) for row in left.to_pylist()])

    return batches.groupBy("batch").cogroup(bits.groupBy("batch")).applyInArrow(both, schema)


def _kept(b: Batch, starts: np.ndarray, length: int) -> pa.RecordBatch:
    """The texts without the words of windows that start at starts, one row each (KEPT)."""
    step = np.zeros(len(b.ids) + length + 1, np.int32)
    step[starts] += 1
    step[starts + length] -= 1
    gone = np.cumsum(step)[: len(b.ids)] > 0
    edges = np.cumsum(b.sizes)[:-1]
    kept = [b" ".join(map(b.words.__getitem__, ids[~g].tolist())) for ids, g in zip(np.split(b.ids, edges), np.split(gone, edges), strict=True)]
    removed = [int(g.sum()) for g in np.split(gone, edges)]
    columns = [pa.array(b.doc_ids, pa.int64()), pa.array(b.sizes), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in KEPT.split(", ")])


def without_repeats(docs: DataFrame, length: int = LENGTH, batch_words: int = BATCH_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space) for each row of docs."""
    spark = docs.sparkSession
    bounded_batches(spark)
    batches = stored(batches_of(docs, batch_words), "words")
    n_words = batches.select(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    sketch = Sketch(n_words, max(partitions(spark), ceil(n_words / SHARD_WINDOWS)))

    def ask(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows:
            for row in r.to_pylist():
                b = opened(row)
                yield _table(sketch.asks(b, Windows(b, length)), ASKS)

    def group(b: Batch, bits: dict) -> pa.RecordBatch:
        w = Windows(b, length)
        return _table(Groups(w, sketch.estimated(w, bits), sketch.shards).asks(b.batch), GROUPS)

    def cut(b: Batch, bits: dict) -> pa.RecordBatch:
        w = Windows(b, length)
        return _kept(b, Groups(w, sketch.estimated(w, bits), sketch.shards).repeated(w, bits), length)

    counted = stored(merged_sketch(batches.mapInArrow(ask, ASKS), int(sketch.bits)), "sketch")
    exact = stored(grouped(_by_batch(batches, counted, group, GROUPS)), "windows")
    return _by_batch(batches, counted.unionByName(exact), cut, KEPT)
