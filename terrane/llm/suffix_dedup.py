"""Removal of long repeats with a logarithmic family of suffix arrays.

A text is a string of symbols: its UTF-8 bytes, or (``WORDS``) its words. A symbol goes when a string of ``length``
symbols that covers it also starts anywhere else, in the same document or another one.

Suffixes are indexed sparsely: of every window of length symbols one suffix, the one at its anchor, the leftmost
smallest of its hashed grams. Equal windows have equal anchors at equal places, so a repeat always brings two suffixes
together that agree in a gram at least. An entry is (key: the hash of the suffix's first gram; ctx: the hash of all
symbols under the windows that share the anchor; the document; the first and last of those windows). A suffix array is
the sorted table of its entries' keys, counted; it stands in the order of the hashes, which brings equal long prefixes
together as byte order would, and nothing else is asked of the order.

Documents come in batches, whose number follows the corpus. A batch gets its array, which is merge-scanned against
itself and against each existing level for keys that are there twice (tables bucketed and sorted alike: no shuffle);
before the next batch, levels of equal size are merged, so there are log2(batches) levels. A key is one row of an array
however many documents share it. Entries of repeated keys are resolved exactly: a context that occurs twice is repeated
as a whole; different contexts under one key are compared window by window, by 64-bit hashes independent of the key's.

Edge cases: a null text counts as empty; texts under length symbols lose nothing; repeated rows are documents of their
own, so a row and its copy both lose what they share; overlapping repeats within one text count; an empty table gives no
rows; columns of any name are kept. Hashes stand in for symbols: two 64-bit hashes must agree for a match.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from math import ceil
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, forget, kept_by, partitions, rows_in, scratch, stored, text_key


class Symbols(NamedTuple):
    """What repeats are counted in: how many symbols make a repeat, and a gram; whether symbols are words."""

    length: int
    gram: int
    words: bool = False

    def of(self, raw: bytes) -> np.ndarray:
        """Bytes, or a 32-bit hash of each word."""
        return np.array([xxhash.xxh32_intdigest(w) for w in raw.split()], np.uint32) if self.words else np.frombuffer(raw, np.uint8)


BYTES = Symbols(400, 100)
WORDS = Symbols(51, 8, True)  # passages of over 50 words; words end at space and tab to carriage return
BATCH_ROWS, MOST_BATCHES = 60_000, 16
CHUNK = 1 << 20
MOST_CONTEXTS = 20_000  # of one key, resolved in one task (48 MB of hashes); keys with more go through a shuffle on their windows
SLICE = 500_000
SPOKEN = re.compile(rb"[^ \t-\r]+")
ENTRY = "key long, ctx long, doc_id long, text_key long, lo int, hi int"
SPANS = "array<struct<from:int,to:int>>"


class Rolling:
    """Hashes of all n-symbol strings of a buffer: a polynomial over random symbol values, modulo 2 ** 64, then mixed."""

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.values = rng.integers(0, 2**64, 256, np.uint64)
        self.spread = rng.integers(0, 2**64, 2, np.uint64) | np.uint64(1)
        self.base = int(rng.integers(0, 2**62)) * 2 + 1
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 17)
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, self.base, np.uint64)], dtype=np.uint64)
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, pow(self.base, -1, 2**64), np.uint64)], dtype=np.uint64)

    def _value(self, data: np.ndarray) -> np.ndarray:
        if data.dtype == np.uint8:
            return self.values[data]
        h = (data.astype(np.uint64) + np.uint64(1)) * self.spread[0]
        h ^= h >> np.uint64(29)
        h *= self.spread[1]
        return h ^ (h >> np.uint64(32))

    def grams(self, data: np.ndarray, n: int) -> np.ndarray:
        self._grow(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self._value(data) * self.up[: len(data)], out=total[1:])
        h = (total[n:] - total[:-n]) * self.down[: len(data) - n + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))


def rolling(seed: int) -> Rolling:
    """One table of powers for each worker process."""
    return kept_by("suffix_dedup", seed, Rolling)


def anchors(data: np.ndarray, kind: Symbols) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """anchor, first window, last window, key of each run of windows that share an anchor; up to CHUNK symbols."""
    grams = rolling(1).grams(data, kind.gram)
    width, low = kind.length - kind.gram + 1, np.uint64((1 << 24) - 1)
    ranked = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    rows = np.full(-(-len(ranked) // width) * width, ~np.uint64(0))
    rows[: len(ranked)] = ranked
    rows = rows.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = len(data) - kind.length + 1
    at = (np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows]) & low).astype(np.int64)
    lo = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    hi = np.r_[lo[1:] - 1, windows - 1]
    return at[lo], lo, hi, grams[at[lo]]


def entries(raw: bytes, kind: Symbols) -> list[np.ndarray]:
    """key, ctx, lo, hi of a document's anchors, as signed integers."""
    out: list[list] = [[], [], [], []]
    data, step = kind.of(raw), CHUNK - kind.length + 1
    for c in range(0, len(data) - kind.length + 1, step):
        piece = data[c : c + CHUNK]
        at, lo, hi, key = anchors(piece, kind)
        view, size = memoryview(piece).cast("B"), piece.itemsize
        ctx = [xxhash.xxh3_64_intdigest(view[a * size : (b + kind.length) * size], x - a) for x, a, b in zip(at.tolist(), lo.tolist(), hi.tolist(), strict=True)]
        for o, v in zip(out, (key, np.array(ctx, np.uint64), lo + c, hi + c), strict=True):
            o.append(v)
    return [np.concatenate(o) for o in out] if out[0] else []


def _raw(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def byte_spans(raw: bytes, spans: list[dict], kind: Symbols) -> list[tuple[int, int]]:
    """Spans of the text's bytes for spans of its symbols; a span of words goes on to the next word."""
    if not kind.words:
        return [(s["from"], s["to"]) for s in spans]
    starts = [m.start() for m in SPOKEN.finditer(raw)] + [len(raw)]
    return [(starts[s["from"]] if s["from"] else 0, starts[s["to"]]) for s in spans]


def _keyed(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text", *more)


def suffix_entries(docs: DataFrame, kind: Symbols, batches: int) -> DataFrame:
    """The sparse suffix entries of docs (ENTRY), and the batch that each document is in."""
    names = [f.split()[0] for f in f"{ENTRY}, batch int".split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                got = [(entries(_raw(t.as_py()), kind), i) for i, t in enumerate(part.column(2))]
                got = [x for x in got if x[0]]
                if not got:
                    continue
                row = pa.array(np.repeat([i for _, i in got], [len(e[0]) for e, _ in got]))
                key, ctx, lo, hi = (np.concatenate([e[c] for e, _ in got]) for c in range(4))
                cols = [pa.array(key.view(np.int64)), pa.array(ctx.view(np.int64)), part.column(0).take(row), part.column(1).take(row), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), part.column(3).take(row)]
                yield pa.RecordBatch.from_arrays(cols, names)
        pa.default_memory_pool().release_unused()  # workers stay for later stages

    dealt = F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).cast("int").alias("batch")
    return _keyed(docs, dealt).mapInArrow(run, f"{ENTRY}, batch int")


class SuffixFamily:
    """Suffix arrays of all batches so far, as bucketed tables of sizes 1, 2, 4, ... batches."""

    def __init__(self, spark: SparkSession, buckets: int | None = None) -> None:
        self.spark = spark
        self.buckets = buckets or partitions(spark)
        self.levels: list[tuple[int, str, str]] = []  # size, table, path
        self.found: list[str] = []

    def _save(self, keys: DataFrame) -> tuple[str, str]:
        """keys (key, n), summed up, as a sorted table."""
        name, path = f"terrane_suffixes_{uuid.uuid4().hex}", scratch(self.spark, "suffixes")
        dealt = keys.groupBy("key").agg(F.sum("n").alias("n")).repartition(self.buckets, "key").sortWithinPartitions("key")
        dealt.write.option("path", path).option("compression", "zstd").bucketBy(self.buckets, "key").sortBy("key").saveAsTable(name)
        return name, path

    def add(self, entries_: DataFrame) -> None:
        """Index a batch and keep the keys that are in it twice, or in it and in an older level."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (n, a, at_a), (m, b, at_b) = self.levels.pop(), self.levels.pop()
            name, path = self._save(self.spark.table(b).unionByName(self.spark.table(a)))
            self._drop((a, at_a), (b, at_b))
            self.levels.append((n + m, name, path))
        name, path = self._save(entries_.select("key", F.lit(1).cast("long").alias("n")))
        new = self.spark.table(name)
        twice = [new.where("n > 1").select("key"), *(new.select("key").join(self.spark.table(level).select("key"), "key", "left_semi") for _, level, _ in self.levels)]
        for keys in twice:
            self.found.append(scratch(self.spark, "twice"))
            keys.write.option("compression", "zstd").parquet(self.found[-1])
        self.levels.append((1, name, path))

    def _drop(self, *tables: tuple[str, str]) -> None:
        for name, path in tables:
            self.spark.sql(f"drop table if exists {name}")
            forget(self.spark, path)

    def repeated_keys(self) -> DataFrame:
        return self.spark.read.schema("key long").parquet(*self.found).distinct()

    def close(self) -> None:
        self._drop(*[(name, path) for _, name, path in self.levels])
        forget(self.spark, *self.found)
        self.levels, self.found = [], []


def repeated_entries(docs: DataFrame, kind: Symbols, batches: int | None = None) -> DataFrame:
    """The entries (ENTRY) whose key is there twice."""
    spark = docs.sparkSession
    bounded_batches(spark)
    batches = batches or min(MOST_BATCHES, max(1, ceil(docs.count() / BATCH_ROWS)))
    path, family = scratch(spark, "entries"), SuffixFamily(spark)
    suffix_entries(docs, kind, batches).write.option("compression", "zstd").partitionBy("batch").parquet(path)
    all_ = spark.read.schema(f"{ENTRY}, batch int").parquet(path)
    for k in range(batches):
        family.add(all_.where(F.col("batch") == k))
    hits = stored(all_.drop("batch").join(family.repeated_keys(), "key", "left_semi"), "hits")
    family.close()
    forget(spark, path)
    return hits


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, packed: the text's bytes under zstd, which halves what a shuffle of texts writes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(3)
        for b in batches:
            packed = pa.array([z.compress(_raw(t.as_py())) for t in b.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), packed], ["doc_id", "text_key", "packed"])

    return _keyed(docs).mapInArrow(run, "doc_id long, text_key long, packed binary")


def _contexts(wanted: DataFrame, docs: DataFrame, kind: Symbols) -> DataFrame:
    """wanted (key, ctx, n_same, n_ctx, doc_id, text_key, lo, hi) with body, the symbols of each context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        for b in batches:
            data = [kind.of(z.decompress(p.as_py())) for p in b.column(0)]
            rows = [(k, c, n, m, data[i][lo : hi + kind.length].tobytes()) for i, spans in enumerate(b.column(1).to_pylist()) for k, c, n, m, lo, hi in (s.values() for s in spans)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["key", "ctx", "n_same", "n_ctx", "body"])

    per_doc = wanted.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("key", "ctx", "n_same", "n_ctx", "lo", "hi")).alias("spans"))
    texts = _packed(rows_in(docs, wanted)).groupBy("doc_id", "text_key").agg(F.first("packed").alias("packed"))
    on = texts["doc_id"].eqNullSafe(per_doc["doc_id"]) & (texts["text_key"] == per_doc["text_key"])
    return texts.join(per_doc, on).select("packed", "spans").mapInArrow(run, "key long, ctx long, n_same long, n_ctx long, body binary")


def _window_pairs(body: bytes, kind: Symbols) -> tuple[np.ndarray, np.ndarray]:
    data = _symbols(body, kind)
    return rolling(2).grams(data, kind.length), rolling(3).grams(data, kind.length)


def _symbols(body: bytes, kind: Symbols) -> np.ndarray:
    return np.frombuffer(body, np.uint32 if kind.words else np.uint8)


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """[from, to) of each run of true values."""
    edge = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _within_keys(bodies: DataFrame, kind: Symbols) -> DataFrame:
    """Repeated windows of contexts, (key, ctx, from, to) counted from a context's first window; a key at a time."""

    def resolve(group: list[tuple]) -> list[tuple]:
        """One hash of a window will do here: the group's key, an independent one, agrees already."""
        hashes = [rolling(2).grams(_symbols(g[4], kind), kind.length) for g in group]
        sizes = [len(h) for h in hashes]
        every = np.concatenate(hashes)
        times = np.repeat(np.array([min(g[2], 2) for g in group], np.int8), sizes)
        repeated, slices = np.zeros(len(every), bool), np.uint64(len(every) // SLICE + 1)
        for r in range(int(slices)):  # equal windows fall into one slice
            at = np.flatnonzero(every % slices == np.uint64(r))
            _, number = np.unique(every[at], return_inverse=True)
            repeated[at] = (np.bincount(number, times[at]) > 1)[number]
        return [(g[0], g[1], a, b) for g, flags in zip(group, np.split(repeated, np.cumsum(sizes)[:-1]), strict=True) for a, b in _runs(flags)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for b in batches:
            rows: list[tuple] = []
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if group and r[0] != group[0][0]:
                    rows += resolve(group)
                    group = []
                group.append(r)
            if rows:
                yield _span_batch(rows)
        if group and (rows := resolve(group)):
            yield _span_batch(rows)

    return bodies.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key long, ctx long, from int, to int")


def _span_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["key", "ctx", "from", "to"])


def _by_windows(bodies: DataFrame, kind: Symbols) -> DataFrame:
    """The same for keys of very many contexts: each window is a row, counted by a shuffle on its hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 64):
                part = b.slice(k, 64)
                pairs = [_window_pairs(x.as_py(), kind) for x in part.column(4)]
                if not pairs:
                    continue
                n = [len(p[0]) for p in pairs]
                row = pa.array(np.repeat(np.arange(len(n)), n))
                at = np.concatenate([np.arange(x, dtype=np.int32) for x in n])
                cols = [part.column(0).take(row), part.column(1).take(row), part.column(2).take(row), pa.array(at), *(pa.array(np.concatenate([p[i] for p in pairs]).view(np.int64)) for i in (0, 1))]
                yield pa.RecordBatch.from_arrays(cols, ["key", "ctx", "n_same", "from", "a", "b"])

    windows = bodies.mapInArrow(run, "key long, ctx long, n_same long, from int, a long, b long")
    repeated = windows.groupBy("a", "b").agg(F.sum("n_same").alias("n")).where("n > 1")
    return windows.join(repeated, ["a", "b"], "left_semi").select("key", "ctx", "from", (F.col("from") + 1).alias("to"))


def repeated_spans(docs: DataFrame, kind: Symbols = BYTES, batches: int | None = None) -> DataFrame:
    """doc_id, text_key, spans: [from, to) in symbols of what is repeated, possibly overlapping, for texts that have any."""
    hits = repeated_entries(docs, kind, batches)
    one = F.first(F.struct("doc_id", "text_key", "lo", "hi")).alias("one")
    ctxs = stored(hits.groupBy("key", "ctx").agg(F.count("*").alias("n_same"), one), "ctxs")
    keys = ctxs.groupBy("key").agg(F.count("*").alias("n_ctx"), F.min("n_same").alias("least")).where("n_ctx > 1 and least = 1")
    wanted = stored(ctxs.join(keys.select("key", "n_ctx"), "key").select("key", "ctx", "n_same", "n_ctx", "one.*"), "wanted")
    bodies = stored(_contexts(wanted, docs, kind), "contexts")
    parts = _within_keys(bodies.where(F.col("n_ctx") <= MOST_CONTEXTS), kind)
    parts = parts.unionByName(_by_windows(bodies.where(F.col("n_ctx") > MOST_CONTEXTS), kind))
    some = parts.groupBy("key", "ctx").agg(F.collect_list(F.struct("from", "to")).alias("runs"))
    whole = ctxs.where("n_same > 1").select("key", "ctx", F.lit(None).cast(SPANS).alias("runs"))
    some = some.join(whole.select("key", "ctx"), ["key", "ctx"], "left_anti")
    runs = F.coalesce("runs", F.array(F.struct(F.lit(0).alias("from"), (F.col("hi") - F.col("lo") + 1).alias("to"))))
    resolved = stored(whole.unionByName(some), "resolved")  # read from files, so that a hot context's entries can be split
    shifted = F.transform(runs, lambda r: F.struct((F.col("lo") + r["from"]).alias("from"), (F.col("lo") + r["to"] - 1 + kind.length).alias("to")))
    marked = hits.join(resolved, ["key", "ctx"]).select("doc_id", "text_key", shifted.alias("spans"))
    return marked.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_set("spans")).alias("spans"))  # a set: repeated rows say the same


def cut(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(what stays, bytes removed, maximal removed runs)."""
    if not spans:
        return raw, 0, 0
    edge = np.zeros(len(raw) + 1, np.int32)
    np.add.at(edge, [a for a, _ in spans], 1)
    np.add.at(edge, [b for _, b in spans], -1)
    gone = np.cumsum(edge[:-1]) > 0
    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
    return kept, int(gone.sum()), len(_runs(gone))


def _with_spans(docs: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of docs that have no spans, and those that have, as row (a struct) beside them: only their texts are shuffled."""
    spans = stored(spans, "spans")
    rows = rows_in(docs, spans).select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), text_key().alias("key"))
    on = rows["id"].eqNullSafe(spans["doc_id"]) & (rows["key"] == spans["text_key"])
    return rows_in(docs, spans, "left_anti"), rows.join(spans, on).drop("id", "key", "doc_id", "text_key")


def _joined(spans: DataFrame, passages: DataFrame) -> DataFrame:
    """doc_id, text_key, spans and passages, either of which may be null."""
    none = F.lit(None).cast(SPANS)
    both = spans.select("doc_id", "text_key", "spans", none.alias("passages")).unionByName(passages.select("doc_id", "text_key", none.alias("spans"), F.col("spans").alias("passages")))
    return both.groupBy("doc_id", "text_key").agg(F.first("spans", True).alias("spans"), F.first("passages", True).alias("passages"))


def remove_repeats(docs: DataFrame, kind: Symbols = BYTES, batches: int | None = None, passages: Symbols | None = None) -> DataFrame:
    """Per row of docs: doc_id, kept (bytes), n_bytes, n_removed, n_spans, n_passage.

    n_passage is the number of the text's bytes that stand in repeats of another kind (passages), which stay; 0 without one.
    """
    spans = repeated_spans(docs, kind, batches)
    spans = _joined(spans, repeated_spans(docs, passages, batches) if passages else spans.limit(0))
    clean, hit = _with_spans(docs.select("doc_id", "text"), spans)
    counts = ("n_bytes", "n_removed", "n_spans", "n_passage")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                kept, n = [], []
                for t, s, p in zip(*(part.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                    raw = _raw(t)
                    left, removed, runs = cut(raw, byte_spans(raw, s or [], kind))
                    kept.append(left)
                    n.append((len(raw), removed, runs, cut(raw, byte_spans(raw, p or [], passages))[1] if passages else 0))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in zip(*n, strict=True))], ["doc_id", "kept", *counts])

    doc_id, raw, none = F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary"), F.lit(0).cast("long")
    cut_rows = hit.select(F.col("row.doc_id").cast("long").alias("doc_id"), "row.text", "spans", "passages").mapInArrow(run, "doc_id long, kept binary, " + ", ".join(f"{c} long" for c in counts))
    return cut_rows.unionByName(clean.select(doc_id, raw.alias("kept"), F.octet_length(raw).cast("long").alias("n_bytes"), *[none.alias(c) for c in counts[1:]]))


def without_repeats(docs: DataFrame, kind: Symbols = BYTES, batches: int | None = None) -> DataFrame:
    """docs with repeats cut out of the text (and n_chars, where there is one, counted again in rows that were cut).

    A character of which some bytes went is dropped whole. Rows that had a text and lose all of it are dropped.
    """
    clean, hit = _with_spans(docs, repeated_spans(docs, kind, batches))
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                rows = zip(part.column(at).to_pylist(), part.column(len(names)).to_pylist(), strict=True)
                texts = [cut(raw := _raw(t), byte_spans(raw, s, kind))[0].decode("utf-8", "ignore") for t, s in rows]
                cols = [pa.array(texts, pa.string()) if i == at else part.column(i) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays(cols, names).filter(pa.array([bool(t) for t in texts]))

    flat = hit.select(*[F.col("row")[c].alias(c) for c in names], F.col("spans").alias("spans of symbols"))
    out = flat.mapInArrow(run, docs.schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.unionByName(clean)
