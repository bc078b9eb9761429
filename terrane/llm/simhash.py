"""SimHash near-duplicates through a Gray-ordered hierarchical index.

A fingerprint has a bit set where over half of the XXH64 hashes (seed 42) of a text's 3-word shingles have it. Two
fingerprints link at 3 or fewer differing bits.

The 64 bits are cut into five blocks. Fingerprints that differ in at most 3 bits agree on two blocks at least, so each
distinct fingerprint goes to ten groups, one for each pair of blocks; equal fingerprints are one entry however many
documents have them. Within a group entries stand in Gray order, which puts similar codes side by side. Runs of entries
form nodes, runs of nodes upper nodes; each node factors out the bits that all below it share, as a mask and a pattern.
A search goes down from the top, adds up differences on the bits that each level newly shares, and drops a node with
all below it when they exceed the limit. It also drops nodes whose entries are already linked to the entry searched
for, so a dense cluster costs a few passes, not its square. What a task finds leaves it as a spanning forest.

Edge cases: a null or empty text has fingerprint 0; fewer than three words are one shingle; a null doc_id is kept but
never names a component unless the component has no other (then it is null); repeated rows stay separate rows; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.operators.components import components

from .common import rows_in, stored, text_key, words

MOST_BITS = 3
SHINGLE = 3  # words
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
FANOUT = 8
MOST_PAIRS = 1 << 20
ONES = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def shingle_hashes(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """XXH64 (seed 42) of a text's n-word shingles, repeats included; fewer words are one shingle, none are none."""
    ws, hash64 = words(text), xxhash.xxh64_intdigest
    if not ws:
        return np.zeros(0, np.uint64)
    hs = [hash64(b" ".join(t), 42) for t in zip(*(ws[i:] for i in range(n)), strict=False)] if len(ws) >= n else [hash64(b" ".join(ws), 42)]
    return np.array(hs, np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have, as a signed number."""
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        octets = hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes)).view("<i8")[0])


def fingerprint(text: str | None) -> int:
    return majority(shingle_hashes(text))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (a hash of the text, to tell rows of one doc_id apart), fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64())], ["doc_id", "text_key", "fp"])

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text")
    return cols.mapInArrow(run, "doc_id long, text_key long, fp long")


def popcount(x: np.ndarray) -> np.ndarray:
    return ONES[x.view(np.uint16).reshape(len(x), 4)].sum(axis=1, dtype=np.uint8)


def gray_rank(fp: Column) -> Column:
    """Where a code stands in the Gray sequence: the exclusive or of all its higher bits, by doubling."""
    for s in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, s))
    return fp


class GrayIndex:
    """The index over entries that stand in order of (group, Gray rank); groups are the topmost nodes."""

    def __init__(self, group: np.ndarray, codes: np.ndarray) -> None:
        self.codes, n = codes, len(codes)
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        sizes = np.diff(np.r_[starts, n])
        first = np.repeat(starts, sizes)
        self.end = np.repeat(starts + sizes, sizes)
        place, span, most = np.arange(n) - first, 1, int(sizes.max())
        self.spans = []
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # number of each entry's node; mask, pattern
        while True:
            begins = np.flatnonzero(place % span == 0)
            both, any_ = np.bitwise_and.reduceat(codes, begins), np.bitwise_or.reduceat(codes, begins)
            mask = ~(both ^ any_)
            self.levels.append((begins, mask, both & mask))
            self.spans.append(span)
            if span >= most:
                break
            span *= FANOUT
        self.place, self.label = place, np.arange(n)

    def node_of(self, level: int, entry: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.levels[level][0], entry, "right") - 1

    def uniform(self, level: int) -> np.ndarray:
        """The label that all entries of each node have, or -1."""
        begins = self.levels[level][0]
        low, high = np.minimum.reduceat(self.label, begins), np.maximum.reduceat(self.label, begins)
        return np.where(low == high, low, -1)

    def search(self, queries: np.ndarray, same: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray] | None:
        """(query, entry) pairs within reach, entries after their query; None if a level held too many pairs."""
        top = len(self.levels) - 1
        q, node = queries, self.node_of(top, queries)
        seen, acc = np.zeros(len(q), np.uint64), np.zeros(len(q), np.uint8)
        for level in range(top, -1, -1):
            begins, mask, pattern = self.levels[level]
            acc = acc + popcount((self.codes[q] ^ pattern[node]) & mask[node] & ~seen)
            last = np.minimum(begins[node] + self.spans[level], self.end[begins[node]])
            keep = (acc <= MOST_BITS) & (last > q + 1) & (same[level][node] != self.label[q])
            q, node, acc, last = q[keep], node[keep], acc[keep], last[keep]
            seen = mask[node]
            if level == 0:
                return q, begins[node]
            below = self.spans[level - 1]
            low = begins[node]
            count = -(-(last - low) // below)
            if count.sum() > MOST_PAIRS and len(queries) > 1:
                return None
            child = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            node = self.node_of(level - 1, np.repeat(low, count) + child * below)
            q, acc, seen = np.repeat(q, count), np.repeat(acc, count), np.repeat(seen, count)
        raise AssertionError

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the components of a and b: hook the larger label to the smaller one and follow, until all agree."""
        while True:
            x, y = self.label[a], self.label[b]
            if not (x != y).any():
                return
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while (up := self.label[self.label]).tobytes() != self.label.tobytes():
                self.label = up

    def forest(self) -> np.ndarray:
        """The label of each entry: the first entry of its component."""
        n, at, step = len(self.codes), 0, 64
        sized = self.end - (np.arange(n) - self.place)
        todo = np.flatnonzero((sized > 1) & (np.arange(n) + 1 < self.end))
        same = [self.uniform(k) for k in range(len(self.levels))]
        while at < len(todo):
            found = self.search(todo[at : at + step], same)
            if found is None:
                step = max(1, step // 4)
                continue
            at += step
            step *= 2
            if len(found[0]):
                self.link(*found)
                same = [self.uniform(k) for k in range(len(self.levels))]
        return self.label


def links(distinct: DataFrame) -> DataFrame:
    """Edges (u, v) of fingerprints that connect all that are within reach of each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not got:
            return
        group, codes = (np.concatenate(x) for x in zip(*got, strict=True))
        label = GrayIndex(group, codes.view(np.uint64)).forest()
        linked = np.flatnonzero(label != np.arange(len(label)))
        yield pa.RecordBatch.from_arrays([pa.array(codes[linked]), pa.array(codes[label[linked]])], ["u", "v"])

    part = lambda at, n: F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << n) - 1))
    routes = [F.lit(i << 32).bitwiseOR(F.shiftleft(part(*a), 13)).bitwiseOR(part(*b)) for i, (a, b) in enumerate(combinations(BLOCKS, 2))]
    routed = distinct.select("fp", F.explode(F.array(*routes)).alias("grp"))
    ordered = routed.repartition("grp").sortWithinPartitions("grp", gray_rank(F.col("fp")))
    return ordered.select("grp", "fp").mapInArrow(run, "u long, v long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, fp, component_id: the smallest doc_id that links reach."""
    fps = stored(fingerprints(docs), "fingerprints")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    comp = components(links(distinct)).withColumnRenamed("node", "fp")
    roots = comp.join(distinct, "fp").groupBy("root").agg(F.min("first_id").alias("root_id"))
    named = comp.join(roots, "root").select("fp", "root_id")
    by_fp = distinct.join(named, "fp", "left").select("fp", F.coalesce("root_id", "first_id").alias("component_id"))
    return fps.join(by_fp, "fp").select("doc_id", "text_key", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def first_of_each(docs: DataFrame, components_of: DataFrame) -> DataFrame:
    """The rows of docs that stay: of each component (doc_id, text_key, component_id) that of the smallest doc_id, then smallest text_key.

    Only the keys of rows that go meet the texts. Rows that are equal in doc_id and text are one.
    """
    found = stored(components_of.groupBy("component_id", "doc_id", "text_key").agg(F.count("*").alias("n")), "members")
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    keep = first.groupBy(F.col("component_id").alias("of")).agg(F.min("text_key").alias("keep_key"))
    stays = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_key") == F.col("keep_key"))
    kept = stored(found.join(keep, F.col("component_id").eqNullSafe(F.col("of"))).select("doc_id", "text_key", "n", stays.alias("stays")), "kept")
    once = rows_in(docs, kept.where("not stays or n > 1"), "left_anti")
    several = kept.where("stays and n > 1")
    if several.isEmpty():
        return once
    nested = rows_in(docs, several).select("doc_id", text_key().alias("key"), F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    again = nested.groupBy("doc_id", "key").agg(F.first("row").alias("row")).select(*[F.col("row")[c].alias(c) for c in docs.columns])
    return once.unionByName(again)


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without near-duplicates: of each component the row of the smallest doc_id (then smallest text_key) stays."""
    return first_of_each(docs, near_duplicates(docs))
