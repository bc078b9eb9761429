"""Near copies: SimHash proposes, an exact comparison decides, and a prefix join finds what 64 bits cannot show.

Texts link where the Jaccard similarity of their 5-word shingles is 4/5 or more; every pair of that similarity is found.
At that bound fingerprints differ in ten of 64 bits on average, which no index over them can search at scale, so the
Gray-ordered index of ``simhash`` at its 3 bits, here over 5-word fingerprints, finds the close copies, and a second
source of candidates is needed. Shingles stand in one global order, those that a sample of the texts shows to be
frequent last, the most frequent one at the very end. Two sets of similarity 4/5 overlap in 4/5 of the larger one at
least, so their first n - ceil(4n/5) + 1 shingles have one in common (the sample only sets the order, any order is
exact). Texts that share such a shingle are candidates, if enough shingles follow it on both sides and bit sketches,
which bound the difference from below, allow it. A candidate pair links when its whole sets, compared, meet the bound.

Candidates are compared in two rounds, so that a group of copies does not cost its square: each text with the hub of its
shingle's group, the one that shares most of its prefix, which an edited copy's original does; then, where a group is
not yet one component, the texts outside its main component with the others. Texts that share rare shingles and are just
below the bound do cost pairs.

Edge cases: words are those of ``simhash``; fewer than five words are one shingle; null and empty texts are equal; equal
sets are one entry however many documents have them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.operators.components import components

from . import simhash
from .common import bounded_batches, forget, kept_by, rows_in, scratch, stored, text_key

WORDS = 5
LEAST = (4, 5)  # the similarity from which texts link, as a fraction
SKETCH = 1024  # bits at least, and of a mark
SAMPLE, SEEN, MOST_FREQUENT = 8_000, 3, 50_000


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """The distinct hashes of a text's n-word shingles, ascending."""
    return np.unique(simhash.shingle_hashes(text, n).view(np.int64))


def set_key(found: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


def prefix(found: np.ndarray, frequent: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, int]:
    """The shingles of which one at least is also in the prefix of every set that is similar enough, and how many are rare.

    frequent is ascending; places are the frequent ones' places in the order, after all others.
    """
    up, down = LEAST
    most = len(found) - -(-up * len(found) // down) + 1
    if not len(frequent):
        return found[:most], min(most, len(found))
    at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
    often = frequent[at] == found
    rare = found[~often][:most]
    rest = found[often][np.argsort(places[at[often]])][: most - len(rare)]
    return np.concatenate([rare, rest]), len(rare)


def sketch(found: np.ndarray) -> bytes:
    """About a bit for each shingle, the parity of those that fall on it: two sets differ in as many shingles at least as bits."""
    bits = SKETCH << max(0, (len(found) - 1) // SKETCH).bit_length()
    odd = np.bincount((found.view(np.uint64) >> np.uint64(32)).astype(np.int64) % bits, minlength=bits) % 2
    return np.packbits(odd.astype(np.uint8)).tobytes()


def apart(one: bytes, other: bytes) -> int:
    """The bits in which two sketches differ; the longer one is folded to the shorter one's length."""
    a, b = (np.frombuffer(x, np.uint64) for x in (one, other))
    n = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(x.reshape(-1, n), axis=0) for x in (a, b))
    return int(np.unpackbits((a ^ b).view(np.uint8)).sum())


def mark(sketched: bytes) -> list[int]:
    """A sketch folded to SKETCH bits, as 64-bit numbers."""
    return np.bitwise_xor.reduce(np.frombuffer(sketched, np.int64).reshape(-1, SKETCH // 64), axis=0).tolist()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    up, down = LEAST
    both = len(np.intersect1d(a, b, assume_unique=True))
    return down * both >= up * (len(a) + len(b) - both)


def _frequent(docs: DataFrame) -> np.ndarray:
    """Shingles that a sample of about SAMPLE texts shows to be frequent, MOST_FREQUENT at most; the most frequent one first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("near_copies")
        for b in batches:
            for t in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t.as_py()))], ["gram"])

    share = max(1, docs.count() // SAMPLE)
    some = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0).distinct()
    grams = some.mapInArrow(run, "gram long").groupBy("gram").count().where(F.col("count") >= SEEN)
    return grams.orderBy(F.desc("count"), "gram").limit(MOST_FREQUENT).select("gram").toArrow()["gram"].to_numpy()


def shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, set_key, fp, n, and for the first of equal sets in a task: prefix, n_rare (of it), mark, sketch (where it is longer)."""
    by_count = _frequent(docs)
    order = np.argsort(by_count)
    frequent, places = by_count[order], len(order) - order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("near_copies")
        seen: set[int] = set()
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                hashes = [simhash.shingle_hashes(t.as_py(), WORDS) for t in part.column(2)]
                found = [np.unique(h.view(np.int64)) for h in hashes]
                keys = [set_key(f) for f in found]
                new = [key not in seen and not seen.add(key) for key in keys]
                heads, rare = zip(*(prefix(f, frequent, places) if is_new else (f[:0], 0) for f, is_new in zip(found, new, strict=True)), strict=True)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, heads)]), pa.int32()), pa.array(np.concatenate(heads)))
                drawn = [sketch(f) if is_new else None for f, is_new in zip(found, new, strict=True)]
                marks = pa.array([None if x is None else mark(x) for x in drawn], pa.list_(pa.int64()))
                sketches = pa.array([x if x and len(x) * 8 > SKETCH else None for x in drawn], pa.binary())
                cols = [pa.array(keys, pa.int64()), pa.array([simhash.majority(h) for h in hashes], pa.int64()), pa.array(list(map(len, found)), pa.int32()), lists, pa.array(rare, pa.int32()), marks, sketches]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *cols], ["doc_id", "text_key", "set_key", "fp", "n", "prefix", "n_rare", "mark", "sketch"])
        pa.default_memory_pool().release_unused()  # workers stay for later stages

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text")
    return cols.mapInArrow(run, "doc_id long, text_key long, set_key long, fp long, n int, prefix array<long>, n_rare int, mark array<long>, sketch binary")


def shared_grams(rows: DataFrame) -> DataFrame:
    """gram, set_key, n, rest (shingles from gram on) of prefix shingles that several sets have.

    Frequent ones are known to be shared and stay where they are. The others are sorted by shingle and told by their
    neighbours, a batch at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("near_copies")
        held, told = None, False  # the last row, whose shingle may come again; whether it was given out
        for b in batches:
            cols = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held or [np.zeros(0, np.int64)] * 3, b.columns, strict=True)]
            if not len(cols[0]):
                continue
            new = np.r_[True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])]
            cols = [c[new] for c in cols]
            same = cols[0][1:] == cols[0][:-1]
            shared = np.r_[False, same] | np.r_[same, False]
            give = shared.copy()
            give[0] &= not told
            told = bool(shared[-1]) or (told and len(shared) == 1)
            held = [c[-1:] for c in cols]
            yield pa.RecordBatch.from_arrays([pa.array(c[give]) for c in cols], ["gram", "set_key", "size"])

    grams = rows.select("set_key", "n", "n_rare", F.posexplode("prefix").alias("pos", "gram"))
    sized = (F.shiftleft(F.col("n").cast("long"), 32) + F.col("n") - F.col("pos")).alias("size")
    rare = grams.where("pos < n_rare").select("gram", "set_key", sized)
    told = rare.repartition("gram").sortWithinPartitions("gram", "set_key").mapInArrow(run, "gram long, set_key long, size long")
    both = told.unionByName(grams.where("pos >= n_rare").select("gram", "set_key", sized).distinct())
    return both.select("gram", "set_key", F.shiftright("size", 32).cast("int").alias("n"), F.col("size").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("rest"))


def _whole_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """set_key, grams (bytes of the sorted shingles) of the texts in wanted (doc_id, text_key, one for each set).

    Rows that repeat one of these texts give its set once a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("near_copies")
        seen: set[int] = set()
        for b in batches:
            for k in range(0, b.num_rows, 256):
                found = {set_key(f): f for f in (shingles(t.as_py()) for t in b.column(0).slice(k, 256))}
                new = {key: f.tobytes() for key, f in found.items() if key not in seen}
                seen.update(new)
                yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.int64()), pa.array(list(new.values()), pa.binary())], ["set_key", "grams"])

    return rows_in(docs, wanted).select("text").mapInArrow(run, "set_key long, grams binary")


def _confirmed(pairs: DataFrame, docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """Edges (u, v) of the pairs (a, b) that are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("near_copies")
        for b in batches:
            pairs = ([np.frombuffer(x.as_py(), np.int64) for x in p] for p in zip(b.column(2), b.column(3), strict=True))
            yield b.select(["u", "v"]).filter(pa.array([similar(*p) for p in pairs], pa.bool_()))

    nodes = pairs.select(F.explode(F.array("a", "b")).alias("set_key")).distinct()
    path = scratch(docs.sparkSession, "sets")
    sets = stored(_whole_sets(docs, distinct.join(nodes, "set_key", "left_semi")), "sets", path)
    first, second = sets.select(F.col("set_key").alias("u"), F.col("grams").alias("left")), sets.select(F.col("set_key").alias("v"), F.col("grams").alias("right"))
    both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).join(first, "u").join(second, "v").select("u", "v", "left", "right")
    edges = stored(both.mapInArrow(run, "u long, v long"), "edges")
    forget(docs.sparkSession, path)
    return edges


def _near(n: str, rest: str, m: str, other_rest: str) -> Column:
    """Sets of n and m shingles can be similar enough if a shingle is their first common one, from which rest stand on each side."""
    up, down = LEAST
    return F.least(rest, other_rest).cast("long") * (up + down) >= (F.col(n).cast("long") + F.col(m)) * up


def _near_marks(n: str, one: str, m: str, other: str) -> Column:
    """Marks that sets of n and m shingles can have if they are similar enough: these differ in 1/9 of n + m at most."""
    up, down = LEAST
    bits = sum((F.bit_count(F.col(one)[k].bitwiseXOR(F.col(other)[k])) for k in range(SKETCH // 64)), F.lit(0))
    return bits * (up + down) <= (F.col(n).cast("long") + F.col(m)) * (down - up)


def _allowed(pairs: DataFrame, distinct: DataFrame) -> DataFrame:
    """The distinct pairs (a, b), in either order, whose sizes, marks and sketches allow the similarity."""
    up, down = LEAST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("near_copies")
        for b in batches:
            rows = ([x.as_py() for x in r] for r in zip(*(b.column(k) for k in range(2, 6)), strict=True))
            near = [not (x and y) or apart(x, y) * (up + down) <= (n + m) * (down - up) for n, m, x, y in rows]
            yield b.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    pairs = pairs.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda *names: distinct.select(*[F.col(c).alias(n) for c, n in zip(("set_key", "n", "mark", "sketch"), names, strict=True)])
    both = pairs.join(side("a", "n", "mark", "one"), "a").join(side("b", "m", "other_mark", "other"), "b")
    near = both.where((F.least("n", "m") * down >= F.greatest("n", "m") * up) & _near_marks("n", "mark", "m", "other_mark"))
    return near.select("a", "b", "n", "m", "one", "other").mapInArrow(run, "a long, b long")


def _proposed(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets whose fingerprints are equal or are linked by the Gray-ordered index."""
    fps = stored(distinct.groupBy("fp").agg(F.min("set_key").alias("a")), "proposed")
    links = simhash.links(fps.select("fp"))
    far = links.join(fps.select(F.col("fp").alias("u"), "a"), "u").join(fps.select(F.col("fp").alias("v"), F.col("a").alias("b")), "v").select("a", "b")
    return far.unionByName(distinct.select("fp", F.col("set_key").alias("b")).join(fps, "fp").where("a != b").select("a", "b"))


def _by_hubs(shared: DataFrame) -> DataFrame:
    """Pairs (a, b): each set with the hub of a shingle's group, the set that shares most of its prefix."""
    up, down = LEAST
    most = F.col("n") - F.ceil(F.col("n") * up / down) + 1
    share = shared.groupBy("set_key").agg((F.count("*") / F.first(most)).alias("share"))
    ranked = shared.join(share, "set_key")
    hubs = ranked.groupBy("gram").agg(F.min(F.struct(-F.col("share"), "set_key", "n", "rest")).alias("hub"))
    stars = shared.join(hubs.select("gram", F.col("hub.set_key").alias("a"), F.col("hub.n").alias("m"), F.col("hub.rest").alias("other_rest")), "gram")
    return stars.where((F.col("set_key") != F.col("a")) & _near("n", "rest", "m", "other_rest")).select("a", F.col("set_key").alias("b"))


def _across(shared: DataFrame, labels: DataFrame, distinct: DataFrame) -> DataFrame:
    """Allowed pairs (a, b) of different components that share a shingle: those outside its group's main component with all others."""
    named = shared.join(labels, "set_key", "left").select("gram", "set_key", "n", "rest", F.coalesce("label", "set_key").alias("label"))
    sizes = named.groupBy("gram", "label").agg(F.count("*").alias("members"))
    main = sizes.groupBy("gram").agg(F.max_by("label", F.struct("members", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1")
    named = stored(named.join(main.select("gram", "main"), "gram").join(distinct.select("set_key", "mark"), "set_key"), "open")
    other = named.select("gram", F.col("set_key").alias("b"), F.col("n").alias("m"), F.col("rest").alias("other_rest"), F.col("label").alias("other"), F.col("mark").alias("other_mark"))
    met = named.where("label != main").join(other, "gram")
    return _allowed(met.where((F.col("label") != F.col("other")) & _near("n", "rest", "m", "other_rest") & _near_marks("n", "mark", "m", "other_mark")).select(F.col("set_key").alias("a"), "b"), distinct)


def links(docs: DataFrame, distinct: DataFrame, shared: DataFrame) -> DataFrame:
    """Edges (u, v) of set keys that connect all sets that a chain of similar ones joins."""
    stars = stored(_allowed(_by_hubs(shared).unionByName(_proposed(distinct)), distinct), "stars")
    edges = _confirmed(stars, docs, distinct)
    labels = components(edges).withColumnRenamed("node", "set_key").withColumnRenamed("root", "label")
    pairs = stored(_across(shared, labels, distinct).join(stars, ["a", "b"], "left_anti"), "pairs")
    return edges.unionByName(_confirmed(pairs, docs, distinct))


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, set_key, component_id: the smallest doc_id that links reach."""
    spark = docs.sparkSession
    bounded_batches(spark)
    path = scratch(spark, "shingles")
    rows = stored(shingle_sets(docs), "shingles", path)
    firsts = rows.where("mark is not null").groupBy("set_key").agg(*[F.min_by(c, F.struct("doc_id", "text_key")).alias(c) for c in ("doc_id", "text_key")], F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("mark").alias("mark"), F.first("sketch").alias("sketch"))
    distinct, shared, keys = stored(firsts, "distinct"), stored(shared_grams(rows), "shared"), stored(rows.select("doc_id", "text_key", "set_key"), "set-keys")
    forget(spark, path)
    comp = components(links(docs, distinct, shared)).withColumnRenamed("node", "set_key")
    named = keys.join(comp, "set_key", "left").withColumn("root", F.coalesce("root", "set_key"))
    firsts = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return named.join(firsts, "root").select("doc_id", "text_key", "set_key", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without near copies: of each component the row of the smallest doc_id (then smallest text_key) stays."""
    return simhash.first_of_each(docs, near_copies(docs))
