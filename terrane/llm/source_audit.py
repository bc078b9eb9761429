"""How the sources of a language differ: a divergence for each pair of sources, and the terms that mark a source.

A source's share of a term, smoothed by 2 and scaled to a billion, is p = 1 + floor(SCALE * (count + 2) / (N + 2 * V)); the
divergence of two shares is floor((p - q)^2 / (p + q)). All of it is integer arithmetic.

Terms are counted once: a task adds up what its texts hold before anything is shuffled, and one shuffle by (lang, term)
serves the counts by source, the number of documents and the vectors. A term's column is the sparse vector of its counts
by source. Most terms are rare and many have equal vectors, so vectors are grouped, and every pair of sources is evaluated
once for each distinct vector and multiplied by the number of its terms. Where a source has no count its share is the same
for all terms; with z for such a share, a pair's sum over all V terms is

    V f(zi, zj) + sum over terms of i (f(pi, zj) - f(zi, zj)) + the same for j + sum over terms of both (f(pi, pj) - f(pi, zj) - f(zi, pj) + f(zi, zj))

so only counts above zero are visited. Distinct vectors of a lang are dealt over tasks (SALT_ROWS each), and sources over
blocks of BLOCK; each task returns sums by pair, and no task sees all terms or more than BLOCK rows of pairs. The marks of
a source are ranked over the original terms.

Edge cases: a null text, lang or source is ''; a group without terms has N = 0; with V = 0 every pair's value is 0; a lang
with one source has no pairs; equal rows are documents of their own; other columns take no part; an empty table gives no
rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, stored

LEAST_DOCS, TOP_TERMS, SCALE = 10, 10, 1_000_000_000
SALT_ROWS, BLOCK, PAIRS_AT_ONCE = 50_000, 256, 1 << 20
HELD_TERMS = 300_000  # that a task holds before it hands on its counts
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))
COUNTS = "lang string, source string, term string, n long, docs long"
PARTIAL = "lang string, source string, item string, value long"


def counted(docs: DataFrame) -> DataFrame:
    """COUNTS by task: how often a term occurs in the texts of a lang and source, and in how many of them."""
    names = [f.split()[0] for f in COUNTS.split(", ")]

    def handed(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in held.items():
            values = np.array(list(terms.values()), np.int64).reshape(-1, 2)
            same = [pa.array([x] * len(terms), pa.string()) for x in (lang, source)]
            columns = [*same, pa.array(list(terms), pa.binary()).cast(pa.string()), pa.array(values[:, 0]), pa.array(values[:, 1])]
            yield pa.RecordBatch.from_arrays(columns, names)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, dict[bytes, list[int]]] = defaultdict(dict)
        n = 0
        for b in rows:
            for lang, source, text in zip(*b.columns, strict=True):
                terms, of_text = held[lang.as_py(), source.as_py()], defaultdict(int)
                for w in text.as_buffer().to_pybytes().translate(LETTERS).split():
                    of_text[w] += 1
                before = len(terms)
                for w, k in of_text.items():
                    got = terms.get(w)
                    if got is None:
                        terms[w] = [k, 1]
                    else:
                        got[0] += k
                        got[1] += 1
                n += len(terms) - before
                if n > HELD_TERMS:
                    yield from handed(held)
                    held.clear()
                    n = 0
        yield from handed(held)
        pa.default_memory_pool().release_unused()

    return docs.select("lang", "source", "text").mapInArrow(run, COUNTS)


def shares(n: np.ndarray, size: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (n + 2) / size), exact for sizes below 9e17: long division, a decimal digit at a time."""
    size = np.maximum(size, 1)
    whole, rest = np.divmod(n + 2, size)
    for _ in range(len(str(SCALE)) - 1):
        digit, rest = np.divmod(rest * 10, size)
        whole = whole * 10 + digit
    return whole + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def pair_sums(counts: list[np.ndarray], sources: list[np.ndarray], times: np.ndarray, size: np.ndarray, block: slice) -> tuple[np.ndarray, np.ndarray]:
    """For sources of the block (rows) and all sources (columns): the formula's sum over terms of i, and that over terms of both."""
    zero = shares(np.zeros(len(size), np.int64), size)
    alone, both = (np.zeros((block.stop - block.start, len(size)), np.int64) for _ in range(2))
    lens = np.array([len(c) for c in counts], np.int64)
    if not lens.sum():
        return alone, both
    n, s = np.concatenate(counts), np.concatenate(sources)
    first, width, many = np.repeat(np.cumsum(lens) - lens, lens), np.repeat(lens, lens), np.repeat(times, lens)
    p = shares(n, size[s])
    mine = np.flatnonzero((s >= block.start) & (s < block.stop))
    order = mine[np.lexsort((p[mine], s[mine]))]  # a source's equal shares are one row
    edge = np.flatnonzero(np.r_[True, (s[order][1:] != s[order][:-1]) | (p[order][1:] != p[order][:-1])]) if len(order) else order
    total = np.add.reduceat(many[order], edge) if len(order) else edge
    step = max(1, PAIRS_AT_ONCE // len(size))
    for k in range(0, len(edge), step):
        e = order[edge[k : k + step]]
        np.add.at(alone, s[e] - block.start, total[k : k + step, None] * (divergence(p[e][:, None], zero[None, :]) - divergence(zero[s[e]][:, None], zero[None, :])))
    upto = np.cumsum(width[mine])
    k = 0
    while k < len(mine):  # entries whose partners, the other counts of their vector, make up PAIRS_AT_ONCE
        stop = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + PAIRS_AT_ONCE, "right")))
        a = np.repeat(mine[k:stop], width[mine[k:stop]])
        starts = np.cumsum(width[mine[k:stop]]) - width[mine[k:stop]]
        b = first[a] + np.arange(len(a)) - np.repeat(starts, width[mine[k:stop]])
        zi, zj = zero[s[a]], zero[s[b]]
        more = divergence(p[a], p[b]) - divergence(p[a], zj) - divergence(zi, p[b]) + divergence(zi, zj)
        np.add.at(both, (s[a] - block.start, s[b]), many[a] * more)
        k = stop
    return alone, both


def _pairs(vectors: DataFrame, groups: DataFrame) -> DataFrame:
    """PARTIAL sums for both directions of every pair; vectors: lang, vector, times; groups: lang, source, total, v, n_sources."""
    salts = max(1, ceil(vectors.count() / SALT_ROWS))
    blocks = F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n_sources") / BLOCK) - 1).cast("int")))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        lang, salt, block = (right[c][0].as_py() for c in ("lang", "salt", "block"))
        right = right.take(np.argsort(np.array([x.encode() for x in right["source"].to_pylist()], object), kind="stable"))
        names, v = right["source"].combine_chunks(), right["v"][0].as_py()
        place = {x: i for i, x in enumerate(names.to_pylist())}
        size = right["total"].to_numpy() + 2 * v
        part = slice(block * BLOCK, min((block + 1) * BLOCK, len(size)))
        rows = left["vector"].to_pylist()
        counts = [np.array([e["n"] for e in r], np.int64) for r in rows]
        sources = [np.array([place[e["source"]] for e in r], np.int64) for r in rows]
        alone, both = pair_sums(counts, sources, left["times"].to_numpy(), size, part)
        if salt == 0 and v:
            zero = shares(np.zeros(len(size), np.int64), size)
            both += v * divergence(zero[part, None], zero[None, :])
        i, j = np.nonzero((alone != 0) | (both != 0) | (salt == 0))
        keep = i + part.start != j
        i, j = i[keep], j[keep]
        a, b = names.take(pa.array(i + part.start)), names.take(pa.array(j))
        langs = pa.array([lang] * (2 * len(i)), pa.string())
        # what both have is found again from the other end, what one has is not
        return pa.table({"lang": langs, "source": pa.concat_arrays([a, b]), "item": pa.concat_arrays([b, a]), "value": np.r_[alone[i, j] + both[i, j], alone[i, j]]})

    dealt = vectors.withColumn("salt", F.pmod(F.xxhash64("vector"), F.lit(salts)).cast("int"))
    here = groups.select("lang", "n_sources").distinct().select("lang", blocks.alias("block"))
    dealt = dealt.join(here, "lang")
    known = groups.withColumn("block", blocks).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    keys = ("lang", "salt", "block")
    return dealt.groupBy(*keys).cogroup(known.groupBy(*keys)).applyInArrow(run, PARTIAL)


def _share(n: str, size: str):
    """The share of a count as an exact expression."""
    return F.expr(f"1 + (cast({n} + 2 as decimal(20,0)) * cast({SCALE} as decimal(10,0))) div cast({size} as decimal(20,0))")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part (pair or term), item (another source, or a term), value, rank."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    by_source = counted(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    vector = F.sort_array(F.collect_list(F.struct("source", "n"))).alias("vector")
    terms = stored(by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_lang"), vector).where(F.col("docs") >= least_docs), "terms")

    entries = terms.select("lang", "term", "n_lang", F.explode("vector").alias("e")).select("lang", "term", "n_lang", "e.*")
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("total_lang"))
    groups = docs.groupBy("lang", "source").agg(F.count("*").alias("docs")).drop("docs").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    many = Window.partitionBy("lang")
    groups = stored(groups.select("lang", "source", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total", "v", "total_lang")), F.count("*").over(many).alias("n_sources")), "groups")

    vectors = stored(terms.groupBy("lang", "vector").agg(F.count("*").alias("times")), "vectors")
    pairs = _pairs(vectors, groups).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    marks = entries.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), _share("n", "total + 2 * v").alias("p"), _share("n_lang", "total_lang + 2 * v").alias("q"))
    marks = marks.where("p > q").select("lang", "source", "item", F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows, part: rows.withColumn("rank", F.row_number().over(best)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return ranked(pairs, "pair").unionByName(ranked(marks, "term").where(F.col("rank") <= top))
