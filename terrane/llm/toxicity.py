"""Toxicity by class-conditional Kneser-Ney models.

Two language models over the bytes of words, one of toxic and one of ordinary labelled texts, give each word two
log-likelihoods; a text's evidence is their difference summed over its words and divided by their number. Orders over
SHARED have counts of their own class, lower orders are continuation counts that both classes share, so a rare or new
expression falls back to the same probabilities on both sides and says nothing, while inflected forms of a toxic stem
are recognised by the stem. A logistic curve fitted on labelled texts kept out of the counts turns evidence into a score.

Training rows are a bounded sample: at most COUNT_ROWS rows of each class for the counts and CALIBRATION_ROWS for the
curve, those with the smallest hashes of doc_id. Everything else covers all rows.

Edge cases: a null or empty text has evidence 0 and the curve's score there; rows with a null label or null doc_id teach
nothing; repeated labels of one doc_id count as toxic if any is; with no usable labels of either class every score is 0;
an empty table gives no rows; repeated rows are scored each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fold, kept_by, words

ORDER, SHARED = 6, 2
DISCOUNT = 0.9
COUNT_ROWS, CALIBRATION_ROWS = 6_000, 6_000
MEMO_ENTRIES = 120_000


def grams(ws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER-byte grams of all words as integers, and the word each is of. A word stands between spaces."""
    pad = b" " * (ORDER - 1)
    raw = np.frombuffer(b"".join([pad + w + b" " for w in ws]), np.uint8).astype(np.uint64)
    sizes = np.array([len(w) + ORDER for w in ws])
    ends = np.cumsum(sizes)
    packed = np.zeros(len(raw) - ORDER + 1, np.uint64)
    for k in range(ORDER):
        packed = packed << np.uint64(8) | raw[k : k + len(packed)]
    keep = np.ones(len(raw), bool)
    for k in range(ORDER - 1):  # grams that would start in one word and end in the next
        keep[ends - 1 - k] = False
    keep = keep[: len(packed)]
    return packed[keep], np.repeat(np.arange(len(ws)), sizes - (ORDER - 1))


class KneserNey:
    """Both models: for each order the grams with what each class keeps of them, the contexts with what each leaves."""

    def __init__(self, top: np.ndarray, counts: np.ndarray) -> None:
        """top: distinct grams of the highest order; counts: (grams, 2) of ordinary and toxic texts."""
        self.memo: dict[bytes, float] = {}
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        keys, n = top, counts.astype(np.float64)
        for order in range(ORDER, 0, -1):
            if order == SHARED:
                n = np.repeat(n.sum(axis=1, keepdims=True), 2, axis=1)
            place = np.argsort(keys)
            keys, n = keys[place], n[place]
            ctx, of = np.unique(keys >> np.uint64(8), return_inverse=True)
            total = np.stack([np.bincount(of, n[:, c], len(ctx)) for c in (0, 1)], axis=1)
            kinds = np.stack([np.bincount(of, n[:, c] > 0, len(ctx)) for c in (0, 1)], axis=1)
            safe = np.maximum(total, 1)
            kept = np.maximum(n - DISCOUNT, 0) / safe[of]
            left = np.where(total > 0, DISCOUNT * kinds / safe, 1.0)
            self.levels.append((keys, kept.astype(np.float32), ctx, left.astype(np.float32)))
            low = np.uint64((1 << (8 * (order - 1))) - 1)
            shorter, of = np.unique(keys & low, return_inverse=True)  # continuation counts: distinct bytes before
            n = np.stack([np.bincount(of, n[:, c] > 0, len(shorter)) for c in (0, 1)], axis=1).astype(np.float64)
            keys = shorter
        self.levels.reverse()

    def evidence(self, ws: list[bytes]) -> np.ndarray:
        """Toxic minus ordinary log-likelihood of each word."""
        out = np.zeros(len(ws))
        for k in range(0, len(ws), 20_000):
            part = ws[k : k + 20_000]
            g, word = grams(part)
            p = np.full((len(g), 2), 1 / 256)
            for order, (keys, kept, ctx, left) in enumerate(self.levels, 1):
                key = g & np.uint64((1 << (8 * order)) - 1)
                p *= self._at(ctx, left, key >> np.uint64(8), 1.0)
                p += self._at(keys, kept, key, 0.0)
            out[k : k + len(part)] = np.bincount(word, np.log(p[:, 1]) - np.log(p[:, 0]), len(part))
        return out

    @staticmethod
    def _at(keys: np.ndarray, values: np.ndarray, want: np.ndarray, default: float) -> np.ndarray:
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        return np.where((keys[at] == want)[:, None], values[at], np.float32(default))


def mean_evidence(texts: list[str | None], model: KneserNey) -> list[float]:
    """Evidence of each text; what is known of words stays with the worker's copy of the model, up to MEMO_ENTRIES."""
    memo = model.memo
    split = [words(t) for t in texts]
    new = list({w for ws in split for w in ws if w not in memo})
    found = dict(zip(new, model.evidence(new).tolist(), strict=True)) if new else {}
    if len(memo) < MEMO_ENTRIES:
        memo.update(found)
        return [sum(map(memo.__getitem__, ws)) / max(1, len(ws)) for ws in split]
    return [sum([memo[w] if w in memo else found[w] for w in ws]) / max(1, len(ws)) for ws in split]


def _sample(labels: DataFrame, part, n: int) -> DataFrame:
    return labels.where(part).orderBy(F.xxhash64("lab_id"), "lab_id").limit(n)


def labelled(docs: DataFrame, labels: DataFrame, folds: int) -> tuple[DataFrame, DataFrame]:
    """(toxic, text) for the counts and for the curve, of rows outside fold 0. At most the sample's ids are broadcast."""
    ids = labels.select(F.col("doc_id").cast("long").alias("lab_id"), F.col("toxic").cast("int").alias("toxic")).where("lab_id is not null and toxic in (0, 1)")
    ids = ids.where(fold("lab_id", folds) != 0).groupBy("lab_id").agg(F.max("toxic").alias("toxic"))
    aside = F.pmod(F.xxhash64(F.lit("curve"), "lab_id"), F.lit(4)) == 0
    counts = _sample(ids, ~aside & (F.col("toxic") == 1), COUNT_ROWS).unionByName(_sample(ids, ~aside & (F.col("toxic") == 0), COUNT_ROWS))
    text = docs.select(F.col("doc_id").cast("long").alias("lab_id"), "text")
    return tuple(text.join(F.broadcast(s), "lab_id").select("toxic", "text") for s in (counts, _sample(ids, aside, CALIBRATION_ROWS)))


def gram_counts(rows: DataFrame) -> DataFrame:
    """gram, toxic, n of labelled rows (toxic, text), combined before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("toxicity")
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for b in batches:
            for t, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen[t].update(words(text))
        for t in (0, 1):
            if seen[t]:
                g, word = grams(list(seen[t]))
                keys, of = np.unique(g, return_inverse=True)
                n = np.bincount(of, np.array(list(seen[t].values()))[word]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), t, np.int32)), pa.array(n)], ["gram", "toxic", "n"])

    return rows.mapInArrow(run, "gram long, toxic int, n long").groupBy("gram").pivot("toxic", [0, 1]).agg(F.sum("n"))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton's method, with a little ridge for separable classes."""
    scale = x.std() or 1.0
    a = np.stack([x / scale, np.ones(len(x))], axis=1)
    w, ridge = np.zeros(2), np.diag([1e-2, 1e-6])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (y - p) - ridge @ w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5):
    """(model, slope, intercept), or None where a class has no labelled row.

    The driver sees the distinct grams of at most 2 * COUNT_ROWS texts and broadcasts about 30 bytes for each.
    """
    bounded_batches(docs.sparkSession)
    counting, calibrating = labelled(docs, labels, folds)
    got = gram_counts(counting).na.fill(0).toArrow()
    counts = np.stack([got[c].to_numpy() for c in ("0", "1")], axis=1)
    if not len(got) or (counts.sum(axis=0) == 0).any():
        return None
    model = KneserNey(got["gram"].to_numpy().view(np.uint64), counts)
    del got, counts
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("toxicity")
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(mean_evidence(b.column(1).to_pylist(), shared.value))], ["toxic", "evidence"])

    curve = calibrating.mapInArrow(run, "toxic int, evidence double").toArrow()
    slope, shift = logistic(curve["evidence"].to_numpy(), curve["toxic"].to_numpy()) if len(curve) else (1.0, 0.0)
    return shared, slope, shift


def scores(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """doc_id, text_key, held_out, score of every row of docs."""
    fitted = fit(docs, labels, folds)
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), (fold("doc_id", folds) == 0).alias("held_out"), "text")
    if fitted is None:
        return cols.select("doc_id", "text_key", "held_out", F.lit(0.0).alias("score"))
    shared, slope, shift = fitted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("toxicity")
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                x = np.array(mean_evidence(part.column(3).to_pylist(), shared.value))
                score = 1 / (1 + np.exp(-np.clip(slope * x + shift, -700, 700)))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(score)], ["doc_id", "text_key", "held_out", "score"])

    return cols.mapInArrow(run, "doc_id long, text_key long, held_out boolean, score double")


def without_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """The rows of docs that score under limit, with all their columns."""
    fitted = fit(docs, labels)
    if fitted is None:
        return docs
    shared, slope, shift = fitted
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("toxicity")
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                x = np.array(mean_evidence(part.column(at).to_pylist(), shared.value))
                yield part.filter(pa.array(1 / (1 + np.exp(-np.clip(slope * x + shift, -700, 700))) < limit))

    return docs.mapInArrow(run, docs.schema)
