"""Texts as rows of numbered words: what operators over word sequences write once and read in every pass.

A task turns its texts into batches of about BATCH_WORDS words, each a row: the batch's distinct words, and one number for
each word of its texts. Batches are written down, so that their numbers hold whatever executor reads them later.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BATCH_WORDS = 2_000_000


class Batch(NamedTuple):
    """One row: the texts of one part (a language, say), as numbers of the words that the list holds."""

    batch: int
    part: str
    doc_ids: list[int | None]
    sizes: np.ndarray
    words: list[bytes]
    ids: np.ndarray


class _Open:
    def __init__(self) -> None:
        self.number: dict[bytes, int] = defaultdict(count().__next__)
        self.texts: list[np.ndarray] = []
        self.doc_ids: list[int | None] = []
        self.n = 0

    def add(self, doc_id: int | None, words: list[bytes]) -> None:
        self.texts.append(np.fromiter(map(self.number.__getitem__, words), np.int32, len(words)))
        self.doc_ids.append(doc_id)
        self.n += len(words)

    def close(self, batch: int, part: str) -> Batch:
        sizes = np.array([len(t) for t in self.texts], np.int64)
        return Batch(batch, part, self.doc_ids, sizes, list(self.number), np.concatenate(self.texts))


def packed(rows: Iterator[pa.RecordBatch], split: Callable[[bytes], list[bytes]], batch_words: int = BATCH_WORDS) -> Iterator[Batch]:
    """The batches of a task whose rows are (doc_id, part, text); what is open holds batch_words words and one text at most."""
    from pyspark import TaskContext

    made, open_ = count(TaskContext.get().partitionId() << 32), defaultdict(_Open)
    for b in rows:
        for doc_id, part, text in zip(*b.columns, strict=True):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            open_[part.as_py()].add(doc_id.as_py(), split(raw))
            if sum(o.n for o in open_.values()) >= batch_words:
                fullest = max(open_, key=lambda k: open_[k].n)
                yield open_.pop(fullest).close(next(made), fullest)
    for part, o in open_.items():
        yield o.close(next(made), part)
    pa.default_memory_pool().release_unused()
