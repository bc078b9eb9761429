"""Token ids as length-delimited binary records with checksums, and an offset index beside each shard.

A shard is a sequence of records:

    uint64 length | uint32 masked crc of the 8 length bytes | payload | uint32 masked crc of the payload

and a payload is ``uint8 has_id | int64 doc_id | uint8 id width (2 or 4) | ids``, all little-endian. The index of a
shard holds the uint64 offset of every record and, last, the file's length, so a reader can fetch records in any order.
The checksum is CRC-32 (zlib), masked by a rotation and a constant so that a checksum of data that holds checksums
stays sound.

Edge cases: a null text is an empty document (the end id only); a null doc_id sorts first and is read back as null;
rows that share a doc_id stay separate records, ordered by a hash of their text; an empty table gives no records; a
control string inside a text (``<|endoftext|>``) becomes its one id, as in the library's plain call.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept_by, partitions, scratch, stored

MEMO_ENTRIES = 600_000
MANIFEST = "shard int, file string, n_records long, n_tokens long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def masked_crc(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


class PieceEncoder:
    """Byte-level BPE through the tokenizers library, one call for each new pre-token.

    The vocabulary's own pre-tokenizer never merges across pre-tokens, so their ids can be kept and reused. The memo is
    bounded: past MEMO_ENTRIES new pre-tokens are encoded without being kept.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.control = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.width = 2 if self.tok.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.find = regex.compile(public_tokenizers.PATTERN).findall
        self.memo: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as bytes. A text that holds a control string of the vocabulary goes through the library whole."""
        odd = {i: t for i, t in enumerate(texts) if t and any(c in t for c in self.control)}
        out = self._split([None if i in odd else t for i, t in enumerate(texts)])
        for i, t in odd.items():
            out[i] = self._one_by_one([t])[t]
        return out

    def _split(self, texts: list[str | None]) -> list[bytes]:
        memo = self.memo
        split = [self.find(t) if t else [] for t in texts]
        new = set(chain.from_iterable(split)).difference(memo)
        plain = [w for w in new if w[0] == " " and w[1:].isalpha()]
        found = self._one_by_one([w for w in new if w[0] != " " or not w[1:].isalpha()])
        for k in range(0, len(plain), 100):
            found |= self._in_a_row(plain[k : k + 100])
        if len(memo) < MEMO_ENTRIES:
            memo.update(found)
            return [b"".join(map(memo.__getitem__, ws)) for ws in split]
        return [b"".join([memo.get(w) or found[w] for w in ws]) for ws in split]

    def _one_by_one(self, ws: list[str]) -> dict[str, bytes]:
        return {w: np.array(e.ids, self.kind).tobytes() for w, e in zip(ws, self.tok.encode_batch_fast(ws, add_special_tokens=False), strict=True)}

    def _in_a_row(self, ws: list[str]) -> dict[str, bytes]:
        """A space and letters, put in a row, are split at the spaces again: one call encodes many pre-tokens."""
        e = self.tok.encode("".join(ws), add_special_tokens=False)
        ids, ends = np.array(e.ids, self.kind).tobytes(), np.flatnonzero(np.diff(e.word_ids)) + 1
        if len(ends) + 1 != len(ws):
            return self._one_by_one(ws)
        cuts = [0, *(ends * self.width).tolist(), len(ids)]
        return {w: ids[i:j] for w, i, j in zip(ws, cuts[:-1], cuts[1:], strict=True)}


def encoder(path: str) -> PieceEncoder:
    """One encoder for each worker process."""
    return kept_by("token_records", path, PieceEncoder)


def frame(doc_id: int | None, ids: bytes, width: int) -> bytes:
    payload = struct.pack("<BqB", doc_id is not None, doc_id or 0, width) + ids
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked_crc(head)), payload, struct.pack("<I", masked_crc(payload))))


def records(stream) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of each record of a shard; raises ValueError where a checksum fails or a record is cut short."""
    while head := stream.read(12):
        if len(head) < 12 or masked_crc(head[:8]) != struct.unpack("<I", head[8:])[0]:
            raise ValueError("damaged record length")
        (n,) = struct.unpack("<Q", head[:8])
        body = stream.read(n + 4)
        if len(body) < n + 4 or masked_crc(body[:n]) != struct.unpack("<I", body[n:])[0]:
            raise ValueError("damaged record payload")
        has_id, doc_id, width = struct.unpack("<BqB", body[:10])
        yield doc_id if has_id else None, np.frombuffer(body, f"<u{width}", (n - 10) // width, 10)


def record_at(base: str, file: str, k: int) -> tuple[int | None, np.ndarray]:
    """The k-th record of a shard, by its index: what a shuffled reader calls."""
    fs, root = FileSystem.from_uri(base)
    with fs.open_input_file(f"{root}/{file}.idx") as f:
        lo, hi = struct.unpack("<QQ", f.read_at(16, 8 * k))
    with fs.open_input_file(f"{root}/{file}") as f:
        return next(records(pa.BufferReader(f.read_at(hi - lo, lo))))


def write_records(docs: DataFrame, base: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and write shards under base, in ascending doc_id order over shards and within each.

    Returns the manifest: shard, file, n_records, n_tokens. Each task attempt writes files of its own name, and only
    the files of attempts that succeeded are in the manifest, so a lost executor or a repeated task does no harm.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, root = FileSystem.from_uri(base)
        fs.create_dir(root, recursive=True)
        enc, shard = encoder(tokenizer), TaskContext.get().partitionId()
        name = f"shard-{shard:06d}-{uuid.uuid4().hex[:12]}"
        end = np.array([end_id], f"<u{enc.width}").tobytes()
        offsets, at, tokens = [0], 0, 0
        with fs.open_output_stream(f"{root}/{name}") as out:
            for b in batches:
                for k in range(0, b.num_rows, 512):
                    part = b.slice(k, 512)
                    encoded = enc.encode(part.column(1).to_pylist())
                    for doc_id, ids in zip(part.column(0).to_pylist(), encoded, strict=True):
                        r = frame(doc_id, ids + end, enc.width)
                        out.write(r)
                        at += len(r)
                        tokens += len(ids) // enc.width + 1
                        offsets.append(at)
        with fs.open_output_stream(f"{root}/{name}.idx") as out:
            out.write(np.array(offsets, "<u8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([name]), pa.array([len(offsets) - 1]), pa.array([tokens])], ["shard", "file", "n_records", "n_tokens"])

    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tie = F.xxhash64("text")
    ordered = ordered.repartitionByRange(partitions(docs.sparkSession), F.col("doc_id").asc_nulls_first(), tie)
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)
    return stored(ordered.mapInArrow(write, MANIFEST), "manifest")


def read_records(manifest: DataFrame, base: str) -> DataFrame:
    """Per record, from the files: doc_id, start (ids of all records before it), n_tokens, ids_crc32.

    The manifest has a row for each shard, so its running total is a list as long as the number of write tasks.
    """
    spark: SparkSession = manifest.sparkSession
    shards, start = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r.shard):
        if r.n_records:
            shards.append((r.file, start))
        start += r.n_tokens

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = FileSystem.from_uri(base)
        for b in batches:
            for file, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                with fs.open_input_stream(f"{root}/{file}", buffer_size=1 << 20) as f:
                    for doc_id, ids in records(f):
                        rows.append((doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        at += len(ids)
                        if len(rows) == 20_000:
                            yield to_batch(rows)
                            rows = []
                if rows:
                    yield to_batch(rows)

    def to_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    todo = spark.createDataFrame(shards, "file string, start long").repartition(max(1, len(shards)))
    return todo.mapInArrow(read, READ)


def token_records(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write docs as token records in the shared folder and read them back."""
    base = scratch(docs.sparkSession, "records")
    return read_records(write_records(docs, base, tokenizer, end_id), base)
