"""SentencePiece encoding and decoding by a streaming lattice search.

The piece model at hand is of the byte-pair kind, where the right ids are those of its merges, not those of the largest
sum of scores: a plain sum-of-scores Viterbi gives other ids. The search here keeps Viterbi's form - one best way to
reach each position, a back pointer for it, a window no longer than the longest piece - with another test for a step.
Merging is local: pieces t1 ... tn are the encoding of their concatenation if and only if each neighbouring pair is the
encoding of its own. So each prefix of a text is reached by exactly one piece that agrees with the piece before it, and
the survivors are the back-pointer paths of the last positions. Once they all pass one boundary, the ids before it are
committed and forgotten. The pieces that may end at a position follow from one move for each character: from the
longest end of the text that pieces begin with (its head) and the next character to the next head.

Every text goes through a ``Stream`` in parts. No piece of the model spans certain pairs of characters (anything before
a space mark, a line feed, a letter beside a sign), so all paths converge there: the stream commits at each such place,
and what the search found between two of them is kept as one step for the next time, up to MEMO_ENTRIES. Which of these
places hold is read off the model's pieces. Where none comes, the lattice finds the convergence itself, and the stream
retains a few times the longest piece at most.

Edge cases: a null or empty text has no ids; characters that the model lacks become byte pieces; decoding drops the
space that encoding put in front; bytes that are no UTF-8 decode to U+FFFD; the mark U+2581 itself decodes to a space.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_by

MARK = "▁"
MEMO_ENTRIES, AGREED_ENTRIES, MOVES_ENTRIES = 300_000, 400_000, 200_000  # of steps, of pairs of pieces and of moves, about 200 bytes each, in a worker
PART = 1 << 15  # characters that a stream takes at a time
SHORT = 64  # of a step that is kept, and of text that waits for its end before the lattice takes it


class Lattice:
    """The search over text that comes in parts, between two places that all paths pass."""

    def __init__(self, coder: PieceCoder) -> None:
        self.coder = coder
        self.text, self.last, self.head = "", [""], ""  # text since the last commit; the piece that ends at each position; see move

    def feed(self, part: str, final: bool = False) -> bytes:
        """Take more text and return the ids that are certain by now."""
        c = self.coder
        moves, agreed, longest = c.moves, c.agreed, c.longest
        last, head, done = self.last, self.head, []
        self.text += part
        for k in range(0, len(part), longest):
            for ch in part[k : k + longest]:
                head, ends = moves.get(head + ch) or c.move(head + ch)
                for p in ends:
                    pair = (last[-len(p)], p)
                    if (ok := agreed.get(pair)) or (ok is None and c.agree(*pair)):
                        last.append(p)
                        break
            if len(last) > 4 * longest and (cut := self._meeting()):
                done.append(self._ids(cut))
                self.text, last = self.text[cut:], last[cut:]
                self.last, head = last, c.head(head[max(0, len(head) - len(self.text)) :])  # no piece reaches behind the commit
        self.head = head
        if final:
            done.append(self._ids(len(last) - 1))
            self.text, self.last, self.head = "", [""], ""
        return b"".join(done)

    def _meeting(self) -> int:
        """The boundary that the paths of all positions still open have in common; 0 if they have none."""
        end = len(self.last)
        open_ = set(range(max(0, end - 1 - self.coder.longest), end))
        while len(open_) > 1:
            j = max(open_)
            open_.remove(j)
            open_.add(max(0, j - len(self.last[j])))
        return open_.pop()

    def _ids(self, end: int) -> bytes:
        pieces = []
        while end > 0:
            pieces.append(self.last[end])
            end -= len(self.last[end])
        return b"".join([self.coder.ids_of(p) for p in reversed(pieces)])


class Stream:
    """Ids, as little-endian 32-bit integers, of a text that comes in parts."""

    def __init__(self, coder: PieceCoder) -> None:
        self.coder = coder
        self.rest, self.lattice = MARK, None  # what is not yet committed; an open step that is too long to wait for its end

    def feed(self, part: str, final: bool = False) -> bytes:
        c = self.coder
        text, out = self.rest + part.replace(" ", MARK), []
        if self.lattice:
            n = c.run_on(self.before, text)
            ends = final or n < len(text)
            out.append(self.lattice.feed(text[:n], ends))
            if not ends:
                self.before, self.rest = text[-1:] or self.before, ""
                return out[0]
            text, self.lattice = text[n:], None
        steps = c.segments(text)
        self.rest = "" if final or not steps else steps.pop()
        known = c.memo.get
        out.append(b"".join([known(s) or c.step(s) for s in steps]))
        if len(self.rest) > SHORT:
            self.lattice, self.before = Lattice(c), self.rest[-1]
            out.append(self.lattice.feed(self.rest))
            self.rest = ""
        return b"".join(out)


class PieceCoder:
    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.scores = {self.pieces[i]: sp.get_score(i) for i in plain}
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.heads = {p[:k] for p in self.scores for k in range(1, len(p) + 1)}
        self.longest = max(map(len, self.scores), default=1)
        spans = {p[k : k + 2] for p in self.scores for k in range(len(p) - 1)}
        letter = re.compile(r"[^\W\d_]").match
        free = all(s[1] != MARK or s[0] == MARK for s in spans) and not any("\n" in s for s in spans)
        apart = all(s[0] == MARK or bool(letter(s[0])) == bool(letter(s[1])) for s in spans)
        other = f"(?:(?![{MARK}\n])[\\W\\d_])+"
        cuts = f"{MARK}*[^\\W\\d_]+|{MARK}*{other}|{MARK}+|\n" if apart else f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n"
        self.segments = re.compile(cuts if free else "(?s:.+)").findall
        self.free, self.apart, self.letter = free, apart, letter
        self.shown = ["" if sp.is_control(i) else p for i, p in enumerate(self.pieces)]
        for b, i in self.bytes.items():
            self.shown[i] = chr(b) if b < 0x80 else chr(0xDC00 + b)
        self.packed = {p: np.array(i, "<i4").tobytes() for p, i in self.ids.items()}
        self.agreed: dict[tuple[str, str], bool] = {}
        self.moves: dict[str, tuple[str, tuple[str, ...]]] = {}
        self.memo: dict[str, bytes] = {}

    def merge(self, text: str) -> list[str]:
        """Byte-pair merges of a short string, best score first, leftmost of equals."""
        parts, score = list(text), self.scores.get
        while len(parts) > 1:
            found = [(s, -i) for i in range(len(parts) - 1) if (s := score(parts[i] + parts[i + 1])) is not None]
            if not found:
                break
            i = -max(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def agree(self, a: str, b: str) -> bool:
        """Whether the pieces a, b in a row are what their text merges to; a is empty at the start of a text."""
        known = self.agreed.get((a, b))
        if known is None:
            known = self.merge(a + b) == ([a, b] if a else [b])
            if len(self.agreed) < AGREED_ENTRIES:
                self.agreed[a, b] = known
        return known

    def head(self, text: str) -> str:
        """The longest end of a text that pieces begin with."""
        return next((text[k:] for k in range(len(text)) if text[k:] in self.heads), "")

    def move(self, text: str) -> tuple[str, tuple[str, ...]]:
        """The head of a head and the next character, and the pieces that may end there, the longest first; a character is one in any case."""
        known = self.moves.get(text)
        if known is None:
            head = self.head(text)
            known = head, (*[head[k:] for k in range(len(head) - 1) if head[k:] in self.scores], text[-1])
            if len(self.moves) < MOVES_ENTRIES:
                self.moves[text] = known
        return known

    def ids_of(self, piece: str) -> bytes:
        """The ids of a piece as little-endian 32-bit integers."""
        found = self.packed.get(piece)
        if found is None:
            found = np.array([self.bytes.get(b, self.unknown) for b in piece.encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown], "<i4").tobytes()
        return found

    def run_on(self, before: str, text: str) -> int:
        """How many characters of text belong to the step that ends in before."""
        if not self.free:
            return len(text)
        for i, ch in enumerate(text):
            if ch == "\n" or (before != MARK and (ch == MARK or (self.apart and bool(self.letter(before)) != bool(self.letter(ch))))):
                return i
            before = ch
        return len(text)

    def step(self, segment: str) -> bytes:
        """The ids between two places that all paths pass."""
        ids = self.memo.get(segment)
        if ids is None:
            ids = Lattice(self).feed(segment, True)
            if len(segment) <= SHORT and len(self.memo) < MEMO_ENTRIES:
                self.memo[segment] = ids
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        stream = Stream(self)
        return np.frombuffer(b"".join([stream.feed(text[k : k + PART], k + PART >= len(text)) for k in range(0, len(text), PART)]), "<i4")

    def decode(self, ids: list[int]) -> str:
        text = "".join(map(self.shown.__getitem__, ids))
        if not text.isascii():
            text = text.encode("utf-8", "surrogateescape").decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


def coder(path: str) -> PieceCoder:
    """One coder for each worker process."""
    return kept_by("piece_coding", path, PieceCoder)


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids, n_ids, ids_crc32 and same (whether decoding the ids gives the text back) of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(model)
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                texts = part.column(1).to_pylist()
                ids = [c.encode(t) for t in texts]
                same = [c.decode(i.tolist()) == (t or "").replace(MARK, " ") for i, t in zip(ids, texts, strict=True)]
                sizes = np.array([len(i) for i in ids], np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(np.concatenate(ids)))
                crcs = pa.array([zlib.crc32(i.tobytes()) for i in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(sizes), crcs, pa.array(same)], ["doc_id", "ids", "n_ids", "ids_crc32", "same"])

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return cols.mapInArrow(run, "doc_id long, ids array<int>, n_ids long, ids_crc32 long, same boolean")


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, text of rows with doc_id and ids; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(model)
        for b in batches:
            text = [None if i is None else c.decode(i) for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
