"""Vector bin packing of documents into training sequences.

A piece of a document asks for three things at once: tokens, one segment, and
loss-bearing tokens.  A sequence has a limit on each.  Sequences are filled one
after the other: of all pieces that fit the room left, the one with the largest
dot product of its demand and that room, both as parts of the limits, goes in.

Every task packs the documents it reads, in windows of ``WINDOW`` documents, so
nothing is shuffled and a lost task packs the same rows again.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Generator, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallbook.llm.common import lean, pick, ship_package, table, text_or_empty
from stallbook.llm.tokens import BATCH_BYTES, WordIds, tokenizer_path, words_of

MAX_TOKENS = 2048
MAX_SEGMENTS = 256
#: Documents that are packed together; bounds the memory of a task.
WINDOW = 4096
#: Room that may stay empty before another document is cut to fill it.
SLACK = 16
END_ID = 1

PIECES = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, loss_tokens long, "
    "sequence_id long, offset long"
)
_GONE = np.iinfo(np.int64).max


class Sequences:
    """Packs (length, loss-bearing tail) pairs.

    ``packed`` yields one list per sequence, of (document, start, length).
    """

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int, slack: int):
        if min(max_tokens, max_segments, max_loss) < 1:
            raise ValueError("limits must be positive")
        self.limits = (max_tokens, max_segments, max_loss)
        self.slack = slack

    def packed(self, lengths: np.ndarray, tails: np.ndarray) -> Iterator[list[tuple[int, int, int]]]:
        max_tokens, max_segments, max_loss = self.limits
        start = np.zeros(len(lengths), dtype=np.int64)
        tokens, loss = lengths.astype(np.int64), tails.astype(np.int64)
        for i in np.flatnonzero((tokens >= max_tokens) | (loss > max_loss)):
            while tokens[i] >= max_tokens or loss[i] > max_loss:
                size = self._head(tokens[i], loss[i], max_tokens, max_loss)
                yield from self._closed([(int(i), int(start[i]), size)], size)
                self._take(i, size, start, tokens, loss)
        if max_loss == max_tokens and np.array_equal(tokens, loss):
            yield from self._longest_first(tokens, start)
            return
        tokens[tokens == 0] = _GONE
        left = int((tokens < _GONE).sum())
        while left:
            room, segments, loss_room = max_tokens, max_segments, max_loss
            held: list[tuple[int, int, int]] = []
            while segments:
                fits = (tokens <= room) & (loss <= loss_room)
                dot = np.where(fits, tokens * (room / max_tokens**2) + loss * (loss_room / max_loss**2), -1.0)
                best = int(dot.argmax()) if left else 0
                if not left or dot[best] < 0:
                    break
                size = int(tokens[best])
                held.append((best, int(start[best]), size))
                room, segments, loss_room = room - size, segments - 1, loss_room - int(loss[best])
                tokens[best] = _GONE
                left -= 1
            if left and room > self.slack and segments:
                # nothing fits whole: the piece with the largest dot product is cut
                dot = np.where(tokens < _GONE, np.minimum(tokens, room) + np.minimum(loss, loss_room), -1)
                best = int(dot.argmax())
                size = self._head(tokens[best], loss[best], room, loss_room)
                if 0 < size < tokens[best]:
                    held.append((best, int(start[best]), size))
                    self._take(best, size, start, tokens, loss)
                    room -= size
            yield from self._closed(held, max_tokens - room)

    def _longest_first(self, tokens: np.ndarray, start: np.ndarray) -> Iterator[list[tuple[int, int, int]]]:
        """The same where every token bears loss: the largest dot product is that of the longest
        piece that fits, of equal ones the first, so a sorted list finds it."""
        max_tokens, max_segments, _ = self.limits
        begins = start.tolist()
        waiting = sorted((n, -i) for i, n in enumerate(tokens.tolist()) if n)
        held_back = {-i: n for n, i in waiting}
        first = 0
        while waiting:
            room, segments = max_tokens, max_segments
            held: list[tuple[int, int, int]] = []
            while segments and room and (at := bisect_left(waiting, (room + 1, -len(tokens)))):
                size, i = waiting.pop(at - 1)
                del held_back[-i]
                held.append((-i, begins[-i], size))
                room, segments = room - size, segments - 1
            if waiting and room > self.slack and segments:
                # nothing fits whole: the first piece is cut
                while first not in held_back:
                    first += 1
                waiting.pop(bisect_left(waiting, (held_back[first], -first)))
                held.append((first, begins[first], room))
                begins[first] += room
                held_back[first] -= room
                insort(waiting, (held_back[first], -first))
                room = 0
            yield from self._closed(held, max_tokens - room)

    @staticmethod
    def _head(tokens: int, loss: int, room: int, loss_room: int) -> int:
        """The longest head that fits; the loss-bearing tokens are the last."""
        return int(min(tokens, room, tokens - loss + loss_room))

    @staticmethod
    def _take(i: int, size: int, start: np.ndarray, tokens: np.ndarray, loss: np.ndarray) -> None:
        start[i] += size
        tokens[i] -= size
        loss[i] = min(loss[i], tokens[i])

    def _closed(self, held: list[tuple[int, int, int]], size: int) -> Iterator[list[tuple[int, int, int]]]:
        """The sequence itself if it is about full; else its pieces, in order,
        as sequences whose lengths are the powers of two that add up to it."""
        if self.limits[0] - size <= self.slack or size & (size - 1) == 0:
            yield held
            return
        want, out = 1 << (size.bit_length() - 1), []
        for i, start, length in held:
            while length:
                part = min(length, want)
                out.append((i, start, part))
                start, length, want, size = start + part, length - part, want - part, size - part
                if not want:
                    yield out
                    want, out = 1 << (size.bit_length() - 1) if size else 0, []


def pack(
    documents: DataFrame,
    tokenizer: str | None = None,
    max_tokens: int = MAX_TOKENS,
    max_segments: int = MAX_SEGMENTS,
    max_loss: int | None = None,
    loss_column: str | None = None,
    slack: int = SLACK,
    memory: int | None = None,
) -> DataFrame:
    """Pieces of all documents (``doc_id``, ``text``) and their places.

    ``loss_column`` says how many of a document's last ids bear loss (null: all;
    clipped to its ids); without it all do.  A document is its ids and one end
    id, so null and empty texts are one id long.  Every id lies in exactly one
    piece; ``ids`` holds them as little-endian unsigned 32-bit numbers.  A sequence
    leaves at most ``slack`` of its tokens empty, or its length is a power of two;
    what would be a shorter last sequence is dealt into such ones.

    ``memory`` bounds the bytes of words that a worker remembers (``tokens.CACHE_BYTES``);
    fewer take more time and give the same pieces.

    Rows may repeat or have a null ``doc_id``: each is packed by itself.  Ties go
    to the row that was read first.  Further columns are ignored; an empty table
    gives no pieces.
    """
    ship_package(documents.sparkSession)
    path = tokenizer or tokenizer_path()
    rule = Sequences(max_tokens, max_segments, max_loss or max_tokens, slack)

    def window(first: int, held: list) -> Generator[pa.RecordBatch, None, int]:
        lengths = np.array([len(ids) for _, ids, _ in held])
        tails = np.array([len(ids) if t is None else min(max(t, 0), len(ids)) for _, ids, t in held])
        rows: list[tuple] = []
        sequence = first
        for pieces in rule.packed(lengths, tails):
            offset = 0
            for i, start, length in pieces:
                doc, ids, _ = held[i]
                bears = min(length, max(0, start + length - (len(ids) - int(tails[i]))))
                rows.append((doc, start, length, ids[start : start + length].tobytes(), len(ids), bears, sequence, offset))
                offset += length
            sequence += 1
            if len(rows) >= 1024:
                yield as_batch(rows)
                rows = []
        if rows:
            yield as_batch(rows)
        return sequence

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in PIECES.split(", ")]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(path, False, memory)
        sequence = TaskContext.get().partitionId() << 33
        held: list[tuple] = []
        size = 0
        for batch in batches:
            docs, texts, tails = (batch.column(c) for c in range(3))
            for doc, found, tail in zip(docs, _ids(words, texts), tails):
                ids = np.append(found, np.uint32(END_ID))
                held.append((doc.as_py(), ids, tail.as_py()))
                size += len(ids)
                if len(held) >= WINDOW or size >= WINDOW * max_tokens:
                    sequence = yield from window(sequence, held)
                    held, size = [], 0
        if held:
            yield from window(sequence, held)

    tail = F.col(f"`{loss_column}`").cast("long") if loss_column else F.lit(None).cast("long")
    source = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), tail.alias("tail")
    )
    return source.mapInArrow(lean(run), PIECES)


def _ids(words: WordIds, texts: pa.StringArray) -> Iterator[np.ndarray]:
    """The ids of every text, encoded about a megabyte at a time."""
    some, size = [], 0
    for text in texts:
        some.append(text.as_py())
        size += len(some[-1])
        if size >= BATCH_BYTES:
            yield from words.ids_of(some)
            some, size = [], 0
    if some:
        yield from words.ids_of(some)


def op1_vector_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens, with the CRC of each
    piece's ids."""
    return digest(pack(pick(table(spark, folder, "documents"), ["doc_id", "text"])))


def digest(packed: DataFrame) -> DataFrame:
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "loss_tokens",
        "sequence_id", "offset",
    )
