"""Packing by minimum bin slack: each window takes the multiset of remaining lengths that fills it best.

Every task packs the documents of its own partition as they stream by, so nothing
is shuffled, nothing reaches the driver and a lost task is simply run again. A
task holds a pool of remainders (``pool_tokens`` at most, plus one document).

Rules:

* A document is its ids followed by the end id; a null or empty text is the end id alone.
* What is longer than a window is cut into whole windows from its start; the
  remainder goes to the pool.
* A window takes the longest remainder and then, by a bitset subset-sum dynamic
  program over the pool's lengths and their counts, the multiset that comes closest
  to the window's size. The counts are found by backtracking through the bitsets.
* Where the best multiset leaves more than ``max_slack`` tokens free, the longest
  remainder left is cut to fill the window.
* The last tokens of a partition fill sequences whose lengths are powers of two.

Ties: of equal lengths the document that came first is taken first. Repeated rows
and repeated or null ids are packed as documents of their own. An empty table
gives an empty table. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from canopyloom.llm.pieces import PieceEncoder

#: Pieces that a worker remembers, and characters encoded at once. Workers stay for
#: the stages that follow, beside the JVM, so what they hold on to is kept small.
MEMO, CHARS = 300_000, 1 << 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def best_fill(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """The (length, count) pairs within ``counts`` whose sum is largest, ``capacity`` at most."""
    goal, mask, reach = 1 << capacity, (1 << (capacity + 1)) - 1, 1
    trail: list[tuple[int, int, int]] = []
    for length in sorted((n for n in counts if n <= capacity), reverse=True):
        left, k = min(counts[length], capacity // length), 1
        while left:
            k = min(k, left)
            trail.append((length, k, reach))
            reach = (reach | reach << length * k) & mask
            left -= k
            k *= 2
        if reach & goal:
            break
    total, taken = reach.bit_length() - 1, {}
    for length, k, before in reversed(trail):
        if not before >> total & 1:
            total -= length * k
            taken[length] = taken.get(length, 0) + k
    return list(taken.items())


@dataclass
class Piece:
    doc_id: int | None
    start: int
    ids: np.ndarray
    of: int  # tokens of its document


class Packer:
    """Takes documents, gives rows of SCHEMA."""

    def __init__(self, window: int, max_slack: int, pool_tokens: int, first_id: int):
        self.window, self.max_slack, self.most, self.next_id = window, max_slack, pool_tokens, first_id
        self.pool: dict[int, deque[Piece]] = {}
        self.held = 0

    def add(self, doc_id, ids: np.ndarray) -> Iterator[list[Piece]]:
        at, n = 0, len(ids)
        while n - at > self.window:
            yield [Piece(doc_id, at, ids[at : at + self.window], n)]
            at += self.window
        self._hold(Piece(doc_id, at, ids[at:], n))
        if self.held > self.most:
            while self.held > self.most // 2:
                yield self._fill(self.window)

    def finish(self) -> Iterator[list[Piece]]:
        while self.held:
            size = self.window
            while size > self.held:
                size = size // 2 if size & (size - 1) == 0 else 1 << (size.bit_length() - 1)
            yield self._fill(size, exact=size < self.window or self.held < 2 * size)

    def _hold(self, piece: Piece, first: bool = False) -> None:
        queue = self.pool.setdefault(len(piece.ids), deque())
        (queue.appendleft if first else queue.append)(piece)
        self.held += len(piece.ids)

    def _take(self, length: int) -> Piece:
        piece = self.pool[length].popleft()
        if not self.pool[length]:
            del self.pool[length]
        self.held -= length
        return piece

    def _fill(self, size: int, exact: bool = False) -> list[Piece]:
        longest = max(self.pool)
        out, free = [], size
        if longest <= size:
            out.append(self._take(longest))
            free -= longest
        for length, k in best_fill({n: len(q) for n, q in self.pool.items()}, free):
            out += [self._take(length) for _ in range(k)]
            free -= length * k
        if free > (0 if exact else self.max_slack) and self.held:
            piece = self._take(max(self.pool))  # longer than what is free, or it would have been taken
            out.append(Piece(piece.doc_id, piece.start, piece.ids[:free], piece.of))
            self._hold(Piece(piece.doc_id, piece.start + free, piece.ids[free:], piece.of), first=True)
        return out

    def rows(self, sequence: list[Piece]) -> Iterator[tuple]:
        at = 0
        for p in sequence:
            yield p.doc_id, p.start, len(p.ids), zlib.crc32(p.ids.astype("<u4").tobytes()), p.of, self.next_id, at
            at += len(p.ids)
        self.next_id += 1


def coded(tokenizer: str, texts) -> tuple[PieceEncoder, Iterator[np.ndarray]]:
    """The worker's encoder and, for one text after the other, an array of its ids."""
    from canopyloom.llm.pieces import encoder

    codec = encoder(tokenizer, MEMO)
    return codec, codec.stream(texts, CHARS, lean=True)


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 2,
    window: int = 4096,
    max_slack: int = 8,
    pool_tokens: int = 2_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row of SCHEMA for each piece of each document.

    ``sequence_id`` is the partition's number times 2**32 plus a number from 0.
    ``ids_crc32`` is over the piece's ids as little-endian unsigned 32-bit integers.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from canopyloom.llm.pieces import arrow, columns

        packer, rows = Packer(window, max_slack, pool_tokens, TaskContext.get().partitionId() << 32), []
        keys: deque = deque()

        def texts():
            for k, t in columns(batches):
                keys.append(k)
                yield t

        def frame():
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
            return arrow(out.astype({"doc_id": "Int64"}), SCHEMA)

        codec, stream = coded(tokenizer, texts())
        end = np.array([end_id], codec.dtype if end_id <= np.iinfo(codec.dtype).max else np.dtype("<u4"))
        for ids in stream:
            for sequence in packer.add(keys.popleft(), np.concatenate([ids, end])):
                rows += packer.rows(sequence)
            if len(rows) > 20_000:
                yield frame()
                rows = []
        for sequence in packer.finish():
            rows += packer.rows(sequence)
        yield frame()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(task, SCHEMA)
