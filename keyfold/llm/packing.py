"""Pack tokenised documents into windows by minimum bin slack.

Whole windows are cut from long documents; what remains of each document is shorter than a window
and waits in a pool. A window takes the longest remainder, and a subset-sum table in the bits of
one integer tells which totals the other lengths can reach beside it; backtracking through the
table gives how many pieces of each length to take. The same multiset serves as many windows as
the pool has pieces for. Where no multiset closes a window, one piece is cut to fill the slack.

Each task packs the documents of its own partition as they stream by, so nothing is shuffled, and
memory holds one pool. Only the last window of a partition can stay short.

Cases: a null or empty text still has its end token; repeated rows, and rows without an id, are
packed each for itself; a document of any length is cut, and its ids are in memory at once; other
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.llm.hashing import slices_of
from keyfold.llm.tokenizing import CACHE_ENTRIES, encoder_of, read_tokenizer

WINDOW = 4096
END_TOKEN = 2
# Remainders that wait in a task's pool; below the lower number no more windows are filled until
# the partition ends, so that lengths to choose from are left.
POOL, POOL_LOW = 4096, 1024

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long")


def fill(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """The multiset of lengths, with the largest among them, whose total comes closest to capacity.

    Returns (length, how many). The bits of ``reach`` are the totals that can be reached; a count is
    taken in parts of 1, 2, 4, ... pieces, and the table before each part is kept for backtracking.
    """
    lengths = sorted(counts, reverse=True)
    seed = lengths[0]
    room = capacity - seed
    mask, full, reach, steps = (1 << room + 1) - 1, 1 << room, 1, []
    for length in lengths:
        left = min(counts[length] - (length == seed), room // length)
        part = 1
        while left > 0 and not reach & full:
            take = min(part, left)
            steps.append((length, take, reach))
            reach |= (reach << length * take) & mask
            left -= take
            part *= 2
        if reach & full:
            break
    total = reach.bit_length() - 1
    chosen: dict[int, int] = defaultdict(int)
    chosen[seed] += 1
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            chosen[length] += take
    return list(chosen.items())


class Packer:
    """Packs the pieces of one partition; ``rows`` gathers what is placed."""

    def __init__(self, window: int, first_sequence: int):
        self.window, self.sequence = window, first_sequence
        self.pool: dict[int, list[tuple[int | None, int, int, bytes]]] = defaultdict(list)
        self.held = 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        tokens = len(ids) // 4
        whole = tokens // self.window * self.window
        for start in range(0, whole, self.window):
            self._place((doc_id, start, tokens, ids[4 * start:4 * (start + self.window)]), 0)
            self.sequence += 1
        if tokens > whole:
            self._hold((doc_id, whole, tokens, ids[4 * whole:]))

    def _hold(self, piece: tuple[int, int, int, bytes]) -> None:
        self.pool[len(piece[3]) // 4].append(piece)
        self.held += 1

    def _take(self, length: int) -> tuple[int, int, int, bytes]:
        pieces = self.pool[length]
        piece = pieces.pop()
        if not pieces:
            del self.pool[length]
        self.held -= 1
        return piece

    def _place(self, piece: tuple[int, int, int, bytes], offset: int) -> int:
        doc_id, start, tokens, ids = piece
        self.rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), tokens, self.sequence, offset))
        return offset + len(ids) // 4

    def pack(self, until: int) -> None:
        """Fill windows until the pool holds no more than ``until`` pieces."""
        while self.held > until:
            chosen = fill({n: len(p) for n, p in self.pool.items()}, self.window)
            for _ in range(min(len(self.pool[n]) // k for n, k in chosen)):
                offset = 0
                for length, k in chosen:
                    for _ in range(k):
                        offset = self._place(self._take(length), offset)
                slack = self.window - offset
                if slack and self.held:
                    # Every piece left is longer than the slack, or the table had taken it.
                    length = min(n for n in self.pool if n > slack)
                    doc_id, start, tokens, ids = self._take(length)
                    self._place((doc_id, start, tokens, ids[:4 * slack]), offset)
                    self._hold((doc_id, start + slack, tokens, ids[4 * slack:]))
                self.sequence += 1
                if any(len(self.pool.get(n, ())) < k for n, k in chosen):
                    break


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_token: int = END_TOKEN,
                   pool: int = POOL, pool_low: int = POOL_LOW, entries: int = CACHE_ENTRIES) -> DataFrame:
    """One row per piece of the documents ``(doc_id, text)``; see ``SCHEMA``.

    ``sequence_id`` holds the partition above 32 bits and the window's number in it below. ``entries`` bounds
    a generation of the encoder's cache.
    """
    tokenizer = read_tokenizer(tokenizer_path)
    end = end_token.to_bytes(4, "little")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer, entries)
        packer = Packer(window, TaskContext.get().partitionId() << 32)

        def placed() -> pa.RecordBatch:
            rows, packer.rows = packer.rows, []
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

        for frame in (p for f in frames for p in slices_of(f)):
            for doc_id, text in zip(frame.column("doc_id").to_pylist(), frame.column("text").to_pylist(), strict=True):
                packer.add(doc_id, encoder.encode(text) + end)
                if packer.held >= pool:
                    packer.pack(pool_low)
            if packer.rows:
                yield placed()
        packer.pack(0)
        if packer.rows:
            yield placed()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)
