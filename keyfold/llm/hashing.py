"""Vectorised word hashing over whole texts, shared by the operators that compare word sequences.

A batch of texts becomes one byte buffer with a line break between texts, so that no word spans
two of them. All hashes are 64 bits, computed from prefix sums of a polynomial in an odd base
(which has an inverse modulo 2**64) and then mixed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BYTE_BASE, _WORD_BASE, _SECOND_BASE = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32

# Bytes hashed at once; a longer text is hashed alone. Hashing takes about forty times as much.
BATCH_BYTES = 1 << 20
# Rows of an Arrow batch that are Python objects at once.
SLICE_ROWS = 512

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base ** i`` and its inverse for every i below ``n``."""
    have = _POWERS.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(n, BATCH_BYTES + 2)
        inverse = U64(pow(int(base), -1, 1 << 64))
        out = []
        for b in (base, inverse):
            steps = np.full(size, b, U64)
            steps[0] = 1
            out.append(np.cumprod(steps, dtype=U64))
        have = _POWERS[int(base)] = (out[0], out[1])
    return have[0][:n], have[1][:n]


def _segment_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    """Hash of ``values[start:end]`` for every pair."""
    power, inverse = _powers(base, len(values) + 1)
    prefix = np.zeros(len(values) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum(values * power[:-1], out=prefix[1:])
        return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(U64))


@dataclass
class Words:
    """The words of a batch of texts: byte ranges in ``data``, hashes, and where each text begins."""

    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # of length texts + 1: words before each text

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words_of(texts: list[str | None], lower: bool = False) -> Words:
    """Split texts at ASCII white space and hash the words; a null text has none."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = b"\n".join(parts) + b"\n"
    raw = np.frombuffer(data, np.uint8)
    gap = _SPACE[raw]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], gap)).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]  # the buffer ends with a break, so every word does end
    begins = np.cumsum([0, *(len(p) + 1 for p in parts)])
    hashes = _segment_hashes((_LOWER[raw] if lower else raw).astype(U64) + U64(1), starts, ends, _BYTE_BASE)
    return Words(data, starts, ends, hashes, np.searchsorted(starts, begins))


def windows_of(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive words, across the texts of a batch."""
    at = np.arange(max(len(hashes) - size + 1, 0))
    return _segment_hashes(hashes, at, at + size, _WORD_BASE)


def second_windows_of(hashes: np.ndarray, size: int, at: np.ndarray) -> np.ndarray:
    """Another hash of the runs of ``size`` words that start at ``at``, independent of ``windows_of``."""
    return _segment_hashes(mix(hashes ^ _SECOND_BASE), at, at + size, _SECOND_BASE)


def sequences_of(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each stated run of words."""
    return _segment_hashes(hashes, starts, ends, _WORD_BASE)


def window_starts(words: Words, size: int) -> np.ndarray:
    """Marks the positions at which a run of ``size`` words lies inside one text."""
    at = np.zeros(max(len(words.hashes) - size + 1, 0), bool)
    if len(at):
        text = np.repeat(np.arange(len(words.first) - 1), words.counts())
        at[:] = text[:len(at)] == text[size - 1:]
    return at


def batches(texts: Iterable[str | None], limit: int = BATCH_BYTES) -> Iterator[tuple[int, list[str | None]]]:
    """Consecutive texts in lists of about ``limit`` bytes, each with the index of its first."""
    held, size, start = [], 0, 0
    for i, t in enumerate(texts):
        if held and size + len(t or "") > limit:
            yield start, held
            held, size, start = [], 0, i
        held.append(t)
        size += len(t or "") + 1
    if held:
        yield start, held


def slices_of(frame: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """An Arrow batch in slices, of which few are held as Python objects at a time."""
    for start in range(0, frame.num_rows, SLICE_ROWS):
        yield frame.slice(start, SLICE_ROWS)


def texts_of(frame: pa.RecordBatch, column: str = "text") -> Iterator[str | None]:
    """The texts of an Arrow batch, slice by slice."""
    for part in slices_of(frame):
        yield from part.column(column).to_pylist()
