"""Runs of words that repeat with a period, found through a dictionary of basic factors.

A basic factor is a stretch of ``2**k`` words. Level k of the dictionary names every factor of that
length so that equal factors, and no others, share a name; a level is named from pairs of the one
before. Factors that occur once in their document are left out, so on plain prose the levels thin out
at once.

A run of smallest period q repeats, with ``L = 2**k <= q < 2 * L``, some factor of length L at
distance q. From every place, successor occurrences are followed up to twice the factor's length, and
each distance reached proposes a period. Where successors are close (a quarter of L or less) they
form an arithmetic progression whose difference is the factor's own period: only its first members
propose, as a run's period, if larger, is never reached inside such a progression (else the root of
the run would itself be a power). Proposals of neighbouring places are merged, extended to both sides
by binary descent through the levels, and of equal stretches the one with the smallest period stays.

Names are exact, not hashes. Documents are worked on in batches of about a megabyte, inside each
task; nothing is shuffled.

Cases: a null or blank text has no words and no runs; a text of any length is worked on at once, in
about fifteen bytes a word and level that is in use; repeated rows, and rows without an id, count each
for itself; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.llm.hashing import BATCH_BYTES, slices_of

# The least words of a run, and the least times its period.
MIN_WORDS, MIN_TIMES = 12, 2

Rewrite = Callable[[int | None, list[bytes]], list[bytes]]
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


class Factors:
    """The dictionary over ``words``, numbers that are distinct between documents.

    ``names[k][i]`` names the factor of ``2**k`` words at i. A factor that occurs once has a negative
    name of its own. ``occurring[k]`` are the places of the others, by name and place.
    """

    def __init__(self, words: np.ndarray):
        self.size = len(words)
        self.names: list[np.ndarray] = []
        self.occurring: list[tuple[np.ndarray, np.ndarray]] = []
        places, keys = np.arange(self.size), words.astype(np.int64)
        while len(places):
            order = np.argsort(keys, kind="stable")
            places, keys = places[order], keys[order]
            first = np.append(True, keys[1:] != keys[:-1])
            group = np.cumsum(first) - 1
            often = np.bincount(group)[group] > 1
            names = -1 - np.arange(self.size, dtype=np.int32)
            names[places[often]] = group[often]
            self.names.append(names)
            self.occurring.append((places[often], group[often]))
            length = 1 << len(self.names) - 1
            left = np.sort(places[often])
            left = left[left + length < self.size]
            left = left[names[left + length] >= 0]
            places, keys = left, names[left].astype(np.int64) * (self.size + 1) + names[left + length]

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words agree from a and from b on."""
        a, b = a.copy(), b.copy()
        start = a.copy()
        for k in range(len(self.names) - 1, -1, -1):
            names, inside = self.names[k], np.maximum(a, b) < self.size
            same = np.zeros(len(a), bool)
            same[inside] = names[a[inside]] == names[b[inside]]
            a[same] += 1 << k
            b[same] += 1 << k
        return a - start

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words agree before a and before b."""
        a, b = a.copy(), b.copy()
        start = a.copy()
        for k in range(len(self.names) - 1, -1, -1):
            names, step = self.names[k], 1 << k
            inside = np.minimum(a, b) >= step
            same = np.zeros(len(a), bool)
            same[inside] = names[a[inside] - step] == names[b[inside] - step]
            a[same] -= step
            b[same] -= step
        return start - a


def proposals(places: np.ndarray, names: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) pairs that successor occurrences of factors of one length propose.

    places, names: of factors that occur more than once, by name and place.
    """
    n = len(places)
    gap = np.zeros(n, np.int64)  # to the next occurrence; 0 for the last
    gap[:-1] = np.where(names[1:] == names[:-1], places[1:] - places[:-1], 0)
    # Last member of the arithmetic progression that goes on from each occurrence.
    ends = np.flatnonzero(np.append(gap[1:] != gap[:-1], True))
    last = ends[np.searchsorted(ends, np.arange(n))]
    start = np.flatnonzero((gap > 0) & (gap < 2 * length))
    at, found = start.copy(), []
    while len(start):
        nxt = at + 1
        distance = places[nxt] - places[start]
        hit = distance >= length
        found.append((places[start[hit]], distance[hit]))
        close = (gap[nxt] == gap[at]) & (gap[at] * 4 <= length)
        nxt = np.where(close, last[nxt], nxt)
        going = gap[nxt] > 0
        going[going] = places[nxt[going] + 1] - places[start[going]] < 2 * length
        start, at = start[going], nxt[going]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def find_runs(words: np.ndarray, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, end, period)`` of every run, by start and period; words: see ``Factors``."""
    factors = Factors(words)
    found = []
    for k, (places, names) in enumerate(factors.occurring):
        place, period = proposals(places, names, 1 << k)
        order = np.lexsort((place, period))
        place, period = place[order], period[order]
        # Neighbouring places with one period lie in one stretch.
        new = np.append(True, (period[1:] != period[:-1]) | (place[1:] != place[:-1] + 1))[:len(place)]
        found.append((place[new], period[new]))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    place, period = (np.concatenate(c) for c in zip(*found, strict=True))
    start = place - factors.behind(place, place + period)
    end = place + period + factors.ahead(place, place + period)
    long = end - start >= np.maximum(min_words, MIN_TIMES * period)
    start, end, period = start[long], end[long], period[long]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1]))[:len(start)]
    start, end, period = start[new], end[new], period[new]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _batches(table: pa.RecordBatch, limit: int = BATCH_BYTES) -> Iterator[list[tuple[int | None, bytes]]]:
    """Rows of a batch in lists of about ``limit`` bytes of text."""
    held, size = [], 0
    for part in slices_of(table):
        for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
            held.append((doc_id, (text or "").encode()))
            size += len(held[-1][1]) + 1
            if size > limit:
                yield held
                held, size = [], 0
    if held:
        yield held


def _collapse(rows: list[tuple[int | None, bytes]], rewrite: Rewrite | None, min_words: int) -> pa.RecordBatch:
    texts = [t.split() for _, t in rows]  # at ASCII white space
    if rewrite:
        texts = [rewrite(doc_id, words) for (doc_id, _), words in zip(rows, texts, strict=True)]
    numbers: list[int] = []
    begins = []
    known = 0
    for words in texts:
        begins.append(len(numbers))
        codes: dict[bytes, int] = {}
        numbers.extend([codes.setdefault(w, known + len(codes)) for w in words])
        known += len(codes) + 1
        numbers.append(known - 1)  # a mark that occurs once parts the documents
    start, end, period = find_runs(np.array(numbers, np.int64), min_words)
    drop = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(drop, start + period, 1)
    np.add.at(drop, end, -1)
    gone = np.cumsum(drop) > 0
    first = np.searchsorted(start, begins + [len(numbers)])
    collapsed = []
    for words, begin, a, b in zip(texts, begins, first[:-1], first[1:], strict=True):
        if a != b:
            words = [words[i] for i in np.flatnonzero(~gone[begin:begin + len(words)]).tolist()]
        collapsed.append(b" ".join(words).decode())
    owner = np.repeat(np.array(begins, np.int64), np.diff(first))
    runs = pa.StructArray.from_arrays([pa.array(c.astype(np.int64)) for c in (start - owner, end - start, period)],
                                      names=["start", "length", "period"])
    return pa.RecordBatch.from_arrays(
        [pa.array([doc_id for doc_id, _ in rows], pa.int64()), pa.array([len(w) for w in texts], pa.int64()),
         pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), runs), pa.array(collapsed, pa.string())],
        names=["doc_id", "n_words", "runs", "collapsed"])


def collapse_runs(docs: DataFrame, min_words: int = MIN_WORDS, rewrite: Rewrite | None = None) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)`` for each row of ``docs (doc_id, text)``.

    ``runs`` lists every run (start, length, period) by start, then period. ``collapsed`` is the text
    without the words that a run holds after its first period, joined by single spaces. ``rewrite``
    may change a document's words before that.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _batches(batch):
                yield _collapse(rows, rewrite, min_words)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)
