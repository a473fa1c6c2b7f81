"""Remove passages that recur anywhere in the corpus, with one phrase automaton per slice of documents.

A passage recurs where a window of words (35 by default) starts in more than one place.

1. Candidates. Documents are dealt into slices by a hash of their id and text. Each slice hashes its
   windows, keeps a 47-bit key of each once with a mark if the slice holds the key twice, and sends the
   keys in blocks to their owners; an owner tells every slice which of its keys recur. A window that
   fills the corpus is thus sent once per slice, not once per place.
2. Confirmation. For the candidates alone, slices send 95 bits of hash (31 of the first and all 64 of a
   second, independent one), and owners answer with the second hashes of those that recur. Windows
   that only share a key drop out here.
3. Each slice takes the recurring windows' first places, joins neighbours into passages, and compiles
   the passages into an Aho-Corasick automaton: pieces of half a window, one after the other, so
   that any window inside a passage holds a whole piece. All documents of the slice stream through
   it; every hit is extended word by word in both directions, and where a window or more agrees with
   the passage those words are removed.

Every document meets exactly one automaton, which holds every recurring passage that it could
contain, so the work grows with the corpus and not with corpus times shards. All steps group the
documents in the same way and share one shuffle. Words are compared by 64 bits each throughout.

Cases: a null text has no words; a text shorter than a window cannot lose any; a text of any length
stays in one slice, which is hashed at once in about forty times its bytes; repeated rows recur in
each other; rows without an id are judged like others; other columns are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.llm.hashing import U64, Words, mix, second_windows_of, window_starts, windows_of, words_of

WINDOW = 35
# Bytes of text in a slice of documents, and of the text whose windows one owner compares.
SLICE_BYTES, OWNER_BYTES = 2 << 20, 4 << 20

# Bits of a candidate's key, of which the lowest is the mark, and the bytes it is sent in.
KEY_BITS, _KEY_BYTES = 48, 6

_MARK = U64(1)
# Bits of the first hash that confirm a candidate.
_LOW = U64(0xFFFFFFFE)
_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def _windows_of_slice(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the windows inside texts, and their hashes with the lowest bit clear."""
    places = np.flatnonzero(window_starts(words, window))
    return places, windows_of(words.hashes, window)[places] & ~_MARK


def _is_among(values: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Whether each value is one of ``some``, which is sorted."""
    if not len(some):
        return np.zeros(len(values), bool)
    return some[np.minimum(np.searchsorted(some, values), len(some) - 1)] == values


def _numbered(pairs: np.ndarray) -> np.ndarray:
    """A number for each row of two hashes, the same for equal rows."""
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    ordered = pairs[order]
    new = np.append(False, (ordered[1:] != ordered[:-1]).any(1))[:len(pairs)]
    numbers = np.empty(len(pairs), np.int64)
    numbers[order] = np.cumsum(new)
    return numbers


def _pairs_of(rows: bytes) -> np.ndarray:
    """Pairs of hashes from rows of three 32-bit words."""
    words = np.frombuffer(rows, np.uint32).reshape(-1, 3).astype(U64)
    return np.column_stack([words[:, 0], words[:, 1] | words[:, 2] << U64(32)])


def _passages(places: np.ndarray, hashes: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Word ranges that hold each of the windows once: neighbours among their first places, joined."""
    _, first = np.unique(hashes, return_index=True)
    starts = np.sort(places[first])
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) != 1)
    return list(zip(starts[np.append(0, breaks + 1)].tolist(),
                    (starts[np.append(breaks, len(starts) - 1)] + window).tolist(), strict=True))


def _packed(keys: np.ndarray) -> np.ndarray:
    """Keys as rows of bytes."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_KEY_BYTES]


def _unpacked(block: bytes) -> np.ndarray:
    out = np.zeros((len(block) // _KEY_BYTES, 8), np.uint8)
    out[:, :_KEY_BYTES] = np.frombuffer(block, np.uint8).reshape(-1, _KEY_BYTES)
    return out.view("<u8").ravel()


def _dealt_blocks(number: pa.Scalar, owner: np.ndarray, rows: np.ndarray) -> pa.Table:
    """The rows in one block of bytes per owner."""
    order = np.argsort(owner, kind="stable")
    owned, begins = np.unique(owner[order], return_index=True)
    blocks = [b.tobytes() for b in np.split(rows[order], begins[1:])] if len(owned) else []
    return pa.table({"owner": pa.array(owned, pa.int64()), "slice": pa.array([number.as_py()] * len(owned), pa.int64()),
                     "hashes": pa.array(blocks, pa.binary())})


def _told(table: pa.Table, blocks: list[np.ndarray]) -> pa.Table:
    """What each slice is told: one block for each that it sent."""
    return pa.table({"slice": table.column("slice"), "hashes": pa.array([b.tobytes() for b in blocks], pa.binary())})


def _pieces(values: np.ndarray, blocks: list[np.ndarray]) -> list[np.ndarray]:
    """Values of all blocks, one after the other, by block."""
    return np.split(values, np.cumsum([len(b) for b in blocks])[:-1])


def _letters(hashes: np.ndarray) -> np.ndarray:
    """One code point per word, for the automaton; different words may share one."""
    return (hashes % U64(0xF0000)).astype(np.uint32) + np.uint32(0x10000)


def compile_automaton(letters: str, passages: list[tuple[int, int]], window: int) -> ahocorasick.Automaton | None:
    """Automaton over the passages' pieces; a piece's value lists its (place, passage)."""
    piece = (window + 1) // 2
    at: dict[str, list[tuple[int, int]]] = {}
    for number, (start, end) in enumerate(passages):
        for place in range(start, end - piece + 1, piece):
            at.setdefault(letters[place:place + piece], []).append((place, number))
    if not at:
        return None
    automaton = ahocorasick.Automaton()
    for text, places in at.items():
        automaton.add_word(text, places)
    automaton.make_automaton()
    return automaton


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Words that two runs share from their beginning."""
    differ = np.flatnonzero(a != b)
    return int(differ[0]) if len(differ) else len(a)


def covered_words(words: Words, recurring: np.ndarray, window: int) -> np.ndarray:
    """Marks the words of a slice that lie in a recurring window; ``recurring`` has their second hashes, sorted."""
    h = words.hashes
    covered = np.zeros(len(h), bool)
    places = np.flatnonzero(window_starts(words, window))
    hashes = second_windows_of(h, window, places)
    hit = _is_among(hashes, recurring)
    passages = _passages(places[hit], hashes[hit], window)
    letters = _letters(h).tobytes().decode("utf-32-le")
    automaton = compile_automaton(letters, passages, window)
    if automaton is None:
        return covered
    piece = (window + 1) // 2
    done: dict[tuple[int, int], int] = {}  # (passage, shift) to the end of the run marked last
    for text in range(len(words.first) - 1):
        low, high = int(words.first[text]), int(words.first[text + 1])
        if high - low < window:
            continue
        for end, found in automaton.iter(letters, low, high):
            place = end - piece + 1
            for origin, number in found:
                if done.get((number, place - origin), -1) >= place + piece:
                    continue
                start, stop = passages[number]
                back = min(place - low, origin - start)
                ahead = min(high - place, stop - origin)
                right = _common(h[place:place + ahead], h[origin:origin + ahead])
                if right < piece:
                    continue  # different words under one code point
                left = _common(h[place - back:place][::-1], h[origin - back:origin][::-1])
                done[number, place - origin] = place + right
                if left + right >= window:
                    covered[place - left:place + right] = True
    return covered


def _kept(words: Words, covered: np.ndarray, text: int) -> bytes:
    low, high = words.first[text], words.first[text + 1]
    stay = np.flatnonzero(~covered[low:high]) + low
    return b" ".join([words.data[a:b] for a, b in zip(words.starts[stay].tolist(), words.ends[stay].tolist(), strict=True)])


def remove_recurring(docs: DataFrame, window: int = WINDOW, slice_bytes: int = SLICE_BYTES,
                     owner_bytes: int = OWNER_BYTES, keep_text: bool = True, key_bits: int = KEY_BITS) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256, kept)`` for each row of ``docs (doc_id, text)``.

    ``kept`` is what is left of the text, its words joined by single spaces; without ``keep_text`` it
    is null. One small aggregate over the texts' lengths sets the numbers of slices and owners. Fewer
    ``key_bits`` (at most 48) make more candidates, not another result.
    """
    volume = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices, owners = volume // slice_bytes + 1, volume // owner_bytes + 1
    # Rows of one id, or of none, are told apart by their texts.
    number = F.pmod(F.xxhash64("doc_id", "text"), F.lit(slices))
    dealt = docs.select(F.col("doc_id").cast("long"), "text", number.alias("slice"))

    key_mask = U64((1 << key_bits) - 1) & ~_MARK

    def send(key: tuple, table: pa.Table) -> pa.Table:
        _, hashes = _windows_of_slice(words_of(table.column("text").to_pylist()), window)
        keys, counts = np.unique(hashes & key_mask, return_counts=True)
        owner = (mix(keys) % U64(owners)).astype(np.int64)
        return _dealt_blocks(key[0], owner, _packed(keys | (counts > 1).astype(U64)))

    def compare(table: pa.Table) -> pa.Table:
        blocks = [_unpacked(b) for b in table.column("hashes").to_pylist()]
        marked = np.concatenate(blocks)
        _, inverse, counts = np.unique(marked & ~_MARK, return_inverse=True, return_counts=True)
        twice = counts > 1
        twice[inverse[(marked & _MARK) == _MARK]] = True
        return _told(table, [_packed((b & ~_MARK)[t]) for b, t in zip(blocks, _pieces(twice[inverse], blocks), strict=True)])

    def send_candidates(key: tuple, documents: pa.Table, told: pa.Table) -> pa.Table:
        keys = np.sort(np.concatenate([np.zeros(0, U64), *map(_unpacked, told.column("hashes").to_pylist())]))
        words = words_of(documents.column("text").to_pylist())
        places, hashes = _windows_of_slice(words, window)
        near = _is_among(hashes & key_mask, keys)
        pairs = np.column_stack([hashes[near] & _LOW, second_windows_of(words.hashes, window, places[near])])
        _, first, counts = np.unique(_numbered(pairs), return_index=True, return_counts=True)
        pairs = pairs[first]
        pairs[:, 0] |= (counts > 1).astype(U64)
        rows = np.ascontiguousarray(pairs, "<u8").view(np.uint32).reshape(-1, 4)[:, [0, 2, 3]]
        return _dealt_blocks(key[0], (mix(pairs[:, 1]) % U64(owners)).astype(np.int64), rows)

    def confirm(table: pa.Table) -> pa.Table:
        blocks = [_pairs_of(b) for b in table.column("hashes").to_pylist()]
        marked = np.concatenate(blocks)
        pairs = marked & np.array([_LOW, ~U64(0)])
        numbers = _numbered(pairs)
        twice = np.bincount(numbers) > 1
        twice[numbers[(marked[:, 0] & _MARK) == _MARK]] = True
        stay = twice[numbers]
        return _told(table, [b[t] for b, t in zip(_pieces(pairs[:, 1], blocks), _pieces(stay, blocks), strict=True)])

    def cut(documents: pa.Table, told: pa.Table) -> pa.Table:
        recurring = np.sort(np.concatenate([np.zeros(0, U64), *(np.frombuffer(b, U64) for b in told.column("hashes").to_pylist())]))
        words = words_of(documents.column("text").to_pylist())
        covered = covered_words(words, recurring, window)
        counts = words.counts()
        removed = np.add.reduceat(np.append(covered, False), words.first[:-1], dtype=np.int64) if len(counts) else counts
        kept = [_kept(words, covered, i) for i in range(len(counts))]
        return pa.table({
            "doc_id": documents.column("doc_id"), "n_words": counts.astype(np.int64),
            "n_removed": np.where(counts > 0, removed, 0).astype(np.int64),
            "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept],
            "kept": pa.array([k.decode("utf-8", "surrogatepass") if keep_text else None for k in kept], pa.string())})

    sent, back = "owner long, slice long, hashes binary", "slice long, hashes binary"
    candidates = dealt.groupBy("slice").applyInArrow(send, sent).groupBy("owner").applyInArrow(compare, back)
    asked = dealt.groupBy("slice").cogroup(candidates.groupBy("slice")).applyInArrow(send_candidates, sent)
    recurring = asked.groupBy("owner").applyInArrow(confirm, back)
    return dealt.groupBy("slice").cogroup(recurring.groupBy("slice")).applyInArrow(cut, _RESULT)
