"""Alignment of two tokenizers over a corpus, by products of token-byte incidence matrices.

For a text, matrix A has a row per token of the first tokenizer and B one per token of the second; the
columns are the text's bytes. ``A @ B.T``, summed row by row (Gustavson), links the tokens that share
bytes and counts how many. Restricted to the tokens' last bytes, the same product links the tokens that
end together. The places where tokens of both end cut the text into groups; the product of the
token-group matrices links tokens of one group. The matrices are compressed sparse rows of a batch of
texts at once, built by hand.

Texts that a tokenizer does not give back byte by byte, null and empty ones have no tokens.

How often a pair of ids ends together is summed over the corpus. Of two tokens that end together one
is a suffix of the other, so there are fewer such pairs than the two vocabularies have bytes (under a
million for the usual ones): the table of counts is bounded by the tokenizers, whatever the corpus. It
is sent to the tasks, which look their links up; only it is shuffled.

Cases: strings of special tokens inside texts are plain text; a text of any length is aligned at once,
in about a hundred times its bytes; repeated rows, and rows without an id, count each for itself; other
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.llm.hashing import BATCH_BYTES, batches, texts_of
from keyfold.llm.tokenizing import BYTE_PATTERN, BYTE_SPLIT, Encoder, byte_letters, read_tokenizer
from keyfold.session import write_stage

SPACE = b" "


# --- compressed sparse rows ---------------------------------------------------------------------------
@dataclass
class Rows:
    """A sparse 0/1 matrix: the columns of row i are ``columns[starts[i]:starts[i + 1]]``, ascending."""

    starts: np.ndarray
    columns: np.ndarray
    width: int

    def transposed(self) -> Rows:
        """The same matrix by columns."""
        order = np.argsort(self.columns, kind="stable")
        row = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        starts = np.concatenate([[0], np.cumsum(np.bincount(self.columns, minlength=self.width))])
        return Rows(starts, row[order], len(self.starts) - 1)


def ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``first[i], first[i] + 1, ...``, ``sizes[i]`` numbers each, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + sizes, sizes)


def spans(first: np.ndarray, sizes: np.ndarray, width: int) -> Rows:
    """Row i holds the columns from ``first[i]`` on, ``sizes[i]`` of them."""
    return Rows(np.concatenate([[0], np.cumsum(sizes)]), ranges(first, sizes), width)


def cells(columns: np.ndarray, width: int) -> Rows:
    """Row i holds one column."""
    return Rows(np.arange(len(columns) + 1), columns, width)


def row_products(a: Rows, b: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``a @ b`` as (row, column, value), by row and column.

    Row i of the product is the sum of the rows of b that row i of a names.
    """
    sizes = np.diff(b.starts)[a.columns]
    column = b.columns[ranges(b.starts[a.columns], sizes)]
    row = np.repeat(np.repeat(np.arange(len(a.starts) - 1), np.diff(a.starts)), sizes)
    keys, value = np.unique(row * max(b.width, 1) + column, return_counts=True)
    return keys // max(b.width, 1), keys % max(b.width, 1), value


# --- tokens and their bytes ------------------------------------------------------------------------------
class Vocabulary:
    """The bytes of each id, one after the other."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        digits = [str(i).encode() for i in range(len(tokens))]
        self.digits = np.array([len(d) for d in digits])
        width = max(map(len, digits), default=1)
        self.decimal = np.frombuffer(b"".join(d.ljust(width) for d in digits), np.uint8).reshape(-1, width)

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a sequence of ids."""
        return self.flat[ranges(self.first[ids], self.sizes[ids])]


class ByteTokens:
    """A byte-level tokenizer given by a tokenizers file; it is given a space and the text.

    A file whose tokens are numbered in the order of their merges, and which splits by the usual rule,
    is run by tiktoken, whose ids are the same and which needs no cache; any other by its own library.
    """

    def __init__(self, tokenizer_json: str):
        stated = json.loads(tokenizer_json)
        letters = {c: b for b, c in enumerate(byte_letters())}
        special = {t["id"]: t["content"].encode() for t in stated["added_tokens"]}
        tokens = {i: bytes(letters[c] for c in t) for t, i in stated["model"]["vocab"].items()
                  if i not in special and all(c in letters for c in t)}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in stated["model"].get("merges", [])]
        made = [stated["model"]["vocab"].get(a + b, -1) for a, b in merges]
        if stated.get("normalizer") is None and stated.get("pre_tokenizer") == BYTE_SPLIT and made == sorted(made) and len(made) + 256 == len(tokens):
            import tiktoken

            self.run = tiktoken.Encoding("stated", pat_str=BYTE_PATTERN, special_tokens={}, mergeable_ranks={
                t: i for i, t in tokens.items()}).encode_ordinary
        else:
            encoder = Encoder(tokenizer_json, specials=False)
            self.run = lambda text: np.frombuffer(encoder.encode(text), "<u4")
        tokens |= special
        self.vocabulary = Vocabulary([tokens.get(i, b"") for i in range(max(tokens) + 1)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(self.run(" " + t), np.int64) for t in texts]


class PieceTokens:
    """A sentencepiece model, which puts the space in front itself."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = self.model.get_piece_size()
        pieces = self.model.id_to_piece(list(range(n)))
        self.vocabulary = Vocabulary([bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else
                                      p.replace("▁", " ").encode() for i, p in enumerate(pieces)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int64) for ids in self.model.encode(texts, num_threads=1)]


@lru_cache(maxsize=2)
def tokenizers_of(byte_json: str, piece_model: bytes) -> tuple[ByteTokens, PieceTokens]:
    """Loaded once per worker process."""
    return ByteTokens(byte_json), PieceTokens(piece_model)


# --- links of a batch --------------------------------------------------------------------------------------
@dataclass
class Aligned:
    """Tokens of a batch of texts on both sides, and where tokens of both end."""

    ids: tuple[np.ndarray, np.ndarray]
    first: tuple[np.ndarray, np.ndarray]  # tokens before each text
    starts: tuple[np.ndarray, np.ndarray]  # byte at which each token begins
    ends: tuple[np.ndarray, np.ndarray]
    cuts: np.ndarray  # bytes after which both have ended
    size: int

    def overlap_links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(token of A, token of B, bytes they share)."""
        a, b = (spans(s, e - s, self.size) for s, e in zip(self.starts, self.ends, strict=True))
        return row_products(a, b.transposed())

    def end_links(self) -> tuple[np.ndarray, np.ndarray]:
        """(token of A, token of B) that end at one byte."""
        a, b = (cells(e - 1, self.size) for e in self.ends)
        return row_products(a, b.transposed())[:2]

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """The group of each token: how many cuts lie before its end."""
        return tuple(np.searchsorted(self.cuts, e) for e in self.ends)

    def group_links(self) -> tuple[np.ndarray, np.ndarray]:
        """(token of A, token of B) of one group."""
        a, b = (cells(g, len(self.cuts)) for g in self.groups())
        return row_products(a, b.transposed())[:2]


def align_batch(texts: list[str | None], sides: tuple[ByteTokens, PieceTokens]) -> Aligned:
    """Tokens and cuts of texts; those that a side does not give back have no tokens."""
    given = [t or "" for t in texts]
    encoded = [side.encode(given) for side in sides]
    wanted = [SPACE + t.encode() if t else b"" for t in given]
    size = np.array([len(w) for w in wanted])
    offset = np.cumsum(size) - size
    original = np.frombuffer(b"".join(wanted), np.uint8)
    good = size > 0
    for side, lists in zip(sides, encoded, strict=True):
        vocabulary = side.vocabulary
        owner = np.repeat(np.arange(len(lists)), [len(ids) for ids in lists])
        flat = np.concatenate([np.zeros(0, np.int64), *lists]).astype(np.int64)
        good &= np.bincount(owner, vocabulary.sizes[flat], len(lists)).astype(np.int64) == size
        held = good[owner]  # of the right length, so the bytes lie side by side
        text = np.repeat(np.flatnonzero(good), size[good])
        differ = vocabulary.spelled(flat[held]) != original[ranges(offset[good], size[good])]
        good[np.unique(text[differ])] = False
    ids, first, starts, ends = [], [], [], []
    for side, lists in zip(sides, encoded, strict=True):
        kept = [ids if ok else ids[:0] for ids, ok in zip(lists, good.tolist(), strict=True)]
        flat = np.concatenate([np.zeros(0, np.int64), *kept]).astype(np.int64)
        length = side.vocabulary.sizes[flat]
        end = np.cumsum(length)  # texts that have tokens lie side by side
        ids.append(flat)
        first.append(np.concatenate([[0], np.cumsum([len(k) for k in kept])]).astype(np.int64))
        starts.append(end - length)
        ends.append(end)
    cuts = np.intersect1d(ends[0], ends[1], assume_unique=True)
    return Aligned(tuple(ids), tuple(first), tuple(starts), tuple(ends), cuts, int(size[good].sum()))


def spell_groups(found: Aligned, sides: tuple[ByteTokens, PieceTokens]) -> tuple[bytes, np.ndarray]:
    """``a1,a2|b1;a3|b2,b3;`` over the batch, and where each text's part begins."""
    group = found.groups()
    counts = [np.bincount(g, minlength=len(found.cuts)) for g in group]
    # In the merged order, a token follows all tokens of earlier groups, and A's tokens of its own.
    before = [np.cumsum(c) - c for c in counts]
    n = len(group[0]) + len(group[1])
    vocabularies = [s.vocabulary for s in sides]
    width = max(v.decimal.shape[1] for v in vocabularies) + 1
    out, sizes = np.zeros((n, width), np.uint8), np.zeros(n, np.int64)
    for side, other, mark in ((0, 1, b"|"), (1, 0, b";")):
        g, v, ids = group[side], vocabularies[side], found.ids[side]
        at = np.arange(len(g)) + before[other][g] + (counts[0][g] if side else 0)
        last = np.arange(len(g)) == (before[side] + counts[side] - 1)[g]
        out[at, :v.decimal.shape[1]] = v.decimal[ids]
        out[at, v.digits[ids]] = np.where(last, ord(mark), ord(","))
        sizes[at] = v.digits[ids] + 1
    flat = out[np.arange(width) < sizes[:, None]].tobytes()
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return flat, ends[found.first[0] + found.first[1]]


_LINKED = "doc_id long, n_a long, n_b long, n_groups long, groups string, groups_sha256 string, links array<long>"


def align(docs: DataFrame, byte_tokenizer: str, piece_model: str, keep_groups: bool = True) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, groups, groups_sha256, links)`` for each row of ``docs (doc_id, text)``.

    ``groups`` writes the groups as ``a1,a2|b1;a3|b2,b3`` in decimal ids and is null without
    ``keep_groups``; its hash is there either way, '' without tokens. ``links`` are the pairs that end
    together, in order, as ``a << 32 | b``.
    """
    byte_json = read_tokenizer(byte_tokenizer)
    with open(piece_model, "rb") as f:
        model = f.read()

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = tokenizers_of(byte_json, model)
        for frame in frames:
            for start, texts in batches(texts_of(frame), BATCH_BYTES // 2):
                found = align_batch(texts, sides)
                a, b = found.end_links()
                links = found.ids[0][a] << 32 | found.ids[1][b]
                per_text = np.searchsorted(a, found.first[0])
                flat, begins = spell_groups(found, sides)
                parts = [flat[x:y - 1] if y > x else b"" for x, y in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]
                cut = np.searchsorted(found.cuts, np.concatenate([[0], found.ends[0]])[found.first[0]], "right")
                yield pa.RecordBatch.from_arrays(
                    [frame.column("doc_id").slice(start, len(texts)), *[pa.array(np.diff(f)) for f in found.first],
                     pa.array(np.diff(cut)), pa.array([p.decode() if keep_groups else None for p in parts], pa.string()),
                     pa.array([hashlib.sha256(p).hexdigest() if p else "" for p in parts]),
                     pa.ListArray.from_arrays(pa.array(per_text.astype(np.int32)), pa.array(links))],
                    names=[c.split()[0] for c in _LINKED.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _LINKED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``(link, n)``: how often each pair of ids ends together in the corpus."""
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            links, n = np.unique(frame.column("links").flatten().to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(links, pa.int64()), pa.array(n.astype(np.int64))], names=["link", "n"])

    return aligned.select("links").mapInArrow(run, "link long, n long").groupBy("link").agg(F.sum("n").alias("n"))


def rate_links(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` of a written alignment.

    ``counts (link, n)`` is bounded by the vocabularies. A link is best if no other partner of its
    second id ends with it more often.
    """
    rows = sorted((r["link"], r["n"]) for r in counts.collect())
    links, n = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
    ids, owner = np.unique(links & 0xFFFFFFFF, return_inverse=True)
    highest = np.zeros(len(ids), np.int64)
    np.maximum.at(highest, owner, n)
    table = aligned.sparkSession.sparkContext.broadcast((links, n, n == highest[owner]))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, best = table.value
        for frame in frames:
            column = frame.column("links")
            at = np.searchsorted(known, column.flatten().to_numpy())
            ends = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
            sums = [np.concatenate([[0], np.cumsum(v[at].astype(np.int64))]) for v in (best, count)]
            yield pa.RecordBatch.from_arrays(
                [*[frame.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")], pa.array(np.diff(ends).astype(np.int64)),
                 *[pa.array(np.diff(s[ends])) for s in sums], frame.column("groups_sha256")],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return aligned.select("doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links").mapInArrow(
        run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def alignment_digest(docs: DataFrame, byte_tokenizer: str, piece_model: str) -> DataFrame:
    """``rate_links`` of the whole table. The alignment is written once, so texts are encoded once."""
    aligned = write_stage(align(docs, byte_tokenizer, piece_model, keep_groups=False).drop("groups"), "aligned")
    return rate_links(aligned, write_stage(pair_counts(aligned), "pairs"))
