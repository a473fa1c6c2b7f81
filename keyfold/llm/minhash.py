"""Near duplicates by MinHash with tensored banding, confirmed on full shingle sets.

A document has ``COLLECTIONS`` small collections of ``ROWS`` minimum hashes. Instead of fresh hashes
for every table, a table key is a pair of collections: 16 collections give 120 tables of 6 hashes
from 48 hashes, where independent tables would need 720.

1. Documents with equal shingle sets become one class, represented by its smallest id, so exact
   copies take no further part. Only ids, set digests and minimum hashes are kept of a document.
2. A table key can only be shared where both its collections are, so collections that no other class
   shares are left out before the pairs are formed. Classes that share a key belong to one family:
   its edges join each class to the smallest of the key, which needs no list of a key's members.
3. The members of a family are compared on their full sets. A family is cut into blocks of
   ``BLOCK`` classes and each pair of blocks is a unit of work, so a family of any size is compared
   in full by units of bounded size. A unit returns a spanning forest of the links it confirms.
4. Components of the confirmed links name the groups.

Keys are counted by aggregation with partial sums and looked up in a join between written stages,
whose skewed partitions Spark splits, so a key may hold any share of the rows.

At the threshold of 0.75 a pair shares no key with probability 0.002, at 0.8 with 0.0002; a pair
that shares none is still compared when others bring it into one family.

Cases: null, empty or blank texts have an empty set, and link with nothing; a text of fewer words
than a shingle has one shingle, all its words; repeated rows are copies of each other, of which
``kept`` marks those of the smallest id; other columns are not read; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.llm.components import connected_components
from keyfold.llm.hashing import U64, batches, mix, sequences_of, slices_of, texts_of, windows_of, words_of
from keyfold.session import write_stage

SHINGLE = 5
# Similarity in hundredths from which two documents are linked.
THRESHOLD = 75
COLLECTIONS, ROWS = 16, 3
BLOCK = 64
SEED = 20240229


def _coefficients(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    values = np.random.default_rng(seed).integers(0, 1 << 63, (2, count), dtype=U64)
    return values[0] * U64(2) + U64(1), values[1]


def shingle_sets(texts: Iterable[str | None], size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, batch in batches(texts):
        words = words_of(batch, lower=True)
        shingles = windows_of(words.hashes, size)
        for low, high in zip(words.first[:-1], words.first[1:], strict=True):
            if high - low >= size:
                yield np.unique(shingles[low:high - size + 1])
            elif high > low:
                yield sequences_of(words.hashes, np.array([low]), np.array([high]))
            else:
                yield np.zeros(0, U64)


def signatures(docs: DataFrame, collections: int = COLLECTIONS, rows: int = ROWS, seed: int = SEED) -> DataFrame:
    """``(doc_id, n_shingles, digest, halves)``: ``halves`` has one hash per collection."""
    schema = "doc_id long, n_shingles long, digest string, halves array<long>"
    a, b = _coefficients(collections * rows, seed)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            sizes, digests, halves = [], [], []
            for s in shingle_sets(texts_of(frame)):
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None)
                if not len(s):
                    halves.append(None)
                    continue
                least = np.full(len(a), np.iinfo(np.uint64).max, U64)
                for part in np.array_split(s, len(s) // 4096 + 1):
                    least = np.minimum(least, (part[None, :] * a[:, None] + b[:, None] >> U64(32)).min(1))
                folded = np.arange(collections, dtype=U64)
                for column in least.reshape(collections, rows).T:
                    folded = mix(folded * U64(0x9E3779B97F4A7C15) + column)
                halves.append(folded.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [frame.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()),
                 pa.array(halves, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "digest", "halves"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _shared(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Rows whose key at least one other class has, with the smallest class of the key."""
    keys = write_stage(rows.groupBy(key).agg(F.min("rep").alias("smallest"), F.max("rep").alias("_most"))
                       .filter("smallest < _most").drop("_most"), name)
    return rows.join(keys, key)


def family_edges(classes: DataFrame) -> DataFrame:
    """``(a, b)``: classes that share a table key, joined to the smallest of the key."""
    halves = write_stage(classes.select("rep", F.explode("halves").alias("half")), "halves")
    kept = write_stage(_shared(halves, "half", "shared_halves").groupBy("rep").agg(
        F.sort_array(F.collect_set("half")).alias("halves")).filter("size(halves) > 1"), "kept_halves")
    pairs = F.flatten(F.transform("halves", lambda x, i: F.transform(
        F.slice("halves", i + 2, F.size("halves")), lambda y: F.xxhash64(x, y))))
    keyed = write_stage(kept.select("rep", F.explode(pairs).alias("key")), "keys")
    return _shared(keyed, "key", "shared_keys").filter("rep <> smallest").select(
        F.col("rep").alias("a"), F.col("smallest").alias("b")).distinct()


def linked_pairs(sets: list[np.ndarray], side: np.ndarray, threshold: int) -> np.ndarray:
    """Boolean matrix of the links between sets: of one block (``side`` all equal) or across two."""
    sizes = np.array([len(s) for s in sets], np.int64)
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    width = int(column.max()) + 1
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((len(sets), len(sets)), np.int64)
    for low in range(0, width, 1 << 14):
        a, b = np.searchsorted(column, [low, low + (1 << 14)])
        part = np.zeros((len(sets), min(1 << 14, width - low)), np.float32)
        part[row[a:b], column[a:b] - low] = 1
        shared += (part @ part.T).astype(np.int64)
    linked = 100 * shared >= threshold * (sizes[:, None] + sizes[None, :] - shared)
    if side.min() != side.max():
        linked &= side[:, None] != side[None, :]
    return linked


def _forest(linked: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges that connect what the links connect."""
    free = np.ones(len(linked), bool)
    for root in range(len(linked)):
        if free[root]:
            free[root], waiting = False, [root]
            while waiting:
                at = waiting.pop()
                for other in np.flatnonzero(linked[at] & free):
                    free[other] = False
                    waiting.append(int(other))
                    yield at, int(other)


def confirmed_links(docs: DataFrame, families: DataFrame, threshold: int = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """``(a, b)``: a spanning forest of the links between the classes of each family.

    families: stage of ``(node, component)``.
    """
    sizes = families.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    members = write_stage(families.join(sizes, "component").select(
        F.col("node").alias("doc_id"), "component", "blocks",
        F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")), "members")

    def sets(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for frame in frames for p in slices_of(frame)):
            found = [s.tobytes() for s in shingle_sets(texts_of(part))]
            yield pa.RecordBatch.from_arrays(
                [part.column(c) for c in ("doc_id", "component", "block", "blocks")] + [pa.array(found, pa.binary())],
                names=["doc_id", "component", "block", "blocks", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(members, "doc_id").select(
        "doc_id", "text", "component", "block", "blocks").mapInArrow(
        sets, "doc_id long, component long, block int, blocks int, shingles binary")
    units = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        F.xxhash64("component", F.least("block", "other"), F.greatest("block", "other")).alias("unit"),
        "component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        "block", "doc_id", "shingles")

    def link(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for f in frames for p in slices_of(f) for r in zip(*(p.column(c).to_pylist() for c in (
            "component", "i", "j", "block", "doc_id", "shingles")), strict=True))
        for _, unit in groupby(rows, key=lambda r: r[:3]):
            side, ids, held = [], [], []
            for _, _, _, at, doc_id, shingles in unit:
                if not ids or ids[-1] != doc_id:  # a repeated row has the same set
                    side.append(at)
                    ids.append(doc_id)
                    held.append(np.frombuffer(shingles, U64))
            if len(ids) > 1:
                edges = list(_forest(linked_pairs(held, np.array(side), threshold)))
                if edges:
                    yield pa.RecordBatch.from_arrays([pa.array([ids[e[k]] for e in edges], pa.int64()) for k in (0, 1)],
                                                     names=["a", "b"])

    return units.repartition("unit").sortWithinPartitions("component", "i", "j", "block", "doc_id").drop(
        "unit").mapInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for each row of ``docs (doc_id, text)``.

    Documents with a Jaccard similarity of ``threshold`` hundredths or more are linked;
    ``component_id`` is the smallest id that links reach.
    """
    signed = write_stage(signatures(docs), "signatures")
    classes = write_stage(signed.filter("digest IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.first("halves").alias("halves")), "classes")
    families = connected_components(family_edges(classes))
    groups = write_stage(connected_components(confirmed_links(docs, families, threshold)), "groups")
    named = write_stage(classes.join(groups, F.col("rep") == F.col("node"), "left").select(
        "digest", F.coalesce("component", "rep").alias("_component")), "named")
    joined = signed.drop("halves").join(named, "digest", "left")
    component = F.coalesce("_component", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"),
                         (F.col("doc_id") == component).alias("kept"))


def keep_one_of_each(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: those with the smallest id of each group."""
    gone = write_stage(near_duplicates(docs, threshold).filter("NOT kept").select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
