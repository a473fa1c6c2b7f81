"""Exact duplicates through an extendible-hash index on shared files.

The index holds one entry per distinct (hash, text) and map task at most: entries are combined
before they are shuffled, so copies of one text do not pile up. A directory of 2**depth slots maps
the leading hash bits to buckets; a bucket with more bytes than fit is split by one more bit, and
the directory doubles when a bucket already uses all its bits. Buckets are written to shared files,
each by one owner task, which chains the entries of equal hash and compares their bytes.

Only texts whose hash occurs more than once can have copies, so only they become entries.

Cases: a null text counts as empty; of repeated rows (same id and text) exactly one can stay; the
order of ids decides ties; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.session import write_stage

# Bytes of one bucket, and the most bits of the directory: 2**MAX_DEPTH slots of 16 bytes bound
# what the driver counts and every executor gets of it.
BUCKET_BYTES, MAX_DEPTH = 8 << 20, 16
# Places over which the copies of one text are combined first.
SALTS = 16


@dataclass(frozen=True)
class Directory:
    """``slots[leading bits]`` is the bucket of a hash; ``local`` the bits that a bucket uses."""

    depth: int
    slots: list[int]
    local: dict[int, int]


def grow_directory(weights: dict[int, int], capacity: int, max_depth: int = MAX_DEPTH) -> Directory:
    """Split buckets until each holds at most ``capacity``, or uses ``max_depth`` bits.

    ``weights`` are bytes by the leading ``max_depth`` bits of the hash. A bucket that cannot be
    split further chains its overflow: its owner streams it, whatever its length.
    """
    prefix = [0]
    for slot in range(1 << max_depth):
        prefix.append(prefix[-1] + weights.get(slot, 0))

    def load(bits: int, depth: int) -> int:
        wide = max_depth - depth
        return prefix[(bits + 1) << wide] - prefix[bits << wide]

    depth, slots, local, buckets = 0, [0], {0: 0}, 1
    waiting = [(0, 0, 0)]  # bucket, its leading bits, how many they are
    while waiting:
        bucket, bits, used = waiting.pop()
        if load(bits, used) <= capacity or used == max_depth:
            continue
        if used == depth:
            slots, depth = [s for s in slots for _ in range(2)], depth + 1
        upper, wide = (bits << 1) | 1, depth - used - 1
        for slot in range(upper << wide, (upper + 1) << wide):
            slots[slot] = buckets
        local[bucket] = local[buckets] = used + 1
        waiting += [(bucket, bits << 1, used + 1), (buckets, upper, used + 1)]
        buckets += 1
    return Directory(depth, slots, local)


_CLASS = "hash long, digest string, keep_id long, group_size long"


def _chained(entries: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Owner task: rows come sorted by bucket and hash; the distinct texts of a hash form its chain,
    which is longer than one only where hashes collide."""
    key, chain, out = None, {}, []

    def close() -> None:
        out.extend((key, digest, keep, n) for digest, keep, n in chain.values())
        chain.clear()

    def frame_of() -> pd.DataFrame:
        rows = out.copy()
        out.clear()
        return pd.DataFrame(rows, columns=["hash", "digest", "keep_id", "group_size"])

    for frame in entries:
        for h, text, digest, keep, n in zip(*(frame[c] for c in ("hash", "text", "digest", "keep_id", "n")), strict=True):
            if h != key:
                close()
                key = h
            held = chain.get(text)  # compares the bytes
            if held is None:
                chain[text] = [digest, keep, n]
            else:
                held[1:] = [max(held[1], keep), held[2] + n]
        if out:
            yield frame_of()
    close()
    if out:
        yield frame_of()


def build_index(texts: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Index files of ``(hash, text, digest, doc_id)``: entries with their bucket, as a stage in which
    each bucket is one run of rows sorted by hash."""
    entries = texts.withColumn("_salt", F.pmod(F.col("doc_id"), F.lit(SALTS))).groupBy("hash", "text", "_salt").agg(
        F.first("digest").alias("digest"), F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    entries = write_stage(entries.drop("_salt"), "entries")
    lead = F.shiftrightunsigned("hash", 64 - MAX_DEPTH).cast("int")
    counted = entries.groupBy(lead.alias("lead")).agg(F.sum(F.octet_length("text") + 32).alias("bytes"))
    directory = grow_directory({r["lead"]: r["bytes"] for r in counted.collect()}, bucket_bytes)
    slots = texts.sparkSession.createDataFrame(list(enumerate(directory.slots)), "slot int, bucket int")
    slot = F.lit(0) if directory.depth == 0 else F.shiftrightunsigned("hash", 64 - directory.depth).cast("int")
    placed = entries.withColumn("slot", slot).join(F.broadcast(slots), "slot").drop("slot")
    return write_stage(placed.repartition("bucket").sortWithinPartitions("bucket", "hash"), "index")


def duplicate_classes(rows: DataFrame, texts: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``(hash, digest, keep_id, group_size, keep_row)`` of every text that more than one row has.

    rows: written stage of ``(doc_id, hash, digest, _row)``. texts: ``(doc_id, text, hash, digest)``.
    """
    often = write_stage(rows.groupBy("hash").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("hash"), "often")
    lowest = F.lit(-(1 << 63)).cast("long")
    index = build_index(texts.join(often, "hash").withColumn("doc_id", F.coalesce("doc_id", lowest)), bucket_bytes)
    owned = index.repartition("bucket").sortWithinPartitions("bucket", "hash")
    classes = write_stage(owned.select("hash", "text", "digest", "keep_id", "n").mapInPandas(_chained, _CLASS)
                          .filter("group_size > 1").withColumn("keep_id", F.nullif("keep_id", lowest)), "classes")
    tops = rows.groupBy("hash", "digest").agg(F.max(F.struct("doc_id", "_row")).alias("_top"))
    return write_stage(classes.join(tops, ["hash", "digest"]).withColumn("keep_row", F.col("_top._row")).drop("_top"),
                       "duplicates")


def hashed(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, hash, digest)``; a null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("hash"), F.sha2(text, 256).alias("digest"))


def exact_duplicates(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` for each row of ``docs (doc_id, text)``.

    Of equal texts the row with the largest id stays.
    """
    texts = hashed(docs)
    rows = write_stage(texts.select("doc_id", "hash", "digest", F.monotonically_increasing_id().alias("_row")), "rows")
    found = rows.join(duplicate_classes(rows, texts, bucket_bytes), ["hash", "digest"], "left")
    alone = F.col("keep_row").isNull()
    return found.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("_row") == F.col("keep_row"))).alias("kept"), F.col("digest").alias("text_sha256"))


def drop_duplicates(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    numbered = write_stage(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = write_stage(numbered.select("doc_id", F.xxhash64(text).alias("hash"), F.sha2(text, 256).alias("digest"), "_row"), "rows")
    classes = duplicate_classes(rows, hashed(numbered), bucket_bytes)
    gone = write_stage(rows.join(classes, ["hash", "digest"]).filter("_row <> keep_row").select("_row"), "gone")
    return numbered.join(gone, "_row", "left_anti").drop("_row")
