"""Token ids in ORC files: run-length encoded integers in stripes, row indexes, Bloom filters on ids.

Documents are range-partitioned by id, so the files and the rows in them ascend by id: a reader
prunes files, stripes and row groups by the minima and maxima that ORC keeps, tells absent ids by
the Bloom filters, and reads stripes in parallel. Each row keeps its place in its own file, so the
place in the whole is known from one number per file.

Cases: a null or empty text has only its end token; repeated rows are written each for itself; an
empty table writes no rows. A null document id sorts first. A text of any length is encoded whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyfold.llm.tokenizing import encoder_of, read_tokenizer

END_TOKEN = 2
STRIPE_BYTES = 16 << 20
INDEX_ROWS = 1_000
# Words that a worker keeps the ids of; see ``tokenizing``.
CACHE_ENTRIES = 650_000
_COLUMNS = "doc_id long, part int, local_start long, n_ids int, ids array<int>"


def _ints(chunks: list[bytes]) -> pa.ListArray:
    offsets = np.cumsum([0, *(len(c) // 4 for c in chunks)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(chunks), "<i4")))


def encode_sorted(docs: DataFrame, tokenizer_path: str, end_token: int = END_TOKEN) -> DataFrame:
    """``(doc_id, part, local_start, n_ids, ids)`` in ranges of ascending id; ids end with ``end_token``."""
    tokenizer = read_tokenizer(tokenizer_path)
    end = end_token.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, at = encoder_of(tokenizer, CACHE_ENTRIES), TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                chunks = [encoder.encode(t) + end for t in piece.column("text").to_pylist()]
                sizes = np.array([len(c) // 4 for c in chunks])
                starts = at + np.cumsum(sizes) - sizes
                at += int(sizes.sum())
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(np.full(len(chunks), part, np.int32)),
                     pa.array(starts.astype(np.int64)), pa.array(sizes.astype(np.int32)), _ints(chunks)],
                    names=["doc_id", "part", "local_start", "n_ids", "ids"])

    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id")
    return ranged.sortWithinPartitions("doc_id").mapInArrow(run, _COLUMNS)


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_token: int = END_TOKEN) -> None:
    encode_sorted(docs, tokenizer_path, end_token).write.options(**{
        "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true",
        "orc.row.index.stride": str(INDEX_ROWS), "orc.stripe.size": str(STRIPE_BYTES), "compression": "zstd",
    }).orc(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, part, local_start, n_ids, ids)``. Filters on ``doc_id`` are pushed into the scan."""
    return spark.read.schema(_COLUMNS).orc(path)


def token_starts(files: DataFrame) -> DataFrame:
    """``(part, part_start)``: ids in all files before each; one row per file, so small."""
    sizes = files.groupBy("part").agg(F.max(F.col("local_start") + F.col("n_ids")).alias("_ids"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("part", F.coalesce(F.sum("_ids").over(earlier), F.lit(0)).alias("part_start"))


def token_digest(files: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of each document in the files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            values = memoryview(lists.values.to_numpy().astype("<u4")).cast("B")
            offsets = lists.offsets.to_numpy()
            crc = [zlib.crc32(values[4 * a:4 * b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), batch.column("local_start"),
                 pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())],
                names=["doc_id", "part", "local_start", "n_tokens", "ids_crc32"])

    told = files.select("doc_id", "part", "local_start", "ids").mapInArrow(run, "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long")
    joined = told.join(F.broadcast(token_starts(files)), "part")
    return joined.select("doc_id", (F.col("local_start") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")
