"""Small aggregates looked up in one pass over the rows.

Some tens of broadcast joins in one plan compile into methods too large for the JIT, and each copies the
rows. Here tasks get all small tables as sorted numbers and take the rows as Arrow tables: the values of
each key column are numbered once, a key tuple is one number made of them, and its place in a table is
found for many rows at a time.

What counts as small is bounded, by set and in all, so neither the driver nor a task holds more than
``LOOKUP_ROWS`` tuples; larger aggregates are joined.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from math import prod

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (BooleanType, DateType, DoubleType, FloatType, IntegralType, LongType, StringType, StructField,
                               StructType)

from keyfold.features.lattice import DISTINCT, FIRST, LAST, PRESENT, ROWS, KeySet, Table
from keyfold.features.spec import Feature, by_key_set

# Tuples of one table and of all tables that are looked up in one pass, and of tables collected at a time.
LOOKUP_SET_ROWS, LOOKUP_ROWS, COLLECTED_ROWS = 250_000, 2_000_000, 500_000
# Rows that a task looks up at a time, and rows in a batch that it returns.
BULK_ROWS, ROWS_IN_BATCH = 32_768, 10_000
# A table is kept by place if it has at least one tuple in so many places.
DENSE = 8
# A tuple is one number below this.
MOST_PLACES = 2 ** 62
SPAN = "_span_"
KEY_TYPES = (StringType, IntegralType, FloatType, DoubleType, DateType, BooleanType)


def same_zero(column: pa.Array | pa.ChunkedArray) -> pa.Array | pa.ChunkedArray:
    """NaN is one value, and so are both zeros."""
    if pa.types.is_floating(column.type):
        return pc.if_else(pc.is_nan(column), pa.scalar(float("nan"), column.type), pc.add(column, pa.scalar(0.0, column.type)))
    return column


def coded(column: pa.ChunkedArray) -> np.ndarray:
    """A number from 1 for each distinct value, 0 for NULL."""
    found = pc.dictionary_encode(same_zero(column)).combine_chunks()
    indices = (found.chunk(0) if isinstance(found, pa.ChunkedArray) else found).indices
    return pc.fill_null(pc.add(indices.cast(pa.int64()), 1), 0).to_numpy(zero_copy_only=False)


def in_bulk(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches put together to tables of at least so many rows, but for the last."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def lookup_sets(target: DataFrame, tables: dict[KeySet, Table], features: Sequence[Feature]) -> list[KeySet]:
    """The key sets with small tables, as many as are small together."""
    def fits(keys: KeySet) -> bool:
        return tables[keys].rows <= LOOKUP_SET_ROWS and all(
            isinstance(target.schema[k].dataType, KEY_TYPES) and target.schema[k].dataType == tables[keys].data.schema[k].dataType
            for k in keys)

    # No column has more values than the smallest table that holds it has tuples.
    most = {k: min(t.rows for s, t in tables.items() if k in s) for keys in tables for k in keys}
    out, room = [], LOOKUP_ROWS
    for keys in sorted(filter(fits, by_key_set(list(features))), key=lambda s: tables[s].rows):
        room -= tables[keys].rows
        if room >= 0 and prod(most[k] for k in keys) < MOST_PLACES:
            out.append(keys)
    return out


@dataclass(frozen=True)
class CodeTable:
    """The tuples of one key set as sorted numbers ``codes``, or with the ``place`` of each possible number,
    -1 for none; and each feature's values, with a last one for no tuple, and whether they are there."""

    keys: tuple[str, ...]
    codes: np.ndarray
    place: np.ndarray | None
    values: dict[str, np.ndarray]
    there: dict[str, np.ndarray]

    def places(self, numbers: dict[str, np.ndarray], sizes: dict[str, int]) -> np.ndarray:
        """The place of each row's tuple, -1 for none."""
        whole, absent = _whole(self.keys, numbers, sizes)
        if not len(self.codes):
            return np.full(len(whole), -1)
        if self.place is not None:
            return np.where(absent, -1, self.place[whole])
        at = np.minimum(np.searchsorted(self.codes, whole), len(self.codes) - 1)
        return np.where(absent | (self.codes[at] != whole), -1, at)


def _whole(keys: Sequence[str], numbers: dict[str, np.ndarray], sizes: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Each row's tuple as one number, and whether one of its keys is NULL or not known, where that is 0."""
    absent = reduce(np.logical_or, [numbers[k] < 0 for k in keys])
    whole = reduce(lambda a, b: a + b, [numbers[k] * prod(sizes[c] for c in keys[i + 1:]) for i, k in enumerate(keys)])
    return np.where(absent, 0, whole), absent


def _numbers(column: pa.ChunkedArray, known: pa.Array) -> np.ndarray:
    """The place of each value among the known ones, -1 for others and NULL."""
    found = pc.index_in(same_zero(column), value_set=known.cast(column.type), skip_nulls=True)
    return pc.fill_null(found, -1).cast(pa.int64()).to_numpy()


def _measure(f: Feature) -> str | None:
    """The column of a collected table that holds a feature's value; None if that is 1."""
    if f.kind == "distinct":
        return None if f.arg in f.keys else DISTINCT + f.arg
    return {"count": lambda: ROWS, "count_col": lambda: PRESENT + f.arg, "span": lambda: SPAN + f.arg}[f.kind]()


def _collected(spark: SparkSession, tables: dict[KeySet, Table], features: Sequence[Feature]) -> Iterator[tuple[KeySet, pa.Table]]:
    """The tables on the driver, some at a time, without tuples that lack a key."""
    sets = by_key_set(list(features))
    measures = {m for f in features if (m := _measure(f)) is not None}
    parts, rows = [[]], 0
    for keys in sets:
        rows += tables[keys].rows
        if parts[-1] and rows > COLLECTED_ROWS:
            parts, rows = [*parts, []], tables[keys].rows
        parts[-1].append(keys)
    for part in parts:
        first = tables[part[0]]
        tall = spark.read.schema(StructType([*first.data.schema.fields, StructField("_set", LongType())])).parquet(first.root)
        columns = [F.datediff(LAST + m.removeprefix(SPAN), FIRST + m.removeprefix(SPAN)).cast("bigint").alias(m)
                   if m.startswith(SPAN) else F.col(m) for m in sorted(measures)]
        keyed = sorted({k for keys in part for k in keys})
        found = tall.filter(F.col("_set").isin([tables[keys].number for keys in part])).select("_set", *keyed, *columns).toArrow()
        for keys in part:
            own = found.filter(pc.equal(found.column("_set"), tables[keys].number))
            yield keys, own.filter(reduce(pc.and_, [own.column(k).is_valid() for k in sorted(keys)]))


def code_tables(spark: SparkSession, tables: dict[KeySet, Table], features: Sequence[Feature]) -> tuple[dict[str, pa.Array], list[CodeTable]]:
    """The known values of each key column, and the tables of the features' key sets as numbers."""
    sets, held, known = by_key_set(list(features)), {}, {}
    for keys, table in _collected(spark, tables, features):
        names = sorted(keys)
        held[keys] = table.select([*names, *{m for f in sets[keys] if (m := _measure(f)) is not None}])
        for k in names:
            values = same_zero(table.column(k)).unique()
            known[k] = pa.chunked_array([known[k], values]).unique() if k in known else values
    sizes = {k: len(v) for k, v in known.items()}
    out = []
    for keys, table in held.items():
        names = tuple(sorted(keys))
        codes = _whole(names, {k: _numbers(table.column(k), known[k]) for k in names}, sizes)[0]
        order = np.argsort(codes)
        codes, place = codes[order], None
        if prod(sizes[k] for k in names) <= DENSE * len(codes):
            place = np.full(prod(sizes[k] for k in names), -1, np.int32)
            place[codes] = np.arange(len(codes))
        values, there = {}, {}
        for f in sets[keys]:
            m = _measure(f)
            column = pa.chunked_array([pa.repeat(1, len(codes))]) if m is None else table.column(m)
            values[f.name] = np.append(pc.fill_null(column, 0).to_numpy()[order], 0)
            there[f.name] = np.append(column.is_valid().to_numpy()[order], False)
        out.append(CodeTable(names, codes, place, values, there))
    return known, out


def look_up(rows: DataFrame, features: Sequence[Feature], tables: tuple[dict[str, pa.Array], list[CodeTable]]) -> DataFrame:
    """Append the features' values, NULL where a row's tuple is not in their table."""
    columns, names = rows.columns, [f.name for f in features]
    schema = StructType([*rows.schema.fields, *[StructField(n, LongType()) for n in names]])
    shared = rows.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sets = shared.value
        sizes = {k: len(v) for k, v in known.items()}
        for table in in_bulk((b for b in batches if b.num_rows), BULK_ROWS):
            numbers = {k: _numbers(table.column(k), v) for k, v in known.items()}
            values = {}
            for s in sets:
                at = s.places(numbers, sizes)
                values |= {n: pa.array(v[at], mask=~s.there[n][at]) for n, v in s.values.items()}
            whole = pa.Table.from_arrays([*[table.column(c) for c in columns], *[values[n] for n in names]], [*columns, *names])
            yield from whole.to_batches(max_chunksize=ROWS_IN_BATCH)

    return rows.mapInArrow(run, schema)
