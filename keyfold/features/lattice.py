"""Aggregates of many key sets, the coarser ones from the finer ones.

A table of one row per key tuple holds what can be merged: the number of rows, the range of each date
and the number of non-null values. Any subset of its keys can then be aggregated from it instead of
from the rows: triples feed pairs, and pairs feed singles. The number of distinct values of a column
under some keys is the number of tuples with a value there in the table of those keys and the column,
so exact distinct counts come from the same tables.

Key sets that no other one contains read the rows, all of them in one scan of grouping sets; each
further layer is one job over the tables of those before. NULL is a key value like any other until the
tables are finished, since a tuple that lacks one key still counts under its other keys.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from keyfold.features.spec import Feature, by_key_set
from keyfold.session import freeing_shuffles, new_stage_path

ROWS, FIRST, LAST, PRESENT, DISTINCT = "_rows", "_first_", "_last_", "_present_", "_distinct_"

# Tables are written in at most this many jobs, one after the other, unless distinct counts need more.
LAYERS = 3

KeySet = frozenset[str]


@dataclass(frozen=True)
class Table:
    """A written aggregate: one row per tuple of ``keys``, NULLs included. ``number`` is its place
    among the tables of a lattice, which lie under ``root``; -1 for one that was given."""

    keys: KeySet
    data: DataFrame
    rows: int
    number: int = -1
    root: str = ""


def read_set(spark: SparkSession, path: str, number: int, schema: StructType) -> DataFrame:
    """One of the tables that a job wrote under ``_set``."""
    try:
        return spark.read.schema(schema).parquet(f"{path}/_set={number}")
    except AnalysisException:  # an aggregate without rows has no folder
        return spark.createDataFrame([], schema)


def write_sets(frames: Sequence[DataFrame]) -> list[DataFrame]:
    """Write many aggregates in one job; read each from its own folder, so that each has a size."""
    spark = frames[0].sparkSession
    path = new_stage_path(spark, "groups")
    tagged = [f.withColumn("_set", F.lit(i)) for i, f in enumerate(frames)]
    with freeing_shuffles(spark):
        reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged).write.partitionBy("_set").parquet(path)
    return [read_set(spark, path, i, f.schema) for i, f in enumerate(frames)]


def needed_sets(features: Iterable[Feature]) -> dict[KeySet, set[str]]:
    """Each key set to be tabulated, with the columns whose distinct values are counted under it.

    A distinct count also needs the table of its keys and its column.
    """
    sets: dict[KeySet, set[str]] = {}
    for f in features:
        keys = frozenset(f.keys)
        sets.setdefault(keys, set())
        if f.kind == "distinct" and f.arg not in keys:
            sets[keys].add(f.arg)
            sets.setdefault(keys | {f.arg}, set())
    return sets


def layers_of(sets: dict[KeySet, set[str]]) -> list[list[KeySet]]:
    """Key sets by the job that tabulates them. The first job reads the rows."""
    at: dict[KeySet, int] = {}
    for keys in sorted(sets, key=lambda s: (-len(s), sorted(s))):
        chain = 1 + max((at[s] for s in at if keys < s), default=-1)
        helpers = 1 + max((at[keys | {a}] for a in sets[keys]), default=-1)
        at[keys] = max(min(chain, LAYERS - 1), helpers)
    return [[s for s in at if at[s] == n] for n in range(max(at.values(), default=-1) + 1)]


class _Columns:
    """The columns of the tall table that holds all key sets of a lattice, each row with the keys of
    its own set and NULL in the others."""

    def __init__(self, sets: dict[KeySet, set[str]], features: Sequence[Feature]):
        self.keys = sorted({k for s in sets for k in s})
        self.dates = sorted({f.arg for f in features if f.kind == "span"})
        self.values = sorted({f.arg for f in features if f.kind == "count_col"})
        self.distinct = sorted({a for args in sets.values() for a in args})

    def state(self) -> list[str]:
        return [ROWS, *[p + d for d in self.dates for p in (FIRST, LAST)], *[PRESENT + v for v in self.values]]

    def from_rows(self) -> list[Column]:
        return [F.count(F.lit(1)).alias(ROWS),
                *[e for d in self.dates for e in (F.min(d).alias(FIRST + d), F.max(d).alias(LAST + d))],
                *[F.count(v).alias(PRESENT + v) for v in self.values]]

    def merged(self) -> list[Column]:
        sums = [ROWS, *[PRESENT + v for v in self.values]]
        return [*[F.sum(c).alias(c) for c in sums],
                *[e for d in self.dates for e in (F.min(FIRST + d).alias(FIRST + d), F.max(LAST + d).alias(LAST + d))]]


def _in_one_pass(source: DataFrame, sets: dict[KeySet, int], measures: Sequence[Column]) -> DataFrame:
    """Grouping sets over one scan: ``(all key columns, measures, _set)``."""
    columns = sorted({k for s in sets for k in s})
    # Bit i of the grouping id is set when the i-th column from the right is rolled up.
    ids = {sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in s): n for s, n in sets.items()}
    grouped = source.groupingSets([[F.col(c) for c in columns if c in s] for s in sets], *[F.col(c) for c in columns])
    number = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair])
    return grouped.agg(F.grouping_id().alias("_id"), *measures).withColumn("_set", number[F.col("_id")].cast("int")).drop("_id")


def _from_tables(tall: DataFrame, columns: _Columns, children: dict[KeySet, int], parents: dict[KeySet, Table],
                 helpers: dict[KeySet, dict[str, Table]]) -> DataFrame:
    """Coarser sets from rows of the tall table.

    Each row goes to the sets that are taken from its own: as rows and ranges where its table is the
    child's parent, and as one more distinct value where it is the child's helper for a column.
    """
    bit = {c: 1 << i for i, c in enumerate(columns.keys)}
    given: dict[int, list[Column]] = {}
    for keys, number in children.items():
        mask = sum(bit[k] for k in keys)
        wanted = {a: t.number for a, t in helpers[keys].items()}
        for table in {parents[keys].number, *wanted.values()}:
            counted = sum(1 << columns.distinct.index(a) for a, t in wanted.items() if t == table)
            given.setdefault(table, []).append(F.struct(
                F.lit(number).alias("child"), F.lit(mask).cast("long").alias("mask"),
                F.lit(table == parents[keys].number).alias("state"), F.lit(counted).cast("long").alias("counted")))
    to = F.create_map(*[x for t, parts in given.items() for x in (F.lit(t), F.array(*parts))])
    spread = tall.filter(F.col("_set").isin(*given)).select("*", F.explode(to[F.col("_set")]).alias("_to"))
    mask, state, counted = (F.col(f"_to.{c}") for c in ("mask", "state", "counted"))
    contributions = spread.select(
        F.col("_to.child").alias("_set"),
        *[F.when(mask.bitwiseAND(F.lit(bit[k])) != 0, F.col(k)).alias(k) for k in columns.keys],
        *[F.when(state, F.col(c)).alias(c) for c in columns.state()],
        *[F.when((counted.bitwiseAND(F.lit(1 << i)) != 0) & F.col(a).isNotNull(), 1).otherwise(0).cast("bigint").alias(DISTINCT + a)
          for i, a in enumerate(columns.distinct)])
    return contributions.groupBy(*columns.keys, "_set").agg(
        *columns.merged(), *[F.sum(DISTINCT + a).alias(DISTINCT + a) for a in columns.distinct])


def tabulate(source: DataFrame, features: Sequence[Feature], cells: DataFrame | None = None) -> dict[KeySet, Table]:
    """Tables of all key sets of the features, and of those that their distinct counts need.

    ``cells``, a finer aggregate of the source with the columns of such a table, serves the key sets
    inside its own columns.
    """
    spark, sets = source.sparkSession, needed_sets(features)
    columns = _Columns(sets, features)
    inside: KeySet = frozenset()
    if cells is not None:
        inside = frozenset(c for c in cells.columns if not c.startswith((ROWS, FIRST, LAST, PRESENT)))
        for v in columns.values:
            if PRESENT + v not in cells.columns and v in inside:
                cells = cells.withColumn(PRESENT + v, F.when(F.col(v).isNotNull(), F.col(ROWS)).otherwise(0))
        if not set(columns.state()) <= set(cells.columns):
            inside = frozenset()
    path = new_stage_path(spark, "lattice")
    numbers = {keys: i for i, keys in enumerate(sets)}
    tables: dict[KeySet, Table] = {}
    schema: StructType | None = None
    for depth, layer in enumerate(layers_of(sets)):
        parts = []
        if depth == 0:
            from_cells, from_rows = ({s: numbers[s] for s in layer if (s <= inside) == side} for side in (True, False))
            if from_rows:
                parts.append(_in_one_pass(source, from_rows, columns.from_rows()))
            if from_cells:
                parts.append(_in_one_pass(cells, from_cells, columns.merged()))
        else:
            # The smallest table that holds the keys is the parent.
            parents = {s: min((t for t in tables.values() if s < t.keys), key=lambda t: (t.rows, t.number)) for s in layer}
            helpers = {s: {a: tables[s | {a}] for a in sets[s]} for s in layer}
            tall = spark.read.schema(schema).parquet(path)
            parts.append(_from_tables(tall, columns, {s: numbers[s] for s in layer}, parents, helpers))
        whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        missing = {c: F.lit(None).cast("bigint") for c in [DISTINCT + a for a in columns.distinct] if c not in whole.columns}
        missing |= {k: F.lit(None).cast(source.schema[k].dataType) for k in columns.keys if k not in whole.columns}
        whole = whole.withColumns(missing).select(*columns.keys, *columns.state(), *[DISTINCT + a for a in columns.distinct], "_set")
        schema = whole.schema
        with freeing_shuffles(spark):
            whole.write.mode("append").partitionBy("_set").parquet(path)
        counts = {r["_set"]: r["count"] for r in spark.read.schema("_set int").parquet(path).groupBy("_set").count().collect()}
        for keys in layer:
            data = read_set(spark, path, numbers[keys], StructType([f for f in schema if f.name != "_set"]))
            tables[keys] = Table(keys, data, counts.get(numbers[keys], 0), numbers[keys], path)
    return tables


def value_of(feature: Feature) -> Column:
    """A feature's value in the table of its keys."""
    if feature.kind == "count":
        value = F.col(ROWS)
    elif feature.kind == "count_col":
        value = F.col(PRESENT + feature.arg)
    elif feature.kind == "span":
        value = F.datediff(LAST + feature.arg, FIRST + feature.arg).cast("bigint")
    elif feature.kind == "distinct":
        value = F.lit(1).cast("bigint") if feature.arg in feature.keys else F.col(DISTINCT + feature.arg)
    else:
        raise ValueError(f"{feature.kind!r} cannot be merged")
    return value.alias(feature.name)


def groups_of(tables: dict[KeySet, Table], features: Sequence[Feature]) -> dict[KeySet, DataFrame]:
    """``(keys, feature values)`` of each key set. Tuples with a NULL, which match no row, are left out."""
    out = {}
    for keys, group in by_key_set(list(features)).items():
        present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in sorted(keys)])
        out[keys] = tables[keys].data.filter(present).select(*sorted(keys), *[value_of(f) for f in group])
    return out
