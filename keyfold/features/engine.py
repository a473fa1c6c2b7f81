"""Attach per-key aggregates to rows.

Three ways give the same rows, and the tests hold them to it:

``attach``                key sets tabulated as a lattice, and joined back. The general way.
``attach_windows``        for key sets that share a leading high-cardinality column: one shuffle on that
                          column serves all of them. Heavy values leave this path for ``attach``.
``attach_grouping_sets``  all counts in one pass over the rows, for key sets of few distinct values.

``attach_all`` takes the second way for the sets led by one column and the first for the others,
``attach_through_cells`` finishes all features on the distinct tuples of their columns and joins once.

Aggregates are written before they are joined; ``attach_all`` looks small ones up instead, see
``lookup``. A written aggregate has a known size, so Spark plans a broadcast for a small one without shuffling the rows; for a large one both sides of the join are
plain shuffles, of which Spark splits the partitions that turn out skewed. A key that holds a third
of the rows, or a third of them without key, is thus spread over many tasks.

A row with a NULL in any key matches no group and gets the fill value, as under plain SQL equality.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from keyfold.features.lattice import FIRST, LAST, ROWS, groups_of, read_set, tabulate, write_sets
from keyfold.features.lookup import code_tables, coded, look_up, lookup_sets
from keyfold.features.spec import Feature, by_key_set
from keyfold.session import freeing_shuffles, new_stage_path, write_stage

# Rows of one leading value that a task may hold; heavier values are joined instead.
MAX_GROUP_ROWS = 1_000_000
# Rows that a task groups at a time, unless one value has more, and rows in a batch that it returns.
ROWS_AT_ONCE, ROWS_IN_BATCH = 100_000, 10_000
# Prefix of a date as a number of days.
DAY = "_day_"

# Key sets joined in one plan before a stage is written.
MAX_JOINS = 20


def _all_present(keys: Iterable[str]) -> Column:
    return _all_of(F.col(k).isNotNull() for k in keys)


def join_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str], null_safe: bool = False) -> DataFrame:
    """Left-join a written table of one row per key to ``rows``."""
    return null_safe_join(rows, groups, keys) if null_safe else rows.join(groups, list(keys), "left")


def _all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _filled(feature: Feature) -> Column:
    value = F.col(feature.name)
    return value if feature.fill is None else F.coalesce(value, F.lit(feature.fill)).alias(feature.name)


def _finest_first(groups: list[list[Feature]], large: Sequence[str]) -> list[list[Feature]]:
    """Joins that must shuffle the rows come first, while the rows are narrow; broadcasts come last."""
    return sorted(groups, key=lambda g: (not set(g[0].keys) & set(large), -len(g[0].keys)))


def pack(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """Put columns into one struct, which joins of the other columns copy as a whole."""
    return df.select(*[c for c in df.columns if c not in columns], F.struct(*columns).alias(name)) if columns else df


def unpack(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in names], *[f"{n}.*" for n in names if n in df.columns])


def attach(target: DataFrame, features: Sequence[Feature], source: DataFrame | None = None,
           large: Sequence[str] = ("user_id",), cells: DataFrame | None = None, block: int = MAX_JOINS,
           lookups: bool = False) -> DataFrame:
    """Left-join every feature to ``target``; aggregates are taken over ``source`` (default: target).

    Key sets are tabulated as a lattice, see ``lattice``; ``cells``, as of ``collapse_to_cells``, stands
    in for the source where it holds a set's columns. A stage is written after every ``block`` key sets:
    one plan of a hundred joins is replanned after each of its stages, and compiles into methods too
    large for the JIT. Finished columns are packed meanwhile.

    With ``lookups``, small tables are not joined but looked up in one pass over the rows, see ``lookup``.
    """
    source = target if source is None else source
    merged = [f for f in features if f.kind != "stddev"]
    made = tabulate(source, merged, cells) if merged else {}
    small = lookup_sets(target, made, merged) if lookups else []
    sets = _finest_first([g for keys, g in by_key_set(list(features)).items() if keys not in small], large)
    joined = [f for f in merged if frozenset(f.keys) not in small]
    tables = groups_of(made, joined)
    spread = [f for f in features if f.kind == "stddev"]
    out, packed, open_names = target, [], []
    for number, group in enumerate(sets):
        if number and number % block == 0:
            out = write_stage(pack(out, open_names, f"_block_{number}"), "block")
            packed, open_names = [*packed, f"_block_{number}"], []
        keys = frozenset(group[0].keys)
        if keys in tables:
            out = join_groups(out, tables[keys], sorted(keys))
            open_names += [f.name for f in group if f.kind != "stddev"]
    out = unpack(out, packed)
    out = out.select(*target.columns, *[_filled(f) for f in joined])
    if small:
        found = [f for f in merged if frozenset(f.keys) in small]
        looked = look_up(out, found, code_tables(source.sparkSession, made, found))
        out = looked.select(*out.columns, *[_filled(f) for f in found])
    return (attach_stddev(out, spread, source=source) if spread else out).select(
        *target.columns, *[f.name for f in features])


def feature_columns(features: Iterable[Feature]) -> set[str]:
    """Key columns, and the arguments of distinct and value counts, which must tell cells apart."""
    features = list(features)
    kept = {k for f in features for k in f.keys}
    return kept | {f.arg for f in features if f.kind in ("distinct", "count_col")}


def collapse_to_cells(source: DataFrame, columns: Sequence[str], dates: Iterable[str] = ()) -> DataFrame:
    """Distinct tuples of ``columns`` with their row count and the range of each date column."""
    ranges = [e for d in sorted(set(dates)) for e in (F.min(d).alias(FIRST + d), F.max(d).alias(LAST + d))]
    return source.groupBy(*columns).agg(F.count(F.lit(1)).alias(ROWS), *ranges)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join in which NULL keys equal each other; the left copy of the keys stays."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    condition = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys])
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def attach_through_cells(target: DataFrame, features: Sequence[Feature],
                         source: DataFrame | None = None) -> DataFrame:
    """Attach features by way of the distinct cells of their columns.

    All aggregates read the (stage-written) cells rather than the rows, and only the finished cells
    are joined to the rows, so the number of shuffles of ``target`` does not grow with the features.
    """
    source = target if source is None else source
    columns = sorted(feature_columns(features))
    cells = write_stage(
        collapse_to_cells(source, columns, [f.arg for f in features if f.kind == "span"]), "cells")
    finished = write_stage(attach(cells, features, large=(), cells=cells).select(
        *columns, *[f.name for f in features]), "finished")
    joined = join_groups(target, finished, columns, null_safe=True)
    # A target row whose cell the source lacks matches no group either.
    return joined.select(*target.columns, *[_filled(f) for f in features])


def attach_all(rows: DataFrame, features: Sequence[Feature], lead: str = "user_id",
               cell_columns: Sequence[str] = ()) -> DataFrame:
    """Attach many features with few shuffles of the rows.

    Those led by ``lead`` share one shuffle. The aggregates of the others are mostly small enough to
    be broadcast; those inside ``cell_columns``, which should have bounded domains, are taken from
    the distinct cells of these columns, so that the rows are read once for all of them. Small
    aggregates are looked up rather than joined.
    """
    led = [f for f in features if lead in f.keys and f.kind != "stddev"]
    rest = [f for f in features if f not in led]
    out = attach_windows(rows, led, lead) if led else rows
    packed = bool(led) and len({f.keys for f in rest}) > MAX_JOINS
    if packed:
        out = write_stage(pack(out, [f.name for f in led], "_led"), "windows")
    if rest:
        dates = {f.arg for f in rest if f.kind == "span"}
        cells = write_stage(collapse_to_cells(rows, sorted(cell_columns), dates), "cells") if cell_columns else None
        out = attach(out, rest, rows, (lead,), cells, lookups=True)
    if packed:
        out = unpack(out, ["_led"])
    return out.select(*rows.columns, *[f.name for f in features])


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct value, in order of appearance, and the number of each place's value."""
    number = pa.array(values).dictionary_encode().indices.to_numpy().astype(np.int64)
    first = np.empty(number.max(initial=-1) + 1, np.int64)
    first[number[::-1]] = np.arange(len(number) - 1, -1, -1)
    return first, number


class _Groups:
    """Measures of the rows with equal keys, over whole groups of rows that are in memory."""

    def __init__(self, table: pa.Table):
        self.table, self.rows = table, table.num_rows
        self.codes: dict[str, np.ndarray] = {}
        self.known: dict[tuple[str, ...], tuple[np.ndarray, np.ndarray]] = {}

    def code(self, column: str) -> np.ndarray:
        if column not in self.codes:
            self.codes[column] = coded(self.table.column(column))
        return self.codes[column]

    def of(self, keys: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
        """The first row of each group, and the group of each row."""
        if keys not in self.known:
            last = self.code(keys[-1])
            whole = self.of(keys[:-1])[1] * (last.max() + 1) + last if len(keys) > 1 else last
            self.known[keys] = _numbered(whole)
        return self.known[keys]

    def measure(self, f: Feature) -> pa.Array:
        first, group = self.of(f.keys)
        missing = np.logical_or.reduce([self.code(k) == 0 for k in f.keys])
        if f.kind == "count":
            value = np.bincount(group)
        elif f.kind == "distinct" and f.arg in f.keys:
            value = np.ones(len(first), np.int64)
        elif f.kind == "distinct":
            finer = self.of((*f.keys, f.arg))[0]
            value = np.bincount(group[finer[self.code(f.arg)[finer] > 0]], minlength=len(first))
        elif f.kind == "count_col":
            value = np.bincount(group[self.table.column(f.arg).is_valid().to_numpy()], minlength=len(first))
        elif f.kind == "stddev":
            numbers = self.table.column(f.arg)
            there, numbers = group[numbers.is_valid().to_numpy()], numbers.drop_null().to_numpy().astype(np.float64)
            n = np.bincount(there, minlength=len(first))
            mean = np.bincount(there, numbers, len(first)) / np.maximum(n, 1)
            squares = np.bincount(there, (numbers - mean[there]) ** 2, len(first))
            return pa.array(np.sqrt(squares / np.maximum(n - 1, 1))[group], mask=missing | (n < 2)[group])
        else:
            days = self.table.column(DAY + f.arg)
            dated, days = days.is_valid().to_numpy(), days.drop_null().to_numpy().astype(np.int64)
            low, high = np.full(len(first), np.iinfo(np.int64).max), np.full(len(first), np.iinfo(np.int64).min)
            np.minimum.at(low, group[dated], days)
            np.maximum.at(high, group[dated], days)
            missing, value = missing | (low > high)[group], np.where(low > high, 0, high - np.minimum(low, high))
        return pa.array(value[group].astype(np.int64), mask=missing)


def _whole_groups(batches: Iterable[pa.RecordBatch], lead: str) -> Iterator[pa.Table]:
    """Rows sorted by ``lead``, cut between its values into tables of about ``ROWS_AT_ONCE`` rows."""
    held, enough = [], ROWS_AT_ONCE
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= enough:
            table = pa.Table.from_batches(held)
            codes = coded(table.column(lead))
            cut = int(np.argmax(codes == codes[-1]))
            if cut:
                yield table.slice(0, cut)
                held, enough = table.slice(cut).to_batches(), ROWS_AT_ONCE
            enough = max(enough, 2 * sum(b.num_rows for b in held))
    if held:
        yield pa.Table.from_batches(held)


def _group_columns(df: DataFrame, features: Sequence[Feature], lead: str) -> DataFrame:
    """The features of rows that are partitioned by ``lead``, one sort on it for all; the caller has
    bounded the rows of every value."""
    columns = df.columns
    dates = sorted({f.arg for f in features if f.kind == "span"})
    names = [f.name for f in features]
    schema = StructType([*df.schema.fields, *[
        StructField(f.name, DoubleType() if f.kind == "stddev" else LongType()) for f in features]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups((b for b in batches if b.num_rows), lead):
            groups = _Groups(table)
            values = [groups.measure(f) for f in features]
            whole = pa.Table.from_arrays([*[table.column(c) for c in columns], *values], [*columns, *names])
            yield from whole.to_batches(max_chunksize=ROWS_IN_BATCH)

    days = [F.datediff(d, F.lit("1970-01-01")).alias(DAY + d) for d in dates]
    return df.sortWithinPartitions(lead).select(*columns, *days).mapInArrow(run, schema)


def attach_windows(df: DataFrame, features: Sequence[Feature], lead: str,
                   max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Attach features whose keys all contain ``lead`` with one shuffle and one sort on ``lead``.

    A task holds the rows of some values of ``lead`` at a time, in which all key sets are grouped, so that
    no rows are sorted again for each of them.

    Values of ``lead`` with more than ``max_rows`` rows (and NULL, which matches nothing) take the
    join path, where groups are combined before the shuffle and skewed partitions are split. The list
    of these values is a written table, which Spark broadcasts if it is small.
    """
    wrong = [f.name for f in features if lead not in f.keys]
    if wrong:
        raise ValueError(f"features without {lead!r} among their keys: {wrong}")
    # Lead column first, so that groups of few keys serve those of more.
    features = [Feature(f.name, (lead, *[k for k in f.keys if k != lead]), f.kind, f.arg, f.fill)
                for f in features]
    special = write_stage(
        df.groupBy(lead).agg(F.count(F.lit(1)).alias("_n"))
        .filter((F.col("_n") > max_rows) | F.col(lead).isNull()).select(lead), "heavy_values")
    if special.isEmpty():
        out = _group_columns(df.repartition(lead), features, lead)
    else:
        light = null_safe_join(df, special, [lead], "left_anti")
        heavy = null_safe_join(df, special, [lead], "left_semi")
        out = _group_columns(light.repartition(lead), features, lead).unionByName(attach(
            heavy, [Feature(f.name, f.keys, f.kind, f.arg) for f in features]))
    return out.select(*df.columns, *[_filled(f) for f in features])


def attach_grouping_sets(df: DataFrame, features: Sequence[Feature]) -> DataFrame:
    """Attach counts that one GROUPING SETS aggregation computes in a single pass over the rows."""
    if any(f.kind != "count" for f in features):
        raise ValueError("only counts are computed with grouping sets")
    columns = sorted({k for f in features for k in f.keys})
    sets = [[F.col(k) for k in columns if k in f.keys] for f in features]
    # Bit i of the grouping id is set when the i-th column from the right is rolled up.
    ids = [sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in f.keys) for f in features]
    grouped = write_stage(
        df.groupingSets(sets, *[F.col(c) for c in columns])
        .agg(F.grouping_id().alias("_set"), F.count(F.lit(1)).alias(ROWS)), "grouping_sets")
    tables = write_sets([
        grouped.filter((F.col("_set") == set_id) & _all_present(f.keys)).select(*f.keys, F.col(ROWS).alias(f.name))
        for f, set_id in zip(features, ids, strict=True)])
    out = df
    for f, counts in zip(features, tables, strict=True):
        out = join_groups(out, counts, f.keys)
    return out.select(*df.columns, *[_filled(f) for f in features])


def attach_stddev(df: DataFrame, features: Sequence[Feature], rounded: bool = False,
                  source: DataFrame | None = None) -> DataFrame:
    """Standard deviation per partition, in which rows with a NULL key form a partition of their own.

    The window form would put a whole region into one task. Here all partitions of all keys are
    aggregated in one pass over the rows (count, mean and squared deviations merge map-side), and a
    null-safe join gives the values of the window. ``rounded`` partitions numeric keys by the nearest
    whole number. ``source`` are the rows to aggregate, if others.
    """
    source = df if source is None else source
    sets = _finest_first(list(by_key_set(list(features)).values()), ("user_id",))
    wrong = [g[0].keys for g in sets if len(g[0].keys) > 1]
    if wrong:
        raise ValueError(f"a partition has one key, not {wrong}")
    part = [(whole_number(g[0].keys[0]) if rounded else F.col(g[0].keys[0])).alias(f"_part_{i}") for i, g in enumerate(sets)]
    values = sorted({f.arg for f in features})
    keyed = source.select(*part, *[F.col(v).alias(f"_value_{v}") for v in values])
    names = [f"_part_{i}" for i in range(len(sets))]
    # Bit i of the grouping id is set when the i-th column from the right is rolled up.
    whole = (1 << len(names)) - 1
    grouped = keyed.groupingSets([[F.col(n)] for n in names], *[F.col(n) for n in names]).agg(
        F.grouping_id().alias("_id"), *[F.stddev_samp(f"_value_{v}").alias(f"_std_{v}") for v in values])
    ids = F.create_map(*[F.lit(x) for i in range(len(names)) for x in (whole - (1 << len(names) - 1 - i), i)])
    path = new_stage_path(source.sparkSession, "moments")
    with freeing_shuffles(source.sparkSession):
        grouped.withColumn("_set", ids[F.col("_id")].cast("int")).drop("_id").write.partitionBy("_set").parquet(path)
    schema = grouped.drop("_id").schema
    out = df
    for i, (group, at) in enumerate(zip(sets, names, strict=True)):
        stats = read_set(source.sparkSession, path, i, schema).select(at, *[F.col(f"_std_{f.arg}").alias(f.name) for f in group])
        out = join_groups(out.withColumn(at, whole_number(group[0].keys[0]) if rounded else F.col(group[0].keys[0])),
                          stats, [at], null_safe=True).drop(at)
    return out.select(*df.columns, *[_filled(f) for f in features])


def whole_number(column: str) -> Column:
    """A float as a whole number, halves rounded away from zero."""
    return F.round(F.col(column)).cast("bigint")
