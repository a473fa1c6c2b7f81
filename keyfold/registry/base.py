"""Registration of queries, the shared item stage, and helpers that write SQL twins."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.features.spec import Feature
from keyfold.session import write_stage
from keyfold.sources.items import ITEMS_SQL, items, read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

_STAGED: dict[tuple[str, str, str], DataFrame] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with the SQL that gives the same rows where there is one."""
    def register(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run
    return register


def staged_once(name: str, sf_dir: str, spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """A stage table that many queries scan, written once per session."""
    at = (spark.sparkContext.applicationId, sf_dir, name)
    if at not in _STAGED:
        _STAGED[at] = write_stage(build(), name)
    return _STAGED[at]


def staged(name: str, sf_dir: str, spark: SparkSession) -> DataFrame | None:
    """The stage table of that name, if it has been written."""
    return _STAGED.get((spark.sparkContext.applicationId, sf_dir, name))


def item_stage(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The items as a stage table, for queries that scan them more than once; of ``columns`` only, if given
    and if no table of all columns is there already."""
    whole = (spark.sparkContext.applicationId, sf_dir, "items")
    if not columns or whole in _STAGED:
        return staged_once("items", sf_dir, spark, lambda: items(spark, sf_dir))
    kept = sorted(set(columns))
    return staged_once(f"items-{hashlib.md5(','.join(kept).encode()).hexdigest()[:8]}", sf_dir, spark,
                       lambda: items(spark, sf_dir).select(*kept))


def item_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items for a query that scans them once: the stage table, if there is one, or else the view, of
    which only the columns in use are shuffled and nothing is written."""
    return _STAGED.get((spark.sparkContext.applicationId, sf_dir, "items")) or items(spark, sf_dir)


def r6(column: str | Column, name: str | None = None) -> Column:
    """Round a float result, whose last digits depend on the order of addition."""
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c, 6).alias(name or column)


def with_items(body: str, extra: str = "") -> str:
    return f"WITH items AS ({ITEMS_SQL}){extra}\n{body}"


def measure_sql(f: Feature) -> str:
    return {
        "count": "count(*)",
        "count_col": f"count({f.arg})",
        "distinct": f"count(DISTINCT {f.arg})",
        "span": f"date_diff('day', min({f.arg}), max({f.arg}))",
        "stddev": f"stddev_samp({f.arg})",
    }[f.kind]


def attach_sql(target: str, features: Sequence[Feature], source: str = "items", columns: str = "t.*") -> str:
    """Plain form of attaching features: one aggregate and one left join per key tuple."""
    groups: dict[tuple[str, ...], list[Feature]] = {}
    for f in features:
        groups.setdefault(f.keys, []).append(f)
    selected, joins = [], []
    for i, (keys, group) in enumerate(groups.items()):
        for f in group:
            value = f"a{i}.{f.name}" if f.fill is None else f"coalesce(a{i}.{f.name}, {f.fill})"
            selected.append(f"{value} AS {f.name}")
        measures = ", ".join(f"{measure_sql(f)} AS {f.name}" for f in group)
        key_list = ", ".join(keys)
        on = " AND ".join(f"t.{k} = a{i}.{k}" for k in keys)
        joins.append(f"LEFT JOIN (SELECT {key_list}, {measures} FROM {source} GROUP BY {key_list}) a{i} ON {on}")
    head = ", ".join([c for c in [columns] if c] + selected)
    return f"SELECT {head}\nFROM {target} t\n" + "\n".join(joins)
