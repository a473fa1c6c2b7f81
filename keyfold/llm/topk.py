"""Exact top-k search by inner product: a Voronoi k-nearest-neighbour join.

Largest inner product becomes smallest distance by one more coordinate: with M the largest norm of
the data, a point ``s`` gets the coordinate ``sqrt(M*M - |s|^2)`` and a query 0, after which
``|q - s|^2 = |q|^2 + M^2 - 2 q.s``.

1. Pivots are a bounded sample of the data. Every point belongs to the cell of its nearest pivot;
   a summary holds the number of points and the radius of each cell.
2. Each query gets an upper bound on the distance of its k-th neighbour, from its distances to the
   pivots (which are points themselves) and from the cells' counts and radii. Queries of nearby
   cells form a group, and for each cell a group has the range of distances to the pivot outside of
   which no point can be among the answers; cells behind a far hyperplane drop out.
3. Points are sent only to the groups whose range they fall into. A group is a grid of blocks of
   queries and pieces of points, so no task gets more than a stated number of either, and each unit
   is solved by one matrix product. The best of the units are ranked per query.

The driver sees the pivots, one row per cell, and one row per pair of group and cell.

Cases: vectors that are null or hold null or non-finite components take no part, nor do rows without
an id; shorter vectors count as padded with zeros; a point never answers a query with its own id;
queries with one id are asked once; equal scores rank by id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyfold.session import write_stage

# Pivots bound what is broadcast: PIVOTS vectors, and PIVOTS * PIVOTS ranges.
PIVOTS = 128
# Queries and points in one unit.
QUERY_BLOCK, POINT_PIECE = 128, 2048
# Slack for rounding in distances, as a share of the largest norm.
SLACK = 1e-6


def integer_vectors(vectors: DataFrame, scale: float) -> DataFrame:
    """``(vec_id, v)`` with ``floor(scale * x)`` of each component, as bytes of 64-bit integers."""
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: (
        x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    rows = vectors.filter(usable).select("vec_id", F.transform(
        "embedding", lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v"))
    return rows.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def _matrix(column, dims: int) -> np.ndarray:
    out = np.zeros((len(column), dims))
    for i, v in enumerate(column):
        out[i, :len(v)] = v
    return out


class _Cells:
    """Pivots with the summaries that bounds are derived from."""

    def __init__(self, pivots: np.ndarray, largest: float):
        self.points, self.largest, self.slack = pivots, largest, SLACK * (largest + 1.0)
        self.heights = np.sqrt(np.maximum(largest ** 2 - (pivots ** 2).sum(1), 0.0))
        self.counts = self.radii = self.between = None

    def of_points(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest pivot and the distance to it."""
        height = np.sqrt(np.maximum(self.largest ** 2 - (v ** 2).sum(1), 0.0))
        square = 2 * self.largest ** 2 - 2 * (v @ self.points.T + height[:, None] * self.heights[None, :])
        cell = square.argmin(1)
        return cell, np.sqrt(np.maximum(square[np.arange(len(v)), cell], 0.0))

    def of_queries(self, v: np.ndarray) -> np.ndarray:
        """Distances of queries to all pivots."""
        return np.sqrt(np.maximum((v ** 2).sum(1)[:, None] + self.largest ** 2 - 2 * v @ self.points.T, 0.0))

    def summarised(self, counts: np.ndarray, radii: np.ndarray) -> _Cells:
        self.counts, self.radii = counts, radii
        full = np.hstack([self.points, self.heights[:, None]])
        self.between = np.sqrt(np.maximum(
            (full ** 2).sum(1)[:, None] + (full ** 2).sum(1)[None, :] - 2 * full @ full.T, 0.0))
        return self

    def reach(self, distances: np.ndarray, k: int) -> np.ndarray:
        """Upper bound on the distance of each query's k-th neighbour other than itself."""
        bound = np.full(len(distances), np.inf)
        if distances.shape[1] > k:
            bound = np.partition(distances, k, axis=1)[:, k]
        far = distances + self.radii[None, :]
        order = far.argsort(1)
        enough = np.cumsum(self.counts[order], axis=1) > k
        reached = np.take_along_axis(far, order, 1)[np.arange(len(far)), enough.argmax(1)]
        return np.where(enough.any(1), np.minimum(bound, reached), bound) + self.slack

    def needed(self, distances: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """Whether a query may have answers in a cell, by the cell's radius and hyperplane."""
        own = distances.argmin(1)
        gap = self.between[own]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (distances ** 2 - distances[np.arange(len(own)), own][:, None] ** 2) / (2 * gap)
        plane = np.where(gap > self.slack, plane, 0.0)
        near = np.maximum(plane, distances - self.radii[None, :]) - self.slack
        return (near <= reach[:, None]) & (self.counts[None, :] > 0)


def _grouped_cells(cells: _Cells, queries: np.ndarray, size: int) -> np.ndarray:
    """Group of each cell: cells are chained from neighbour to neighbour and cut every ``size`` queries."""
    group, at, held, left = np.zeros(len(queries), np.int64), 0, 0, set(range(1, len(queries)))
    number = 0
    while True:
        if held and held + queries[at] > size:
            number, held = number + 1, 0
        group[at] = number
        held += queries[at]
        if not left:
            return group
        rest = np.array(sorted(left))
        at = int(rest[cells.between[at, rest].argmin()])
        left.discard(at)


def top_k(vectors: DataFrame, is_query: Column, k: int, scale: float = 64.0, pivots: int = PIVOTS,
          query_block: int = QUERY_BLOCK, point_piece: int = POINT_PIECE) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` largest inner products of each query.

    vectors: ``(vec_id, embedding)``; ``is_query`` is a condition on ``vec_id``.
    """
    spark = vectors.sparkSession
    points = write_stage(integer_vectors(vectors.select("vec_id", "embedding"), scale), "points")
    result = "query_id long, vec_id long, score long"
    dims, largest = points.agg(F.max(F.size("v")), F.max("norm2")).first()
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims, largest = max(dims, 1), float(np.sqrt(largest))
    exact = largest ** 2 < 2 ** 52  # all sums of products are exact in floating point
    chosen = points.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()
    base = _Cells(_matrix([r["v"] for r in chosen], dims), largest)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            v = _matrix(f["v"], dims)
            cell, distance = base.of_points(v)
            home = base.of_queries(v).argmin(1)
            yield pd.DataFrame({"vec_id": f["vec_id"], "cell": cell, "distance": distance, "home": home,
                                "v": [np.asarray(x, np.int64).tobytes() for x in f["v"]]})

    placed = write_stage(points.select("vec_id", "v").mapInPandas(
        assign, "vec_id long, cell long, distance double, home long, v binary"), "cells")
    queries = placed.filter(is_query).dropDuplicates(["vec_id"])
    counts, radii, asked = (np.zeros(len(chosen)) for _ in range(3))
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("d")).collect():
        counts[r["cell"]], radii[r["cell"]] = r["n"], r["d"]
    for r in queries.groupBy("home").agg(F.count(F.lit(1)).alias("n")).collect():
        asked[r["home"]] = r["n"]
    cells = base.summarised(counts, radii)
    group_of = _grouped_cells(cells, asked, query_block)

    def ranges(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            distances = cells.of_queries(_matrix([np.frombuffer(b, np.int64) for b in f["v"]], dims))
            reach = cells.reach(distances, k)
            q, cell = np.nonzero(cells.needed(distances, reach))
            yield pd.DataFrame({"grp": group_of[f["home"].to_numpy()[q]], "cell": cell,
                                "low": distances[q, cell] - reach[q], "high": distances[q, cell] + reach[q]}
                               ).groupby(["grp", "cell"], as_index=False).agg({"low": "min", "high": "max"})

    told = write_stage(queries.select("home", "v").mapInPandas(
        ranges, "grp long, cell long, low double, high double").groupBy("grp", "cell").agg(
        F.min("low").alias("low"), F.max("high").alias("high")), "ranges")
    rows = told.collect()
    sent = np.zeros(len(chosen))
    for r in rows:
        sent[r["grp"]] += counts[r["cell"]]
    share = np.bincount(group_of, weights=asked, minlength=len(chosen))
    grid = spark.createDataFrame(
        [(g, int(-(-share[g] // query_block)), int(-(-sent[g] // point_piece))) for g in range(len(chosen)) if sent[g]],
        "grp long, blocks int, pieces int")
    homes = spark.createDataFrame([(i, int(g)) for i, g in enumerate(group_of)], "home long, grp long")
    named = queries.select("home", F.col("vec_id").alias("query_id"), F.col("v").alias("asked"))
    of_query = named.join(F.broadcast(homes), "home").join(F.broadcast(grid), "grp").select(
        "grp", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), "query_id", "asked")
    within = F.broadcast(told.join(F.broadcast(grid), "grp"))
    of_point = placed.join(within, "cell").filter("distance BETWEEN low AND high").select(
        "grp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.pmod(F.xxhash64("vec_id"), F.col("pieces")).cast("int").alias("piece"), "vec_id", "v")

    def solve(q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(s):
            kind = np.float64 if exact else np.int64
            a, b = (_matrix([np.frombuffer(x, np.int64) for x in column], dims).astype(kind)
                    for column in (q["asked"], s["v"]))
            ids, scores = s["vec_id"].to_numpy(), a @ b.T
            for query_id, line in zip(q["query_id"].tolist(), scores, strict=True):
                other = np.flatnonzero(ids != query_id)
                if len(other) > k:
                    least = np.partition(line[other], len(other) - k)[len(other) - k]
                    other = other[line[other] >= least]
                best = other[np.lexsort((ids[other], -line[other]))][:k]
                out.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[best], "score": line[best].astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    unit = ["grp", "block", "piece"]
    found = of_query.groupBy(unit).cogroup(of_point.groupBy(unit)).applyInPandas(solve, result)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
