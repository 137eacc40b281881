"""Exact search with cells around pivots: metric pruning as joins.

Every row belongs to its nearest pivot and, by the median of the distances there, to
the inner or the outer half: a cell is a half, with its smallest and largest distance
to the pivot.  ``fit`` writes the rows once, those of a cell together.  Phase 1 scans
each query's nearest cells until they hold ``k`` rows and takes the k-th distance
found; phase 2 scans only cells whose lower bound (triangle inequality on the smallest
and largest distance; for L2 also the hyperplane between two pivots) does not exceed
it.  Valid for L2, L1, L-infinity and Hamming, not for squared L2.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinage.functions.metrics import distance, resolve
from vicinage.operators.exact import bucketed, check_k, dimension, fits, top_k, vectors_of
from vicinage.operators.kernel import exact_distances
from vicinage.operators.kmeans import with_cells
from vicinage.sources.staging import Staged
from vicinage.sources.storage import clustered, load_table, save_table

#: Slack that rounding may take from a bound.
EPSILON = 1e-9


def spread_pivots(data: DataFrame, n: int, metric: str, dim: int, *, pool: int = 5, probes: int = 64) -> list[list]:
    """``n`` pivots: of ``pool * n`` drawn rows those whose distances to a bounded
    sample vary most, as a vantage point should."""
    drawn = data.orderBy(F.xxhash64("id"), "id").limit(pool * n + probes)
    sample = drawn.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(probes).select(F.col("vec").alias("s"))  # `probes` rows are broadcast
    picked = drawn.limit(pool * n).crossJoin(F.broadcast(sample)).groupBy("id").agg(F.var_pop(distance(metric, F.col("vec"), F.col("s"), dim)).alias("spread"), F.first("vec").alias("vec"))
    return [list(r["vec"]) for r in picked.orderBy(F.desc("spread"), "id").limit(n).collect()]


@dataclass
class PivotIndex:
    """``cells``: one tuple a cell: number, pivot, smallest and largest distance, rows."""

    metric: str = "l2"
    n_pivots: int = 16
    dim: int = 0
    cells: list[tuple] = field(default_factory=list, repr=False)
    points: DataFrame | None = field(default=None, repr=False)

    def __post_init__(self):
        self.metric = resolve(self.metric)
        if self.metric == "l2sq":
            raise ValueError("squared L2 is no metric; use l2")

    def fit(self, data: DataFrame, pivots: list[list] | None = None) -> PivotIndex:
        """Build from ``id, vec``; without rows the index is empty."""
        self.dim = dimension(data, "vec")
        whole = self.metric == "hamming"
        pivots = [[int(x) if whole else float(x) for x in p] for p in pivots or spread_pivots(data, self.n_pivots, self.metric, self.dim)]
        if not pivots:
            self.cells, self.points = [], data.select("id", "vec", F.lit(0).alias("cell"))
            return self
        if not fits(len(pivots), self.dim):
            raise ValueError("the pivots are too many to be broadcast")
        near = with_cells(data, pivots, self.metric)
        halves = {r["cell"]: (r["median"], r["n"]) for r in near.groupBy("cell").agg(F.percentile_approx("distance", 0.5).alias("median"), F.count("*").alias("n")).collect()}  # one row a pivot
        median = F.create_map(*[F.lit(x) for cell, (m, _) in halves.items() for x in (cell, float(m))])
        placed = near.select("id", "vec", "distance", (2 * F.col("cell") + (F.col("distance") > median[F.col("cell")]).cast("int")).alias("cell"))
        sizes = {2 * cell + half: -(-n // 2) for cell, (_, n) in halves.items() for half in (0, 1)}
        points = Staged(clustered(placed, "cell", sizes), "pivots").df
        found = points.groupBy("cell").agg(F.min("distance").alias("lo"), F.max("distance").alias("hi"), F.count("*").alias("n")).collect()
        self.cells = sorted((r["cell"], pivots[r["cell"] // 2], float(r["lo"]), float(r["hi"]), r["n"]) for r in found)
        self.points = points.select("id", "vec", "cell")
        return self

    def cell_table(self, spark: SparkSession) -> DataFrame:
        """``cell, pivot, r_min, r_max, n``."""
        kind = "long" if self.metric == "hamming" else "double"
        return spark.createDataFrame(self.cells, f"cell int, pivot array<{kind}>, r_min double, r_max double, n long")

    def _bounds(self, queries: DataFrame, need: int | None = None) -> DataFrame:
        """``qid, q, cell, dp, lb, n, most``: bounds of the cells for every query: of
        all, of the nearest ones that hold ``need`` rows, or, where queries have a
        ``tau`` (null: none), of those that it reaches."""
        numbers, sizes = (np.array([c[i] for c in self.cells], kind) for i, kind in ((0, np.int32), (4, np.int64)))
        pivots = np.array([c[1] for c in self.cells], np.int64 if self.metric == "hamming" else np.float64)
        lo, hi = (np.array([c[i] for c in self.cells], np.float64) for i in (2, 3))
        metric, by_tau = self.metric, "tau" in queries.columns
        to_pivots = lambda q: np.stack([exact_distances(metric, q, np.broadcast_to(p, q.shape)) for p in pivots], 1)
        between = to_pivots(pivots) if len(pivots) and metric == "l2" else None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows if len(numbers) else 0, 256):
                    batch = whole.slice(at, 256)
                    dp = to_pivots(vectors_of(batch.column(1), metric))
                    lb = np.maximum(0.0, np.maximum(dp - hi, lo - dp))
                    if metric == "l2":
                        own = dp.argmin(1)
                        apart, own_d = between[own], dp[np.arange(len(dp)), own][:, None]
                        lb = np.maximum(lb, np.where(apart > 0, (dp * dp - own_d * own_d) / np.where(apart > 0, 2 * apart, 1.0), 0.0))
                    most = np.full(len(dp), np.inf)
                    keep = np.ones(dp.shape, bool)
                    if by_tau:
                        tau = batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
                        most = np.where(np.isnan(tau), np.inf, tau + EPSILON * (1 + np.abs(tau)))
                        keep = lb <= most[:, None]
                    if need is not None:
                        order = np.lexsort((np.broadcast_to(numbers, dp.shape), dp, lb))
                        held = sizes[order]
                        np.put_along_axis(keep, order, held.cumsum(1) - held < need, 1)
                    r, c = np.nonzero(keep)
                    rows = pa.array(r)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(numbers[c]), pa.array(dp[r, c]), pa.array(lb[r, c]), pa.array(sizes[c]), pa.array(most[r])], names=["qid", "q", "cell", "dp", "lb", "n", "most"])

        source = queries.select(F.col("qid").cast("long").alias("qid"), "q", *(["tau"] if by_tau else []))
        return source.mapInArrow(run, f"qid long, q {source.schema['q'].dataType.simpleString()}, cell int, dp double, lb double, n long, most double")

    def search(self, queries: DataFrame, k: int, *, exclude_self: bool = False) -> DataFrame:
        check_k(k)
        if self.points is None:
            raise RuntimeError("index is not built")
        n = queries.count()
        first = self._bounds(queries, k + 1 if exclude_self else k)
        tau = top_k(self._scan(first, n, k, exclude_self), k).groupBy("qid").agg(F.max(F.when(F.col("rank") == k, F.col("distance"))).alias("tau"))
        kept = self._bounds(queries.select("qid", "q").join(tau, "qid", "left"))
        return top_k(self._scan(kept, n, k, exclude_self), k)

    def _scan(self, sent: DataFrame, n: int, k: int, exclude_self: bool) -> DataFrame:
        """The ``k`` nearest rows of each cell that a query is sent to."""
        points = self.points.select("id", "vec", F.col("cell").alias("bucket"))
        return bucketed(sent.select("qid", "q", F.col("cell").alias("bucket"), "most"), points, {c[0]: (n, c[4]) for c in self.cells}, self.metric, self.dim, k=k, exclude_self=exclude_self)

    def scanned_share(self, queries: DataFrame, k: int) -> float:
        """Share of point-query pairs that phase 2 would look at, of all pairs."""
        total = self.points.count() * queries.count()
        bounds = self._bounds(queries)
        tau = self.search(queries, k).groupBy("qid").agg(F.max("distance").alias("tau"))
        seen = bounds.join(tau, "qid").where("lb <= tau").agg(F.sum("n")).first()[0] or 0
        return seen / total if total else 0.0

    def save(self, path: str) -> None:
        if self.points is None:
            raise RuntimeError("index is not built")
        save_table(clustered(self.points, "cell", {c[0]: c[4] for c in self.cells}), path, meta={"kind": "pivots", "metric": self.metric, "n_pivots": self.n_pivots, "dim": self.dim, "cells": self.cells})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PivotIndex:
        points, meta = load_table(spark, path, kind="pivots")
        return cls(meta["metric"], meta["n_pivots"], meta["dim"], [tuple(c) for c in meta["cells"]], points)
