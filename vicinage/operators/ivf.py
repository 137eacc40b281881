"""Inverted-file search: cells around centroids, of which a query probes the nearest.

Float cells rank and return **squared** L2; binary cells rank and return bits.
``fit`` writes the points, with their cell, once: partitioned by cell, a large cell in
several files, so that a search reads the cells that its queries probe and no others.
Cell numbers are those of the centroids throughout; an empty cell simply has no points.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vicinage.functions.metrics import distance
from vicinage.operators.exact import block_distances, check_k, collected, dimension, fits, nearest, smaller_broadcast, top_k, vectors_of
from vicinage.operators.kmeans import binary_kmeans, centroid_rows, kmeans, with_cells
from vicinage.sources.staging import Staged
from vicinage.sources.storage import clustered, load_table, save_table


@dataclass
class IVFIndex:
    """``metric`` is ``l2sq`` or ``hamming``; ``dim`` counts components or words."""

    n_clusters: int = 100
    n_probe: int = 10
    metric: str = "l2sq"
    max_iter: int = 20
    dim: int = 0
    centroids: list[list] = field(default_factory=list)
    sizes: dict[int, int] = field(default_factory=dict)
    points: DataFrame | None = field(default=None, repr=False)

    def __post_init__(self):
        self.n_probe = min(self.n_probe, self.n_clusters)

    def fit(self, data: DataFrame, *, centroids: list[list] | None = None, seeds: str = "parallel") -> IVFIndex:
        """Build from ``id, vec``; the number of cells is at most that of the rows."""
        self.dim = dimension(data, "vec")
        k = min(self.n_clusters, data.limit(self.n_clusters).count())
        self.n_clusters, self.n_probe = k, min(self.n_probe, k)
        if centroids is None:
            build = binary_kmeans(data, k, self.dim, max_iter=self.max_iter, seeds=seeds) if self.metric == "hamming" else kmeans(data, k, max_iter=self.max_iter, dim=self.dim, seeds=seeds)
            centroids = build.centroids
        self.centroids = centroids
        placed = with_cells(data, centroids, self.metric).select("id", "vec", "cell")
        self.sizes = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # one row a cell
        self.points = Staged(clustered(placed, "cell", self.sizes), "ivf", partition_by="cell").df
        return self

    def set_nprobe(self, n_probe: int) -> IVFIndex:
        """Cells that a search probes from now on, at most all."""
        if n_probe < 1:
            raise ValueError("n_probe must be at least 1")
        self.n_probe = min(n_probe, len(self.centroids) or self.n_clusters)
        return self

    @property
    def nlist(self) -> int:
        return len(self.centroids)

    def probes(self, queries: DataFrame, n_probe: int | None = None) -> DataFrame:
        """``qid, q, cell``: the nearest cells of each query, ties by cell number."""
        n_probe = min(n_probe or self.n_probe, len(self.centroids))
        cells = centroid_rows(queries.sparkSession, self.centroids)
        if not fits(len(self.centroids), self.dim):
            raise ValueError("the centroids are too many to be broadcast")
        ranked = queries.crossJoin(F.broadcast(cells)).withColumn("cd", distance(self.metric, F.col("q"), F.col("centroid"), self.dim))
        order = Window.partitionBy("qid").orderBy("cd", "cell")
        return ranked.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n_probe).select("qid", "q", "cell")

    def search(self, queries: DataFrame, k: int, n_probe: int | None = None) -> DataFrame:
        """``qid, id, distance, rank``; fewer than ``k`` rows where the probed cells
        hold fewer.  Probing every cell is exact.

        Queries that fit travel with a function that scans the probed cells batch by
        batch; more of them are joined with the points by cell."""
        check_k(k)
        if self.points is None:
            raise RuntimeError("index is not built")
        n_probe = min(n_probe or self.n_probe, len(self.centroids))
        if fits(queries.count(), self.dim):
            return top_k(self._scan(queries, k, n_probe), k)
        sent = smaller_broadcast(self.probes(queries, n_probe), self.dim)
        near = self.points.join(sent, "cell").select("qid", "id", distance(self.metric, F.col("q"), F.col("vec"), self.dim).alias("distance"))
        return top_k(near, k)

    def _scan(self, queries: DataFrame, k: int, n_probe: int) -> DataFrame:
        qids, matrix = collected(queries, self.metric)
        whole, metric = self.metric == "hamming", self.metric
        centroids = np.array(self.centroids, matrix.dtype)
        asking: dict[int, np.ndarray] = {}  # cell -> places of the queries that probe it
        if len(qids):
            near = np.vstack([np.argsort(block_distances(metric, matrix[at : at + 256], centroids), axis=1, kind="stable")[:, :n_probe] for at in range(0, len(qids), 256)])
            asking = {int(c): np.flatnonzero((near == c).any(1)) for c in np.unique(near)}
        points = self.points.where(F.col("cell").isin(list(asking))) if len(asking) < len(centroids) else self.points

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cells = batch.column(2).to_numpy()
                for cell in np.unique(cells):
                    some, which = batch.filter(pa.array(cells == cell)), asking.get(int(cell))
                    if which is not None:
                        for q, i, d in nearest(metric, qids[which], matrix[which], some.column(0).to_numpy(), vectors_of(some.column(1), metric), k, False):
                            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(i), pa.array(d.astype(np.int64) if whole else d)], names=["qid", "id", "distance"])

        return points.select(F.col("id").cast("long").alias("id"), "vec", F.col("cell").cast("int").alias("cell")).mapInArrow(run, f"qid long, id long, distance {'long' if whole else 'double'}")

    def search1(self, queries: DataFrame) -> DataFrame:
        return self.search(queries, 1)

    def save(self, path: str) -> None:
        if self.points is None:
            raise RuntimeError("index is not built")
        meta = {"kind": "ivf", "n_clusters": self.n_clusters, "n_probe": self.n_probe, "metric": self.metric, "dim": self.dim, "centroids": self.centroids, "sizes": sorted(self.sizes.items())}
        save_table(clustered(self.points, "cell", self.sizes), path, partition_by="cell", meta=meta)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IVFIndex:
        points, meta = load_table(spark, path, kind="ivf")
        return cls(meta["n_clusters"], meta["n_probe"], meta["metric"], dim=meta["dim"], centroids=meta["centroids"], sizes={int(c): n for c, n in meta["sizes"]}, points=points)
