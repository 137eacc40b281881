"""K-means on float vectors and on binary descriptors, by DataFrame rounds.

Centroids are few and live on the driver; the points stay distributed.  A round is
one narrow pass over Arrow batches in which each partition sums up its cells, and an
aggregate of one row a cell and partition.  Seeds are drawn by k-means|| (a few passes,
each of which draws twice as many rows as seeds, with chances that follow their cost,
and a weighted k-means++ among what was drawn), or are the ``k`` smallest ids, or a
farthest-first walk.  Draws go by hashes of ids, so runs repeat exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinage.functions.binary import WORD_BITS
from vicinage.operators.exact import block_distances, dimension, vectors_of


def centroid_rows(spark: SparkSession, centroids: list[list]) -> DataFrame:
    """``cell, centroid``."""
    kind = "array<double>" if not centroids or isinstance(centroids[0][0], float) else "array<long>"
    return spark.createDataFrame([(k, list(c)) for k, c in enumerate(centroids)], f"cell int, centroid {kind}")


@dataclass
class Clusters:
    """``labels``: ``id, cell``; ``centroids``: one list a cell, by cell number."""

    labels: DataFrame
    centroids: list[list[float]]

    def centroid_rows(self) -> DataFrame:
        return centroid_rows(self.labels.sparkSession, self.centroids)


#: Vector pairs whose distances are held at once; passes of k-means||, and rows a pass draws for each seed.
PAIRS, PASSES, DRAWN = 1 << 18, 3, 2


def cell_distances(x: np.ndarray, centroids: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each row, ties to the lowest, and its distance."""
    cells, away = np.empty(len(x), np.int32), np.empty(len(x))
    step = max(1, PAIRS // max(1, centroids.size))
    for at in range(0, len(x), step):
        some = x[at : at + step]
        d = ((some[:, None, :] - centroids[None]) ** 2).sum(2) if metric in ("l2", "l2sq") else block_distances(metric, some, centroids)
        cells[at : at + step] = d.argmin(1)
        away[at : at + step] = np.sqrt(d.min(1)) if metric == "l2" else d.min(1)
    return cells, away


def with_cells(data: DataFrame, centroids: list[list], metric: str = "l2sq") -> DataFrame:
    """``id, vec, cell, distance``, in one narrow pass over Arrow batches; the
    centroids travel with the function."""
    c = np.array(centroids, np.int64 if metric == "hamming" else np.float64)
    source = data.select("id", "vec")
    unit = "long" if metric == "hamming" else "double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if rows.num_rows:
                cells, away = cell_distances(vectors_of(rows.column(1), metric), c, metric)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(cells), pa.array(away.astype(np.int64) if unit == "long" else away)], names=["id", "vec", "cell", "distance"])

    ids, vec = source.schema["id"].dataType.simpleString(), source.schema["vec"].dataType.simpleString()
    return source.mapInArrow(run, f"id {ids}, vec {vec}, cell int, distance {unit}")


def assign(data: DataFrame, centroids: list[list], metric: str = "l2sq") -> DataFrame:
    """``id, cell, distance`` of the nearest centroid, ties to the lowest cell."""
    return with_cells(data, centroids, metric).select("id", "cell", "distance")


def parallel_seeds(data: DataFrame, k: int, metric: str, *, seed: int = 42) -> list[list]:
    """Seeds by k-means||.  A row's cost is its squared distance to the nearest
    candidate, or its distance in bits.  A pass is one job: it draws the ``DRAWN * k``
    rows with the smallest exponential variate of their cost, that is, a weighted draw
    without replacement, and only these reach the driver."""
    unit = lambda salt: (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "id"), F.lit(1 << 31)) + 1) / float(1 << 31)
    candidates = [list(r["vec"]) for r in data.orderBy(unit(0), "id").limit(1).collect()]
    for number in range(1, PASSES + 1):
        costs = with_cells(data, candidates, metric).where("distance > 0")
        hit = costs.orderBy(-F.log(unit(number)) / F.col("distance"), "id").limit(DRAWN * k).select("vec").collect()
        if not hit:  # every row equals a candidate
            break
        candidates += [list(r["vec"]) for r in hit]
    candidates = [list(c) for c in dict.fromkeys(map(tuple, candidates))]
    if len(candidates) <= k:  # fewer different rows than that were drawn: the farthest complete them
        return _farthest(data, candidates, k, metric)
    counts = {r["cell"]: r["count"] for r in assign(data, candidates, metric).groupBy("cell").count().collect()}
    x = np.array(candidates, np.int64 if metric == "hamming" else np.float64)
    weights = np.array([counts.get(c, 0) for c in range(len(x))], np.float64)
    rng = np.random.default_rng(seed)
    chosen = [int(weights.argmax())]
    cost = block_distances(metric, x[chosen], x)[0]
    while len(chosen) < k:
        chance = weights * cost
        if not chance.sum():  # what is left has no weight or no distance: any that is not chosen yet
            chance = np.array([float(c not in chosen) for c in range(len(x))])
        chosen.append(int(rng.choice(len(x), p=chance / chance.sum())))
        cost = np.minimum(cost, block_distances(metric, x[chosen[-1:]], x)[0])
    return [candidates[c] for c in chosen]


def _farthest(data: DataFrame, seeds: list[list], k: int, metric: str) -> list[list]:
    while seeds and len(seeds) < k:
        far = with_cells(data, seeds, metric).orderBy(F.desc("distance"), "id").limit(1).first()
        seeds.append(list(far["vec"]))
    return seeds


def _seeds(data: DataFrame, k: int, metric: str, how: str) -> list[list]:
    if how == "parallel":
        return parallel_seeds(data, k, metric)
    if how not in ("first", "farthest"):
        raise ValueError(f"unknown seeds: {how!r}; 'parallel', 'first' or 'farthest'")
    seeds = [list(r["vec"]) for r in data.orderBy("id").limit(k if how == "first" else 1).collect()]
    return _farthest(data, seeds, k, metric)


def check_clusters(data: DataFrame, k: int) -> None:
    n = data.limit(max(k, 1)).count()
    if not 1 <= k <= n:
        raise ValueError("k must be between 1 and the number of rows")


def kmeans(data: DataFrame, k: int, *, max_iter: int = 100, seeds: str | list[list[float]] = "parallel", dim: int | None = None) -> Clusters:
    """Lloyd's rounds until no label changes or ``max_iter`` is reached.  An empty
    cell takes the row that lies farthest from its centroid."""
    check_clusters(data, k)
    dim = dimension(data, "vec") if dim is None else dim
    data = data.select("id", F.transform("vec", lambda x: x.cast("double")).alias("vec"))
    centroids = [list(map(float, c)) for c in (_seeds(data, k, "l2sq", seeds) if isinstance(seeds, str) else seeds)]
    for _ in range(max_iter):
        sums = cell_sums(data, centroids, dim, "l2sq")
        found = {r["cell"]: [x / r["n"] for x in r["sums"]] for r in sums.collect()}  # one row a cell
        after = _completed(data, centroids, found, "l2sq")
        if after == centroids:
            break
        centroids = after
    return Clusters(assign(data, centroids).select("id", "cell"), centroids)


def cell_sums(data: DataFrame, centroids: list[list], width: int, metric: str) -> DataFrame:
    """``cell, n, sums`` of the cells that have rows: sums of components, or of each
    bit.  Each partition sends one row a cell."""
    c = np.array(centroids, np.int64 if metric == "hamming" else np.float64)
    bits = metric == "hamming"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(len(c), np.int64), np.zeros((len(c), width), np.int64 if bits else np.float64)
        for rows in batches:
            if rows.num_rows:
                x = vectors_of(rows.column(1), metric)
                cells, _ = cell_distances(x, c, metric)
                n += np.bincount(cells, minlength=len(c))
                np.add.at(sums, cells, ((x[:, :, None] >> np.arange(WORD_BITS)) & 1).reshape(len(x), -1) if bits else x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(c), dtype=np.int32)), pa.array(n), pa.array(list(sums), pa.list_(pa.int64() if bits else pa.float64()))], names=["cell", "n", "sums"])

    parts = data.select("id", "vec").mapInArrow(run, f"cell int, n long, sums array<{'long' if bits else 'double'}>")
    return parts.groupBy("cell").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums")).where("n > 0")


def _completed(data: DataFrame, centroids: list[list], found: dict[int, list], metric: str) -> list[list]:
    """The new centroids; empty cells are moved to the rows farthest from theirs."""
    out = [found.get(cell, c) for cell, c in enumerate(centroids)]
    if empty := [cell for cell in range(len(centroids)) if cell not in found]:
        far = with_cells(data, centroids, metric).orderBy(F.desc("distance"), "id").limit(len(empty)).collect()
        for cell, r in zip(empty, far, strict=False):
            out[cell] = list(r["vec"])
    return out


def binary_majority(data: DataFrame, centroids: list[list[int]], n_words: int) -> DataFrame:
    """``cell, centroid``: of the rows nearest to each centroid, a bit is set where more
    than ``floor(n / 2)`` have it."""
    half = F.floor(F.col("n") / 2)

    def word(j: int) -> Column:
        out = F.lit(0).cast("long")
        for i in range(WORD_BITS):
            out = out + F.when(F.col("sums")[WORD_BITS * j + i] > half, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
        return out

    return cell_sums(data, centroids, WORD_BITS * n_words, "hamming").select("cell", F.array(*[word(j) for j in range(n_words)]).alias("centroid"))


def binary_kmeans(data: DataFrame, k: int, n_words: int, *, max_iter: int = 20, seeds: str | list[list[int]] = "parallel") -> Clusters:
    """Rounds of nearest centroid in bits and bit majority; an empty cell keeps its
    centroid for the round and is then moved to the farthest row."""
    check_clusters(data, k)
    centroids = _seeds(data, k, "hamming", seeds) if isinstance(seeds, str) else [list(c) for c in seeds]
    for _ in range(max_iter):
        found = {r["cell"]: list(r["centroid"]) for r in binary_majority(data, centroids, n_words).collect()}
        after = _completed(data, centroids, found, "hamming")
        if after == centroids:
            break
        centroids = after
    return Clusters(assign(data, centroids, "hamming").select("id", "cell"), centroids)
