"""Neighbour estimators: graph, classification, regression.

``data`` holds ``id, vec`` and labels; queries hold ``qid, q``.  Weights are
``uniform`` (1) or ``distance`` (1/d; where a query has neighbours at distance 0,
these count 1 and the others 0).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinage.functions.metrics import resolve
from vicinage.operators.exact import knn_join


def weighted(knn: DataFrame, weights: str) -> DataFrame:
    """``knn`` with its weights as ``w``."""
    if weights == "uniform":
        return knn.withColumn("w", F.lit(1.0))
    if weights != "distance":
        raise ValueError(f"Unsupported weights: {weights!r}; 'uniform' or 'distance'")
    d = F.col("distance").cast("double")
    exact = F.min(d).over(Window.partitionBy("qid")) == 0
    return knn.withColumn("w", F.when(exact, F.when(d == 0, 1.0).otherwise(0.0)).otherwise(1.0 / F.nullif(d, F.lit(0.0))))


@dataclass
class _Fitted:
    data: DataFrame = field(repr=False)
    n_neighbors: int
    metric: str
    weights: str
    dim: int | None

    def kneighbors(self, queries: DataFrame | None = None, n_neighbors: int | None = None) -> DataFrame:
        """Nearest first; without queries every row asks for its neighbours other than itself."""
        own = queries is None
        queries = self.data.select(F.col("id").alias("qid"), F.col("vec").alias("q")) if own else queries
        return knn_join(queries.select("qid", "q"), self.data.select("id", "vec"), n_neighbors or self.n_neighbors, self.metric, dim=self.dim, exclude_self=own)

    def kneighbors_graph(self, queries: DataFrame | None = None, n_neighbors: int | None = None, mode: str = "connectivity") -> DataFrame:
        """Coordinates of a sparse matrix: ``row, col, value``."""
        value: Column = F.lit(1.0) if mode == "connectivity" else F.col("distance").cast("double")
        return self.kneighbors(queries, n_neighbors).select(F.col("qid").alias("row"), F.col("id").alias("col"), value.alias("value"))


@dataclass
class NearestNeighbors:
    n_neighbors: int = 5
    metric: str = "euclidean"
    weights: str = "uniform"
    dim: int | None = None

    def __post_init__(self):
        resolve(self.metric)

    def fit(self, data: DataFrame) -> _Fitted:
        return _Fitted(data, self.n_neighbors, self.metric, self.weights, self.dim)


class _Classes(_Fitted):
    def classes(self) -> list:
        return [r[0] for r in self.data.select("label").distinct().orderBy("label").collect()]

    def predict_proba(self, queries: DataFrame) -> DataFrame:
        """``qid, label, proba`` of the labels among a query's neighbours; others have 0."""
        near = weighted(self.kneighbors(queries), self.weights).join(self.data.select("id", "label"), "id")
        votes = near.groupBy("qid", "label").agg(F.sum("w").alias("votes"))
        total = F.sum("votes").over(Window.partitionBy("qid"))
        return votes.select("qid", "label", F.coalesce(F.col("votes") / F.nullif(total, F.lit(0.0)), F.lit(0.0)).alias("proba"))

    def predict(self, queries: DataFrame) -> DataFrame:
        """``qid, label``: the most probable label, ties to the smallest."""
        order = Window.partitionBy("qid").orderBy(F.desc(F.round("proba", 12)), "label")
        return self.predict_proba(queries).withColumn("r", F.row_number().over(order)).where("r = 1").select("qid", "label")

    def score(self, queries: DataFrame) -> DataFrame:
        """One row, ``accuracy``; queries carry their true ``y``."""
        both = self.predict(queries).join(queries.select("qid", "y"), "qid")
        return both.agg(F.avg((F.col("label") == F.col("y")).cast("double")).alias("accuracy"))


class _Values(_Fitted):
    def predict(self, queries: DataFrame) -> DataFrame:
        """``qid, prediction``: weighted mean of ``y``, by output where ``y`` is an array."""
        near = weighted(self.kneighbors(queries), self.weights).join(self.data.select("id", "y"), "id")
        if not near.schema["y"].dataType.typeName() == "array":
            return near.groupBy("qid").agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("prediction"))
        each = near.select("qid", "w", F.posexplode("y").alias("output", "value"))
        means = each.groupBy("qid", "output").agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("p"))
        ordered = means.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("output", "p"))).alias("ps"))
        return ordered.select("qid", F.transform("ps", lambda x: x["p"]).alias("prediction"))

    def score(self, queries: DataFrame) -> DataFrame:
        """One row, ``r2``; queries carry their true ``y`` (a number)."""
        both = self.predict(queries).join(queries.select("qid", F.col("y").cast("double").alias("y")), "qid")
        stats = both.agg(F.sum((F.col("y") - F.col("prediction")) ** 2).alias("rest"), (F.var_pop("y") * F.count("*")).alias("total"))
        return stats.select((1 - F.col("rest") / F.nullif("total", F.lit(0.0))).alias("r2"))


@dataclass
class KNeighborsClassifier(NearestNeighbors):
    def fit(self, data: DataFrame) -> _Classes:
        """``data``: ``id, vec, label``."""
        return _Classes(data, self.n_neighbors, self.metric, self.weights, self.dim)


@dataclass
class KNeighborsRegressor(NearestNeighbors):
    def fit(self, data: DataFrame) -> _Values:
        """``data``: ``id, vec, y``; ``y`` is a number or an array of numbers."""
        return _Values(data, self.n_neighbors, self.metric, self.weights, self.dim)
