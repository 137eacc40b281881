"""Introspection: statistics of cells, a printable summary, and plan facts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cell_stats(points: DataFrame, distance: str) -> DataFrame:
    """``cell, n, r_min, r_max``: rows of each cell and their least and largest
    distance to its centre (column ``distance``)."""
    return points.groupBy("cell").agg(F.count("*").alias("n"), F.min(distance).alias("r_min"), F.max(distance).alias("r_max"))


def to_string(points: DataFrame, distance: str, dim: int) -> str:
    """Header, number of points, an estimate of their memory, and a line a cell."""
    cells = cell_stats(points, distance).orderBy("cell").collect()
    n = sum(c["n"] for c in cells)
    height = math.ceil(math.log2(len(cells))) + 1 if cells else 0
    lines = [f"cells: {len(cells)}, points: {n}, levels of a binary tree over them: {height}", f"memory of the vectors: {n * dim * 4} bytes"]
    return "\n".join(lines + [f"cell {c['cell']}: points {c['n']}, distances {c['r_min']:.6g} to {c['r_max']:.6g}" for c in cells])


def plan_facts(df: DataFrame) -> dict[str, bool]:
    """What a physical plan holds, for tests that pin it down."""
    text = df._jdf.queryExecution().executedPlan().toString()
    names = ("BroadcastNestedLoopJoin", "CartesianProduct", "BroadcastHashJoin", "SortMergeJoin", "WindowGroupLimit", "PushedFilters", "ArrowEvalPython", "Exchange")
    return {name: name in text for name in names}
