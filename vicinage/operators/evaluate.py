"""Quality of approximate results, and timing.

Two measures share the name recall: the share of true neighbours found, and the
share of queries with at least one true neighbour found."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall_by_query(truth: DataFrame, approx: DataFrame) -> DataFrame:
    """``qid, hits, wanted`` for every query of ``truth``; both hold ``qid, id``."""
    found = approx.select("qid", "id").distinct().withColumn("hit", F.lit(1))
    return truth.select("qid", "id").join(found, ["qid", "id"], "left").groupBy("qid").agg(F.count("hit").alias("hits"), F.count("*").alias("wanted"))


def recall_at_k(truth: DataFrame, approx: DataFrame) -> DataFrame:
    """One row, ``recall``: mean share of a query's true neighbours that are found."""
    return recall_by_query(truth, approx).agg(F.avg(F.col("hits") / F.col("wanted")).alias("recall"))


def hit_rate_at_k(truth: DataFrame, approx: DataFrame) -> DataFrame:
    """One row, ``hit_rate``: share of queries with a true neighbour found."""
    return recall_by_query(truth, approx).agg(F.avg((F.col("hits") > 0).cast("double")).alias("hit_rate"))


def timed(make: Callable[[], DataFrame], runs: int = 3) -> list[float]:
    """Seconds of ``runs`` full evaluations, written to nowhere."""
    out = []
    for _ in range(runs):
        began = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        out.append(time.perf_counter() - began)
    return out


def trimmed_mean(seconds: list[float], deviations: float = 1.2) -> float:
    """Mean of the runs within ``deviations`` standard deviations of the mean."""
    mean = sum(seconds) / len(seconds)
    spread = (sum((s - mean) ** 2 for s in seconds) / len(seconds)) ** 0.5
    kept = [s for s in seconds if abs(s - mean) <= deviations * spread] or seconds
    return sum(kept) / len(kept)


@dataclass(frozen=True)
class Case:
    """What to time: a name and parameters, and how to make the result."""

    name: str
    make: Callable[..., DataFrame]
    parameters: dict = field(default_factory=dict)


def measure(cases: list[Case], runs: int = 3) -> list[dict]:
    """Name, parameters and trimmed mean of the seconds of each case."""
    return [{"name": c.name, **c.parameters, "seconds": trimmed_mean(timed(lambda c=c: c.make(**c.parameters), runs))} for c in cases]


def build_sweep(sizes: list[int], data: Callable[[int], DataFrame], build: Callable[[DataFrame], object], runs: int = 1) -> list[dict]:
    """Rows and seconds of building an index of each size; making the data is not
    counted where ``data`` returns a written table."""
    out = []
    for n in sizes:
        rows, seconds = data(n), []
        for _ in range(runs):
            began = time.perf_counter()
            build(rows)
            seconds.append(time.perf_counter() - began)
        out.append({"rows": n, "seconds": trimmed_mean(seconds)})
    return out


def recall_sweep(index, queries: DataFrame, truth: DataFrame, k: int, probes: list[int]) -> list[dict]:
    """Mean recall of an inverted file for each number of probed cells."""
    return [{"n_probe": p, "recall": recall_at_k(truth, index.search(queries, k, n_probe=p)).first()["recall"]} for p in probes]
