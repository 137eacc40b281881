"""Range search: all rows within a Hamming threshold, inclusive.

``queries(qid, q)`` and ``data(id, vec)`` hold 32-bit words; the result is ``(qid,
id, distance, key)`` with the matched words.  The pivot plan turns the theta join
into an equi-join: by the triangle inequality a row within ``t`` of the query has a
distance to the pivot within ``t`` of the query's own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinage.functions.binary import hamming_words
from vicinage.operators.exact import fits, grid, materialised, spread
from vicinage.sources.storage import load_table, save_table


def range_join(queries: DataFrame, data: DataFrame, t: int, n_words: int) -> DataFrame:
    """Nested-loop join with the distance as its condition; queries that are too
    large to broadcast go block by block (see ``exact.grid``)."""
    n = queries.count()
    if not fits(n, n_words):
        near = grid(queries, data, "hamming", n_words, most=t)
        return near.join(data.select("id", F.col("vec").alias("key")), "id").select("qid", "id", "distance", "key")
    d = hamming_words(F.col("q"), F.col("vec"), n_words)
    both = materialised(spread(data, n * data.count()), "vec").join(F.broadcast(queries), d <= t, "inner")
    return both.select("qid", "id", d.alias("distance"), F.col("vec").alias("key"))


def choose_pivots(data: DataFrame, n: int) -> list[list[int]]:
    """``n`` rows by a seeded hash of their ids, as pivots."""
    return [list(r["vec"]) for r in data.orderBy(F.xxhash64("id"), "id").limit(n).collect()]


def range_join_pivots(queries: DataFrame, data: DataFrame, t: int, n_words: int, pivots: list[list[int]] | None = None) -> DataFrame:
    """The same rows by an equi-join on the distance to the first pivot; further
    pivots filter.  Falls back to the theta join where ``2 t + 1`` buckets cover
    most distances."""
    bits = 32 * n_words
    pivots = choose_pivots(data, 2) if pivots is None else pivots
    if not pivots or 2 * t + 1 >= 0.75 * bits:
        return range_join(queries, data, t, n_words)
    to = lambda column, p: hamming_words(F.col(column), F.array(*[F.lit(w).cast("long") for w in p]), n_words)
    left = data.select("id", "vec", *[to("vec", p).alias(f"x{k}") for k, p in enumerate(pivots)])
    right = queries.select("qid", "q", *[to("q", p).alias(f"y{k}") for k, p in enumerate(pivots)])
    right = right.withColumn("x0_key", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.col("y0") - t), F.least(F.lit(bits).cast("long"), F.col("y0") + t))))
    close = [F.abs(F.col(f"x{k}") - F.col(f"y{k}")) <= t for k in range(1, len(pivots))]
    d = hamming_words(F.col("q"), F.col("vec"), n_words)
    on = reduce(lambda a, b: a & b, [F.col("x0") == F.col("x0_key"), *close, d <= t])
    return left.join(right, on).select("qid", "id", d.alias("distance"), F.col("vec").alias("key"))


class RangeIndex:
    """A set of descriptors that can grow: ``set`` replaces, ``append`` continues ids."""

    def __init__(self, n_words: int):
        self.n_words, self._rows = n_words, None

    def set(self, data: DataFrame) -> RangeIndex:
        self._rows = data.select("id", "vec")
        return self

    def append(self, data: DataFrame) -> RangeIndex:
        """Add rows; their ids are moved behind the largest id so far."""
        if self._rows is None:
            return self.set(data)
        last = self._rows.agg(F.coalesce(F.max("id") + 1, F.lit(0))).first()[0]
        self._rows = self._rows.unionByName(data.select((F.col("id") + last).alias("id"), "vec"))
        return self

    def empty(self) -> bool:
        return self._rows is None or self._rows.isEmpty()

    def size(self) -> int:
        return 0 if self._rows is None else self._rows.count()

    def values(self) -> DataFrame:
        return self._rows.select("vec")

    def find_threshold(self, queries: DataFrame, t: int, *, pivots: bool = False) -> DataFrame:
        if self._rows is None:
            return queries.select("qid", F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("distance"), F.col("q").alias("key")).limit(0)
        return (range_join_pivots if pivots else range_join)(queries, self._rows, t, self.n_words)

    def save(self, path: str) -> None:
        if self._rows is None:
            raise RuntimeError("index is not built")
        save_table(self._rows, path, meta={"kind": "range", "n_words": self.n_words})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> RangeIndex:
        rows, meta = load_table(spark, path, kind="range")
        return cls(meta["n_words"]).set(rows)
