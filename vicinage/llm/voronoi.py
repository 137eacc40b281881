"""Exact top-k search as a Voronoi kNN join, for integer inner products.

Pivots cut the data into cells, about the square root of the rows in number; a
summary of each cell (rows, radius around its pivot, largest norm) bounds the inner
product that a query can reach there: ``q . p + |q| r`` and ``|q| max|v|``.
Neighbouring cells are gathered to bundles of bounded size (a cell that is larger,
such as that of one very common vector, makes several), and queries of neighbouring
cells to chunks.

The search goes in rounds.  A query is first solved in its own bundle, which gives
its k-th best score so far; each further round takes eight times as many of the
remaining bundles, those of the highest bounds first, and of these only the ones
whose bound reaches that score.  A bundle is sent to the chunks that have such a
query and to no others, and a group answers with rows that reach the score only, so
what moves is in proportion to the queries and not to queries times bundles.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinage.llm.common import Staged

#: Rows of a bundle: this, or so many times the square root of all rows, whatever is more
#: (hashes deal larger cells).
BLOCK, BLOCK_ROOTS = 1024, 2
#: Queries of a chunk at most, bundles of a round for each of the round before, and rows
#: of a broadcast table of groups.
CHUNK, STEP, BROADCAST_ROWS = 4096, 8, 200_000
#: Numbers that a matrix of distances or scores holds at most, in one Python worker.
CELLS = 1 << 21


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def inner_products(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Exact: in floating point while every partial sum is below 2**53, else in integers."""
    largest = float(np.abs(q).max(initial=0)) * float(np.abs(d).max(initial=0)) * max(1, q.shape[1])
    if largest < 2**53:
        return (q.astype(np.float64) @ d.astype(np.float64).T).astype(np.int64)
    return np.array([[sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for y in d] for x in q], dtype=np.int64).reshape(len(q), len(d))


def best(scores: np.ndarray, ids: np.ndarray, copies: np.ndarray, own: int, floor: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` highest scores of one query that reach ``floor``, ties to the smaller
    id, and their ids.  ``ids`` ascend and stand for ``copies`` equal rows each; of
    those at place ``own`` (-1 for none) one is the query itself."""
    at = np.flatnonzero(scores >= floor) if floor > -math.inf else np.arange(len(scores))
    if own >= 0 and copies[own] == 1:
        at = at[at != own]
    if len(at) > k:
        edge = np.partition(scores[at], len(at) - k)[len(at) - k]
        above = at[scores[at] > edge]
        at = np.concatenate([above, at[scores[at] == edge][: k - len(above)]])
    at = at[np.lexsort((ids[at], -scores[at]))]
    n = copies[at] - (at == own)
    if (n > 1).any():
        at = np.repeat(at, np.minimum(n, k))[:k]
    return scores[at], ids[at]


def whole_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """``id, v``: ``floor(scale * x)`` of every component; vectors that are null,
    empty or hold null or non-finite components are left out, as are null ids."""
    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("x")).where(F.col("id").isNotNull())
    fine = F.when(F.col("x").isNotNull(), F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))) & (F.size("x") > 0)).otherwise(False)
    return source.where(fine).select("id", F.transform("x", lambda e: F.floor(e.cast("double") * scale).cast("long")).alias("v"))


def bundles(order: list[int], counts: list[int], most: int, start: int = 0) -> tuple[dict[int, int], dict[int, int], int]:
    """Cell -> its first bundle and how many it has, and the number of the next free
    bundle.  Cells that follow one another share a bundle of up to ``most`` rows; a
    larger cell has bundles of its own."""
    first, number, free, held = {}, {}, start, most
    for cell in order:
        n = counts[cell]
        if n > most:
            first[cell], number[cell] = free, math.ceil(n / most)
            free, held = free + number[cell], most
            continue
        if held + n > most:
            free, held = free + 1, 0
        first[cell], number[cell] = free - 1, 1
        held += n
    return first, number, free


@dataclass
class Space:
    """Cells of the vectors of one length, in the order of their bundles."""

    pivots: np.ndarray
    radius: np.ndarray
    norm: np.ndarray
    starts: np.ndarray  # of the runs of cells that share bundles
    run_of: np.ndarray  # run of each bundle
    first_bundle: int

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Highest inner product that each bundle can give each query, rounded up."""
        norms = np.sqrt((q * q).sum(1))[:, None]
        reach = np.maximum(self.radius, 0)
        bound = np.minimum(q @ self.pivots.T + norms * reach, norms * self.norm)
        bound += 1e-9 * norms * (np.sqrt((self.pivots**2).sum(1)) + reach) + 1e-3
        bound[:, self.radius < 0] = -np.inf  # empty cells
        return np.maximum.reduceat(bound, self.starts, axis=1)[:, self.run_of]


def _near_order(pivots: np.ndarray) -> list[int]:
    """Cells so that neighbours mostly follow one another: by the nearest of a few
    chosen pivots, then by the distance to it."""
    few = pivots[: math.isqrt(len(pivots) - 1) + 1]
    apart = (pivots**2).sum(1)[:, None] + (few**2).sum(1)[None] - 2 * pivots @ few.T
    return np.lexsort((apart.min(1), apart.argmin(1))).tolist()


def _looked_up(values: list[int], at: Column) -> Column:
    """Element of a constant array."""
    return F.from_json(F.lit(json.dumps(values)), "array<int>")[at]


def top_inner_products(vectors: DataFrame, *, k: int = 20, every: int = 20, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding", block: int | None = None, chunk: int = CHUNK, step: int = STEP) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row whose id ``every``
    divides, its ``k`` highest inner products with other rows (all, if fewer),
    ties to the smaller id.

    Vectors that are null, empty or hold null or non-finite components take no
    part, nor do rows with a null id.  Vectors of different lengths are not
    compared.  Rows that share an id, and repeated rows, are rows of their own: each
    is a candidate of the others, and each with a fitting id has ``k`` rows in the
    result.  Vectors of any length are whole.  An empty table gives no rows.  Other
    columns of ``vectors`` are ignored.
    """
    spark = vectors.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # work, not bytes, sets their number
    asked = F.col("id") % every == 0
    distinct = whole_vectors(vectors, id_col, vec_col, scale).groupBy("id", "v").agg(F.count("*").alias("n"))
    staged = Staged(distinct.select(F.monotonically_increasing_id().alias("row"), "id", "v", "n", F.size("v").alias("dim"), F.pmod(F.xxhash64(F.lit(7), "id", "v"), F.lit(1 << 31)).alias("hash")), "vectors")
    rows = staged.df

    # pivots: a seeded draw of about the square root of the rows of each length
    lengths = {r["dim"]: r for r in rows.groupBy("dim").agg(F.count("*").alias("rows"), F.min_by("v", "hash").alias("one")).collect()}  # one row a length
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    block = block or max(BLOCK, BLOCK_ROOTS * math.isqrt(sum(r["rows"] for r in lengths.values())))
    share = F.create_map(*[F.lit(x) for dim, r in lengths.items() for x in (dim, int(2**31 / math.sqrt(r["rows"])))])
    drawn: dict[int, list] = {dim: [r["one"]] for dim, r in lengths.items()}
    for r in rows.where(F.col("hash") < share[F.col("dim")]).orderBy("hash", "row").select("dim", "v").collect():
        if r["v"] != drawn[r["dim"]][0]:
            drawn[r["dim"]].append(r["v"])
    pivots = {dim: np.array(vs, dtype=np.float64) for dim, vs in drawn.items()}
    first_cell = dict(zip(pivots, np.cumsum([0, *map(len, pivots.values())]).tolist(), strict=False))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(3).to_numpy()
            for dim in np.unique(dims):
                whole, p = batch.filter(pa.array(dims == dim)), pivots[int(dim)]
                size = max(1, CELLS // max(p.shape))
                for at in range(0, whole.num_rows, size):
                    some = whole.slice(at, size)
                    x = _matrix(some.column(2)).astype(np.float64)
                    cell = ((p * p).sum(1)[None] - 2 * x @ p.T).argmin(1)
                    away = np.sqrt(((x - p[cell]) ** 2).sum(1))
                    yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), some.column(2), some.column(4), pa.array(cell + first_cell[int(dim)], pa.int32()), pa.array(away), pa.array(np.sqrt((x * x).sum(1)))], names=["row", "id", "v", "n", "cell", "away", "norm"])

    placed = Staged(rows.select("row", "id", "v", "dim", "n").mapInArrow(assign, "row long, id long, v array<long>, n long, cell int, away double, norm double"), "cells").df
    staged.drop()
    cells = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count("*").alias("rows"), F.max("away").alias("radius"), F.max("norm").alias("norm"), F.count(F.when(asked, 1)).alias("queries")).collect()}  # one row a pivot

    # bundles of cells and chunks of queries, by the summaries
    total = sum(map(len, pivots.values()))
    of_cell = lambda name, none: [cells[c][name] if c in cells else none for c in range(total)]
    counts, asks, radius, norm = of_cell("rows", 0), of_cell("queries", 0), of_cell("radius", -1.0), of_cell("norm", 0.0)
    bundle_of, bundles_of, chunk_of, chunks_of = [0] * total, [1] * total, [0] * total, [1] * total
    spaces: dict[int, Space] = {}
    free = free_chunk = 0
    for dim, p in pivots.items():
        order = [c + first_cell[dim] for c in _near_order(p)]
        start = free
        first, number, free = bundles(order, counts, block, free)
        first_chunk, n_chunks, free_chunk = bundles(order, asks, chunk, free_chunk)
        for c in order:
            bundle_of[c], bundles_of[c], chunk_of[c], chunks_of[c] = first[c], number[c], first_chunk[c], n_chunks[c]
        starts = [i for i, c in enumerate(order) if not i or first[c] != first[order[i - 1]]]
        run_of = np.repeat(np.arange(len(starts)), [number[order[i]] for i in starts])
        local = np.array(order) - first_cell[dim]
        spaces[dim] = Space(p[local], np.array([radius[c] for c in order]), np.array([norm[c] for c in order]), np.array(starts), run_of, start)
    most_bundles = max(len(s.run_of) for s in spaces.values())

    spread = lambda firsts, numbers, salt: (_looked_up(firsts, F.col("cell")) + F.pmod(F.xxhash64(F.lit(salt), "row"), _looked_up(numbers, F.col("cell")))).cast("int")
    data = placed.select("row", "id", "v", "n", spread(bundle_of, bundles_of, 3).alias("bundle"))
    queries = placed.where(asked).select("row", "id", "v", "n", spread(bundle_of, bundles_of, 3).alias("own"), spread(chunk_of, chunks_of, 4).alias("chunk"))

    def solve(group: pa.Table) -> pa.Table:
        asks = np.asarray(group.column("ask"))
        number, ids, copies, v, floors = group.column("row").to_numpy(), group.column("id").to_numpy(), group.column("n").to_numpy(), _matrix(group.column("v")), group.column("floor").to_numpy()
        mine, theirs = np.flatnonzero(asks), np.flatnonzero(~asks)
        theirs = theirs[np.lexsort((number[theirs], ids[theirs]))]
        d, d_ids, d_copies = v[theirs], ids[theirs], copies[theirs]
        by_row = np.argsort(number[theirs])
        found = np.searchsorted(number[theirs], number[mine], sorter=by_row)
        place = by_row[np.minimum(found, len(theirs) - 1)] if len(theirs) else found
        own = np.where(number[theirs][place] == number[mine], place, -1) if len(theirs) else np.full(len(mine), -1)
        out = []
        size = max(1, CELLS // max(1, len(theirs)))
        for at in range(0, len(mine), size):
            some = mine[at : at + size]
            for q, scores, o in zip(some, inner_products(v[some], d), own[at : at + size], strict=True):
                got, whose = best(scores, d_ids, d_copies, int(o), floors[q], k)
                out.append((np.full(len(got), q), got, whose))
        q, scores, whose = (np.concatenate(x) if out else np.empty(0, np.int64) for x in (zip(*out, strict=True) if out else ((), (), ())))
        return pa.table({"row": pa.array(number[q], pa.int64()), "query_id": pa.array(ids[q], pa.int64()), "copies": pa.array(copies[q], pa.int64()), "score": pa.array(scores, pa.int64()), "vec_id": pa.array(whose, pa.int64())})

    def solved(sent: DataFrame, needed: DataFrame) -> DataFrame:
        both = data.join(needed, "bundle").select("row", "id", "v", "n", "bundle", "chunk", F.lit(False).alias("ask"), F.lit(0.0).alias("floor"))
        both = both.unionByName(sent.withColumn("ask", F.lit(True)))
        return both.repartition(tasks, "bundle", "chunk").groupBy("bundle", "chunk").applyInArrow(solve, "row long, query_id long, copies long, score long, vec_id long")

    def send(low: int, high: int):
        """Queries for the bundles at places ``low`` to ``high`` of their order by bound,
        where the bound reaches the score so far."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims = np.array([len(x) for x in batch.column(2)])
                for dim in np.unique(dims):
                    whole, space = batch.filter(pa.array(dims == dim)), spaces[int(dim)]
                    size = max(1, CELLS // max(len(space.run_of), *space.pivots.shape))
                    for at in range(0, whole.num_rows, size):
                        some = whole.slice(at, size)
                        bound = space.bounds(_matrix(some.column(2)).astype(np.float64))
                        bound[np.arange(some.num_rows), some.column(4).to_numpy() - space.first_bundle] = np.inf  # the own one is done, and comes first
                        taken = np.argsort(-bound, axis=1, kind="stable")[:, low:high]
                        hit = np.take_along_axis(bound, taken, 1) >= some.column(6).to_numpy()[:, None]
                        which, place = np.nonzero(hit)
                        part = some.take(pa.array(which))
                        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), part.column(3), pa.array(taken[which, place] + space.first_bundle, pa.int32()), part.column(5), part.column(6)], names=["row", "id", "v", "n", "bundle", "chunk", "floor"])

        return run

    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    low, high, top, before = 0, 1, None, None
    while low < most_bundles:
        if top is None:
            sent = queries.select("row", "id", "v", "n", F.col("own").alias("bundle"), "chunk", F.lit(float("-inf")).alias("floor"))
        else:
            floors = top.groupBy("row").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("floor"))
            known = queries.join(floors, "row", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
            sent = known.mapInArrow(send(low, high), "row long, id long, v array<long>, n long, bundle int, chunk int, floor double")
        needed = Staged(sent.select("bundle", "chunk").distinct(), "groups")
        groups = needed.df.count()
        if top is not None and not groups:
            break  # bounds descend, so nothing that follows can reach the scores either
        found = solved(sent, F.broadcast(needed.df) if groups <= BROADCAST_ROWS else needed.df)
        merged = found if top is None else top.drop("rank").unionByName(found)
        after = Staged(merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "top")
        needed.drop()
        if before is not None:
            before.drop()
        top, before = after.df, after
        low, high = high, high * step
    return top.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
