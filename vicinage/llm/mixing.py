"""Mixing sources to target weights by Sainte-Lague apportionment.

Targets come from water-filling: every source gets tokens in proportion to its
weight, none more than ``max_repeats`` times what it holds; what capped sources
cannot use is shared again by weight.  The total is then dealt in equal-token
blocks: a source's whole passes are fixed first, and the highest quotients
``votes / (2 * seats + 1)`` give the remaining blocks, first to sources, then to
the shards of each source.  A shard lays its documents end to end in a seeded
order and takes its quota of blocks as one run from a seeded start.

Only one row per source and per shard reaches the driver.  A source is split into
as many shards as its size asks for, so one with a third of all rows is spread over
many tasks.  Shards and their size both grow with the square root of all words: a
million shards of 15 million words stand for 100 TB of text.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinage.llm.common import Staged, pieces

SPACE_WORD = r"[^\x20\x09-\x0D]+"
#: Tokens of a block at most, blocks that the smallest remaining target holds at least.
BLOCK, LEAST_BLOCKS = 64, 16
#: Words of a shard: this, or so many times the square root of all words, whatever is more.
SHARD_WORDS, SHARD_ROOTS = 4096, 4
SEED = 20_24


def water_fill(sizes: list[int], weights: list[float], total: float, max_repeats: float) -> list[float]:
    """Targets in proportion to ``weights`` that add up to ``total``, none above
    ``max_repeats`` times its size (less in all if every source is capped)."""
    targets, free, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], float(total)
    while free:
        share = left / sum(weights[i] for i in free)
        capped = [i for i in free if share * weights[i] > max_repeats * sizes[i]]
        if not capped:
            for i in free:
                targets[i] = share * weights[i]
            break
        for i in capped:
            targets[i] = float(max_repeats * sizes[i])
            left -= targets[i]
        free = [i for i in free if i not in set(capped)]
    return targets


def sainte_lague(votes: list[float], seats: int, most: list[int] | None = None) -> list[int]:
    """Seats by highest quotients ``votes / (2 * won + 1)``; ties go to the
    earlier party; ``most`` bounds each party's seats.

    The common divisor gives nearly all seats at once; a heap of quotients adds
    or takes back the few that rounding leaves."""
    n = len(votes)
    most = most or [seats] * n
    seats = min(seats, sum(m for m, v in zip(most, votes, strict=True) if v > 0))
    total = sum(votes)
    if seats <= 0 or total <= 0:
        return [0] * n
    won = [min(m, int(v * seats / total + 0.5)) for v, m in zip(votes, most, strict=True)]
    while (extra := sum(won) - seats) > 0:
        worst = [(v / (2 * w - 1), -i) for i, (v, w) in enumerate(zip(votes, won, strict=True)) if w]
        heapq.heapify(worst)
        for _ in range(extra):
            _, i = heapq.heappop(worst)
            won[-i] -= 1
            if won[-i]:
                heapq.heappush(worst, (votes[-i] / (2 * won[-i] - 1), i))
    best = [(-v / (2 * w + 1), i) for i, (v, w, m) in enumerate(zip(votes, won, most, strict=True)) if w < m and v > 0]
    heapq.heapify(best)
    for _ in range(seats - sum(won)):
        _, i = heapq.heappop(best)
        won[i] += 1
        if won[i] < most[i]:
            heapq.heappush(best, (-votes[i] / (2 * won[i] + 1), i))
    return won


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def mix(
    docs: DataFrame,
    *,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    max_repeats: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = SEED,
    keep: bool = False,
) -> DataFrame:
    """Per document ``doc_id, size, source_size, target, passes, extra_from,
    extra, taken``: the document is taken whole ``passes`` times and once more
    for ``extra`` words, cyclically from its word ``extra_from`` (from 0) on;
    ``taken = passes * size + extra``.  With ``keep`` each row also carries its
    input row as the struct ``row``.

    Sources are ordered by code point with null last and weigh ``weights`` over
    and over.  Null text has size 0 and takes nothing.  Repeated rows are rows
    of their own.  The draw depends on ids, texts and the seed alone, so reruns
    agree; rows with one id (or a null id) and different texts are spread like
    others, equal rows follow one another.  Very long texts are taken in part like
    others.  An empty table gives no rows.  Other columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    place = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("place")
    digest = [F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), place]
    staged = Staged(docs.select(*digest), "mix").df
    totals = sorted(((r["source"], r["size"]) for r in staged.groupBy("source").agg(F.sum("size").alias("size")).collect()), key=lambda r: (r[0] is None, (r[0] or "").encode()))
    sizes = [s for _, s in totals]
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share * sum(sizes), max_repeats)

    # whole passes first; blocks are dealt for what is left of each target
    passes = [min(max_repeats, int(t // s)) if s else 0 for t, s in zip(targets, sizes, strict=True)]
    rest = [max(0.0, t - p * s) for t, p, s in zip(targets, passes, sizes, strict=True)]
    unit = max(1, min(BLOCK, int(min((r for r in rest if r >= 1), default=BLOCK) / LEAST_BLOCKS)))
    blocks = [-(-s // unit) for s in sizes]
    quotas = sainte_lague(rest, round(sum(rest) / unit), [b if r else 0 for b, r in zip(blocks, rest, strict=True)])
    per_shard = max(SHARD_WORDS, SHARD_ROOTS * math.isqrt(sum(sizes)))
    shards = [max(1, -(-s // per_shard)) for s in sizes]

    plan = _looked_up(
        spark,
        [(name, s, float(t), p, n) for (name, s), t, p, n in zip(totals, targets, passes, shards, strict=True)],
        "p_source string, source_size long, target double, passes int, shards int",
    )

    def deal(rows: DataFrame) -> DataFrame:
        shard = F.pmod(F.xxhash64(F.lit(seed + 1), "place"), F.col("shards")).cast("int")
        return rows.join(plan, F.col("source").eqNullSafe(F.col("p_source")), "left").withColumn("shard", shard).drop("p_source", "shards")

    by_source: dict = {}
    for r in deal(staged).groupBy("source", "shard").agg(F.sum("size").alias("size")).collect():  # one row a shard
        by_source.setdefault(r["source"], []).append((r["shard"], r["size"]))
    runs = []
    for (name, _), quota, left in zip(totals, quotas, rest, strict=True):
        parts = sorted(by_source.get(name, []))
        held = [-(-s // unit) for _, s in parts]
        won = sainte_lague([float(s) for _, s in parts], quota, held)
        taken = [s * w / b if b else 0.0 for (_, s), w, b in zip(parts, won, held, strict=True)]  # blocks of a shard are equal
        scale = left / sum(taken) if sum(taken) else 0.0  # evens out what whole blocks leave or exceed
        runs += [(name, shard, s, min(s, int(x * scale + 0.5))) for (shard, s), x in zip(parts, taken, strict=True)]
    quota_rows = _looked_up(spark, runs, "q_source string, q_shard int, shard_size long, run long")

    dealt = deal(docs.select(*digest, F.struct("*").alias("row")) if keep else staged)
    order = Window.partitionBy("source", "shard").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = (
        dealt.join(quota_rows, F.col("source").eqNullSafe(F.col("q_source")) & (F.col("shard") == F.col("q_shard")), "left")
        .withColumn("b", F.sum("size").over(order))
        .withColumn("a", F.col("b") - F.col("size"))
        .withColumn("s", F.pmod(F.xxhash64(F.lit(seed + 2), "source", "shard"), F.greatest("shard_size", F.lit(1))))
    )

    def overlap(start: Column, end: Column) -> tuple[Column, Column]:
        lo = F.greatest("a", start)
        return lo, F.greatest(F.lit(0), F.least("b", end) - lo)

    stop = F.col("s") + F.col("run")
    lo, first = overlap(F.col("s"), F.least(stop, F.col("shard_size")))
    _, second = overlap(F.lit(0), stop - F.col("shard_size"))
    return laid.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        "passes",
        F.when(first > 0, lo - F.col("a")).otherwise(0).cast("long").alias("extra_from"),
        (first + second).cast("long").alias("extra"),
        (F.col("passes") * F.col("size") + first + second).cast("long").alias("taken"),
        *(["row"] if keep else []),
    )


#: Rows up to which a table made on the driver is broadcast; beyond it Spark joins by shuffle.
BROADCAST_ROWS = 200_000


def _looked_up(spark, rows: list[tuple], schema: str) -> DataFrame:
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= BROADCAST_ROWS else df


def cut_words(text: str, start: int, n: int) -> str:
    """``n`` words of a text from word ``start`` on, cyclically, with the white
    space between them; a run over the end is joined by a line break."""
    places = [m.span() for m in _WORDS.finditer(text)]
    stop = start + n
    part = text[places[start][0] : places[min(stop, len(places)) - 1][1]]
    return part if stop <= len(places) else part + "\n" + text[places[0][0] : places[stop - len(places) - 1][1]]


_WORDS = re.compile(SPACE_WORD)


def expand(mixed: DataFrame, *, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """Rows of :func:`mix` with ``keep`` turned into the documents that the mix
    takes: the input row once for each pass, and once more with the extra words.
    Rows that it takes nothing of (null and empty texts too) are left out; an empty
    table gives no rows, with the same columns."""
    schema = mixed.schema["row"].dataType
    columns = schema.names
    at = columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in pieces(batch, 3 + at):
                passes, starts, extras = (rows.column(k).to_pylist() for k in range(3))
                take, parts = [], {}
                for k, (n, start, extra) in enumerate(zip(passes, starts, extras, strict=True)):
                    take += [k] * n
                    if extra:
                        parts[len(take)] = cut_words(rows.column(3 + at)[k].as_py(), start, extra)
                        take.append(k)
                taken = [c.take(pa.array(take, pa.int64())) for c in rows.columns[3:]]
                if parts:
                    taken[at] = pa.array([parts.get(k, t) for k, t in enumerate(taken[at].to_pylist())], taken[at].type)
                yield pa.RecordBatch.from_arrays(taken, names=columns)

    flat = mixed.select(F.col("passes").alias("__passes"), F.col("extra_from").alias("__from"), F.col("extra").alias("__extra"), *[F.col("row")[c].alias(c) for c in columns])
    out = flat.mapInArrow(run, schema)
    return out.withColumn(chars_col, F.length(text_col).cast(schema[chars_col].dataType)) if chars_col in columns else out
