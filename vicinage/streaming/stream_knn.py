"""Streams of queries against static data, and static data with a recent delta.

Both are extensions: an index answers one batch; here each micro-batch of queries
is such a batch, and rows that arrived after the build are scanned linearly."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from vicinage.operators.exact import knn_join, top_k


def stream_knn(queries: DataFrame, data: DataFrame, k: int, metric: str, sink: Callable[[DataFrame, int], None], *, dim: int, checkpoint: str | None = None) -> StreamingQuery:
    """Answer a streaming ``queries(qid, q)`` batch by batch; ``sink`` gets each
    result with its batch number, and must bear a repeat of the last batch after a
    restart.  ``checkpoint`` keeps the stream's progress."""

    def answer(batch: DataFrame, number: int) -> None:
        sink(knn_join(batch, data, k, metric, dim=dim), number)

    writer = queries.writeStream.foreachBatch(answer).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.start()


def with_delta(search: Callable[[DataFrame], DataFrame], queries: DataFrame, delta: DataFrame, k: int, metric: str, *, dim: int) -> DataFrame:
    """The ``k`` nearest of an index's answer (``search``, with at least ``k`` rows
    a query) and of the rows that were added since."""
    recent = knn_join(queries, delta, k, metric, dim=dim)
    both = search(queries).select("qid", "id", "distance").unionByName(recent.select("qid", "id", "distance"))
    return top_k(both, k)
