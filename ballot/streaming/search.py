"""Streams of queries: each micro-batch is searched against the static corpus and its index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ballot.functions.vectors import L2, Metric
from ballot.operators.forest import routed
from ballot.plans.index import VectorIndex


def stream_leaves(index: VectorIndex, queries: DataFrame) -> DataFrame:
    """(qid, tree, leaf) of a stream: routing needs no state."""
    index._ready()
    return routed(queries, "qid", index.forest)


def stream_votes(index: VectorIndex, queries: DataFrame) -> DataFrame:
    """(qid, tree, label, vote) of a stream joined to the static leaf votes; sums are the sink's."""
    return stream_leaves(index, queries).join(index.leaf_votes, ["tree", "leaf"]).select("qid", "tree", "label", "vote")


def search_stream(index: VectorIndex, queries: DataFrame, k: int, votes_required: float, sink: Callable[[DataFrame, int], None], dist: Metric | str = L2) -> DataStreamWriter:
    """A writer that hands sink each batch's (qid, rank, id, distance) and its number; the caller starts it.

    A batch that runs again after a failure gives the same rows under the same number.
    """

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.select(F.col("qid"), "vec").persist()
        try:
            sink(index.ann(batch, k, votes_required, dist, return_distances=True), number)
        finally:
            batch.unpersist()

    return queries.writeStream.foreachBatch(each)
