"""Candidates to results: exact distances of what was elected, ranked and padded."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballot.functions.vectors import L2, Metric
from ballot.operators.exact import BEST_ROWS, CELLS, KEYS, QUERY_BYTES, as_matrix, best_of, check_k, padded, ranked
from ballot.operators.forest import Forest
from ballot.operators.votes import ROOM
from ballot.sources.vectors import matrix, of_dimension

SHARD_ROWS = 1024  # corpus rows, about, whose votes are summed together


def candidate_keys(candidates: DataFrame, corpus: DataFrame, queries: DataFrame, metric: Metric | str = L2) -> DataFrame:
    """(qid, id, key) of the elected pairs; labels that are no corpus rows drop out."""
    metric = Metric.of(metric)
    pairs = candidates.select("qid", F.col("label").alias("id")).join(corpus.select("id", F.col("vec").alias("c")), "id").join(queries.select("qid", F.col("vec").alias("q")), "qid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            dim = len(b.column(2)[0])
            c, q = matrix(b.column(2), dim), matrix(b.column(3), dim)
            key = ((q - c) ** 2).sum(axis=1) if metric is L2 else -(q * c).sum(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(key)], names=["qid", "id", "key"])

    return pairs.select(F.col("qid").cast("long").alias("qid"), F.col("id").cast("long").alias("id"), "c", "q").mapInArrow(run, "qid long, id long, key double")


def searched_at_once(n_queries: int, dim: int, k: int) -> bool:
    """Whether so many queries may be sent to all tasks."""
    return n_queries * (dim + 1) * 8 <= QUERY_BYTES and n_queries * k <= BEST_ROWS


def elected_keys(leaf_votes: DataFrame, forest: Forest, corpus: DataFrame, n_corpus: int, queries: DataFrame, votes_required: float, k: int, metric: Metric | str = L2) -> DataFrame:
    """(qid, id, key): at least the k nearest elected rows of every query, for few enough queries to be sent to all tasks.

    Rows of the corpus meet their own leaf votes in shards of bounded size; there the votes of all queries are
    summed, and what is elected is measured. So neither votes nor candidates are shuffled, only k rows a query and shard.
    """
    metric = Metric.of(metric)
    qids, q = as_matrix(queries.filter("qid IS NOT NULL").select("qid", of_dimension(forest.dim)), "qid", forest.dim)
    slots = np.arange(forest.n_trees) << forest.depth
    parts = []  # of the queries: the leaves they reach, in order, and the rows that reach them
    for lo in range(0, len(q), CELLS // SHARD_ROWS):
        own = slice(lo, lo + CELLS // SHARD_ROWS)
        met = (forest.leaves(q[own]) + slots).ravel()
        order = np.argsort(met, kind="stable")
        parts.append((qids[own], q[own], met[order], order // forest.n_trees))
    depth, dim = forest.depth, forest.dim
    shared = corpus.sparkSession.sparkContext.broadcast(parts)

    def run(votes: pa.Table, rows: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if votes.num_rows and rows.num_rows:
            ids, c = rows.column("id").to_numpy(), matrix(pa.concat_arrays(rows.column("vec").chunks), dim)
            named, place = np.unique(ids, return_inverse=True)
            tree, leaf, label, vote = (votes.column(x).to_numpy() for x in ("tree", "leaf", "label", "vote"))
            col = np.searchsorted(named, label)
            real = named[np.minimum(col, len(named) - 1)] == label
            slot = (tree.astype(np.int64) << depth) + leaf
            order = np.flatnonzero(real)[np.argsort(slot[real], kind="stable")]
            slot, col, vote = slot[order], col[order], vote[order]
            first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]]) if len(slot) else np.zeros(0, np.int64)
            last = np.r_[first[1:], len(slot)]
            for own, x, met, reach in shared.value:
                total = np.zeros((len(own), len(named)))
                begin, end = (np.searchsorted(met, slot[first], side) for side in ("left", "right"))
                for i in np.flatnonzero(end > begin).tolist():
                    at = slice(first[i], last[i])
                    total[reach[begin[i] : end[i], None], col[at]] += vote[at]
                row, found, key = best_of(x, c, ids, k, metric, among=((total > 0) & (total >= votes_required - ROOM))[:, place])
                out = [np.concatenate(y) for y in zip(out, (own[row], found, key), strict=True)]
        return pa.table(dict(zip(("qid", "id", "key"), out, strict=True)))

    shard = lambda name: F.pmod(F.xxhash64(F.col(name).cast("long")), F.lit(-(-n_corpus // SHARD_ROWS))).alias("shard")
    votes = leaf_votes.select(shard("label"), "tree", "leaf", F.col("label").cast("long").alias("label"), "vote")
    rows = corpus.select(shard("id"), F.col("id").cast("long").alias("id"), "vec")
    return votes.groupBy("shard").cogroup(rows.groupBy("shard")).applyInArrow(run, KEYS)


def rerank(candidates: DataFrame, corpus: DataFrame, queries: DataFrame, k: int, metric: Metric | str = L2, return_distances: bool = True) -> DataFrame:
    """(qid, rank, id[, distance]): the k nearest candidates of every query, -1 where there are fewer."""
    check_k(k)
    out = padded(ranked(candidate_keys(candidates, corpus, queries, metric), k, metric), queries, k)
    return out if return_distances else out.drop("distance")
