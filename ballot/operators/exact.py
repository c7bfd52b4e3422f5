"""Exact search: every query against every corpus row, by L2 or inner product.

Two plans with the same result. `expressions` stays in the JVM and suits few rows. `kernel` works on blocks
as matrices: queries of bounded size are sent to the tasks that scan the corpus, and each task's best k a
query are shuffled; a corpus of bounded size is sent to the tasks that read more queries than that; where
both are larger they meet block by block in the cells of a grid. What is left is ranked. Ties go to the
lower id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ballot.functions.vectors import L2, Metric, reported, sort_key
from ballot.sources.vectors import check_schema, matrix

QUERY_BYTES = 32 << 20  # of queries sent to all tasks at once
BEST_ROWS = 640 << 10  # rows of k nearest that queries sent to all tasks have at most: a task holds some multiples of them
BLOCK_BYTES = 1 << 20  # of a block of the grid
CELLS = 4 << 20  # distances held at once in a task


def check_k(k: int) -> None:
    if k < 1:
        raise ValueError(f"a search needs k of 1 or more, not {k}")


def all_pairs(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, __q, id, __c): the stated queries against all rows; they are broadcast if their size allows it."""
    n, dim = size_of(queries)
    q = queries.select("qid", F.col("vec").alias("__q"))
    return corpus.select("id", F.col("vec").alias("__c")).crossJoin(F.broadcast(q) if n * dim * 8 <= QUERY_BYTES else q)


def pairwise(corpus: DataFrame, queries: DataFrame, metric: Metric | str = L2) -> DataFrame:
    """(qid, id, distance) of all pairs of a small corpus and few queries."""
    return all_pairs(corpus, queries).select("qid", "id", reported(sort_key(F.col("__q"), F.col("__c"), metric), metric).alias("distance"))


def ranked(keys: DataFrame, k: int, metric: Metric | str) -> DataFrame:
    """(qid, rank, id, distance) of the k least keys a query; Spark limits the groups before it shuffles them."""
    w = Window.partitionBy("qid").orderBy("key", "id")
    return keys.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("qid", "rank", "id", reported(F.col("key"), metric).alias("distance"))


def nearest(keys: DataFrame, metric: Metric | str) -> DataFrame:
    """ranked for k = 1: a least struct, summed on the map side, without a sort."""
    best = keys.groupBy("qid").agg(F.min(F.struct("key", "id")).alias("b"))
    return best.select("qid", F.lit(1).alias("rank"), F.col("b.id").alias("id"), reported(F.col("b.key"), metric).alias("distance"))


def padded(found: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """k rows a query: where fewer were found, id and distance -1."""
    slots = queries.select("qid", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank"))
    out = slots.join(found, ["qid", "rank"], "left")
    return out.select("qid", "rank", F.coalesce("id", F.lit(-1)).cast("long").alias("id"), F.coalesce("distance", F.lit(-1.0)).alias("distance"))


def best_of(q: np.ndarray, c: np.ndarray, ids: np.ndarray, k: int, metric: Metric, most: np.ndarray | None = None, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, key) of each query's k nearest rows of c, but those beyond `most`, its k-th key so far; ties at the end are all kept.

    among: [query, row], the pairs to choose from.
    """
    product = q @ c.T
    if metric is L2:
        near = (q * q).sum(axis=1)[:, None] - 2 * product + (c * c).sum(axis=1)[None, :]
    else:
        near = -product
    if among is not None:
        near[~among] = np.inf
    if near.shape[1] > k or most is not None:
        cut = np.partition(near, k - 1, axis=1)[:, k - 1] if most is None else most
        # The product form is off by some ulps of the norms; whatever may belong to the k is measured directly.
        room = 1e-9 * (1 + np.abs(q).sum(axis=1) * np.abs(c).max(initial=1.0) + np.abs(cut, where=np.isfinite(cut), out=np.zeros_like(cut)))
        kept = near <= (cut + room)[:, None]
        row, col = np.nonzero(kept if among is None else kept & among)
    else:
        row, col = np.nonzero(np.ones_like(near, bool) if among is None else among)
    a, b = q[row], c[col]
    key = ((a - b) ** 2).sum(axis=1) if metric is L2 else -(a * b).sum(axis=1)
    return row, ids[col], key


def trimmed(row: np.ndarray, ids: np.ndarray, key: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, key, row))
    row, ids, key = row[order], ids[order], key[order]
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    place = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
    keep = place < k
    return row[keep], ids[keep], key[keep]


def best_among(q: np.ndarray, parts: Iterator[tuple[np.ndarray, np.ndarray]], k: int, metric: Metric) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, key), in order: the k nearest rows of each query among all parts (ids, vectors)."""
    held, most = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), None
    for ids, c in parts:
        for lo in range(0, len(c), 4096):
            part, own = c[lo : lo + 4096], ids[lo : lo + 4096]
            step = max(1, CELLS // len(part))
            for at in range(0, len(q), step):
                row, found, key = best_of(q[at : at + step], part, own, k, metric, None if most is None else most[at : at + step])
                held = tuple(np.concatenate(x) for x in zip(held, (row + at, found, key), strict=True))
            if len(held[0]) > 1.5 * k * len(q) or most is None:
                held = trimmed(*held, k)
                most = held[2][k - 1 :: k] if len(held[0]) == k * len(q) else None
    return trimmed(*held, k)


def best_rows(qids: np.ndarray, q: np.ndarray, parts: Iterator[tuple[np.ndarray, np.ndarray]], k: int, metric: Metric) -> Iterator[pa.RecordBatch]:
    """best_among as rows of KEYS."""
    row, found, key = best_among(q, parts, k, metric)
    if len(row):
        yield pa.RecordBatch.from_arrays([pa.array(qids[row]), pa.array(found), pa.array(key)], names=["qid", "id", "key"])


KEYS = "qid long, id long, key double"


def as_matrix(df: DataFrame, id_column: str, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of a frame of bounded size."""
    got = df.select(F.col(id_column).cast("long").alias("id"), "vec").toArrow().combine_chunks()
    return got.column("id").to_numpy(), matrix(pa.concat_arrays(got.column("vec").chunks), dim) if got.num_rows else np.zeros((0, dim))


def kernel_keys(corpus: DataFrame, queries: DataFrame, dim: int, k: int, metric: Metric) -> DataFrame:
    """The k nearest of each task's part of the corpus, for few enough queries to be sent to all tasks."""
    shared = corpus.sparkSession.sparkContext.broadcast(as_matrix(queries, "qid", dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q = shared.value
        yield from best_rows(qids, q, ((b.column(0).to_numpy(), matrix(b.column(1), dim)) for b in batches), k, metric)

    return corpus.select(F.col("id").cast("long").alias("id"), "vec").mapInArrow(run, KEYS)


def sent_whole(corpus: DataFrame, dim: int, query_bytes: int | None = None) -> bool:
    """Whether the corpus may be sent to all tasks: up to 64 MB, twice what queries may have."""
    return size_of(corpus)[0] * dim * 8 <= 2 * min(QUERY_BYTES if query_bytes is None else query_bytes, QUERY_BYTES)


def dealt(queries: DataFrame) -> DataFrame:
    """(qid, vec) in even parts, several a core."""
    return queries.select(F.col("qid").cast("long").alias("qid"), "vec").repartition(queries.sparkSession.sparkContext.defaultParallelism * 4, "qid")


def some_queries(b: pa.RecordBatch, dim: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(qids, vectors) of as many queries at a time as have BEST_ROWS nearest."""
    step = max(1, BEST_ROWS // k)
    for lo in range(0, b.num_rows, step):
        part = b.slice(lo, step)
        yield part.column(0).to_numpy(), matrix(part.column(1), dim)


def scan_keys(corpus: DataFrame, queries: DataFrame, dim: int, k: int, metric: Metric) -> DataFrame:
    """The k nearest rows of a corpus that is small enough to be sent to all tasks, for any number of queries; nothing else is shuffled."""
    shared = corpus.sparkSession.sparkContext.broadcast(as_matrix(corpus, "id", dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for qids, q in some_queries(b, dim, k):
                yield from best_rows(qids, q, iter([shared.value]), k, metric)

    return dealt(queries).mapInArrow(run, KEYS)


def scan_labels(corpus: DataFrame, train: DataFrame, dim: int, k: int, metric: Metric) -> DataFrame:
    """training_labels of scan_keys: a task has all of a row's nearest, in order."""
    shared = corpus.sparkSession.sparkContext.broadcast(as_matrix(corpus, "id", dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for qids, q in some_queries(b, dim, k):
                row, found, _ = best_among(q, iter([shared.value]), k, metric)
                ends = np.r_[0, np.cumsum(np.bincount(row, minlength=len(q)))].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(qids), pa.ListArray.from_arrays(ends, pa.array(found))], names=["train_id", "labels"])

    return dealt(train.withColumnRenamed("train_id", "qid")).mapInArrow(run, "train_id long, labels array<long>")


def packed(df: DataFrame, id_column: str, dim: int, rows: int) -> DataFrame:
    """(block, ids, vecs): blocks of up to `rows` rows as little-endian bytes; block: a number to deal them by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for b in batches:
            for lo in range(0, b.num_rows, rows):
                part = b.slice(lo, rows)
                ids, x = part.column(0).to_numpy(), matrix(part.column(1), dim)
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([x.astype("<f8").tobytes()], pa.binary())], names=["block", "ids", "vecs"])
                number += 1

    out = df.select(F.col(id_column).cast("long").alias("id"), "vec").mapInArrow(run, "block long, ids binary, vecs binary")
    return out.withColumn("block", F.xxhash64("block", "ids"))


def grid_keys(corpus: DataFrame, queries: DataFrame, n_queries: int, dim: int, k: int, metric: Metric) -> DataFrame:
    """The k nearest in each cell of a grid: blocks of queries by columns, blocks of the corpus by rows.

    Every block is copied along its own side of the grid only, so a cell reads an even part of either, and
    nothing goes through the driver; a cell's pairs of blocks are met one at a time, those of a block of queries
    one after another, so that its best k are kept over all blocks that it meets there.
    """
    rows = max(1, BLOCK_BYTES // (8 * dim))
    columns = max(1, -(-n_queries * dim * 8 // QUERY_BYTES))
    lines = max(1, -(-corpus.sparkSession.sparkContext.defaultParallelism * 2 // columns))
    c = packed(corpus, "id", dim, rows).select(F.pmod("block", F.lit(lines)).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("j"), F.col("ids").alias("cid"), F.col("vecs").alias("c"))
    q = packed(queries, "qid", dim, rows).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lines - 1).cast("long"))).alias("i"), F.pmod("block", F.lit(columns)).cast("int").alias("j"), F.col("ids").alias("qid"), F.col("vecs").alias("q"))
    pairs = q.join(c.hint("merge"), ["i", "j"]).select("qid", "q", "cid", "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = ([b.column(i)[at].as_py() for i in range(4)] for b in batches for at in range(b.num_rows))
        for (qids, q), same in groupby(met, itemgetter(0, 1)):
            parts = ((np.frombuffer(ids, "<i8"), np.frombuffer(c, "<f8").reshape(-1, dim)) for _, _, ids, c in same)
            yield from best_rows(np.frombuffer(qids, "<i8"), np.frombuffer(q, "<f8").reshape(-1, dim), parts, k, metric)

    return pairs.mapInArrow(run, KEYS)


def size_of(queries: DataFrame) -> tuple[int, int]:
    """(rows, dimension)"""
    r = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dim")).first()
    return r.n, r.dim or 0


def exact_keys(corpus: DataFrame, queries: DataFrame, k: int, metric: Metric | str = L2, plan: str = "kernel", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(qid, id, key): at least the k nearest rows of every query."""
    metric = Metric.of(metric)
    if plan == "expressions":
        pairs = all_pairs(corpus, queries)
        return pairs.select("qid", "id", sort_key(F.col("__q"), F.col("__c"), metric).alias("key"))
    if plan != "kernel":
        raise ValueError(f"unknown plan {plan!r}; use 'kernel' or 'expressions'")
    n, dim = size_of(queries)
    if n * dim * 8 <= query_bytes and n * k <= BEST_ROWS:
        return kernel_keys(corpus, queries, dim, k, metric)
    if sent_whole(corpus, dim, query_bytes):
        return scan_keys(corpus, queries, dim, k, metric)
    return grid_keys(corpus, queries, n, dim, k, metric)


def exact_search(corpus: DataFrame, queries: DataFrame, k: int, metric: Metric | str = L2, return_distances: bool = True, pad: bool = True, plan: str = "kernel") -> DataFrame:
    """(qid, rank, id[, distance]): each query's k nearest corpus rows, -1 where the corpus has fewer than k.

    A pre-filtered search is a search of corpus.filter(...).
    """
    check_k(k)
    check_schema(corpus, "corpus")
    check_schema(queries, "queries", "qid")
    keys = exact_keys(corpus, queries, k, metric, plan)
    out = nearest(keys, metric) if k == 1 else ranked(keys, k, metric)
    out = padded(out, queries, k) if pad else out
    return out if return_distances else out.drop("distance")


def folded(found: DataFrame) -> DataFrame:
    """(qid, ids, distances): one row a query, arrays in rank order; distances only if found has them."""
    value = F.struct("rank", "id", *(["distance"] if "distance" in found.columns else []))
    got = found.groupBy("qid").agg(F.array_sort(F.collect_list(value)).alias("x"))
    return got.select("qid", F.col("x.id").alias("ids"), *([F.col("x.distance").alias("distances")] if "distance" in found.columns else []))


def training_labels(corpus: DataFrame, train: DataFrame, k: int, metric: Metric | str = L2) -> DataFrame:
    """(train_id, labels): the ids of each training vector's k nearest corpus rows."""
    queries = train.select(F.col("train_id").alias("qid"), "vec")
    n, dim = size_of(queries)
    if n * k > BEST_ROWS and sent_whole(corpus, dim):
        check_k(k)
        check_schema(corpus, "corpus")
        check_schema(train, "train", "train_id")
        return scan_labels(corpus, train, dim, k, Metric.of(metric))
    found = exact_search(corpus, queries, k, metric, return_distances=False, pad=False)
    return folded(found).select(F.col("qid").alias("train_id"), F.col("ids").alias("labels"))
