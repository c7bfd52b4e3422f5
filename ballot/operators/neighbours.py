"""Training labels of many rows without comparing all pairs: search within the leaves of balanced trees.

Trees of random projections, as deep as leaves of about LEAF_ROWS rows ask for, are grown from a bounded
sample; every row is routed (ties by id, so that equal vectors spread over leaves), and each leaf's rows
are compared among themselves. A row's labels are the best of what its leaves offer. With LEAF_ROWS rows
or fewer there is one leaf, and the labels are exact. Work grows as rows times LEAF_ROWS times trees.

The sample places no more than a bounded number of leaves, so on very many rows leaves grow with them. A leaf whose
vectors take more than LEAF_BYTES is cut into chunks by a hash of the id, and each pair of chunks is a group of
its own: the same rows are compared, but no task holds more than two chunks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballot.functions.vectors import L2, Metric
from ballot.operators.build import FIT_ROWS, grow
from ballot.operators.exact import best_rows, check_k, folded, ranked
from ballot.operators.forest import Forest, leaves_of
from ballot.sources.vectors import check_vectors, matrix

LEAF_ROWS = 4096
LABEL_TREES = 8
LEAF_BYTES = 64 << 20  # of a chunk of a leaf's vectors, as doubles


def leaf_depth(rows: int, leaf_rows: int, fit_rows: int = FIT_ROWS) -> int:
    """Halvings until a leaf has about `leaf_rows` rows; eight sampled rows a leaf at least place the splits."""
    wanted = math.ceil(math.log2(max(1.0, rows / leaf_rows)))
    return min(wanted, max(0, int(math.log2(max(1, min(rows, fit_rows) // 8)))))


def near_labels(corpus: DataFrame, k: int, metric: Metric | str = L2, seed: int = 0, leaf_rows: int = LEAF_ROWS, trees: int = LABEL_TREES, fit_rows: int = FIT_ROWS, leaf_bytes: int = LEAF_BYTES) -> DataFrame:
    """(train_id, labels): for each corpus row about its k nearest corpus rows, itself among them."""
    check_k(k)
    metric = Metric.of(metric)
    rows, dim = check_vectors(corpus, "corpus")
    depth = leaf_depth(rows, max(leaf_rows, 2 * k), fit_rows)
    train = corpus.select(F.col("id").cast("long").alias("train_id"), "vec")
    if depth:
        forest = grow(train, Forest("RP", trees, depth, dim, 1.0, 1, seed), rows, fit_rows=fit_rows)
        placed = leaves_of(train, "train_id", forest, training=True, with_vec=True).select("train_id", "vec", F.posexplode("leaves").alias("tree", "leaf"))
    else:
        placed = train.select("train_id", "vec", F.lit(0).alias("tree"), F.lit(0).alias("leaf"))

    most = max(1, leaf_bytes // (8 * max(1, dim)))
    cut = in_chunks(placed, most) if rows > most else placed.withColumn("own", F.lit(0)).withColumn("first", F.lit(0)).withColumn("second", F.lit(0))

    def near(leaf: pa.Table) -> pa.Table:
        leaf = leaf.combine_chunks()
        ids, x, own = leaf.column("train_id").to_numpy(), matrix(pa.concat_arrays(leaf.column("vec").chunks), dim), leaf.column("own").to_numpy()
        step = max(1, (4 << 20) // max(1, k * 8))
        out = []
        for queries, others in sides(own):
            base = ids[others], x[others]
            for lo in range(0, len(queries), step):
                at = queries[lo : lo + step]
                out += best_rows(ids[at], x[at], iter([base]), k, metric)
        return pa.Table.from_batches(out)

    found = cut.groupBy("tree", "leaf", "first", "second").applyInArrow(near, "qid long, id long, key double")
    if depth or rows > most:
        found = found.groupBy("qid", "id").agg(F.min("key").alias("key"))  # leaves of several trees name the same rows
    return folded(ranked(found, k, metric).drop("distance")).select(F.col("qid").alias("train_id"), F.col("ids").alias("labels"))


def sides(own: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(positions of queries, positions of what they are compared with) in a group of one chunk or of two."""
    a = np.flatnonzero(own == own.min())
    b = np.flatnonzero(own != own.min())
    return [(a, b), (b, a)] if len(b) else [(a, a)]


def in_chunks(placed: DataFrame, most: int) -> DataFrame:
    """placed with own (a row's chunk) and the pair (first, second) of chunks it is copied to, one row a pair.

    Leaves are counted exactly; there are trees times leaves of them, both bounded, so that those to cut can be broadcast.
    """
    large = placed.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)
    large = large.select("tree", "leaf", F.ceil(F.col("n") / most).cast("int").alias("chunks"))
    parts = placed.join(F.broadcast(large), ["tree", "leaf"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    parts = parts.withColumn("own", F.pmod(F.xxhash64("train_id"), F.col("chunks")).cast("int"))
    parts = parts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return parts.withColumn("first", F.least("own", "other")).withColumn("second", F.greatest("own", "other")).drop("chunks", "other")
