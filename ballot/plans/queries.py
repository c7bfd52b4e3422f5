"""The engine's operators over the driver's `embeddings`, and the same results in DuckDB's SQL.

All rows are corpus and all rows train, whatever their number, in trees of depth DEPTH as their SQL fixes it.
The queries are the rows whose id is a multiple of QUERY_EVERY. Vectors have unit length, so for
searches by inner product they are stretched by 1 + id % 7, which tells the metrics apart. The votes required
are measured at every size: those that elect a share TARGET of the true neighbours of as many other rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballot.functions.vectors import Metric, normalised
from ballot.operators import build, evaluate, exact, forest, passes, votes
from ballot.plans.index import VectorIndex
from ballot.sources.vectors import read_vectors, shared_folder

QUERY_EVERY = 50
K, TRAIN_K, TREES, DEPTH, SEED, DIM = 10, 50, 10, 5, 7, 64
LEAF, DEEPEST = 64, 15  # rows a leaf beyond which trees are deeper than DEPTH, and the depth that FIT_ROWS can place
TARGET, TUNE_AT = 0.95, 25  # the votes required elect this share of the neighbours of other queries: rows with this id modulo QUERY_EVERY
NARROW, LABELLED = 100, 3  # a search among the rows of one label
CLASS_LABELS = 5


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_vectors(spark, f"{sf_dir}/embeddings.parquet")


def queries_of(rows: DataFrame, at: int = 0) -> DataFrame:
    return rows.filter(F.col("id") % QUERY_EVERY == at).select(F.col("id").alias("qid"), "vec")


def train_of(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("id").alias("train_id"), "vec")


def stretched(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.transform(F.col("vec").cast("array<double>"), lambda x: x * (1 + F.col("id") % 7)).alias("vec"))


def shown(found: DataFrame) -> DataFrame:
    """Distances at five places, which all engines agree on."""
    return found.withColumn("distance", F.round("distance", 5))


def pairwise_l2(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return shown(exact.pairwise(c, queries_of(c)))


def pairwise_ip(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return shown(exact.pairwise(stretched(c), queries_of(c), "ip"))


def exact_l2_batch(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return shown(exact.exact_search(c, queries_of(c), K))


def exact_ip_batch(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return shown(exact.exact_search(stretched(c), queries_of(c), K, "ip"))


def exact_l2_expressions(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return shown(exact.exact_search(c, queries_of(c), K, plan="expressions"))


def exact_cosine(spark, sf_dir):
    c = corpus(spark, sf_dir)
    unit = stretched(c).select("id", normalised(F.col("vec")).alias("vec"))
    return shown(exact.exact_search(unit, queries_of(unit), K, "ip"))


def exact_single(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return shown(exact.exact_search(c, c.filter("id = 0").select(F.lit(0).cast("long").alias("qid"), "vec"), K))


def exact_k1_l2(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return shown(exact.exact_search(c, queries_of(c), 1))


def exact_k1_ip(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return shown(exact.exact_search(stretched(c), queries_of(c), 1, "ip"))


def exact_ids_only(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return exact.exact_search(c, queries_of(c), K, return_distances=False)


def exact_padded(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    return shown(exact.exact_search(rows.filter(F.col("label") == LABELLED).select("id", "vec"), queries_of(rows), NARROW))


def training_labels(spark, sf_dir):
    c = corpus(spark, sf_dir)
    found = exact.training_labels(c, train_of(c), TRAIN_K)
    return found.select("train_id", F.explode("labels").alias("label"))


def _projection(spark, sf_dir, density):
    c = corpus(spark, sf_dir)
    f = forest.Forest("RP", TREES, DEPTH, DIM, density, 1, SEED)
    f.weights = forest.rp_weights(TREES, DEPTH, DIM, density, SEED)
    shared = spark.sparkContext.broadcast(f.weights)

    def run(batches):
        import numpy as np

        from ballot.sources.vectors import matrix

        for b in batches:
            x = matrix(b.column(1), DIM)
            v = x @ shared.value.reshape(TREES * DEPTH, DIM).T
            tree, level = (np.broadcast_to(y, v.shape).ravel() for y in (np.repeat(np.arange(TREES), DEPTH), np.tile(np.arange(DEPTH), TREES)))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), TREES * DEPTH)), pa.array(tree.astype(np.int32)), pa.array(level.astype(np.int32)), pa.array(v.ravel())], names=["id", "tree", "level", "value"])

    return c.mapInArrow(run, "id long, tree int, level int, value double").withColumn("value", F.round("value", 6))


def rp_projection_dense(spark, sf_dir):
    return _projection(spark, sf_dir, 1.0)


def rp_projection_sparse(spark, sf_dir):
    return _projection(spark, sf_dir, 0.125)


_models: dict = {}


def depth_of(rows: int) -> int:
    """A depth for an index whose depth nothing fixes: a level more each time the rows double beyond 2^DEPTH leaves of LEAF rows."""
    return min(DEEPEST, max(DEPTH, math.ceil(math.log2(max(1, rows) / LEAF))))


def built(rows: DataFrame, kind: str, knn: DataFrame, b: int = 1) -> VectorIndex:
    """An index over rows, all of which train; knn: their labels."""
    return VectorIndex(rows, kind, SEED).build(train_of(rows), knn, TREES, DEPTH, b=b, fit_rows=None)


_labels: dict = {}


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact labels of all rows, searched once a session and directory."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _labels:
        c = corpus(spark, sf_dir)
        _labels[key] = exact.training_labels(c, train_of(c), TRAIN_K).persist(StorageLevel.MEMORY_AND_DISK)
    return _labels[key]


def index(spark: SparkSession, sf_dir: str, kind: str, b: int = 1) -> VectorIndex:
    """Built once a session, directory and kind: the queries on a model share it, as a caller's would."""
    key = (spark.sparkContext.applicationId, sf_dir, kind, b)
    if key not in _models:
        _models[key] = built(corpus(spark, sf_dir), kind, labels(spark, sf_dir), b).persist()
    return _models[key]


_required: dict = {}


def required(spark: SparkSession, sf_dir: str, kind: str) -> float:
    """The votes to require of an index, measured once a session."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _required:
        ix = index(spark, sf_dir, kind)
        _required[key] = ix.votes_for_recall(queries_of(ix.corpus, TUNE_AT), K, TARGET)
    return _required[key]


def forget() -> None:
    """Frees the models and labels kept for queries."""
    _required.clear()
    for kept in (_models, _labels):
        while kept:
            kept.popitem()[1].unpersist()


def rp_split_points(spark, sf_dir):
    return index(spark, sf_dir, "RP").nodes().select("tree", "node", F.round("split_point", 4).alias("split_point"))


def _assignment(spark, sf_dir, kind):
    ix = index(spark, sf_dir, kind)
    return forest.routed(train_of(ix.corpus), "train_id", ix.forest, training=True)


def rp_leaf_assignment(spark, sf_dir):
    return _assignment(spark, sf_dir, "RP")


def _counts(spark, sf_dir, kind="RP"):
    ix = index(spark, sf_dir, kind)
    return votes.leaf_counts(forest.leaves_of(train_of(ix.corpus), "train_id", ix.forest, training=True), labels(spark, sf_dir))


def leaf_votes_raw(spark, sf_dir):
    return votes.leaf_votes(_counts(spark, sf_dir))


def leaf_votes_min_b(spark, sf_dir):
    return votes.leaf_votes(_counts(spark, sf_dir), b=5)


def leaf_votes_normalised(spark, sf_dir):
    return votes.leaf_votes(_counts(spark, sf_dir), b=5, n_trees=TREES).withColumn("vote", F.round("vote", 9))


def rf_leaf_votes(spark, sf_dir):
    return votes.leaf_votes(_counts(spark, sf_dir, "RF"), b=2, n_trees=TREES).withColumn("vote", F.round("vote", 9))


def _route(spark, sf_dir, kind):
    ix = index(spark, sf_dir, kind)
    return ix.leaves(queries_of(ix.corpus))


def rp_route(spark, sf_dir):
    return _route(spark, sf_dir, "RP")


def pca_route(spark, sf_dir):
    return _route(spark, sf_dir, "PCA")


def rf_route(spark, sf_dir):
    return _route(spark, sf_dir, "RF")


def pca_leaf_assignment(spark, sf_dir):
    return _assignment(spark, sf_dir, "PCA")


def rp_votes(spark, sf_dir):
    ix = index(spark, sf_dir, "RP")
    return ix.votes(queries_of(ix.corpus))


def rp_elected(spark, sf_dir):
    ix = index(spark, sf_dir, "RP")
    return ix.candidates(queries_of(ix.corpus), required(spark, sf_dir, "RP"))


def rp_n_elected(spark, sf_dir):
    ix = index(spark, sf_dir, "RP")
    return ix.n_candidates(queries_of(ix.corpus), required(spark, sf_dir, "RP"))


def ann_rp_l2(spark, sf_dir):
    ix = index(spark, sf_dir, "RP")
    return shown(ix.ann(queries_of(ix.corpus), K, required(spark, sf_dir, "RP"), return_distances=True))


def _ann_ip(spark, sf_dir, kind):
    """Candidates by the index, ranked by the inner product with stretched vectors."""
    ix = index(spark, sf_dir, kind)
    q = queries_of(ix.corpus)
    return shown(ix.ann(q, K, required(spark, sf_dir, kind), "ip", return_distances=True, vectors=stretched(ix.corpus)))


def ann_rp_ip(spark, sf_dir):
    return _ann_ip(spark, sf_dir, "RP")


def ann_pca_ip(spark, sf_dir):
    return _ann_ip(spark, sf_dir, "PCA")


def ann_rf_ip(spark, sf_dir):
    return _ann_ip(spark, sf_dir, "RF")


def ann_single(spark, sf_dir):
    """One query."""
    ix = index(spark, sf_dir, "PCA")
    return shown(ix.ann(queries_of(ix.corpus).filter("qid = 0"), K, required(spark, sf_dir, "PCA"), return_distances=True))


def ann_zero_threshold(spark, sf_dir):
    """With a threshold of 0 every label met is a candidate, and nothing else."""
    ix = index(spark, sf_dir, "RP")
    return shown(ix.ann(queries_of(ix.corpus), K, 0.0, return_distances=True))


def ann_reloaded(spark, sf_dir):
    """A saved and loaded index answers as the one that was saved."""
    ix = index(spark, sf_dir, "RP")
    path = f"{shared_folder(spark)}/index-{spark.sparkContext.applicationId}"
    ix.save(path)
    again = VectorIndex.load(spark, path, ix.corpus)
    return shown(again.ann(queries_of(ix.corpus), K, required(spark, sf_dir, "RP"), return_distances=True))


def ann_rp_empty_election(spark, sf_dir):
    ix = index(spark, sf_dir, "RP")
    return shown(ix.ann(queries_of(ix.corpus), K, 1e9, return_distances=True))


def _roots(spark, sf_dir, work, schema):
    """What `work` yields for the rows that score each RF tree's root."""
    f = forest.Forest("RF", TREES, DEPTH, DIM, forest.resolve_density("auto", DIM), 1, SEED)

    def run(rows: pa.Table) -> pa.Table:
        t = rows.column("tree")[0].as_py()
        return pa.Table.from_batches(work(t, *passes.in_order(rows, DIM), build.tried_dims(f, t, 0)))

    found = passes.labelled_rows(train_of(corpus(spark, sf_dir)), f, labels(spark, sf_dir), 0)
    return found.groupBy("tree", "node").applyInArrow(run, schema)


def rf_root_gain(spark, sf_dir):
    def work(t, x, labels, dims):
        for d in dims:
            order = x[:, d].argsort(kind="stable")
            at, gain, split = build.boundary_gains(x[order, d], [labels[j] for j in order])
            yield pa.RecordBatch.from_arrays([pa.array([t] * len(at), pa.int32()), pa.array([d] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array(gain.round(6)), pa.array(split.round(6))], names=["tree", "dim", "position", "gain", "split"])

    return _roots(spark, sf_dir, work, "tree int, dim int, position int, gain double, split double")


def rf_root_split(spark, sf_dir):
    def work(t, x, labels, dims):
        found = build.best_split(x, labels, dims) or (-1, 0.0)
        yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([found[0]], pa.int32()), pa.array([round(found[1], 6)])], names=["tree", "dim", "split"])

    return _roots(spark, sf_dir, work, "tree int, dim int, split double")


def _shown_nodes(nodes):
    """-1 and 0 where a node has no split."""
    out = nodes.withColumn("split_point", F.coalesce(F.round("split_point", 4), F.lit(0.0)))
    return out.withColumn("split_dim", F.coalesce("split_dim", F.lit(-1)))


def rf_nodes(spark, sf_dir):
    return _shown_nodes(index(spark, sf_dir, "RF").nodes())


def _classes(spark, sf_dir):
    """Rows labelled by their class alone: CLASS_LABELS labels that all rows of a class share."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    labels = F.transform(F.sequence(F.lit(0), F.lit(CLASS_LABELS - 1)), lambda j: F.col("label").cast("long") * 100 + j)
    return corpus(spark, sf_dir), rows.select(F.col("vec_id").cast("long").alias("train_id"), labels.alias("labels"))


def rf_terminal(spark, sf_dir):
    """Nodes whose rows have one class have nothing to gain: they are terminal, and what is below them has no split."""
    rows, knn = _classes(spark, sf_dir)
    return _shown_nodes(built(rows, "RF", knn).nodes())


def rf_terminal_leaves(spark, sf_dir):
    """Rows that meet a terminal node go to its leftmost leaf."""
    rows, knn = _classes(spark, sf_dir)
    ix = built(rows, "RF", knn)
    return forest.routed(train_of(rows), "train_id", ix.forest, training=True)


def rf_leaf_assignment(spark, sf_dir):
    return _assignment(spark, sf_dir, "RF")


def _ann(spark, sf_dir, kind):
    ix = index(spark, sf_dir, kind)
    return shown(ix.ann(queries_of(ix.corpus), K, required(spark, sf_dir, kind), return_distances=True))


def ann_rf_l2(spark, sf_dir):
    return _ann(spark, sf_dir, "RF")


def pca_nodes(spark, sf_dir):
    return _shown_nodes(index(spark, sf_dir, "PCA").nodes())


def pca_root_direction(spark, sf_dir):
    f = index(spark, sf_dir, "PCA").forest
    rows = [(t, i, int(f.dims[t, 0, i]), round(float(f.weights[t, 0, i]), 6)) for t in range(TREES) for i in range(f.dims.shape[2])]
    return spark.createDataFrame(rows, "tree int, place int, dim int, weight double")


def ann_pca_l2(spark, sf_dir):
    return _ann(spark, sf_dir, "PCA")


def _recall(spark, sf_dir, kind):
    ix = index(spark, sf_dir, kind)
    q = queries_of(ix.corpus)
    return evaluate.recall(ix.ann(q, K, required(spark, sf_dir, kind)), ix.exact_search(q, K), K)


def recall_at_k(spark, sf_dir):
    return _recall(spark, sf_dir, "RP")


def recall_at_k_rf(spark, sf_dir):
    return _recall(spark, sf_dir, "RF")


def recall_at_k_pca(spark, sf_dir):
    return _recall(spark, sf_dir, "PCA")


NAMES = [
    "pairwise_l2", "pairwise_ip", "exact_l2_batch", "exact_ip_batch", "exact_l2_expressions", "exact_cosine", "exact_single", "exact_k1_l2", "exact_k1_ip", "exact_ids_only", "exact_padded",
    "training_labels", "rp_projection_dense", "rp_projection_sparse", "rp_split_points", "rp_leaf_assignment", "leaf_votes_raw", "leaf_votes_min_b", "leaf_votes_normalised",
    "rf_leaf_votes", "pca_leaf_assignment", "rp_route", "pca_route", "rf_route", "rp_votes", "rp_elected", "rp_n_elected", "ann_rp_l2", "ann_rp_ip", "ann_pca_ip", "ann_rf_ip", "ann_single", "ann_zero_threshold", "ann_reloaded", "ann_rp_empty_election", "rf_root_gain", "rf_root_split", "rf_nodes", "rf_terminal", "rf_terminal_leaves", "rf_leaf_assignment", "ann_rf_l2",
    "pca_root_direction", "pca_nodes", "ann_pca_l2", "recall_at_k", "recall_at_k_rf", "recall_at_k_pca",
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: globals()[n] for n in NAMES}
