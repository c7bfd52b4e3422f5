"""The index: build once, then search approximately or exactly."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballot.functions.vectors import L2, Metric
from ballot.operators.build import FIT_ROWS, grow, wanted_rows
from ballot.operators.evaluate import candidate_counts, votes_for_recall
from ballot.operators.exact import QUERY_BYTES, check_k, exact_search, padded, ranked, size_of
from ballot.operators.forest import Forest, check_shape, leaves_of, resolve_density, routed
from ballot.operators.passes import grow_by_passes
from ballot.operators.rerank import elected_keys, rerank, searched_at_once
from ballot.operators.votes import elected, leaf_counts, leaf_votes, votes, votes_of
from ballot.sources.vectors import check_schema, check_vectors

KINDS = ("RP", "PCA", "RF")
AT_ONCE = 4  # times FIT_ROWS: rows, of 64 MB at most, that all place splits without passes


class VectorIndex:
    """An index over corpus (id, vec). Frames in, frames out; nothing runs before build, save or the caller's action,
    but for the checks of what is passed in.
    """

    def __init__(self, corpus: DataFrame, index_type: str = "PCA", seed: int = 0):
        if not isinstance(corpus, DataFrame):
            raise ValueError("the corpus must be a DataFrame with id and vec")
        if index_type not in KINDS:
            raise ValueError(f"unknown index type {index_type!r}; use one of {', '.join(KINDS)}")
        self.corpus, self.index_type, self.seed = corpus, index_type, seed
        self.n_corpus, self.dim = check_vectors(corpus, "corpus")
        self.forest: Forest | None = None
        self.leaf_votes: DataFrame | None = None

    @property
    def built(self) -> bool:
        return self.forest is not None

    @property
    def empty(self) -> bool:
        return self.forest is None or not self.forest.n_trees

    def build(self, train: DataFrame, knn: DataFrame, n_trees: int, depth: int, density: float | str | None = "auto", b: int = 1, fit_rows: int | None = FIT_ROWS) -> VectorIndex:
        """train: (train_id, vec); knn: (train_id, labels), each row the ids of its nearest corpus rows.

        Splits are placed by about `fit_rows` training rows at most (and by 64 MB of them); all training rows
        are routed, and all their labels counted. With None all training rows place splits, by passes over them
        where they are more than 64 MB or four times FIT_ROWS.
        """
        if self.built:
            raise RuntimeError("this index is built already; make another for other parameters")
        density = resolve_density(density, self.dim)
        n_train, _ = check_vectors(train, "train", self.dim, "train_id")
        check_shape(self.index_type, n_trees, depth, n_train if fit_rows is None else min(n_train, fit_rows))
        forest = Forest(self.index_type, n_trees, depth, self.dim, density, b, self.seed)
        if fit_rows is None and n_train > wanted_rows(AT_ONCE * FIT_ROWS, self.dim):
            grow_by_passes(train, forest, knn)
        else:
            grow(train, forest, n_train, knn, n_train if fit_rows is None else fit_rows)
        counts = leaf_counts(leaves_of(train, "train_id", forest, training=True), knn)
        self.leaf_votes = leaf_votes(counts, b, n_trees if self.index_type == "RF" else None)
        self.forest = forest
        return self

    def persist(self) -> VectorIndex:
        """Keeps the leaf votes in the executors for repeated searches; unpersist() frees them."""
        self._ready()
        self.leaf_votes.persist()
        return self

    def unpersist(self) -> VectorIndex:
        self._ready()
        self.leaf_votes.unpersist()
        return self

    def _ready(self) -> None:
        if not self.built:
            raise RuntimeError("this index has no trees yet; build or load it first")

    def leaves(self, queries: DataFrame) -> DataFrame:
        """(qid, tree, leaf)."""
        self._ready()
        check_schema(queries, "queries", "qid")
        return routed(queries, "qid", self.forest)

    def votes(self, queries: DataFrame) -> DataFrame:
        """(qid, label, votes)."""
        return votes(self.leaves(queries), self.leaf_votes)

    def candidates(self, queries: DataFrame, votes_required: float) -> DataFrame:
        """(qid, label, votes) of what is elected; for RF votes are probabilities, else counts."""
        return elected(self.votes(queries), votes_required)

    def n_candidates(self, queries: DataFrame, votes_required: float) -> DataFrame:
        return candidate_counts(self.candidates(queries, votes_required), queries)

    def votes_for_recall(self, queries: DataFrame, k: int, target: float = 0.9, dist: Metric | str = L2) -> float:
        """A votes_required that elects a share `target` of these queries' exact neighbours; a sample of queries will do."""
        exact = self.exact_search(queries, k, dist).filter("id >= 0").persist()
        try:
            few = size_of(queries)[0] * k * self.forest.n_trees * 32 <= QUERY_BYTES
            return votes_for_recall(votes_of(exact, self.leaves(queries), self.leaf_votes, few), exact, target)
        finally:
            exact.unpersist()

    def ann(self, queries: DataFrame, k: int, votes_required: float, dist: Metric | str = L2, return_distances: bool = False, vectors: DataFrame | None = None) -> DataFrame:
        """(qid, rank, id[, distance]): the k nearest of the rows that get the votes, -1 where there are fewer.

        vectors: (id, vec) to rank them by, if not by the corpus's own.
        """
        self._ready()
        check_k(k)
        check_schema(queries, "queries", "qid")
        vectors = self.corpus if vectors is None else vectors
        if not searched_at_once(size_of(queries)[0], self.dim, k):
            return rerank(self.candidates(queries, votes_required), vectors, queries, k, dist, return_distances)
        keys = elected_keys(self.leaf_votes, self.forest, vectors, self.n_corpus, queries, votes_required, k, dist)
        out = padded(ranked(keys, k, dist), queries, k)
        return out if return_distances else out.drop("distance")

    def exact_search(self, queries: DataFrame, k: int, dist: Metric | str = L2, return_distances: bool = False) -> DataFrame:
        return exact_search(self.corpus, queries, k, dist, return_distances)

    def nodes(self) -> DataFrame:
        """(tree, node, level, split_dim, split_point)."""
        self._ready()
        return self.corpus.sparkSession.createDataFrame(self.forest.nodes_table(), "tree int, node int, level int, split_dim int, split_point double")

    def save(self, path: str) -> None:
        """The model as Parquet tables below path: meta (parameters and arrays of bounded size) and leaf_votes."""
        self._ready()
        f = self.forest
        arrays = {k: None if (v := getattr(f, k)) is None else {"shape": v.shape, "kind": v.dtype.str, "values": v.ravel().tolist()} for k in ("splits", "split_dims", "dims", "weights", "cut_value", "cut_id")}
        row = (f.kind, f.n_trees, f.depth, f.dim, f.density, f.b, f.seed, self.n_corpus, json.dumps(arrays))
        spark = self.corpus.sparkSession
        meta = "kind string, n_trees int, depth int, dim int, density double, b int, seed long, n_corpus long, arrays string"
        spark.createDataFrame([row], meta).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
        self.leaf_votes.write.mode("overwrite").parquet(f"{path}/leaf_votes")

    @classmethod
    def load(cls, spark: SparkSession, path: str, corpus: DataFrame) -> VectorIndex:
        r = spark.read.parquet(f"{path}/meta").first()
        out = cls(corpus, r.kind, r.seed)
        if (out.dim, out.n_corpus) != (r.dim, r.n_corpus):
            raise ValueError(f"the model was built for {r.n_corpus} rows of dimension {r.dim}, not {out.n_corpus} of {out.dim}")
        arrays = {k: None if v is None else np.array(v["values"], v["kind"]).reshape(v["shape"]) for k, v in json.loads(r.arrays).items()}
        out.forest = Forest(r.kind, r.n_trees, r.depth, r.dim, r.density, r.b, r.seed, **arrays)
        out.leaf_votes = spark.read.parquet(f"{path}/leaf_votes")
        return out


def positional(df: DataFrame, vec_column: str = "vec", id_column: str = "id") -> DataFrame:
    """(id, vec) with ids 0, 1, ... in the frame's order, for sources without ids.

    Rows are counted a partition; each partition then adds the count of those before it. The frame must
    give the same partitions both times, as a table read from files does.
    """
    vec = df.select(F.col(vec_column).alias("vec"))
    placed = vec.withColumn("at", F.monotonically_increasing_id())  # partition number times 2^33, plus place
    sizes = placed.groupBy(F.shiftright("at", 33).alias("part")).count().orderBy("part").collect()  # one record a partition
    before, total = {}, 0
    for r in sizes:
        before[r.part] = total
        total += r["count"]
    rows = df.sparkSession.createDataFrame(list(before.items()), "part long, before long")
    placed = placed.join(F.broadcast(rows), F.shiftright("at", 33) == F.col("part"))
    return placed.select((F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias(id_column), "vec")
