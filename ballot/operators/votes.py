"""Leaf labels, votes and election."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROOM = 1e-12  # sums of normalised votes are compared with this much room


def leaf_counts(train_leaves: DataFrame, knn: DataFrame) -> DataFrame:
    """(tree, leaf, label, count) of the labels of the training rows in each leaf; labels under 0 are no rows.

    train_leaves: (train_id, leaves), as routing gives them; a training row is joined to its labels once, not
    once a tree. Counts are summed before they are shuffled.
    """
    both = train_leaves.join(knn.select("train_id", F.filter("labels", lambda x: x >= 0).alias("labels")), "train_id")
    slots = both.select(F.posexplode("leaves").alias("tree", "leaf"), "labels").select("tree", "leaf", F.explode("labels").alias("label"))
    return slots.groupBy("tree", "leaf", "label").agg(F.count(F.lit(1)).alias("count"))


def leaf_votes(counts: DataFrame, b: int = 1, n_trees: int | None = None) -> DataFrame:
    """(tree, leaf, label, vote): labels of `b` rows or more.

    The vote is the count; with n_trees the count's share of its leaf's kept counts over n_trees, so that
    the votes a query meets add up to 1 at most.
    """
    kept = counts.filter(F.col("count") >= b)
    if n_trees is None:
        return kept.select("tree", "leaf", "label", F.col("count").cast("double").alias("vote"))
    total = kept.groupBy("tree", "leaf").agg(F.sum("count").alias("__total"))
    return kept.join(total, ["tree", "leaf"]).select("tree", "leaf", "label", (F.col("count") / (F.col("__total") * n_trees)).alias("vote"))


def votes(query_leaves: DataFrame, leaf_votes: DataFrame) -> DataFrame:
    """(qid, label, votes): sums over the leaves that a query reaches."""
    return query_leaves.join(leaf_votes, ["tree", "leaf"]).groupBy("qid", "label").agg(F.sum("vote").alias("votes"))


def votes_of(pairs: DataFrame, query_leaves: DataFrame, leaf_votes: DataFrame, few: bool = False) -> DataFrame:
    """votes of the stated pairs (qid, id) alone; `few`: they may be sent to all tasks, once a tree."""
    met = pairs.select("qid", F.col("id").alias("label")).join(query_leaves, "qid")
    return leaf_votes.join(F.broadcast(met) if few else met, ["tree", "leaf", "label"]).groupBy("qid", "label").agg(F.sum("vote").alias("votes"))


def elected(summed: DataFrame, votes_required: float) -> DataFrame:
    """Labels with the votes required; at 0 or less every label met."""
    return summed.filter(F.col("votes") >= votes_required - ROOM)
