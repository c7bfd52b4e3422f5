"""Quality of an approximate result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """(qid, recall): the share of a query's exact k that was found."""
    hits = exact.filter("id >= 0").join(found.filter("id >= 0").select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left")
    return hits.groupBy("qid").agg((F.count("hit") / k).alias("recall"))


def candidate_counts(elected: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, n_elected), 0 for queries without candidates."""
    n = elected.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    return queries.select("qid").join(n, "qid", "left").select("qid", F.coalesce("n", F.lit(0)).alias("n_elected"))


def votes_for_recall(votes: DataFrame, exact: DataFrame, target: float) -> float:
    """The votes to require so that a share `target` of the exact neighbours is elected, on these queries.

    votes: (qid, label, votes) of all labels met; exact: (qid, id). Neighbours that no leaf names have none.
    """
    true = exact.filter("id >= 0").join(votes.withColumnRenamed("label", "id"), ["qid", "id"], "left")
    got = true.agg(F.percentile(F.coalesce("votes", F.lit(0.0)), max(0.0, 1 - target)).alias("v")).first().v
    return float(got or 0.0)
