import numpy as np
import pytest
from pyspark.sql import functions as F

from ballot.functions.vectors import IP, L2, Metric, normalised
from ballot.operators.exact import exact_search, folded, pairwise, training_labels
from ballot.sources.vectors import check_vectors, read_vectors

SF = "/root/testdata/sf0.001/embeddings.parquet"


def vectors(spark, rows, name="id"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], f"{name} long, vec array<float>")


def brute(c, q, k, metric):
    out = []
    for v in q:
        key = ((c - v) ** 2).sum(axis=1) if metric is L2 else -(c @ v)
        out.append(np.lexsort((np.arange(len(c)), key))[:k].tolist())
    return out


@pytest.mark.parametrize("plan", ["kernel", "expressions"])
@pytest.mark.parametrize("metric", [L2, IP])
def test_against_numpy(spark, plan, metric):
    r = np.random.default_rng(0)
    c = r.standard_normal((300, 9)).astype(np.float32).astype(np.float64)
    q = r.standard_normal((7, 9)).astype(np.float32).astype(np.float64)
    corpus, queries = vectors(spark, enumerate(c)).repartition(5), vectors(spark, enumerate(q), "qid")
    got = {x.qid: list(x.ids) for x in folded(exact_search(corpus, queries, 12, metric, plan=plan)).collect()}
    want = brute(c, q, 12, metric)
    assert [got[i] for i in range(7)] == want


def test_ties_go_to_the_lower_id(spark):
    corpus = vectors(spark, [(i, [1, 0]) for i in range(50)]).repartition(7)
    got = exact_search(corpus, vectors(spark, [(0, [1, 0])], "qid"), 5).orderBy("rank").collect()
    assert [(x.id, x.distance) for x in got] == [(i, 0.0) for i in range(5)]


def test_padding_and_k1(spark):
    corpus = vectors(spark, [(i, [i, 0]) for i in range(5)])
    q = vectors(spark, [(3, [2.2, 0]), (4, [9, 0])], "qid")
    for metric in ("l2", "ip"):
        got = exact_search(corpus, q, 8, metric).orderBy("qid", "rank").collect()
        assert len(got) == 16
        assert all((x.id, x.distance) == (-1, -1.0) for x in got if x["rank"] > 5)
        one = {x.qid: x.id for x in exact_search(corpus, q, 1, metric).collect()}
        assert one == {x.qid: x.id for x in got if x["rank"] == 1}
    assert "distance" not in exact_search(corpus, q, 2, return_distances=False).columns


def test_query_blocks_give_the_same(spark):
    c = read_vectors(spark, SF)
    q = c.filter("id % 50 = 0").select(F.col("id").alias("qid"), "vec")
    from ballot.operators.exact import exact_keys, ranked

    whole = ranked(exact_keys(c, q, 5), 5, "l2").orderBy("qid", "rank").collect()
    parts = ranked(exact_keys(c, q, 5, query_bytes=600), 5, "l2").orderBy("qid", "rank").collect()
    assert whole == parts


def test_self_query_is_nearest_and_metrics_agree_on_unit_vectors(spark):
    c = read_vectors(spark, SF)
    q = c.filter("id % 100 = 0").select(F.col("id").alias("qid"), "vec")
    l2 = exact_search(c, q, 4).orderBy("qid", "rank").collect()
    ip = exact_search(c.select("id", normalised(F.col("vec")).alias("vec")), q, 4, "ip").orderBy("qid", "rank").collect()
    assert all(x.id == x.qid and x.distance < 1e-9 for x in l2 if x["rank"] == 1)
    assert [x.id for x in l2] == [x.id for x in ip]
    assert pairwise(c, q).count() == c.count() * q.count()


def test_bad_inputs(spark):
    good = vectors(spark, [(0, [1, 2])])
    with pytest.raises(ValueError):
        exact_search(good, vectors(spark, [(0, [1, 2])], "qid"), 0)
    with pytest.raises(ValueError):
        Metric.of("cosine")
    with pytest.raises(ValueError):
        check_vectors(good.limit(0), "corpus")
    with pytest.raises(ValueError):
        check_vectors(vectors(spark, [(0, [1, 2]), (1, [1])]), "corpus")
    with pytest.raises(ValueError):
        check_vectors(spark.createDataFrame([(0, [1.0, None])], "id long, vec array<double>"), "corpus")
    with pytest.raises(ValueError):
        check_vectors(spark.createDataFrame([(0, "x")], "id long, vec string"), "corpus")
    with pytest.raises(ValueError):
        check_vectors(good, "corpus", dim=3)


def test_training_labels(spark):
    c = read_vectors(spark, SF)
    t = c.select(F.col("id").alias("train_id"), "vec")
    rows = training_labels(c, t, 3).collect()
    assert len(rows) == c.count() and all(r.labels[0] == r.train_id and len(r.labels) == 3 for r in rows)
