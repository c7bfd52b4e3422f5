import numpy as np
import pytest
from pyspark.sql import functions as F

from ballot.operators import build
from ballot.operators.evaluate import recall
from ballot.operators.exact import training_labels
from ballot.operators.neighbours import near_labels
from ballot.operators.forest import TERMINAL, Forest, projected_dims, resolve_density, routed
from ballot.operators.votes import leaf_counts, leaf_votes
from ballot.plans.index import VectorIndex, positional
from ballot.sources.vectors import read_vectors

SF = "/root/testdata/sf0.001/embeddings.parquet"


@pytest.fixture(scope="module")
def data(spark):
    c = read_vectors(spark, SF)
    train = c.select(F.col("id").alias("train_id"), "vec")
    knn = training_labels(c, train, 20).persist()
    q = c.filter("id % 50 = 0").select(F.col("id").alias("qid"), "vec")
    return c, train, knn, q


@pytest.fixture(scope="module", params=["RP", "PCA", "RF"])
def index(request, data):
    c, train, knn, _ = data
    return VectorIndex(c, request.param, seed=3).build(train, knn, 6, 4)


def test_median_split_of_odd_even_and_tied():
    def split(values):
        return build.median_split(np.array(values, float), np.arange(len(values)))[:3]

    assert split([5, 1, 3, 2, 4]) == (3.0, 3.0, 2)
    assert split([6, 1, 3, 2, 4, 5]) == (3.5, 3.0, 2)
    assert split([7, 7, 7, 7, 1]) == (7.0, 7.0, 1)


def test_every_training_row_has_one_leaf_a_tree_and_median_leaves_balance(data, index):
    _, train, _, _ = data
    got = routed(train, "train_id", index.forest, training=True)
    sizes = [r["count"] for r in got.groupBy("tree", "leaf").count().collect()]
    assert sum(sizes) == 6 * train.count()
    if index.index_type != "RF":
        assert len(sizes) == 6 * 16 and max(sizes) - min(sizes) <= 1


def test_training_leaves_agree_with_a_plain_loop(data):
    c, train, knn, _ = data
    f = VectorIndex(c, "RP", seed=5).build(train, knn, 2, 3).forest
    rows = sorted(train.collect())
    x = np.array([r.vec for r in rows], np.float64)
    want = np.zeros((len(x), 2), int)
    for t in range(2):
        def put(at, level, node, t=t):
            if level == 3:
                want[at, t] = node - 7
                return
            v = np.round(x[at] @ f.weights[t, level], 9)
            order = at[np.lexsort((at, v))]
            half = -(-len(at) // 2)
            put(np.sort(order[:half]), level + 1, 2 * node + 1)
            put(np.sort(order[half:]), level + 1, 2 * node + 2)

        put(np.arange(len(x)), 0, 0)
    assert (f.leaves(x, np.array([r.train_id for r in rows])) == want).all()


def test_same_seed_same_model_at_any_partitioning(data):
    c, train, knn, _ = data
    for kind in ("RP", "PCA", "RF"):
        a = VectorIndex(c, kind, 1).build(train, knn, 2, 3).forest
        b = VectorIndex(c, kind, 1).build(train.repartition(7), knn.repartition(3), 2, 3).forest
        assert np.allclose(a.splits, b.splits, atol=1e-8)
        if kind == "RF":
            assert (a.split_dims == b.split_dims).all()


def test_search(data, index):
    c, _, _, q = data
    exact = index.exact_search(q, 10)
    rows = index.ann(q, 10, -1.0)
    assert rows.count() == 10 * q.count() and rows.columns == ["qid", "rank", "id"]
    low = recall(rows, exact, 10).agg(F.avg("recall")).first()[0]
    assert low >= 0.9
    strict = 12 if index.index_type != "RF" else 1.2 / c.count()
    n_low = {r.qid: r.n_elected for r in index.n_candidates(q, -1.0).collect()}
    n_high = {r.qid: r.n_elected for r in index.n_candidates(q, strict).collect()}
    assert all(n_high[k] <= n_low[k] for k in n_low) and sum(n_high.values()) < sum(n_low.values())
    none = index.ann(q, 3, 1e9, "ip", return_distances=True).collect()
    assert len(none) == 3 * q.count() and all((r.id, r.distance) == (-1, -1.0) for r in none)


def test_votes_of_rf_add_up(data):
    c, train, knn, q = data
    ix = VectorIndex(c, "RF", 2).build(train, knn, 4, 3)
    sums = [r.s for r in ix.leaf_votes.groupBy("tree", "leaf").agg(F.sum("vote").alias("s")).collect()]
    assert np.allclose(sums, 1 / 4)
    assert all(r.s <= 1 + 1e-9 for r in ix.votes(q).groupBy("qid").agg(F.sum("votes").alias("s")).collect())


def test_minimum_count(spark):
    leaves = spark.createDataFrame([(0, [0]), (1, [0]), (2, [1])], "train_id long, leaves array<int>")
    knn = spark.createDataFrame([(0, [5, 6, -1]), (1, [5]), (2, [6])], "train_id long, labels array<long>")
    counts = leaf_counts(leaves, knn)
    rows = lambda df: sorted((r.leaf, r.label, r.vote) for r in df.collect())
    assert rows(leaf_votes(counts)) == [(0, 5, 2.0), (0, 6, 1.0), (1, 6, 1.0)]
    assert rows(leaf_votes(counts, 2)) == [(0, 5, 2.0)]
    assert rows(leaf_votes(counts, 1, 2)) == [(0, 5, 1 / 3), (0, 6, 1 / 6), (1, 6, 0.5)]


def entropy(labels):
    k = sum(map(len, labels)) / len(labels)
    _, v = np.unique(np.concatenate(labels), return_counts=True)
    return k * np.log2(len(labels)) - (v * np.log2(v)).sum() / len(labels)


def test_gains_by_definition():
    r = np.random.default_rng(1)
    key = np.sort(r.integers(0, 12, 40).astype(float))
    labels = [r.choice(20, 5, replace=False).tolist() for _ in range(40)]
    got = build.gains(key, labels)
    assert [g[0] for g in got] == np.flatnonzero(key[:-1] != key[1:]).tolist()
    for i, gain, split in got:
        a, b = labels[: i + 1], labels[i + 1 :]
        assert abs(gain - (entropy(labels) - len(a) / 40 * entropy(a) - len(b) / 40 * entropy(b))) < 1e-9
        assert split == (key[i] + key[i + 1]) / 2


def test_split_rules():
    x = np.array([[0.0, 0.0, 1.0], [0.0, 1.0, 1.0], [1.0, 2.0, 1.0], [1.0, 3.0, 1.0]])
    labels = [[0], [0], [1], [1]]
    assert build.best_split(x, labels, [0, 1]) == (0, 0.5)  # an equal gain doesn't replace the first
    assert build.best_split(x, labels, [1, 0]) == (1, 1.5)
    assert build.best_split(x, labels, [2]) is None  # constant
    assert build.best_split(x, [[4]] * 4, [0, 1]) is None  # nothing to gain


def test_terminal_nodes_lead_to_the_leftmost_leaf():
    f = Forest("RF", 1, 3, 2, 1.0, 1, 0)
    f.split_dims[0, 0], f.splits[0, 0] = 1, 0.5
    assert f.leaves(np.array([[0.0, 0.0], [0.0, 1.0]])).tolist() == [[0], [4]]
    f.split_dims[0, 0] = TERMINAL
    assert f.leaves(np.array([[9.0, 9.0]])).tolist() == [[0]]


def test_principal_direction():
    c = np.diag([4.0, 0.1, 0.1])
    v = build.principal(c, np.array([0.5, 0.5, 0.7]))
    assert abs(np.linalg.norm(v) - 1) < 1e-8 and v[0] > 0.99


def test_lifecycle_and_checks(spark, data, tmp_path):
    c, train, knn, q = data
    ix = VectorIndex(c, "RP")
    assert ix.empty
    with pytest.raises(RuntimeError):
        ix.ann(q, 3, 1)
    for bad in ({"n_trees": 0, "depth": 2}, {"n_trees": 1, "depth": 0}, {"n_trees": 1, "depth": 9}, {"n_trees": 1, "depth": 2, "density": 1.5}, {"n_trees": 1, "depth": 2, "density": 0}):
        with pytest.raises(ValueError):
            ix.build(train, knn, **bad)
    ix.build(train, knn, 2, 2)
    with pytest.raises(RuntimeError):
        ix.build(train, knn, 2, 2)
    with pytest.raises(ValueError):
        ix.ann(q, 0, 1)
    with pytest.raises(ValueError):
        VectorIndex(c, "KD")
    ix.save(str(tmp_path / "m"))
    again = VectorIndex.load(spark, str(tmp_path / "m"), c)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(again.ann(q, 5, 2, return_distances=True)) == key(ix.ann(q, 5, 2, return_distances=True))
    assert key(again.nodes()) == key(ix.nodes())


def test_density():
    assert resolve_density("auto", 64) == 0.125 and resolve_density(None, 9) == 1.0
    assert projected_dims(0.125, 64) == 8 and projected_dims(resolve_density("auto", 3721), 3721) == 60


def test_positional(spark):
    df = spark.createDataFrame([([float(i)],) for i in range(9)], "vec array<float>").repartition(3)
    assert sorted(r.id for r in positional(df).collect()) == list(range(9))
    assert positional(df.limit(0)).count() == 0


def test_streamed_queries(spark, data, tmp_path):
    from ballot.streaming.search import search_stream

    c, train, knn, q = data
    ix = VectorIndex(c, "RP").build(train, knn, 3, 3)
    q.write.parquet(str(tmp_path / "q"))
    got = []
    stream = spark.readStream.schema(q.schema).parquet(str(tmp_path / "q"))
    run = search_stream(ix, stream, 4, 2, lambda df, n: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(map(tuple, got)) == sorted(map(tuple, ix.ann(q, 4, 2, return_distances=True).collect()))


def test_all_rows_train_at_any_size(spark):
    from ballot.plans import queries

    rows = spark.range(60_000).select("id", F.array(F.lit(1.0)).alias("vec"))
    assert queries.train_of(rows).count() == 60_000
    assert [queries.depth_of(n) for n in (1, 500, 2000, 4096, 4097, 10**12)] == [5, 5, 5, 6, 7, 15]


def test_labels_through_a_grid_of_blocks(data, monkeypatch):
    from ballot.operators import exact

    c, train, _, _ = data
    want = {r.train_id: r.labels for r in training_labels(c, train, 20).collect()}
    monkeypatch.setattr(exact, "BEST_ROWS", 20 * 150)
    monkeypatch.setattr(exact, "BLOCK_BYTES", 64 * 8 * 100)
    monkeypatch.setattr(exact, "QUERY_BYTES", 64 * 8 * 200)
    assert {r.train_id: r.labels for r in training_labels(c, train, 20).collect()} == want


def test_near_labels(spark, data):
    c, train, _, _ = data
    want = {r.train_id: r.labels for r in training_labels(c, train, 20).collect()}
    assert {r.train_id: r.labels for r in near_labels(c, 20).collect()} == want  # one leaf
    got = {r.train_id: r.labels for r in near_labels(c, 20, leaf_rows=125).collect()}
    assert set(got) == set(want) and all(len(v) == 20 and v[0] == i for i, v in got.items())
    assert np.mean([len(set(got[i]) & set(want[i])) / 20 for i in want]) > 0.7
    equal = spark.range(300).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("vec"))
    assert all(len(r.labels) == 3 for r in near_labels(equal, 3, leaf_rows=40).collect())


@pytest.mark.parametrize("leaf_rows", [125, 10**6])
def test_near_labels_of_leaves_cut_into_chunks(data, leaf_rows):
    """Leaves larger than a task may hold give the labels that they give whole."""
    c = data[0]
    want = {r.train_id: r.labels for r in near_labels(c, 20, leaf_rows=leaf_rows).collect()}
    for rows in (60, 170):
        assert {r.train_id: r.labels for r in near_labels(c, 20, leaf_rows=leaf_rows, leaf_bytes=8 * 64 * rows).collect()} == want


def test_near_labels_of_equal_vectors_cut_into_chunks(spark):
    rows = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(60)], "id long, vec array<float>")
    got = {r.train_id: r.labels for r in near_labels(rows, 3, leaf_bytes=8 * 2 * 7).collect()}
    assert got == {i: [0, 1, 2] for i in range(60)}


@pytest.mark.parametrize("kind", ["RP", "PCA", "RF"])
def test_recall_where_a_tenth_of_the_rows_places_the_splits(spark, kind):
    c = read_vectors(spark, "/root/testdata/sf0.1/embeddings.parquet")
    n = c.count()
    ix = VectorIndex(c, kind, 7).build(c.withColumnRenamed("id", "train_id"), near_labels(c, 50, leaf_rows=n // 4), 10, 5, fit_rows=n // 10)
    assert ix.leaf_votes.select("label").distinct().count() == n  # every row can be elected
    tune = c.filter("id % 50 = 25").withColumnRenamed("id", "qid")
    q = c.filter("id % 50 = 0").withColumnRenamed("id", "qid")
    votes = ix.votes_for_recall(tune, 10, 0.97)
    got = recall(ix.ann(q, 10, votes), ix.exact_search(q, 10), 10).agg(F.avg("recall")).first()[0]
    few = ix.n_candidates(q, votes).agg(F.avg("n_elected")).first()[0]
    assert got >= 0.9 and few < n / 2, (got, few)


def test_queries_of_another_dimension_and_no_numbers(spark, data):
    c, train, knn, q = data
    ix = VectorIndex(c, "RP").build(train, knn, 2, 2)
    with pytest.raises(Exception, match="vectors of 64 elements"):
        ix.leaves(q.withColumn("vec", F.slice("vec", 1, 5))).collect()
    with pytest.raises(ValueError):
        VectorIndex(c.withColumn("vec", F.transform("vec", lambda x: F.lit(float("nan")))), "RP")


@pytest.mark.parametrize("kind", ["RP", "PCA", "RF"])
def test_growing_by_passes_equals_growing_at_once(data, kind, monkeypatch):
    """Rows beyond what tasks are sent all place splits."""
    from ballot.plans import index as plans

    c, train, knn, _ = data
    want = VectorIndex(c, kind, 4).build(train, knn, 2, 3).forest
    monkeypatch.setattr(plans, "FIT_ROWS", 100)
    got = VectorIndex(c, kind, 4).build(train, knn, 2, 3, fit_rows=None).forest
    assert np.allclose(got.splits, want.splits, rtol=0, atol=1e-8)
    if kind == "RF":
        assert (got.split_dims == want.split_dims).all()
    else:
        assert (got.cut_id == want.cut_id).all()


def test_medians_of_equal_values_by_passes(spark):
    from ballot.operators import passes

    rows = [(2**62 - i, [float(i % 3 == 0)] * 2) for i in range(90)] + [(-(2**62) - i, [2.0, 2.0]) for i in range(30)]
    train = spark.createDataFrame(rows, "train_id long, vec array<double>").repartition(3)
    at_once = build.grow(train, Forest("RP", 2, 3, 2, 1.0, 1, 1), len(rows))
    got = passes.grow_by_passes(train, Forest("RP", 2, 3, 2, 1.0, 1, 1))
    assert np.allclose(got.splits, at_once.splits) and (got.cut_id == at_once.cut_id).all()


def searched(df):
    return sorted((r.qid, r["rank"], r.id, round(r.distance, 9)) for r in df.collect())


@pytest.mark.parametrize("dist", ["l2", "ip"])
def test_search_lists_no_pairs(data, index, dist, monkeypatch):
    """Votes and candidates are made in the shards of the corpus; the plan by pairs of a query and a label has the same results."""
    from ballot.operators import rerank
    from ballot.operators.evaluate import votes_for_recall

    c, _, _, q = data
    vectors = c.select((F.col("id") + 0).alias("id"), F.transform("vec", lambda x: x * (1 + F.col("id") % 7)).alias("vec"))
    required = votes_for_recall(index.votes(q), index.exact_search(q, 5), 0.9)
    for least in (0.0, required, 1e9):
        want = searched(rerank.rerank(index.candidates(q, least), vectors, q, 5, dist))
        with monkeypatch.context() as m:
            m.setattr(rerank, "SHARD_ROWS", 37)
            m.setattr(VectorIndex, "votes", None)
            assert searched(index.ann(q, 5, least, dist, True, vectors=vectors)) == want
            assert index.votes_for_recall(q, 5, 0.9) == pytest.approx(required, abs=1e-12)


def test_search_of_parts_of_the_queries(data, index, monkeypatch):
    from ballot.operators import rerank

    want = searched(index.ann(data[3], 5, 0.0, return_distances=True))
    monkeypatch.setattr(rerank, "CELLS", rerank.SHARD_ROWS * 3)
    assert searched(index.ann(data[3], 5, 0.0, return_distances=True)) == want
    monkeypatch.setattr(rerank, "QUERY_BYTES", 0)
    assert searched(index.ann(data[3], 5, 0.0, return_distances=True)) == want


def test_search_of_repeated_rows_and_labels_that_are_no_rows(data, index):
    """A row that is there twice is found twice; labels that are no rows of the corpus drop out."""
    from ballot.operators.rerank import rerank

    c, _, _, q = data
    some = c.filter("id % 3 > 0").unionAll(c.filter("id % 5 = 1"))
    assert searched(index.ann(q, 20, 0.0, return_distances=True, vectors=some)) == searched(rerank(index.candidates(q, 0.0), some, q, 20))


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_labels_of_many_rows_meet_no_grid(data, metric, monkeypatch):
    from ballot.operators import exact

    c, train, _, _ = data
    want = {r.train_id: r.labels for r in training_labels(c, train, 20, metric).collect()}
    monkeypatch.setattr(exact, "BEST_ROWS", 20 * 7)
    monkeypatch.setattr(exact, "grid_keys", None)
    assert {r.train_id: r.labels for r in training_labels(c, train, 20, metric).collect()} == want
    few = c.filter("id < 13")
    queries = train.withColumnRenamed("train_id", "qid")
    assert all(len(r.labels) == 13 for r in training_labels(few, train, 20, metric).collect())
    keys = exact.ranked(exact.exact_keys(c, queries, 20, metric), 20, metric).filter("rank <= 20")
    assert {(r.qid, r.id) for r in keys.collect()} == {(t, i) for t, ids in want.items() for i in ids}


@pytest.mark.parametrize("kind", ["RP", "PCA", "RF"])
def test_all_rows_place_splits_at_once_where_they_are_few_enough(data, kind, monkeypatch):
    from ballot.plans import index as plans

    c, train, knn, _ = data
    want = VectorIndex(c, kind, 4).build(train, knn, 2, 3).forest
    monkeypatch.setattr(plans, "FIT_ROWS", 200)
    monkeypatch.setattr(plans, "grow_by_passes", None)
    got = VectorIndex(c, kind, 4).build(train, knn, 2, 3, fit_rows=None).forest
    assert (got.splits == want.splits).all()
