import glob
import os

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__
from ballot.plans.index import VectorIndex
from ballot.plans.queries import NAMES, forget

SF = "/root/testdata/sf0.001"


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(f"{v:.5g}" if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False))


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["qid", "rank", "id", "distance"] and df.count() == 100


@pytest.mark.parametrize("name", [n for n in NAMES if n in __spark_entry__.oracle_sql()])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    got = __spark_entry__.queries()[name](spark, SF).toPandas()
    want = con.sql(__spark_entry__.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["recall_at_k", "recall_at_k_rf", "recall_at_k_pca"])
def test_recall(spark, name):
    got = __spark_entry__.queries()[name](spark, SF).toPandas()
    assert got.recall.mean() >= 0.9


#: Queries on the index, compared with their SQL on more rows than the labels' search takes as one leaf.
LARGER = ["rp_leaf_assignment", "rp_route", "pca_leaf_assignment", "rf_terminal_leaves", "rf_root_gain", "rf_route", "rf_leaf_votes", "leaf_votes_normalised", "ann_pca_ip", "ann_reloaded", "ann_rf_l2", "ann_rp_ip", "recall_at_k", "recall_at_k_rf"]


@pytest.fixture(scope="module")
def larger(tmp_path_factory):
    folder = tmp_path_factory.mktemp("larger")
    vecs = np.random.default_rng(5).normal(size=(4200, 64)).astype(np.float32)
    vecs /= np.linalg.norm(vecs, axis=1, keepdims=True)
    table = {"vec_id": np.arange(4200), "embedding": pa.array(list(vecs), pa.list_(pa.float32())), "label": pa.array(np.arange(4200) % 10, pa.int32())}
    pq.write_table(pa.table(table), folder / "embeddings.parquet")
    return str(folder)


@pytest.mark.parametrize("name", LARGER)
def test_index_query_equals_its_sql_on_a_larger_table(spark, larger, name):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{larger}/embeddings.parquet'")
    got = __spark_entry__.queries()[name](spark, larger).toPandas()
    assert rows(got) == rows(con.sql(__spark_entry__.oracle_sql()[name]).df())


#: Queries that search by the index.
SEARCHED = ["recall_at_k", "ann_reloaded", "ann_rf_l2", "recall_at_k_rf", "ann_pca_ip"]


@pytest.mark.parametrize("name", SEARCHED)
def test_search_lists_no_votes_of_all_pairs(spark, name, monkeypatch):
    forget()
    want = rows(__spark_entry__.queries()[name](spark, SF).toPandas())
    forget()
    monkeypatch.setattr(VectorIndex, "votes", None)
    assert rows(__spark_entry__.queries()[name](spark, SF).toPandas()) == want
