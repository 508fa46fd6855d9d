"""Every core query against its SQL, and the rest for rows."""

import pytest

from tests.oracle import connect, same
from weftline.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, data, con, name):
    ok, ours, theirs = same(QUERIES[name](spark, data), con, SQL[name])
    assert ok, (ours, theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    rows = df.collect()
    assert rows and all(v is not None for v in rows[0])


def test_more_clusters_fit_better(spark, data):
    got = sorted((r.k, r.heterogeneity) for r in QUERIES["clu_k_sweep"](spark, data).collect())
    assert [k for k, _ in got] == [2, 5, 10] and got[0][1] > got[1][1] > got[2][1]


def test_restarted_means_take_all_rows(spark, data):
    rows = QUERIES["clu_kmeans"](spark, data).collect()
    n = spark.read.parquet(f"{data}/embeddings.parquet").count()
    one = QUERIES["clu_lloyd"](spark, data).first()
    assert sum(r.n for r in rows) == n and rows[0].heterogeneity < one.heterogeneity


def test_parts_of_bisected_clusters_are_all_rows(spark, data):
    rows = QUERIES["clu_bisecting"](spark, data).collect()
    assert len(rows) == 4 and sum(r.n for r in rows) == spark.read.parquet(f"{data}/embeddings.parquet").count()


def test_mixture_weights_sum_to_one(spark, data):
    assert abs(sum(r.weight for r in QUERIES["clu_mixture"](spark, data).collect()) - 1) < 1e-3


def test_learners_beat_the_majority(spark, data):
    assert all(r.accuracy > 0.5 for r in QUERIES["cls_library_trees"](spark, data).collect())
    assert QUERIES["cls_images"](spark, data).first().accuracy > 0.4


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
