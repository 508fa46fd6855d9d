"""Hot groups, ties and small cases of operators that were cut to be spread."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.ml import neighbours as NN
from weftline.ml import recommend as RC
from weftline.ml import trees as TR
from weftline.operators import aggregate as A
from weftline.operators import ranking as K
from weftline.operators import relational as R


def test_item_similarity_does_not_depend_on_blocks(spark):
    rng = np.random.default_rng(1)
    rows = [(1, i) for i in range(40)] + [(int(u), int(i)) for u, i in zip(rng.integers(2, 20, 200), rng.integers(0, 40, 200), strict=True)]
    pairs = spark.createDataFrame(rows, "user long, item long")
    few, many = ({tuple(r) for r in RC.item_similarity(pairs, "user", "item", block=b).collect()} for b in (1000, 3))
    assert few == many and len(few) == 40 * 39 // 2


def test_popular_items_for_a_user_who_has_nearly_all(spark):
    pairs = spark.createDataFrame([(1, i) for i in range(30)] + [(2, 29), (2, 31), (3, 31)], "user long, item long")
    got = {(r.user, r["rank"]): r.item for r in RC.recommend_popular(pairs, "user", "item", 2).collect()}
    assert got == {(1, 1): 31, (2, 1): 0, (2, 2): 1, (3, 1): 29, (3, 2): 0}


def test_quartiles_from_ranks(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 50, 3000).astype(float)
    df = spark.createDataFrame([("a" if i % 3 else None, float(v)) for i, v in enumerate(x)] + [("b", None), ("c", 5.0), ("a", None)], "g string, v double")
    got = {r.g: r for r in A.five_numbers(df, "v", ["g"]).collect()}
    for g, mine in (("a", x[np.arange(3000) % 3 > 0]), (None, x[::3])):
        assert np.allclose([got[g].q1, got[g].median, got[g].q3, got[g].minimum, got[g].maximum, got[g].mean], [*np.percentile(mine, [25, 50, 75]), mine.min(), mine.max(), mine.mean()])
    assert got["b"].median is None and got["b"].minimum is None and got["c"].q1 == 5.0
    assert A.five_numbers(df.where("v > 100"), "v").count() in (0, 1)


def test_positions_and_zip(spark):
    a = spark.range(100).select((F.col("id") * 7 % 101).alias("a"))
    b = spark.range(50).select(F.col("id").alias("b"))
    assert sorted(r.position for r in K.numbered(a, ["a"]).collect()) == list(range(100))
    got = sorted((r.b, r.a) for r in K.zip_frames(a, b, ["a"], ["b"]).collect())
    assert [y for _, y in got] == sorted(r.a for r in a.collect())[:50] and [x for x, _ in got] == list(range(50))
    assert K.zip_frames(a.limit(0), b, ["a"], ["b"]).count() == 0
    with pytest.raises(ValueError):
        K.zip_frames(a, a, ["a"], ["a"])


def test_unknown_outcome_and_wide_domain(spark):
    with pytest.raises(ValueError):
        K.outcome_column("x", {"y": "z"})
    with pytest.raises(ValueError):
        R.one_hot(spark.range(20), ["id"], limit=10)


def test_brute_force_ties_text_labels_and_bounds(spark):
    rows = spark.createDataFrame([(c, [float(i % 2), 1.0]) for i, c in enumerate("hgfedcba")], "k string, v array<double>")
    got = [(r.query_label, r.reference_label) for r in NN.brute_force(rows, rows.where("k = 'a'"), "k", "v", 3, block=3).orderBy("rank").collect()]
    assert got == [("a", "a"), ("a", "c"), ("a", "e")]
    assert NN.brute_force(rows, rows.where("k = 'z'"), "k", "v", 3).count() == 0
    with pytest.raises(ValueError):
        NN.brute_force(rows, rows, "k", "v", 3, max_bytes=8)


def test_boosting_without_jobs_is_the_same(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2, (300, 3))
    y = np.where((x[:, 0] + x[:, 1] * 2 + rng.normal(size=300)) > 1.2, 1, -1)
    df = spark.createDataFrame([(*map(int, a), int(b)) for a, b in zip(x, y, strict=True)], "a int, b int, c int, y int")
    rows = TR.grouped_rows(df, ["a", "b", "c"], "y")
    few, many = (TR.boost(rows, ["a", "b", "c"], 4, few_rows=n) for n in (1000, 0))
    assert [s for _, s in few] == [s for _, s in many] and np.allclose([v for v, _ in few], [v for v, _ in many])
    errors = [r.error for r in TR.staged_errors(df, few, "y").orderBy("stage").collect()]
    assert len(errors) == 4 and errors[0] == pytest.approx(TR.error_rate(df, few[0][1], "y").first().error)


def test_recommendations_do_not_depend_on_tiles(spark, monkeypatch):
    rng = np.random.default_rng(5)
    had = {(int(u), f"i{i:02d}") for u, i in zip(rng.integers(0, 60, 500), rng.integers(0, 40, 500), strict=True)} | {(7, f"i{i:02d}") for i in range(35)} | {(8, "only"), (9, None), (3, None)}
    pairs = spark.createDataFrame(sorted(had, key=str), "user long, item string")
    users = {i: {u for u, x in had if x == i} for _, i in had if i}
    sim = {(a, b): len(users[a] & users[b]) / len(users[a] | users[b]) for a in users for b in users if a != b and users[a] & users[b]}
    want = {}
    for u in {u for u, _ in had}:
        own, n = {i for w, i in had if w == u and i}, sum(w == u for w, _ in had)
        scores = {o: round(sum(sim.get((i, o), 0) for i in sorted(own)) / n, 12) for o in users if o not in own and any((i, o) in sim for i in own)}
        want |= {(u, r + 1): o for r, o in enumerate(sorted(scores, key=lambda o: (-scores[o], o))[:4])}
    for tile, entries in ((1024, 2_000_000), (7, 20)):
        monkeypatch.setattr(RC, "TILE", tile, raising=False)
        monkeypatch.setattr(RC, "ENTRIES", entries, raising=False)
        similarity = RC.item_similarity(pairs, "user", "item", block=tile)
        assert {(r.item_a, r.item_b): r.similarity for r in similarity.collect()} == {k: v for k, v in sim.items() if k[0] < k[1]}
        assert {(r.user, r["rank"]): r.item for r in RC.recommend_similar(pairs, similarity, "user", "item", 4).collect()} == want


def _shuffled(spark, run):
    """Records that the stages of run() write for shuffles."""
    context = spark.sparkContext
    store, jvm = context._jsc.sc().statusStore(), context._gateway

    def total():
        context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, jvm.new_array(jvm.jvm.double, 0), None)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = total()
    run()
    return sum(n for k, n in total().items() if k not in before)


def test_sums_of_users_and_items_are_not_shuffled(spark):
    rng = np.random.default_rng(6)
    pairs = spark.createDataFrame([(u, i) for u in range(1500) for i in rng.choice(120, 4, replace=False).tolist()], "user long, item long")
    similarity = RC.item_similarity(pairs, "user", "item").collect()
    kept = spark.createDataFrame(similarity)
    sums = 1500 * 100
    n = _shuffled(spark, lambda: RC.recommend_similar(pairs, kept, "user", "item", 3).collect())
    assert n < 0.6 * sums, n
