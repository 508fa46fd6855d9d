"""Sampling, linear algebra, learning, retrieval and evaluation."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from weftline.ml import classification as C
from weftline.ml import clustering as KM
from weftline.ml import library as L
from weftline.ml import mixture as GM
from weftline.ml import neighbours as NN
from weftline.ml import recommend as RC
from weftline.ml import regression as LR
from weftline.ml import trees as TR
from weftline.functions import text as X
from weftline.operators import linalg as LA
from weftline.operators import ranking as K
from weftline.operators import relational as R
from weftline.operators import sampling as S
from weftline.plans import statements as Q
from weftline.plans._query import Book
from weftline.runtime import shared_dir

BOOK = Book()

_DRAW = "((({k} + {s}) % 1000003) * 2654435761 % 1000003000) % 1000000"


# --- sampling and simulation


@BOOK.add("smp_split", f"SELECT part, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM (SELECT o_orderkey, CASE WHEN {_DRAW.format(k='o_orderkey', s=0)} < 800000 THEN CASE WHEN {_DRAW.format(k='o_orderkey', s=9)} < 500000 THEN 'a' ELSE 'b' END ELSE 'test' END AS part FROM orders) GROUP BY 1")
def _(t):
    """Three parts by nested splits."""
    rest, test = S.split(t("orders").select("o_orderkey"), "o_orderkey", 0.8)
    a, b = S.split(rest, "o_orderkey", 0.5, salt=9)
    parts = [p.select("o_orderkey", F.lit(n).alias("part")) for p, n in ((a, "a"), (b, "b"), (test, "test"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@BOOK.add(
    "smp_balanced",
    f"WITH r AS (SELECT loan_id, safe_loans FROM lending_club_data WHERE safe_loans IS NOT NULL), n AS (SELECT safe_loans, count(*) AS c FROM r GROUP BY 1) SELECT r.safe_loans, count(*) AS n FROM r JOIN n USING (safe_loans) WHERE {_DRAW.format(k='loan_id', s=1)} < floor(1000000 * (SELECT min(c) FROM n) / n.c) GROUP BY 1",
)
def _(t):
    rows = t("lending_club_data").where("safe_loans is not null").select("loan_id", "safe_loans")
    return S.balanced(rows, "loan_id", "safe_loans").groupBy("safe_loans").agg(F.count(F.lit(1)).alias("n"))


@BOOK.add("smp_rows", f"SELECT p_partkey FROM part ORDER BY {_DRAW.format(k='p_partkey', s=4)}, p_partkey LIMIT 50")
def _(t):
    return S.sample_rows(t("part").select("p_partkey"), "p_partkey", 50, 4)


@BOOK.add("smp_weighted", f"SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice > 0 ORDER BY round(-ln(({_DRAW.format(k='p_partkey', s=4)} + 1) / 1000001.0::DOUBLE) / p_retailprice, 15), p_partkey LIMIT 40")
def _(t):
    return S.weighted_choice(t("part").select("p_partkey", "p_retailprice"), "p_partkey", "p_retailprice", 40, 4)


@BOOK.add("smp_with_replacement", f"SELECT c_custkey FROM (SELECT c_custkey, unnest(range(len(list_filter({S.POISSON_STEPS}::DOUBLE[], lambda e: u >= e)))) FROM (SELECT c_custkey, {_DRAW.format(k='c_custkey', s=2)} / 1000000.0::DOUBLE AS u FROM customer))")
def _(t):
    return S.resample(t("customer").select("c_custkey"), "c_custkey", 2)


@BOOK.add("sim_linear", "SELECT 2.0::DOUBLE AS slope, 0.5::DOUBLE AS intercept")
def _(t):
    """Coefficients recovered from a simulated line."""
    rows = S.linear_simulation(t("region").sparkSession, 100_000)
    return rows.agg(F.round(F.regr_slope("y", "x"), 1).alias("slope"), F.round(F.regr_intercept("y", "x"), 1).alias("intercept"))


@BOOK.add("sim_poisson", "SELECT 'intercept' AS name, 0.5::DOUBLE AS value UNION ALL SELECT 'x', 0.3")
def _(t):
    rows = S.poisson_simulation(t("region").sparkSession, 20_000)
    m = L.fit_poisson(rows, ["x"], "y")
    return rows.sparkSession.createDataFrame([("intercept", round(float(m.intercept), 1)), ("x", round(float(m.coefficients[0]), 1))], "name string, value double")


@BOOK.add("sim_draws", "SELECT 3.0::DOUBLE AS binomial, 1.0::DOUBLE AS first, -2.0::DOUBLE AS second, 0.6::DOUBLE AS together, 0.2::DOUBLE AS share, 1.0::DOUBLE AS whole")
def _(t):
    """Means of many draws: binomial, multivariate normal with its covariance, Dirichlet."""
    spark = t("region").sparkSession
    b = S.binomial_draws(spark, 200_000, 10, 0.3).agg(F.round(F.avg("y"), 1).alias("binomial"))
    x = F.col("x")
    m = S.normal_vectors(spark, 200_000, [1.0, -2.0], [[1.0, 0.6], [0.6, 2.0]]).agg(F.round(F.avg(x[0]), 1).alias("first"), F.round(F.avg(x[1]), 1).alias("second"), F.round(F.covar_samp(x[0], x[1]), 1).alias("together"))
    d = S.dirichlet_draws(spark, 100_000, [1, 4]).agg(F.round(F.avg(x[0]), 1).alias("share"), F.round(F.max(x[0] + x[1]), 6).alias("whole"))
    return b.crossJoin(m).crossJoin(d)


# --- linear algebra


@BOOK.add("lin_sparse_product", "SELECT l_orderkey AS row, round(sum(l_quantity * p_size), 4) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def _(t):
    entries = t("lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("col"), F.col("l_quantity").alias("value"))
    vector = t("part").select(F.col("p_partkey").alias("col"), F.col("p_size").alias("value"))
    return LA.sparse_times_vector(entries, vector).select("row", F.round("value", 4).alias("value"))


@BOOK.add("lin_sparse_mean", "SELECT e.key AS col, round(sum(e.value) / (SELECT count(*) FROM people_wiki WHERE tfidf IS NOT NULL), 8) AS value FROM (SELECT unnest(map_entries(tfidf)) AS e FROM people_wiki) GROUP BY 1")
def _(t):
    rows = t("people_wiki").where("tfidf is not null").select(F.col("id").alias("row"), "tfidf")
    entries = R.stack_map(rows, "tfidf", "col", "value")
    return LA.sparse_mean(entries, rows.select("row")).select("col", F.round("value", 8).alias("value"))


@BOOK.add(
    "lin_inverse",
    "WITH m AS (SELECT sum(temp::DOUBLE * temp) AS a, sum(temp * wind) AS b, sum(wind * wind) AS d FROM hw1_data WHERE temp IS NOT NULL AND wind IS NOT NULL), e AS (SELECT a * d - b * b AS det, a, b, d FROM m) SELECT round(det / 1e6, 3) AS determinant, round(d / det * 1e6, 4) AS i00, round(-b / det * 1e6, 4) AS i01, round(a / det * 1e6, 4) AS i11, round(b * d / 1e6, 3) AS outer_01 FROM e",
)
def _(t):
    """Determinant, cached inverse and outer product of a small matrix of sums."""
    df = t("hw1_data").where("temp is not null and wind is not null")
    a, b, d = df.agg(F.sum(F.col("temp").cast("double") * F.col("temp")), F.sum(F.col("temp") * F.col("wind")), F.sum(F.col("wind") * F.col("wind"))).first()
    x = LA.CachedMatrix([[a, b], [b, d]])
    inverse = x.solve()
    row = (round(LA.determinant(x.get()) / 1e6, 3), *(round(float(v) * 1e6, 4) for v in (inverse[0, 0], inverse[0, 1], inverse[1, 1])), round(float(LA.outer([a, b], [b, d])[1, 1]) / 1e6, 3))
    return df.sparkSession.createDataFrame([row], "determinant double, i00 double, i01 double, i11 double, outer_01 double")


@BOOK.add("lin_sparse_row", "SELECT e.key AS col, e.value AS value FROM (SELECT unnest(map_entries(tfidf)) AS e FROM (SELECT tfidf FROM people_wiki WHERE id = (SELECT min(id) FROM people_wiki WHERE tfidf IS NOT NULL AND cardinality(tfidf) > 0) LIMIT 1))")
def _(t):
    """One row of a sparse matrix."""
    rows = t("people_wiki").where("tfidf is not null and cardinality(tfidf) > 0").select(F.col("id").alias("row"), "tfidf").dropDuplicates(["row"])
    first = rows.agg(F.min("row")).first()[0]
    return LA.sparse_row(R.stack_map(rows, "tfidf", "col", "value"), first)


# --- regression


@BOOK.add("reg_simple", "SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem")
def _(t):
    df = t("lineitem")
    b, a = LR.simple_fit(df, "l_quantity", "l_extendedprice")
    return df.sparkSession.createDataFrame([(b, a)], "slope double, intercept double").select(F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"))


@BOOK.add(
    "reg_predict_rss",
    "WITH f AS (SELECT regr_slope(ozone, temp) AS b, regr_intercept(ozone, temp) AS a FROM hw1_data) SELECT round(sum(power(ozone - a - b * temp, 2)), 2) AS rss, round((SELECT (100 - a) / b FROM f), 5) AS temp_for_100 FROM hw1_data, f WHERE ozone IS NOT NULL AND temp IS NOT NULL",
)
def _(t):
    df = t("hw1_data")
    b, a = LR.simple_fit(df, "temp", "ozone")
    e = F.pow(F.col("ozone") - LR.predict(["temp"], np.array([a, b])), 2)
    return df.agg(F.round(F.sum(e), 2).alias("rss")).select("rss", F.round(LR.inverse_predict(F.lit(100.0), b, a), 5).alias("temp_for_100"))


def _air(t, n: int = 3):
    return LR.Moments.of(t("hw1_data").where("ozone between 1 and 400"), ["temp", "wind", "solar_r"][:n], "ozone")


def _one(t, m: LR.Moments, w):
    df = LR.coefficients(t("region"), m.features, w)
    return df.select("name", F.round("value", 4).alias("value"))


_ONE_FEATURE = "WITH f AS (SELECT regr_slope(ozone, temp) AS b, regr_intercept(ozone, temp) AS a FROM hw1_data WHERE ozone BETWEEN 1 AND 400 AND temp IS NOT NULL) SELECT '(intercept)' AS name, round(a, 4) AS value FROM f UNION ALL SELECT 'temp', round(b, 4) FROM f"


_AIR = ["temp", "wind", "solar_r"]
_AIR_ROWS = "FROM hw1_data WHERE ozone BETWEEN 1 AND 400 AND temp IS NOT NULL AND wind IS NOT NULL AND solar_r IS NOT NULL"
_AIR_SQL = f"m AS (SELECT {Q.moment_sums(_AIR, 'ozone')} {_AIR_ROWS})"


@BOOK.add("reg_multiple", f"WITH {_AIR_SQL}, {Q.solved('w', 'm', 4)} {Q.listed(_AIR, 'w', 4)}")
def _(t):
    m = _air(t)
    return _one(t, m, m.least_squares())


@BOOK.add("reg_normal_equations", _ONE_FEATURE)
def _(t):
    m = _air(t, 1)
    return _one(t, m, m.least_squares())


@BOOK.add(
    "reg_gradient_descent",
    "WITH f AS (SELECT regr_slope(ozone, (temp - 78) / 10.0) AS b, regr_intercept(ozone, (temp - 78) / 10.0) AS a FROM hw1_data WHERE ozone BETWEEN 1 AND 400 AND temp IS NOT NULL) SELECT '(intercept)' AS name, round(a, 4) AS value FROM f UNION ALL SELECT 'x', round(b, 4) FROM f",
)
def _(t):
    """Descent from zero, on moments, ends at the least-squares line."""
    rows = t("hw1_data").where("ozone between 1 and 400").select("ozone", ((F.col("temp") - 78) / 10.0).alias("x"))
    m = LR.Moments.of(rows, ["x"], "ozone")
    return _one(t, m, m.gradient_descent(np.zeros(2), 0.4 / np.linalg.eigvalsh(m.xx)[-1], 1e-7 * m.n))


@BOOK.add("reg_ridge", f"WITH {_AIR_SQL}, {Q.solved('w', 'm', 4, l2='1000.0')} {Q.listed(_AIR, 'w', 4)}")
def _(t):
    m = _air(t)
    return _one(t, m, m.least_squares(l2=1000.0))


@BOOK.add("reg_ridge_descent", f"WITH RECURSIVE {_AIR_SQL}, {Q.ridge_descent(4, '0.45 / (m.x0_0 + m.x1_1 + m.x2_2 + m.x3_3)', 100.0, 2000)} {Q.listed(_AIR, '(SELECT * FROM w WHERE t = 2000)', 4)}")
def _(t):
    """2000 steps; the trace of X'X bounds its largest eigenvalue, so the step cannot diverge."""
    m = _air(t)
    return _one(t, m, m.ridge_descent(np.zeros(4), 0.45 / np.trace(m.xx), 100.0, 2000))


@BOOK.add("reg_lasso", f"WITH RECURSIVE {_AIR_SQL}, penalty AS (SELECT 500.0::DOUBLE AS l1), {Q.lasso('w', 'm', 'penalty', 4, 1e-9)} {Q.listed(_AIR, 'w', 4)}")
def _(t):
    m = _air(t)
    return _one(t, m, m.lasso(np.zeros(4), 500.0, 1e-9))


_SPLIT = f"CASE WHEN {_DRAW.format(k='obs_id', s=0)} < {{cut}} THEN 'train' ELSE 'valid' END"
_NONZERO = " + ".join(f"(abs(w{i}) > 1e-9)::INT" for i in range(4))


@BOOK.add(
    "reg_lasso_search",
    f"""WITH RECURSIVE parts AS (SELECT {_SPLIT.format(cut=800000)} AS part, * {_AIR_ROWS}), a AS (SELECT {Q.moment_sums(_AIR, 'ozone')} FROM parts WHERE part = 'train'), b AS (SELECT {Q.moment_sums(_AIR, 'ozone')} FROM parts WHERE part = 'valid'),
wide AS (SELECT pow(10, i / 4.0::DOUBLE)::DOUBLE AS l1 FROM range(25) r(i)), {Q.lasso('f', 'a', 'wide', 4, 1e-6)}, sized AS (SELECT l1, {_NONZERO} AS k FROM f),
span AS (SELECT coalesce(max(l1) FILTER (k > 2), min(l1)) AS low, coalesce(min(l1) FILTER (k < 2), max(l1)) AS high FROM sized),
fine AS (SELECT low + (high - low) / 19.0 * i AS l1 FROM span, range(20) r(i)), {Q.lasso('g', 'a', 'fine', 4, 1e-6)},
best AS (SELECT g.* FROM g, b WHERE {_NONZERO} = 2 ORDER BY {Q.rss('b', 'g', 4)}, l1 LIMIT 1) {Q.listed(_AIR, 'best', 4, more=', round(l1, 2) AS penalty')}""",
)
def _(t):
    """Penalty at which just two weights are non-zero, by validation error."""
    train, valid = S.split(t("hw1_data").where("ozone between 1 and 400"), "obs_id", 0.8)
    cols = ["temp", "wind", "solar_r"]
    a, b = (LR.Moments.of(p, cols, "ozone") for p in (train, valid))
    penalty, w = LR.sparsity_search(a, b, 2, np.logspace(0, 6, 25))
    return _one(t, a, w).withColumn("penalty", F.lit(round(penalty, 2)))


_TOTALS = ", ".join(f"sum(f.{c}) - any_value(h.{c}) AS {c}" for c in Q.names(3))


@BOOK.add(
    "reg_cross_validation",
    f"""WITH r AS (SELECT * FROM hw1_data WHERE ozone BETWEEN 1 AND 400 AND obs_id IS NOT NULL AND temp IS NOT NULL AND wind IS NOT NULL), n AS (SELECT *, floor((row_number() OVER (ORDER BY obs_id) * 5 - 1) / (SELECT count(*) FROM r))::INT AS fold FROM r),
f AS (SELECT fold, {Q.moment_sums(['temp', 'wind'], 'ozone')} FROM n GROUP BY fold), rest AS (SELECT h.fold AS held, {_TOTALS} FROM f h, f GROUP BY h.fold),
grid AS (SELECT * FROM rest, (SELECT unnest([0.0, 10.0, 1000.0, 100000.0]::DOUBLE[]) AS l2)), {Q.solved('w', 'grid', 3, ('held', 'l2'), 'l2')},
scored AS (SELECT l2, avg({Q.rss('h', 'w', 3)}) AS rss FROM w JOIN f h ON h.fold = w.held GROUP BY l2) SELECT l2, round(rss, 2) AS rss, l2 = (SELECT l2 FROM scored ORDER BY rss, l2 LIMIT 1) AS best FROM scored""",
)
def _(t):
    """Mean held-out RSS for each ridge penalty, from one pass of moments by fold."""
    rows = t("hw1_data").where("ozone between 1 and 400").select("obs_id", "ozone", "temp", "wind").na.drop()
    folds = K.contiguous_folds(rows, "obs_id", 5)
    scores = LR.cross_validate(LR.Moments.by_fold(folds, "fold", ["temp", "wind"], "ozone"), [0.0, 10.0, 1000.0, 100000.0])
    best = LR.best_of(scores)
    return rows.sparkSession.createDataFrame([(a, round(b, 2), a == best) for a, b in scores], "l2 double, rss double, best boolean")


_POWERS = [f"power_{i}" for i in range(1, 7)]


@BOOK.add(
    "reg_polynomial_choice",
    f"""WITH parts AS (SELECT {_SPLIT.format(cut=700000)} AS part, ozone, {', '.join(f'pow(temp / 100.0::DOUBLE, {i}) AS power_{i}' for i in range(1, 7))} FROM hw1_data WHERE ozone BETWEEN 1 AND 400 AND temp IS NOT NULL),
a AS (SELECT {Q.moment_sums(_POWERS, 'ozone')} FROM parts WHERE part = 'train'), b AS (SELECT {Q.moment_sums(_POWERS, 'ozone')} FROM parts WHERE part = 'valid'),
{', '.join(Q.solved(f'w{d}', 'a', d + 1) for d in range(1, 7))} SELECT degree::INT AS degree FROM ({' UNION ALL '.join(f"SELECT {d} AS degree, {Q.rss('b', f'w{d}', d + 1)} AS rss FROM w{d}, b" for d in range(1, 7))}) ORDER BY rss LIMIT 1""",
)
def _(t):
    """Degree of least validation error among 1..6."""
    scaled = t("hw1_data").where("ozone between 1 and 400 and temp is not null").select("obs_id", "ozone", (F.col("temp") / 100).alias("x"))
    rows = R.polynomial(scaled, "x", 6)
    train, valid = S.split(rows, "obs_id", 0.7)
    cols = [f"power_{i}" for i in range(1, 7)]
    a, b = (LR.Moments.of(p, cols, "ozone") for p in (train, valid))
    return rows.sparkSession.createDataFrame([(LR.choose_degree(a, b, 6),)], "degree int")


# --- neighbours


_NN_SQL = """WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0), r AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings),
d AS (SELECT q.vec_id AS query_label, r.vec_id AS reference_label, r.label, round(list_distance(q.e, r.e), 9) AS distance FROM q, r),
k AS (SELECT *, row_number() OVER (PARTITION BY query_label ORDER BY distance, reference_label)::INT AS rank FROM d)"""


def _vectors(t):
    return t("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"), "label")


@BOOK.add("nn_brute_force", f"{_NN_SQL} SELECT query_label, reference_label, round(distance, 5) AS distance, rank FROM k WHERE rank <= 10")
def _(t):
    rows = _vectors(t)
    return NN.brute_force(rows, rows.where("vec_id % 100 = 0"), "vec_id", "e", 10).select("query_label", "reference_label", F.round("distance", 5).alias("distance"), "rank")


@BOOK.add(
    "nn_cosine",
    "WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0), d AS (SELECT q.vec_id AS query_label, r.vec_id AS reference_label, round(1 - list_cosine_similarity(q.e, r.embedding::DOUBLE[]), 9) AS distance FROM q, embeddings r) SELECT query_label, reference_label, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_label ORDER BY distance, reference_label)::INT AS rank FROM d) WHERE rank <= 5",
)
def _(t):
    rows = _vectors(t)
    return NN.brute_force(rows, rows.where("vec_id % 100 = 0"), "vec_id", "e", 5, metric="cosine").select("query_label", "reference_label", "rank")


@BOOK.add("nn_regression", f"{_NN_SQL} SELECT query_label, round(avg(label), 8) AS prediction FROM k WHERE rank <= 10 GROUP BY 1")
def _(t):
    rows = _vectors(t)
    return NN.knn_regression(rows, rows.where("vec_id % 100 = 0"), "vec_id", "e", "label", 10).select("query_label", F.round("prediction", 8).alias("prediction"))


@BOOK.add(
    "nn_class_consistency",
    """WITH v AS (SELECT DISTINCT ON (id) id, label, deep_features AS e FROM image_train WHERE label IS NOT NULL AND deep_features IS NOT NULL AND len(deep_features) = 96 AND len(list_filter(deep_features, lambda x: isnan(x))) = 0),
d AS (SELECT q.id, q.label, r.label = q.label AS own, min(round(list_distance(q.e, r.e), 9)) AS d FROM v q JOIN v r ON q.id <> r.id WHERE q.id % 100 = 0 GROUP BY ALL)
SELECT label, count_if(coalesce(o < x, false))::BIGINT AS correct, count(*) AS n FROM (SELECT id, label, min(d) FILTER (own) AS o, min(d) FILTER (NOT own) AS x FROM d GROUP BY ALL) GROUP BY 1""",
)
def _(t):
    """Queries whose nearest picture of their own class is strictly nearer than any other."""
    rows = KM.usable(t("image_train").where("label is not null and size(deep_features) = 96"), "deep_features").select("id", "label", "deep_features").dropDuplicates(["id"])
    queries = rows.where("id % 100 = 0")
    parts = [NN.brute_force(rows.where(F.col("label") == c), queries, "id", "deep_features", 2).withColumn("c", F.lit(c)) for c in ("cat", "dog", "automobile", "bird")]
    near = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).where("query_label <> reference_label")
    best = near.groupBy("query_label", "c").agg(F.min("distance").alias("d")).join(queries.select(F.col("id").alias("query_label"), "label"), "query_label")
    per = best.groupBy("query_label", "label").agg(F.min(F.when(F.col("c") == F.col("label"), F.col("d"))).alias("o"), F.min(F.when(F.col("c") != F.col("label"), F.col("d"))).alias("x"))
    return per.groupBy("label").agg(F.count_if(F.coalesce(F.col("o") < F.col("x"), F.lit(False))).alias("correct"), F.count(F.lit(1)).alias("n"))


_PLANES = NN.planes(64, 6, 143)
_BIN_SQL = " + ".join(f"(CASE WHEN list_dot_product(embedding::DOUBLE[], {[round(float(v), 12) for v in p]}::DOUBLE[]) >= 0 THEN {1 << (5 - i)} ELSE 0 END)" for i, p in enumerate(_PLANES))


@BOOK.add("lsh_bins", f"SELECT bin, count(*) AS n FROM (SELECT ({_BIN_SQL})::BIGINT AS bin FROM embeddings) GROUP BY 1")
def _(t):
    return _vectors(t).select(NN.hyperplane_bin("e", np.round(_PLANES, 12)).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@BOOK.add(
    "lsh_search",
    f"""WITH b AS (SELECT vec_id, embedding::DOUBLE[] AS e, ({_BIN_SQL})::BIGINT AS bin FROM embeddings), m AS (SELECT q.vec_id AS query_label, r.vec_id AS reference_label, round(1 - list_cosine_similarity(q.e, r.e), 9) AS distance FROM b q JOIN b r ON bit_count(xor(q.bin, r.bin)) <= 2 WHERE q.vec_id % 100 = 0)
SELECT query_label, reference_label, rank, candidates FROM (SELECT *, row_number() OVER (PARTITION BY query_label ORDER BY distance, reference_label)::INT AS rank, count(*) OVER (PARTITION BY query_label) AS candidates FROM m) WHERE rank <= 10""",
)
def _(t):
    rows = _vectors(t)
    return NN.hashed_search(rows, rows.where("vec_id % 100 = 0"), "vec_id", "e", np.round(_PLANES, 12), 2, 10).select("query_label", "reference_label", "rank", "candidates")


@BOOK.add(
    "lsh_quality",
    f"""WITH b AS (SELECT vec_id, embedding::DOUBLE[] AS e, ({_BIN_SQL})::BIGINT AS bin FROM embeddings), d AS (SELECT q.vec_id AS query_label, r.vec_id AS reference_label, round(1 - list_cosine_similarity(q.e, r.e), 9) AS distance, bit_count(xor(q.bin, r.bin)) <= 3 AS met FROM b q, b r WHERE q.vec_id % 100 = 0),
truth AS (SELECT query_label, reference_label FROM (SELECT *, row_number() OVER (PARTITION BY query_label ORDER BY distance, reference_label) AS k FROM d) WHERE k <= 25), found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_label ORDER BY distance, reference_label) AS k FROM d WHERE met) WHERE k <= 11 AND query_label <> reference_label)
SELECT f.query_label, round(count(t.reference_label) / 10, 6) AS precision, round(avg(distance), 6) AS mean_distance, round(min(distance), 6) AS min_distance, round(max(distance), 6) AS max_distance FROM found f LEFT JOIN truth t USING (query_label, reference_label) GROUP BY 1""",
)
def _(t):
    """Precision of the hashed search against the true 25 nearest."""
    rows = _vectors(t)
    queries = rows.where("vec_id % 100 = 0")
    found = NN.hashed_search(rows, queries, "vec_id", "e", np.round(_PLANES, 12), 3, 11)
    truth = NN.brute_force(rows, queries, "vec_id", "e", 25, metric="cosine")
    return NN.search_quality(found, truth, 10).select("query_label", *(F.round(c, 6).alias(c) for c in ("precision", "mean_distance", "min_distance", "max_distance")))


# --- clustering


@BOOK.add(
    "clu_assign",
    "WITH c AS (SELECT vec_id AS k, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id < 4), d AS (SELECT v.vec_id, k, round(power(list_distance(v.embedding::DOUBLE[], c.e), 2), 9) AS d FROM embeddings v, c) SELECT vec_id, k::INT AS cluster FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, k) AS r FROM d) WHERE r = 1",
)
def _(t):
    """Nearest of four given centroids."""
    rows = _vectors(t)
    seeds = np.array([r.e for r in rows.where("vec_id < 4").orderBy("vec_id").collect()])
    return KM.assign(rows, "e", seeds).select("vec_id", "cluster")


@BOOK.add("clu_kmeans")
def _(t):
    """Heterogeneity and sizes of the best of three k-means++ starts."""
    rows = _vectors(t)
    best = KM.restarts(rows, "e", 6, [1, 2, 3], 30)
    sizes = KM.assign(rows, "e", best.centroids).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return sizes.withColumn("heterogeneity", F.lit(round(best.heterogeneity, 3)))


@BOOK.add("clu_bisecting")
def _(t):
    return KM.bisect_clusters(_vectors(t), "vec_id", "e", 4).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@BOOK.add(
    "clu_describe",
    "WITH p AS (SELECT DISTINCT ON (id) id, CASE WHEN name IS NULL OR trim(name) = '' THEN '?' ELSE upper(substr(trim(name), 1, 1)) END AS cluster, tfidf FROM people_wiki WHERE tfidf IS NOT NULL), n AS (SELECT cluster, count(*) AS size FROM p GROUP BY 1), w AS (SELECT cluster, e.key AS term, round(sum(e.value) / any_value(size), 9) AS weight FROM (SELECT cluster, unnest(map_entries(tfidf)) AS e FROM p) JOIN n USING (cluster) GROUP BY 1, 2) SELECT cluster, term, round(weight, 6) AS weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY weight DESC, term)::INT AS rank FROM w) WHERE rank <= 5",
)
def _(t):
    """Heaviest terms of the people by their first letter."""
    name = F.trim("name")
    first = F.when(name.isNull() | (name == ""), "?").otherwise(F.upper(F.substring(name, 1, 1)))
    rows = t("people_wiki").where("tfidf is not null").dropDuplicates(["id"]).select(first.alias("cluster"), "tfidf")
    return KM.describe(rows, "cluster", "weight", "tfidf", 5).select("cluster", "term", F.round("weight", 6).alias("weight"), "rank")


def _lloyd_sql(steps: int) -> str:
    out = ["c0 AS (SELECT vec_id AS k, embedding::DOUBLE[] AS c FROM embeddings WHERE vec_id < 4)", "v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)"]
    for i in range(steps):
        out.append(f"d{i} AS (SELECT vec_id, e, k, pow(list_distance(e, c), 2) AS d FROM v, c{i})")
        out.append(f"a{i} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, k) AS r FROM d{i}) WHERE r = 1)")
        out.append(f"c{i + 1} AS (SELECT k, list(x ORDER BY j) AS c FROM (SELECT k, j, avg(e[j]) AS x FROM a{i}, (SELECT unnest(range(1, 65)) AS j) GROUP BY k, j) GROUP BY k)")
    return f"WITH {', '.join(out)} SELECT k::INT AS cluster, count(*) AS n, round((SELECT sum(d) FROM a{steps - 1}), 3) AS heterogeneity FROM a{steps - 1} GROUP BY k"


@BOOK.add("clu_lloyd", _lloyd_sql(4))
def _(t):
    """Sizes and heterogeneity after three steps from four given centroids."""
    rows = _vectors(t)
    seeds = np.array([r.e for r in rows.where("vec_id < 4").orderBy("vec_id").collect()])
    model = KM.lloyd(rows, "e", seeds, 3)
    part = KM.assign(rows, "e", model.centroids)
    whole = part.agg(F.round(F.sum("squared_distance"), 3).alias("heterogeneity"))
    return part.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(whole))


@BOOK.add("clu_k_sweep")
def _(t):
    """Heterogeneity and largest cluster for growing numbers of clusters; must fall as they grow."""
    rows = _vectors(t)
    out = []
    for k in (2, 5, 10):
        best = KM.restarts(rows, "e", k, [1, 2], 20)
        sizes = KM.assign(rows, "e", best.centroids).groupBy("cluster").count().agg(F.max("count")).first()[0]
        out.append((k, round(best.heterogeneity, 3), sizes))
    return rows.sparkSession.createDataFrame(out, "k int, heterogeneity double, largest long")


_COLOURS = [[0.2, 0.3, 0.4], [0.6, 0.5, 0.4], [0.8, 0.8, 0.7]]
_EM_SQL = f"""p AS (SELECT DISTINCT ON (id) id, [red, green, blue]::DOUBLE[] AS x FROM images WHERE red IS NOT NULL AND green IS NOT NULL AND blue IS NOT NULL AND NOT isnan(red) AND NOT isnan(green) AND NOT isnan(blue)),
c AS (SELECT unnest(range(3))::INT AS component, unnest({_COLOURS}::DOUBLE[][]) AS mu), z AS (SELECT id, x, component, ln(1 / 3.0::DOUBLE) - 0.5 * (pow(list_distance(x, mu), 2) / 0.05 + 3 * ln(0.05::DOUBLE) + 3 * ln(2 * pi())) AS z FROM p, c),
r AS (SELECT *, exp(z - top) / sum(exp(z - top)) OVER (PARTITION BY id) AS r, top + ln(sum(exp(z - top)) OVER (PARTITION BY id)) AS l FROM (SELECT *, max(z) OVER (PARTITION BY id) AS top FROM z))"""


def _colours(t):
    return t("images").dropDuplicates(["id"]).select("id", F.array("red", "green", "blue").alias("x")).where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)))


@BOOK.add("clu_em_step", f"WITH {_EM_SQL} SELECT component, round(sum(r) / (SELECT count(*) FROM p), 6) AS weight, round(sum(r * x[1]) / sum(r), 6) AS red, round(sum(r * x[2]) / sum(r), 6) AS green, round(sum(r * x[3]) / sum(r), 6) AS blue, round(sum(r * x[1] * x[2]) / sum(r) - sum(r * x[1]) * sum(r * x[2]) / pow(sum(r), 2), 6) AS red_green, round((SELECT sum(l) FROM r WHERE component = 0), 3) AS log_likelihood FROM r GROUP BY component")
def _(t):
    """One step of expectation maximisation from a given mixture, and the likelihood of that mixture."""
    rows, mu = _colours(t), np.array(_COLOURS)
    m = GM.fit(rows, "x", mu, np.stack([np.eye(3) * 0.05] * 3), max_iterations=1)
    like = GM.log_likelihood(rows, "x", GM.Mixture(np.full(3, 1 / 3), mu, np.stack([np.eye(3) * 0.05] * 3), []))
    out = [(i, *(round(float(v), 6) for v in (m.weights[i], *m.means[i], m.covariances[i][0, 1])), round(like, 3)) for i in range(3)]
    return rows.sparkSession.createDataFrame(out, "component int, weight double, red double, green double, blue double, red_green double, log_likelihood double")


@BOOK.add("clu_posterior", f"WITH {_EM_SQL} SELECT component, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY round(r, 9) DESC, id)::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY r DESC, component) AS best FROM r) WHERE best = 1) WHERE rank <= 5")
def _(t):
    """The surest members of each component of a given mixture."""
    rows = _colours(t)
    m = GM.Mixture(np.full(3, 1 / 3), np.array(_COLOURS), np.stack([np.eye(3) * 0.05] * 3), [])
    return GM.top_members(GM.responsibilities(rows, "id", "x", m), "id", 5).select("component", "id", "rank")


@BOOK.add("clu_mixture")
def _(t):
    """Weights and means of a Gaussian mixture of picture colours."""
    rows = t("images").select(F.array("red", "green", "blue").alias("x")).where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)))
    seeds = KM.spread_seeds(rows, "x", 4, 1)
    m = GM.fit(rows, "x", seeds, np.stack([np.eye(3) * 0.05] * len(seeds)), max_iterations=30)
    out = [(i, round(float(w), 4), [round(float(v), 4) for v in mu]) for i, (w, mu) in enumerate(zip(m.weights, m.means, strict=True))]
    return rows.sparkSession.createDataFrame(out, "component int, weight double, mean array<double>")


@BOOK.add(
    "clu_representatives",
    "WITH c AS (SELECT vec_id AS k, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id < 4), d AS (SELECT v.vec_id, k, round(power(list_distance(v.embedding::DOUBLE[], c.e), 2), 9) AS d FROM embeddings v, c), a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, k) AS r FROM d) WHERE r = 1) SELECT k::INT AS cluster, vec_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d, vec_id)::INT AS rank FROM a) WHERE rank <= 3",
)
def _(t):
    """The rows nearest to each of four given centroids."""
    rows = _vectors(t)
    seeds = np.array([r.e for r in rows.where("vec_id < 4").orderBy("vec_id").collect()])
    return KM.representatives(rows, "vec_id", "e", seeds, 3).select("cluster", "vec_id", "rank")


@BOOK.add("clu_mixture_members")
def _(t):
    """The surest members of each component of a mixture of picture colours."""
    rows = t("images").dropDuplicates(["id"]).select("id", F.array("red", "green", "blue").alias("x")).where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)))
    seeds = KM.spread_seeds(rows, "x", 3, 1)
    m = GM.fit(rows, "x", seeds, np.stack([np.eye(3) * 0.05] * len(seeds)), max_iterations=10)
    return GM.top_members(GM.responsibilities(rows, "id", "x", m), "id", 5)


@BOOK.add("clu_topic_cutoff")
def _(t):
    """Words that make up a fifth of each topic."""
    words = t("documents").where("text is not null").select("doc_id", X.word_tokens("text").alias("words"))
    return L.Topics(words, "words", 3).topics(cutoff=0.2)


@BOOK.add("clu_topic_draws", "SELECT count(*) AS documents, 1.0::DOUBLE AS least, 1.0::DOUBLE AS most FROM (SELECT DISTINCT doc_id FROM documents WHERE text IS NOT NULL)")
def _(t):
    """Topic probabilities of all documents, averaged over draws of their words, sum to one."""
    words = t("documents").where("text is not null").select("doc_id", X.word_tokens("text").alias("words")).dropDuplicates(["doc_id"])
    per = L.Topics(words, "words", 2, tolerance=1e-3).average_predictions(words, "doc_id", 3).groupBy("doc_id").agg(F.sum("probability").alias("p"))
    return per.agg(F.count(F.lit(1)).alias("documents"), F.round(F.min("p"), 6).alias("least"), F.round(F.max("p"), 6).alias("most"))


@BOOK.add("clu_topics")
def _(t):
    words = t("documents").where("text is not null").select("doc_id", X.word_tokens("text").alias("words"))
    return L.Topics(words, "words", 4).top_words(5)


# --- classification


_LOANS = ["short_emp", "grade_low", "own_home", "long_term"]


def _loans(t):
    rows = t("lending_club_data").where("safe_loans is not null and grade is not null and term is not null and home_ownership is not null and short_emp is not null")
    flag = lambda c: F.when(c, 1).otherwise(0)
    grade, own, term = F.upper(F.trim("grade")), F.upper(F.trim("home_ownership")), F.trim("term")
    return rows.select("loan_id", "safe_loans", "short_emp", flag(grade.isin("D", "E", "F", "G")).alias("grade_low"), flag(own == "OWN").alias("own_home"), flag(term.startswith("60")).alias("long_term"))


_LOANS_SQL = "WITH r AS (SELECT safe_loans AS y, short_emp, (upper(trim(grade)) IN ('D', 'E', 'F', 'G'))::INT AS grade_low, (upper(trim(home_ownership)) = 'OWN')::INT AS own_home, (trim(term) LIKE '60%')::INT AS long_term FROM lending_club_data WHERE safe_loans IS NOT NULL AND grade IS NOT NULL AND term IS NOT NULL AND home_ownership IS NOT NULL AND short_emp IS NOT NULL)"


_NODES = 'SELECT node::INT AS node, depth::INT AS depth, feature, "left"::INT AS "left", "right"::INT AS "right", prediction::INT AS prediction FROM t'


@BOOK.add("cls_stump", f"{_LOANS_SQL}, {Q.tree('t', 'r', _LOANS, 1)} {_NODES}")
def _(t):
    """The best single split; see cls_feature_mistakes for the mistakes of all."""
    rows = TR.grouped_rows(_loans(t), _LOANS, "safe_loans")
    return TR.node_table(t("region"), TR.build(rows, _LOANS, max_depth=1))


@BOOK.add("cls_feature_mistakes", _LOANS_SQL + ", c AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, least(count_if({f} = 0 AND y = 1), count_if({f} = 0 AND y = -1))::BIGINT + least(count_if({f} = 1 AND y = 1), count_if({f} = 1 AND y = -1))::BIGINT AS mistakes FROM r" for f in _LOANS) + ") SELECT * FROM c")
def _(t):
    """Mistakes of each single split, one pass."""
    n = lambda f, v, y: F.count_if((F.col(f) == v) & (F.col("safe_loans") == y))
    side = lambda f, v: F.least(n(f, v, 1), n(f, v, -1))
    rows = _loans(t).agg(F.array(*(F.struct(F.lit(f).alias("feature"), (side(f, 0) + side(f, 1)).alias("mistakes")) for f in _LOANS)).alias("a"))
    return rows.select(F.inline("a"))


@BOOK.add("cls_tree", f"{_LOANS_SQL}, {Q.tree('t', 'r', _LOANS, 4)} {_NODES}")
def _(t):
    tree = TR.build(TR.grouped_rows(_loans(t), _LOANS, "safe_loans"), _LOANS, max_depth=4)
    return TR.node_table(t("region"), tree)


@BOOK.add(
    "cls_tree_error",
    f"{_LOANS_SQL}, {Q.tree('a', 'r', _LOANS, 1)}, {Q.tree('b', 'r', _LOANS, 4)}, {Q.tree('c', 'r', _LOANS, 4, 100, 0.0)} "
    + " UNION ALL ".join(f"SELECT '{n}' AS tree, round(sum(m) / (SELECT count(*) FROM r), 8) AS error, count(m)::INT AS leaves FROM {t}" for n, t in (("depth 1", "a"), ("depth 4", "b"), ("early", "c"))),
)
def _(t):
    """Error of trees of growing depth, and of one stopped early."""
    loans = _loans(t)
    rows = TR.grouped_rows(loans, _LOANS, "safe_loans")
    out = None
    for name, tree in (("depth 1", TR.build(rows, _LOANS, 1)), ("depth 4", TR.build(rows, _LOANS, 4)), ("early", TR.build(rows, _LOANS, 4, min_node_size=100, min_error_reduction=0.0))):
        e = TR.error_rate(loans, tree, "safe_loans").select(F.lit(name).alias("tree"), F.round("error", 8).alias("error"), F.lit(TR.count_leaves(tree)).alias("leaves"))
        out = e if out is None else out.unionByName(e)
    return out


@BOOK.add("cls_tree_size", f"{_LOANS_SQL}, {Q.tree('t', 'r', _LOANS, 4)} SELECT count(*)::INT AS nodes, count(m)::INT AS leaves, count(feature)::INT AS edge_pairs FROM t")
def _(t):
    """Nodes and leaves of a tree, and the pairs of edges in its drawing."""
    tree = TR.build(TR.grouped_rows(_loans(t), _LOANS, "safe_loans"), _LOANS, max_depth=4)
    return t("region").sparkSession.createDataFrame([(TR.count_nodes(tree), TR.count_leaves(tree), TR.to_dot(tree).count("->") // 2)], "nodes int, leaves int, edge_pairs int")


@BOOK.add("cls_saved_model", "SELECT 0::BIGINT AS differing")
def _(t):
    """A model saved and loaded gives the same classes."""
    loans = _loans(t)
    model = L.fit_classifier(loans, _LOANS, "safe_loans", "tree", maxDepth=3)
    path = f"{shared_dir(loans.sparkSession)}/weftline/model-{uuid.uuid4().hex}"
    model.save(path)
    a, b = (L.classify(m, loans).select("loan_id", F.col("predicted").alias(n)).distinct() for m, n in ((model, "a"), (PipelineModel.load(path), "b")))
    return a.join(b, "loan_id").agg(F.count_if(F.col("a") != F.col("b")).alias("differing"))


@BOOK.add("cls_boosted_stumps", f"{_LOANS_SQL}, {Q.boosting('b', 'r', _LOANS, 5)} SELECT round(error, 8) AS error, 5 AS stumps FROM b WHERE stage = 5")
def _(t):
    loans = _loans(t)
    stumps = TR.boost(TR.grouped_rows(loans, _LOANS, "safe_loans"), _LOANS, 5)
    return loans.agg(F.round(F.avg((TR.boosted_class(stumps) != F.col("safe_loans")).cast("double")), 8).alias("error"), F.lit(len(stumps)).alias("stumps"))


@BOOK.add("cls_boosting_stages", f"{_LOANS_SQL}, {Q.boosting('b', 'r', _LOANS, 12)} SELECT stage::INT AS stage, round(error, 8) AS error FROM b")
def _(t):
    """Error after each of the first stumps, one pass for all stages."""
    loans = _loans(t)
    stumps = TR.boost(TR.grouped_rows(loans, _LOANS, "safe_loans"), _LOANS, 12)
    return TR.staged_errors(loans, stumps, "safe_loans").select("stage", F.round("error", 8).alias("error"))


@BOOK.add("cls_library_trees")
def _(t):
    loans = _loans(t)
    out = None
    for kind, o in (("tree", {"maxDepth": 3}), ("boosted_trees", {"maxIter": 3})):
        p = L.classify(L.fit_classifier(loans, _LOANS, "safe_loans", kind, **o), loans)
        e = p.agg(F.avg((F.col("predicted").cast("int") == F.col("safe_loans")).cast("double")).alias("accuracy")).select(F.lit(kind).alias("learner"), "accuracy")
        out = e if out is None else out.unionByName(e)
    return out


@BOOK.add("cls_images")
def _(t):
    """Accuracy of a multinomial classifier on deep features, held out by key."""
    rows = KM.usable(t("image_train").where("label is not null and size(deep_features) = 96"), "deep_features").select("id", "label", *(F.col("deep_features")[i].alias(f"d{i}") for i in range(96)))
    train, test = S.split(rows, "id", 0.8)
    p = L.classify(L.fit_classifier(train, [f"d{i}" for i in range(96)], "label", "logistic", maxIter=15, regParam=0.01), test)
    return p.agg(F.avg((F.col("predicted") == F.col("label")).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


_SENTIMENT = ["great", "love", "worth", "easily", "broke", "expected", "returned", "cheap"]


def _sentiment(t):
    rows = t("amazon_baby").where("rating is not null and rating <> 3").select("review_id", F.when(F.col("rating") >= 4, 1).otherwise(-1).alias("sentiment"), X.word_tokens(F.coalesce("review", F.lit(""))).alias("w"))
    return rows.select("review_id", "sentiment", *(X.occurrences(F.col("w"), w).alias(w) for w in _SENTIMENT))


@BOOK.add("cls_word_features", "SELECT CASE WHEN rating >= 4 THEN 1 ELSE -1 END AS sentiment, " + ", ".join(f"sum(len(list_filter(w, lambda x: x = '{w}')))::BIGINT AS {w}" for w in _SENTIMENT) + r" FROM (SELECT rating, list_filter(string_split_regex(lower(coalesce(review, '')), '[^\p{L}\p{N}_]+'), lambda t: t <> '') AS w FROM amazon_baby WHERE rating IS NOT NULL AND rating <> 3) GROUP BY 1")
def _(t):
    return _sentiment(t).groupBy("sentiment").agg(*(F.sum(w).alias(w) for w in _SENTIMENT))


_SENTIMENT_SQL = "g AS (SELECT " + ", ".join(f"len(list_filter(w, lambda x: x = '{w}'))::DOUBLE AS {w}" for w in _SENTIMENT) + r", (rating >= 4)::INT::DOUBLE AS y, count(*)::DOUBLE AS c FROM (SELECT rating, list_filter(string_split_regex(lower(coalesce(review, '')), '[^\p{L}\p{N}_]+'), lambda t: t <> '') AS w FROM amazon_baby WHERE rating IS NOT NULL AND rating <> 3) GROUP BY ALL)"


def _weights_sql(source: str, more: str = "") -> str:
    return " UNION ALL ".join(f"SELECT {more}'{f}' AS name, round(w[{i + 1}], 6) AS value FROM {source}" for i, f in enumerate(["(intercept)", *_SENTIMENT]))


@BOOK.add("cls_logistic", f"WITH RECURSIVE {_SENTIMENT_SQL}, {Q.logistic('s', 'g', _SENTIMENT, 25, [0.0])} SELECT *, true AS improved FROM ({_weights_sql('(SELECT * FROM s WHERE t = 25)')})")
def _(t):
    rows = _sentiment(t)
    n = rows.count() or 1
    w, trace = C.logistic_ascent(rows, _SENTIMENT, "sentiment", 2.0 / n, 25)
    out = LR.coefficients(rows, _SENTIMENT, w)
    return out.select("name", F.round("value", 6).alias("value"), F.lit(trace[-1] > trace[0]).alias("improved"))


@BOOK.add("cls_logistic_l2", f"WITH RECURSIVE {_SENTIMENT_SQL}, {Q.logistic('s', 'g', _SENTIMENT, 15, [0.0, 4.0, 100.0])} {_weights_sql('(SELECT * FROM s WHERE t = 15)', 'l2, ')}")
def _(t):
    """Coefficients along growing penalties."""
    rows = _sentiment(t)
    n = rows.count() or 1
    out = None
    for l2 in (0.0, 4.0, 100.0):
        w, _ = C.logistic_ascent(rows, _SENTIMENT, "sentiment", 2.0 / n, 15, l2)
        c = LR.coefficients(rows, _SENTIMENT, w).select(F.lit(l2).alias("l2"), "name", F.round("value", 6).alias("value"))
        out = c if out is None else out.unionByName(c)
    return out


@BOOK.add("cls_logistic_minibatch")
def _(t):
    rows = _sentiment(t)
    w, trace = C.logistic_minibatch(rows, _SENTIMENT, "sentiment", 0.5, 100, 2)
    return LR.coefficients(rows, _SENTIMENT, w).withColumn("batches", F.lit(len(trace)))


_SCORED = "WITH r AS (SELECT safe_loans AS y, 1 - int_rate / 40 AS p, CASE WHEN int_rate < 13 THEN 1 ELSE -1 END AS yhat FROM lending_club_data WHERE safe_loans IS NOT NULL AND int_rate IS NOT NULL)"


def _scored(t):
    rows = t("lending_club_data").where("safe_loans is not null and int_rate is not null")
    return rows.select(F.col("safe_loans").alias("y"), (1 - F.col("int_rate") / 40).alias("p"), F.when(F.col("int_rate") < 13, 1).otherwise(-1).alias("yhat"))


@BOOK.add("eval_confusion", f"{_SCORED} SELECT y, yhat, count(*) AS n FROM r GROUP BY 1, 2")
def _(t):
    return C.confusion(_scored(t), "y", "yhat")


@BOOK.add(
    "eval_rates",
    f"{_SCORED} SELECT round(avg((y = yhat)::INT), 8) AS accuracy, round(count_if(y = 1 AND yhat = 1) / count_if(yhat = 1), 8) AS precision, round(count_if(y = 1 AND yhat = 1) / count_if(y = 1), 8) AS recall, round(greatest(count_if(y = 1), count_if(y <> 1)) / count(*), 8) AS majority FROM r",
)
def _(t):
    return C.rates(_scored(t), "y", "yhat").select(*(F.round(c, 8).alias(c) for c in ("accuracy", "precision", "recall", "majority")))


_GRID = [round(0.5 + 0.005 * i, 3) for i in range(100)]


@BOOK.add(
    "eval_threshold_sweep",
    f"{_SCORED} SELECT t AS threshold, count_if(p >= t AND y = 1)::BIGINT AS tp, count_if(p >= t AND y <> 1)::BIGINT AS fp, round(count_if(p >= t AND y = 1) / nullif(count_if(p >= t), 0), 8) AS precision, round(count_if(p >= t AND y = 1) / nullif(count_if(y = 1), 0), 8) AS recall FROM r, (SELECT unnest({_GRID}::DOUBLE[]) AS t) GROUP BY 1",
)
def _(t):
    out = C.threshold_sweep(_scored(t), "y", "p", _GRID)
    return out.select("threshold", "tp", "fp", F.round("precision", 8).alias("precision"), F.round("recall", 8).alias("recall"))


@BOOK.add("eval_least_threshold", f"{_SCORED} SELECT min(t) AS threshold FROM (SELECT t FROM r, (SELECT unnest({_GRID}::DOUBLE[]) AS t) GROUP BY 1 HAVING count_if(p >= t AND y = 1) / nullif(count_if(p >= t), 0) > 0.8)")
def _(t):
    """The smallest threshold of more than 80 % precision."""
    return C.threshold_sweep(_scored(t), "y", "p", _GRID).where("precision > 0.8").agg(F.min("threshold").alias("threshold"))


@BOOK.add("eval_roc", f"{_SCORED} SELECT t AS threshold, round(count_if(p >= t AND y = 1) / count_if(y = 1), 8) AS tpr, round(count_if(p >= t AND y <> 1) / count_if(y <> 1), 8) AS fpr FROM r, (SELECT i / 50.0::DOUBLE AS t FROM range(51) x(i)) GROUP BY 1")
def _(t):
    return C.roc_curve(_scored(t), "y", "p", 50).select("threshold", F.round("tpr", 8).alias("tpr"), F.round("fpr", 8).alias("fpr"))


@BOOK.add("eval_cost", f"{_SCORED} SELECT sum(CASE WHEN y > 0 AND yhat <= 0 THEN 10000.0 WHEN y <= 0 AND yhat > 0 THEN 20000.0 ELSE 0.0 END)::DOUBLE AS cost FROM r")
def _(t):
    return C.error_cost(_scored(t), "y", "yhat", 10000.0, 20000.0)


# --- recommendation


def _pairs(t):
    orders = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return t("lineitem").select("l_orderkey", "l_suppkey").join(orders, "l_orderkey").select(F.col("o_custkey").alias("user"), F.col("l_suppkey").alias("item")).distinct()


_PAIRS_SQL = 'WITH h AS (SELECT DISTINCT o_custkey AS "user", l_suppkey AS item FROM lineitem JOIN orders ON l_orderkey = o_orderkey), c AS (SELECT item, count(*) AS users FROM h GROUP BY 1)'


@BOOK.add("rec_popular", f"{_PAIRS_SQL} SELECT item, users FROM c ORDER BY users DESC, item LIMIT 10")
def _(t):
    return RC.popular(_pairs(t), "user", "item", 10)


@BOOK.add("rec_popular_new", f'{_PAIRS_SQL} SELECT "user", item, users, rank FROM (SELECT u."user", c.item, c.users, row_number() OVER (PARTITION BY u."user" ORDER BY users DESC, c.item)::INT AS rank FROM (SELECT DISTINCT "user" FROM h) u, c WHERE NOT EXISTS (SELECT 1 FROM h WHERE h."user" = u."user" AND h.item = c.item)) WHERE rank <= 3')
def _(t):
    """The most popular items that a user does not have."""
    return RC.recommend_popular(_pairs(t), "user", "item", 3)


_SIM_SQL = f'{_PAIRS_SQL}, s AS (SELECT a.item AS item_a, b.item AS item_b, count(*) AS shared FROM h a JOIN h b ON a."user" = b."user" AND a.item < b.item GROUP BY 1, 2), j AS (SELECT item_a, item_b, shared, shared / (x.users + y.users - shared) AS similarity FROM s JOIN c x ON x.item = item_a JOIN c y ON y.item = item_b)'


@BOOK.add("rec_item_similarity", f"{_SIM_SQL} SELECT item_a, item_b, shared, round(similarity, 8) AS similarity FROM j")
def _(t):
    return RC.item_similarity(_pairs(t), "user", "item").select("item_a", "item_b", "shared", F.round("similarity", 8).alias("similarity"))


@BOOK.add("rec_similar_items", f"{_SIM_SQL} SELECT item, other, rank FROM (SELECT item, other, row_number() OVER (PARTITION BY item ORDER BY round(similarity, 12) DESC, other)::INT AS rank FROM (SELECT item_a AS item, item_b AS other, similarity FROM j UNION ALL SELECT item_b, item_a, similarity FROM j)) WHERE rank <= 3")
def _(t):
    return RC.similar_items(RC.item_similarity(_pairs(t), "user", "item"), 3).select("item", "other", "rank")


def _personal_sql(had: str, sim: str, k: int) -> str:
    """The k new items of greatest mean similarity, for each user of ``had``."""
    both = f"(SELECT item_a AS item, item_b AS other, similarity FROM {sim} UNION ALL SELECT item_b, item_a, similarity FROM {sim})"
    offers = f'SELECT o."user", o.other AS item, round(o.s / n.n, 12) AS score FROM (SELECT {had}."user", b.other, sum(b.similarity) AS s FROM {had} JOIN {both} b ON b.item = {had}.item GROUP BY 1, 2) o JOIN (SELECT "user", count(*) AS n FROM {had} GROUP BY 1) n USING ("user") WHERE NOT EXISTS (SELECT 1 FROM {had} x WHERE x."user" = o."user" AND x.item = o.other)'
    return f'SELECT "user", item, rank FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY score DESC, item)::INT AS rank FROM ({offers})) WHERE rank <= {k}'


@BOOK.add("rec_personal", f"{_SIM_SQL} {_personal_sql('h', 'j', 3)}")
def _(t):
    pairs = _pairs(t)
    return RC.recommend_similar(pairs, RC.item_similarity(pairs, "user", "item"), "user", "item", 3).select("user", "item", "rank")


_COMPARE_SQL = f"""WITH p AS (SELECT DISTINCT o_custkey AS "user", l_suppkey AS item FROM lineitem JOIN orders ON l_orderkey = o_orderkey), k AS (SELECT *, {_DRAW.format(k='("user" * 1000003 + item)', s=0)} < 800000 AS train FROM p),
h AS (SELECT "user", item FROM k WHERE train), held AS (SELECT "user", item FROM k WHERE NOT train AND {_DRAW.format(k='"user"', s=0)} < 150000), c AS (SELECT item, count(*) AS users FROM h GROUP BY 1),
s AS (SELECT a.item AS item_a, b.item AS item_b, count(*) AS shared FROM h a JOIN h b ON a."user" = b."user" AND a.item < b.item GROUP BY 1, 2), j AS (SELECT item_a, item_b, shared / (x.users + y.users - shared) AS similarity FROM s JOIN c x ON x.item = item_a JOIN c y ON y.item = item_b),
popular AS (SELECT "user", item, rank FROM (SELECT u."user", c.item, row_number() OVER (PARTITION BY u."user" ORDER BY users DESC, c.item) AS rank FROM (SELECT DISTINCT "user" FROM h) u, c WHERE NOT EXISTS (SELECT 1 FROM h WHERE h."user" = u."user" AND h.item = c.item)) WHERE rank <= 5),
personal AS ({_personal_sql('h', 'j', 5)}), found AS (SELECT 'popularity' AS model, * FROM popular UNION ALL SELECT 'item similarity', * FROM personal),
hit AS (SELECT f.model, f.rank, count(*) AS n, count(held.item) AS h FROM found f LEFT JOIN held ON held."user" = f."user" AND held.item = f.item WHERE f."user" IN (SELECT "user" FROM held) GROUP BY 1, 2)
SELECT a.model, a.rank::INT AS k, round(sum(b.h) / sum(b.n), 8) AS precision, round(sum(b.h) / (SELECT count(*) FROM held), 8) AS recall FROM (SELECT DISTINCT model, rank FROM hit) a JOIN hit b ON a.model = b.model AND b.rank <= a.rank GROUP BY 1, 2"""


@BOOK.add("rec_compare", _COMPARE_SQL)
def _(t):
    """Precision and recall of both recommenders on held-out pairs."""
    pairs = _pairs(t).withColumn("k", F.col("user") * 1_000_003 + F.col("item"))
    train, test = S.split(pairs, "k", 0.8)
    users, _ = S.split(test.select("user").distinct(), "user", 0.15)
    held = test.join(users, "user", "left_semi")
    train = train.select("user", "item")
    a = RC.precision_recall_at(RC.recommend_popular(train, "user", "item", 5), held, "user", "item").withColumn("model", F.lit("popularity"))
    b = RC.precision_recall_at(RC.recommend_similar(train, RC.item_similarity(train, "user", "item"), "user", "item", 5), held, "user", "item").withColumn("model", F.lit("item similarity"))
    return a.unionByName(b).select("model", "k", F.round("precision", 8).alias("precision"), F.round("recall", 8).alias("recall"))


QUERIES, ORACLES = BOOK.queries, BOOK.statements
