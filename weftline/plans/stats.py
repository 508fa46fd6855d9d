"""Aggregates, profiles, per-group ranks and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import aggregate as A
from weftline.operators import ranking as K
from weftline.operators import relational as R
from weftline.plans._query import Book
from weftline.streaming import events as E

BOOK = Book()


@BOOK.add(
    "agg_pricing_summary",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_net,
 round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""",
)
def _(t):
    rows = t("lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum("l_extendedprice"), 2).alias("sum_base"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_net"),
        F.round(F.avg("l_quantity"), 6).alias("avg_qty"),
        F.round(F.avg("l_discount"), 6).alias("avg_discount"),
        F.count(F.lit(1)).alias("n"),
    )


@BOOK.add("agg_sum_by_group", "SELECT l_partkey, round(sum(l_quantity), 4) AS total_count FROM lineitem GROUP BY 1")
def _(t):
    return t("lineitem").groupBy("l_partkey").agg(F.round(F.sum("l_quantity"), 4).alias("total_count"))


@BOOK.add("agg_count_and_users", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def _(t):
    """Rows and distinct users, both."""
    return t("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@BOOK.add("agg_best_group", "SELECT n, mean FROM (SELECT c_mktsegment AS n, round(avg(c_acctbal), 6) AS mean FROM customer GROUP BY 1) ORDER BY mean DESC, n LIMIT 1")
def _(t):
    means = t("customer").groupBy(F.col("c_mktsegment").alias("n")).agg(F.round(F.avg("c_acctbal"), 6).alias("mean"))
    return means.orderBy(F.desc("mean"), "n").limit(1)


@BOOK.add("agg_scalars", "SELECT max(o_totalprice) AS largest, min(o_totalprice) AS smallest, round(avg(o_totalprice), 4) AS mean, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders")
def _(t):
    c = "o_totalprice"
    return t("orders").agg(F.max(c).alias("largest"), F.min(c).alias("smallest"), F.round(F.avg(c), 4).alias("mean"), F.round(F.sum(c), 2).alias("total"), F.count(F.lit(1)).alias("n"))


@BOOK.add("agg_conditional", "SELECT count_if(safe_loans = 1)::BIGINT AS safe, count_if(safe_loans = -1)::BIGINT AS risky, round(avg(CASE WHEN safe_loans = 1 THEN 1.0 ELSE 0.0 END), 8) AS share FROM lending_club_data WHERE safe_loans IS NOT NULL")
def _(t):
    rows = t("lending_club_data").where("safe_loans is not null")
    return rows.agg(F.count_if(F.col("safe_loans") == 1).alias("safe"), F.count_if(F.col("safe_loans") == -1).alias("risky"), F.round(F.avg(F.when(F.col("safe_loans") == 1, 1.0).otherwise(0.0)), 8).alias("share"))


@BOOK.add("agg_pooled_mean", "SELECT round(sum(ozone) / count(ozone), 8) AS mean FROM hw1_data WHERE station IN ('st00_0001', 'st00_0002', 'st00_0003')")
def _(t):
    out = A.pooled_mean(t("hw1_data"), "ozone", "station", ["st00_0001", "st00_0002", "st00_0003"])
    return out.select(F.round("mean", 8).alias("mean"))


@BOOK.add(
    "agg_complete_counts",
    "SELECT id AS station, count_if(ozone IS NOT NULL AND solar_r IS NOT NULL AND wind IS NOT NULL)::BIGINT AS nobs FROM (VALUES ('st00_0003'), ('st00_0001'), ('nowhere')) v(id) LEFT JOIN hw1_data ON station = id GROUP BY 1",
)
def _(t):
    """Requested stations without a complete row come out with 0."""
    df = t("hw1_data")
    ids = df.sparkSession.createDataFrame([("st00_0003",), ("st00_0001",), ("nowhere",)], "station string")
    return A.complete_counts(df, "station", ["ozone", "solar_r", "wind"], ids)


@BOOK.add("agg_corr_threshold", "SELECT station, round(corr(ozone, temp), 6) AS corr, count(*) AS nobs FROM hw1_data WHERE ozone IS NOT NULL AND temp IS NOT NULL GROUP BY 1 HAVING count(*) > 20")
def _(t):
    return A.correlation_by_entity(t("hw1_data"), "station", "ozone", "temp", 20).select("station", F.round("corr", 6).alias("corr"), "nobs")


@BOOK.add("agg_column_means", "SELECT round(avg(ozone), 8) AS ozone, round(avg(wind), 8) AS wind, round(avg(temp), 8) AS temp FROM hw1_data")
def _(t):
    return A.column_means(t("hw1_data"), ["ozone", "wind", "temp"]).select(*(F.round(c, 8).alias(c) for c in ("ozone", "wind", "temp")))


@BOOK.add("agg_column_means_strict", "SELECT CASE WHEN count(ozone) = count(*) THEN round(avg(ozone), 8) END AS ozone, CASE WHEN count(obs_id) = count(*) THEN round(avg(obs_id), 4) END AS obs_id FROM hw1_data")
def _(t):
    out = A.column_means(t("hw1_data"), ["ozone", "obs_id"], remove_na=False)
    return out.select(F.round("ozone", 8).alias("ozone"), F.round("obs_id", 4).alias("obs_id"))


@BOOK.add(
    "agg_missing_and_conditional",
    "SELECT count_if(ozone IS NULL)::BIGINT AS missing, round(avg(ozone), 8) AS mean, round(avg(CASE WHEN ozone > 31 AND temp > 90 THEN solar_r END), 6) AS solar, max(CASE WHEN \"month\" = 5 THEN ozone END) AS may FROM hw1_data",
)
def _(t):
    hot = (F.col("ozone") > 31) & (F.col("temp") > 90)
    return t("hw1_data").agg(
        F.count_if(F.col("ozone").isNull()).alias("missing"), F.round(F.avg("ozone"), 8).alias("mean"), F.round(F.avg(F.when(hot, F.col("solar_r"))), 6).alias("solar"), F.max(F.when(F.col("month") == 5, F.col("ozone"))).alias("may")
    )


@BOOK.add("agg_frequency", "SELECT rating, count(*) AS n FROM amazon_baby GROUP BY 1")
def _(t):
    return A.frequency(t("amazon_baby"), "rating")


@BOOK.add("agg_bin_counts", "SELECT b AS bin, count(x) AS n FROM (SELECT unnest(range(0, (SELECT max(p_size) * 3 + 1 FROM part)))::BIGINT AS b) LEFT JOIN (SELECT p_size * 3 AS x FROM part) ON x = b GROUP BY 1")
def _(t):
    """Zeros for the integers that do not occur."""
    return A.bin_counts(t("part").select((F.col("p_size") * 3).alias("x")), "x")


@BOOK.add("agg_most_common", "SELECT event_type, count(*) AS n, min(event_id) AS first_seen FROM events GROUP BY 1 ORDER BY n DESC, first_seen LIMIT 3")
def _(t):
    return R.first_seen_rank(t("events"), "event_type", "event_id", 3)


@BOOK.add("agg_spread", "SELECT round(var_samp(l_quantity), 6) AS variance, round(covar_samp(l_quantity, l_extendedprice), 4) AS covariance, round(stddev_pop(l_discount), 8) AS sd FROM lineitem")
def _(t):
    return t("lineitem").agg(F.round(F.var_samp("l_quantity"), 6).alias("variance"), F.round(F.covar_samp("l_quantity", "l_extendedprice"), 4).alias("covariance"), F.round(F.stddev_pop("l_discount"), 8).alias("sd"))


@BOOK.add("agg_five_numbers", "SELECT min(o_totalprice) AS minimum, round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.75), 4) AS q3, round(avg(o_totalprice), 4) AS mean, max(o_totalprice) AS maximum FROM orders")
def _(t):
    out = A.five_numbers(t("orders"), "o_totalprice")
    return out.select("minimum", *(F.round(c, 4).alias(c) for c in ("q1", "median", "q3", "mean")), "maximum")


@BOOK.add(
    "agg_box_by_group",
    "SELECT p_brand, min(p_retailprice) AS minimum, round(quantile_cont(p_retailprice, 0.25), 4) AS q1, round(quantile_cont(p_retailprice, 0.5), 4) AS median, round(quantile_cont(p_retailprice, 0.75), 4) AS q3, round(avg(p_retailprice), 4) AS mean, max(p_retailprice) AS maximum FROM part GROUP BY 1",
)
def _(t):
    out = A.five_numbers(t("part"), "p_retailprice", ["p_brand"])
    return out.select("p_brand", "minimum", *(F.round(c, 4).alias(c) for c in ("q1", "median", "q3", "mean")), "maximum")


@BOOK.add("agg_sketch")
def _(t):
    """Approximate profile; tested against exact counts."""
    return A.sketch(t("lineitem"), ["l_quantity", "l_partkey", "l_extendedprice"])


@BOOK.add(
    "agg_histogram",
    """WITH b AS (SELECT least(floor((p_retailprice - 900) / 24), 49)::BIGINT AS bin FROM part WHERE p_retailprice BETWEEN 900 AND 2100), c AS (SELECT bin, count(*) AS n FROM b GROUP BY 1)
SELECT g.bin, coalesce(n, 0) AS n, round(coalesce(n, 0) / ((SELECT count(*) FROM b) * 24.0), 10) AS density FROM (SELECT unnest(range(0, 50))::BIGINT AS bin) g LEFT JOIN c USING (bin)""",
)
def _(t):
    return A.histogram(t("part"), "p_retailprice", 50, 900.0, 2100.0).select("bin", "n", F.round("density", 10).alias("density"))


@BOOK.add("agg_argmax", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def _(t):
    return A.arg_extreme(t("orders"), "o_totalprice", "o_orderkey")


@BOOK.add("agg_arg_in_array", "SELECT id, list_position(image_array, list_min(image_array)) - 1 AS at FROM image_train WHERE image_array IS NOT NULL AND len(image_array) > 0")
def _(t):
    """Position of the first least value."""
    rows = t("image_train").where("image_array is not null and size(image_array) > 0")
    return rows.select("id", (F.array_position("image_array", F.array_min("image_array")).cast("int") - 1).alias("at"))


@BOOK.add("agg_weighted_by_class", "SELECT o_orderstatus, round(sum(CASE WHEN o_totalprice > 100000 THEN o_totalprice ELSE 0 END), 2) AS weight_high, round(sum(CASE WHEN o_totalprice > 100000 THEN 0 ELSE o_totalprice END), 2) AS weight_low FROM orders GROUP BY 1")
def _(t):
    high = F.col("o_totalprice") > 100000
    return t("orders").groupBy("o_orderstatus").agg(F.round(F.sum(F.when(high, F.col("o_totalprice")).otherwise(0)), 2).alias("weight_high"), F.round(F.sum(F.when(high, 0).otherwise(F.col("o_totalprice"))), 2).alias("weight_low"))


@BOOK.add("agg_intersection_size", "SELECT count(*) / 10.0 AS share FROM (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10) a JOIN (SELECT o_custkey FROM orders GROUP BY 1 ORDER BY count(*) DESC, o_custkey LIMIT 10) b ON c_custkey = o_custkey")
def _(t):
    a = t("customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(10).select("c_custkey")
    b = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "c_custkey").limit(10).select("c_custkey")
    return a.join(b, "c_custkey").agg((F.count(F.lit(1)) / 10.0).alias("share"))


@BOOK.add("agg_sum_products", "SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(sum(l_quantity * l_extendedprice), 0) AS xy, count(*) AS n FROM lineitem")
def _(t):
    return t("lineitem").agg(
        F.round(F.regr_slope("l_extendedprice", "l_quantity"), 6).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 4).alias("intercept"), F.round(F.sum(F.col("l_quantity") * F.col("l_extendedprice")), 0).alias("xy"), F.count(F.lit(1)).alias("n")
    )


@BOOK.add("agg_nonzero", "SELECT count_if(l_discount <> 0)::BIGINT AS discount, count_if(l_tax <> 0)::BIGINT AS tax FROM lineitem")
def _(t):
    return t("lineitem").agg(F.count_if(F.col("l_discount") != 0).alias("discount"), F.count_if(F.col("l_tax") != 0).alias("tax"))


@BOOK.add("agg_rss", "SELECT round(sum(power(l_extendedprice - 1500 * l_quantity, 2)), 0) AS rss, round(sqrt(avg(power(l_extendedprice - 1500 * l_quantity, 2))), 4) AS rmse FROM lineitem")
def _(t):
    e = F.pow(F.col("l_extendedprice") - 1500 * F.col("l_quantity"), 2)
    return t("lineitem").agg(F.round(F.sum(e), 0).alias("rss"), F.round(F.sqrt(F.avg(e)), 4).alias("rmse"))


# --- ranks and windows


_RANK_SQL = "SELECT n.s_nationkey, {pick} AS s_name FROM (SELECT DISTINCT s_nationkey FROM supplier) n LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_name) AS rn, count(*) OVER (PARTITION BY s_nationkey) AS c FROM supplier WHERE s_acctbal > 0) r ON n.s_nationkey = r.s_nationkey AND {which}"


def _ranked(t, which):
    rows = t("supplier").withColumn("s_acctbal", F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")))
    return K.nth_per_group(rows, "s_nationkey", "s_acctbal", "s_name", which)


@BOOK.add("rank_best", _RANK_SQL.format(pick="r.s_name", which="rn = 1"))
def _(t):
    return _ranked(t, "best")


@BOOK.add("rank_third", _RANK_SQL.format(pick="r.s_name", which="rn = 3"))
def _(t):
    """Groups with fewer rows come out with null."""
    return _ranked(t, 3)


@BOOK.add("rank_worst", _RANK_SQL.format(pick="r.s_name", which="rn = c"))
def _(t):
    return _ranked(t, "worst")


@BOOK.add("rank_by_outcome", "SELECT station, obs_id FROM (SELECT station, obs_id, row_number() OVER (PARTITION BY station ORDER BY wind, obs_id) AS r FROM (SELECT DISTINCT station, obs_id, wind FROM hw1_data WHERE station IS NOT NULL AND wind IS NOT NULL)) WHERE r = 1")
def _(t):
    """The best record of each station for an outcome given by name."""
    column = K.outcome_column("least wind", {"least wind": "wind", "least heat": "temp"})
    return K.nth_per_group(t("hw1_data").where(F.col("station").isNotNull() & F.col(column).isNotNull()), "station", column, "obs_id", "best")


@BOOK.add(
    "win_moving_average",
    "SELECT station, obs_id, round(m, 8) AS moving_average FROM (SELECT station, obs_id, avg(wind) OVER (PARTITION BY station ORDER BY obs_id ROWS 4 PRECEDING) AS m, row_number() OVER (PARTITION BY station ORDER BY obs_id) AS i FROM (SELECT DISTINCT ON (obs_id) * FROM hw1_data WHERE station IS NOT NULL)) WHERE i >= 5",
)
def _(t):
    rows = t("hw1_data").where("station is not null").select("obs_id", "station", "wind").dropDuplicates(["obs_id"])
    return K.moving_average(rows, "obs_id", "wind", 5, ["station"]).select("station", "obs_id", F.round("moving_average", 8).alias("moving_average"))


@BOOK.add("win_rank_of_item", "SELECT rank FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey)::BIGINT AS rank FROM supplier) WHERE s_suppkey = 11")
def _(t):
    """Rank of one row, by counting those before it: no numbering of all rows; nothing if the row is not there."""
    one = t("supplier").where("s_suppkey = 11").select(F.col("s_acctbal").alias("x"))
    before = (F.col("s_acctbal") < F.col("x")) | ((F.col("s_acctbal") == F.col("x")) & (F.col("s_suppkey") <= 11))
    return t("supplier").crossJoin(F.broadcast(one)).groupBy("x").agg(F.count_if(before).alias("rank")).select("rank")


@BOOK.add(
    "win_cumulative_cutoff",
    """WITH s AS (SELECT c_mktsegment AS topic, c_nationkey AS word, count(*) / sum(count(*)) OVER (PARTITION BY c_mktsegment) AS score FROM customer GROUP BY 1, 2)
SELECT topic, word FROM (SELECT *, coalesce(sum(score) OVER (PARTITION BY topic ORDER BY score DESC, word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM s) WHERE b < 0.303""",
)
def _(t):
    counts = t("customer").groupBy(F.col("c_mktsegment").alias("topic"), F.col("c_nationkey").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("topic").agg(F.sum("n").alias("total"))
    scored = counts.join(total, "topic").select("topic", "word", (F.col("n") / F.col("total")).alias("score"))
    return K.cumulative_cutoff(scored, "topic", "word", "score", 0.303).select("topic", "word")


@BOOK.add("win_changed", "SELECT count_if(l_quantity % 3 <> l_quantity % 2)::BIGINT AS changed FROM (SELECT DISTINCT l_partkey, l_quantity FROM lineitem)")
def _(t):
    rows = t("lineitem").select("l_partkey", "l_quantity").distinct().withColumn("k", F.struct("l_partkey", "l_quantity"))
    return K.changed(rows.select("k", (F.col("l_quantity") % 3).alias("v")), rows.select("k", (F.col("l_quantity") % 2).alias("v")), "k", "v")


@BOOK.add("win_folds", "SELECT fold, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM (SELECT o_orderkey, floor((row_number() OVER (ORDER BY o_orderkey) * 10 - 1) / (SELECT count(*) FROM orders))::INT AS fold FROM orders) GROUP BY 1")
def _(t):
    folds = K.contiguous_folds(t("orders").select("o_orderkey"), "o_orderkey", 10)
    return folds.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


# --- extensions


@BOOK.add("ext_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def _(t):
    return t("orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@BOOK.add("ext_windowed_counts", "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(t):
    out = E.windowed_counts(t("events"), "ts", "event_type", "value", "1 hour")
    return out.select("window_start", "event_type", "n", F.round("total", 4).alias("total"))


QUERIES, ORACLES = BOOK.queries, BOOK.statements
