"""Scans, projections, filters, joins and set operations."""

from __future__ import annotations

import io
import uuid

import numpy as np
from pyspark.sql import functions as F

from weftline.operators import relational as R
from weftline.operators.ranking import numbered, top_per_group, zip_frames
from weftline.plans._query import Book
from weftline.runtime import shared_dir
from weftline.sources import files, images

BOOK = Book()


def _path(spark, label: str) -> str:
    return f"{shared_dir(spark)}/weftline/{label}-{uuid.uuid4().hex}"


# --- sources and sinks


@BOOK.add("src_csv_inferred", "SELECT s_suppkey::INT AS s_suppkey, s_name, s_nationkey::INT AS s_nationkey, s_acctbal FROM supplier")
def _(t):
    """CSV written and read back with inferred types."""
    df = t("supplier")
    path = _path(df.sparkSession, "csv")
    files.write_csv(df, path)
    return files.read_csv(df.sparkSession, path)


@BOOK.add("src_csv_schema", "SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_acctbal > 0")
def _(t):
    df = t("supplier").select("s_suppkey", "s_name", "s_acctbal")
    path = _path(df.sparkSession, "csv")
    files.write_csv(df, path, sep=",")
    return files.read_csv(df.sparkSession, path, schema=df.schema, splittable=True).where("s_acctbal > 0")


@BOOK.add("src_csv_as_text", "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation")
def _(t):
    df = t("nation")
    path = _path(df.sparkSession, "csv")
    files.write_csv(df, path)
    return files.read_csv(df.sparkSession, path, as_text=True)


@BOOK.add("src_csv_na_token", "SELECT obs_id, ozone, solar_r FROM hw1_data WHERE ozone IS NULL")
def _(t):
    """'NA' in a file is a missing value."""
    df = t("hw1_data").select("obs_id", "ozone", "solar_r")
    path = _path(df.sparkSession, "csv")
    df.write.csv(path, header=True, nullValue="NA")
    return files.read_csv(df.sparkSession, path, schema=df.schema, na="NA").where("ozone is null")


@BOOK.add("src_entity_files", "SELECT s_nationkey AS id, count(*) AS n, round(avg(s_acctbal), 4) AS mean FROM supplier WHERE s_nationkey IN (3, 7, 12) GROUP BY 1")
def _(t):
    """One file an entity, named by its zero-padded number; only the wanted files are opened."""
    df = t("supplier")
    path = _path(df.sparkSession, "entities")
    files.write_entities(df.select("s_suppkey", "s_acctbal", "s_nationkey"), path, "s_nationkey")
    rows = files.read_entities(df.sparkSession, path, "s_suppkey long, s_acctbal double", [3, 7, 12])
    return rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("s_acctbal"), 4).alias("mean"))


@BOOK.add("src_csv_head", "SELECT [n_nationkey::VARCHAR, n_name] AS fields FROM nation ORDER BY n_nationkey LIMIT 5")
def _(t):
    """The first five lines as lists of texts."""
    df = t("nation").select("n_nationkey", "n_name").orderBy("n_nationkey").coalesce(1)
    path = _path(df.sparkSession, "csv")
    files.write_csv(df, path, header=False)
    return files.read_rows(df.sparkSession, path).limit(5)


@BOOK.add("src_parquet_columns", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_shipdate > DATE '1998-06-01'")
def _(t):
    """A columnar scan reads two columns and skips what the filter rules out."""
    return t("lineitem").where("l_shipdate > DATE'1998-06-01'").select("l_orderkey", "l_quantity")


@BOOK.add("src_npz_matrix", "SELECT * FROM (VALUES ('m.npz', 0::BIGINT, 0::BIGINT, 1.5::DOUBLE), ('m.npz', 0, 2, 2.0), ('m.npz', 2, 1, -3.25)) v(file, row, col, value)")
def _(t):
    """A compressed sparse row matrix with an empty row."""
    spark = t("region").sparkSession
    path, held = f"{_path(spark, 'npz')}/m.npz", io.BytesIO()
    np.savez(held, data=np.array([1.5, 2.0, -3.25]), indices=np.array([0, 2, 1]), indptr=np.array([0, 2, 2, 3]))
    files.write_bytes(spark, path, held.getvalue())
    return files.read_npz_csr(spark, path)


@BOOK.add("src_listing", "SELECT 2::BIGINT AS files, true AS any_bytes")
def _(t):
    df = t("region")
    path = _path(df.sparkSession, "listing")
    df.repartition(2).write.option("compression", "none").csv(path)
    found = files.list_files(df.sparkSession, path, "part-*")
    return found.agg(F.count(F.lit(1)).alias("files"), (F.sum("length") > 0).alias("any_bytes"))


@BOOK.add("src_sparse_long", "SELECT id AS row_id, e.key AS term, e.value AS weight FROM (SELECT id, unnest(map_entries(tfidf)) AS e FROM people_wiki)")
def _(t):
    """Sparse rows in long form."""
    return R.stack_map(t("people_wiki").select(F.col("id").alias("row_id"), "tfidf"), "tfidf", "term", "weight")


@BOOK.add("src_json_index", "SELECT n_name AS word, n_nationkey::BIGINT AS index FROM nation")
def _(t):
    df = t("nation")
    spark = df.sparkSession
    path = _path(spark, "json")
    index = df.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("n_name", F.col("n_nationkey").cast("long"))))).alias("value"))
    index.coalesce(1).write.text(path)
    return files.read_index(spark, path)


@BOOK.add("src_text_lines", "SELECT count(*) AS lines, sum(length(r_name))::BIGINT AS characters FROM region")
def _(t):
    """Lines written in two appends and read back."""
    df = t("region").select("r_name")
    path = _path(df.sparkSession, "text")
    files.write_text(df.where("r_name < 'B'"), path)
    files.write_text(df.where("r_name >= 'B'"), path, mode="append", compression="gzip")
    return files.read_lines(df.sparkSession, path).agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("value")).alias("characters"))


@BOOK.add("src_html_title", "SELECT p_partkey, p_name || ' & more' AS title FROM part")
def _(t):
    html = F.concat(F.lit("<html><head><TITLE id='a'>\n"), F.col("p_name"), F.lit(" &amp; more</TITLE></head><body><title>x</title></body></html>"))
    return t("part").select("p_partkey", files.html_title(html).alias("title"))


@BOOK.add("src_image_crop", "SELECT id, list_slice(image_array, 7, 9) AS cropped FROM image_train WHERE image_array IS NOT NULL AND len(image_array) = 12")
def _(t):
    """The lower left pixel of 2 x 2 pictures of three channels."""
    rows = t("image_train").where("image_array is not null and size(image_array) = 12")
    return rows.select("id", images.crop("image_array", 2, 3, 0, 1, 1, 2).alias("cropped"))


@BOOK.add("src_image_resize", "SELECT id, list_transform([0, 1, 2, 0, 1, 2, 3, 4, 5, 3, 4, 5, 0, 1, 2, 0, 1, 2, 3, 4, 5, 3, 4, 5, 6, 7, 8, 6, 7, 8, 9, 10, 11, 9, 10, 11, 6, 7, 8, 6, 7, 8, 9, 10, 11, 9, 10, 11], lambda i: image_array[i + 1]) AS pixels FROM image_train WHERE image_array IS NOT NULL AND len(image_array) = 12")
def _(t):
    """Pictures of 2 x 2 made 4 x 4."""
    rows = t("image_train").where("image_array is not null and size(image_array) = 12")
    return rows.select("id", images.resize("image_array", 2, 2, 3, 4, 4).alias("pixels"))


@BOOK.add("src_image_file", "SELECT 2 AS height, 2 AS width, 3 AS channels, 12::BIGINT AS bytes")
def _(t):
    """A picture saved and read back."""
    spark = t("region").sparkSession
    folder = _path(spark, "pictures")
    images.write_png(spark, f"{folder}/one.png", list(range(0, 120, 10)), 2, 3)
    return images.read_images(spark, folder).select("height", "width", "channels", F.length("data").cast("long").alias("bytes"))


@BOOK.add("src_literal_frame", "SELECT * FROM (VALUES ('a', 1::BIGINT), ('b', 2), ('c', NULL)) v(name, x)")
def _(t):
    return t("region").sparkSession.createDataFrame([("a", 1), ("b", 2), ("c", None)], "name string, x long")


# --- projection and filters


@BOOK.add("prj_computed", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, 1 AS constant FROM lineitem WHERE l_discount > 0.05 AND l_discount < 0.07")
def _(t):
    rows = t("lineitem").where((F.col("l_discount") > 0.05) & (F.col("l_discount") < 0.07))
    return rows.select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"), F.lit(1).alias("constant"))


@BOOK.add("prj_drop_rename", "SELECT c_custkey AS customer, c_mktsegment, c_acctbal FROM customer")
def _(t):
    return t("customer").drop("c_name", "c_nationkey").withColumnRenamed("c_custkey", "customer")


@BOOK.add("prj_cast", "SELECT p_partkey, p_size::DOUBLE AS size, trunc(p_retailprice)::INT AS price, try_cast(p_brand AS DOUBLE) AS brand_number FROM part")
def _(t):
    return t("part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").cast("int").alias("price"), R.try_number("p_brand").alias("brand_number"))


@BOOK.add("flt_predicates", "SELECT p_partkey FROM part WHERE (p_size >= 30 AND p_retailprice <> 1000) OR lower(p_name) LIKE '%a%' AND p_size < 5")
def _(t):
    a = (F.col("p_size") >= 30) & (F.col("p_retailprice") != 1000)
    return t("part").where(a | (F.lower("p_name").contains("a") & (F.col("p_size") < 5))).select("p_partkey")


@BOOK.add("flt_member", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(t):
    wanted = t("customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return R.member_filter(t("orders").select("o_custkey", "o_orderkey"), "o_custkey", wanted)


@BOOK.add("flt_member_list", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (1, 3)")
def _(t):
    return R.member_filter(t("nation"), "n_regionkey", [1, 3]).select("n_nationkey", "n_name")


@BOOK.add("nul_missing", "SELECT obs_id, ozone IS NULL AS no_ozone, coalesce(ozone, 0) AS ozone_or_0 FROM hw1_data WHERE solar_r IS NOT NULL")
def _(t):
    return t("hw1_data").where(F.col("solar_r").isNotNull()).select("obs_id", R.is_na("ozone").alias("no_ozone"), F.coalesce("ozone", F.lit(0)).alias("ozone_or_0"))


@BOOK.add("nul_complete_cases", "SELECT obs_id FROM hw1_data WHERE ozone IS NOT NULL AND solar_r IS NOT NULL AND wind IS NOT NULL AND NOT isnan(wind) AND temp IS NOT NULL")
def _(t):
    return R.complete_cases(t("hw1_data"), ["ozone", "solar_r", "wind", "temp"]).select("obs_id")


@BOOK.add("nul_split", "SELECT ozone IS NOT NULL AND solar_r IS NOT NULL AS complete, count(*) AS n FROM hw1_data GROUP BY 1")
def _(t):
    whole, rest = R.split_complete(t("hw1_data"), ["ozone", "solar_r"])
    return whole.select(F.lit(True).alias("complete")).unionByName(rest.select(F.lit(False).alias("complete"))).groupBy("complete").agg(F.count(F.lit(1)).alias("n"))


@BOOK.add("row_slice", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 20")
def _(t):
    return R.row_slice(t("orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 20, 30)


@BOOK.add("row_by_label", "SELECT n_nationkey, n_name FROM nation WHERE n_name IN (SELECT n_name FROM nation WHERE n_nationkey IN (2, 5))")
def _(t):
    names = t("nation").where("n_nationkey in (2, 5)").select("n_name")
    return t("nation").join(names, "n_name", "left_semi").select("n_nationkey", "n_name")


@BOOK.add("row_block", "SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM orders) WHERE position IN (0, 2, 5)")
def _(t):
    """Rows by position in an order, and a block of columns."""
    return numbered(t("orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"]).where(F.col("position").isin(0, 2, 5)).drop("position")


@BOOK.add("join_positions", "SELECT c_custkey, p_partkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS i FROM customer) JOIN (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS i FROM part) USING (i)")
def _(t):
    """Two frames side by side by position."""
    return zip_frames(t("customer").select("c_custkey", "c_acctbal"), t("part").select("p_partkey"), [F.desc("c_acctbal"), "c_custkey"], ["p_partkey"]).select("c_custkey", "p_partkey")


@BOOK.add("mask_cells", "SELECT obs_id, CASE WHEN wind < 10 THEN wind END AS wind, CASE WHEN temp < 80 THEN temp END AS temp FROM (SELECT obs_id, wind, temp FROM hw1_data)")
def _(t):
    rows = t("hw1_data").select("obs_id", "wind", "temp")
    return R.mask_cells(R.mask_cells(rows, ["wind"], lambda c: c < 10), ["temp"], lambda c: c < 80)


@BOOK.add("mask_modulo", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 2 = 0 AND l_quantity > 45")
def _(t):
    return t("lineitem").where((F.col("l_orderkey") % 2 == 0) & (F.col("l_quantity") > 45)).select("l_orderkey", "l_linenumber")


@BOOK.add("map_if_else", "SELECT loan_id, CASE WHEN bad_loans = 0 THEN 1 WHEN bad_loans IS NOT NULL THEN -1 END AS safe FROM lending_club_data")
def _(t):
    return t("lending_club_data").select("loan_id", F.when(F.col("bad_loans") == 0, 1).when(F.col("bad_loans").isNotNull(), -1).alias("safe"))


@BOOK.add("polynomial", "SELECT p_partkey, p_size::DOUBLE AS power_1, power(p_size, 2) AS power_2, power(p_size, 3) AS power_3 FROM part")
def _(t):
    return R.polynomial(t("part"), "p_size", 3).select("p_partkey", "power_1", "power_2", "power_3")


@BOOK.add("feature_transform", "SELECT p_partkey, p_size * p_size AS p_size_squared, round(ln(p_retailprice), 6) AS p_retailprice_log FROM part")
def _(t):
    out = R.with_transformed(t("part"), "p_size", "squared", lambda c: c * c)
    return R.with_transformed(out, "p_retailprice", "log", lambda c: F.round(F.ln(c), 6)).select("p_partkey", "p_size_squared", "p_retailprice_log")


@BOOK.add("string_concat", "SELECT s_suppkey, s_name || ' / ' || s_nationkey AS label FROM supplier")
def _(t):
    return t("supplier").select("s_suppkey", F.concat("s_name", F.lit(" / "), F.col("s_nationkey").cast("string")).alias("label"))


@BOOK.add("pack_columns", "SELECT id, [red, green, blue] AS packed FROM images WHERE red IS NOT NULL AND green IS NOT NULL AND blue IS NOT NULL")
def _(t):
    return R.pack(R.complete_cases(t("images").select("id", "red", "green", "blue")), ["red", "green", "blue"], "packed")


@BOOK.add("unpack_map", "SELECT id, word_count['is']::INT AS \"w.is\", word_count['born']::INT AS \"w.born\" FROM people_wiki WHERE word_count IS NOT NULL")
def _(t):
    rows = t("people_wiki").where("word_count is not null").select("id", "word_count")
    return R.unpack_map(rows, "word_count", "w", ["is", "born"])


@BOOK.add("stack_map", "SELECT e.key AS word, sum(e.value)::BIGINT AS n FROM (SELECT unnest(map_entries(word_count)) AS e FROM people_wiki) GROUP BY 1 HAVING sum(e.value) > 5")
def _(t):
    return R.stack_map(t("people_wiki").select("word_count"), "word_count", "word", "value").groupBy("word").agg(F.sum("value").alias("n")).where("n > 5")


@BOOK.add(
    "one_hot",
    """SELECT c_custkey, (c_mktsegment = 'AUTOMOBILE')::INT AS c_mktsegment_AUTOMOBILE, (c_mktsegment = 'BUILDING')::INT AS c_mktsegment_BUILDING, (c_mktsegment = 'FURNITURE')::INT AS c_mktsegment_FURNITURE,
 (c_mktsegment = 'HOUSEHOLD')::INT AS c_mktsegment_HOUSEHOLD, (c_mktsegment = 'MACHINERY')::INT AS c_mktsegment_MACHINERY FROM customer""",
)
def _(t):
    return R.one_hot(t("customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"])


@BOOK.add("normalise_columns", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity / (SELECT sqrt(sum(power(p_size, 2))) FROM part), 8) AS l_quantity FROM lineitem")
def _(t):
    """Columns of one frame divided by the norm found on another."""
    norms = R.column_norms(t("part").select(F.col("p_size").cast("double").alias("l_quantity")), ["l_quantity"])
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return R.normalise_columns(rows, norms).withColumn("l_quantity", F.round("l_quantity", 8))


@BOOK.add("normalise_rows", "SELECT vec_id, round(embedding[1] / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))), 5) AS first FROM embeddings")
def _(t):
    from weftline.functions.numeric import unit

    return t("embeddings").select("vec_id", F.round(unit(F.col("embedding").cast("array<double>"))[0], 5).alias("first"))


@BOOK.add("distinct_values", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def _(t):
    return t("orders").select("o_orderstatus", "o_orderpriority").distinct()


# --- joins


@BOOK.add(
    "join_suffixes",
    "SELECT a.n_regionkey, a.name AS name_x, b.name AS name_y FROM (SELECT n_regionkey, n_name AS name FROM nation) a JOIN (SELECT r_regionkey AS n_regionkey, r_name AS name FROM region) b USING (n_regionkey) WHERE b.name <> 'ASIA'",
)
def _(t):
    a = t("nation").select("n_regionkey", F.col("n_name").alias("name"))
    b = t("region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("name"))
    return R.suffixed_join(a, b, ["n_regionkey"]).where("name_y <> 'ASIA'")


@BOOK.add(
    "join_right_topk",
    "SELECT c_custkey, c_name, round(total, 4) AS total FROM (SELECT o_custkey AS c_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1) o LEFT JOIN customer USING (c_custkey) ORDER BY o.total DESC, c_custkey LIMIT 10",
)
def _(t):
    totals = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("total"))
    joined = t("customer").select("c_custkey", "c_name").join(totals, "c_custkey", "right")
    return joined.orderBy(F.desc("total"), "c_custkey").limit(10).select("c_custkey", "c_name", F.round("total", 4).alias("total"))


@BOOK.add(
    "join_aligned_sum",
    "SELECT coalesce(a.k, b.k) AS k, round(a.v + b.v, 4) AS v FROM (SELECT c_nationkey AS k, sum(c_acctbal) AS v FROM customer WHERE c_nationkey < 15 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, sum(s_acctbal) AS v FROM supplier WHERE s_nationkey > 8 GROUP BY 1) b ON a.k = b.k",
)
def _(t):
    """Label-aligned addition; a label missing on one side gives null."""
    a = t("customer").where("c_nationkey < 15").groupBy(F.col("c_nationkey").alias("k")).agg(F.sum("c_acctbal").alias("v"))
    b = t("supplier").where("s_nationkey > 8").groupBy(F.col("s_nationkey").alias("k")).agg(F.sum("s_acctbal").alias("v"))
    return R.aligned_sum(a, b, "k", "v").select("k", F.round("v", 4).alias("v"))


@BOOK.add("join_all_pairs", "SELECT n_name, r_name, abs(n_regionkey - r_regionkey) AS gap FROM nation, region")
def _(t):
    return R.all_pairs(t("nation"), t("region")).select("n_name", "r_name", F.abs(F.col("n_regionkey") - F.col("r_regionkey")).alias("gap"))


@BOOK.add("join_two_rows", "SELECT a.s_name AS a, b.s_name AS b, round(abs(a.s_acctbal - b.s_acctbal), 4) AS gap FROM supplier a, supplier b WHERE a.s_suppkey = 3 AND b.s_suppkey = 5")
def _(t):
    a, b = (t("supplier").where(F.col("s_suppkey") == k).select(F.col("s_name").alias(n), F.col("s_acctbal").alias(f"x{n}")) for k, n in ((3, "a"), (5, "b")))
    return a.crossJoin(b).select("a", "b", F.round(F.abs(F.col("xa") - F.col("xb")), 4).alias("gap"))


@BOOK.add(
    "join_star",
    "SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL",
)
def _(t):
    """Filters and columns are pruned into the scans; the fixed-size tables join in place."""
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@BOOK.add("join_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def _(t):
    return t("customer").join(t("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


# --- set operations


@BOOK.add("set_union_all", "SELECT n_name AS name, n_regionkey AS region FROM nation UNION ALL SELECT r_name, r_regionkey FROM region")
def _(t):
    return t("nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).unionByName(t("region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("region")))


@BOOK.add("set_union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def _(t):
    return t("customer").select(F.col("c_nationkey").alias("k")).union(t("supplier").select("s_nationkey")).distinct()


@BOOK.add("set_intersect", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def _(t):
    return t("customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).intersect(t("supplier").where("s_acctbal > 5000").select("s_nationkey"))


@BOOK.add("set_subset", "SELECT id, len(list_intersect(map_keys(word_count), ['the', 'of', 'in'])) = 3 AS has_all FROM people_wiki WHERE word_count IS NOT NULL")
def _(t):
    return t("people_wiki").where("word_count is not null").select("id", R.subset_of_keys("word_count", ["the", "of", "in"]).alias("has_all"))


@BOOK.add("set_remove", "SELECT n_nationkey FROM nation WHERE n_nationkey <> 7")
def _(t):
    return t("nation").where("n_nationkey <> 7").select("n_nationkey")


# --- sort and top-k


@BOOK.add("sort_multi", "SELECT p_partkey, p_size FROM part ORDER BY p_size, p_partkey")
def _(t):
    return t("part").select("p_partkey", "p_size").orderBy(F.asc_nulls_last("p_size"), "p_partkey")


@BOOK.add("top_k", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 15")
def _(t):
    return t("part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(15)


@BOOK.add("k_smallest_per_group", "SELECT s_nationkey, s_suppkey, rank FROM (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey)::INT AS rank FROM supplier) WHERE rank <= 3")
def _(t):
    return top_per_group(t("supplier"), ["s_nationkey"], ["s_acctbal", "s_suppkey"], 3).select("s_nationkey", "s_suppkey", "rank")


QUERIES, ORACLES = BOOK.queries, BOOK.statements
