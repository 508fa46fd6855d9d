"""Text, number, array, map, bit and date expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import numeric as N
from weftline.functions import text as X
from weftline.plans._query import Book

BOOK = Book()

_TOKENS = r"list_filter(string_split_regex(text, '\s+'), lambda t: t <> '')"
_WORDS = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), lambda t: t <> '')"


@BOOK.add("txt_slices", "SELECT p_partkey, substr(p_name, 2, 3) AS middle, right(p_name, 3) AS tail, reverse(p_name) AS backward, substr(p_name, 1, 1) || substr(p_name, 3, 1) || substr(p_name, 5, 1) AS odd FROM part")
def _(t):
    c = "p_name"
    return t("part").select("p_partkey", X.sliced(c, 1, 4).alias("middle"), X.sliced(c, -3).alias("tail"), X.sliced(c, step=-1).alias("backward"), X.sliced(c, 0, 6, 2).alias("odd"))


@BOOK.add("txt_case_repeat", "SELECT n_name, upper(n_name) AS up, lower(n_name) AS low, length(n_name)::INT AS n, repeat('ab', 3) || n_name AS more FROM nation")
def _(t):
    return t("nation").select("n_name", F.upper("n_name").alias("up"), F.lower("n_name").alias("low"), F.length("n_name").alias("n"), F.concat(F.repeat(F.lit("ab"), 3), "n_name").alias("more"))


@BOOK.add("txt_split", rf"SELECT doc_id, len({_TOKENS}) AS pieces, len(string_split(text, ' ')) AS spaced, array_to_string(list_slice({_TOKENS}, 1, 5), ' ') AS first_five FROM documents WHERE text IS NOT NULL")
def _(t):
    tokens = X.white_space_tokens("text")
    rows = t("documents").where("text is not null")
    return rows.select("doc_id", F.size(tokens).cast("long").alias("pieces"), F.size(F.split("text", " ")).cast("long").alias("spaced"), F.array_join(F.slice(tokens, 1, 5), " ").alias("first_five"))


@BOOK.add("txt_format", "SELECT s_suppkey, lpad(s_suppkey::VARCHAR, 6, '0') || ': ' || printf('%.3f', s_acctbal) AS label, ['x', 'y', 'z'][(s_suppkey % 3) + 1] AS recycled FROM supplier")
def _(t):
    label = F.concat(X.padded("s_suppkey", 6), F.lit(": "), F.format_string("%.3f", "s_acctbal"))
    return t("supplier").select("s_suppkey", label.alias("label"), X.recycled(F.array(F.lit("x"), F.lit("y"), F.lit("z")), F.col("s_suppkey")).alias("recycled"))


@BOOK.add("txt_punctuation", r"SELECT review_id, regexp_replace(review, '[!-/:-@\[-`{-~]', '', 'g') AS plain FROM (SELECT DISTINCT review_id, review FROM amazon_baby) WHERE review IS NOT NULL")
def _(t):
    return t("amazon_baby").where("review is not null").select("review_id", "review").distinct().select("review_id", X.without_punctuation("review").alias("plain"))


@BOOK.add("txt_word_counts", rf"SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({_WORDS}) AS term FROM documents) GROUP BY 1, 2")
def _(t):
    return X.word_counts(t("documents"), "doc_id", X.word_tokens("text"))


@BOOK.add("txt_known_words", rf"SELECT id, term, count(*) AS n FROM (SELECT id, unnest({_WORDS}) AS term FROM (SELECT DISTINCT ON (id) id, text FROM people_wiki)) WHERE term IN (SELECT unnest({_WORDS}) FROM subject_examples) GROUP BY 1, 2")
def _(t):
    """Counts over a vocabulary learnt elsewhere; unseen words are dropped."""
    known = t("subject_examples").select(F.explode(X.word_tokens("text")).alias("term")).distinct()
    people = t("people_wiki").select("id", "text").dropDuplicates(["id"])
    return X.word_counts(people, "id", X.word_tokens("text")).join(known, "term", "left_semi").select("id", "term", "n")


@BOOK.add("txt_one_word", rf"SELECT review_id, len(list_filter(list_filter(string_split_regex(review, '\s+'), lambda t: t <> ''), lambda w: w = 'the')) AS n_the FROM amazon_baby WHERE review IS NOT NULL")
def _(t):
    return t("amazon_baby").where("review is not null").select("review_id", X.occurrences(X.white_space_tokens("review"), "the").cast("long").alias("n_the"))


@BOOK.add("txt_map_lookup", "SELECT id, coalesce(word_count['of'], 0)::INT AS n_of FROM people_wiki WHERE word_count IS NOT NULL")
def _(t):
    return t("people_wiki").where("word_count is not null").select("id", F.coalesce(F.col("word_count")["of"], F.lit(0)).alias("n_of"))


@BOOK.add("txt_stop_words", "SELECT id, len(list_filter(map_keys(word_count), lambda k: k NOT IN ('the', 'of', 'in', 'a')))::BIGINT AS kept FROM people_wiki WHERE word_count IS NOT NULL")
def _(t):
    bag = X.without_words("word_count", ["the", "of", "in", "a"])
    return t("people_wiki").where("word_count is not null").select("id", F.size(bag).cast("long").alias("kept"))


@BOOK.add(
    "txt_tf_idf",
    rf"WITH c AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({_WORDS}) AS term FROM documents) GROUP BY 1, 2), d AS (SELECT term, count(*) AS df FROM c GROUP BY 1) SELECT doc_id, term, round(n * ln((SELECT count(DISTINCT doc_id) FROM c) / df), 6) AS tf_idf FROM c JOIN d USING (term)",
)
def _(t):
    counts = X.word_counts(t("documents"), "doc_id", X.word_tokens("text"))
    return X.tf_idf(counts, "doc_id").select("doc_id", "term", F.round("tf_idf", 6).alias("tf_idf"))


@BOOK.add(
    "txt_top_words",
    "SELECT id, list_transform(list_slice(list_sort(list_transform(map_entries(word_count), lambda e: {'n': -e.value, 'w': e.key})), 1, 5), lambda x: x.w) AS words FROM people_wiki WHERE word_count IS NOT NULL",
)
def _(t):
    top = F.transform(X.top_entries("word_count", 5), lambda e: e["key"])
    return t("people_wiki").where("word_count is not null").select("id", top.alias("words"))


@BOOK.add(
    "txt_long_to_map",
    "SELECT id, list_transform(b, lambda x: x.w) AS words, list_transform(b, lambda x: x.n) AS counts FROM (SELECT id, list_sort(list_transform(map_entries(word_count), lambda e: {'w': e.key, 'n': e.value})) AS b FROM (SELECT DISTINCT ON (id) id, word_count FROM people_wiki WHERE word_count IS NOT NULL AND len(map_keys(word_count)) > 0))",
)
def _(t):
    """Long counts gathered back into one bag a document, through a vocabulary of word numbers."""
    rows = t("people_wiki").where("word_count is not null").select("id", "word_count").dropDuplicates(["id"])
    long = rows.select("id", F.explode("word_count").alias("word", "n"))
    vocabulary = long.select("word").distinct().select("word", F.xxhash64("word").alias("nr"))
    coded = long.join(vocabulary, "word").select("id", "nr", "n")
    bags = coded.join(vocabulary, "nr").groupBy("id").agg(F.sort_array(F.collect_list(F.struct(F.col("word").alias("w"), "n"))).alias("b"))
    return bags.select("id", F.col("b.w").alias("words"), F.col("b.n").alias("counts"))


@BOOK.add("txt_has_top_words", "SELECT count_if(len(list_intersect(map_keys(word_count), ['the', 'of'])) = 2)::BIGINT AS n FROM people_wiki WHERE word_count IS NOT NULL")
def _(t):
    """How many documents have all of the given words."""
    from weftline.operators.relational import subset_of_keys

    return t("people_wiki").where("word_count is not null").agg(F.count_if(subset_of_keys("word_count", ["the", "of"])).alias("n"))


@BOOK.add("txt_length_in_words", "SELECT doc_id, len(string_split(text, ' ')) AS n FROM documents WHERE text IS NOT NULL")
def _(t):
    return t("documents").where("text is not null").select("doc_id", F.size(F.split("text", " ")).cast("long").alias("n"))


@BOOK.add("num_functions", "SELECT p_partkey, p_size % 7 AS m, power(p_size, 2) AS p, round(sqrt(p_retailprice), 8) AS s, round(exp(p_size / 10.0), 4) AS e, round(sin(p_size), 8) AS i, ceil(p_retailprice / 7)::BIGINT AS c, floor(p_retailprice / 7)::BIGINT AS f, round(log10(p_retailprice), 8) AS l FROM part")
def _(t):
    x, y = F.col("p_size"), F.col("p_retailprice")
    return t("part").select(
        "p_partkey", (x % 7).alias("m"), F.pow(x, F.lit(2)).alias("p"), F.round(F.sqrt(y), 8).alias("s"), F.round(F.exp(x / 10.0), 4).alias("e"), F.round(F.sin(x.cast("double")), 8).alias("i"), F.ceil(y / 7).alias("c"), F.floor(y / 7).alias("f"), F.round(F.log10(y), 8).alias("l")
    )


@BOOK.add("num_log_of_zero", "SELECT k, CASE WHEN k = 0 THEN '-inf' ELSE 'finite' END AS kind FROM (SELECT unnest(range(0, 3))::BIGINT AS k)")
def _(t):
    spark = t("region").sparkSession
    v = N.natural_log(F.col("id").cast("double"))
    return spark.range(3).select(F.col("id").alias("k"), F.when(v == F.lit(float("-inf")), "-inf").otherwise("finite").alias("kind"))


@BOOK.add("num_sigmoid", "SELECT c_custkey, round(1 / (1 + exp(-c_acctbal / 1000)), 8) AS p, round(ln(1 + exp(c_acctbal / 1000)), 8) AS softplus FROM customer")
def _(t):
    x = F.col("c_acctbal") / 1000
    return t("customer").select("c_custkey", F.round(N.sigmoid(x), 8).alias("p"), F.round(N.log1p_exp(x), 8).alias("softplus"))


@BOOK.add("num_log_sum_exp", "SELECT id, round(ln(list_sum(list_transform(image_array, lambda v: exp(v - 255)))) + 255, 6) AS lse FROM image_train WHERE image_array IS NOT NULL")
def _(t):
    return t("image_train").where("image_array is not null").select("id", F.round(N.log_sum_exp("image_array"), 6).alias("lse"))


@BOOK.add("num_bits", "SELECT k, xor(k, 4) AS flipped, bit_count(xor(k, 21))::INT AS hamming, (k << 2) AS shifted FROM (SELECT unnest(range(0, 64))::BIGINT AS k)")
def _(t):
    k = F.col("id")
    return t("region").sparkSession.range(64).select(k.alias("k"), N.flip_bit(k, 2).alias("flipped"), N.hamming(k, F.lit(21).cast("long")).alias("hamming"), F.shiftleft(k, 2).alias("shifted"))


@BOOK.add("num_density_2d", "SELECT i, j, round(exp(-(power(i - 1, 2) / 4 + power(j, 2) - 2 * 0.25 * ((i - 1) / 2.0) * j) / (2 * (1 - 0.0625))) / (2 * pi() * 2 * sqrt(1 - 0.0625)), 10) AS density FROM (SELECT unnest(range(-3, 4))::BIGINT AS i), (SELECT unnest(range(-3, 4))::BIGINT AS j)")
def _(t):
    s = t("region").sparkSession
    grid = s.range(-3, 4).select(F.col("id").alias("i")).crossJoin(s.range(-3, 4).select(F.col("id").alias("j")))
    return grid.select("i", "j", F.round(N.normal_density_2d(F.col("i"), F.col("j"), 2.0, 1.0, 1.0, 0.0, 0.5), 10).alias("density"))


@BOOK.add("arr_generators", "SELECT 1 AS k, range(0, 10, 2)::BIGINT[] AS evens, [0.0, 0.25, 0.5, 0.75, 1.0]::DOUBLE[] AS grid, [1.0, 1.0, 1.0]::DOUBLE[] AS ones")
def _(t):
    grid = F.array(*(F.lit(x) for x in N.grid(0.0, 1.0, 5)))
    return t("region").where("r_regionkey = 0").select(F.lit(1).alias("k"), F.sequence(F.lit(0).cast("long"), F.lit(8).cast("long"), F.lit(2).cast("long")).alias("evens"), grid.alias("grid"), F.array_repeat(F.lit(1.0), 3).alias("ones"))


@BOOK.add(
    "arr_access",
    "SELECT vec_id, CAST(round(embedding[3], 5) AS FLOAT)::DOUBLE AS third, len(embedding)::INT AS n, CAST(round(list_max(embedding), 5) AS FLOAT)::DOUBLE AS largest, CAST(round(list_min(embedding), 5) AS FLOAT)::DOUBLE AS smallest FROM embeddings",
)
def _(t):
    e = F.col("embedding")
    up = lambda c: F.round(c, 5).cast("double")
    return t("embeddings").select("vec_id", up(F.element_at(e, 3)).alias("third"), F.size(e).alias("n"), up(F.array_max(e)).alias("largest"), up(F.array_min(e)).alias("smallest"))


@BOOK.add("arr_submatrix", "SELECT id, [image_array[4:5], image_array[7:8]] AS block, 4 AS rows, 3 AS columns FROM image_train WHERE image_array IS NOT NULL AND len(image_array) = 12")
def _(t):
    """Rows 1-2 and columns 0-1 of a 4 x 3 matrix held by rows, and its shape."""
    x = F.col("image_array")
    matrix = F.transform(F.sequence(F.lit(0), (F.size(x) / 3).cast("int") - 1), lambda r: F.slice(x, r * 3 + 1, 3))
    rows = t("image_train").where("image_array is not null and size(image_array) = 12").select("id", matrix.alias("m"))
    return rows.select("id", F.transform(F.slice("m", 2, 2), lambda r: F.slice(r, 1, 2)).alias("block"), F.size("m").alias("rows"), F.size(F.col("m")[0]).alias("columns"))


@BOOK.add("struct_fields", "SELECT s.key AS key, s.name AS name, s.place.region AS region FROM (SELECT {'key': n_nationkey, 'name': n_name, 'place': {'region': n_regionkey}} AS s FROM nation)")
def _(t):
    """Fields of named tuples by name and by nesting."""
    s = F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.struct(F.col("n_regionkey").alias("region")).alias("place"))
    return t("nation").select(s.alias("s")).select(F.col("s").getField("key").alias("key"), "s.name", "s.place.region")


@BOOK.add("arr_mutations", "SELECT n_nationkey, [n_nationkey, n_regionkey, 9] AS appended, [n_regionkey] AS popped, list_position([n_nationkey, n_regionkey, 9], 9)::BIGINT AS at, list_sort([n_nationkey, n_regionkey, 9]) AS ordered FROM nation")
def _(t):
    base = F.array("n_nationkey", "n_regionkey")
    more = F.array_append(base, F.lit(9))
    return t("nation").select("n_nationkey", more.alias("appended"), F.slice(base, 2, 1).alias("popped"), F.array_position(more, F.lit(9)).alias("at"), F.array_sort(more).alias("ordered"))


@BOOK.add("map_functions", "SELECT id, len(map_keys(word_count))::INT AS n, list_sum(map_values(word_count))::BIGINT AS total, coalesce(word_count['zebra'], -1)::INT AS zebra FROM people_wiki WHERE word_count IS NOT NULL")
def _(t):
    m = F.col("word_count")
    total = F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda s, v: s + v)
    return t("people_wiki").where("word_count is not null").select("id", F.size(F.map_keys(m)).alias("n"), total.alias("total"), F.coalesce(F.try_element_at(m, F.lit("zebra")), F.lit(-1)).alias("zebra"))


@BOOK.add("arr_map_filter", "SELECT id, list_sum(list_transform(list_filter(image_array, lambda v: v > 128), lambda v: v * 2)) AS bright FROM image_train WHERE image_array IS NOT NULL AND list_max(image_array) > 128")
def _(t):
    rows = t("image_train").where("image_array is not null").where(F.array_max("image_array") > 128)
    return rows.select("id", F.aggregate(F.transform(F.filter("image_array", lambda v: v > 128), lambda v: v * 2), F.lit(0.0), lambda s, v: s + v).alias("bright"))


@BOOK.add("gen_cubes", "SELECT k, (k * k * k)::BIGINT AS cube FROM (SELECT unnest(range(0, 20))::BIGINT AS k)")
def _(t):
    return t("region").sparkSession.range(20).select(F.col("id").alias("k"), (F.col("id") * F.col("id") * F.col("id")).alias("cube"))


@BOOK.add("date_functions", "SELECT o_orderkey, date_diff('day', DATE '1995-01-01', o_orderdate::DATE)::INT AS days, (o_orderdate::DATE + 30) AS due, year(o_orderdate)::INT AS y, strftime(o_orderdate, '%a %b') || ' ' || day(o_orderdate) || strftime(o_orderdate, ' %H:%M:%S %Y') AS c_time FROM orders")
def _(t):
    d = F.to_date("o_orderdate")
    return t("orders").select("o_orderkey", F.date_diff(d, F.lit("1995-01-01").cast("date")).alias("days"), F.date_add(d, 30).alias("due"), F.year(d).alias("y"), X.c_time(F.col("o_orderdate")).alias("c_time"))


@BOOK.add("txt_json_field", "SELECT event_id, (props->>'$.k')::INT AS k FROM events")
def _(t):
    """Extension: a field of a JSON text."""
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


QUERIES, ORACLES = BOOK.queries, BOOK.statements
