import pytest
from pyspark.sql import functions as F

from weftline.functions import numeric as N
from weftline.functions import text as X
from weftline.operators import aggregate as A
from weftline.operators import ranking as K
from weftline.operators import relational as R
from weftline.sources import files, images
from weftline.streaming import events as E


def one(df):
    return df.first()


def test_slices_like_python(spark):
    for text in ("", "a", "hello world"):
        df = spark.createDataFrame([(text,)], "s string")
        for a, b, step in ((None, None, -1), (0, 7, 2), (-3, None, 1), (-3, -1, 1), (2, 100, 1), (5, 2, 1), (4, 0, -2), (None, 3, -1)):
            assert one(df.select(X.sliced("s", a, b, step)))[0] == text[slice(a, b, step)], (text, a, b, step)


def test_tokens(spark):
    df = spark.createDataFrame([("  a  b\tc ",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(X.white_space_tokens("s")).collect()] == [["a", "b", "c"], [], None]
    bag = one(spark.createDataFrame([("Be, be or not",)], "s string").select(X.word_count_map(X.word_tokens("s"))))[0]
    assert bag == {"be": 2, "or": 1, "not": 1}


def test_number_expressions(spark):
    df = spark.createDataFrame([(-800.0,), (0.0,), (800.0,)], "x double")
    assert [round(r[0], 6) for r in df.select(N.log1p_exp(F.col("x"))).collect()] == [0.0, 0.693147, 800.0]
    assert [r[0] for r in df.select(N.natural_log(F.abs(F.col("x")) * 0)).collect()] == [float("-inf")] * 3
    assert N.log_grid(0, 2, 3) == [1, 10, 100] and N.grid(1, 2, 1) == [1]


def test_ranks_with_missing_values_and_short_groups(spark):
    df = spark.createDataFrame([("x", 2.0, "b"), ("x", 1.0, "c"), ("x", 1.0, "a"), ("y", None, "z"), ("w", 3.0, "q")], "g string, v double, n string")
    get = lambda which: {r.g: r.n for r in K.nth_per_group(df, "g", "v", "n", which).collect()}
    assert get("best") == {"x": "a", "y": None, "w": "q"}
    assert get("worst") == {"x": "b", "y": None, "w": "q"}
    assert get(2) == {"x": "c", "y": None, "w": None}
    with pytest.raises(ValueError):
        get(0)


def test_null_rules(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, float("nan"))], "k int, v double")
    assert R.complete_cases(df).count() == 1 and df.where(R.is_na("v")).count() == 2
    whole, rest = R.split_complete(df, ["v"])
    assert (whole.count(), rest.count()) == (2, 1)
    assert one(A.column_means(df.where("k < 3"), ["v"], remove_na=False)).v is None
    assert one(df.select(R.try_number(F.lit("Not Available"))))[0] is None
    assert R.polynomial(df, "v", 0) is None


def test_bins_and_histogram_of_nothing(spark):
    empty = spark.createDataFrame([], "v int")
    assert A.bin_counts(empty, "v").count() == 0
    assert one(A.histogram(empty, "v", 4, 0.0, 4.0).agg(F.sum("n")))[0] == 0
    top = A.histogram(spark.createDataFrame([(4,)], "v int"), "v", 4, 0.0, 4.0).where("n > 0").collect()
    assert [r.bin for r in top] == [3]


def test_wide_domains_are_refused(spark):
    df = spark.range(50).select("id", F.col("id").cast("string").alias("c"))
    with pytest.raises(ValueError):
        R.one_hot(df, ["c"], limit=10)
    with pytest.raises(ValueError):
        R.all_pairs(df, df, max_right=10)


def test_files(spark, tmp_path):
    path = str(tmp_path / "x.csv")
    spark.createDataFrame([(1, 'say "hi"\nthere', None)], "a int, b string, c double").coalesce(1).write.csv(path, header=True, escape='"', nullValue="NA")
    row = one(files.read_csv(spark, path, na="NA"))
    assert (row.a, row.b, row.c) == (1, 'say "hi"\nthere', None)
    (tmp_path / "w.json").write_text('["b", "a"]')
    assert [(r.position, r.word) for r in files.read_word_list(spark, str(tmp_path / "w.json")).collect()] == [(0, "b"), (1, "a")]
    folder = tmp_path / "entities"
    folder.mkdir()
    for i in (1, 30):
        (folder / f"{i:03d}.csv").write_text("x\nNA\n5\n")
    got = files.read_entities(spark, str(folder), "x int", [30]).collect()
    assert [(r.x, r.id) for r in got] == [(None, 30), (5, 30)]
    assert files.sniff_schema(spark, str(folder / "001.csv"), na="NA").fields[0].dataType.typeName() == "integer"
    html = spark.createDataFrame([("<title>\n A &amp; B </title>",), ("none",), (None,)], "h string")
    assert [r[0] for r in html.select(files.html_title("h")).collect()] == ["A & B", "", None]


def test_picture_geometry(spark):
    px = [float(i) for i in range(12)]  # 2 x 2 pixels of 3 channels
    df = spark.createDataFrame([(px, [0.5, 0.6, 0.7])], "p array<double>, q array<double>")
    assert one(df.select(images.crop("p", 2, 3, 1, 0, 2, 2)))[0] == [3, 4, 5, 9, 10, 11]
    assert one(df.select(images.paste("p", "q", 2, 3, 1, 1, 1)))[0] == [*px[:9], 0.5, 0.6, 0.7]
    assert one(df.select(images.resize("p", 2, 2, 3, 1, 1)))[0] == [0, 1, 2]


def test_stream_gives_the_batch_result(spark, data, tmp_path):
    src = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    batch = E.windowed_counts(src, "ts", "event_type", "value", "1 day").count()
    stream = E.windowed_counts(E.read_events(spark, str(tmp_path / "in"), src.schema), "ts", "event_type", "value", "1 day")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        assert spark.table("windows").count() == batch
    finally:
        q.stop()
    assert E.sessions(src, "user_id", "ts", "30 minutes").agg(F.sum("n")).first()[0] == src.count()
