from pathlib import Path

from pyspark.sql import functions as F

from weftline import runtime as R


def test_materialised_tables_keep_schema_and_rows(spark):
    df = spark.range(10).select("id", F.array(F.lit(1.5)).alias("a"), F.lit(None).cast("string").alias("s"))
    back = R.materialize(df, "test")
    assert back.dtypes == df.dtypes and sorted(back.collect()) == sorted(df.collect())
    assert R.materialize(df.limit(0), "empty").count() == 0
    assert "weftline" in back.inputFiles()[0]


def test_deliveries_count_once(spark):
    df = spark.createDataFrame([(1, "a", 9), (1, "a", 10), (2, None, 1), (None, "x", 1)], "k int, v string, loaded int")
    assert sorted((r.k, r.v) for r in R.delivered_once(df, "k", "v").collect()) == [(1, "a"), (2, None)]


def test_no_checkpoint_is_local():
    root = Path(R.__file__).parent
    assert not [p for p in root.rglob("*.py") if "localCheckpoint" in p.read_text()]
    core = [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts]
    assert not [p for p in core if "weftline.llm" in p.read_text()]
