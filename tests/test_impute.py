import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators.impute import Field, fill_missing
from weftline.plans.impute import AIR_FIELDS
from weftline.runtime import table

SHAPE = "obs_id long, station string, obs_ts timestamp, ozone int, solar_r int, month int, wind double, temp int, k int, g int, cells int, day int"


def frame(spark, rows):
    return spark.createDataFrame(rows, SHAPE)


def run(df):
    return {r.obs_id: r for r in fill_missing(df, "obs_id", AIR_FIELDS, "station", "obs_ts", ["wind", "temp"]).collect()}


def row(i, station="a", ts=dt.datetime(2020, 5, 1), ozone=40, solar=200, month=5, wind=9.0, temp=70):
    return (i, station, None if ts is None else ts + dt.timedelta(days=i), ozone, solar, month, wind, temp, 1, 2, 3, 4)


def test_marks_missing_and_impossible_values(spark):
    out = run(frame(spark, [row(1), row(2, ozone=None), row(3, solar=-5), row(4, month=13), row(5, ozone=4000), row(6)]))
    marked = {(i, f.name) for i, r in out.items() for f in AIR_FIELDS if r[f"{f.name}_filled"]}
    assert marked == {(2, "ozone"), (3, "solar_r"), (4, "month"), (5, "ozone")}
    assert all(1 <= r.ozone <= 400 and 1 <= r.solar_r <= 1000 and r.month == 5 for r in out.values())
    assert out[1].ozone == 40  # known values stay


def test_nulls_everywhere_repeats_and_ties(spark):
    empty = (9, None, None, None, None, None, None, None, None, None, None, None)
    nan = row(7, wind=float("nan"))
    out = run(frame(spark, [row(1), row(1), row(2), empty, nan, (None, "a", None, 1, 1, 1, 1.0, 1, 1, 1, 1, 1), row(3, month=None, ts=None)]))
    assert set(out) == {1, 2, 3, 7, 9}
    assert out[9].ozone_filled and out[9].ozone is not None and out[9].month == 5


def test_empty_table_and_field_without_values(spark):
    assert run(frame(spark, [])) == {}
    out = run(frame(spark, [row(1, ozone=None), row(2, ozone=None)]))
    assert out[1].ozone is None and out[1].ozone_filled


def test_field_range_is_inclusive(spark):
    f = Field("ozone", 1, 400)
    got = [r[0] for r in spark.createDataFrame([(0.0,), (1.0,), (400.0,), (401.0,), (float("nan"),), (None,)], "ozone double").select(f.valid(F.col("ozone"), "double")).collect()]
    assert got == [None, 1.0, 400.0, None, None, None]


def test_beats_the_mean_on_held_out_values(spark):
    t = table(spark, "/root/testdata/sf0.01", "hw1_data").dropDuplicates(["obs_id"])
    hidden = F.pmod(F.xxhash64("obs_id"), F.lit(8)) == 0
    shown = t.withColumn("ozone", F.when(~hidden, F.col("ozone"))).withColumn("month", F.when(~(F.pmod(F.xxhash64("obs_id", F.lit(1)), F.lit(8)) == 0), F.col("month")))
    out = fill_missing(shown, "obs_id", AIR_FIELDS, "station", "obs_ts", ["wind", "temp"])
    truth = t.select("obs_id", AIR_FIELDS[0].valid(F.col("ozone"), "int").alias("o"), AIR_FIELDS[2].valid(F.col("month"), "int").alias("m"))
    rows = out.join(truth, "obs_id").toPandas()
    a = rows[rows.ozone_filled & rows.o.notna()]
    assert len(a) > 30
    assert np.sqrt(((a.ozone - a.o) ** 2).mean()) < np.sqrt(((rows.o.mean() - a.o) ** 2).mean())
    m = rows[rows.month_filled & rows.m.notna()]
    assert (m.month == m.m).mean() > 0.95


@pytest.mark.parametrize("n", [1, 2])
def test_tiny_tables(spark, n):
    out = run(frame(spark, [row(i, ozone=None if i else 30) for i in range(n)]))
    assert len(out) == n


def test_categories_of_text_and_their_bound(spark):
    rows = [(i, "ab"[i % 2], dt.datetime(2020, 5, 1) + dt.timedelta(days=i), ("low" if i % 2 else "high") if i % 7 else " ", float(i % 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, station string, ts timestamp, level string, x double")
    out = {r.id: r for r in fill_missing(df, "id", [Field("level", categorical=True)], "station", "ts", ["x"]).collect()}
    assert {i for i, r in out.items() if r.level_filled} == set(range(0, 60, 7))
    assert all(r.level == ("low" if i % 2 else "high") for i, r in out.items())
    with pytest.raises(ValueError):
        fill_missing(df, "id", [Field("level", categorical=True)], "station", "ts", most_categories=1)


def test_solar_and_ozone_stay_in_range_when_held_out(spark):
    """No worse than the mean by more than chance for a field that follows nothing."""
    t = table(spark, "/root/testdata/sf0.01", "hw1_data").dropDuplicates(["obs_id"])
    hidden = F.pmod(F.xxhash64("obs_id", F.lit(3)), F.lit(8)) == 0
    out = fill_missing(t.withColumn("solar_r", F.when(~hidden, F.col("solar_r"))), "obs_id", AIR_FIELDS, "station", "obs_ts", ["wind", "temp"])
    rows = out.join(t.select("obs_id", AIR_FIELDS[1].valid(F.col("solar_r"), "int").alias("s")), "obs_id").toPandas()
    a = rows[rows.solar_r_filled & rows.s.notna()]
    assert len(a) > 30 and a.solar_r.between(1, 1000).all()
    assert np.sqrt(((a.solar_r - a.s) ** 2).mean()) < 1.1 * np.sqrt(((rows.s.mean() - a.s) ** 2).mean())
