"""Queries that fill missing values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.impute import Field, fill_missing
from weftline.runtime import table

AIR_FIELDS = [Field("ozone", 1, 400), Field("solar_r", 1, 1000), Field("month", 1, 12, categorical=True, of_time="month")]


def p5_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Air-quality records with ozone, solar_r and month filled, and a mark for each filled value."""
    return fill_missing(table(spark, sf_dir, "hw1_data"), "obs_id", AIR_FIELDS, "station", "obs_ts", ["wind", "temp"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = p5_filled(spark, sf_dir)
    marks = F.array(*(F.when(F.col(f"{f.name}_filled"), F.lit(f.name)) for f in AIR_FIELDS))
    return filled.select("obs_id", F.explode(F.filter(marks, lambda x: x.isNotNull())).alias("field"))


QUERIES = {"p5_found": p5_found, "p5_filled": p5_filled}

ORACLES = {
    "p5_found": """WITH r AS (SELECT DISTINCT ON (obs_id) * FROM hw1_data WHERE obs_id IS NOT NULL)
SELECT obs_id, 'ozone' AS field FROM r WHERE NOT coalesce(ozone BETWEEN 1 AND 400, false)
UNION ALL SELECT obs_id, 'solar_r' FROM r WHERE NOT coalesce(solar_r BETWEEN 1 AND 1000, false)
UNION ALL SELECT obs_id, 'month' FROM r WHERE NOT coalesce("month" BETWEEN 1 AND 12, false)"""
}
