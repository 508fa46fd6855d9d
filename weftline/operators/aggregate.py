"""Null-aware aggregates, profiles and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.runtime import materialize


def pooled_mean(df: DataFrame, value: str, entity: str | None = None, ids: list | None = None) -> DataFrame:
    """Mean of all known values of the chosen entities: sum over count, not a mean of means."""
    rows = df if ids is None else df.where(F.col(entity).isin(ids))
    return rows.agg(F.avg(value).alias("mean"))


def complete_counts(df: DataFrame, entity: str, columns: list[str], ids: DataFrame) -> DataFrame:
    """Complete rows of each requested entity, 0 where it has none; ``ids`` is a frame of the entity column."""
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    counts = df.groupBy(entity).agg(F.count_if(whole).alias("nobs"))
    return ids.select(entity).join(counts, entity, "left").select(entity, F.coalesce("nobs", F.lit(0)).alias("nobs"))


def correlation_by_entity(df: DataFrame, entity: str, x: str, y: str, threshold: int = 0) -> DataFrame:
    """Correlation of the complete rows of each entity with over ``threshold`` of them."""
    whole = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return whole.groupBy(entity).agg(F.corr(x, y).alias("corr"), F.count(F.lit(1)).alias("nobs")).where(F.col("nobs") > threshold)


def column_means(df: DataFrame, columns: list[str], remove_na: bool = True) -> DataFrame:
    """Mean of each column; without ``remove_na``, null where any value is missing."""
    mean = lambda c: F.avg(c) if remove_na else F.when(F.count(c) == F.count(F.lit(1)), F.avg(c))
    return df.agg(*(mean(c).alias(c) for c in columns))


def frequency(df: DataFrame, value: str) -> DataFrame:
    return df.groupBy(value).agg(F.count(F.lit(1)).alias("n"))


def bin_counts(df: DataFrame, value: str) -> DataFrame:
    """Count of each integer from 0 to the largest, zeros included."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = counts.agg(F.max("bin").alias("top")).where("top is not null").select(F.explode(F.sequence(F.lit(0).cast("long"), "top")).alias("bin"))
    return grid.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def five_numbers(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Minimum, quartiles (linear interpolation), mean and maximum.

    Exact, from ranks: values are counted, ranges of values are counted, and
    each range goes on from the count before it. No task holds the values of a
    group, whatever its size. Missing values take no part; a group without a
    value has none of the numbers.
    """
    by = by or []
    width = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = df.groupBy(*by, F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    counts = materialize(counts.repartitionByRange(width, *by, "__v").withColumn("__part", F.spark_partition_id()).withColumn("__n", F.when(F.col("__v").isNull(), 0).otherwise(F.col("__n"))), "value-counts")
    parts = counts.groupBy(*by, "__part").agg(F.sum("__n").alias("__in_part"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = F.sum("__in_part").over(group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(*(F.col(c).alias(f"__g{i}") for i, c in enumerate(by)), F.col("__part").alias("__p"), F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__in_part").over(group).alias("__total"))
    same = F.col("__part") == F.col("__p")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__g{i}"))
    inside = Window.partitionBy(*by, "__part").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.join(parts, same).withColumn("__to", F.sum("__n").over(inside) + F.col("__before"))
    aggs = [F.min("__v").alias("minimum"), (F.sum(F.col("__v") * F.col("__n")) / F.nullif(F.max("__total"), F.lit(0))).alias("mean"), F.max("__v").alias("maximum"), F.max("__total").alias("__total")]
    for name, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        place = q * (F.col("__total") - 1)
        for end, at in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            aggs.append(F.min(F.when((F.col("__to") > at) & F.col("__v").isNotNull(), F.col("__v"))).alias(f"{name}_{end}"))
    out = (ranked.groupBy(*by) if by else ranked).agg(*aggs)
    quart = lambda n, q: (F.col(f"{n}_lo") + (F.col(f"{n}_hi") - F.col(f"{n}_lo")) * (q * (F.col("__total") - 1) - F.floor(q * (F.col("__total") - 1)))).alias(n)
    kind = dict(df.dtypes)[value]
    return out.select(*by, F.col("minimum").cast(kind).alias("minimum"), quart("q1", 0.25), quart("median", 0.5), quart("q3", 0.75), "mean", F.col("maximum").cast(kind).alias("maximum"))


def sketch(df: DataFrame, columns: list[str], accuracy: float = 0.01) -> DataFrame:
    """Profile of columns in one pass: rows, missing, approximate distinct values and quartiles."""
    parts = []
    for c in columns:
        quart = F.percentile_approx(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(int(1 / accuracy) * 100))
        parts.append(
            F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col(c).isNull()).alias("missing"), F.approx_count_distinct(c, accuracy).alias("distinct"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), quart.cast("array<double>").alias("quartiles"))
        )
    return df.agg(F.array(*parts).alias("p")).select(F.inline("p"))


def histogram(df: DataFrame, value: str, bins: int, low: float, high: float) -> DataFrame:
    """Count and density of ``bins`` equal bins of [low, high]; the last bin is closed. Empty bins are kept."""
    width = (high - low) / bins
    at = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1))
    counts = df.where(F.col(value).between(low, high)).groupBy(at.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(bins).select(F.col("id").alias("bin"))
    all_bins = grid.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return all_bins.crossJoin(F.broadcast(total)).select("bin", "n", (F.col("n") / (F.col("total") * width)).alias("density"))


def arg_extreme(df: DataFrame, value: str, key: str, largest: bool = True) -> DataFrame:
    """Key of the largest (smallest) value; ties go to the smallest key."""
    best = F.max_by(key, F.struct(F.col(value), -F.col(key))) if largest else F.min_by(key, F.struct(F.col(value), F.col(key)))
    return df.agg(best.alias(key), (F.max(value) if largest else F.min(value)).alias(value))


def moments(df: DataFrame, features: list[str], target: str) -> list[Column]:
    """Aggregates of X'X, X'y and y'y (upper triangle, intercept first), one pass."""
    x = [F.lit(1.0), *(F.col(c).cast("double") for c in features)]
    y = F.col(target).cast("double")
    out = [F.sum(a * b).alias(f"xx_{i}_{j}") for i, a in enumerate(x) for j, b in enumerate(x) if i <= j]
    return out + [F.sum(a * y).alias(f"xy_{i}") for i, a in enumerate(x)] + [F.sum(y * y).alias("yy")]
