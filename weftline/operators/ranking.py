"""n-th per group, moving averages, cumulative cut-offs, folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.runtime import materialize


def nth_per_group(df: DataFrame, group: str, value: str, name: str, which: int | str = "best") -> DataFrame:
    """The row of rank ``which`` ('best', 'worst' or a number) of each group by (value, name).

    Rows without a value do not rank. A group that lacks the rank gives a null ``name``.
    """
    ranked = df.where(F.col(value).isNotNull()).select(group, value, name)
    if which in ("best", "worst"):
        pick = F.min_by if which == "best" else F.max_by
        found = ranked.groupBy(group).agg(pick(name, F.struct(value, name)).alias(name))
    else:
        if int(which) < 1:
            raise ValueError("rank must be 'best', 'worst' or a positive number")
        found = ranked.withColumn("__rn", F.row_number().over(Window.partitionBy(group).orderBy(value, name))).where(F.col("__rn") == int(which)).select(group, name)
    return df.select(group).distinct().join(found, group, "left").select(group, name)


def moving_average(df: DataFrame, order: str, value: str, width: int, by: list[str]) -> DataFrame:
    """Means of ``width`` successive values, only where the window is full."""
    w = Window.partitionBy(*by).orderBy(order)
    frame = w.rowsBetween(-(width - 1), 0)
    return df.select(*by, order, F.avg(value).over(frame).alias("moving_average"), F.row_number().over(w).alias("__i")).where(F.col("__i") >= width).drop("__i")


def cumulative_cutoff(df: DataFrame, group: str, name: str, score: str, cutoff: float) -> DataFrame:
    """The best names of each group up to the one that brings the cumulative score to ``cutoff``."""
    w = Window.partitionBy(group).orderBy(F.desc(score), name)
    before = F.sum(score).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("__before", F.coalesce(before, F.lit(0.0))).where(F.col("__before") < cutoff).drop("__before")


def top_per_group(df: DataFrame, by: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group; the limit is applied before the shuffle too."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def contiguous_folds(df: DataFrame, key: str, k: int) -> DataFrame:
    """Fold of each row: k contiguous blocks of the rows in order of ``key``, as even as possible.

    Rows are numbered without gathering them in one task: ranges of keys are
    counted, and each range numbers its rows from the count before it.
    """
    numbered, total = _numbered(df, [key], "__rn")
    return numbered.withColumn("fold", F.floor(((F.col("__rn") + 1) * k - 1) / total).cast("int") if total else F.lit(0)).drop("__rn")


def _numbered(df: DataFrame, order: list, name: str) -> tuple[DataFrame, int]:
    width = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = materialize(df.repartitionByRange(width, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    # one number for each range, as many as the session has shuffle partitions
    counts = {r["__part"]: r["n"] for r in ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, start = 0, {}
    for p in sorted(counts):
        start[p] = before
        before += counts[p]
    if not start:
        return df.withColumn(name, F.lit(0).cast("long")), 0
    offsets = F.create_map(*(F.lit(x).cast("long") for kv in start.items() for x in kv))
    rn = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1 + offsets[F.col("__part")]
    return ranged.withColumn(name, rn).drop("__part"), before


def numbered(df: DataFrame, order: list, name: str = "position") -> DataFrame:
    """Position of each row, from 0, in the given order, without gathering the rows in one task."""
    return _numbered(df, order, name)[0]


def zip_frames(a: DataFrame, b: DataFrame, order_a: list, order_b: list) -> DataFrame:
    """Rows of two frames side by side by position; the longer one is cut to the shorter."""
    clash = set(a.columns) & set(b.columns)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    return numbered(a, order_a, "__position").join(numbered(b, order_b, "__position"), "__position").drop("__position")


def outcome_column(outcome: str, columns: dict[str, str]) -> str:
    """Column that a named outcome stands for; an unknown name is an error."""
    if outcome not in columns:
        raise ValueError(f"invalid outcome {outcome!r}, one of {sorted(columns)}")
    return columns[outcome]


def changed(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """How many rows changed their value from one iteration to the next."""
    joined = a.select(key, F.col(value).alias("__a")).join(b.select(key, F.col(value).alias("__b")), key)
    return joined.agg(F.count_if(~F.col("__a").eqNullSafe(F.col("__b"))).alias("changed"))
