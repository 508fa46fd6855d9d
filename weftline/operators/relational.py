"""Projection, filters, nulls, joins and set operations on data frames."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_na(c: str | Column) -> Column:
    """Null, or NaN of a floating value."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull() | F.isnan(c.cast("double"))


def try_number(c: str | Column) -> Column:
    """Text as a number, null where it is none."""
    return (F.col(c) if isinstance(c, str) else c).try_cast("double")


def complete_cases(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Rows without a missing value in ``columns`` (default all)."""
    out = df
    for c in columns or df.columns:
        out = out.where(~is_na(c) if dict(df.dtypes)[c] in ("double", "float") else F.col(c).isNotNull())
    return out


def split_complete(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows complete in ``columns``, and the others."""
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    return df.where(whole), df.where(~whole)


def member_filter(df: DataFrame, column: str, values: DataFrame | list) -> DataFrame:
    """Rows whose ``column`` is among ``values``: a list, or a frame of one column (semi-join)."""
    if isinstance(values, DataFrame):
        return df.join(values.toDF(column), column, "left_semi")
    return df.where(F.col(column).isin(values))


def row_slice(df: DataFrame, order: list, start: int, stop: int) -> DataFrame:
    """Rows start..stop-1 in ``order``.

    A bounded top-k, not a numbering of all rows: the plan keeps ``stop`` rows a partition.
    """
    return df.orderBy(*order).offset(start).limit(max(0, stop - start))


def mask_cells(df: DataFrame, columns: list[str], keep: Callable[[Column], Column]) -> DataFrame:
    """Cells for which ``keep`` is not true become null."""
    return df.withColumns({c: F.when(keep(F.col(c)), F.col(c)) for c in columns})


def polynomial(df: DataFrame, column: str, degree: int) -> DataFrame | None:
    """power_1 .. power_degree of a column; nothing for a degree below 1."""
    if degree < 1:
        return None
    x = F.col(column).cast("double")
    return df.withColumns({f"power_{i}": F.pow(x, F.lit(float(i))) if i > 1 else x for i in range(1, degree + 1)})


def with_transformed(df: DataFrame, column: str, suffix: str, change: Callable[[Column], Column]) -> DataFrame:
    """Adds ``<column>_<suffix>``."""
    return df.withColumn(f"{column}_{suffix}", change(F.col(column)))


def pack(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    return df.withColumn(name, F.array(*columns)).drop(*columns)


def unpack_map(df: DataFrame, column: str, prefix: str, keys: list[str] | None = None, limit: int = 10_000) -> DataFrame:
    """A column for each key of a map, keys in sorted order; the key domain must not exceed ``limit``."""
    if keys is None:
        found = df.select(F.explode(F.map_keys(column)).alias("k")).distinct().orderBy("k").limit(limit + 1).collect()
        if len(found) > limit:
            raise ValueError(f"{column} has over {limit} keys; keep it long")
        keys = [r.k for r in found]
    return df.select("*", *(F.col(column)[k].alias(f"{prefix}.{k}") for k in keys)).drop(column)


def stack_map(df: DataFrame, column: str, key: str, value: str) -> DataFrame:
    """A row for each entry of a map."""
    return df.select(*(c for c in df.columns if c != column), F.explode(column).alias(key, value))


def one_hot(df: DataFrame, columns: list[str], limit: int = 1000, domains: dict[str, list] | None = None) -> DataFrame:
    """0/1 columns ``<feature>_<value>`` in place of categorical ones, values in sorted order.

    Of a domain at most ``limit`` + 1 values reach the driver; over ``limit`` is an error.
    """
    if domains is None:
        domains = {c: sorted(r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().limit(limit + 1).collect()) for c in columns}
    for c, values in domains.items():
        if len(values) > limit:
            raise ValueError(f"{c} has over {limit} values")
    new = [F.when(F.col(c) == v, 1).otherwise(0).alias(f"{c}_{v}") for c in columns for v in domains[c]]
    return df.select(*(c for c in df.columns if c not in columns), *new)


def column_norms(df: DataFrame, columns: list[str]) -> dict[str, float]:
    row = df.agg(*(F.sqrt(F.sum(F.col(c) * F.col(c))).alias(c) for c in columns)).first()
    return {c: row[c] for c in columns}


def normalise_columns(df: DataFrame, norms: dict[str, float]) -> DataFrame:
    """Columns divided by given (training) norms."""
    return df.withColumns({c: F.col(c) / F.lit(n) for c, n in norms.items()})


def suffixed_join(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner", suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Equi-join that renames columns which both sides have."""
    both = (set(a.columns) & set(b.columns)) - set(on)
    left = a.select(*(F.col(c).alias(c + suffixes[0]) if c in both else F.col(c) for c in a.columns))
    right = b.select(*(F.col(c).alias(c + suffixes[1]) if c in both else F.col(c) for c in b.columns))
    return left.join(right, on, how)


def aligned_sum(a: DataFrame, b: DataFrame, label: str, value: str) -> DataFrame:
    """Label-aligned sum of two series: null where a label is missing on one side."""
    joined = a.select(label, F.col(value).alias("__a")).join(b.select(label, F.col(value).alias("__b")), label, "full_outer")
    return joined.select(label, (F.col("__a") + F.col("__b")).alias(value))


def subset_of_keys(column: str, words: list[str]) -> Column:
    """Whether a map has all of ``words`` as keys."""
    return F.size(F.array_except(F.array(*(F.lit(w) for w in words)), F.map_keys(column))) == 0


def all_pairs(a: DataFrame, b: DataFrame, max_right: int = 100_000) -> DataFrame:
    """Every row of ``a`` with every row of the small side ``b``, whose size is checked before it is broadcast."""
    n = b.limit(max_right + 1).count()
    if n > max_right:
        raise ValueError(f"the small side of all_pairs has over {max_right} rows; use the search operators")
    return a.crossJoin(F.broadcast(b))


def first_seen_rank(df: DataFrame, value: str, order: str, k: int) -> DataFrame:
    """The k most common values; ties go to the one seen first in ``order``."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_seen"))
    return counts.orderBy(F.desc("n"), "first_seen").limit(k)
