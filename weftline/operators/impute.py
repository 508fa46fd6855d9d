"""Filling missing values from similar records: low-rank alternating least squares over mixed encoded cells."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.runtime import materialize


@dataclass(frozen=True)
class Field:
    """A field to fill: its valid range, and whether it is a category (numbers or texts).

    ``of_time`` names a part of the time stamp (``month``, ``dayofweek``, ...)
    that tells the category where there is a stamp.
    """

    name: str
    low: float = -np.inf
    high: float = np.inf
    categorical: bool = False
    of_time: str | None = None

    def valid(self, value: Column, kind: str) -> Column:
        """The value, or null where it is missing, not a number, impossible or a blank text."""
        if self.categorical and kind == "string":
            return F.nullif(F.trim(value), F.lit(""))
        x = value.cast("double")
        return F.when(~F.isnan(x) & x.between(self.low, self.high), x)


@dataclass
class Factors:
    """Feature factors, and the location and scale of each cell column."""

    v: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    ridge: float

    def records(self, x: np.ndarray) -> np.ndarray:
        """Factors of records (rows of standardised cells, NaN where unknown): one ridge solution each."""
        known = ~np.isnan(x)
        rank = self.v.shape[1]
        gram = (known.astype(float) @ (self.v[:, :, None] * self.v[:, None, :]).reshape(len(self.v), -1)).reshape(-1, rank, rank)
        return np.linalg.solve(gram + self.ridge * np.eye(rank), (np.where(known, x, 0.0) @ self.v)[:, :, None])[:, :, 0]


def _cells(batch: pa.RecordBatch, column: int, width: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def _fit(cells: DataFrame, width: int, rank: int, ridge: float, rounds: int, seed: int = 11) -> Factors:
    """Alternating least squares. Record factors are solved where the records lie; of the
    feature factors' equations every task sends its sums, ``width`` x ``rank``^2 numbers."""
    spark = cells.sparkSession
    stats = cells.select(*(F.struct(F.avg(F.col("cells")[i]), F.stddev_pop(F.col("cells")[i])).alias(f"s{i}") for i in range(width))).first()
    centre = np.array([s[0] if s[0] is not None else 0.0 for s in stats])
    scale = np.array([s[1] if s[1] else 1.0 for s in stats])
    model = Factors(np.random.default_rng(seed).normal(0, 0.3, (width, rank)), centre, scale, ridge)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m = shared.value
            gram, right = np.zeros((width, rank * rank)), np.zeros((width, rank))
            for b in batches:
                x = (_cells(b, 0, width) - m.centre) / m.scale
                u, known = m.records(x), ~np.isnan(x)
                gram += known.T.astype(float) @ (u[:, :, None] * u[:, None, :]).reshape(len(u), -1)
                right += np.where(known, x, 0.0).T @ u
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([gram.ravel(), right.ravel()]).tolist()])], ["s"])

        total = cells.select("cells").mapInArrow(sums, "s array<double>").select(F.posexplode("s")).groupBy("pos").agg(F.sum("col").alias("n")).toPandas()
        flat = total.sort_values("pos")["n"].to_numpy()
        gram, right = flat[: width * rank * rank].reshape(width, rank, rank), flat[width * rank * rank :].reshape(width, rank)
        model = Factors(np.linalg.solve(gram + ridge * np.eye(rank), right[:, :, None])[:, :, 0], centre, scale, ridge)
    return model


def _trust(cells: DataFrame, model: Factors, columns: list[int]) -> dict[int, float]:
    """How much of the decoded deviation from the mean to believe, for each cell column.

    Every known cell is decoded from the others of its record; the slope of
    the values on these guesses, between 0 and 1, shrinks what the factors
    only fitted to noise.
    """
    shared, width = cells.sparkSession.sparkContext.broadcast(model), len(model.v)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        total = np.zeros((len(columns), 2))
        for b in batches:
            x = (_cells(b, 0, width) - m.centre) / m.scale
            for i, c in enumerate(columns):
                rows = x[~np.isnan(x[:, c])]
                truth = rows[:, c].copy()
                rows[:, c] = np.nan
                guess = m.records(rows) @ m.v[c]
                total[i] += (guess @ truth, guess @ guess)
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()])], ["s"])

    got = cells.select("cells").mapInArrow(sums, "s array<double>").select(F.posexplode("s")).groupBy("pos").agg(F.sum("col").alias("n")).collect()
    flat = {r.pos: r.n for r in got}
    return {c: float(np.clip(flat.get(2 * i, 0.0) / max(flat.get(2 * i + 1, 0.0), 1e-9), 0.0, 1.0)) for i, c in enumerate(columns)}


def fill_missing(
    records: DataFrame, key: str, fields: list[Field], group: str, when: str, numeric: list[str] = (), rank: int = 10, ridge: float = 5.0, rounds: int = 8, neighbour: str | None = None, most_categories: int = 64
) -> DataFrame:
    """Fills ``fields`` from records of the same ``group`` or the same time, and marks what was filled.

    A record becomes a row of cells: its own fields (categories one-hot) and
    ``numeric`` fields, the means of its group by month, those of all groups
    on its day, its month by the time stamp, and the values of the records with
    the keys before and after it in the group (``neighbour``, an integer that
    runs with time in a group; default the key). The cells are factorised at
    ``rank``; a missing entry is decoded from the factors of its record and
    field to a valid value: a number within the range, rounded for integer
    columns, or the category with the greatest cell. A category of over
    ``most_categories`` values is an error: each value is a cell of every record.

    Null keys are left out and repeated deliveries count once. Records that
    lack everything get the typical value. A field without any valid value
    stays null but is marked. Ties among categories go to the smallest. An
    empty table gives no rows. Other columns of ``records`` are ignored.

    Returns the key and, for each field, ``<field>`` and ``<field>_filled``.
    """
    types = dict(records.dtypes)
    near_by = neighbour or key
    spark = records.sparkSession
    kept = records.where(F.col(key).isNotNull()).select(
        F.col(key).alias("k"),
        F.col(group).alias("g"),
        F.col(near_by).cast("long").alias("p"),
        F.to_date(when).alias("day"),
        F.month(when).alias("stamp"),
        *(f.valid(F.col(f.name), types[f.name]).alias(f"f{i}") for i, f in enumerate(fields)),
        *(F.expr(f"{f.of_time}(`{when}`)").alias(f"t{i}") for i, f in enumerate(fields) if f.of_time),
        *(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(f"n{i}") for i, c in enumerate(numeric)),
    )
    base = materialize(kept.dropDuplicates(["k"]), "fill-records")
    plain = [f"f{i}" for i, f in enumerate(fields) if not f.categorical] + [f"n{i}" for i in range(len(numeric))]
    coded = [(f"f{i}", f) for i, f in enumerate(fields) if f.categorical]
    domains = {c: sorted(r[0] for r in base.select(c).where(F.col(c).isNotNull()).distinct().limit(most_categories + 1).collect()) for c, _ in coded}
    for c, f in coded:
        if len(domains[c]) > most_categories:
            raise ValueError(f"{f.name} has over {most_categories} categories")

    def totals(mark: str) -> list[Column]:
        return [e for c in plain for e in (F.sum(c).alias(f"{mark}s_{c}"), F.count(c).alias(f"{mark}n_{c}"))]

    def of_others(mark: str, c: str) -> Column:
        """Mean of the other records: a record's own value must not come back as its context."""
        own = F.coalesce(F.col(c), F.lit(0.0))
        n = F.col(f"{mark}n_{c}") - F.col(c).isNotNull().cast("long")
        return F.when(n > 0, (F.col(f"{mark}s_{c}") - own) / n)

    by_group = base.where("g is not null and stamp is not null").groupBy("g", "stamp").agg(*totals("g"))
    by_day = base.where("day is not null").groupBy("day").agg(*totals("d"))
    next_to = base.where("g is not null and p is not null").select("g", "p", *plain, *(c for c, _ in coded))

    def moved(by: int, mark: str) -> DataFrame:
        return next_to.select("g", (F.col("p") + by).alias("p"), *(F.col(c).alias(f"{mark}_{c}") for c in [*plain, *(c for c, _ in coded)])).dropDuplicates(["g", "p"])

    wide = base.join(moved(1, "b"), ["g", "p"], "left").join(moved(-1, "a"), ["g", "p"], "left").join(by_group, ["g", "stamp"], "left").join(by_day, "day", "left")
    columns = [F.col(c) for c in plain] + [of_others(m, c) for m in "gd" for c in plain] + [F.col(f"{m}_{c}") for m in "ba" for c in plain]
    for c, f in coded:
        for value in domains[c]:
            for source in (c, f"b_{c}", f"a_{c}", *([f"t{c[1:]}"] if f.of_time else [])):
                columns.append(F.when(F.col(source).isNotNull(), (F.col(source) == value).cast("double")))
    missing = [F.col(f"f{i}").isNull().alias(f"m{i}") for i in range(len(fields))]
    cells = materialize(wide.select("k", *(f"f{i}" for i in range(len(fields))), *missing, F.array(*(c.cast("double") for c in columns)).alias("cells")), "fill-cells")
    width = len(columns)
    model = _fit(cells, width, rank, ridge, rounds)
    shared = spark.sparkContext.broadcast(model)
    first = len(plain) * 5
    where: dict[int, list[int] | int] = {}
    at = first
    for i, f in enumerate(fields):
        if f.categorical:
            values = domains[f"f{i}"]
            step = 4 if f.of_time else 3
            where[i] = [at + step * j for j in range(len(values))]
            at += step * len(values)
        else:
            where[i] = plain.index(f"f{i}")
    trust = _trust(cells, model, [where[i] for i, f in enumerate(fields) if not f.categorical])
    empty = {i for i, f in enumerate(fields) if not f.categorical and _unknown(cells, where[i])}

    kinds = [pa.string() if dict(base.dtypes)[f"f{i}"] == "string" else pa.float64() for i in range(len(fields))]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            x = (_cells(b, 1, width) - m.centre) / m.scale
            guess = m.records(x) @ m.v.T * np.array([trust.get(c, 1.0) for c in range(width)]) * m.scale + m.centre
            out = [b.column(0)]
            for i, f in enumerate(fields):
                if f.categorical:
                    values = pa.array(domains[f"f{i}"], kinds[i])
                    out.append(values.take(pa.array(guess[:, where[i]].argmax(1))) if len(values) else pa.nulls(len(guess), kinds[i]))
                    continue
                value = np.full(len(guess), np.nan) if i in empty else np.clip(guess[:, where[i]], f.low, f.high)
                out.append(pa.array(value, pa.float64(), from_pandas=True))
            yield pa.RecordBatch.from_arrays(out, ["k", *(f"guess{i}" for i in range(len(fields)))])

    key_type = dict(base.dtypes)["k"]
    guesses = cells.where(" or ".join(f"m{i}" for i in range(len(fields)))).select("k", "cells").mapInArrow(decode, f"k {key_type}, " + ", ".join(f"guess{i} {'string' if kinds[i] == pa.string() else 'double'}" for i in range(len(fields))))
    joined = cells.drop("cells").join(guesses, "k", "left")
    out = [F.col("k").alias(key)]
    for i, f in enumerate(fields):
        value = F.coalesce(F.col(f"f{i}"), F.col(f"guess{i}"))
        if types[f.name] in ("tinyint", "smallint", "int", "bigint"):
            value = F.round(value).cast(types[f.name])
        out += [value.alias(f.name), F.col(f"m{i}").alias(f"{f.name}_filled")]
    return joined.select(*out)


def _unknown(cells: DataFrame, column: int) -> bool:
    """Whether no record has a value in this cell column."""
    return cells.where(F.col("cells")[column].isNotNull()).limit(1).count() == 0
