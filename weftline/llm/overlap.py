"""Records of evaluation splits that also stand, exactly or almost, in the training split.

Both operators work on classes of exact copies, named by a 64-bit hash of their
content: pairs of classes are found, membership is kept aside, and ``expand``
turns class pairs into record pairs where a result needs them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.terms import _splitter
from weftline.runtime import materialize

#: Ratio of the class bounds of record sizes.
_CLASS_RATIO = 1.25


@dataclass
class Overlaps:
    """``pairs``: train_cls, eval_cls and scores. ``members``: cls, key, in_train, one row per record."""

    pairs: DataFrame
    members: DataFrame

    def expand(self) -> DataFrame:
        """Pairs of records (train_key, eval_key) with the scores of their classes."""
        train = self.members.where("in_train").select(F.col("cls").alias("train_cls"), F.col("key").alias("train_key"))
        held = self.members.where("not in_train").select(F.col("cls").alias("eval_cls"), F.col("key").alias("eval_key"))
        return self.pairs.join(train, "train_cls").join(held, "eval_cls")


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A second 64-bit hash of 64-bit hashes (multiply-xorshift)."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


class TermGrams:
    """Keys that two term sets of Jaccard similarity >= ``threshold`` must share.

    The terms of a record, put into a canonical order by their hash class, are
    cut into ``m`` word n-grams, one for each class; an n-gram is hashed as a
    whole. Two records of sizes a, b differ in at most
    (a + b)(1 - t)/(1 + t) terms, so with more classes than that at least one
    n-gram is equal in both. ``m`` depends on the size class of the training
    record; evaluation records give keys for each size class they can match.
    An empty n-gram selects nothing. ``spare`` classes beyond the bound make up
    for them: a record with at most so many empty n-grams has a filled one
    among the equal ones. The few records with more are "hollow"; they are
    matched on empty n-grams too, in key spaces of their own, so no pair is
    lost.
    """

    def __init__(self, threshold: float, min_terms: int, spare: int = 2) -> None:
        self.t, self.min_terms, self.spare = threshold, min_terms, spare

    def size_class(self, n: np.ndarray) -> np.ndarray:
        return np.floor(np.log(np.maximum(n, self.min_terms) / self.min_terms) / math.log(_CLASS_RATIO) + 1e-9).astype(np.int64)

    def parts(self, cls: np.ndarray) -> np.ndarray:
        largest = np.ceil(self.min_terms * _CLASS_RATIO ** (cls + 1)) + 1
        return np.floor(largest * (1 + 1 / self.t) * (1 - self.t) / (1 + self.t) + 1e-9).astype(np.int64) + 1 + self.spare

    def keys(self, h: np.ndarray, start: np.ndarray, n: np.ndarray, cls: np.ndarray, is_train: bool) -> tuple[np.ndarray, np.ndarray]:
        """Keys of records whose term hashes are h[start:start+n], and their number for each record."""
        m = self.parts(cls)
        owner = np.repeat(np.arange(len(n)), n)
        flat = h[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)]
        base = np.cumsum(m) - m
        slot = base[owner] + (_mix(flat, 3) % m[owner].astype(np.uint64)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        used, first = np.unique(slot[order], return_index=True)
        with np.errstate(over="ignore"):
            gram = np.add.reduceat(_mix(flat[order], 4), first) if len(first) else np.zeros(0, np.uint64)
        of_slot = np.repeat(np.arange(len(m)), m)
        place = ((cls[of_slot] << 20) + np.arange(m.sum()) - base[of_slot]).astype(np.uint64)  # size class and part
        slot_key = _mix(place, 5)
        slot_key[used] = _mix(gram ^ slot_key[used], 6)
        empty = np.ones(m.sum(), bool)
        empty[used] = False
        hollow = np.bincount(of_slot[empty], minlength=len(m)) > self.spare
        out_key, out_owner = [slot_key[used]], [of_slot[used]]
        for salt, only_hollow in ((7, not is_train), (8, is_train)):
            # 7: all training records against hollow evaluation records; 8: the reverse
            at = np.flatnonzero(empty & hollow[of_slot] if only_hollow else empty)
            out_key.append(_mix(slot_key[at], salt))
            out_owner.append(of_slot[at])
        key, own = np.concatenate(out_key), np.concatenate(out_owner)
        by_owner = np.argsort(own, kind="stable")
        return key[by_owner].view(np.int64), np.bincount(own, minlength=len(m))

    def rows(self, keys: pa.Array, texts: list, train: np.ndarray, split) -> pa.RecordBatch:
        sets = [list(set(split(t))) for t in texts]
        n = np.fromiter(map(len, sets), np.int64, len(sets))
        kept = np.flatnonzero(n >= self.min_terms)
        n, train = n[kept], train[kept]
        coded = pa.array([t for k in kept for t in sets[k]], pa.string()).dictionary_encode()
        ours = np.fromiter((xxhash.xxh64_intdigest(t) for t in coded.dictionary.to_pylist()), np.uint64)
        h = ours[coded.indices.to_numpy()] if len(kept) else np.zeros(0, np.uint64)
        start = np.cumsum(n) - n
        over = lambda f, x: f.reduceat(x, start) if len(kept) else np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            cls = (over(np.add, _mix(h, 1)) ^ n.astype(np.uint64)).view(np.int64)
            parity = over(np.bitwise_xor, np.uint64(1) << (_mix(h, 9) & np.uint64(63))).view(np.int64)
        own = self.size_class(n)
        least = np.where(train, own, self.size_class(np.ceil(n * self.t - 1e-9)))
        most = np.where(train, own, self.size_class(np.floor(n / self.t + 1e-9)))
        many = most - least + 1
        rec = np.repeat(np.arange(len(n)), many)
        size = np.repeat(least, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        grams, owner = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for side in (True, False):
            at = np.flatnonzero(train[rec] == side)
            if len(at):
                key, number = self.keys(h, start[rec[at]], n[rec[at]], size[at], side)
                grams.append(key)
                owner.append(np.repeat(rec[at], number))
        gram, own_of = np.concatenate(grams), np.concatenate(owner)
        ends = np.concatenate([[0], np.cumsum(np.bincount(own_of, minlength=len(n)))]).astype(np.int32)
        listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(gram[np.argsort(own_of, kind="stable")]))
        return pa.RecordBatch.from_arrays(
            [keys.take(pa.array(kept)), pa.array(cls), pa.array(parity), pa.array(n, pa.int32()), pa.array(train), listed], ["key", "cls", "parity", "n_terms", "in_train", "grams"]
        )


@F.pandas_udf(T.StructType([T.StructField(c, T.IntegerType()) for c in ("common", "train_terms", "eval_terms")]))
def _shared_terms(style: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
    split = _splitter(style.iloc[0]) if len(style) else None
    rows = [(len((x := set(split(s))) & (y := set(split(t)))), len(x), len(y)) for s, t in zip(a, b, strict=True)]
    return pd.DataFrame(rows, columns=["common", "train_terms", "eval_terms"])


def text_overlaps(
    records: DataFrame,
    key_col: str,
    text_col: str,
    split_col: str,
    style: str = "plain",
    threshold: float = 0.8,
    min_terms: int = 12,
    train: str = "train",
    hot_rows: int = 20_000,
) -> Overlaps:
    """Evaluation texts that share most of their distinct terms with a training text.

    Evaluation n-gram hashes (``TermGrams``) are partitioned with those of the
    training split; a hit counts if a 64-bit parity sketch of both term sets
    leaves the similarity possible, and is then verified on the whole texts:
    Jaccard similarity of the distinct terms >= ``threshold``. Each pair also
    gets the containment of the evaluation record in the training record.
    Grams found (on a sample, which only steers the physical plan) to be
    shared by over ``hot_rows`` records of either side are salted.

    Null keys, null splits, and texts of fewer than ``min_terms`` distinct
    terms (null and empty ones too) take no part; a repeated delivery counts
    once; every split but ``train`` is an evaluation split; an empty table
    gives no rows; other columns are ignored, whatever their names.
    """
    grams, split = TermGrams(threshold, min_terms), _splitter(style)
    key_type = records.schema[key_col].dataType.simpleString()
    source = records.select(F.col(key_col).alias("key"), F.col(text_col).cast("string").alias("text"), (F.col(split_col) == train).alias("in_train"))
    source = source.where("key is not null and text is not null and in_train is not null")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                b = batch.slice(i, 2000)
                yield grams.rows(b.column(0), b.column(1).to_pylist(), np.array(b.column(2).to_pylist(), bool), split)

    emitted = materialize(source.mapInArrow(emit, f"key {key_type}, cls long, parity long, n_terms int, in_train boolean, grams array<long>"), "overlap-grams")
    members = emitted.select("cls", "key", "in_train").distinct()
    rows = _without_hot_copies(emitted)
    hot = _hot_grams(rows, hot_rows)

    exploded = rows.select(F.explode("grams").alias("gram"), "cls", "parity", "n_terms", "in_train")
    n_hot = hot.count()
    if n_hot:
        # a hot gram becomes salts x salts buckets: each side keeps one coordinate and is repeated along the other
        salts = F.broadcast(hot) if n_hot <= 100_000 else hot
        own = F.pmod(F.xxhash64("cls"), "salts")
        across = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("salts"), F.lit(1)).cast("long") - 1))
        exploded = exploded.join(salts, "gram", "left").withColumn("other", across).withColumn("own", F.coalesce(own, F.lit(0)))
        bucket = F.when(F.col("in_train"), F.xxhash64("gram", "own", "other")).otherwise(F.xxhash64("gram", "other", "own"))
        exploded = exploded.withColumn("gram", F.when(F.col("salts").isNull(), F.col("gram")).otherwise(bucket)).drop("salts", "own", "other")
    per_term = (1 - threshold) / (1 + threshold)
    met = exploded.repartition("gram").sortWithinPartitions("gram").mapInArrow(lambda batches: _meet(batches, per_term), "train_cls long, eval_cls long")
    hits = materialize(met.distinct(), "overlap-hits")

    wanted = hits.select(F.explode(F.array("train_cls", "eval_cls")).alias("cls")).distinct()
    one_of = emitted.groupBy("cls").agg(F.min("key").alias("key"))
    texts = source.join(one_of.join(wanted, "cls").hint("merge"), "key").select("cls", "text").dropDuplicates(["cls"])
    a = texts.select(F.col("cls").alias("train_cls"), F.col("text").alias("train_text"))
    b = texts.select(F.col("cls").alias("eval_cls"), F.col("text").alias("eval_text"))
    judged = hits.join(a, "train_cls").join(b, "eval_cls").select("train_cls", "eval_cls", _shared_terms(F.lit(style), "train_text", "eval_text").alias("s"))
    scored = judged.select(
        "train_cls",
        "eval_cls",
        (F.col("s.common") / (F.col("s.train_terms") + F.col("s.eval_terms") - F.col("s.common"))).alias("similarity"),
        (F.col("s.common") / F.col("s.eval_terms")).alias("containment"),
    )
    return Overlaps(materialize(scored.where(F.col("similarity") >= threshold - 1e-12), "overlap-pairs"), members)


def _meet(batches: Iterator[pa.RecordBatch], per_term: float) -> Iterator[pa.RecordBatch]:
    """Pairs of one training and one evaluation class in a gram whose parity sketches allow the similarity.

    Rows come sorted by gram. A gram's rows may go over several batches; the
    last gram of a batch waits for the next one.
    """
    held: list[np.ndarray] | None = None

    def columns(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]

    def pairs(part: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        gram, cls, parity, n, train = part
        parity, n, train = parity.view(np.uint64), n.astype(np.float64), train.astype(bool)
        first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
        group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(gram)]))
        t_rows, e_rows = np.flatnonzero(train), np.flatnonzero(~train)
        n_t, n_e = (np.bincount(group[r], minlength=len(first)) for r in (t_rows, e_rows))
        t_at = np.cumsum(n_t) - n_t
        found: list[tuple[np.ndarray, np.ndarray]] = []
        large = (n_t * n_e > 4096) & (n_t > 16)
        # small grams: pairs are laid out flat, about two million at a time
        small = e_rows[(~large & (n_t > 0))[group[e_rows]]]
        many = n_t[group[small]]
        cut = np.searchsorted(np.cumsum(many), np.arange(2_000_000, many.sum() + 2_000_000, 2_000_000)) + 1 if len(small) else []
        for es, k in zip(np.split(small, cut), np.split(many, cut), strict=True):
            b = np.repeat(es, k)
            a = t_rows[np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(t_at[group[es]], k)]
            good = np.bitwise_count(parity[a] ^ parity[b]) <= np.floor((n[a] + n[b]) * per_term + 1e-9)
            found.append((a[good], b[good]))
        e_at = np.cumsum(n_e) - n_e
        for g in np.flatnonzero(large):
            ts, es = t_rows[t_at[g] : t_at[g] + n_t[g]], e_rows[e_at[g] : e_at[g] + n_e[g]]
            # all pairs of a size class pass the bound of its largest sizes or none does: exact bound only for these
            loose = np.uint8(min(255, int((n[ts].max() + n[es].max()) * per_term + 1e-9)))
            step = max(1, 500_000 // len(ts))
            for s in range(0, len(es), step):
                x, y = np.nonzero(np.bitwise_count(parity[es[s : s + step], None] ^ parity[ts][None]) <= loose)
                a, b = ts[y], es[s + x]
                good = np.bitwise_count(parity[a] ^ parity[b]) <= np.floor((n[a] + n[b]) * per_term + 1e-9)
                found.append((a[good], b[good]))
        if found:
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            if len(a):
                both = np.unique(np.stack([cls[a], cls[b]], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["train_cls", "eval_cls"])

    waiting = 0
    for batch in batches:
        part = columns(batch)
        if held is not None:
            part = [np.concatenate(x) for x in zip(held, part, strict=True)]
        if len(part[0]) < max(100_000, 2 * waiting):
            held = part
            continue
        end = np.searchsorted(part[0], part[0][-1])
        if end:
            yield from pairs([x[:end] for x in part])
        held = [x[end:] for x in part]
        waiting = len(held[0])
    if held is not None and len(held[0]):
        yield from pairs(held)


def _without_hot_copies(emitted: DataFrame) -> DataFrame:
    """Leaves one training and one evaluation record of each class that holds over a thousandth of all rows.

    There are at most 1000 such classes. Smaller classes may keep their
    copies: they meet again as one class after the join.
    """
    per = emitted.groupBy("cls", "in_train").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key"))
    total = emitted.count()
    hot = per.where(F.col("n") > max(100, total // 1000))
    found = hot.select("cls", "in_train", F.col("key").alias("kept")).collect()
    if not found:
        return emitted
    kept = F.broadcast(emitted.sparkSession.createDataFrame(found, hot.select("cls", "in_train", F.col("key").alias("kept")).schema))
    return emitted.join(kept, ["cls", "in_train"], "left").where("kept is null or kept = key").drop("kept")


def _hot_grams(rows: DataFrame, hot_rows: int, one_in: int = 50) -> DataFrame:
    """``gram, salts``: every gram that a fiftieth of the records shows to be frequent on either side."""
    few = rows.where(F.pmod(F.xxhash64("key"), F.lit(one_in)) == 0)
    counts = few.select(F.explode("grams").alias("gram"), F.col("in_train").cast("int").alias("t")).groupBy("gram").agg(F.greatest(F.sum("t"), F.sum(1 - F.col("t"))).alias("c"))
    hot = counts.where(F.col("c") * one_in > hot_rows)
    return materialize(hot.select("gram", F.ceil(F.col("c") * one_in / hot_rows).cast("int").alias("salts")), "overlap-hot")


def _norm_text(c: str) -> Column:
    return F.lower(F.trim(F.col(c).cast("string")))


def field_overlaps(
    records: DataFrame,
    key_col: str,
    split_col: str,
    equal: list[str],
    near: list[str],
    tolerance: float = 0.005,
    train: str = "train",
) -> Overlaps:
    """Evaluation rows whose fields equal those of a training row, numbers within a relative tolerance.

    Text fields in ``equal`` are compared without case and outer white space.
    ``near`` fields differ by at most ``tolerance`` of the larger value. A
    field null on either side is passed over, at most one such field per pair.
    The first two ``near`` fields, in logarithmic steps, take part in the
    candidate keys; a key exists for each field that may be passed over, so
    every pair meets in at least one key, and no key is only a popular
    combination of categories.

    Null keys and splits take no part, nor do rows with two or more null
    fields match any row that has a value in either; a repeated delivery
    counts once; an empty table gives no rows; other columns are ignored.
    """
    fields = [*(f"e{i}" for i in range(len(equal))), *(f"v{i}" for i in range(len(near)))]
    kinds = dict(records.dtypes)
    text = lambda c: _norm_text(c) if kinds[c] == "string" else F.col(c).cast("double")
    number = lambda c: F.when(F.isnan(F.col(c).cast("double")), None).otherwise(F.col(c).cast("double") + F.lit(0.0))
    base = records.where(F.col(key_col).isNotNull() & F.col(split_col).isNotNull()).select(
        F.col(key_col).alias("key"), (F.col(split_col) == train).alias("in_train"), *(text(c).alias(f) for c, f in zip(equal, fields, strict=False)), *(number(c).alias(f"v{i}") for i, c in enumerate(near))
    )
    base = materialize(base.withColumn("cls", F.xxhash64(*_coded(fields))), "overlap-fields")
    members = base.select("cls", "key", "in_train").distinct()
    classes = base.groupBy("cls").agg(F.max("in_train").alias("any_train"), F.min("in_train").alias("all_train"), *(F.first(f).alias(f) for f in fields))
    classes = materialize(classes, "overlap-classes")

    step = 4 * -math.log(1 - tolerance)
    anchors = ["v0", "v1"][: len(near)]
    keyed = [f for f in fields if f.startswith("e") or f in anchors]

    def bucket(f: str, shift: float) -> Column:
        size = F.floor((F.ln(F.abs(F.col(f))) + shift) / step)
        return F.when(F.col(f) == 0, F.lit("0")).when(F.col(f).isNotNull(), F.concat(F.signum(f).cast("int").cast("string"), F.lit(":"), size.cast("string")))

    def buckets(f: str, evaluating: bool) -> Column:
        if not evaluating:
            return F.array(bucket(f, 0.0))
        width = step / 4 * 1.01
        return F.array_distinct(F.array(bucket(f, -width), bucket(f, 0.0), bucket(f, width)))

    def keys(evaluating: bool) -> DataFrame:
        rows = classes.where("not all_train" if evaluating else "any_train")
        n_null = sum(F.col(f).isNull().cast("int") for f in keyed)
        skip = F.when(n_null == 0, F.array(*(F.lit(i) for i in range(-1, len(keyed))))).when(n_null == 1, F.array(sum(F.when(F.col(f).isNull(), i).otherwise(0) for i, f in enumerate(keyed))))
        rows = rows.select("cls", *keyed, (n_null == 1).alias("gap"), F.explode(skip).alias("skip"))
        for a in anchors:
            rows = rows.withColumn(f"b_{a}", F.explode(buckets(a, evaluating)))
        part = lambda i, f: F.when(F.col("skip") != i, F.col(f"b_{f}") if f in anchors else F.col(f).cast("string"))
        hashed = F.xxhash64("skip", *(F.coalesce(part(i, f), F.lit("~")) for i, f in enumerate(keyed)))
        side = "eval" if evaluating else "train"
        return rows.select(hashed.alias("k"), F.col("cls").alias(f"{side}_cls"), F.col("gap").alias(f"{side}_gap"), "skip").distinct()

    # a key with a field left out stands only for pairs that lack that field
    # merged, never broadcast: the planner does not see that the keys are exploded rows
    hits = keys(False).hint("merge").join(keys(True), ["k", "skip"]).where("skip = -1 or train_gap or eval_gap").select("train_cls", "eval_cls").distinct()
    a = classes.select(F.col("cls").alias("train_cls"), *(F.col(f).alias(f"a_{f}") for f in fields))
    b = classes.select(F.col("cls").alias("eval_cls"), *(F.col(f).alias(f"b_{f}") for f in fields))
    missing = sum((F.col(f"a_{f}").isNull() | F.col(f"b_{f}").isNull()).cast("int") for f in fields)
    alike = F.lit(True)
    for f in fields:
        x, y = F.col(f"a_{f}"), F.col(f"b_{f}")
        same = x == y if f.startswith("e") else F.abs(x - y) <= tolerance * F.greatest(F.abs(x), F.abs(y)) + 1e-12
        alike = alike & (x.isNull() | y.isNull() | same)
    judged = hits.join(a, "train_cls").join(b, "eval_cls").where((missing <= 1) & alike)
    pairs = judged.select("train_cls", "eval_cls", missing.alias("fields_passed_over"))
    return Overlaps(pairs, members)


def _coded(fields: list[str]) -> list[Column]:
    """Null is a value of its own in a hash."""
    return [F.coalesce(F.col(f).cast("string"), F.lit("\u0000null")) for f in fields]
