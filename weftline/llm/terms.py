"""Term statistics: distributed burst-trie counting and hypergeometric distinctiveness."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weftline.llm.burst_trie import BurstTrie
from weftline.llm.tokens import counts_from_map, edge_stripped_terms, plain_terms
from weftline.runtime import materialize

_CONTAINER = "prefix string, suffixes array<string>, occurrences array<long>, records array<long>, with_terms long"


def _splitter(style: str):
    return {"edge_stripped": edge_stripped_terms, "plain": plain_terms}[style]


def count_terms(
    records: DataFrame,
    text_col: str,
    style: str = "plain",
    bag_col: str | None = None,
    rare_at_most: int = 1,
    common_share: float = 0.53,
    burst_at: int = 512,
    subtree_terms: int = 50_000,
) -> DataFrame:
    """Occurrences and records of every distinct term.

    Each task accumulates a burst trie over its records and sends only its
    leaf containers. Terms are then routed by adaptive prefixes: one character,
    or one more than the longest prefix that holds over ``subtree_terms``
    entries, so no merge task receives an unbounded subtree. Matching subtrees
    meet in one task and are merged there.

    ``records`` holds one row per record. Null or blank texts give no terms
    (``bag_col``, a map of counts, is used where the text has none); repeated
    rows count as separate records; an empty table gives no rows. ``mark`` is
    'rare' for terms in at most ``rare_at_most`` records, 'common' for those in
    over ``common_share`` of the records that have terms ('common' wins), else
    null. Other columns of ``records`` are ignored, whatever their names.

    Returns ``term, occurrences, records, mark``.
    """
    split = _splitter(style)
    has_bag = bag_col is not None
    cols = [F.col(text_col).cast("string").alias("text")]
    if has_bag:
        # the map crosses to Python only where the text gives nothing
        blank = F.col(text_col).isNull() | ~F.col(text_col).rlike(r"\S")
        cols.append(F.when(blank, F.map_entries(bag_col)).alias("bag"))

    def accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, with_terms = BurstTrie(burst_at), 0
        for batch in batches:
            occ: Counter = Counter()
            rec: Counter = Counter()
            bags = batch.column(1).to_pylist() if has_bag else None
            for k, text in enumerate(batch.column(0).to_pylist()):
                terms = split(text)
                if terms:
                    with_terms += 1
                    occ.update(terms)
                    rec.update(set(terms))
                elif bags and bags[k]:
                    bag = counts_from_map((e["key"], e["value"]) for e in bags[k])
                    with_terms += bool(bag)
                    occ.update(bag)
                    rec.update(bag.keys())
            for term, n in occ.items():
                trie.add(term, n, rec[term])
        rows = [(p, list(c), [v[0] for v in c.values()], [v[1] for v in c.values()], 0) for p, c in trie.leaves()]
        rows.append((None, [], [], [], with_terms))
        yield _containers(rows)

    sent = materialize(records.select(*cols).mapInArrow(accumulate, _CONTAINER), "containers")
    routes = _heavy_prefixes(sent, subtree_terms)
    total = sent.agg(F.coalesce(F.sum("with_terms"), F.lit(0)).alias("n_records"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for prefix, suffixes, occ, rec in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                parts: dict[str, tuple[list, list, list]] = {}
                for s, o, r in zip(suffixes, occ, rec, strict=True):
                    term = prefix + s
                    depth = 1
                    while depth < len(term) and term[:depth] in routes:
                        depth += 1
                    part = parts.setdefault(term[:depth], ([], [], []))
                    part[0].append(term)
                    part[1].append(o)
                    part[2].append(r)
                rows.extend((k, *v, 0) for k, v in parts.items())
            if rows:
                yield _containers(rows)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[str, BurstTrie] = {}
        for batch in batches:
            for key, terms, occ, rec in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                trie = tries.setdefault(key, BurstTrie(burst_at))
                for t, o, r in zip(terms, occ, rec, strict=True):
                    trie.add(t[len(key) :], o, r)
        for key, trie in tries.items():
            rows = [(key + p + s, v[0], v[1]) for p, c in trie.leaves() for s, v in c.items()]
            for i in range(0, len(rows), 20_000):
                t, o, r = zip(*rows[i : i + 20_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(t, pa.string()), pa.array(o, pa.int64()), pa.array(r, pa.int64())], ["term", "occurrences", "records"])

    routed = sent.where("prefix is not null").mapInArrow(route, _CONTAINER).repartition("prefix")
    counts = routed.mapInArrow(merge, "term string, occurrences long, records long")
    mark = F.when(F.col("records") > common_share * F.col("n_records"), "common").when(F.col("records") <= rare_at_most, "rare")
    return counts.crossJoin(F.broadcast(total)).select("term", "occurrences", "records", mark.alias("mark"))


def _containers(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()]
    names = ["prefix", "suffixes", "occurrences", "records", "with_terms"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _heavy_prefixes(sent: DataFrame, subtree_terms: int, longest: int = 64) -> frozenset[str]:
    """Prefixes that hold over ``subtree_terms`` entries.

    At most entries / ``subtree_terms`` prefixes of each length exist, whatever
    the data, so the driver's share is small: with 10^9 distinct entries and
    the default, 20,000 strings a length.
    """
    heavy: set[str] = set()
    entries = sent.where("prefix is not null").select("prefix", F.size("suffixes").alias("n"))
    for depth in range(1, longest):
        at = entries.where(F.length("prefix") >= depth).groupBy(F.substring("prefix", 1, depth).alias("p"))
        found = [r.p for r in at.agg(F.sum("n").alias("n")).where(F.col("n") > subtree_terms).select("p").collect()]
        if not found:
            break
        heavy.update(found)
    return frozenset(heavy)


# --- distinctiveness -------------------------------------------------------------------------

_LANCZOS = (  # fixed values: Lanczos coefficients, g = 7, n = 9
    0.99999999999980993,
    676.5203681218851,
    -1259.1392167224028,
    771.32342877765313,
    -176.61502916214059,
    12.507343278686905,
    -0.13857109526572012,
    9.9843695780195716e-6,
    1.5056327351493116e-7,
)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma(x) for x >= 1, elementwise (Stirling's series above 20, Lanczos below)."""
    x = np.asarray(x, float)
    big = np.maximum(x, 20.0)
    series = (big - 0.5) * np.log(big) - big + 0.9189385332046727 + 1 / (12 * big) - 1 / (360 * big**3) + 1 / (1260 * big**5)
    small = np.minimum(x, 20.0) - 1
    total = np.full_like(small, _LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        total += c / (small + i)
    t = small + 7.5
    lanczos = 0.9189385332046727 + (small + 0.5) * np.log(t) - t + np.log(total)
    return np.where(x >= 20, series, lanczos)


def log_upper_tail(k: np.ndarray, n: np.ndarray, of_term: np.ndarray, total: np.ndarray) -> np.ndarray:
    """ln P(X >= k), X hypergeometric: n draws from ``total`` tokens of which ``of_term`` are the term.

    The whole tail is summed: upward from k where k is over the mean, else as
    the complement of the terms below k. A series ends when its next term no
    longer changes a double.
    """
    k, n, of_term, total = (np.asarray(a, float) for a in (k, n, of_term, total))
    top = np.minimum(n, of_term)

    def log_pmf(j):
        lc = lambda a, b: log_gamma(a + 1) - log_gamma(b + 1) - log_gamma(a - b + 1)
        return lc(of_term, j) + lc(total - of_term, n - j) - lc(total, n)

    low = np.maximum(0.0, n + of_term - total)
    upward = k > n * of_term / total
    start = np.where(upward, k, k - 1)
    safe = np.clip(start, low, top)
    first = log_pmf(safe)
    ratio_sum, term, j = np.ones_like(k), np.ones_like(k), safe.copy()
    active = (start >= low) & (start <= top)
    while active.any():
        # finished rows may step outside the support; their terms are masked
        up = (of_term - j) * (n - j) / (np.maximum(j + 1, 1) * np.maximum(total - of_term - n + j + 1, 1))
        down = j * (total - of_term - n + j) / np.maximum((of_term - j + 1) * (n - j + 1), 1)
        term = np.where(active, term * np.where(upward, up, down), 0.0)
        j = j + np.where(upward, 1, -1)
        active &= (term > ratio_sum * 1e-17) & (j >= low) & (j <= top)
        ratio_sum = ratio_sum + np.where(active, term, 0.0)
    part = first + np.log(ratio_sum)
    below = np.where(start < low, -np.inf, part)
    tail = np.where(upward, np.where(k > top, -np.inf, part), np.log1p(-np.exp(np.minimum(below, -1e-16))))
    return np.minimum(np.where(k <= low, 0.0, tail), 0.0)


@F.pandas_udf(T.DoubleType())
def _tail_udf(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for k, n, of_term, total in parts:
        yield pd.Series(log_upper_tail(k.to_numpy(), n.to_numpy(), of_term.to_numpy(), total.to_numpy()))


def distinctive_terms(records: DataFrame, key_col: str, text_col: str, style: str = "edge_stripped", bag_col: str | None = None) -> DataFrame:
    """Score of every term of every record by hypergeometric enrichment.

    The record is ``n_terms`` draws from all term occurrences of the
    collection; the probability that it holds the term at least as often as it
    does is summed exactly. Within a record the probabilities are adjusted for
    the false-discovery rate (Benjamini-Hochberg); ``score`` is the negative
    decimal logarithm of the adjusted probability.

    ``records`` holds one row per key. Null keys and records without any term
    give no rows; an empty table gives none; ties in probability share the
    same adjusted value; other columns are ignored, whatever their names.

    Returns ``<key>, term, in_record, n_terms, in_collection, n_records, log10_p, score``.
    """
    split = _splitter(style)
    has_bag = bag_col is not None
    cols = [F.col(key_col).alias("key"), F.col(text_col).cast("string").alias("text")]
    if has_bag:
        blank = F.col(text_col).isNull() | ~F.col(text_col).rlike(r"\S")
        cols.append(F.when(blank, F.map_entries(bag_col)).alias("bag"))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                given = piece.column(2).to_pylist() if has_bag else None
                at, terms, counts, sizes = [], [], [], []
                for i, text in enumerate(piece.column(1).to_pylist()):
                    bag = Counter(split(text))
                    if not bag and given and given[i]:
                        bag = counts_from_map((e["key"], e["value"]) for e in given[i])
                    at.extend([i] * len(bag))
                    terms.extend(bag)
                    counts.extend(bag.values())
                    sizes.extend([sum(bag.values())] * len(bag))
                keys = piece.column(0).take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, pa.array(terms, pa.string()), pa.array(counts, pa.int32()), pa.array(sizes, pa.int32())], ["key", "term", "in_record", "n_terms"])

    key_type = records.schema[key_col].dataType.simpleString()
    held = records.where(F.col(key_col).isNotNull()).select(*cols)
    long = materialize(held.mapInArrow(bags, f"key {key_type}, term string, in_record int, n_terms int"), "record-terms")
    per_term = long.groupBy("term").agg(F.sum("in_record").alias("in_collection"), F.count(F.lit(1)).alias("n_records"))
    total = long.agg(F.coalesce(F.sum("in_record"), F.lit(0)).alias("total"))
    log_p = _tail_udf("in_record", "n_terms", "in_collection", "total") / float(np.log(10))
    tested = long.join(per_term, "term").crossJoin(F.broadcast(total)).withColumn("log10_p", log_p)
    by_key = Window.partitionBy("key")
    ordered = by_key.orderBy("log10_p")
    ranked = tested.select(
        "*", (F.col("log10_p") + F.log10(F.count(F.lit(1)).over(by_key)) - F.log10(F.count(F.lit(1)).over(ordered.rangeBetween(Window.unboundedPreceding, 0)))).alias("step")
    )
    # the adjusted value is the least step at or after the rank: a running minimum from the largest probability down
    adjusted = F.min("step").over(ordered.rangeBetween(0, Window.unboundedFollowing))
    score = F.greatest(F.lit(0.0), -adjusted)
    return ranked.select(F.col("key").alias(key_col), "term", "in_record", "n_terms", "in_collection", "n_records", "log10_p", score.alias("score"))
