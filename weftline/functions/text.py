"""Text expressions: tokens, counts, TF-IDF, formatting, dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PUNCTUATION = r"\p{Punct}"  # the 32 ASCII marks


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def without_punctuation(c: str | Column) -> Column:
    return F.regexp_replace(col(c), PUNCTUATION, "")


def white_space_tokens(c: str | Column) -> Column:
    """Pieces between runs of white space; an empty text has none."""
    return F.filter(F.split(col(c), r"\s+"), lambda t: t != "")


def word_tokens(c: str | Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.filter(F.split(F.lower(col(c)), r"[^\p{L}\p{N}_]+"), lambda t: t != "")


def occurrences(tokens: Column, word: str) -> Column:
    """How often a word stands among tokens."""
    return F.size(F.filter(tokens, lambda t: t == word))


def sliced(c: str | Column, start: int | None = None, stop: int | None = None, step: int = 1) -> Column:
    """Characters start..stop-1 in steps, with negative positions from the end, as in a slice."""
    c = col(c)
    n = F.length(c)

    def place(v: int | None, default: Column) -> Column:
        if v is None:
            return default
        return F.greatest(F.lit(-1 if step < 0 else 0), F.least(n + v if v < 0 else F.lit(v), n - 1 if step < 0 else n))

    if step == 1:
        a, b = place(start, F.lit(0)), place(stop, n)
        return F.substring(c, a + 1, F.greatest(b - a, F.lit(0)))
    a = place(start, n - 1 if step < 0 else F.lit(0))
    b = place(stop, F.lit(-1) if step < 0 else n)
    last = b + 1 if step < 0 else b - 1
    some = a >= last if step < 0 else a <= last
    return F.when(some & (n > 0), F.array_join(F.transform(F.sequence(a, last, F.lit(step)), lambda i: F.substring(c, i + 1, F.lit(1))), "")).otherwise(F.when(c.isNotNull(), F.lit("")))


def word_counts(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """Long counts: key, term, n."""
    return df.select(key, F.explode(tokens).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))


def word_count_map(tokens: Column) -> Column:
    """Bag of words of one row, without a shuffle."""
    words = F.array_distinct(tokens)
    return F.map_from_arrays(words, F.transform(words, lambda w: F.size(F.filter(tokens, lambda t: t == w))))


def without_words(bag: str | Column, words: list[str]) -> Column:
    """A bag without stop words."""
    return F.map_filter(col(bag), lambda k, _: ~k.isin(words))


def top_entries(bag: str | Column, k: int) -> Column:
    """The k entries of greatest value, ties by key, as an array of (key, value)."""
    entries = F.transform(F.map_entries(col(bag)), lambda e: F.struct((-e["value"]).alias("neg"), e["key"].alias("key"), e["value"].alias("value")))
    return F.transform(F.slice(F.array_sort(entries), 1, k), lambda e: F.struct(e["key"], e["value"]))


def tf_idf(counts: DataFrame, key: str) -> DataFrame:
    """n ln(N / df) of long counts (key, term, n); N is the number of keys with terms."""
    n_docs = counts.agg(F.count_distinct(key).alias("n_docs"))
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return counts.join(df, "term").crossJoin(F.broadcast(n_docs)).select(key, "term", (F.col("n") * F.ln(F.col("n_docs") / F.col("df"))).alias("tf_idf"))


def cosine_of_sparse(weights: DataFrame, key: str, a, b) -> DataFrame:
    """Cosine similarity of two rows of long weights (key, term, w)."""
    x, y = weights.where(F.col(key) == a), weights.where(F.col(key) == b)
    dot = x.select("term", F.col("w").alias("x")).join(y.select("term", F.col("w").alias("y")), "term").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0.0)).alias("d"))
    norms = x.agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("nx")).crossJoin(y.agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("ny")))
    return dot.crossJoin(norms).select((F.col("d") / F.nullif(F.col("nx") * F.col("ny"), F.lit(0.0))).alias("cosine"))


def padded(c: str | Column, width: int) -> Column:
    """Zero-padded text of a number."""
    return F.lpad(col(c).cast("string"), width, "0")


def recycled(values: Column, i: Column) -> Column:
    """The i-th value (from 0) of an array that starts again at its end."""
    return F.element_at(values, (F.pmod(i, F.size(values)) + 1).cast("int"))


def c_time(ts: Column) -> Column:
    return F.date_format(ts, "EEE MMM d HH:mm:ss yyyy")
