import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import terms as T
from weftline.llm.burst_trie import BurstTrie
from weftline.llm.tokens import edge_stripped_terms

SHAPE = "id long, text string, bag map<string,int>, term string, records int, key int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 7, 8) for r in rows], SHAPE)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(alphabet="abc", max_size=6), max_size=200), st.integers(1, 5))
def test_trie_counts_like_a_counter(words, burst):
    trie = BurstTrie(burst)
    for w in words:
        trie.add(w, 1, 2)
    got = {p + s: v for p, c in trie.leaves() for s, v in c.items()}
    assert got == {w: [n, 2 * n] for w, n in Counter(words).items()}
    assert all(len(c) <= burst or "" in c and len(c) <= burst + 1 for _, c in trie.leaves())


@pytest.mark.parametrize("limits", [{}, {"burst_at": 2, "subtree_terms": 3}])
def test_counts_with_nulls_blanks_bags_and_long_texts(spark, limits):
    rows = [
        (1, "The cat, the (hat)!", None),
        (2, None, {"The,": 2, "cat": 1, "...": 4, "dog": None}),
        (3, "   ", None),
        (4, "", {}),
        (5, "cat " * 50_000 + "x" * 100_000, None),
        (6, "the cat", {"ignored": 9}),
    ]
    out = {r.term: (r.occurrences, r.records, r.mark) for r in T.count_terms(frame(spark, rows), "text", "edge_stripped", bag_col="bag", **limits).collect()}
    assert out["the"] == (5, 3, "common") and out["cat"] == (50_003, 4, "common")
    assert out["hat"] == (1, 1, "rare") and out["x" * 100_000] == (1, 1, "rare")
    assert set(out) == {"the", "cat", "hat", "x" * 100_000}


def test_counts_of_nothing(spark):
    assert T.count_terms(frame(spark, []), "text").count() == 0
    assert T.count_terms(frame(spark, [(1, None, None)]), "text").count() == 0
    assert T.distinctive_terms(frame(spark, []), "id", "text").count() == 0


def test_repeated_rows_are_records_of_their_own(spark):
    out = T.count_terms(frame(spark, [(1, "a", None), (1, "a", None)]), "text").collect()
    assert [(r.term, r.records) for r in out] == [("a", 2)]


def exact_tail(k, n, of_term, total):
    pick = lambda a, b: math.comb(a, b)
    return sum(pick(of_term, j) * pick(total - of_term, n - j) for j in range(k, min(n, of_term) + 1)) / pick(total, n)


def test_tail_is_exact():
    cases = [(k, n, K, N) for N in (10, 60, 200) for K in (1, 3, N // 2, N) for n in (1, 5, N // 3, N) for k in range(0, min(n, K) + 1)]
    got = T.log_upper_tail(*(np.array(c) for c in zip(*cases, strict=True)))
    want = [math.log(exact_tail(*c)) for c in cases]
    assert np.allclose(got, want, rtol=1e-7, atol=1e-9)


def test_log_gamma():
    x = np.r_[np.linspace(1, 60, 300), 1e3, 1e7]
    assert np.allclose(T.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-10)


def test_scores_rank_what_is_characteristic(spark):
    rows = [(i, "the of and " * 3 + f"name{i} name{i} town", None) for i in range(30)]
    rows += [(99, None, None), (None, "a b", None)]
    out = T.distinctive_terms(frame(spark, rows), "id", "text", bag_col="bag").collect()
    assert {r.id for r in out} == set(range(30))
    mine = {r.term: r for r in out if r.id == 3}
    assert mine["name3"].score == max(r.score for r in mine.values()) > mine["the"].score
    # Benjamini-Hochberg by hand
    p = sorted(10**r.log10_p for r in mine.values())
    q = [min(p[j] * len(p) / (j + 1) for j in range(i, len(p))) for i in range(len(p))]
    assert sorted(r.score for r in mine.values()) == pytest.approx(sorted(max(0.0, -math.log10(v)) for v in q), abs=1e-9)


def test_edge_marks():
    assert edge_stripped_terms("(Hello), it's \"so.\" ... a-b") == ["hello", "it's", "so", "a-b"]
