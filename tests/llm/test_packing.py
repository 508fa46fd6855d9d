from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import packing as P
from weftline.llm import sizes


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=12), st.integers(0, 60))
def test_fullest_is_optimal(stock, room):
    sums = {0}
    for s in stock:
        sums |= {x + s for x in sums if x + s <= room}
    counts = Counter(stock)
    got = P.fullest(counts, sorted(counts, reverse=True), room)
    assert sum(got) == max(sums) and not Counter(got) - counts


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=80))
def test_every_item_is_packed_once_within_capacity(items):
    where = P.minimum_bin_slack(np.array(items, int), 50)
    load = np.bincount(where, weights=items, minlength=1) if items else np.zeros(1)
    assert len(where) == len(items) and load.max() <= 50


def frames(spark, items, specs):
    return spark.createDataFrame([(k, n, "x", 1) for k, n in items], "key long, n_tokens long, spec string, piece int"), spark.createDataFrame(specs, "spec string, capacity int")


@pytest.mark.parametrize("block", [20_000, 20])
def test_pack(spark, block):
    rng = np.random.default_rng(0)
    items = [(i, int(n)) for i, n in enumerate(rng.integers(0, 120, 300))] + [(900, 1000), (901, 200), (None, 5), (902, None), (903, -4), (904, 100)]
    a, b = frames(spark, items, [("s", 100), ("m", 256), ("none", None), (None, 5), ("bad", 0)])
    rows = P.pack(a, b, block).collect()
    sizes_of = {k: n for k, n in items if k is not None and n is not None and n >= 0}
    for spec, capacity in (("s", 100), ("m", 256)):
        mine = [r for r in rows if r.spec == spec]
        per, load = defaultdict(list), Counter()
        for r in mine:
            per[r.key].append((r.start_token, r.n_tokens))
            load[r.container] += r.n_tokens
        assert max(load.values()) <= capacity and set(per) == set(sizes_of)
        for k, parts in per.items():
            parts.sort()
            assert sum(n for _, n in parts) == sizes_of[k] and all(s + n == t for (s, n), (t, _) in zip(parts, parts[1:], strict=False))
            assert len(parts) == max(1, -(-sizes_of[k] // capacity))
        if block > 1000:
            assert sum(v > 0 for v in load.values()) <= 1.02 * sum(sizes_of.values()) / capacity + 1
    assert {r.spec for r in rows} == {"s", "m"}


def test_pack_of_nothing(spark):
    a, b = frames(spark, [], [("s", 10)])
    assert P.pack(a, b).count() == 0
    a, b = frames(spark, [(1, 5)], [])
    assert P.pack(a, b).count() == 0


def test_sizes(spark):
    df = spark.createDataFrame([(1, "hello world", "s"), (2, None, "s"), (3, "", "s"), (None, "x", "s"), (4, "<|endoftext|>", "s"), (5, "a" * 50_000, "t")], "id long, text string, source string")
    got = {r.key: r.n_tokens for r in sizes.with_sizes(df, "id", "text", sizes.vocabulary(), "source").collect()}
    enc = sizes.encoding(sizes.vocabulary())
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] == len(enc.encode_ordinary("<|endoftext|>")) and set(got) == {1, 2, 3, 4, 5}
    assert enc.decode(enc.encode_ordinary("naïve 日本 \n x")) == "naïve 日本 \n x"
