from collections import Counter

import pytest

from weftline.llm import mixing as M


def test_targets_hold_up_to_the_repetition_limit():
    p = M.plan({"a": 1000, "b": 100, "c": 0}, {"a": 1, "b": 2, "c": 9}, {"a": 0.5, "b": 0.4, "c": 0.1}, total="met")
    assert p.exponent == 1 and p.budgets["b"] == pytest.approx(200) and p.budgets["a"] == pytest.approx(250) and "c" not in p.budgets


def test_a_larger_total_moves_the_exponent():
    p = M.plan({"a": 1000, "b": 100}, {"a": 1, "b": 2}, {"a": 0.5, "b": 0.5}, total=900)
    assert 0 < p.exponent < 1 and p.budgets["b"] == pytest.approx(200, rel=1e-6) and sum(p.budgets.values()) == pytest.approx(900)
    assert M.plan({"a": 1000, "b": 100}, {"a": 1, "b": 2}, {"a": 0.5, "b": 0.5}).budgets == pytest.approx({"a": 900, "b": 200})
    full = M.plan({"a": 100, "b": 100}, {"a": 1, "b": 1}, {"a": 0.9, "b": 0.1}, total=10_000)
    assert full.budgets == pytest.approx({"a": 100, "b": 100})


def test_sources_beside_the_limited_ones_keep_the_proportions_of_their_targets():
    sizes = {"a": 5000, "b": 3000, "c": 100, "d": 40}
    targets = {"a": 0.3, "b": 0.3, "c": 0.2, "d": 0.2}
    p = M.plan(sizes, {"a": 2, "b": 2, "c": 4, "d": 3}, targets)
    assert sum(p.budgets.values()) == pytest.approx(sum(sizes.values()))
    assert p.budgets["c"] == pytest.approx(400, rel=1e-5) and p.budgets["d"] == pytest.approx(120, rel=1e-5)
    assert p.budgets["a"] == pytest.approx(p.budgets["b"]) and p.exponents["a"] == 1
    assert 0 < p.exponents["d"] < 1 and 0 < p.exponents["c"] < 1 and p.exponent == min(p.exponents.values())


def test_entropy_is_met():
    sizes = {"a": 900, "b": 90, "c": 10}
    want = 0.8
    p = M.plan(sizes, dict.fromkeys(sizes, 50), target_entropy=want)
    total = sum(p.budgets.values())
    assert M.entropy({s: b / total for s, b in p.budgets.items()}) == pytest.approx(want, abs=1e-6) and 0 < p.exponent < 1
    assert M.plan({}, {}, {"a": 1.0}).budgets == {}


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, 2.0) for r in rows], "key long, source string, n_tokens long, pass int, place double")


def test_mix(spark):
    rows = [(i, "big", 10) for i in range(2000)] + [(5000 + i, "small", 7) for i in range(30)] + [(9000, "unlisted", 50), (9001, None, 5), (None, "big", 3), (9002, "big", 0)]
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 4), ("gone", 0.1, 2), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    drawn, report = M.mix(docs(spark, rows + rows[:3]), targets, "met")
    got = drawn.collect()
    per = Counter((r.key, r.source) for r in got)
    assert max(n for (_, s), n in per.items() if s == "big") == 1 and max(per.values()) <= 4
    assert len({(r.key, r["pass"]) for r in got}) == len(got)
    out = {r.source: r for r in report.collect()}
    assert set(out) == {"big", "small", "gone"}
    assert out["small"].most_repeats == 4 and out["small"].actual_share == pytest.approx(1 / 3, abs=0.02)
    assert out["gone"].actual_share == 0 and not out["gone"].met
    assert sum(r.n_tokens for r in got) == sum(r.drawn_tokens for r in out.values())


def test_shares_of_the_whole_stock(spark):
    rows = [(i, "big", 10) for i in range(2000)] + [(5000 + i, "small", 7) for i in range(30)] + [(7000 + i, "mid", 10) for i in range(900)]
    targets = spark.createDataFrame([("big", 0.4, 1), ("small", 0.3, 4), ("mid", 0.3, 2)], "source string, target_share double, max_repeats int")
    drawn, report = M.mix(docs(spark, rows), targets)
    out = {r.source: r for r in report.collect()}
    assert out["small"].drawn_tokens == 840 and not out["small"].met and 0 < out["small"].exponent < 1
    assert out["big"].drawn_tokens / out["mid"].drawn_tokens == pytest.approx(4 / 3, rel=0.01) and out["mid"].exponent == 1
    again = Counter()
    for r in drawn.collect():
        again[r.source] += r.n_tokens
    assert {s: r.drawn_tokens for s, r in out.items()} == dict(again)
    assert sum(again.values()) == pytest.approx(sum(n for *_, n in rows), rel=0.01)
    with pytest.raises(ValueError):
        M.mix(docs(spark, rows), targets, most_sources=2)


def test_mix_of_nothing(spark):
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    drawn, report = M.mix(docs(spark, []), targets)
    assert drawn.count() == 0 and report.first().actual_share == 0
    drawn, report = M.mix(docs(spark, [(1, "a", 5)]), targets.limit(0))
    assert drawn.count() == 0 and report.count() == 0


def test_budgets_are_never_passed(spark):
    rows = [(i, "a", 1 + i % 9) for i in range(500)]
    for budget in (0.0, 3.0, 777.0, 2500.0, 6001.0):
        got = M.draw(docs(spark, rows).select("key", "source", "n_tokens"), {"a": budget}, block_rows=50).collect()
        total = sum(r.n_tokens for r in got)
        assert total <= budget and total >= budget - 60
