"""Mixing sources to target shares, by temperature and budgeted block permutations."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.runtime import materialize


def tempered(shares: dict[str, float], exponent: float, targets: dict[str, float] | None = None) -> dict[str, float]:
    """Weights p^(1-x) t^x, normalised; without targets p^x."""
    logs = {}
    for s, p in shares.items():
        if p <= 0 or (targets is not None and targets.get(s, 0.0) <= 0):
            continue
        logs[s] = exponent * math.log(p) if targets is None else (1 - exponent) * math.log(p) + exponent * math.log(targets[s])
    top = max(logs.values(), default=0.0)
    raw = {s: math.exp(v - top) for s, v in logs.items()}
    total = sum(raw.values())
    return {s: v / total for s, v in raw.items()}


def entropy(weights: dict[str, float]) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def bisect(holds, low: float, high: float, steps: int = 60) -> float:
    """Greatest x in [low, high] for which ``holds``, given that it holds up to some x and at ``low``."""
    if holds(high):
        return high
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (middle, high) if holds(middle) else (low, middle)
    return low


@dataclass
class Plan:
    """Budget in tokens for each source, the exponent found, the total aimed at, and the exponent at which each source stands."""

    budgets: dict[str, float]
    exponent: float
    total: float
    exponents: dict[str, float] = field(default_factory=dict)


def plan(sizes: dict[str, int], max_repeats: dict[str, int], targets: dict[str, float] | None = None, total: float | str | None = None, target_entropy: float | None = None) -> Plan:
    """Budgets of sources of the given sizes.

    ``total`` defaults to all tokens of the sources. With ``targets``, the exponent goes from the sources' own shares (0) to
    the targets (1) and is bisected to the greatest at which no source is
    repeated more than ``max_repeats`` times. The sources that stand at their
    limit there keep that budget, and for the others the exponent is bisected
    again over what is left of the total, until it reaches 1: these get
    shares in proportion to their targets. With ``total`` "met" the largest
    total is taken at which all targets hold. Without ``targets``
    the shares are raised to an exponent, bisected to reach
    ``target_entropy`` (a smaller exponent is flatter) within the limit.
    Sources without tokens or target get nothing; the targets of the others are normalised.
    """
    sizes = {s: n for s, n in sizes.items() if n > 0 and (targets is None or targets.get(s, 0) > 0) and max_repeats.get(s, 1) > 0}
    if not sizes:
        return Plan({}, 1.0, 0.0)
    everything = sum(sizes.values())
    shares = {s: n / everything for s, n in sizes.items()}
    room = {s: n * max_repeats.get(s, 1) for s, n in sizes.items()}
    if targets is not None:
        wanted = tempered(shares, 1.0, targets)
        total = min(room[s] / wanted[s] for s in wanted) if total == "met" else min(everything if total is None else total, sum(room.values()))
        return _at_limits(shares, room, targets, total)
    else:
        total = everything if total is None else min(total, sum(room.values()))
        fits = lambda y: all(w * total <= room[s] * (1 + 1e-12) for s, w in tempered(shares, 1 - y).items()) and (target_entropy is None or entropy(tempered(shares, 1 - y)) <= target_entropy)
        x = 1 - bisect(fits, 0.0, 1.0)
        weights = tempered(shares, x)
    budgets = {s: min(w * total, room[s]) for s, w in weights.items()}
    # a total beyond what the weights can give (limits reached at every exponent) is filled where room is left
    for _ in range(len(budgets)):
        short = total - sum(budgets.values())
        open_ = {s: w for s, w in weights.items() if budgets[s] < room[s] * (1 - 1e-12)}
        if short <= 1e-6 * total or not open_:
            break
        for s, w in open_.items():
            budgets[s] = min(room[s], budgets[s] + short * w / sum(open_.values()))
    return Plan(budgets, x, total)


def _at_limits(shares: dict[str, float], room: dict[str, float], targets: dict[str, float], total: float) -> Plan:
    budgets: dict[str, float] = {}
    exponents: dict[str, float] = {}
    first, low = None, 0.0
    while open_ := {s: p for s, p in shares.items() if s not in budgets}:
        left = max(total - sum(budgets.values()), 0.0)
        fits = lambda x: all(w * left <= room[s] * (1 + 1e-9) for s, w in tempered(open_, x, targets).items())  # noqa: B023, E731
        x = bisect(fits, low, 1.0) if fits(low) else low
        first, low = x if first is None else first, x
        weights = tempered(open_, x, targets)
        # at an exponent below 1 some source has reached its limit: the ones that a little more would take beyond it
        bound = [s for s, w in weights.items() if w * left >= room[s] * (1 - 1e-6)] if x < 1 else list(weights)
        bound = bound or [max(weights, key=lambda s: weights[s] * left / room[s])]  # noqa: B023
        for s in bound:
            budgets[s], exponents[s] = min(weights[s] * left, room[s]), x
    return Plan({s: budgets[s] for s in shares}, first if first is not None else 1.0, total, exponents)


def draw(documents: DataFrame, budgets: dict[str, float], seed: int = 17, block_rows: int = 5_000) -> DataFrame:
    """Draws ``documents`` (key, source, n_tokens) up to each source's budget.

    Whole passes over a source come first; the last pass takes a random
    permutation of the source's blocks (by hash) while they fit, and of the
    block at the edge the documents, in hash order, while they fit. Only block sums reach the
    driver, and only edge blocks are ordered. Documents without tokens are
    drawn with their blocks. Null keys or sources take no part.

    Returns ``key, source, pass, n_tokens, place`` with one row per draw; sorting by
    (``pass``, ``place``) gives a shuffled order of all sources.
    """
    spark = documents.sparkSession
    rows = documents.where(F.col("key").isNotNull() & F.col("source").isin(list(budgets))).select("key", "source", "n_tokens")
    per = {r.source: (r.rows, r.tokens) for r in rows.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_tokens").alias("tokens")).collect()}
    # at most 10,000 blocks a source
    table = [(s, min(10_000, max(1, math.ceil(n / block_rows))), int(budgets[s] // t) if t else 0, float(budgets[s] - (budgets[s] // t) * t) if t else 0.0) for s, (n, t) in per.items()]
    shape = "source string, blocks int, passes int, rest double"
    facts = F.broadcast(spark.createDataFrame(table, shape))
    blocked = rows.join(facts, "source").withColumn("block", F.pmod(F.xxhash64("key", F.lit(seed)), F.col("blocks")))
    sums = blocked.groupBy("source", "block").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest")).collect()
    order: dict[str, list] = {}
    for r in sums:
        order.setdefault(r.source, []).append((hash((seed, r.block)) & 0xFFFFFFFF, r.block, r.n, r.rest))
    whole, edge = [], []
    for s, blocks in order.items():
        left = blocks[0][3]
        for _, block, n, _ in sorted(blocks):
            if n <= left:
                whole.append((s, block, 0.0))
                left -= n
            else:
                edge.append((s, block, left))
                break
    marks = spark.createDataFrame([(s, b, True, 0.0) for s, b, _ in whole] + [(s, b, False, left) for s, b, left in edge], "source string, block long, whole boolean, room double")
    marked = blocked.join(F.broadcast(marks), ["source", "block"], "left")
    again = marked.where("whole").select("key", "source", "passes", "n_tokens")
    running = Window.partitionBy("source", "block").orderBy(F.xxhash64("key", F.lit(seed + 1)), "key").rowsBetween(Window.unboundedPreceding, 0)
    last = marked.where("not whole").withColumn("running", F.sum("n_tokens").over(running)).where("running <= room").select("key", "source", "passes", "n_tokens")
    full = blocked.where("passes > 0").select("key", "source", F.explode(F.sequence(F.lit(1), F.col("passes"))).alias("pass"), "n_tokens")
    part = again.unionByName(last).select("key", "source", (F.col("passes") + 1).alias("pass"), "n_tokens")
    return full.unionByName(part).withColumn("place", F.xxhash64("key", "pass", F.lit(seed + 2)))


def mix(documents: DataFrame, targets: DataFrame, total: float | str | None = None, most_sources: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Draws ``documents`` (key, source, n_tokens) to the shares of ``targets`` (source, target_share, max_repeats).

    Returns the draws (see ``draw``) and a report with a row for each listed
    source: ``source, target_share, max_repeats, documents, available_tokens,
    drawn_tokens, actual_share, most_repeats, exponent, met``; ``total`` as for ``plan``. ``exponent`` is that at which the source
    stands: below 1 it is held by its repetition limit. More than
    ``most_sources`` targets are an error. Sources that are not listed stay out;
    a listed source without documents has share 0 and is not met. ``met``: within
    half a percent of the target, absolutely.
    """
    listed = targets.where("source is not null and target_share > 0").dropDuplicates(["source"]).limit(most_sources + 1).collect()
    if len(listed) > most_sources:
        raise ValueError(f"over {most_sources} sources are listed")
    goal = {r.source: float(r.target_share) for r in listed}
    repeats = {r.source: int(r.max_repeats or 1) for r in listed}
    rows = materialize(documents.where(F.col("source").isin(list(goal))).dropDuplicates(["key"]), "mix-sizes")
    stock = {r.source: (r.documents, r.tokens) for r in rows.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("tokens")).collect()}
    found = plan({s: n for s, (_, n) in stock.items()}, repeats, goal, total)
    drawn = materialize(draw(rows, found.budgets), "mix-draws") if found.budgets else draw(rows, {"": 0.0})
    got = drawn.groupBy("source").agg(F.sum("n_tokens").alias("drawn_tokens"), F.max("pass").alias("most_repeats"))
    all_drawn = drawn.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("all_drawn"))
    base = rows.sparkSession.createDataFrame([(s, goal[s], repeats[s], stock.get(s, (0, 0))[0], stock.get(s, (0, 0))[1] or 0, found.exponents.get(s)) for s in goal], "source string, target_share double, max_repeats int, documents long, available_tokens long, exponent double")
    report = base.join(got, "source", "left").crossJoin(F.broadcast(all_drawn))
    actual = F.coalesce(F.col("drawn_tokens") / F.nullif(F.col("all_drawn"), F.lit(0)), F.lit(0.0))
    return drawn, report.select(
        "source",
        "target_share",
        "max_repeats",
        "documents",
        "available_tokens",
        F.coalesce("drawn_tokens", F.lit(0)).alias("drawn_tokens"),
        actual.alias("actual_share"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        "exponent",
        (F.abs(actual - F.col("target_share")) <= 0.005).alias("met"),
    )
