"""Filling containers of fixed capacity with items of varying length, by minimum bin slack."""

from __future__ import annotations

from collections import Counter


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fullest(counts: Counter, lengths: list[int], room: int) -> list[int]:
    """Lengths of the fullest combination that fits in ``room``, each at most as often as it is in stock.

    Subset sums as bits of one integer: bit s is set if s can be reached. A
    stock of n equal lengths enters as chunks of 1, 2, 4, ... of them. The
    search ends as soon as ``room`` itself is reached.
    """
    if room <= 0:
        return []
    mask, reach = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for length in lengths:
        if length > room:
            continue
        left, chunk = min(counts[length], room // length), 1
        while left > 0:
            take = min(chunk, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            chunk *= 2
        if reach >> room & 1:
            break
    target, out = reach.bit_length() - 1, []
    for length, take, before in reversed(steps):
        if not before >> target & 1:
            out.extend([length] * take)
            target -= length * take
    return out


def minimum_bin_slack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item; every size is in 0..capacity. Items of size 0 go into the first container.

    The largest item left opens a container; the fullest combination of the
    rest that fits beside it is taken out with it.
    """
    stock: dict[int, list[int]] = {}
    for i in np.argsort(-sizes, kind="stable").tolist():
        stock.setdefault(int(sizes[i]), []).append(i)
    zero = stock.pop(0, [])
    counts = Counter({s: len(v) for s, v in stock.items()})
    lengths = sorted(counts, reverse=True)
    out, number = np.zeros(len(sizes), np.int64), 0
    while lengths:
        first = lengths[0]
        counts[first] -= 1
        chosen = [first, *fullest(counts, lengths, capacity - first)]
        for s in chosen[1:]:
            counts[s] -= 1
        for s in chosen:
            out[stock[s].pop()] = number
        if any(not counts[s] for s in set(chosen)):
            lengths = [s for s in lengths if counts[s]]
        number += 1
    out[zero] = 0
    return out


def pack(items: DataFrame, specs: DataFrame, block_items: int = 20_000, most_specs: int = 1000) -> DataFrame:
    """Puts ``items`` (key, n_tokens) into containers of each of ``specs`` (spec, capacity).

    Items are spread over blocks of about ``block_items`` by hash, and each
    block is packed in one task: at most one poorly filled container per
    block. An item larger than the capacity is cut into full containers and a
    rest, which is packed like the others; no other item is cut.

    Null keys, null or negative sizes and capacities below 1 take no part;
    items of size 0 lie in a block's first container; repeated keys are
    separate items; empty tables give no rows.

    Returns ``spec, capacity, container, key, piece, start_token, n_tokens``; ``container`` is unique within a spec.
    """
    specs = specs.where("spec is not null and capacity >= 1").select("spec", F.col("capacity").cast("long").alias("capacity")).dropDuplicates(["spec"])
    total = items.count()
    blocks = max(1, round(total / block_items))
    # the specs are a list of wanted capacities, never data that grows
    wanted = [(r.spec, r.capacity) for r in specs.orderBy("spec").limit(most_specs + 1).collect()]
    if len(wanted) > most_specs:
        raise ValueError(f"over {most_specs} capacities")
    if not wanted:
        wanted_df = specs
    else:
        wanted_df = items.sparkSession.createDataFrame(wanted, specs.schema)
    given = items.where("key is not null and n_tokens >= 0").select("key", "n_tokens").crossJoin(F.broadcast(wanted_df))
    n_full = F.floor(F.greatest(F.col("n_tokens") - 1, F.lit(0)) / F.col("capacity"))
    piece = F.posexplode(F.concat(F.array_repeat(F.col("capacity"), n_full.cast("int")), F.array(F.col("n_tokens") - n_full * F.col("capacity"))))
    cut = given.select("spec", "capacity", "key", piece.alias("piece", "n"))
    cut = cut.select("spec", "capacity", "key", "piece", (F.col("piece") * F.col("capacity")).alias("start_token"), "n", F.pmod(F.xxhash64("key", "piece"), F.lit(blocks)).alias("block"))
    key_type = dict(items.dtypes)["key"]

    def solve(t: pa.Table) -> pa.Table:
        where = minimum_bin_slack(t.column("n").to_numpy(), t.column("capacity")[0].as_py())
        container = pa.array((t.column("block").to_numpy() << 32) + where)
        return pa.table([t.column("spec"), t.column("capacity"), container, t.column("key"), t.column("piece"), t.column("start_token"), t.column("n")], ["spec", "capacity", "container", "key", "piece", "start_token", "n_tokens"])

    return cut.groupBy("spec", "block").applyInArrow(solve, f"spec string, capacity long, container long, key {key_type}, piece int, start_token long, n_tokens long")


def fill_report(packed: DataFrame) -> DataFrame:
    """Containers, tokens, free room and the least possible number of containers of each spec."""
    per = packed.groupBy("spec", "capacity", "container").agg(F.sum("n_tokens").alias("n"), F.max("n_tokens").alias("largest"))
    out = per.where("n > 0").groupBy("spec", "capacity").agg(F.count(F.lit(1)).alias("containers"), F.sum("n").alias("tokens"), F.max("n").alias("fullest"))
    least = F.ceil(F.col("tokens") / F.col("capacity"))
    return out.select("spec", "capacity", "containers", "tokens", "fullest", least.alias("least_containers"), (1 - F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("free_share"))
