"""Filling containers of fixed capacity with whole documents.

Minimum bin slack: for one container after another, a bitset subset-sum over the
available lengths finds the fullest feasible combination, which is then taken away.
Items of one length are alike, so it works on the number of items per length -
which the capacity bounds, however many documents there are - and takes a
combination as often as the lengths allow.  Documents get their places by their
rank among those of the same length.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.runtime import checkpoint_with

#: Greatest capacity; a histogram has no more rows.
MAX_CAPACITY = 1 << 17
#: Kinds of containers handled at once.
MAX_CONTAINERS = 1000
#: Lengths and parts of plans of all kinds together, which are broadcast: 96 MB.
MAX_PLAN = 3_000_000
#: Items of one length ranked in one task.
RANK_ROWS = 50_000


def fullest(lengths: list[int], counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The fullest combination that holds the largest length: how often each length is taken.

    ``lengths`` is descending.  A bit of ``reach`` stands for each sum that the lengths
    so far can make; multiples enter in powers of two.  It stops at the first exact fill.
    """
    top = lengths[0]
    room = capacity - top
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in lengths:
        if length > room:
            continue
        have = min(counts[length] - (length == top), room // length)
        k = 1
        while have > 0:
            k = min(k, have)
            grown = (reach | reach << (length * k)) & mask
            if grown != reach:
                steps.append((length, k, reach))
                reach = grown
            have -= k
            k *= 2
        if reach >> room & 1:
            break
    left = reach.bit_length() - 1
    taken = {top: 1}
    for length, k, before in reversed(steps):
        if not before >> left & 1:
            taken[length] = taken.get(length, 0) + k
            left -= length * k
    return taken


def plan_histogram(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, items per container, first container) of every part of the plan; all items are placed."""
    counts = {k: v for k, v in counts.items() if v > 0}
    lengths = sorted(counts, reverse=True)
    used = dict.fromkeys(counts, 0)
    out, container = [], 0
    while lengths:
        taken = fullest(lengths, counts, capacity)
        times = min(counts[length] // c for length, c in taken.items())
        for length, c in taken.items():
            out.append((length, used[length], used[length] + c * times, c, container))
            used[length] += c * times
            counts[length] -= c * times
            if not counts[length]:
                i = bisect.bisect_left(lengths, -length, key=lambda x: -x)
                lengths.pop(i)
        container += times
    return out


def pack(items: DataFrame, containers: DataFrame, item: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """(container, item, piece, tokens, bin_id): a container of each kind for every item.

    ``containers`` has container and capacity_tokens.  An item longer than the capacity
    is cut into pieces of the capacity and a rest, numbered from 0; no other item is
    cut.  Items of size 0, or of a null or negative size, need no place: piece 0 with
    0 tokens and a null bin_id.  Repeated items are placed as often as they are given.
    Kinds without a positive capacity are ignored; of a repeated kind the greatest
    capacity counts.  Empty tables give no rows.
    """
    spark = items.sparkSession
    rows = containers.where("container IS NOT NULL AND capacity_tokens > 0").groupBy("container").agg(F.max("capacity_tokens")).limit(MAX_CONTAINERS + 1).collect()
    kinds = {name: int(capacity) for name, capacity in rows}
    if len(kinds) > MAX_CONTAINERS or max(kinds.values(), default=0) > MAX_CAPACITY:
        raise ValueError(f"more than {MAX_CONTAINERS} containers, or a capacity above {MAX_CAPACITY}")
    schema = f"container string, `{item}` {dict(items.dtypes)[item]}, piece int, tokens int, bin_id long"
    if not kinds:
        return spark.createDataFrame([], schema)

    offered = F.array(*(F.struct(F.lit(name).alias("container"), F.lit(capacity).alias("capacity")) for name, capacity in sorted(kinds.items())))
    n = F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0))
    pieces = (
        items.select(F.col(item), n.alias("_n"))
        .withColumn("_k", F.explode(offered))
        .select("_k.*", item, "_n", F.explode(F.expr("sequence(0, greatest(0, cast(ceil(_n / _k.capacity) as int) - 1))")).alias("piece"))
        .select("container", item, "piece", F.expr("cast(least(capacity, _n - piece * capacity) as int)").alias("tokens"))
    )
    histogram, seen = checkpoint_with(pieces.where("tokens > 0").groupBy("container", "tokens").agg(F.count("*").alias("n")), rows=F.count("*"))

    def plan(part: pd.DataFrame) -> pd.DataFrame:
        name = part["container"].iloc[0]
        found = plan_histogram(dict(zip(part["tokens"].tolist(), part["n"].tolist())), kinds[name])
        return pd.DataFrame(found, columns=["tokens", "first", "stop", "per", "bin"]).assign(container=name).astype({"container": object})

    names = {name: i for i, name in enumerate(sorted(kinds))}
    planned, parts = checkpoint_with(histogram.groupBy("container").applyInPandas(plan, "container string, tokens int, first long, stop long, per long, bin long"), rows=F.count("*"))
    if max(seen["rows"], parts["rows"]) > MAX_PLAN:
        raise ValueError(f"more than {MAX_PLAN} lengths or parts of plans; pack fewer kinds of containers at once")
    steps = planned.toPandas()
    kind = steps["container"].map(names).to_numpy(np.int64) if len(steps) else np.zeros(0, np.int64)
    group = kind * (MAX_CAPACITY + 1) + steps["tokens"].to_numpy(np.int64)
    by = np.lexsort((steps["first"].to_numpy(np.int64), group))
    shared = spark.sparkContext.broadcast([x[by] for x in (group, *(steps[c].to_numpy(np.int64) for c in ("first", "per", "bin")))])

    def place(kinds_: pa.Array, tokens: pa.Array, ranks: pa.Array) -> pa.Array:
        group, first, per, at = shared.value
        wanted = kinds_.to_numpy(zero_copy_only=False).astype(np.int64) * (MAX_CAPACITY + 1) + tokens.to_numpy(zero_copy_only=False).astype(np.int64)
        rank = ranks.to_numpy(zero_copy_only=False).astype(np.int64)
        keys = np.concatenate([group, wanted])
        values = np.concatenate([first, rank])
        kind_of = np.concatenate([np.zeros(len(group), np.int8), np.ones(len(wanted), np.int8)])
        merged = np.lexsort((kind_of, values, keys))
        seen = np.cumsum(kind_of[merged] == 0) - 1
        found = np.empty(len(wanted), np.int64)
        found[merged[kind_of[merged] == 1] - len(group)] = seen[kind_of[merged] == 1]
        return pa.array(at[found] + (rank - first[found]) // per[found])

    wide = F.broadcast(histogram.select("container", "tokens", F.ceil(F.col("n") / RANK_ROWS).alias("_salts")))
    salted = pieces.where("tokens > 0").join(wide, ["container", "tokens"]).withColumn("_salt", F.expr(f"pmod(xxhash64(`{item}`, piece), _salts)")).drop("_salts")
    keys = ["container", "tokens", "_salt"]
    before = F.sum("_n").over(Window.partitionBy("container", "tokens").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = salted.groupBy(*keys).agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    ranked = (
        salted.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(item, "piece")))
        .join(offsets, keys)
        .withColumn("_rank", F.col("_r") - 1 + F.col("_before"))
    )
    numbered = F.create_map(*(F.lit(x) for pair in sorted(names.items()) for x in pair))
    placed = ranked.withColumn("bin_id", F.arrow_udf(place, "long")(numbered[F.col("container")], F.col("tokens"), F.col("_rank")))
    out = ["container", item, "piece", "tokens", "bin_id"]
    return placed.select(*out).unionByName(pieces.where("tokens <= 0").withColumn("bin_id", F.lit(None).cast("long")).select(*out))


def fill(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """Per kind of container: capacity, bins, tokens, the least possible bins, the fullest overflow (0 always) and the share filled."""
    per_bin = packed.where("bin_id IS NOT NULL").groupBy("container", "bin_id").agg(F.sum("tokens").alias("t"))
    sizes = containers.where("container IS NOT NULL AND capacity_tokens > 0").groupBy("container").agg(F.max("capacity_tokens").alias("capacity"))
    return (
        per_bin.groupBy("container")
        .agg(F.count("*").alias("bins"), F.sum("t").alias("tokens"), F.max("t").alias("most"))
        .join(F.broadcast(sizes), "container")
        .select(
            "container", "capacity", "bins", "tokens",
            F.ceil(F.col("tokens") / F.col("capacity")).alias("least_bins"),
            F.greatest(F.col("most") - F.col("capacity"), F.lit(0)).alias("overflow"),
            (F.col("tokens") / (F.col("bins") * F.col("capacity"))).alias("filled"),
        )
    )
