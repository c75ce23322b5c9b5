"""Filling containers of fixed capacity with items, without splitting an item that fits one.

Method: best-two-fit. A container is filled greedily with the largest unpacked items that fit; then its smallest item
gives way to the two unpacked items that fit the gap so expanded more tightly. Items are hashed into shards of bounded
size that are packed side by side, so a shard's last containers are all that sharding can waste.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dumpquarry.session import stage

CAPACITY = 2048
#: Items of a shard, on average: the bound of a task's memory and time.
SHARD_ITEMS = 50_000


def best_two_fit(sizes: list[int], capacity: int = CAPACITY) -> list[int]:
    """The container (0, 1, ...) of each item; sizes lie between 0 and the capacity. Items of size 0 go into container 0."""
    stacks: dict[int, list[int]] = {}
    for i in range(len(sizes) - 1, -1, -1):
        if sizes[i]:
            stacks.setdefault(sizes[i], []).append(i)
    present = 0  # bit s: an unpacked item of size s is there
    for s in stacks:
        present |= 1 << s
    container = [0] * len(sizes)

    def largest(room: int) -> int:
        return (present & ((2 << room) - 1)).bit_length() - 1 if room > 0 else -1

    def take(s: int) -> int:
        nonlocal present
        i = stacks[s].pop()
        if not stacks[s]:
            present &= ~(1 << s)
        return i

    opened = 0
    while present:
        held: list[int] = []
        gap = capacity
        while (s := largest(gap)) > 0:
            held.append(take(s))
            gap -= s
        if gap and present:
            smallest = sizes[held[-1]]
            room, best, pair = gap + smallest, smallest, None
            a = largest(room - 1)
            while a > 0 and 2 * a > best and best < room:
                b = largest(min(a, room - a))
                if b == a and len(stacks[a]) < 2:
                    b = largest(a - 1)
                if b > 0 and a + b > best:
                    best, pair = a + b, (a, b)
                a = largest(a - 1)
            if pair:
                back = held.pop()
                held += [take(pair[0]), take(pair[1])]
                stacks[smallest].append(back)
                present |= 1 << smallest
        for i in held:
            container[i] = opened
        opened += 1
    return container


def pack(items: DataFrame, key: str = "doc_id", size: str = "tokens", capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """One row per item or piece: key, piece (0, 1, ...), size, container_id.

    An item larger than the capacity is cut into pieces of the capacity and a rest. Defined results: items of size 0
    (or null, which counts as 0) get a container, where they take no room; repeated keys are separate items; the same
    table gives the same containers; an empty table gives no rows; other columns are ignored.
    """
    n = F.coalesce(F.col(size), F.lit(0)).cast("long")
    pieces = stage(
        items.select(F.col(key), n.alias("_n"))
        .select(key, "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("_n") / capacity) - 1, F.lit(0)).cast("long"))).alias("piece"))
        .select(key, "piece", F.least(F.lit(capacity).cast("long"), F.col("_n") - F.col("piece") * capacity).alias(size)),
        "pieces",
    )
    shards = max(1, math.ceil(pieces.count() / shard_items))

    def fill(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values([key, "piece", size], kind="stable", na_position="last").reset_index(drop=True)
        inside = best_two_fit([int(x) for x in shard[size]], capacity)
        shard[key] = shard[key].astype(object) if shard[key].dtype.kind not in "iuf" else shard[key]
        return shard.drop(columns="_shard").assign(container_id=[(int(shard["_shard"].iloc[0]) << 32) + c for c in inside])

    schema = pieces.schema.add("container_id", "long")
    return pieces.withColumn("_shard", F.pmod(F.xxhash64(key, "piece"), F.lit(shards))).groupBy("_shard").applyInPandas(fill, schema)
