"""Fixed-size uniform sample from data of unknown size that arrives in pieces.

Method: the distinct keys are hashed into shards; each shard keeps a geometric file: accepted records collect in a
buffer, and a full buffer is flushed as one new randomised subsample over the slots that the older subsamples lose, so
that a subsample's segments shrink exponentially. The shards' samples are then merged, some at a time, by
hypergeometric draws weighted with the numbers of records the shards have seen.
"""

from __future__ import annotations

import io
import os
import random
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dumpquarry.session import shared_dir

#: Up to so many records a shard's file is kept in memory; a larger one lies in the shared folder while its task runs.
MEMORY_RECORDS = 4_000_000
#: Shards merged into one at a time.
FAN_IN = 64


class GeometricFile:
    """A reservoir of ``capacity`` 64-bit records in fixed slots, written only in flushes of a whole buffer."""

    def __init__(self, capacity: int, rng: np.random.Generator, buffer: int | None = None, folder: str | None = None, memory_records: int = MEMORY_RECORDS) -> None:
        self.capacity, self.rng = capacity, rng
        self.limit = max(1, min(capacity, buffer or max(16, capacity // 64)))
        self.path: Path | None = None
        if capacity > memory_records and folder:
            self.path = Path(folder) / f"reservoir-{uuid.uuid4().hex}.bin"
            self.path.parent.mkdir(parents=True, exist_ok=True)
            self.slots: io.BufferedIOBase = self.path.open("w+b")
        else:
            self.slots = io.BytesIO()
        self.seen = 0
        self.filled = 0
        self.buffer: list[int] = []
        self.subsamples: list[np.ndarray] = []  # the slots of each, in random order; its last ones are lost first
        self.flushes = 0

    def _write(self, slots: np.ndarray, records: np.ndarray) -> None:
        order = np.argsort(slots, kind="stable")
        slots, records = slots[order], records[order]
        for run in np.split(np.arange(len(slots)), np.flatnonzero(np.diff(slots) != 1) + 1):
            if len(run):
                self.slots.seek(int(slots[run[0]]) * 8)
                self.slots.write(records[run].astype("<i8").tobytes())

    def _flush(self) -> None:
        if not self.buffer:
            return
        records = self.rng.permutation(np.array(self.buffer, dtype=np.int64))
        fresh = min(len(records), self.capacity - self.filled)
        slots = [np.arange(self.filled, self.filled + fresh)]
        self.filled += fresh
        if lost := len(records) - fresh:
            sizes = np.array([len(s) for s in self.subsamples])
            for i, n in enumerate(self.rng.multivariate_hypergeometric(sizes, lost)):
                if n:
                    slots.append(self.subsamples[i][-n:])
                    self.subsamples[i] = self.subsamples[i][:-n]
            self.subsamples = [s for s in self.subsamples if len(s)]
        taken = np.concatenate(slots)
        self._write(taken, records)
        self.subsamples.append(self.rng.permutation(taken))
        self.buffer = []
        self.flushes += 1

    def add(self, records: np.ndarray) -> None:
        """Offer records in order; the n-th seen is accepted with probability capacity / n."""
        room = max(0, self.capacity - self.seen)
        for r in records[:room].tolist():
            self.buffer.append(r)
            if len(self.buffer) == self.limit:
                self._flush()
        self.seen += min(room, len(records))
        rest = records[room:]
        if not len(rest):
            return
        if self.filled < self.capacity:
            self._flush()
        ordinal = np.arange(self.seen + 1, self.seen + len(rest) + 1)
        for r in rest[self.rng.random(len(rest)) * ordinal < self.capacity].tolist():
            # the record that gives way is any of the reservoir: one still in the buffer, or one in a slot, chosen at the flush
            at = int(self.rng.integers(self.capacity))
            if at < len(self.buffer):
                self.buffer[at] = r
            else:
                self.buffer.append(r)
                if len(self.buffer) == self.limit:
                    self._flush()
        self.seen += len(rest)

    def sample(self) -> np.ndarray:
        """The records now held, in slot order; the file is closed and removed."""
        self._flush()
        self.slots.seek(0)
        held = np.frombuffer(self.slots.read(self.filled * 8), dtype="<i8").astype(np.int64)
        self.close()
        return held

    def close(self) -> None:
        self.slots.close()
        if self.path and self.path.exists():
            os.unlink(self.path)


def shares(populations: list[int], k: int, rng: np.random.Generator) -> list[int]:
    """How many of k draws without replacement fall on each population: multivariate hypergeometric, for populations of any size."""
    total = sum(populations)
    if k >= total:
        return list(populations)
    if total < 1_000_000_000:
        return [int(x) for x in rng.multivariate_hypergeometric(np.array(populations), k)]
    urn, left, out = random.Random(int(rng.integers(1 << 62))), list(populations), [0] * len(populations)
    for _ in range(k):  # beyond what numpy's generator takes: draw by draw
        at = urn.randrange(total)
        i = 0
        while at >= left[i]:
            at -= left[i]
            i += 1
        left[i] -= 1
        out[i] += 1
        total -= 1
    return out


def merge_samples(populations: list[int], samples: list[np.ndarray], k: int, rng: np.random.Generator) -> np.ndarray:
    """One uniform sample of k (or all) from uniform samples of disjoint populations."""
    parts = [rng.choice(s, n, replace=False) for s, n in zip(samples, shares(populations, k, rng)) if n]
    return np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)


def fixed_size_sample(rows: DataFrame, key: str, k: int, seed: int = 42, buffer: int | None = None) -> DataFrame:
    """Exactly k distinct keys of ``rows`` (all if there are fewer), each set of k equally likely: one column, ``key``.

    The key is a whole number. Defined results: null keys are left out; a key in many rows or pieces counts once; an
    empty table gives no rows; other columns are ignored. For the same seed, data and number of partitions the sample
    is the same whatever the order of arrival, as each shard takes its keys in the order of a seeded hash. k is the
    size of the rows that are merged, so it should fit a task's memory several times; the data need not.
    """
    spark = rows.sparkSession
    folder = shared_dir(spark) + "/dumpquarry/reservoirs"
    local = folder.removeprefix("file://") if folder.startswith(("file:", "/")) else None
    state = "shard long, population long, held array<long>"

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = TaskContext.get().partitionId()
        reservoir = GeometricFile(k, np.random.default_rng([seed, shard]), buffer, local)
        try:
            for batch in batches:
                reservoir.add(batch["id"].to_numpy(dtype=np.int64))
            if reservoir.seen:
                yield pd.DataFrame({"shard": [shard], "population": [reservoir.seen], "held": [reservoir.sample()]})
        finally:
            reservoir.close()

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("shard")
        shard = int(group["shard"].iloc[0])
        populations = [int(x) for x in group["population"]]
        held = merge_samples(populations, list(group["held"]), k, np.random.default_rng([seed, len(group), shard, sum(populations) & 0xFFFFFFFF]))
        return pd.DataFrame({"shard": [shard // FAN_IN], "population": [sum(populations)], "held": [held]})

    distinct = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id")).distinct().sortWithinPartitions(F.xxhash64("id", F.lit(seed)))
    shards = distinct.mapInPandas(draw, state)
    named = spark.conf.get("spark.sql.shuffle.partitions")
    bound = max(2, int(named), int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", named)))
    while bound > 1:
        bound = -(-bound // FAN_IN)
        # rows that are already spread by key keep their partitions, so more shards than expected may be left: the last merge takes them all
        part = F.floor(F.col("shard") / FAN_IN) if bound > 1 else F.lit(0)
        shards = shards.withColumn("part", part).groupBy("part").applyInPandas(merge, state)
    return shards.select(F.explode("held").alias(key))
