"""Sharded minimal perfect hashing in NumPy, and probing it from Spark.

A shard is a cascade of bit arrays (the construction of Limasset, Rizk, Chikhi
and Peterlongo, 2017): level ``l`` has about twice as many bits as keys are
left; a key that is alone at its bit there is settled, the others go on to the
next level.  A key's slot is the number of set bits before its own, over all
levels, so slots run from 0 to n-1 without gaps.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits a level has for each key that reaches it.
GAMMA = 2
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(keys: np.ndarray, level: int) -> np.ndarray:
    """The 64-bit finaliser of SplitMix64 over ``keys`` shifted by a multiple of its increment."""
    with np.errstate(over="ignore"):
        x = keys + _ODD * np.uint64(level + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def build(keys: np.ndarray) -> list[np.ndarray]:
    """The levels (boolean arrays) for distinct 64-bit ``keys``."""
    levels, left = [], np.asarray(keys, np.uint64)
    while len(left):
        size = GAMMA * len(left) + 1
        at = (_mix(left, len(levels)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(alone)
        left = left[~alone[at]]
        if len(levels) > 200:
            raise ValueError("keys must be distinct")
    return levels


def _packed(bits: np.ndarray) -> np.ndarray:
    """Booleans as 64-bit words, the first in the lowest bit."""
    raw = np.packbits(bits, bitorder="little")
    return np.concatenate([raw, np.zeros(-len(raw) % 8, np.uint8)]).view(np.uint64)


@dataclass
class Hash:
    """Levels of one shard, ready for lookups: packed bits and a rank a word of 64."""

    words: list[np.ndarray]
    sizes: list[int]

    def __post_init__(self) -> None:
        before, self._before = 0, []
        for words in self.words:
            ones = np.bitwise_count(words).astype(np.uint32)
            self._before.append((before + np.cumsum(ones, dtype=np.uint32) - ones).astype(np.uint32))
            before += int(ones.sum(dtype=np.int64))
        self.n = before

    @classmethod
    def of(cls, keys: np.ndarray) -> Hash:
        levels = build(keys)
        return cls([_packed(x) for x in levels], [len(x) for x in levels])

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; of keys that aren't in the set any slot, or -1."""
        keys = np.asarray(keys, np.uint64)
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (words, size, before) in enumerate(zip(self.words, self.sizes, self._before, strict=True)):
            if not len(left):
                break
            at = _mix(keys[left], level) % np.uint64(size)
            word, bit = (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))
            held = words[word]
            hit = (held & bit) != 0
            below = np.bitwise_count(held[hit] & (bit[hit] - np.uint64(1)))
            out[left[hit]] = before[word[hit]].astype(np.int64) + below
            left = left[~hit]
        return out

    def dumps(self) -> bytes:
        head = np.array([len(self.sizes), *self.sizes], np.uint32)
        return head.tobytes() + b"".join(x.tobytes() for x in self.words)

    @classmethod
    def loads(cls, data: bytes) -> Hash:
        n = int(np.frombuffer(data, np.uint32, 1)[0])
        sizes = np.frombuffer(data, np.uint32, n, 4).astype(int).tolist()
        at, words = 4 * (n + 1), []
        for size in sizes:
            words.append(np.frombuffer(data[at : at + 8 * -(-size // 64)], np.uint64))
            at += 8 * len(words[-1])
        return cls(words, sizes)


# --- dealing rows to shards -----------------------------------------------------

#: Rows that one task gets of one shard: a shard with more is sent to several tasks.
SHARD_ROWS = 200_000
#: Heavy shards whose salts are broadcast at most; there is one for each ``SHARD_ROWS`` rows at most.
BROADCAST_SHARDS = 1_000_000


def salts(rows: DataFrame, most: int | None = None) -> DataFrame:
    """(shard, salts) of the shards that more than ``most`` of (shard, rows) rows go to."""
    most = most or SHARD_ROWS
    return rows.groupBy("shard").agg(F.sum("rows").alias("rows")).where(F.col("rows") > most).select("shard", F.ceil(F.col("rows") / most).cast("int").alias("salts"))


def deal(asked: DataFrame, index: DataFrame, heavy: DataFrame) -> DataFrame:
    """Rows to look up and the index's shards, in partitions sorted so that a shard comes before its rows.

    asked: columns, among them shard; index: shard and blob (a struct);
    heavy: ``salts`` of the rows.  A heavy shard goes to each of its salts, and
    its rows are spread over them by their numbers in ``asked`` (a written
    table, so that a task that runs again gives the same), whatever they hold:
    rows that are alike in all columns spread too.  Columns: shard, salt, kind (0
    for a shard, 1 for a row), blob, and those of ``asked``.
    """
    side = F.broadcast(heavy) if heavy.count() <= BROADCAST_SHARDS else heavy
    n = F.coalesce(F.col("salts"), F.lit(1))
    blob = index.schema["blob"].dataType
    own = [c for c in asked.columns if c != "shard"]
    blobs = index.join(side, "shard", "left").select("shard", F.explode(F.sequence(F.lit(0), n - 1)).alias("salt"), F.lit(0).alias("kind"), "blob", *[F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in own])
    numbered = asked.withColumn("_number", F.monotonically_increasing_id())
    rows = numbered.join(side, "shard", "left").select("shard", F.pmod(F.xxhash64("_number"), n).cast("int").alias("salt"), F.lit(1).alias("kind"), F.lit(None).cast(blob).alias("blob"), *own)
    return rows.unionByName(blobs).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")


def runs(batch: pa.RecordBatch):
    """(shard, kind, first, last) of the stretches of a dealt batch that have one shard and kind."""
    shard, kinds = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
    edges = np.flatnonzero((shard[1:] != shard[:-1]) | (kinds[1:] != kinds[:-1]) | (kinds[1:] == 0)) + 1 if batch.num_rows else np.empty(0, int)
    starts = [0, *edges.tolist(), batch.num_rows]
    for a, b in zip(starts, starts[1:], strict=False):
        if a < b:
            yield int(shard[a]), int(kinds[a]), a, b
