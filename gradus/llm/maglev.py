"""Sharding by a permutation-filled lookup table.

Each shard has its own permutation of the slots of a prime-sized table; in turns each claims its next free slot.
Shards thus hold nearly equal numbers of slots, and when a shard goes, few slots change hands among the others.
"""
from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SLOTS = 65_537
SHARDS = 64


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> np.ndarray:
    """Index into `shards` for each slot; `slots` must be prime and at least the number of shards."""
    if not shards:
        raise ValueError("there is no shard to place rows on")
    if slots < len(shards) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime, not below the number of shards")
    at = [_number(f"{s}:offset") % slots for s in shards]
    skip = [_number(f"{s}:skip") % (slots - 1) + 1 for s in shards]
    owner, free = [-1] * slots, slots
    while free:
        for i in range(len(shards)):
            slot = at[i]
            while owner[slot] >= 0:
                slot = (slot + skip[i]) % slots
            owner[slot] = i
            at[i] = (slot + skip[i]) % slots
            free -= 1
            if not free:
                break
    return np.array(owner)


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: 60 bits of its md5, modulo the slots; a null key has the slot of the empty string."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15)
    return F.pmod(F.conv(digits, 16, 10).cast("bigint"), F.lit(slots))


def table_frame(spark: SparkSession, shards: Sequence[str], slots: int = SLOTS, lost: str | None = None) -> DataFrame:
    """(slot, shard, shard_name[, shard_after_loss]); a row per slot, so its size is a parameter, not the data's."""
    owner = lookup_table(shards, slots)
    rows = {"slot": range(slots), "shard": owner.tolist(), "shard_name": [shards[i] for i in owner]}
    kinds = ["slot bigint", "shard int", "shard_name string"]
    if lost is not None:
        rest = [s for s in shards if s != lost]
        names = {s: i for i, s in enumerate(shards)}
        rows["shard_after_loss"] = [names[rest[i]] for i in lookup_table(rest, slots)]
        kinds.append("shard_after_loss int")
    return spark.createDataFrame(list(zip(*rows.values())), ", ".join(kinds))


def place(rows: DataFrame, key: str, shards: Sequence[str], slots: int = SLOTS, lost: str | None = None) -> DataFrame:
    """Adds slot, shard and shard_name to every row (columns of these names are replaced).

    The lookup table has one row per slot and is broadcast; the rows are not shuffled. Equal keys go to one shard,
    null keys to that of the empty string.
    """
    table = table_frame(rows.sparkSession, shards, slots, lost)
    kept = [c for c in rows.columns if c not in table.columns]
    return rows.select(*kept).withColumn("slot", slot_of(F.col(key), slots)).join(F.broadcast(table), "slot").select(*kept, *table.columns)


def write_shards(rows: DataFrame, key: str, path: str, shards: Sequence[str], slots: int = SLOTS) -> None:
    """Writes a folder per shard. Each task writes what it has of each shard, so no shard is one task's work."""
    place(rows, key, shards, slots).write.mode("overwrite").partitionBy("shard").parquet(path)
