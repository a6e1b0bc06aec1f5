"""Sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table. Shards take turns, each
claiming its first free slot in that order, until the table is full: shares differ by one slot at most,
and adding or losing a shard moves few slots. A document's id is hashed to a slot; the table is a
parameter's size (``SLOTS`` rows) whatever the data, so it is broadcast and nothing is shuffled.

Defined results: rows without an id are placed by their text, and by the hash of null where both are
null; repeated rows share a shard; texts do not matter otherwise. A column that has the name of the
result column is replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARDS = 64
SLOTS = 65_537  # prime, well over 100 times the shards


def lookup_table(shards: list[str], slots: int = SLOTS) -> np.ndarray:
    """The index of the shard that owns each slot."""
    if slots < max(2, len(shards)) or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be a prime, not under the number of shards")
    if len(set(shards)) != len(shards) or not shards:
        raise ValueError("shards need distinct names, one at least")
    owner = np.full(slots, -1, np.int32)
    digests = [hashlib.md5(name.encode()).digest() for name in shards]
    at = [int.from_bytes(d[:8], "big") % slots for d in digests]
    step = [int.from_bytes(d[8:], "big") % (slots - 1) + 1 for d in digests]
    free = slots
    while True:
        for k in range(len(shards)):
            while owner[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % slots
            owner[at[k]] = k
            free -= 1
            if not free:
                return owner


def place(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, column: str = "shard") -> DataFrame:
    """``docs`` with the shard of each row as ``column``."""
    owner = lookup_table([f"shard-{k}" for k in range(shards)], slots)
    table = docs.sparkSession.createDataFrame(list(enumerate(owner.tolist())), "__slot long, __owner int")
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    names = [c for c in docs.columns if c != column]
    slotted = docs.withColumn("__slot", F.pmod(key, F.lit(slots)))
    return slotted.join(F.broadcast(table), "__slot").select(*(F.col(f"`{c}`") for c in names), F.col("__owner").alias(column))
