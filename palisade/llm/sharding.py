"""Operator 4: sharding by a permutation-filled lookup table. Native: DataFrame and SQL functions only.

Every shard prefers the slots of a table of prime size in an order of its own (offset and skip, from a hash of its
name); shards take turns, each claiming the next free slot it prefers, until the table is full. Slots per shard
differ by one at most, and most keys stay where they are when a shard goes. A row's slot is a hash of its key
modulo the table's size, found in the broadcast table in constant time.

The table has a fixed number of slots (a parameter), whatever the data. Null keys count as the empty string; equal
keys go to one shard. All rows are kept, and other columns but for those named slot or shard (letter case aside), which
the result replaces; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import masked, unmasked

SLOTS = 16381  # prime


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def filled(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The number of the shard that holds each slot."""
    if not shards or slots < len(shards) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("a prime number of slots, at least one for each shard, is needed")
    at = [_hash(f"{s}/offset") % slots for s in shards]
    skip = [_hash(f"{s}/skip") % (slots - 1) + 1 for s in shards]
    table, free = [-1] * slots, slots
    while True:
        for shard in range(len(shards)):
            while table[at[shard]] >= 0:
                at[shard] = (at[shard] + skip[shard]) % slots
            table[at[shard]] = shard
            free -= 1
            if not free:
                return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """From 60 bits of the MD5 of the key as text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long") % slots


def place(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """df with the columns slot and shard."""
    inner, of = masked(df)
    listed = ",".join(map(str, filled(shards, slots)))
    table = df.sparkSession.range(1).select(F.posexplode(F.from_json(F.lit(f"[{listed}]"), "array<int>")).alias("slot", "n"))
    named = F.element_at(F.array(*map(F.lit, shards)), F.col("n") + 1)
    table = table.select(F.col("slot").cast("long").alias("slot"), named.alias("shard"))
    out = inner.withColumn("slot", slot_of(F.col(of[key]), slots)).join(F.broadcast(table), "slot")  # `slots` rows, a fixed bound
    return unmasked(out, of, "slot", "shard")


def write_shards(df: DataFrame, key: str, shards: list[str], path: str, files_per_shard: int = 1, slots: int = SLOTS) -> None:
    """Writes df partitioned by shard; rows of a shard are dealt over so many files, so no writer gets a whole shard."""
    placed = place(df, key, shards, slots)
    deal = F.pmod(F.xxhash64(F.col(key).cast("string"), F.monotonically_increasing_id()), F.lit(files_per_shard))
    placed.repartition(len(shards) * files_per_shard, "shard", deal).write.partitionBy("shard").parquet(path)
