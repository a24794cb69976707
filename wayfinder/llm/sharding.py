"""Sharding with a permutation-filled lookup table.

Each shard has a preference order over the slots of a table of prime size, from an offset and a
skip that its name hashes to. Shards take turns; at its turn a shard claims the first slot of its
order that is free, until none is. A row belongs to the shard of the slot that its key hashes to:
one probe of a broadcast table with exactly `slots` rows, and no shuffle. Shares differ by at most
one slot, and taking a shard away moves few of the others' slots.

Null and empty keys: null places as the empty string. Rows with equal keys go to one shard. An
empty table gives an empty result. Columns of the input named like the added ones are replaced;
the key may be computed from them. Keys of any length are hashed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The query's shards and slots: a prime, over a hundred slots a shard.
SHARDS = tuple(f"shard-{k:02d}" for k in range(16))
SLOTS = 1601


def hashed(key: Column, salt: str = "") -> Column:
    """A number under 2^52 from the MD5 of a key as text."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.coalesce(key.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("long")


def lookup_table(spark: SparkSession, shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Rows `(slot, shard)`, one for each slot. Needs at least one shard, distinct names and a prime `slots`."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct names, at least one")
    if slots < len(shards) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime, no smaller than the number of shards")
    owner = ",".join(map(str, fill(shards, slots)))
    names = F.array(*map(F.lit, shards))
    one = spark.range(1).select(F.posexplode(F.split(F.lit(owner), ",")).alias("slot", "owner"))
    return one.select(F.col("slot").cast("long").alias("slot"), F.get(names, F.col("owner").cast("int")).alias("shard"))


def fill(shards: Sequence[str], slots: int) -> list[int]:
    """The number of the shard that owns each slot. A table of fixed size, filled before any row is read."""
    of = lambda x, salt: int(hashlib.md5((salt + x).encode()).hexdigest()[:13], 16)
    orders = [(of(x, "offset:") % slots, of(x, "skip:") % (slots - 1) + 1) for x in shards]
    owner, at = [-1] * slots, [0] * len(shards)
    for turn in range(slots):
        k = turn % len(shards)
        offset, skip = orders[k]
        while owner[(offset + at[k] * skip) % slots] >= 0:
            at[k] += 1
        owner[(offset + at[k] * skip) % slots] = k
    return owner


def place(rows: DataFrame, key: Column, table: DataFrame, slots: int = SLOTS) -> DataFrame:
    """`rows` with `slot` and `shard`; the table has exactly `slots` rows, which bounds the broadcast."""
    kept = [c for c in rows.columns if c not in ("slot", "shard")]
    marked = rows.select(*kept, (hashed(key) % slots).alias("slot"))
    return marked.join(F.broadcast(table), "slot").select(*kept, "slot", "shard")
