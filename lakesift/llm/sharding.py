"""Sharding by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesift.llm.common import fresh

#: Slots of the table: a prime, so that every step visits every slot.
SLOTS = 65537


def _number(text: str) -> int:
    """60 bits of the MD5 digest of a text."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: list[str], slots: int = SLOTS, weights: dict[str, int] | None = None) -> list[int]:
    """For each slot the number of the shard that owns it.

    Each shard prefers the slots in the order offset, offset + skip, ... (mod ``slots``), where both
    come from its name. Shards take turns (``weights`` times in a row, 1 by default), each claiming its first
    slot that is still free. A shard that goes leaves most slots of the others where they are.
    """
    if not shards:
        raise ValueError("no shards")
    if len(set(shards)) != len(shards):
        raise ValueError("shard names repeat")
    if slots < len(shards) or any(slots % p == 0 for p in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime that is no less than the number of shards")
    at = [_number(f"offset:{s}") % slots for s in shards]
    skip = [_number(f"skip:{s}") % (slots - 1) + 1 for s in shards]
    turns = [max(1, (weights or {}).get(s, 1)) for s in shards]
    table, left = [-1] * slots, slots
    while left:
        for k, n in enumerate(turns):
            for _ in range(n):
                if not left:
                    break
                while table[at[k]] >= 0:
                    at[k] = (at[k] + skip[k]) % slots
                table[at[k]] = k
                left -= 1
    return table


def slot_of(key, slots: int = SLOTS):
    """The slot of a key column; a null key has slot 0."""
    return F.coalesce(F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 15), 16, 10).cast("long") % slots, F.lit(0))


def shard(df: DataFrame, shards: list[str], key: str = "doc_id", slots: int = SLOTS, weights: dict[str, int] | None = None) -> DataFrame:
    """``df`` with the columns slot (long), shard (int) and shard_name: constant-time placement by key.

    The table of ``slots`` rows is broadcast (under 1 MB at the default size, whatever ``df``
    holds), so no row of ``df`` moves. Null keys: slot 0. Equal keys: equal shards. Empty table:
    empty result. Columns of ``df`` named slot, shard or shard_name are replaced.
    """
    spark = df.sparkSession
    table = lookup_table(shards, slots, weights)
    at, slot, number, name = (fresh(c, df.columns) for c in ("__at", "__slot", "__shard", "__name"))
    rows = spark.createDataFrame([(i, k, shards[k]) for i, k in enumerate(table)], f"{slot} long, {number} int, {name} string")
    kept = [c for c in df.columns if c not in ("slot", "shard", "shard_name")]
    return df.select("*", slot_of(F.col(key), slots).alias(at)).join(F.broadcast(rows), F.col(at) == F.col(slot)).select(
        *kept, F.col(at).alias("slot"), F.col(number).alias("shard"), F.col(name).alias("shard_name")
    )


def write_shards(sharded: DataFrame, path: str, files: int = 16) -> None:
    """Write a folder for each shard. A shard's rows go to ``files`` tasks, so that no shard is one task."""
    salt = F.pmod(F.xxhash64(*[c for c in sharded.columns if c not in ("slot", "shard", "shard_name")]), F.lit(files))
    n_shards = max(1, sharded.select("shard").distinct().count())
    sharded.repartition(n_shards * files, "shard", salt).write.partitionBy("shard").mode("overwrite").parquet(path)
