"""Sharding through a permutation-filled lookup table.

Every shard has its own permutation of the slots of a table of prime size, an offset and
a step drawn from its name. The shards take turns; each claims the first slot of its
order that is still free, until the table is full. So all shards hold the same number of slots up
to one, and a shard that goes or comes moves few slots that belong to others. A row is
placed by its key's hash modulo the table's size and one lookup in the table, which has
a fixed number of rows (`slots`) and is broadcast.

A null key is placed by the row's text, so rows without a key don't meet in one shard;
without a text either, as the empty key. Equal keys share a shard; every row is returned; other columns stay or
are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def preference(shard: str, slots: int) -> tuple[int, int]:
    """Offset and step of a shard's order of the slots."""
    d = hashlib.sha256(shard.encode()).digest()
    return int.from_bytes(d[:8], "big") % slots, int.from_bytes(d[8:16], "big") % (slots - 1) + 1


def fill_table(shards: list[str], slots: int = 65537) -> np.ndarray:
    """The shard number of each slot."""
    if not is_prime(slots):
        raise ValueError("the number of slots must be prime: only then does every step reach every slot")
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct, one at least and no more than slots")
    order = [preference(s, slots) for s in shards]
    nxt, found, left = [o for o, _ in order], [-1] * slots, slots
    while left:
        for k, (_, step) in enumerate(order):
            at = nxt[k]
            while found[at] >= 0:
                at = (at + step) % slots
            found[at], nxt[k], left = k, (at + step) % slots, left - 1
            if not left:
                break
    return np.array(found, dtype=np.int32)


def slot_of(key: Column, slots: int) -> Column:
    """The slot of a key: the first 60 bits of the MD5 of its text, modulo the table's size."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(slots))


def assign_shards(df: DataFrame, shards: list[str], key: str = "doc_id", text: str | None = "text", slots: int = 65537) -> DataFrame:
    """`df` with __slot and __shard. No shuffle: the lookup table of `slots` rows is broadcast."""
    filled = fill_table(shards, slots)
    rows = df.sparkSession.createDataFrame([(i, int(s)) for i, s in enumerate(filled)], "__slot long, __shard int")
    other = F.md5(F.col(text).cast("binary")) if text and text in df.columns else F.lit("")
    named = F.coalesce(F.col(key).cast("string"), other, F.lit(""))
    return df.withColumn("__slot", slot_of(named, slots)).join(F.broadcast(rows), "__slot")


def write_shards(df: DataFrame, path: str, shards: list[str], parts: int = 1, **how) -> None:
    """Write `df` as one folder for each shard, each dealt to `parts` tasks."""
    placed = assign_shards(df, shards, **how)
    split = placed.repartition(len(shards) * parts, "__shard", F.pmod(F.xxhash64(*df.columns), F.lit(parts)))
    split.drop("__slot").write.partitionBy("__shard").parquet(path)
