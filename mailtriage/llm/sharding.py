"""Placement of rows on shards by a permutation-filled lookup table, in DataFrame operations only.

Every shard prefers the slots of a prime-sized table in an order of its own: a start and a step, both from the
shard's name, run through all slots. Shards take turns, in the order of their names, each claiming the first slot
it prefers that is still free, until the table is full; so all shards own the same number of slots, give or take
one, and a shard that comes or goes moves little more than its own share of the keys. A row's key is hashed to a
slot; its shard is read from the table, which is broadcast: its size is the parameter ``table_size``, whatever the
input. The fill is sequential and bounded by the same parameter; it runs once, on the driver.

A missing key is hashed as an empty text. Repeated rows get the same shard. An empty table gives an empty result.
Other columns are kept; the two that are added are named by ``slot_col`` and ``shard_col``, and a column of the
same name is replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_SIZE = 65537  # prime; hundreds of slots for each shard keep the shares within a few per mille
MAX_TABLE_SIZE = 1 << 22  # the bound of what is broadcast
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def fill_table(shards: Sequence[str], table_size: int = TABLE_SIZE) -> list[int]:
    """The shard number of every slot."""
    if not 0 < len(set(shards)) == len(shards) <= table_size <= MAX_TABLE_SIZE:
        raise ValueError("shard names must be distinct, and no more than the slots")
    if table_size < 2 or any(table_size % i == 0 for i in range(2, int(table_size**0.5) + 1)):
        raise ValueError("the table's size must be a prime")
    order = sorted(range(len(shards)), key=lambda i: shards[i])
    names = [shards[i].encode() for i in order]
    wanted = [zlib.crc32(b"start:" + x) % table_size for x in names]
    steps = [zlib.crc32(b"step:" + x) % (table_size - 1) + 1 for x in names]
    table, left = [-1] * table_size, table_size
    while left:
        for turn, shard in enumerate(order):
            slot = wanted[turn]
            while table[slot] >= 0:
                slot = (slot + steps[turn]) % table_size
            table[slot] = shard
            wanted[turn] = (slot + steps[turn]) % table_size
            left -= 1
            if not left:
                break
    return table


def lookup_table(spark: SparkSession, shards: Sequence[str] = SHARDS, table_size: int = TABLE_SIZE) -> DataFrame:
    """``slot, shard``: one row per slot."""
    packed = F.split(F.lit(",".join(map(str, fill_table(shards, table_size)))), ",")
    names = F.array(*map(F.lit, shards))
    slots = spark.range(1).select(F.posexplode(packed).alias("slot", "number"))
    return slots.select("slot", F.get(names, F.col("number").cast("int")).alias("shard"))


def slot_of(key: Column, table_size: int = TABLE_SIZE) -> Column:
    """The slot of a key: the first 60 bits of the MD5 of its text, modulo the table's size."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(table_size)).cast("int")


def place(
    rows: DataFrame,
    key_col: str,
    shards: Sequence[str] = SHARDS,
    table_size: int = TABLE_SIZE,
    slot_col: str = "slot",
    shard_col: str = "shard",
) -> DataFrame:
    """The rows with ``slot_col`` and ``shard_col``; no row is shuffled."""
    table = lookup_table(rows.sparkSession, shards, table_size)
    own = F.struct(*(rows[c] for c in rows.columns if c not in (slot_col, shard_col)))
    keyed = rows.select(own.alias("own"), slot_of(rows[key_col], table_size).alias("at"))
    placed = keyed.join(F.broadcast(table), F.col("at") == F.col("slot"), "left")
    return placed.select("own.*", F.col("slot").alias(slot_col), F.col("shard").alias(shard_col))


def write_shards(placed: DataFrame, path: str, tasks_per_shard: int = 4, shard_col: str = "shard") -> None:
    """Parquet folders, one per shard. The rows of a shard are spread over up to ``tasks_per_shard`` writers."""
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(tasks_per_shard))
    placed.repartition(F.col(shard_col), salt).write.partitionBy(shard_col).parquet(path)
