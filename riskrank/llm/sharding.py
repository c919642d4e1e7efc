"""Shard placement by a permutation-filled lookup table (Maglev hashing).

Every shard has its own preference order over the slots of a prime-sized table.
Shards take turns (a shard of weight w takes w slots a turn) claiming the next free
slot of their order until the table is full. A row's key hashes to a slot; a broadcast
join with the table gives its shard in constant time, without moving the rows. Adding
or removing one shard moves few keys.

The table has ``size`` rows, a parameter that does not depend on the data, which bounds
both the driver-side fill and the broadcast. Rows are hashed with SQL functions only.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prime; at least a hundred slots a shard keeps loads within about one percent.
TABLE_SIZE = 2053
MAX_TABLE = 1_000_003


def _h(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def key_hash(key: Column) -> Column:
    """The first 60 bits of the key's MD5 (of its text form; null like an empty key)."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def fill_table(shards: list[tuple[str, int]], size: int = TABLE_SIZE) -> list[str]:
    """The lookup table: the shard of every slot. ``shards``: (name, weight > 0)."""
    if not shards or len({n for n, _ in shards}) != len(shards) or min(w for _, w in shards) < 1:
        raise ValueError("shards need distinct names and weights of 1 or more")
    if size > MAX_TABLE or size < 2 or any(size % d == 0 for d in range(2, int(size ** 0.5) + 1)):
        raise ValueError(f"the table size must be a prime up to {MAX_TABLE}")
    shards = sorted(shards)
    offset = [_h(f"offset:{name}") % size for name, _ in shards]
    skip = [_h(f"skip:{name}") % (size - 1) + 1 for name, _ in shards]
    at = [0] * len(shards)
    table: list[str | None] = [None] * size
    turns = [i for i, (_, weight) in enumerate(shards) for _ in range(weight)]
    for claim in range(size):
        i = turns[claim % len(turns)]
        while table[(slot := (offset[i] + at[i] * skip[i]) % size)] is not None:
            at[i] += 1
        table[slot] = shards[i][0]
    return table


def lookup_frame(spark: SparkSession, shards: list[tuple[str, int]], size: int = TABLE_SIZE) -> DataFrame:
    """The table as rows ``(slot, shard)``; ``size`` rows."""
    return spark.createDataFrame(list(enumerate(fill_table(shards, size))), "slot int, shard string")


def place(df: DataFrame, key: str, shards: list[tuple[str, int]], size: int = TABLE_SIZE,
          slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """``df`` with its slot and shard by ``key``.

    Rows with the same key go to the same shard; a null key is placed like an empty one.
    Input columns called ``slot_col`` or ``shard_col`` are replaced. Empty in, empty out."""
    keep = [F.col(f"`{c}`") for c in df.columns if c.lower() not in (slot_col.lower(), shard_col.lower())]
    slot = (key_hash(F.col(f"`{key}`")) % size).cast("int")
    table = lookup_frame(df.sparkSession, shards, size) \
        .select(F.col("slot").alias("__slot"), F.col("shard").alias("__shard"))
    rows = df.select(F.struct(*keep).alias("__row"), slot.alias("__at"))
    return rows.join(F.broadcast(table), F.col("__at") == F.col("__slot")) \
               .select("__row.*", F.col("__at").alias(slot_col), F.col("__shard").alias(shard_col))


def shard_loads(placed: DataFrame, shard_col: str = "shard") -> DataFrame:
    """Rows of each shard."""
    return placed.groupBy(shard_col).agg(F.count(F.lit(1)).alias("n_rows"))


def write_shards(placed: DataFrame, path: str, shard_col: str = "shard", files: int = 1) -> None:
    """Write one folder a shard. ``files`` spreads each shard over so many tasks, so that
    no shard has to pass through one task."""
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in placed.columns]), F.lit(files))
    placed.repartition(shard_col, spread).write.partitionBy(shard_col).parquet(path)
