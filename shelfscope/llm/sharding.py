"""Sharding by a permutation-filled lookup table.

Every shard walks the slots of a prime-sized table in an order of its own (an offset
and a step drawn from its name, which with a prime size visit each slot once). The
shards take turns; at its turn a shard claims the next slot of its order that is still
free. The filled table has between floor(M/N) and ceil(M/N) slots for each shard, and
losing a shard moves few slots of the others. A row's place is one hash and one look-up.

The table has ``size`` rows whatever the input (a parameter, 65,537 by default: a few
hundred KB), so it is broadcast; rows are placed where they are, without a shuffle, so
hot keys, long texts and groups of copies make no difference.

Defined results: a null key hashes as the empty text; equal keys get the same shard;
an empty table gives an empty result; columns of the input that the result needs are
taken by name, others are carried through by ``place`` under their own names.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.llm.common import id_text, table

SIZE = 65_537
SHARDS = tuple(f"shard-{i:04d}" for i in range(256))


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n ** 0.5) + 1))


def lookup(shards: tuple[str, ...] = SHARDS, size: int = SIZE) -> np.ndarray:
    """Slot -> index of its shard in ``shards``."""
    if not is_prime(size):
        raise ValueError(f"the table's size must be prime, not {size}")
    if not 0 < len(shards) <= size or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct names, one at least and no more than slots")
    offset = [xxhash.xxh3_64_intdigest(s, seed=1) % size for s in shards]
    step = [1 + xxhash.xxh3_64_intdigest(s, seed=2) % (size - 1) if size > 2 else 1 for s in shards]
    taken = np.full(size, -1, np.int32)
    at = list(offset)
    left = size
    while left:
        for k in range(len(shards)):
            while taken[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % size
            taken[at[k]] = k
            left -= 1
            if not left:
                break
    return taken


def slot(key: Column, size: int = SIZE) -> Column:
    """The slot of a key: the first 60 bits of its text's MD5, modulo the size."""
    return (F.conv(F.substring(F.md5(id_text(key).cast("binary")), 1, 15), 16, 10).cast("long") % size).cast("int")


def lookup_table(spark: SparkSession, shards: tuple[str, ...] = SHARDS, size: int = SIZE) -> DataFrame:
    names = np.array(shards, object)[lookup(shards, size)]
    return spark.createDataFrame([(i, n) for i, n in enumerate(names)], "slot int, shard string")


def place(df: DataFrame, key: str, shards: tuple[str, ...] = SHARDS, size: int = SIZE,
          slot_column: str = "slot", shard_column: str = "shard") -> DataFrame:
    """``df`` with the slot and the shard of each row; a column of ``df`` that has one
    of the two names gives way to it."""
    t = lookup_table(df.sparkSession, shards, size).select(
        F.col("slot").alias("__slot"), F.col("shard").alias("__shard"))
    kept = [F.col(f"`{c}`") for c in df.columns if c not in (slot_column, shard_column)]
    d = df.select(*kept, slot(F.col(f"`{key}`"), size).alias("__place"))
    return (d.join(F.broadcast(t), F.col("__place") == F.col("__slot"))
            .select(*kept, F.col("__slot").alias(slot_column), F.col("__shard").alias(shard_column)))


def write_shards(df: DataFrame, key: str, path: str, shards: tuple[str, ...] = SHARDS, size: int = SIZE,
                 files_per_shard: int = 1) -> None:
    """Write ``df`` as Parquet in one folder for each shard. Rows of a shard are dealt
    over ``files_per_shard`` tasks by a hash of the whole row's key and position, so a
    key that holds a third of the rows can be spread."""
    d = place(df, key, shards, size)
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(files_per_shard))
    d.repartition(len(shards) * files_per_shard, F.col("shard"), salt).write.partitionBy("shard").parquet(path)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's slot and shard."""
    return place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
