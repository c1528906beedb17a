"""Sharding by a permutation-filled lookup table.

Every shard has its own preference order of the slots of a prime-sized table: it starts at ``offset`` and goes on by
``skip``, both hashed from its name. The shards take turns, each claiming its next slot that is still free, until the
table is full, so shares differ by one slot per unit of weight at most, and a shard that leaves moves few
other slots. A row's key is hashed to a slot; the table, whose size is a parameter and not that of the data, is
broadcast, so placing a row is one lookup and shuffles nothing, however often a key repeats.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots: a prime, at least a hundred times the shards so that shares stay within one in a hundred.
SIZE = 65_537
#: The table is broadcast; more slots than this are refused.
MOST = 1 << 20


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill(shards: list[str], size: int = SIZE, weights: list[int] | None = None) -> list[int]:
    """The shard (its place in ``shards``) of each slot; a shard of weight w claims w slots a turn.

    ValueError for no shards, repeated names, a size that is not prime, below the number of shards or
    above MOST, or weights that aren't positive.
    """
    weights = weights or [1] * len(shards)
    if not shards or len(set(shards)) < len(shards) or len(weights) != len(shards) or min(weights) < 1:
        raise ValueError("shards must be distinct names, with one positive weight each")
    if not is_prime(size) or not len(shards) <= size <= MOST:
        raise ValueError(f"the table size must be a prime from {len(shards)} to {MOST}")
    at = [xxhash.xxh64_intdigest(s, 1) % size for s in shards]
    skip = [xxhash.xxh64_intdigest(s, 2) % (size - 1) + 1 for s in shards]
    table, left = [-1] * size, size
    while left:
        for i, weight in enumerate(weights):
            for _ in range(min(weight, left)):
                while table[at[i]] >= 0:
                    at[i] = (at[i] + skip[i]) % size
                table[at[i]] = i
                left -= 1
    return table


def names(n: int) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def lookup(spark: SparkSession, shards: list[str], size: int = SIZE, weights: list[int] | None = None) -> DataFrame:
    """(slot, shard): the filled table."""
    return spark.createDataFrame(list(enumerate(fill(shards, size, weights))), "slot int, shard int")


def place(rows: DataFrame, key: str, shards: list[str], size: int = SIZE, weights: list[int] | None = None) -> DataFrame:
    """Add ``slot`` and ``shard`` (its place in ``shards``) to every row.

    Rows of one key share a shard; null is a key like any other. An empty table stays empty. Other columns stay;
    ValueError if ``rows`` already has a column slot or shard.
    """
    clash = {"slot", "shard"} & {c.lower() for c in rows.columns}
    if clash:
        raise ValueError(f"rows already have columns {sorted(clash)}")
    slot = F.pmod(F.xxhash64(F.col(f"`{key}`").cast("string")), F.lit(size)).cast("int")
    # at most MOST rows of two integers
    return rows.withColumn("slot", slot).join(F.broadcast(lookup(rows.sparkSession, shards, size, weights)), "slot").select(*[F.col(f"`{c}`") for c in rows.columns], "slot", "shard")


def write(placed: DataFrame, path: str, files: int = 4) -> None:
    """Write placed rows as Parquet, a folder for each shard of up to ``files`` files, so that a hot shard is written by several tasks."""
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in placed.columns]), F.lit(files))
    placed.withColumn("__salt", salt).repartition("shard", "__salt").drop("__salt").write.partitionBy("shard").parquet(path)
