"""Consistent placement of rows on shards by a permutation-filled lookup table.

Each shard has its own preference order over the slots of a table of prime size; the shards take turns, and in its
turn a shard claims the first slot of its order that is still free. A row goes to the shard that owns slot
``hash(key) mod size``. The table depends on the shard names alone (its size is a parameter, so it has a fixed bound)
and reaches the executors as one literal array inside the plan: placing a row is one hash and one array access, with
no join, shuffle or Python. When a shard leaves, only its rows and a small share of the others move.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_SIZE = 65_537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], size: int = DEFAULT_SIZE, weights: dict[str, int] | None = None) -> list[int]:
    """Owner (index into ``shards``) of each of ``size`` slots.

    A shard of weight w claims w slots a turn (default 1). Names must be distinct, ``size`` prime and at least as
    large as the number of shards; else ValueError.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and not empty")
    if not _is_prime(size) or size < len(shards):
        raise ValueError("size must be a prime, and no smaller than the number of shards")
    offsets, skips = [], []
    for name in shards:
        digest = hashlib.sha256(name.encode()).digest()
        offsets.append(int.from_bytes(digest[:8], "big") % size)
        skips.append(int.from_bytes(digest[8:16], "big") % (size - 1) + 1)
    owner, turn, free = [-1] * size, [0] * len(shards), size
    while free:
        for i, name in enumerate(shards):
            for _ in range((weights or {}).get(name, 1)):
                if not free:
                    break
                slot = (offsets[i] + turn[i] * skips[i]) % size
                while owner[slot] >= 0:
                    turn[i] += 1
                    slot = (offsets[i] + turn[i] * skips[i]) % size
                owner[slot] = i
                turn[i] += 1
                free -= 1
    return owner


def slot_of(keys: list[Column], size: int = DEFAULT_SIZE) -> Column:
    """Slot 0..size-1 of a key, from its SHA-256. Nulls have a slot of their own spelling, apart from empty strings."""
    spelled = F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), k.cast("string")), F.lit("~")) for k in keys])
    head = F.conv(F.substring(F.sha2(spelled, 256), 1, 15), 16, 10).cast("long")
    return F.pmod(head, F.lit(size)).cast("int")


def place(df: DataFrame, keys: list[str], shards: list[str], size: int = DEFAULT_SIZE, weights: dict[str, int] | None = None, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """``df`` with the slot and the shard of each row.

    Every row is placed, repeated rows alike; null keys are keys like any other; an empty table stays empty. Columns
    of ``df`` named like the two new ones are replaced. Where one key holds much of the rows, name a second, finer key
    column as well, as the operator never splits a key over shards.
    """
    owner = lookup_table(shards, size, weights)
    names = F.split(F.lit("\x1f".join(shards)), "\x1f")
    owners = F.split(F.lit(",".join(map(str, owner))), ",")  # folded by the optimiser into one literal array
    slot = slot_of([F.col(k) for k in keys], size)
    kept = df.drop(*[c for c in (slot_col, shard_col) if c not in keys])
    return kept.withColumn(slot_col, slot).withColumn(shard_col, F.element_at(names, F.element_at(owners, F.col(slot_col) + 1).cast("int") + 1))


def shard_balance(placed: DataFrame, weight: Column | None = None, shard_col: str = "shard") -> DataFrame:
    """Rows (and summed weight, if given) of each shard."""
    return placed.groupBy(shard_col).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(weight if weight is not None else F.lit(1)).alias("weight"))


def write_shards(placed: DataFrame, path: str, files_per_shard: int = 8, shard_col: str = "shard") -> None:
    """One folder a shard. Rows of a shard are spread over ``files_per_shard`` tasks, so a large shard is no single task's work."""
    salt = F.pmod(F.xxhash64(*placed.columns), F.lit(files_per_shard))
    placed.withColumn("_salt", salt).repartition(shard_col, "_salt").drop("_salt").write.partitionBy(shard_col).parquet(path)
