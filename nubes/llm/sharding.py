"""Sharding by a permutation-filled lookup table.

Each shard has its own permutation of a prime-sized table (offset and skip
from its name's hash) and the shards take turns claiming the next free slot of
their permutation, until the table is full. A row's shard is the table's entry
at its key's hash modulo the size: one probe of a broadcast table whose size is
the fixed prime. Adding or removing a shard moves few other slots.

Defined cases: a null key hashes like any other value, to one fixed slot;
equal keys go to equal shards unless ``salt`` spreads them; an empty table
gives an empty result; ``slot`` and the columns named by the caller replace
columns of ``df`` with these names, and the key may be one of them.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

TABLE_SIZE = 65537  # a prime; about 100 times the shards or more keeps shares even


def fill_table(shards: list[str], size: int = TABLE_SIZE, weights: list[int] | None = None) -> np.ndarray:
    """The table: at each slot the index of the shard that claimed it. With
    weights, shard i claims weights[i] slots in each of its turns."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct names, one at least")
    if size < len(shards) or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("size must be a prime not below the number of shards")
    turns = weights or [1] * len(shards)
    if len(turns) != len(shards) or min(turns) < 1:
        raise ValueError("one weight of at least 1 for each shard")
    pref = []
    for s in shards:
        d = hashlib.sha256(s.encode()).digest()
        pref.append((int.from_bytes(d[:8], "big") % size, int.from_bytes(d[8:16], "big") % (size - 1) + 1))
    table, nxt, left = np.full(size, -1, np.int32), [0] * len(shards), size
    while left:
        for i, (offset, skip) in enumerate(pref):
            for _ in range(turns[i]):
                if not left:
                    break
                while table[slot := (offset + nxt[i] * skip) % size] >= 0:
                    nxt[i] += 1
                table[slot] = i
                nxt[i] += 1
                left -= 1
    return table


def slot_of(key, size: int = TABLE_SIZE, salt=None, spread: int = 1):
    """The slot of a key column. With a salt column, the rows of one key take
    up to ``spread`` slots, so that a hot key is not bound to one shard."""
    if salt is None or spread <= 1:
        return F.pmod(F.xxhash64(key), F.lit(size))
    return F.pmod(F.xxhash64(key, F.pmod(F.xxhash64(salt), F.lit(spread))), F.lit(size))


def assign_shards(df: DataFrame, key: str, tables: dict[str, np.ndarray], salt: str | None = None, spread: int = 1) -> DataFrame:
    """Add ``slot`` and, for each named table, the shard it gives. The tables
    have TABLE_SIZE rows or another fixed prime, so they are broadcast."""
    size = len(next(iter(tables.values())))
    at = fresh(df, "place")[0]
    rows = df.sparkSession.createDataFrame([(i, *map(int, x)) for i, x in enumerate(zip(*tables.values(), strict=True))], f"{at} long, " + ", ".join(f"`{n}` int" for n in tables))
    slot = slot_of(F.col(key), size, F.col(salt) if salt else None, spread)
    kept = df.withColumn(at, slot.cast("long")).drop("slot", *tables)
    return kept.join(F.broadcast(rows), at).withColumnRenamed(at, "slot")


def write_sharded(df: DataFrame, path: str, shard: str = "shard") -> None:
    """One folder of Parquet files per shard; tasks write without a shuffle."""
    df.write.partitionBy(shard).parquet(path)
