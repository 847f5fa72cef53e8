"""Shards by a permutation-filled lookup table of prime size."""

from __future__ import annotations

from collections.abc import Iterable
from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shards and slots of the registered table: a prime more than a hundred times the number of shards.
SHARDS, SLOTS = 32, 4099
#: Slots that a broadcast table may have; a row of it takes two dozen bytes.
MOST_SLOTS = 1_000_003
#: Factors of the preference order, and of the placement of keys.
OFFSET_FACTOR, SKIP_FACTOR, KEY_FACTOR = 40_503, 69_069, 48_271


def preference(shard: int, slots: int) -> tuple[int, int]:
    """First slot and step of a shard's order of preference; a step below a prime visits every slot once."""
    return (shard + 1) * OFFSET_FACTOR % slots, (shard + 1) * SKIP_FACTOR % (slots - 1) + 1


def filled(shards: Iterable[int], slots: int = SLOTS) -> list[int]:
    """The shard of each slot: in turns, each shard claims the slot it likes best of those still free.

    Shares differ by at most one slot, and a shard that leaves or joins moves
    few slots of the others. The table is as large as the prime, whatever the
    data are.
    """
    names = list(shards)
    if not names or len(set(names)) != len(names) or min(names) < 0:
        raise ValueError("shards are distinct numbers from 0")
    if not len(names) <= slots <= MOST_SLOTS or slots < 2 or any(slots % d == 0 for d in range(2, isqrt(slots) + 1)):
        raise ValueError("the number of slots is a prime, at least the number of shards")
    table = [-1] * slots
    orders = [preference(s, slots) for s in names]
    claims = [0] * len(names)
    free = slots
    while free:
        for i, (first, step) in enumerate(orders[: min(len(orders), free)]):
            while table[at := (first + claims[i] * step) % slots] >= 0:
                claims[i] += 1
            table[at] = names[i]
            free -= 1
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of an integer key, whole numbers only; null keys take slot 0."""
    spread = F.pmod(key.cast("long"), F.lit(slots * 1000)) * F.lit(KEY_FACTOR)
    return F.coalesce(F.pmod(spread + F.pmod(F.shiftright(key.cast("long"), 16), F.lit(slots)), F.lit(slots)), F.lit(0)).cast("long")


def sharded(rows: DataFrame, key: str, shards: Iterable[int] = range(SHARDS), slots: int = SLOTS) -> DataFrame:
    """Rows with ``slot`` and ``shard``: the key's slot looked up in the broadcast table.

    Columns of those names are replaced. Placement depends on the key alone:
    rows that repeat fall together and null keys take slot 0. No row is
    shuffled, so no key or group can be too large; an empty table stays empty.
    """
    table = filled(shards, slots)
    spark = rows.sparkSession
    lookup = spark.sql("select posexplode(array(" + ",".join(map(str, table)) + ")) as (slot, shard)").select(F.col("slot").cast("long").alias("slot"), F.col("shard").cast("int").alias("shard"))
    kept = [c for c in rows.columns if c not in ("slot", "shard")]
    placed = rows.select(*kept, slot_of(F.col(key), slots).alias("slot"))
    return placed.join(F.broadcast(lookup), "slot").select(*kept, "slot", "shard")
