"""Sharding by a permutation-filled lookup table.

Each shard has its own permutation of a prime number of slots, from two hashes of its name.  Shards take turns; at its turn a shard
claims the first free slot of its permutation.  A document's key hashes to a slot, the slot names the shard: constant time, near-even
shares, and few documents move when a shard joins or leaves.  The table's size is a parameter, so its broadcast is bounded.
"""
from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

from panelquant.llm.common import fresh_path

#: Fixed value: a prime, some hundred times the usual number of shards.
SLOTS = 65537


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n ** 0.5) + 1))


def preferences(name: str, slots: int) -> tuple[int, int]:
    """Start and step of a shard's permutation: slot of its j-th choice is (start + j * step) mod slots."""
    h = hashlib.sha256(name.encode()).digest()
    return int.from_bytes(h[:8], "big") % slots, int.from_bytes(h[8:16], "big") % (slots - 1) + 1


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """Index of the owning shard for each slot.  Names must differ and be no more than the slots; slots must be prime."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards need distinct names, at least one and at most one per slot")
    if not is_prime(slots):
        raise ValueError("the number of slots must be prime")
    choice = [list(preferences(s, slots)) for s in shards]
    owner, left = [-1] * slots, slots
    while True:
        for k, c in enumerate(choice):
            while owner[c[0]] >= 0:
                c[0] = (c[0] + c[1]) % slots
            owner[c[0]] = k
            left -= 1
            if not left:
                return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key; null counts as a key of its own."""
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit(""))), F.lit(slots)).cast("int")


def place(docs: DataFrame, shards: list[str], key: str = "doc_id", slots: int = SLOTS, shard: str = "shard", slot: str | None = None) -> DataFrame:
    """docs with their shard's name (and slot, if a column name is given); columns of these names are replaced.  No shuffle.

    Rows with the same key, null too, share a shard; a key that holds many rows belongs to one shard by contract, but its rows stay in the
    partitions they came in.  Empty tables stay empty.
    """
    table = docs.sparkSession.createDataFrame(list(enumerate(shards[k] for k in lookup_table(shards, slots))), "_slot int, _shard string")
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), slot_of(docs[f"`{key}`"], slots).alias("_slot"))  # no name of docs can clash
    new = {shard: F.col("_shard"), **({slot: F.col("_slot")} if slot else {})}
    placed = rows.join(F.broadcast(table), "_slot")
    return placed.select(*[new.pop(c).alias(c) if c in new else placed["row"].getField(c).alias(c) for c in docs.columns], *[c.alias(n) for n, c in new.items()])


def write_shards(docs: DataFrame, shards: list[str], key: str = "doc_id", slots: int = SLOTS, spread: int = 8, path: str | None = None) -> str:
    """Writes one folder per shard; each shard's rows go through `spread` tasks, so a hot key does not fill one task.  Returns the folder."""
    path = path or fresh_path(docs.sparkSession, "shards")
    placed = place(docs, shards, key, slots, "shard")
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(spread))
    placed.repartition(len(shards) * spread, "shard", salt).write.partitionBy("shard").parquet(path)
    return path
