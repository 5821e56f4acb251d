"""Sharding by a permutation-filled lookup table.

Each shard has its own permutation of a prime number of slots, from two hashes of
its name. Shards take turns, and in its turn a shard claims the first slot of its
permutation that is still free, until the table is full. A document's slot is a hash
of its doc_id; the table, whose size is a parameter and not that of the data, goes
with the plan as a literal, so that placement is one array access without a shuffle.
Shards get equal shares of slots (within one), and adding or removing a shard moves
little beyond its own share.

Defined results: null doc_id is placed as the empty string; repeated rows go to the
same shard; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 65537
SHARDS = 64


def _hash(name: str, use: str) -> int:
    return int.from_bytes(hashlib.md5(f"{use}:{name}".encode()).digest()[:8], "big")


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The number of the shard that owns each slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names, and one at least")
    if not _is_prime(slots) or slots < len(shards):
        raise ValueError("the number of slots must be a prime and at least the number of shards")
    offset = [_hash(s, "offset") % slots for s in shards]
    skip = [_hash(s, "skip") % (slots - 1) + 1 if slots > 2 else 1 for s in shards]
    at, owner, filled = [0] * len(shards), [-1] * slots, 0
    while True:
        for k in range(len(shards)):
            slot = (offset[k] + at[k] * skip[k]) % slots
            while owner[slot] >= 0:
                at[k] += 1
                slot = (offset[k] + at[k] * skip[k]) % slots
            owner[slot] = k
            at[k] += 1
            filled += 1
            if filled == slots:
                return owner


def shard_names(count: int = SHARDS) -> list[str]:
    return [f"shard-{k:05d}" for k in range(count)]


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % slots


def place(docs: DataFrame, shards: list[str] | None = None, slots: int = SLOTS, name: str = "shard") -> DataFrame:
    """docs with a column (`name`, or one with underscores where docs has it) of shard numbers."""
    table = fill_table(shards or shard_names(), slots)
    while name in docs.columns:
        name += "_"
    owners = F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>")  # folded to one literal by the optimizer
    return docs.withColumn(name, F.get(owners, slot_of(F.col("doc_id"), slots).cast("int")))


def oracle_table() -> str:
    return "[" + ",".join(map(str, fill_table(shard_names()))) + "]"


ORACLE_SLOT = "(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % 65537)"
