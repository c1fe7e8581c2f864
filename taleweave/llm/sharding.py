"""Shard placement by a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size: slot (offset + k * skip) mod size for
k = 0, 1, ... The shards take turns; at its turn a shard claims the first slot of its order that is still free. All
shards end within one slot of each other, and when a shard leaves, most slots keep their owner. A document hashes to a
slot and the slot names the shard.

The table has a fixed number of rows (SLOTS, whatever the data), which is the proof that its broadcast is bounded. Null
doc_id goes to slot 0; repeated ids go to the same shard; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A prime; at 64 shards each holds over a thousand slots, so shares differ by less than 0.1 %.
SLOTS = 65_537
#: Rows of a file of a shard, about.
ROWS_A_FILE = 20_000


def _number(text: str) -> int:
    return int(hashlib.sha256(text.encode()).hexdigest()[:12], 16)


def fill_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """Owner (index into shards) of every slot."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct names, at least one and no more than there are slots")
    at = [_number(f"at:{s}") % slots for s in shards]
    skip = [1 + _number(f"skip:{s}") % (slots - 1) if slots > 1 else 1 for s in shards]
    owner, free = [-1] * slots, slots
    while free:
        for s in range(len(shards)):
            while owner[at[s]] >= 0:
                at[s] = (at[s] + skip[s]) % slots
            owner[at[s]] = s
            free -= 1
            if not free:
                break
    return owner


def table_frame(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """slot, shard, shard_name: exactly `slots` rows."""
    rows = spark.range(1).select(F.posexplode(F.from_json(F.lit(json.dumps(fill_table(shards, slots))), "array<int>")).alias("slot", "shard"))
    names = F.from_json(F.lit(json.dumps(shards)), "array<string>")
    return rows.withColumn("shard_name", F.element_at(names, F.col("shard") + 1))


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The first 12 hex digits of md5(key as text), modulo the table size; null goes to 0."""
    digits = F.substring(F.md5(key.cast("string").cast("binary")), 1, 12)
    return F.coalesce((F.conv(digits, 16, 10).cast("long") % slots).cast("int"), F.lit(0))


def place(rows: DataFrame, shards: list[str], key: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """rows with slot, shard and shard_name; columns of those names that rows already has are replaced."""
    table = table_frame(rows.sparkSession, shards, slots)
    kept = [c for c in rows.columns if c not in ("slot", "shard", "shard_name")]
    return rows.select(*kept).withColumn("slot", slot_of(F.col(key), slots)).join(F.broadcast(table), "slot").select(*kept, "slot", "shard", "shard_name")


def write_shards(rows: DataFrame, path: str, shards: list[str], key: str = "doc_id", rows_a_file: int = ROWS_A_FILE) -> DataFrame:
    """Writes whole rows, with slot and shard, to one folder per shard, and returns them as they are read from there. Rows are
    dealt by shard and part; there are as many parts as make files of about rows_a_file rows, so files stay of one size as
    the table grows and no task holds a shard. The part follows the row's place in the input, so that rows which repeat a
    key spread as well."""
    placed = place(rows, shards, key)
    parts = max(1, -(-rows.count() // (len(shards) * rows_a_file)))
    part = F.pmod(F.monotonically_increasing_id(), F.lit(parts))
    placed.withColumn("__part", part).repartition("shard", "__part").drop("__part").write.partitionBy("shard_name").parquet(path)
    return rows.sparkSession.read.schema(placed.schema).parquet(path)
