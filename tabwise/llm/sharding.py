"""Sharding by fixed virtual slots and a versioned slot map.

A record's id hashes to one of 4096 slots for good; a small versioned table says which shard owns a slot. Adding a
shard or moving load is an edit of that table, written as a new version: records of slots that were not edited never
move. Rows and bytes are aggregated per slot, so a rebalance is decided on 4096 numbers however large the corpus is.

The map for a number of shards follows from that number alone (built by adding one shard at a time, each taking an
equal part of its slots from every older shard), hence id and shard count decide where a record lies.

Positions inside a shard need no window over a whole shard: rows are numbered within (slot, part) cells, where the
part comes from the text's checksum and splits a slot that one id fills; cell offsets come from the cell counts.

Defined results: a null id is an id like any other; null text has size 1 and checksum 0; repeated rows get positions
of their own; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabwise.session import cut_lineage

SLOTS = 4096
PARTS = 64


def slot_of(id_col: str, slots: int = SLOTS):
    return F.pmod(F.xxhash64(F.col(id_col)), F.lit(slots)).cast("int")


def first_map(shards: int, slots: int = SLOTS) -> list[int]:
    """Owner of each slot for this many shards."""
    if not 1 <= shards <= slots:
        raise ValueError(f"between 1 and {slots} shards")
    owners = [0] * slots
    for _ in range(1, shards):
        owners = add_shard(owners)
    return owners


def add_shard(owners: list[int]) -> list[int]:
    """A new version of the map in which one more shard takes its even part from the fullest older ones."""
    held = Counter(owners)
    new, out = len(held), list(owners)
    own: dict[int, list[int]] = {}
    for slot, shard in enumerate(owners):
        own.setdefault(shard, []).append(slot)
    for _ in range(len(owners) // (new + 1)):
        giver = max(own, key=lambda s: (len(own[s]), -s))
        out[own[giver].pop()] = new
    return out


def rebalance(owners: list[int], load: dict[int, int], tolerance: float = 0.02) -> list[int]:
    """A new version in which slots moved from the heaviest to the lightest shard until both are within ``tolerance``
    of the mean or no move narrows the gap. ``load``: bytes per slot."""
    out = list(owners)
    total = Counter({s: 0 for s in out})
    for slot, shard in enumerate(out):
        total[shard] += load.get(slot, 0)
    mean = sum(total.values()) / len(total)
    for _ in range(len(out)):
        high, low = max(total, key=lambda s: (total[s], s)), min(total, key=lambda s: (total[s], s))
        gap = total[high] - total[low]
        if gap <= 2 * tolerance * mean:
            break
        moves = [s for s, shard in enumerate(out) if shard == high and 0 < load.get(s, 0) < gap]
        if not moves:
            break
        slot = min(moves, key=lambda s: (abs(gap - 2 * load[s]), s))
        out[slot] = low
        total[high] -= load[slot]
        total[low] += load[slot]
    return out


def stored_map(spark: SparkSession, versions: list[list[int]]) -> DataFrame:
    """(version, vslot, shard), versions from 1, written to the shared folder."""
    rows = [(v, s, shard) for v, owners in enumerate(versions, 1) for s, shard in enumerate(owners)]
    return cut_lineage(spark.createDataFrame(rows, "version int, vslot int, shard int"))


def slot_load(records: DataFrame) -> DataFrame:
    """(vslot, n_rows, n_bytes) of records that carry vslot and size."""
    return records.groupBy("vslot").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("n_bytes"))


def records_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, vslot, part)."""
    checksum = F.coalesce(F.crc32(F.col(text_col)), F.lit(0)).cast("bigint")
    return docs.select(
        id_col,
        (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 1).cast("bigint").alias("size"),
        checksum.alias("text_crc32"),
        slot_of(id_col).alias("vslot"),
        F.pmod(F.xxhash64(checksum), F.lit(PARTS)).cast("int").alias("part"),
    )


def place(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document with its shard, its position there, the shard it has once one more shard joins, its virtual
    slot and the bytes of that slot."""
    spark = docs.sparkSession
    now = first_map(shards)
    owners = stored_map(spark, [now, add_shard(now)])
    current = owners.filter("version = 1").select("vslot", "shard")
    grown = owners.filter("version = 2").select("vslot", F.col("shard").alias("grown_shard"))
    records = cut_lineage(records_of(docs, id_col, text_col))

    cells = records.groupBy("vslot", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"))
    before = Window.partitionBy("shard").orderBy("vslot", "part").rowsBetween(Window.unboundedPreceding, -1)
    whole_slot = Window.partitionBy("shard", "vslot")
    offsets = (
        cells.join(F.broadcast(current), "vslot")  # 4096 rows
        .join(F.broadcast(grown), "vslot")
        .withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("slot_bytes", F.sum("b").over(whole_slot))
        .select("vslot", "part", "shard", "grown_shard", "base", "slot_bytes")
    )
    # repeated rows travel as one row with their number
    alike = records.groupBy("vslot", "part", id_col, "text_crc32", "size").agg(F.count(F.lit(1)).alias("copies"))
    ahead = Window.partitionBy("vslot", "part").orderBy(id_col, "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    numbered = alike.withColumn("ahead", F.coalesce(F.sum("copies").over(ahead), F.lit(0)))
    return (
        numbered.join(offsets, ["vslot", "part"])
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)))
        .select(
            id_col, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("base") + F.col("ahead") + F.col("copy")).alias("slot"), "grown_shard",
            F.col("vslot").alias("virtual_slot"), "slot_bytes",
        )
    )
