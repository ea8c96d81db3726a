"""Sharding over fixed virtual slots.

Records are hashed into thousands of virtual slots. Bytes are summed per slot, and
a versioned slot-to-shard map says where each slot lives. All versions are stored in
one home folder. The first deals the slots out in turn; from then on the map is only
edited: rebalancing moves the slots that the measured bytes ask for and stores the next
version, and no record is hashed anew. A later run loads the newest version and edits it
only where shards have drifted from the mean by more than the tolerance.

Everything on the records is DataFrame code. The driver sees one row per slot, so
never more than `n_slots` rows however large the input is.

Defined cases: a null text has 0 bytes and counts as 8; a null doc_id is hashed as
null with its text; a text of any length is one record of one slot, and a shard that holds
a record above the mean keeps little else; repeated rows take neighbouring positions in one
slot; an empty table gives an empty result; other columns of the input, whatever their
names, are ignored.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.files import exists
from .common import fresh_path

N_SLOTS = 4096
ROW_BYTES = 8
#: Shards may differ from the mean by this share of it.
TOLERANCE = 0.0005
MAP_SCHEMA = "version int, n_shards int, vslot int, shard int, bytes long, rows long, first long"


@dataclass(frozen=True)
class SlotMap:
    """Slot v lives in shard[v]; bytes and rows are what the slot held when mapped."""

    version: int
    n_shards: int
    shard: tuple[int, ...]
    bytes: tuple[int, ...]
    rows: tuple[int, ...]

    def loads(self) -> list[int]:
        out = [0] * self.n_shards
        for s, b in zip(self.shard, self.bytes, strict=True):
            out[s] += b
        return out

    def frame(self, spark: SparkSession) -> DataFrame:
        """The map as a table; first: rows of the shard in lower slots."""
        seen, rows = [0] * self.n_shards, []
        for v, (s, b, n) in enumerate(zip(self.shard, self.bytes, self.rows, strict=True)):
            rows.append((self.version, self.n_shards, v, s, b, n, seen[s]))
            seen[s] += n
        return spark.createDataFrame(rows, MAP_SCHEMA)


def slotted(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and vslot of each row."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.pmod(F.xxhash64("doc_id", text), F.lit(n_slots)).cast("int").alias("vslot"),
    )


def slot_loads(rows: DataFrame, n_slots: int = N_SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows per slot: at most n_slots rows come to the driver."""
    size, count = [0] * n_slots, [0] * n_slots
    for r in rows.groupBy("vslot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
        size[r.vslot], count[r.vslot] = r.b, r.n
    return size, count


def first_map(n_slots: int, n_shards: int) -> SlotMap:
    """Version 1, before any load is known: slots in turn."""
    return SlotMap(1, n_shards, tuple(v % n_shards for v in range(n_slots)), (0,) * n_slots, (0,) * n_slots)


def rebalance(old: SlotMap, size: list[int], rows: list[int], n_shards: int | None = None, tolerance: float = TOLERANCE) -> SlotMap:
    """The next version, for new loads or another number of shards; few slots move.

    Slots leave shards above the mean by more than tolerance, the largest that fits
    the gap first, for the lightest shard. Slots of removed shards all move. A shard that
    one slot holds above the mean is left as it is, and the mean is that of the others.
    """
    n = n_shards or old.n_shards
    shard, load = list(old.shard), [0] * n
    held: list[list[int]] = [[] for _ in range(n)]
    for v, s in enumerate(shard):
        if s < n:
            load[s] += size[v]
            held[s].append(v)
    for v in sorted((v for v, s in enumerate(shard) if s >= n), key=lambda v: (-size[v], v)):
        s = min(range(n), key=lambda s: (load[s], s))
        shard[v] = s
        load[s] += size[v]
        held[s].append(v)
    for h in held:
        h.sort(key=lambda v: (size[v], v))
    live = set(range(n))
    while len(live) > 1:
        mean = sum(load[s] for s in live) / len(live)
        top, low = max(live, key=lambda s: (load[s], -s)), min(live, key=lambda s: (load[s], s))
        if load[top] <= mean * (1 + tolerance) and load[low] >= mean * (1 - tolerance):
            break
        room = min(load[top] - mean, mean - load[low])
        own = held[top]
        k = bisect.bisect_right(own, room, key=size.__getitem__) - 1
        if k < 0 or size[own[k]] == 0:  # none fits the gap: the smallest one that still brings the two closer
            k = bisect.bisect_right(own, 0, key=size.__getitem__)
            if k == len(own) or size[own[k]] >= load[top] - load[low]:
                live.discard(top)
                continue
        v = own.pop(k)
        bisect.insort(held[low], v, key=size.__getitem__)
        load[top] -= size[v]
        load[low] += size[v]
        shard[v] = low
    return SlotMap(old.version + 1, n, tuple(shard), tuple(size), tuple(rows))


def store_map(spark: SparkSession, m: SlotMap, home: str) -> None:
    """Write a version; versions are never written over."""
    m.frame(spark).coalesce(1).write.parquet(f"{home}/version={m.version}")


def map_versions(spark: SparkSession, home: str) -> list[int]:
    """The complete versions below home, in ascending order."""
    out, v = [], 1
    while exists(spark, f"{home}/version={v}/_SUCCESS"):
        out.append(v)
        v += 1
    return out


def load_map(spark: SparkSession, home: str, version: int | None = None) -> SlotMap | None:
    """A stored version, the newest by default; None where there is none."""
    stored = map_versions(spark, home)
    if not stored:
        return None
    rows = sorted(spark.read.schema(MAP_SCHEMA).parquet(f"{home}/version={version or stored[-1]}").collect(), key=lambda r: r.vslot)
    return SlotMap(rows[0].version, rows[0].n_shards, tuple(r.shard for r in rows), tuple(r.bytes for r in rows), tuple(r.rows for r in rows))


def assign(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Shard and position of each row of slotted().

    A position is the rows of the shard in lower slots plus the place inside the slot,
    so no task ever holds a whole shard. The map has one row per slot: its broadcast is
    bounded by the number of slots.
    """
    inside = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    placed = rows.withColumn("inside", F.row_number().over(inside))
    return placed.join(F.broadcast(slot_map.select("vslot", "version", "shard", "first")), "vslot").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("inside") - 1).alias("slot"), "vslot", F.col("version").alias("map_version")
    )


def shard_documents(docs: DataFrame, n_shards: int = 24, n_slots: int = N_SLOTS, home: str | None = None) -> DataFrame:
    """Every row with its shard by the map stored in home, which is edited first for these rows.

    A stored map keeps its number of slots; another number of shards is an edit of it.
    """
    spark = docs.sparkSession
    home = home or fresh_path(spark, "slot_map")
    now = load_map(spark, home)
    if now is None:
        store_map(spark, now := first_map(n_slots, n_shards), home)
    rows = slotted(docs, len(now.shard))
    size, count = slot_loads(rows, len(now.shard))
    edited = rebalance(now, size, count, n_shards)
    if edited.shard != now.shard or (edited.n_shards, edited.rows) != (now.n_shards, now.rows):
        store_map(spark, edited, home)
    newest = map_versions(spark, home)[-1]
    return assign(rows, spark.read.schema(MAP_SCHEMA).parquet(f"{home}/version={newest}"))
