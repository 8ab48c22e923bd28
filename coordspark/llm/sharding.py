"""Shards by fixed virtual slots: records hash into thousands of slots, and a versioned map sends slots to shards.

The map is an edit list over slots: a rebalance reads the bytes gathered for each slot and moves only as many
slots as it needs; other slots, and so their records, stay where they are. A slot that alone outweighs a
quarter of a shard (one key with very many rows) is split into ``SPLITS`` parts by a stored salt, each mapped
by itself. All that the driver sees is the slot table, whose size is fixed by the number of slots.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coordspark.llm.common import new_path, text_of, written

SLOTS, SPLITS = 4096, 256
Unit = tuple[int, int]


@dataclass
class SlotMap:
    """Versions of the map from (slot, part) to shard; part is -1 for a slot that is not split."""

    shards: int
    version: int
    shard_of: dict[Unit, int]
    edits: list[tuple[int, int, int, int, int]] = field(default_factory=list)  # version, slot, part, from, to

    @classmethod
    def initial(cls, units: list[Unit], shards: int, slots: int = SLOTS) -> SlotMap:
        """Version 1: equal runs of slots; the parts of a split slot in turn."""
        return cls(shards, 1, {(s, p): s * shards // slots if p < 0 else p % shards for s, p in units})

    def with_split(self, hot: list[int]) -> SlotMap:
        """The same map where the slots ``hot`` are split, their parts where the whole slot was."""
        split = {(s, p): self.shard_of[s, -1] for s in hot if (s, -1) in self.shard_of for p in range(SPLITS)}
        whole = {u: shard for u, shard in self.shard_of.items() if (u[0], 0) not in split}
        return SlotMap(self.shards, self.version, whole | split, self.edits)

    def split_slots(self) -> set[int]:
        return {s for s, p in self.shard_of if p >= 0}

    def rebalanced(self, weight: dict[Unit, int], shards: int | None = None) -> SlotMap:
        """The next version: slots move from the heaviest to the lightest shard while that evens them out.

        With more ``shards`` than before, slots move to the new ones only.
        """
        shards = shards or self.shards
        if shards < self.shards:
            raise ValueError(f"a map of {self.shards} shards can't be edited to {shards}")
        takers = range(self.shards if shards > self.shards else 0, shards)
        held: list[list[tuple[int, Unit]]] = [[] for _ in range(shards)]
        for unit, shard in self.shard_of.items():
            insort(held[shard], (weight.get(unit, 0), unit))
        loads = [sum(w for w, _ in h) for h in held]
        shard_of, edits = dict(self.shard_of), list(self.edits)
        while True:
            heavy, light = max(range(shards), key=loads.__getitem__), min(takers, key=loads.__getitem__)
            gap, own = loads[heavy] - loads[light], held[heavy]
            at = bisect_left(own, (gap // 2, (-1, -1)))
            near = [own[i] for i in (at - 1, at) if 0 <= i < len(own) and 0 < own[i][0] < gap]
            if not near:
                return SlotMap(shards, self.version + 1, shard_of, edits)
            moved = min(near, key=lambda x: (abs(2 * x[0] - gap), x[1]))
            own.remove(moved)
            insort(held[light], moved)
            loads[heavy] -= moved[0]
            loads[light] += moved[0]
            shard_of[moved[1]] = light
            edits.append((self.version + 1, *moved[1], heavy, light))

    def store(self, spark: SparkSession, path: str, weight: dict[Unit, int]) -> None:
        """Adds this version, with the bytes that it was made for, and its edits to the tables under ``path``."""
        rows = [(self.version, self.shards, s, p, shard, weight.get((s, p), 0)) for (s, p), shard in sorted(self.shard_of.items())]
        table = spark.createDataFrame(rows, "version int, shards int, slot int, part int, shard int, bytes long")
        table.coalesce(1).write.mode("append").parquet(f"{path}/map")
        own = [e for e in self.edits if e[0] == self.version]
        edits = spark.createDataFrame(own, "version int, slot int, part int, from_shard int, to_shard int")
        edits.coalesce(1).write.mode("append").parquet(f"{path}/edits")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SlotMap:
        """The newest version under ``path``: as many rows as slots and the parts of split ones."""
        table = spark.read.parquet(f"{path}/map")
        rows = table.where(F.col("version") == table.agg(F.max("version")).first()[0]).collect()
        shard_of = {(r["slot"], r["part"]): r["shard"] for r in rows}
        return cls(rows[0]["shards"], rows[0]["version"], shard_of)


def shard_documents(docs: DataFrame, shards: int = 16, slots: int = SLOTS, map_path: str | None = None, stored: bool = False) -> DataFrame:
    """``docs(doc_id, text)`` to shards of near equal bytes, a row for each input row.

    ``map_path`` is where the versions of the slot map are; with ``stored`` the newest one there is edited, else a
    first one is stored and then edited by the bytes that the slots hold. So records whose slot the edits leave
    alone keep their shard from one run to the next.

    Gives doc_id, size (UTF-8 bytes of the text plus one; null counts as empty), text_crc32, shard, slot (the
    row's place in its shard, gapless from 0), virtual_slot, and map_version. A record's virtual slot hashes
    its doc_id and text (nulls hash as absent), so a text of any length is read once. Equal places in the order of
    a slot are settled by the row's place in the input. Rows that repeat are each placed. An empty table gives none.
    Other columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    map_path = map_path or new_path(spark, "slot-map")
    text = text_of()
    keyed = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(slots)).cast("int").alias("virtual_slot"),
        F.monotonically_increasing_id().alias("row"),
    )
    keyed = written(keyed, "records").withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SPLITS)).cast("int"))

    per_slot = {r["virtual_slot"]: r["bytes"] for r in keyed.groupBy("virtual_slot").agg(F.sum("size").alias("bytes")).collect()}
    hot = sorted(s for s, b in per_slot.items() if 4 * shards * b > sum(per_slot.values()))
    if not stored:
        SlotMap.initial([(s, -1) for s in range(slots)], shards, slots).store(spark, map_path, {})
    before = SlotMap.load(spark, map_path).with_split(hot)
    split = sorted(before.split_slots())
    placed = keyed.withColumn("part", F.when(F.col("virtual_slot").isin(split), F.col("salt")).otherwise(F.lit(-1)))
    sums = placed.groupBy("virtual_slot", "part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
    weight = {(r["virtual_slot"], r["part"]): r["bytes"] for r in sums}
    count = {(r["virtual_slot"], r["part"]): r["n"] for r in sums}
    slot_map = before.rebalanced(weight, shards)
    slot_map.store(spark, map_path, weight)

    offsets, rows = [0] * shards, []
    for unit in sorted(weight):
        shard = slot_map.shard_of[unit]
        rows.append((*unit, shard, offsets[shard]))
        offsets[shard] += count[unit]
    # as many as slots and their parts
    units = F.broadcast(spark.createDataFrame(rows, "virtual_slot int, part int, shard int, before long"))
    window = "row_number() over (partition by virtual_slot, part order by doc_id, size, text_crc32, row) - 1"
    met = placed.withColumn("at", F.expr(window)).join(units, ["virtual_slot", "part"])
    place = (F.col("before") + F.col("at")).cast("long").alias("slot")
    version = F.lit(slot_map.version).alias("map_version")
    return met.select("doc_id", "size", "text_crc32", "shard", place, "virtual_slot", version)
