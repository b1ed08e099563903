"""Sharding by fixed virtual slots.

A record's hash names one of ``n_slots`` virtual slots, for good. Bytes and rows are added up by slot, and a small table maps slots to
shards. The table has versions: each one is stored as the rows it edits, so any version can be read again and a version
tells what it moves. Rebalancing moves slots from shards above their share to shards below it, or swaps two; growing gives the
new shard slots of the fullest ones and touches nothing else.

The law of the query is ``bytes``: shards' sizes differ by what no move or swap of slots can mend, which is less than the smallest slot of the fullest shard.

What goes through the driver is the map and the slots' sums: ``n_slots`` rows (8,192), whatever the data. Texts are read once and
reduced to four numbers where they are read; these are stored, added up by slot (combined map-side), and numbered within
their slot. A row's place in its shard is its number there behind the rows of the shard's earlier slots, so no task has a whole shard.

Defined cases: null or empty text: eight bytes. A null doc_id is hashed by its text. Rows are placed by id and text, so that texts that share
an id spread; rows equal in both share a slot. An empty table gives an empty result and a map in which shards take slots by turns. Columns other than
doc_id and text are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, store

SLOTS = 8192
EDITS = "slot int, shard int"


def balanced(shard_of: dict[int, int], load: dict[int, int], shards: int) -> dict[int, int]:
    """The edits (slot -> shard) that level the shards' loads.

    First what is above its share moves, largest slots first, each to the emptiest shard; then, as long as it brings
    the fullest and the emptiest shard nearer to each other, one slot moves between them or two are swapped.
    """
    held: list[set[int]] = [set() for _ in range(shards)]
    for slot, shard in shard_of.items():
        held[shard].add(slot)
    total = [sum(load.get(s, 0) for s in h) for h in held]
    share = -(-sum(total) // shards)
    pool = []
    for i in range(shards):
        for slot in sorted(held[i], key=lambda s: (-load.get(s, 0), s)):
            if total[i] - load.get(slot, 0) >= share and load.get(slot, 0):
                held[i].remove(slot)
                total[i] -= load[slot]
                pool.append(slot)
        while total[i] > share and held[i]:
            slot = min((s for s in held[i] if load.get(s, 0)), key=lambda s: (load[s], s))
            held[i].remove(slot)
            total[i] -= load[slot]
            pool.append(slot)
    for slot in sorted(pool, key=lambda s: (-load[s], s)):
        to = min(range(shards), key=lambda i: (total[i], i))
        held[to].add(slot)
        total[to] += load[slot]
    for _ in range(100 * shards):
        high, low = max(range(shards), key=lambda i: (total[i], i)), min(range(shards), key=lambda i: (total[i], i))
        gap = total[high] - total[low]
        # what the pair's difference would be after each move and each swap with the slot that fits best
        best = min(((abs(gap - 2 * load.get(s, 0)), s, -1) for s in held[high] if load.get(s, 0)), default=(gap, -1, -1))
        theirs = sorted((load.get(s, 0), s) for s in held[low])
        j = 0
        for mine, s in sorted((load.get(s, 0), s) for s in held[high]):
            while j < len(theirs) and gap - 2 * (mine - theirs[j][0]) < 0:
                j += 1
            for k in (j - 1, j):
                if 0 <= k < len(theirs):
                    best = min(best, (abs(gap - 2 * (mine - theirs[k][0])), s, theirs[k][1]))
        if best[0] >= gap:
            break
        _, out, back = best
        for slot, a, b in ((out, high, low), (back, low, high)):
            if slot >= 0:
                held[a].remove(slot)
                held[b].add(slot)
                total[a] -= load.get(slot, 0)
                total[b] += load.get(slot, 0)
    return {slot: i for i in range(shards) for slot in held[i] if shard_of[slot] != i}


def grown(shard_of: dict[int, int], load: dict[int, int], shards: int) -> dict[int, int]:
    """The edits that give shard number ``shards`` its share, slot by slot from the fullest shards."""
    held: list[list[int]] = [[] for _ in range(shards)]
    for slot, shard in sorted(shard_of.items(), key=lambda x: (load.get(x[0], 0), x[0])):
        held[shard].append(slot)
    total = [sum(load.get(s, 0) for s in h) for h in held]
    share, got, edits = sum(total) / (shards + 1), 0, {}
    while got < share:
        # of the fullest shard that has a slot which fits and leaves the new shard no fuller than it
        fits = next((f for f in ([(i, s) for s in held[i] if 0 < load.get(s, 0) <= min(share - got, total[i] - got)] for i in sorted(range(shards), key=lambda i: (-total[i], i))) if f), None)
        if not fits:
            break
        donor, slot = fits[len(fits) // 2]
        held[donor].remove(slot)
        total[donor] -= load[slot]
        got += load[slot]
        edits[slot] = shards
    return edits


class SlotMap:
    """The versioned map in a folder: one folder of edits for each version, written once."""

    def __init__(self, spark: SparkSession, path: str, slots: int = SLOTS) -> None:
        self.spark, self.path, self.slots = spark, path, slots

    def _put(self, version: int, edits: DataFrame) -> None:
        edits.coalesce(1).write.parquet(f"{self.path}/version={version}")  # fails if another editor was first

    def create(self, shards: int) -> SlotMap:
        """Version 0: shards take slots by turns."""
        self._put(0, self.spark.range(self.slots).select(F.col("id").cast("int").alias("slot"), F.pmod("id", F.lit(shards)).cast("int").alias("shard")))
        return self

    def edits(self) -> DataFrame:
        """(slot, shard, version): everything that was ever put."""
        return self.spark.read.schema(EDITS + ", version int").parquet(self.path)

    def latest(self) -> int:
        return self.edits().agg(F.max("version")).first()[0]

    def at(self, version: int | None = None) -> DataFrame:
        """(slot, shard, version) as of a version, the latest if none is given; ``version`` is that of the slot's last edit."""
        known = self.edits() if version is None else self.edits().where(F.col("version") <= version)
        return known.groupBy("slot").agg(F.max_by("shard", "version").alias("shard"), F.max("version").alias("version"))

    def _edit(self, how, loads: DataFrame, shards: int) -> int:
        now = {r.slot: r.shard for r in self.at().collect()}  # at most ``slots`` rows
        found = how(now, {r.slot: r.bytes for r in loads.select("slot", "bytes").collect()}, shards)
        version = self.latest() + 1
        self._put(version, self.spark.createDataFrame(sorted(found.items()), EDITS))
        return version

    def rebalance(self, loads: DataFrame, shards: int) -> int:
        """loads (slot, bytes). Writes and returns the next version, which levels the shards."""
        return self._edit(balanced, loads, shards)

    def grow(self, loads: DataFrame, shards: int) -> int:
        """The next version: one shard more than ``shards``, which alone takes slots."""
        return self._edit(grown, loads, shards)


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, th, size, text_crc32, slot) of each row."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("th"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return rows.withColumn("slot", F.pmod(F.xxhash64("doc_id", "th"), F.lit(slots)).cast("int"))


def slot_loads(rows: DataFrame) -> DataFrame:
    """(slot, bytes, n) of the slots that have rows."""
    return rows.groupBy("slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))


def shard(docs: DataFrame, shards: int = 24, slots: int = SLOTS, path: str | None = None) -> tuple[DataFrame, SlotMap]:
    """Rows as (doc_id, size, text_crc32, shard, place, slot, version), and the map they were placed by.

    ``place`` numbers a shard's rows from 0 without gaps. ``path``: a folder whose map is taken up and edited; else a new one.
    """
    spark = docs.sparkSession
    rows, _ = store(records(docs, slots), "sharding")
    loads, _ = store(slot_loads(rows).coalesce(1), "slot-loads")
    known = SlotMap(spark, path or new_path(spark, "slot-map"), slots)
    if path is None:
        known.create(shards)
    version = known.rebalance(loads, shards)
    return placed(rows, loads, known.at(version)), known


def placed(rows: DataFrame, loads: DataFrame, where: DataFrame) -> DataFrame:
    """records() in their shards by a map (slot, shard, version)."""
    before = Window.partitionBy("shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = loads.join(where, "slot").withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("slot").orderBy(F.col("doc_id").asc_nulls_last(), "th")) - 1
    met = rows.withColumn("within", within).join(F.broadcast(starts.select("slot", "shard", "version", "start")), "slot")  # at most ``slots`` rows
    return met.select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("within")).alias("place"), "slot", "version")
