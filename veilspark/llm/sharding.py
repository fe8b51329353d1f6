"""Operator 6: fixed virtual slots with a versioned slot-to-shard map (native).

Records hash into a fixed number of virtual slots. Rows and bytes are summed for each slot,
slots are dealt to shards so that the shards' bytes are near equal, and the map from slots
to shards is stored with a version. A later run on the same store starts from its latest version and
edits it: heavy slots are cut, and only units of shards above their share move; what moved is the next version.

Equal texts hash to one slot and so stay in one shard. A slot that alone holds more than a
quarter of a shard's share is cut by record into units which are then dealt apart; so
one hot text cannot unbalance the shards. A stored map routes records by itself. Only tables whose size is bounded by the number
of slots (never by the data) come to the driver.

Defined results: a null text counts as empty (size 1, CRC 0); null doc_ids are placed by their
text; repeated rows each get a place of their own; an empty table gives no rows; columns of the
input other than doc_id and text are ignored.
"""

from __future__ import annotations

import heapq
from collections import Counter
from dataclasses import dataclass, replace
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspark.llm.common import literal_array, scratch_path, stored

N_SLOTS = 4096


@dataclass(frozen=True)
class SlotMap:
    """Which shard holds each unit: a slot, or one of the parts of a heavy slot."""

    version: int
    n_shards: int
    shards: tuple[int, ...]  # by unit, slot after slot
    parts: tuple[int, ...]  # units of each slot

    @property
    def first(self) -> list[int]:
        """Number of each slot's first unit."""
        return [0, *accumulate(self.parts)][:-1]

    def unit(self, slot: Column, record: Column) -> Column:
        """Unit of a record by its slot and its hash."""
        at = slot + F.lit(1)
        return F.element_at(literal_array(self.first), at) + F.pmod(record, F.element_at(literal_array(list(self.parts)), at)).cast("int")

    def shard(self, unit: Column) -> Column:
        return F.element_at(literal_array(list(self.shards)), unit + F.lit(1))

    def cut(self, parts: list[int]) -> SlotMap:
        """The same map with whole slots cut into the given numbers of parts, all in the shard they were in."""
        new, shards = list(self.parts), []
        for v, a in enumerate(self.first):
            own = self.shards[a : a + self.parts[v]]
            if self.parts[v] == 1 and parts[v] > 1:
                new[v], own = parts[v], own * parts[v]
            shards += own
        return replace(self, shards=tuple(shards), parts=tuple(new))

    @classmethod
    def balanced(cls, loads: list[int], n_shards: int, parts: tuple[int, ...] | None = None) -> SlotMap:
        """Largest units first, each to the shard with the fewest bytes so far."""
        heap = [(0, s) for s in range(n_shards)]
        shards = [0] * len(loads)
        for unit in sorted(range(len(loads)), key=lambda u: (-loads[u], u)):
            load, shard = heapq.heappop(heap)
            shards[unit] = shard
            heapq.heappush(heap, (load + loads[unit], shard))
        return cls(1, n_shards, tuple(shards), parts or (1,) * len(loads))

    def rebalanced(self, loads: list[int], n_shards: int | None = None, slack: float = 0.01) -> SlotMap:
        """The next version: move few units until no shard exceeds its share by more than slack.

        Units of shards that no longer exist must move; others move only from shards above their share,
        into new shards if there are any, else to the shard with the fewest bytes.
        """
        n = n_shards or self.n_shards
        shards, total = list(self.shards), [0] * n
        homeless = [u for u, s in enumerate(shards) if s >= n]
        for u, s in enumerate(shards):
            if s < n:
                total[s] += loads[u]
        for u in sorted(homeless, key=lambda u: (-loads[u], u)):
            shards[u] = min(range(n), key=lambda s: (total[s], s))
            total[shards[u]] += loads[u]
        share = sum(loads) / n
        open_ = range(self.n_shards, n) if n > self.n_shards else range(n)
        members: list[list[int]] = [[] for _ in range(n)]
        for u in sorted(range(len(loads)), key=lambda u: (loads[u], u)):
            members[shards[u]].append(u)
        for s in sorted(range(n), key=lambda s: (-total[s], s)):
            for u in reversed(members[s].copy()):
                if total[s] <= share * (1 + slack):
                    break
                to = min(open_, key=lambda x: (total[x], x))
                if loads[u] and total[to] + loads[u] < total[s]:
                    shards[u] = to
                    total[s] -= loads[u]
                    total[to] += loads[u]
        return SlotMap(self.version + 1, n, tuple(shards), self.parts)

    def frame(self, spark: SparkSession) -> DataFrame:
        """unit, slot, shard, n_shards: all that routes a record."""
        slots = [v for v, n in enumerate(self.parts) for _ in range(n)]
        both = F.arrays_zip(literal_array(slots).alias("slot"), literal_array(list(self.shards)).alias("shard"))
        return spark.range(1).select(F.posexplode(both).alias("unit", "x")).select("unit", "x.slot", "x.shard", F.lit(self.n_shards).alias("n_shards"))

    def save(self, spark: SparkSession, path: str) -> None:
        """Add this version to the store at path; versions are never overwritten."""
        self.frame(spark).coalesce(1).write.parquet(f"{path}/version={self.version}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """The given or latest version. Its rows are bounded by the number of units."""
        df = spark.read.parquet(path)
        if version is None:
            version = df.agg(F.max("version")).first()[0]
        rows = sorted(df.filter(F.col("version") == version).select("unit", "slot", "shard", "n_shards").collect())
        parts = Counter(r["slot"] for r in rows)
        return cls(int(version), rows[0]["n_shards"], tuple(r["shard"] for r in rows), tuple(parts[v] for v in range(len(parts))))

    @staticmethod
    def stored_at(spark: SparkSession, path: str) -> bool:
        """Whether a store with a version is there, by the store's own file system."""
        pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/_SUCCESS")
        return bool(pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern))


def shard(docs: DataFrame, n_shards: int = 8, n_slots: int = N_SLOTS, store: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, position (gapless from 0 in its shard), virtual_slot, map_version.

    With a store that holds a map, its latest version (and its number of slots) is used, rebalanced for these rows and n_shards;
    a version is saved if it differs.
    """
    spark = docs.sparkSession
    old = SlotMap.load(spark, store) if store and SlotMap.stored_at(spark, store) else None
    n_slots = len(old.parts) if old else n_slots
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.pmod(F.xxhash64(text), F.lit(n_slots)).cast("int").alias("virtual_slot"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "shard-rows",
    )
    by_slot = {r[0]: (r[1], r[2]) for r in rows.groupBy("virtual_slot").agg(F.count(F.lit(1)), F.sum("size")).collect()}
    total_rows, total_bytes = (sum(x[i] for x in by_slot.values()) for i in (0, 1))

    # A heavy slot has as many parts as slots of mean size would hold it, so there are fewer than 2 * n_slots units.
    heavy, mean = total_bytes / (4 * n_shards), max(1, total_bytes / n_slots)
    parts = [-int(-b // mean) if b > heavy else 1 for _, b in (by_slot.get(v, (0, 0)) for v in range(n_slots))]
    cut = old.cut(parts) if old else SlotMap(0, n_shards, (0,) * sum(parts), tuple(parts))
    record = F.xxhash64("doc_id", "size", "text_crc32")
    in_units = rows.withColumn("unit", cut.unit(F.col("virtual_slot"), record))
    by_unit = {r[0]: (r[1], r[2]) for r in in_units.groupBy("unit").agg(F.count(F.lit(1)), F.sum("size")).collect()}
    loads = [by_unit.get(u, (0, 0))[1] for u in range(len(cut.shards))]
    if old is None:
        slot_map = SlotMap.balanced(loads, n_shards, cut.parts)
    else:
        slot_map = cut.rebalanced(loads, n_shards)
        if (slot_map.shards, slot_map.parts, slot_map.n_shards) == (old.shards, old.parts, old.n_shards):
            slot_map = old
    if slot_map is not old:
        slot_map.save(spark, store or scratch_path(spark, "slot-map"))

    # Places are numbered within cells of bounded size, many to a large unit, rows of one text and id apart as well.
    step = max(256, total_rows / n_slots)
    cells = [max(1, -int(-by_unit.get(u, (0, 0))[0] // step)) for u in range(len(loads))]
    first = [0, *accumulate(cells)][:-1]
    unit = F.col("unit") + F.lit(1)
    cell = F.element_at(literal_array(first), unit) + F.pmod(F.xxhash64("doc_id", "size", "text_crc32", "row"), F.element_at(literal_array(cells), unit)).cast("int")
    celled = in_units.withColumn("cell", cell)
    by_cell = dict(celled.groupBy("cell").count().collect())
    start, filled = [], [0] * n_shards
    for u, s in enumerate(slot_map.shards):
        for c in range(first[u], first[u] + cells[u]):
            start.append(filled[s])
            filled[s] += by_cell.get(c, 0)
    place = F.row_number().over(Window.partitionBy("cell").orderBy("doc_id", "size", "text_crc32", "row"))
    return celled.select(
        "doc_id",
        "size",
        "text_crc32",
        slot_map.shard(F.col("unit")).alias("shard"),
        (F.element_at(literal_array(start, "bigint"), F.col("cell") + F.lit(1)) + place - F.lit(1)).cast("long").alias("position"),
        "virtual_slot",
        F.lit(slot_map.version).alias("map_version"),
    )
