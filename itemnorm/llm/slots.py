"""Sharding by fixed virtual slots: hash -> slot, bytes per slot, and a versioned slot-to-shard map.

A record's slot never changes. What changes is the map of slots to shards, a table of as many lines as
there are slots; a rebalance edits it and writes the next version, so readers of an older one go on.
New data are placed by the newest version; it is edited only where shards have drifted apart or their number changes.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from itemnorm.llm.common import dense_number
from itemnorm.session import cut_lineage
from itemnorm.sources.commits import names

SLOTS = 4096
#: How far shards of a stored map may drift apart, as a share of their mean, before it is edited.
SLACK = 0.02


def slot_of(record_id: Column, slots: int = SLOTS) -> Column:
    """Virtual slot of a record: XXH64 of its id as text, modulo the number of slots."""
    return F.pmod(F.xxhash64(record_id.cast("string")), F.lit(slots)).cast("int")


def slot_loads(records: DataFrame, slots: int = SLOTS) -> list[tuple[int, int]]:
    """(rows, bytes) of every slot, from records(virtual_slot, size); `slots` lines reach the driver."""
    loads = [(0, 0)] * slots
    for row in records.groupBy("virtual_slot").agg(F.count("*").alias("n"), F.sum("size").alias("b")).toLocalIterator():
        loads[row["virtual_slot"]] = (row["n"], row["b"])
    return loads


@dataclass(frozen=True)
class SlotMap:
    """shard of each slot, and the version of this assignment."""

    version: int
    shard_of: tuple[int, ...]

    @staticmethod
    def first(shards: int, slots: int = SLOTS) -> "SlotMap":
        return SlotMap(1, tuple(s % shards for s in range(slots)))

    def rebalanced(self, sizes: list[int], shards: int, slack: float = 0.0) -> "SlotMap":
        """Next version: slots move, largest useful first, until no move brings shards closer, or they differ by at most
        `slack` of their mean.

        A slot moves from the fullest shard to the emptiest while that lowers the larger of the two;
        where no single slot does, two are exchanged. Slots of shards that no longer exist are dealt out
        first, heaviest to the emptiest shard.
        """
        held: list[dict[int, int]] = [{} for _ in range(shards)]
        homeless = []
        for slot, shard in enumerate(self.shard_of):
            if shard < shards:
                held[shard][slot] = sizes[slot]
            else:
                homeless.append(slot)
        total = [sum(h.values()) for h in held]
        heap = [(t, k) for k, t in enumerate(total)]
        heapq.heapify(heap)
        for slot in sorted(homeless, key=lambda s: (-sizes[s], s)):
            t, k = heapq.heappop(heap)
            held[k][slot] = sizes[slot]
            total[k] = t + sizes[slot]
            heapq.heappush(heap, (total[k], k))
        for _ in range(16 * len(self.shard_of)):
            high = max(range(shards), key=lambda k: (total[k], -k))
            low = min(range(shards), key=lambda k: (total[k], k))
            gap = total[high] - total[low]
            if gap <= slack * sum(total) / shards:
                break
            move = max(((s, n) for s, n in held[high].items() if 0 < n < gap), key=lambda x: (-abs(gap - 2 * x[1]), -x[0]), default=None)
            swap = self._exchange(held[high], held[low], gap)
            if move is None and swap is None:
                break
            if swap is None or (move is not None and abs(gap - 2 * move[1]) <= abs(gap - 2 * swap[2])):
                held[low][move[0]] = held[high].pop(move[0])
                change = move[1]
            else:
                out, back, change = swap
                held[low][out], held[high][back] = held[high].pop(out), held[low].pop(back)
            total[high] -= change
            total[low] += change
        shard_of = [0] * len(self.shard_of)
        for shard, own in enumerate(held):
            for slot in own:
                shard_of[slot] = shard
        return SlotMap(self.version + 1, tuple(shard_of))

    @staticmethod
    def _exchange(high: dict[int, int], low: dict[int, int], gap: int) -> tuple[int, int, int] | None:
        """(slot out, slot back, bytes moved) closest to half the gap, from neighbours in sorted order."""
        mine, other = sorted((n, s) for s, n in high.items()), sorted((n, s) for s, n in low.items())
        best, k = None, 0
        for n, s in mine:
            while k < len(other) and 2 * (n - other[k][0]) > gap:
                k += 1
            for m, t in other[max(0, k - 1) : k + 1]:
                if 0 < n - m < gap and (best is None or abs(gap - 2 * (n - m)) < abs(gap - 2 * best[2])):
                    best = (s, t, n - m)
        return best

    def grown(self, sizes: list[int], shards: int) -> "SlotMap":
        """Next version with more shards: slots move into the new ones only, until those hold their share."""
        now = max(self.shard_of) + 1
        goal = sum(sizes) / max(1, shards)
        shard_of, total = list(self.shard_of), [0] * max(shards, now)
        for slot, shard in enumerate(shard_of):
            total[shard] += sizes[slot]
        for new in range(now, shards):
            for slot in sorted(range(len(shard_of)), key=lambda s: (-sizes[s], s)):
                if shard_of[slot] < now and total[shard_of[slot]] - sizes[slot] >= goal * 0.98 and total[new] + sizes[slot] <= goal * 1.02:
                    total[shard_of[slot]] -= sizes[slot]
                    total[new] += sizes[slot]
                    shard_of[slot] = new
        return SlotMap(self.version + 1, tuple(shard_of))

    def write(self, spark: SparkSession, path: str) -> None:
        """A new folder v=<version> under path; an existing version is never overwritten."""
        rows = [(slot, shard) for slot, shard in enumerate(self.shard_of)]
        spark.createDataFrame(rows, "virtual_slot int, shard int").coalesce(1).write.parquet(f"{path}/v={self.version}")

    @staticmethod
    def read(spark: SparkSession, path: str, version: int) -> "SlotMap":
        rows = spark.read.schema("virtual_slot int, shard int").parquet(f"{path}/v={version}").orderBy("virtual_slot").collect()
        return SlotMap(version, tuple(r["shard"] for r in rows))

    @staticmethod
    def newest(spark: SparkSession, path: str) -> tuple["SlotMap | None", int]:
        """The last version written whole, None without any, and the first number that is free."""
        tails = [n.removeprefix("v=") for n in names(spark, path) if n.startswith("v=")]
        numbers = sorted((int(t) for t in tails if t.isdigit()), reverse=True)
        whole = next((n for n in numbers if "_SUCCESS" in names(spark, f"{path}/v={n}")), None)
        return None if whole is None else SlotMap.read(spark, path, whole), max(numbers, default=0) + 1

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(enumerate(self.shard_of)), "virtual_slot int, shard int")


def shard_points(points: DataFrame, shards: int, path: str, slots: int = SLOTS, slack: float = SLACK) -> DataFrame:
    """item_id, size, text_crc32, virtual_slot, shard, place, map_version of every point.

    points(item_id, text, ...): size is the UTF-8 bytes of the text plus 1, so an empty or null text
    counts 1; texts of any length are only measured and digested. Where `path` holds no map, the first one deals slots out in turn,
    and the bytes of the slots edit it until shards differ
    as little as moves and exchanges of whole slots allow. Both versions are written under `path`. Where there is a map, its newest version
    is used as it is while shards differ by at most `slack` of their mean; else, or if the number of shards
    changes, it is edited by the fewest moves that a fullest-to-emptiest rule needs, more shards taking slots only into
    themselves, and the edited map is the next version. place
    numbers the rows of a shard from 0 without gaps. Equal ids share a slot and a shard; all null ids
    share one. Repeated rows keep a place each; an empty table gives an empty result.
    """
    spark = points.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    records = cut_lineage(
        points.select(
            "item_id",
            (F.octet_length(text) + 1).cast("bigint").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            slot_of(F.coalesce(F.col("item_id").cast("string"), F.lit("")), slots).alias("virtual_slot"),
        )
    )
    sizes = [size for _, size in slot_loads(records, slots)]
    held, number = SlotMap.newest(spark, path)
    if held is None:
        start = replace(SlotMap.first(shards, slots), version=number)
        balanced = start.rebalanced(sizes, shards)
        start.write(spark, path)
        balanced.write(spark, path)
    else:
        if len(held.shard_of) != slots:
            raise ValueError(f"the map under {path} has {len(held.shard_of)} slots")
        more = shards > max(held.shard_of) + 1
        balanced = replace(held.grown(sizes, shards) if more else held.rebalanced(sizes, shards, slack), version=number)
        if balanced.shard_of == held.shard_of:
            balanced = held
        else:
            balanced.write(spark, path)
    placed = records.join(F.broadcast(balanced.table(spark)), "virtual_slot").withColumn("map_version", F.lit(balanced.version))
    return dense_number(placed, ["shard"], [F.col("item_id"), F.col("text_crc32"), F.col("size")], "place", salts=256).select(
        "item_id", "size", "text_crc32", "virtual_slot", "shard", "place", "map_version"
    )
