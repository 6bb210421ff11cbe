"""Sharding by fixed virtual slots and a versioned slot-to-shard map."""

from __future__ import annotations

import bisect
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import n_shuffle, stored

#: Virtual slots; fixed for the life of a data set. All tables of slots have so many rows.
SLOTS = 4096
#: Rebalancing stops when the largest and the smallest shard differ by less than this share of the mean.
SPREAD = 0.0005


#: Rows that are alike, of which one task gives out so many numbers.
RUN = 4096


def vslot(*key, slots: int = SLOTS):
    """The virtual slot of a key (nulls have one too)."""
    return F.pmod(F.xxhash64(*key), F.lit(slots)).cast("int")


def first_map(shards: int, slots: int = SLOTS) -> list[int]:
    """Version 0: slots are dealt round."""
    return [i % shards for i in range(slots)]


def rebalanced(mapping: list[int], weight: list[int], shards: int, spread: float = SPREAD) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Edits the map until the shards' weights are near equal.

    Each edit moves one slot from the heaviest shard to the lightest, the one
    nearest to half their difference, or else swaps two slots of them by which
    the difference shrinks most. Returns the map and the edits (slot, from, to).
    """
    out, edits = list(mapping), []
    total = [0] * shards
    members: list[set[int]] = [set() for _ in range(shards)]
    for slot, shard in enumerate(out):
        total[shard] += weight[slot]
        members[shard].add(slot)
    limit = spread * sum(total) / shards
    for _ in range(8 * len(out)):
        low = min(range(shards), key=lambda s: (total[s], s))
        heavy = sorted((s for s in range(shards) if total[s] - total[low] > limit), key=lambda s: (-total[s], s))
        # a shard that one heavy slot fills cannot give; then the next heaviest does
        found = next(((high, m) for high in heavy if (m := _best_move(members[high], members[low], weight, total[high] - total[low], limit))), None)
        if found is None:
            break
        high, (slot, back) = found
        for s, a, b in ((slot, high, low), (back, low, high)):
            if s is not None:
                members[a].remove(s)
                members[b].add(s)
                total[a] -= weight[s]
                total[b] += weight[s]
                out[s] = b
                edits.append((s, a, b))
    return out, edits


def _best_move(high: set[int], low: set[int], weight: list[int], gap: int, limit: float) -> tuple[int, int | None] | None:
    """The slot to move, and one to take back or None, that leaves the least gap."""
    move = [(abs(gap - 2 * weight[s]), s, -1) for s in high if 0 < weight[s] < gap]
    if not move or min(move)[0] > limit:
        lows = sorted((weight[s], s) for s in low)
        for s in high:
            at = _nearest(lows, weight[s] - gap / 2)
            if at is not None and 0 < weight[s] - at[0] < gap:
                move.append((abs(gap - 2 * (weight[s] - at[0])), s, at[1]))
    if not move:
        return None
    _, slot, back = min(move)
    return slot, None if back < 0 else back


def _nearest(pairs: list[tuple[int, int]], want: float):
    at = bisect.bisect_left(pairs, (want, -1))
    near = pairs[max(0, at - 1) : at + 1]
    return min(near, key=lambda p: abs(p[0] - want)) if near else None


def grown(mapping: list[int], shards: int) -> list[int]:
    """The map for one more shard: slots move only into it, evenly from all others."""
    out, quota = list(mapping), len(mapping) // (shards + 1)
    by_shard = {s: [i for i, x in enumerate(out) if x == s] for s in range(shards)}
    for turn in range(quota):
        largest = max(by_shard, key=lambda s: (len(by_shard[s]), -s))
        out[by_shard[largest].pop()] = shards
    return out


def slot_weights(records: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each virtual slot; at most ``slots`` rows come to the driver."""
    size, rows = [0] * slots, [0] * slots
    for r in records.groupBy("vslot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect():
        size[r["vslot"]], rows[r["vslot"]] = r["b"], r["n"]
    return size, rows


class SlotMap:
    """Versions of a slot-to-shard map, as rows (version, slot, shard, note)."""

    def __init__(self, shards: int, slots: int = SLOTS):
        self.versions: list[tuple[int, list[int], str]] = [(shards, first_map(shards, slots), "dealt round")]

    @property
    def current(self) -> list[int]:
        return self.versions[-1][1]

    def rebalance(self, weight: list[int], spread: float = SPREAD) -> None:
        shards, mapping, _ = self.versions[-1]
        after, edits = rebalanced(mapping, weight, shards, spread)
        self.versions.append((shards, after, json.dumps({"edits": len(edits)})))

    def grow(self) -> None:
        shards, mapping, _ = self.versions[-1]
        self.versions.append((shards + 1, grown(mapping, shards), "one more shard"))

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(v, n, s, x, note) for v, (n, m, note) in enumerate(self.versions) for s, x in enumerate(m)]
        return spark.createDataFrame(rows, "version int, shards int, vslot int, shard int, note string")


def shard_documents(docs: DataFrame, shards: int = 16, slots: int = SLOTS, spread: float = SPREAD) -> tuple[DataFrame, DataFrame]:
    """Deals documents into shards of near equal bytes; returns the rows and the stored map.

    A row's virtual slot is a hash of doc_id, text and its number among the rows
    that are alike, so that an id or a row that comes very often is spread too
    (rows that are alike are counted, and numbered by their count; which of them
    has which number makes no difference); the bytes of each slot are summed
    (text bytes plus 1), and version 1 of the map is version 0 edited until the
    shards' bytes are near equal. Rows: doc_id, size, text_crc32, vslot, shard
    and slot, the row's place in its shard, from 0 without gaps, in the order
    of (vslot, doc_id, text_crc32, size). Null texts count as empty; texts may
    be of any length; repeated rows each have a place; extra
    columns are ignored whatever their names; an empty table gives no rows.
    Places need a sort only within a virtual slot: the slots before it in its
    shard give the first place.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    alike = docs.select("doc_id", F.xxhash64(text).alias("key"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    counted = alike.groupBy("doc_id", "key", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    run = F.col("run") * RUN
    runs = counted.select("*", F.explode(F.expr(f"sequence(0L, (n - 1) div {RUN})")).alias("run")).repartition(n_shuffle(spark), "doc_id", "key", "run")
    numbered = runs.select("doc_id", "key", "size", "text_crc32", F.explode(F.sequence(run, F.least(run + RUN, F.col("n")) - 1)).alias("number"))
    records = stored(numbered.select("doc_id", "size", "text_crc32", vslot(F.col("doc_id"), F.col("key"), F.col("number"), slots=slots).alias("vslot")), "shard-records")
    size, rows = slot_weights(records, slots)
    slot_map = SlotMap(shards, slots)
    slot_map.rebalance(size, spread)
    versions = stored(slot_map.table(spark).coalesce(1), "shard-map")
    first, base = [0] * shards, []
    for s, shard in enumerate(slot_map.current):
        base.append((s, first[shard]))
        first[shard] += rows[s]
    places = spark.createDataFrame(base, "vslot int, first long")
    now = versions.where(F.col("version") == 1).select("vslot", "shard").join(F.broadcast(places), "vslot")
    within = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    out = records.withColumn("nth", F.row_number().over(within) - 1).join(F.broadcast(now), "vslot")
    return out.select("doc_id", "size", "text_crc32", "vslot", "shard", (F.col("first") + F.col("nth")).cast("long").alias("slot")), versions


def op2_shard(spark, sf_dir: str) -> DataFrame:
    rows, _ = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
