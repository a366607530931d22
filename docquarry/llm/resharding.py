"""Resharding by minimum-cost flow.

Old shards are cut into blocks by a hash of the rows' ids and texts, more of them as the input grows. From the old shards' bytes and the new shards' capacities, a minimum-cost flow
(a byte that stays costs nothing, a byte that moves costs one) says how many bytes go from each old shard to each new one. An old shard's
rows, in the order of its blocks, are then dealt out along these flows: whole blocks mostly, and the rows of a few blocks that a flow's end cuts. Around
each cut, a bounded number of rows is dealt out again, largest first to the emptiest shard, so that sizes end up as near as rows allow.
Only the texts of blocks that don't stay whole where they are get moved and written again.

What the driver holds is bounded by parameters: a row for each block, flow and row beside a cut.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, shared_path

#: Blocks of an old shard at least, and bytes of a block at most, about.
BLOCKS, BLOCK_BYTES = 256, 1 << 30
#: Rows on each side of a cut that are dealt out again.
BESIDE = 48


def min_cost_flow(supply: list[int], capacity: list[int]) -> list[list[int]]:
    """Bytes from each old shard to each new one: all supplies, no capacity exceeded, and the fewest bytes whose shard changes.

    Successive shortest paths with potentials over source, old shards, new shards and sink; old shard i and new shard i are the same place.
    """
    if sum(capacity) < sum(supply):
        raise ValueError("the capacities don't hold the supplies")
    n, m = len(supply), len(capacity)
    source, sink = n + m, n + m + 1
    room: dict[int, dict[int, int]] = {v: {} for v in range(n + m + 2)}
    cost: dict[tuple[int, int], int] = {}

    def arc(a: int, b: int, most: int, price: int) -> None:
        room[a][b], cost[a, b] = most, price
        room[b].setdefault(a, 0)
        cost[b, a] = -price

    for i, s in enumerate(supply):
        arc(source, i, s, 0)
        for j in range(m):
            arc(i, n + j, s, 0 if i == j else 1)
    for j, c in enumerate(capacity):
        arc(n + j, sink, c, 0)
    potential, left = dict.fromkeys(room, 0), sum(supply)
    while left:
        distance, back, heap = {source: 0}, {}, [(0, source)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > distance[a]:
                continue
            for b, r in room[a].items():
                e = d + cost[a, b] + potential[a] - potential[b]
                if r > 0 and e < distance.get(b, e + 1):
                    distance[b], back[b] = e, a
                    heapq.heappush(heap, (e, b))
        top = max(distance.values())
        for v in potential:
            potential[v] += distance.get(v, top)
        path, v = [], sink
        while v != source:
            path.append((back[v], v))
            v = back[v]
        moved = min(left, *(room[a][b] for a, b in path))
        for a, b in path:
            room[a][b] -= moved
            room[b][a] += moved
        left -= moved
    return [[room[n + j][i] for j in range(m)] for i in range(n)]


def equal_capacities(total: int, shards: int) -> list[int]:
    """Capacities at most one byte apart that sum to the total."""
    return [total // shards + (j < total % shards) for j in range(shards)]


def even_out(free: dict[tuple[int, int], tuple[int, int, int, int]], loads: dict[int, int], capacity: list[int]) -> dict[tuple[int, int], int]:
    """The rows of free (key: size, shard, and the two shards it may be in) that go to their other shard so that loads come near the capacities.

    Rows change sides, the largest first, as long as that lessens the sum of squared deviations."""
    loads, at = dict(loads), {k: shard for k, (_, shard, _, _) in free.items()}
    over = {j: loads.get(j, 0) - c for j, c in enumerate(capacity)}
    order, changed = sorted(free, key=lambda k: (-free[k][0], k)), True
    while changed:
        changed = False
        for k in order:
            size, _, left, right = free[k]
            a, b = at[k], left + right - at[k]
            if (over[a] - size) ** 2 + (over[b] + size) ** 2 < over[a] ** 2 + over[b] ** 2:
                over[a], over[b], at[k], changed = over[a] - size, over[b] + size, b, True
    return {k: j for k, j in at.items() if j != free[k][1]}


@dataclass
class Plan:
    """flows: bytes from old to new shards; pieces: (old, begin, end, new), where each old shard's bytes go, in its order;
    offsets: the first byte of each (old, block); affected: the blocks that don't stay whole in their place."""

    flows: list[list[int]]
    pieces: list[tuple[int, int, int, int]]
    offsets: dict[tuple[int, int], int]
    affected: list[tuple[int, int]]


def plan_moves(sizes: dict[tuple[int, int], int], capacity: list[int], old_shards: int) -> Plan:
    """The plan for blocks of (old, block): bytes."""
    supply = [sum(s for (o, _), s in sizes.items() if o == i) for i in range(old_shards)]
    flows = min_cost_flow(supply, capacity)
    pieces, offsets, affected = [], {}, []
    for old in range(old_shards):
        at = 0
        for new in sorted(range(len(capacity)), key=lambda j: (j != old, j)):  # what stays comes first
            if flows[old][new]:
                pieces.append((old, at, at + flows[old][new], new))
                at += flows[old][new]
        stays, at = flows[old][old] if old < len(capacity) else 0, 0
        for o, block in sorted(k for k in sizes if k[0] == old):
            offsets[o, block] = at
            at += sizes[o, block]
            if at > stays:
                affected.append((o, block))
    return Plan(flows, pieces, offsets, affected)


def reshard(docs: DataFrame, old_shard: Column, capacity: list[int] | int, old_shards: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Plan]:
    """Every row of docs as (id, size, text_crc32, old_shard, shard, slot), and the plan. size: UTF-8 bytes of the text (null: none) plus 1.

    old_shard: the number of a row's old shard, from 0 to old_shards - 1. capacity: bytes of each new shard, or their number, for equal
    ones. Slots count the rows of a shard from 0 without gaps. The rows of affected blocks are written to a file set per new shard in the shared folder and
    what is returned of them is read from there; rows of other blocks stay where they are.
    A null old_shard counts as 0. Rows with equal or null ids are separate rows; rows that repeat both id and text are interchangeable. An empty table gives empty shards.
    Columns of docs other than id and text are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    total = docs.agg(F.sum(F.octet_length(text_col)), F.count(F.lit(1))).first()
    blocks = int(max(BLOCKS, -(-((total[0] or 0) + total[1]) // (BLOCK_BYTES * old_shards))))
    key = F.xxhash64(F.col(id_col), F.xxhash64(text))  # rows with equal or null ids are spread by their texts
    rows = docs.select(
        F.col(id_col).alias("id"), text.alias("text"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"),
        F.coalesce(old_shard.cast("int"), F.lit(0)).alias("old"), F.pmod(key, F.lit(blocks)).cast("int").alias("block"), F.xxhash64(text).alias("hash"),
    )
    narrow = materialise(rows.drop("text"), "sized")
    sizes = {(r["old"], r["block"]): r["bytes"] for r in narrow.groupBy("old", "block").agg(F.sum("size").alias("bytes")).collect()}  # old_shards * blocks rows at most
    capacity = equal_capacities(sum(sizes.values()), capacity) if isinstance(capacity, int) else capacity
    plan = plan_moves(sizes, capacity, old_shards)
    bounds = F.broadcast(spark.createDataFrame([(*k, v) for k, v in plan.offsets.items()] or [], "old int, block int, first long"))
    pieces = F.broadcast(spark.createDataFrame([list(x) for x in plan.pieces] or [], "old int, low long, high long, shard int"))
    order = Window.partitionBy("old", "block").orderBy("id", "size", "crc", "hash")

    def dealt(part: DataFrame) -> DataFrame:
        """With position (the row's first byte in its old shard) and shard, by the flows alone."""
        part = part.withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).join(bounds, ["old", "block"])
        part = part.withColumn("position", F.col("first") + F.col("upto") - F.col("size")).drop("upto", "first").alias("p")
        middle = F.col("p.position") + F.expr("p.size div 2")
        return part.join(pieces.alias("c"), (F.col("p.old") == F.col("c.old")) & (middle >= F.col("low")) & (middle < F.col("high"))).select("p.*", "shard", "low", "high")

    # rows beside the cuts are dealt out again: both sides of a cut are shards that its old shard's bytes go to
    cuts = [(a[0], a[2], a[3], b[3]) for a, b in zip(plan.pieces, plan.pieces[1:]) if a[0] == b[0]]
    moved: dict[tuple[int, int], int] = {}
    if cuts:
        where = {}
        for old, at, _, _ in cuts:
            where[old, max((b for (o, b), first in plan.offsets.items() if o == old and first < at), key=lambda b: plan.offsets[old, b])] = True
        cut_blocks = F.broadcast(spark.createDataFrame([list(k) for k in where], "old int, block int"))
        near = dealt(narrow.join(cut_blocks, ["old", "block"]))
        cut = F.broadcast(spark.createDataFrame([(o, at) for o, at, _, _ in cuts], "old int, cut long"))
        near = near.join(cut, "old").withColumn("side", F.col("position") < F.col("cut"))
        rank = F.row_number().over(Window.partitionBy("old", "cut", "side").orderBy(F.abs(F.col("position") - F.col("cut")), "position"))
        beside = near.withColumn("rank", rank).where(F.col("rank") <= BESIDE).select("old", "cut", "position", "size", "shard").collect()  # 2 * BESIDE rows of each cut at most
        loads = {r["shard"]: r["bytes"] for r in dealt(narrow).groupBy("shard").agg(F.sum("size").alias("bytes")).collect()}
        free = {}
        for r in beside:
            for o, at, left, right in cuts:
                if o == r["old"] and at == r["cut"] and r["shard"] in (left, right) and (r["old"], r["position"]) not in free:
                    free[r["old"], r["position"]] = (r["size"], r["shard"], left, right)
        moved = even_out(free, loads, capacity)
    again = F.broadcast(spark.createDataFrame([(*k, v) for k, v in moved.items()] or [], "old int, position long, other int"))

    def placed(part: DataFrame) -> DataFrame:
        return dealt(part).drop("low", "high").join(again, ["old", "position"], "left").withColumn("shard", F.coalesce("other", "shard")).drop("other")

    # slots: the rows of a shard in the order of old shards, blocks and positions
    counts = placed(narrow).groupBy("shard", "old", "block").agg(F.count(F.lit(1)).alias("rows")).collect()  # blocks and cuts at most
    starts, firsts = dict.fromkeys(range(len(capacity)), 0), []
    for r in sorted(counts, key=lambda r: (r["shard"], r["old"], r["block"])):
        firsts.append((r["shard"], r["old"], r["block"], starts[r["shard"]]))
        starts[r["shard"]] += r["rows"]
    first_slot = F.broadcast(spark.createDataFrame(firsts, "shard int, old int, block int, slot long"))
    within = F.row_number().over(Window.partitionBy("old", "block", "shard").orderBy("position")) - 1

    def slotted(part: DataFrame) -> DataFrame:
        part = placed(part).withColumn("within", within).join(first_slot, ["shard", "old", "block"])
        return part.withColumn("slot", F.col("slot") + F.col("within")).drop("within")

    touched = {(o, b) for o, b in plan.affected} | {(r["old"], r["block"]) for r in counts if r["shard"] != r["old"]}
    touched_rows = F.broadcast(spark.createDataFrame([list(k) for k in touched] or [], "old int, block int"))
    stays = slotted(narrow.join(touched_rows, ["old", "block"], "left_anti"))
    path = shared_path(spark, "shards")
    slotted(rows.join(touched_rows, ["old", "block"])).select("id", "text", "old", "slot", "shard").write.partitionBy("shard").parquet(path)
    written = spark.read.schema(f"id {dict(rows.dtypes)['id']}, text string, old int, slot long, shard int").parquet(path)
    written = written.select("id", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("crc"), "old", "shard", "slot")
    result = stays.select(*written.columns).unionByName(written)
    return result.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.col("old").alias("old_shard"), "shard", "slot"), plan

