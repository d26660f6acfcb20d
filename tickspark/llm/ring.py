"""Sharding: a consistent-hash ring with virtual nodes and bounded loads.

Each shard has several virtual nodes on a ring of 2^16 cells. A row belongs to the first node at or after
its key's cell; when that node's shard is full, it goes on clockwise. Capacities are n // shards, one more
for the first n % shards, so that counts are at most one apart whatever the keys; what moves when shards
or rows come is bounded by the overflow and the new shard's share. Null keys hash like any value, equal
keys may part (a key with a third of all rows must), empty tables give empty results. Other columns stay
out of the way: only the key, the text and what is derived from them are read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickspark.llm.common import repeated, written

CELLS = 1 << 16


def ring(n_shards: int, nodes: int) -> list[tuple[int, int]]:
    """(cell, shard) of all virtual nodes in order of cells; no two in one cell."""
    taken: dict[int, int] = {}
    for shard in range(n_shards):
        for v in range(nodes):
            cell = int(hashlib.md5(f"{shard}/{v}".encode()).hexdigest()[:8], 16) % CELLS
            while cell in taken:
                cell = (cell + 1) % CELLS
            taken[cell] = shard
    return sorted(taken.items())


def spread(counts: list[int], shards: list[int], capacity: list[int]) -> list[list[tuple[int, int, int, int]]]:
    """Per arc, the (first rank, end, shard, first slot) that its rows get; rows beyond a full shard go on clockwise.

    Its size is that of the ring (nodes and their overflow), whatever the number of rows.
    """
    free, slot = capacity.copy(), [0] * len(capacity)
    placed = [0] * len(counts)
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in counts]
    waiting = [a for a, n in enumerate(counts) if n]
    for hop in range(len(counts)):
        if not waiting:
            break
        for a in waiting:
            shard = shards[(a + hop) % len(counts)]
            if take := min(counts[a] - placed[a], free[shard]):
                out[a].append((placed[a], placed[a] + take, shard, slot[shard]))
                placed[a] += take
                free[shard] -= take
                slot[shard] += take
        waiting = [a for a in waiting if placed[a] < counts[a]]
    return out


def ring_shards(docs: DataFrame, n_shards: int = 24, nodes: int = 32, key: str = "doc_id", text: str = "text", rows_a_group: int = 50_000) -> DataFrame:
    """(key, size, text_crc32, shard, slot): rows in shards whose counts are at most one apart.

    Equal rows are counted first, so that a row with any number of copies is one row of the windows. Rows are ranked
    inside an arc by two hashes; an arc is cut into groups of about rows_a_group by the second hash (of key and text),
    so no arc, however full, meets in one task. The driver gets one count for each arc, and the plan for the ring's
    arcs goes back as a broadcast of at most nodes * n_shards rows with a few spans each.
    """
    spark = docs.sparkSession
    nodes_at = ring(n_shards, nodes)
    cells, shards = [c for c, _ in nodes_at], [s for _, s in nodes_at]
    arc_of, a = [], 0
    for cell in range(CELLS):
        while a < len(cells) and cells[a] < cell:
            a += 1
        arc_of.append((cell, a % len(cells)))
    arcs = F.broadcast(spark.createDataFrame(arc_of, "cell int, arc int"))
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    base = docs.select(F.col(key), (F.octet_length(raw) + F.lit(8)).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    base = base.groupBy(key, "size", "text_crc32").agg(F.count("*").alias("rows"))
    hashed = base.withColumn("first_hash", F.xxhash64(F.lit("arc"), F.coalesce(F.col(key).cast("string"), F.lit("~"))))
    hashed = hashed.withColumn("second_hash", F.xxhash64(F.lit("group"), "first_hash", "size", "text_crc32"))
    rows = written(hashed.withColumn("cell", F.shiftrightunsigned("first_hash", 48).cast("int")).join(arcs, "cell").drop("cell"), "ring")
    groups = F.lit(max(1, -(-rows.count() // (len(cells) * rows_a_group))))
    rows = rows.withColumn("part", F.pmod("second_hash", groups).cast("int"))
    counts = written(rows.groupBy("arc", "part").agg(F.sum("rows").alias("n")), "ring-counts")
    per_arc = [0] * len(cells)
    for r in counts.groupBy("arc").agg(F.sum("n").alias("n")).collect():
        per_arc[r["arc"]] = r["n"]
    total = sum(per_arc)
    capacity = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    spans = F.broadcast(spark.createDataFrame(list(enumerate(spread(per_arc, shards, capacity))), "arc int, spans array<struct<low:long,high:long,shard:int,slot:long>>"))
    parts_before = W.partitionBy("arc").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select("arc", "part", F.coalesce(F.sum("n").over(parts_before), F.lit(0)).alias("rank_before"))
    in_part = W.partitionBy("arc", "part").orderBy("second_hash", "first_hash", F.col(key).cast("string"), "text_crc32", "size").rowsBetween(W.unboundedPreceding, -1)
    ranked = rows.withColumn("rank_inside", F.coalesce(F.sum("rows").over(in_part), F.lit(0))).join(before, ["arc", "part"])
    ranked = written(ranked.select(key, "size", "text_crc32", "arc", "rows", (F.col("rank_inside") + F.col("rank_before")).alias("first_rank")), "ring-ranks")
    each = repeated(ranked, "rows", "copy").withColumn("rank", F.col("first_rank") + F.col("copy")).join(spans, "arc")
    span = F.try_element_at(F.filter("spans", lambda x: (x["low"] <= F.col("rank")) & (F.col("rank") < x["high"])), F.lit(1))
    return each.withColumn("span", span).select(key, "size", "text_crc32", F.col("span.shard").alias("shard"), (F.col("span.slot") + F.col("rank") - F.col("span.low")).alias("slot"))
