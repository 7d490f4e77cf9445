"""Shards of near equal bytes for indivisible groups, by Karmarkar-Karp differencing.

Rows of equal text are one group.  Groups are dealt into buckets by a hash; within a bucket
every group starts as a partial partition (its bytes in one shard, none in the others), and
the two partial partitions of largest spread are combined, the heaviest shard of one with
the lightest of the other, until one is left.  The partial partitions of the buckets, one row
of sums each, are combined the same way in tasks of at most about FAN, level by level, until
one is left; nothing but their number reaches the driver.

Slots number the rows of a shard by doc_id: rows are numbered within hash buckets of a
shard, and the buckets' counts are added up, so no task sorts a whole shard.

Cases: a null text has no bytes and shares a group with the empty one.  Repeated rows are
rows of their own, with slots of their own.  An empty table gives an empty result.  Extra
columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from posefarm.llm.store import stored

GROUPS_PER_BUCKET = 20_000
#: Partial partitions that one task combines on the levels above.
FAN = 2000
ROWS_PER_BUCKET = 200_000


def difference(parts: list[list[int]]) -> list[list[int]]:
    """Combine partial partitions (k sums each) to one.

    Returns, for each of them, the final shard of each of its k shards.
    """
    k = len(parts[0])
    sums: list[list[int]] = []
    places: list[list[int]] = []  # of each node: which of its shards is where in the sorted sums
    for p in parts:
        order = sorted(range(k), key=lambda s: (-p[s], s))
        sums.append([p[s] for s in order])
        places.append(order)
    heap = [(s[-1] - s[0], i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    joins: list[tuple[int, int, list[int]]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        added = [x + y for x, y in zip(sums[a], reversed(sums[b]))]
        order = sorted(range(k), key=lambda s: (-added[s], s))
        joins.append((a, b, order))
        sums[a] = sums[b] = []
        sums.append([added[s] for s in order])
        heapq.heappush(heap, (sums[-1][-1] - sums[-1][0], len(sums) - 1))
    # From the last combination down: the final shard of every place of a node.
    final: dict[int, list[int]] = {len(sums) - 1: list(range(k))}
    for node in range(len(sums) - 1, len(parts) - 1, -1):
        a, b, order = joins[node - len(parts)]
        mine = final.pop(node)
        before = [0] * k
        for place, s in enumerate(order):
            before[s] = mine[place]
        final[a], final[b] = before, before[::-1]
    out = []
    for i, order in enumerate(places):
        shard = [0] * k
        for place, s in enumerate(order):
            shard[s] = final[i][place]
        out.append(shard)
    return out


def _dealt(groups: DataFrame, shards: int) -> DataFrame:
    """(bucket, key, part, bytes): the place of every group in its bucket's partition."""

    def deal(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["bytes", "key"], ascending=[False, True], ignore_index=True)
        start = [[int(b)] + [0] * (shards - 1) for b in frame["bytes"]]
        return frame.assign(part=np.array([s[0] for s in difference(start)], np.int32))[["bucket", "key", "part", "bytes"]]

    return groups.groupBy("bucket").applyInPandas(deal, "bucket long, key string, part int, bytes long")


def _combined(sums: DataFrame, shards: int) -> DataFrame:
    """(bucket, part, shard): where each bucket's parts go when all partial partitions,
    (bucket, part, bytes), are combined to one."""

    def combine(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node", ignore_index=True)
        own = [[int(x) for x in s] for s in frame["sums"]]
        places = difference(own)
        total = [0] * shards
        for s, p in zip(own, places):
            for part, place in enumerate(p):
                total[place] += s[part]
        return frame[["up", "node"]].assign(places=places, sums=[total, *[None] * (len(own) - 1)])

    parts = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda k: F.coalesce(F.col("m")[k], F.lit(0).cast("long")))
    nodes = sums.groupBy(F.col("bucket").alias("node")).agg(F.map_from_entries(F.collect_list(F.struct("part", "bytes"))).alias("m")).select("node", parts.alias("sums"))
    # A level maps (node, part) to (node above, part there).
    way = sums.select("bucket", "part", F.col("bucket").alias("node"), F.col("part").alias("shard"))
    while True:
        nodes = stored(nodes, "nodes")
        groups = max(1, -(-nodes.count() // FAN))
        grouped = nodes.withColumn("up", F.pmod(F.xxhash64("node"), F.lit(groups))).groupBy("up")
        level = stored(grouped.applyInPandas(combine, "up long, node long, places array<int>, sums array<long>"), "level")
        way = way.join(level.select("node", "up", "places"), "node").select(
            "bucket", "part", F.col("up").alias("node"), F.element_at("places", F.col("shard") + 1).alias("shard"))
        if groups == 1:
            return way.select("bucket", "part", "shard")
        nodes = level.filter("sums IS NOT NULL").select(F.col("up").alias("node"), "sums")


def sharded(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = stored(docs.select(F.col("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
                              F.sha2(text, 256).alias("key")), "sizes")
    n = rows.count()
    if not n:
        return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"),
                           F.lit(None).cast("int").alias("grown_shard"))
    buckets = -(-n // GROUPS_PER_BUCKET)
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes")).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    dealt = stored(_dealt(groups, shards), "dealt")
    places = _combined(dealt.groupBy("bucket", "part").agg(F.sum("bytes").alias("bytes")), shards)
    placed = rows.join(dealt.join(places, ["bucket", "part"]).select("key", "shard"), "key").select("doc_id", "size", "text_crc32", "shard")
    placed = stored(placed.withColumn("bin", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(-(-n // ROWS_PER_BUCKET)))), "placed")
    counts = placed.groupBy("shard", "bin").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    own = Window.partitionBy("shard", "bin").orderBy("doc_id", "text_crc32")
    return placed.withColumn("place", F.row_number().over(own)).join(offsets, ["shard", "bin"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("place") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
