"""Sharding with near-equal bytes by Karmarkar-Karp differencing over indivisible groups of equal texts."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.common import read, small, written


def differencing(sizes: list[int], k: int) -> list[int]:
    """Shard of each item: the two partial partitions of largest spread are combined again and again, oppositely ordered."""
    if not sizes:
        return []
    heap = []
    for i, s in enumerate(sizes):
        sums = np.zeros(k, np.int64)
        sums[0] = s
        heap.append((-int(s), i, sums))
    heapq.heapify(heap)
    merged: list[tuple[int, int, np.ndarray]] = []
    n = len(sizes)
    while len(heap) > 1:
        _, a, left = heapq.heappop(heap)
        _, b, right = heapq.heappop(heap)
        sums = left + right[::-1]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        merged.append((a, b, order))
        heapq.heappush(heap, (int(sums[-1] - sums[0]), n + len(merged) - 1, sums - sums[-1]))
    names = {n + len(merged) - 1: np.arange(k)}
    for i in range(len(merged) - 1, -1, -1):
        a, b, order = merged[i]
        own = names.pop(n + i)
        names[a], names[b] = np.empty(k, int), np.empty(k, int)
        names[a][order] = own
        names[b][k - 1 - order] = own
    return [int(names[i][0]) for i in range(n)]


def shard(docs: DataFrame, shards: int = 16, chunks: int = 4096, part_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, size, text_crc32, text_key, shard, slot for each row of docs (doc_id, text).

    Groups of equal texts stay whole. A group of at least a 1/chunks share of all bytes (there are at most `chunks`
    of them) is an item of its own; the others are dealt by key into `chunks` items. So the driver gets at most twice
    `chunks` sums, whatever the number of rows, and differencing sets each item's shard. Slots count from 0 in each
    shard without gaps: counts by (shard, part) give each part's offset. Null texts form one group of size 1 a row;
    an empty table gives an empty result; repeated rows get slots of their own.
    """
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.md5("text"), F.lit("null")).alias("text_key"),
    )
    rows = written(rows, "shard-rows")
    groups = written(rows.groupBy("text_key").agg(F.sum("size").alias("bytes")), "shard-groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    bucket = F.pmod(F.xxhash64("text_key"), F.lit(chunks)).cast("string")
    groups = groups.withColumn("heavy", F.col("bytes") * chunks >= total)
    groups = groups.withColumn("item", F.when(F.col("heavy"), F.col("text_key")).otherwise(bucket))
    items = groups.groupBy("heavy", "item").agg(F.sum("bytes").alias("bytes")).collect()  # at most 2 * chunks rows
    items.sort(key=lambda r: (-r["bytes"], r["item"]))
    homes = differencing([r["bytes"] for r in items], shards)
    table = docs.sparkSession.createDataFrame([(r["heavy"], r["item"], h) for r, h in zip(items, homes, strict=True)], "heavy boolean, item string, shard int")
    heavy_keys = table.filter("heavy").select(F.col("item").alias("heavy_key"))
    rows = rows.join(F.broadcast(heavy_keys), F.col("text_key") == F.col("heavy_key"), "left")
    rows = rows.withColumn("item", F.coalesce("heavy_key", bucket))
    rows = rows.join(F.broadcast(table.drop("heavy")), "item").drop("item", "heavy_key")
    parts = max(64, total // (shards * part_bytes) + 1)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(parts)))
    counts = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("shard", "part", before.alias("offset"))  # shards * parts rows
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_key")) - 1
    rows = rows.withColumn("within", within).join(small(offsets), ["shard", "part"])
    return rows.select("doc_id", "size", "text_crc32", "text_key", "shard", (F.col("offset") + F.col("within")).cast("long").alias("slot"))


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near-equal bytes."""
    out = shard(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
