"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Keys and virtual nodes sit on a ring of `2 ** ring_bits` buckets. A key belongs to the next virtual node clockwise.
A shard holds at most its share of the rows; keys that find it full go on clockwise to the next virtual node of a
shard with room, nearest keys first. Spark counts the rows of each bucket; from those counts, at most one row a
bucket, the driver works out which runs of keys stay where. Each row then finds its run by its rank in its
bucket. Only ids, sizes and checksums are shuffled, never texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ring:
    """`shards` shards of `virtual` virtual nodes each on `2 ** ring_bits` buckets."""

    shards: int = 8
    virtual: int = 64
    ring_bits: int = 14

    def nodes(self) -> list[tuple[int, int]]:
        """(bucket, shard) of the virtual nodes in ring order; two on one bucket keep the order of their shards."""
        shift = 64 - self.ring_bits
        return sorted((xxhash.xxh64_intdigest(f"{s}/{v}", 0) >> shift, s) for s in range(self.shards) for v in range(self.virtual))


@dataclass
class Run:
    """Keys of one bucket, by rank from `low` to before `high`, and their place."""

    bucket: int
    low: int
    high: int
    shard: int = -1
    slot: int = -1
    hops: int = 0


def place_runs(counts: dict[int, int], ring: Ring) -> list[Run]:
    """Places every key of every bucket. Capacities differ by one at most and add up to the number of keys."""
    nodes = ring.nodes()
    total = sum(counts.values())
    room = [total // ring.shards + (s < total % ring.shards) for s in range(ring.shards)]
    filled = [0] * ring.shards
    waiting: list[list[Run]] = [[] for _ in nodes]
    at = 0
    for bucket in sorted(counts):
        while at < len(nodes) and nodes[at][0] < bucket:
            at += 1
        waiting[at % len(nodes)].append(Run(bucket, 0, counts[bucket]))
    placed: list[Run] = []
    while any(waiting):
        moved: list[list[Run]] = [[] for _ in nodes]
        for k, (_, shard) in enumerate(nodes):
            for run in waiting[k]:
                fits = min(room[shard] - filled[shard], run.high - run.low)
                if fits:
                    placed.append(Run(run.bucket, run.low, run.low + fits, shard, filled[shard], run.hops))
                    filled[shard] += fits
                if run.low + fits < run.high:
                    moved[(k + 1) % len(nodes)].append(Run(run.bucket, run.low + fits, run.high, hops=run.hops + 1))
        waiting = moved
    return placed


def sharded(docs: DataFrame, ring: Ring = Ring()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, hops of every row of `docs`; the law is `rows`.

    Row counts of two shards differ by one at most. `slot` counts the rows of a shard from 0; `hops` is the number of
    virtual nodes passed by. A null text counts as empty, a null doc_id is a key like any other, and rows that
    repeat a doc_id share its place on the ring and are told apart by size and checksum. An empty table gives an
    empty one; further columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    bucket = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 64 - ring.ring_bits)
    place = F.xxhash64(F.lit(1), F.col("doc_id"))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), bucket.alias("bucket"))
    counts = {r["bucket"]: r["count"] for r in docs.select(bucket.alias("bucket")).groupBy("bucket").count().collect()}  # one row a bucket
    runs = [(r.bucket, r.low, r.high, r.shard, r.slot, r.hops) for r in place_runs(counts, ring)]
    table = docs.sparkSession.createDataFrame(runs, "bucket bigint, low bigint, high bigint, shard int, first bigint, hops int")
    order = Window.partitionBy("bucket").orderBy(place, "doc_id", "size", "text_crc32")
    ranked = rows.withColumn("rank", F.row_number().over(order) - 1)
    out = ranked.join(F.broadcast(table), "bucket").filter("rank >= low and rank < high")
    slot = F.col("first") + F.col("rank") - F.col("low")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "hops")
