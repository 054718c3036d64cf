"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.shared import dropped, written


_HOT_ROWS = 200
_HOT_KEYS = 10_000


def spread_join(left: DataFrame, right: DataFrame, key: str, rows: int) -> DataFrame:
    """Inner join on `key`. `right` has one row for a key and in `n` the number of rows that `left` has of it.

    Keys of over `limit` rows are dealt out by the other columns of `left` over several tasks. There are at most
    `_HOT_KEYS` of them in `rows` rows of `left`, or fewer in a small table, so that their list can be broadcast.
    """
    limit = max(_HOT_ROWS, rows // _HOT_KEYS)
    parts = F.ceil(F.col("n") / limit).cast("int")
    hot = right.filter(F.col("n") > limit).select(key, parts.alias("_parts"))
    dealt = left.join(F.broadcast(hot), key, "left")
    part = F.coalesce(F.pmod(F.xxhash64(*left.columns), "_parts"), F.lit(0)).cast("int")
    dealt = dealt.select(*left.columns, part.alias("_part"))
    copies = right.withColumn("_part", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1))).drop("n")
    return dealt.join(copies, [key, "_part"]).drop("_part")


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    """Ties every larger neighbour of a node to the smallest node around it."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count_if(F.expr("b > a")).alias("n"))
    return spread_join(both.filter("b > a"), least, "a", rows).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    """Ties a node and its smaller neighbours to the smallest of them. Edges point from `a` down to `b`."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    moved = spread_join(edges, least, "a", rows).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).filter("a > b")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Maps nodes to the smallest node that they reach.

    `edges` has two columns of one orderable integer type; direction, loops and repeats do not matter and
    null ends are ignored. Returns `node`, `component` for every node on an edge to another node. Minima are
    pre-aggregated before each shuffle and the joins are plain equi joins, which adaptive execution splits
    where a node has very many neighbours. Each round is written to the shared folder.
    """
    a, b = edges.columns
    now = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a > b").distinct()
    now, before = written(now, "edges"), None
    for _ in range(max_rounds):
        total = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if total == before:
            break
        after = written(_small_star(_large_star(now, total[0]), total[0]).distinct(), "edges")
        dropped(now)
        now, before = after, total
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
