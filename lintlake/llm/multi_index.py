"""Embedding near-duplicates by an inverted multi-index.

Vectors are scaled to length 1 and cut into halves, each with a codebook of its own. A vector lies in the cell of
its two nearest codes, so that the two codebooks span a grid. Every vector visits cells in the order of the
multi-sequence algorithm, nearest sum of the two distances first, and stops at the distance that reaches the target
recall for pairs at the similarity limit. Each visit meets the vectors of that cell in a shuffle, where cosines in
double precision decide. Codebooks and the stopping distance come from a bounded sample, but every row is
indexed and every row visits. Of a pair the vector with the smaller key visits, so each pair is met once at most.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.components import connected_components, spread_join
from lintlake.llm.shared import written


@dataclass(frozen=True)
class IndexRules:
    """`cosine` links; `recall` is the target at that limit; `sample_rows` bounds what the codebooks are fitted on. A
    codebook has from `least_codes` to `most_codes` codes, as many as cost least if shipping a copy of a vector to a cell
    costs as much as `shipped` comparisons. `node_rows` is the most that one task holds of a cell."""

    cosine: float = 0.93
    recall: float = 0.995
    sample_rows: int = 8192
    least_codes: int = 8
    most_codes: int = 1024
    shipped: int = 2000
    node_rows: int = 16_384


@dataclass
class Index:
    """Codebooks of the halves and the stopping distance of the traversal."""

    codes: tuple[np.ndarray, np.ndarray]
    limit: float
    dims: int

    def excess(self, unit: np.ndarray) -> list[np.ndarray]:
        """For each half, squared distance to every code less that to the nearest."""
        found = []
        for half, codes in zip(np.split(unit, [self.dims // 2], axis=1), self.codes, strict=True):
            d = (half**2).sum(1)[:, None] - 2 * half @ codes.T + (codes**2).sum(1)
            found.append(d - d.min(axis=1, keepdims=True))
        return found


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _codebook(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    codes = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = (-2 * x @ codes.T + (codes**2).sum(1)).argmin(1)
        sums, sizes = np.zeros_like(codes), np.bincount(near, minlength=k)
        np.add.at(sums, near, x)
        codes = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], codes)
    return codes


def _with_codes(sample: np.ndarray, codes: int, rules: IndexRules) -> Index:
    """Codebooks of a sample of unit vectors, and the distance at which `recall` of vectors at the limiting cosine have been
    visited, as found with random vectors at that cosine to the sample."""
    rng = np.random.default_rng(11)
    dims = sample.shape[1]
    index = Index(tuple(_codebook(half, codes, rng) for half in np.split(sample, [dims // 2], axis=1)), 0.0, dims)
    noise = rng.normal(size=sample.shape)
    noise -= (noise * sample).sum(1, keepdims=True) * sample
    norm = np.linalg.norm(noise, axis=1, keepdims=True)
    other = rules.cosine * sample + (1 - rules.cosine**2) ** 0.5 * noise / np.where(norm > 0, norm, 1)
    mine, theirs = index.excess(sample), index.excess(other)
    needed = sum(np.take_along_axis(m, t.argmin(1)[:, None], 1)[:, 0] for m, t in zip(mine, theirs, strict=True))
    index.limit = float(np.quantile(needed, rules.recall)) + 1e-9
    return index


def fitted(sample: np.ndarray, peers: float, rules: IndexRules) -> Index:
    """The index that costs least where a vector has `peers` vectors of its label, by the visits of part of the sample.

    A finer grid has fewer vectors in a cell, but a vector visits more cells: twice as many codes are tried while that pays.
    """
    best, least, codes = None, np.inf, min(rules.least_codes, len(sample))
    while True:
        index = _with_codes(sample, codes, rules)
        left, right = index.excess(sample[:256])
        visits = np.mean([sum(1 for _ in multi_sequence(a, b, index.limit)) for a, b in zip(left, right, strict=True)])
        cost = visits * (1 + peers / codes**2 / rules.shipped)
        if cost >= least:
            return best
        best, least, codes = index, cost, 2 * codes
        if codes > min(rules.most_codes, len(sample) // 4):
            return best


def multi_sequence(left: np.ndarray, right: np.ndarray, limit: float) -> Iterator[tuple[int, int]]:
    """Cells (i, j) by increasing left[i] + right[j], up to the limit."""
    a, b = left.argsort(kind="stable"), right.argsort(kind="stable")
    heap, seen = [(left[a[0]] + right[b[0]], 0, 0)], {(0, 0)}
    while heap:
        total, i, j = heapq.heappop(heap)
        if total > limit:
            return
        yield int(a[i]), int(b[j])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (left[a[x]] + right[b[y]], x, y))


def _padded(column: pa.Array, dims: int) -> np.ndarray:
    out = np.zeros((len(column), dims))
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes == dims).all():
        return flat.astype(float).reshape(-1, dims)
    for row, part in zip(out, np.split(flat, np.cumsum(sizes)[:-1]), strict=True):
        row[: len(part)] = part
    return out


def _visits(index: Index):
    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                left, right = index.excess(unit_rows(_padded(part["embedding"], index.dims)))
                home = np.stack([left.argmin(1), right.argmin(1)], 1).tolist()
                rows = [(r, i, j, [i, j] != home[r]) for r in range(len(part)) for i, j in multi_sequence(left[r], right[r], index.limit)]
                take, i, j, away = (list(x) for x in zip(*rows, strict=True))
                kept = part.select(["id", "label", "copies", "embedding"]).take(pa.array(take))
                arrays = [*kept.columns, pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(away)]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "label", "copies", "embedding", "i", "j", "away"])

    return visit


def _meetings(dims: int, cosine: float):
    """Reads rows sorted by node, residents first; holds one node's residents and passes the visitors by them."""

    def emit(ids, links, peers) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(links, pa.int64()), pa.array(peers, pa.int64())], ["id", "links", "peer"])

    def meet(held, ids: np.ndarray, copies: np.ndarray, unit: np.ndarray, labels: np.ndarray, first: int = 0) -> Iterator[pa.RecordBatch]:
        h_ids, h_copies, h_unit = held
        for at in range(0, len(ids), 256):
            s = slice(at, at + 256)
            hit = (unit[s] @ h_unit.T >= cosine) & (ids[s][:, None] < h_ids)
            if not hit.any():
                continue
            rows, cols = hit.any(1), hit.any(0)
            yield emit(ids[s][rows], (hit @ h_copies)[rows], h_ids[hit.argmax(1)[rows]])
            yield emit(h_ids[cols], (copies[s] @ hit)[cols], np.full(cols.sum(), None))
            for mates in map(np.flatnonzero, hit[hit.sum(1) > 1]):
                roots = np.unique(labels[mates + first])
                if len(roots) > 1:
                    labels[np.isin(labels, roots[1:])] = roots[0]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held, labels = None, None, None

        def close() -> Iterator[pa.RecordBatch]:
            if labels is not None and (moved := labels != np.arange(len(labels))).any():
                ids = held[0]
                yield emit(ids[moved], np.zeros(moved.sum(), np.int64), ids[labels[moved]])

        for batch in batches:
            nodes, away = batch["node"].to_numpy(), batch["away"].to_numpy(zero_copy_only=False)
            ids, copies = batch["id"].to_numpy(), batch["copies"].to_numpy()
            unit = unit_rows(_padded(batch["embedding"], dims)) if len(batch) else np.zeros((0, dims))
            cuts = np.flatnonzero(np.concatenate([[True], (nodes[1:] != nodes[:-1])])) if len(batch) else []
            for a, b in zip(cuts, [*cuts[1:], len(batch)], strict=True):
                if nodes[a] != node:
                    yield from close()
                    node, held, labels = nodes[a], (ids[:0], copies[:0], unit[:0]), np.zeros(0, np.int64)
                own = slice(a, a + int((~away[a:b]).sum()))
                if own.stop > a:
                    first = len(held[0])
                    held = tuple(np.concatenate(x) for x in zip(held, (ids[own], copies[own], unit[own]), strict=True))
                    labels = np.concatenate([labels, np.arange(first, len(held[0]))])
                    yield from meet(held, ids[own], copies[own], unit[own], labels)
                    if first:  # residents of an earlier batch visit those of this one
                        yield from meet(tuple(x[first:] for x in held), *(x[:first] for x in held), labels, first)
                if own.stop < b:
                    rest = slice(own.stop, b)
                    yield from meet(held, ids[rest], copies[rest], unit[rest], labels)
        yield from close()

    return stream


def near_vectors(vectors: DataFrame, rules: IndexRules = IndexRules()) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of `vectors` (vec_id, embedding, label).

    Vectors link if their labels are equal and not null and their cosine reaches the limit. A vector that is null,
    empty, zero or holds a null or non-finite component, or has no label, links with nothing, its copies included,
    and is its own component. Vectors of different lengths do not link. Equal vectors of a label are compared
    once and counted by their number. Rows with a null vec_id link like any other and have a null component only if no
    member has an id. An empty table gives an empty one; further columns are ignored.
    """
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    usable = F.coalesce(F.col("label").isNotNull() & fine, F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("bigint"), F.col("label").cast("bigint"), "embedding", usable.alias("usable"))
    distinct = rows.filter("usable").groupBy("label", "embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    distinct = written(distinct.withColumn("id", F.xxhash64("label", "embedding")), "vectors")
    total, copies, dims = distinct.agg(F.count("*"), F.sum("copies"), F.max(F.size("embedding"))).first()
    alone = rows.filter("not usable").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    if not total:
        return alone
    dims += dims % 2
    sample = distinct.orderBy(F.xxhash64("id")).limit(rules.sample_rows).select("embedding").collect()  # bounded by sample_rows
    fit = np.zeros((len(sample), dims))
    for row, x in zip(fit, sample, strict=True):
        row[: len(x[0])] = x[0]
    peers = distinct.groupBy("label").count().agg(F.sum(F.col("count").cast("double") ** 2)).first()[0] / total
    index = fitted(unit_rows(fit), peers, rules)
    element = distinct.schema["embedding"].dataType.simpleString()
    grid = distinct.mapInArrow(_visits(index), f"id bigint, label bigint, copies bigint, embedding {element}, i int, j int, away boolean")
    cells = grid.withColumn("cell", F.xxhash64("label", F.size("embedding"), "i", "j")).drop("i", "j", "label")
    cells = written(cells, "cells")
    crowded = cells.filter("not away").groupBy("cell").count().filter(F.col("count") > rules.node_rows)
    crowded = crowded.select("cell", F.ceil(F.col("count") / rules.node_rows).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("id"), "chunks").cast("int")
    everywhere = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(c.alias("chunk"), (F.col("away") | (c != own)).alias("away_here")))
    once = F.array(F.struct(F.lit(0).alias("chunk"), F.col("away").alias("away_here")))
    dealt = cells.join(crowded, "cell", "left").select("cell", "id", "copies", "embedding", F.inline(F.when(F.col("chunks").isNull(), once).otherwise(everywhere)))
    dealt = dealt.select(F.xxhash64("cell", "chunk").alias("node"), F.col("away_here").alias("away"), "id", "copies", "embedding")
    dealt = dealt.repartition("node").sortWithinPartitions("node", "away")
    met = written(dealt.mapInArrow(_meetings(dims, rules.cosine), "id bigint, links bigint, peer bigint"), "links")
    links = met.groupBy("id").agg(F.sum("links").alias("links"))
    parts = connected_components(met.filter("peer is not null").select("id", "peer"))
    members = distinct.select("id", "copies", "least").join(parts, distinct.id == parts.node, "left").withColumn("component", F.coalesce("component", "id")).drop("node")
    roots = members.groupBy("component").agg(F.min("least").alias("root"), F.count("*").alias("n"))
    classes = spread_join(members, roots, "component", total).join(links, "id", "left")
    classes = classes.select("id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.col("root").alias("component_id"), F.col("copies").alias("n"))
    usable_rows = rows.filter("usable").select("vec_id", F.xxhash64("label", "embedding").alias("id"))
    linked = spread_join(usable_rows, classes, "id", copies).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
    return linked.unionByName(alone)
