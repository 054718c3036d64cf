"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints of one or more 64-bit words are made inside map tasks; only ids and fingerprints are shuffled.
Equal fingerprints are merged first. The index is a tree of masked bit patterns. Each node of its top level is a
mask and a pattern, and the shuffle deals the nodes out. `pigeonhole_masks` choose the masks so that no pair is
lost: 64 bits in `blocks` blocks, every choice of `blocks - max_bits` of them; two fingerprints that differ in
`max_bits` bits agree on one such choice. The number of blocks grows with the table, so that nodes don't. For the wide limits of long fingerprints, `sampled_masks` take
disjoint groups of bits, as many as the target recall at the limit needs. Inside a node fingerprints are sorted by
Gray rank; runs of them are factored into nested nodes that hold the bits all members share, and a pair of
nodes is pruned as a whole once the bits that both fix differ in more than `max_bits` places. A node with more
than `node_rows` fingerprints is cut into chunks, each pair of which is searched by itself, so no task holds an
unbounded node. A node returns a spanning forest of its links, at most one row for a member, never all pairs.
`one_of_each` takes these links as candidates only and decides on the shingle sets themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.llm.components import connected_components, spread_join
from lintlake.llm.shared import written

_LEAF = 16
_NODE_TARGET = 256
_FRONTIER = 2048
_SHINGLES = 400_000


def shingle_hashes(raw: bytes, words: int) -> np.ndarray:
    """XXH64 values of a text's word shingles in order; none for a wordless text."""
    found = raw.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: max(1, len(found) - words + 1)].tolist()
    shingles = [joined[a:b] for a, b in zip(starts, ends[min(words, len(found)) - 1 :].tolist(), strict=True)]
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, len(shingles))


def _majority(hashes: np.ndarray, width: int) -> np.ndarray:
    """Fingerprint words of shingle hashes."""
    total = np.zeros((width, 64), np.int64)
    for k in range(0, len(hashes), 32768):
        part = hashes[k : k + 32768]
        for w in range(width):
            if w:
                part = (part ^ (part >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
                part ^= part >> np.uint64(29)
            total[w] += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint16)
    return np.packbits(total * 2 > len(hashes), axis=1, bitorder="little").view(np.uint64).ravel()


def simhash(raw: bytes, words: int, width: int = 1, once: bool = False) -> np.ndarray:
    """Fingerprint of a text's word shingles: bit set where over half of the shingles' XXH64 values have it.

    Further fingerprint words (`width` over 1) come from mixes of the same hashes; `once` counts equal shingles once.
    """
    hashes = shingle_hashes(raw, words)
    return _majority(np.unique(hashes) if once else hashes, width)


def fingerprints(docs: DataFrame, words: int = 5, width: int = 1, once: bool = False) -> DataFrame:
    """`doc_id`, `f0`, `f1`... (64 bits in a long each) of every row; a null or wordless text has zeros."""
    names = [f"f{w}" for w in range(width)]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [simhash(raw.as_py(), words, width, once) for raw in batch["_raw"]]
            columns = np.array(found, np.uint64).reshape(-1, width).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(columns[:, w]) for w in range(width))], ["doc_id", *names])

    texts = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).cast("binary").alias("_raw"))
    return texts.mapInArrow(hashed, ", ".join(f"{c} bigint" for c in ["doc_id", *names]))


def gray_rank(bits: Column) -> Column:
    """Place of a 64-bit pattern in Gray order: the running exclusive-or of its bits from the top."""
    for k in (1, 2, 4, 8, 16, 32):
        bits = bits.bitwiseXOR(F.shiftrightunsigned(bits, k))
    return bits


def _signed(word: int) -> int:
    return word - (1 << 64) if word >> 63 else word


def pigeonhole_masks(max_bits: int, blocks: int) -> list[list[int]]:
    """One-word masks, one for each choice of `blocks - max_bits` of `blocks` near-equal blocks of 64 bits."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [[_signed(sum(c))] for c in combinations(parts, blocks - max_bits)]


def block_count(rows: int, max_bits: int) -> int:
    """The fewest blocks whose masks leave about `_NODE_TARGET` of `rows` fingerprints, or fewer, in a node."""
    blocks = max_bits + 1
    while blocks < 16 and rows > _NODE_TARGET * 2 ** (64 * (blocks - max_bits) / blocks):
        blocks += 1
    return blocks


def sampled_masks(width: int, max_bits: int, node_bits: int, recall: float) -> list[list[int]]:
    """Masks of `node_bits` random bits each, disjoint as far as the fingerprint goes, so many that two
    fingerprints at the limit agree on one of them with probability `recall` (closer ones are surer)."""
    agree = (1 - max_bits / (64 * width)) ** node_bits
    rng, masks, deck = np.random.default_rng(7), [], []
    for _ in range(math.ceil(math.log(1 - recall) / math.log(1 - agree))):
        if len(deck) < node_bits:
            deck = rng.permutation(64 * width).tolist()
        words = [0] * width
        for bit in (deck.pop() for _ in range(node_bits)):
            words[bit // 64] |= 1 << (bit % 64)
        masks.append([_signed(x) for x in words])
    return masks


def _levels(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(mask, pattern) of the runs of a Gray-sorted array: leaves of `_LEAF` first, then 16 nodes to a parent."""
    ones = zeros = fps
    found = []
    while True:
        at = np.arange(0, len(ones), _LEAF)
        ones, zeros = np.bitwise_and.reduceat(ones, at), np.bitwise_or.reduceat(zeros, at)
        found.append((~(ones ^ zeros), ones))
        if len(ones) == 1:
            return found


def _merge(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the sets of i and j in a flat union-find, in which labels[x] is the root of x."""
    a, b = labels[i], labels[j]
    pairs = np.unique((a * len(labels) + b)[a != b])
    for x, y in zip((pairs // len(labels)).tolist(), (pairs % len(labels)).tolist(), strict=True):
        x, y = labels[x], labels[y]
        if x != y:
            labels[labels == max(x, y)] = min(x, y)


def _near(left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that differ in few enough bits; differences add up word by word and pairs past the limit go."""
    seen = np.zeros(len(a), np.int64)
    for w in range(left.shape[1]):
        seen += np.bitwise_count(left[a, w] ^ right[b, w])
        on = seen <= max_bits
        a, b, seen = a[on], b[on], seen[on]
    return a, b


def _search(left: np.ndarray, right: np.ndarray, labels: np.ndarray, shift: int, max_bits: int) -> None:
    """Merges all linked pairs of two Gray-sorted arrays, descending both trees together."""
    up_l, up_r = _levels(left), _levels(right)
    top = max(len(up_l), len(up_r))
    up_l += [up_l[-1]] * (top - len(up_l))
    up_r += [up_r[-1]] * (top - len(up_r))
    work = [(top - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while work:
        level, i, j = work.pop()
        if len(i) > _FRONTIER:
            work += [(level, i[k : k + _FRONTIER], j[k : k + _FRONTIER]) for k in range(0, len(i), _FRONTIER)]
            continue
        (m, p), (n, q) = up_l[level], up_r[level]
        near = np.bitwise_count((p[i] ^ q[j]) & m[i] & n[j]).sum(1, dtype=np.int64) <= max_bits
        if not shift:
            near &= i <= j
        i, j = i[near], j[near]
        if not len(i):
            continue
        below_l = len(up_l[level - 1][0]) if level else len(left)
        below_r = len(up_r[level - 1][0]) if level else len(right)
        wide_l = _LEAF if below_l > len(p) else 1
        wide_r = _LEAF if below_r > len(q) else 1
        a = (i[:, None] * wide_l + np.arange(wide_l)).repeat(wide_r, axis=1).ravel()
        b = np.tile(j[:, None] * wide_r + np.arange(wide_r), (1, wide_l)).ravel()
        real = (a < below_l) & (b < below_r)
        if not shift and not level:
            real &= a < b
        a, b = a[real], b[real]
        if level:
            work.append((level - 1, a, b))
        else:
            a, b = _near(left, right, a, b, max_bits)
            _merge(labels, a, b + shift)


def node_links(fps: np.ndarray, halves: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of one node, as places in it. `halves`: 0 for all, or 1 and 2 for two chunks to compare."""
    labels = np.arange(len(fps))
    if halves.any():
        first = int((halves == 1).sum())
        if 0 < first < len(fps):
            _search(fps[:first], fps[first:], labels, first, max_bits)
    else:
        _search(fps, fps, labels, 0, max_bits)
    moved = np.flatnonzero(labels != np.arange(len(fps)))
    return moved, labels[moved]


def _node_stream(max_bits: int, width: int):
    """Reads rows sorted by node, half and Gray rank; keeps the rows of one unfinished node between batches."""

    def small(keys: np.ndarray, fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for k in range(1, _LEAF):
            at = np.flatnonzero(keys[k:] == keys[:-k])
            if not len(at):
                break
            out.append(_near(fps, fps, at + k, at, max_bits))
        return out

    def linked(keys: np.ndarray, halves: np.ndarray, ids: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(at, len(keys)))
        large = (sizes > _LEAF) | (halves[at] > 0)
        rest = np.flatnonzero(~large.repeat(sizes))
        found = [(rest[a], rest[b]) for a, b in small(keys[rest], fps[rest])]
        for start, n in zip(at[large], sizes[large], strict=True):
            a, b = node_links(fps[start : start + n], halves[start : start + n], max_bits)
            found.append((a + start, b + start))
        if found:
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            words = np.stack([batch[f"f{w}"].to_numpy().view(np.uint64) for w in range(width)], axis=1)
            now = [batch["node"].to_numpy(), batch["half"].to_numpy(), batch["id"].to_numpy(), words]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            whole = np.searchsorted(held[0], held[0][-1]) if len(held[0]) else 0
            if whole:
                yield from linked(*(x[:whole] for x in held))
                held = [x[whole:] for x in held]
        if held is not None and len(held[0]):
            yield from linked(*held)

    return stream


def _meetings(*member: str) -> Column:
    """The pairs `x`, `y` of chunks, with the `half` of its own, in which a row of a key with `chunks` chunks takes part."""
    own = F.pmod(F.xxhash64(*member), "chunks").cast("int")

    def meeting(other: Column) -> Column:
        half = F.when(own == other, 0).when(own < other, 1).otherwise(2)
        return F.struct(F.least(own, other).alias("x"), F.greatest(own, other).alias("y"), half.alias("half"))

    alone = F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("half")))
    return F.when(F.col("chunks").isNull(), alone).otherwise(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), meeting))


def fingerprint_id(width: int) -> Column:
    """The id of a fingerprint `f0`, `f1`...: itself, or a hash of its words."""
    return F.col("f0") if width == 1 else F.xxhash64(*(f"f{w}" for w in range(width)))


def linked_fingerprints(fps: DataFrame, masks: list[list[int]], max_bits: int, node_rows: int = 8192) -> DataFrame:
    """Pairs `a`, `b` of `fingerprint_id`s of fingerprints that differ in at most `max_bits` bits: enough of them to connect
    all that meet under a mask. `fps` has distinct fingerprints `f0`, `f1`..., which are all that is shuffled."""
    width = len(masks[0])
    names = [f"f{w}" for w in range(width)]
    listed = F.array(*(F.array(*(F.lit(x) for x in mask)) for mask in masks))
    placed = fps.select(*names, F.posexplode(listed).alias("m", "mask"))
    placed = placed.select(*names, F.xxhash64("m", *(F.col(f).bitwiseAND(F.col("mask")[w]) for w, f in enumerate(names))).alias("key"))
    crowded = placed.groupBy("key").count().filter(F.col("count") > node_rows)
    crowded = crowded.select("key", F.ceil(F.col("count") / node_rows).cast("int").alias("chunks"))
    placed = placed.join(crowded, "key", "left")
    dealt = placed.select("key", *names, F.inline(_meetings(*names)))
    node = F.when((F.col("x") == 0) & (F.col("y") == 0), F.col("key")).otherwise(F.xxhash64("key", "x", "y"))
    dealt = dealt.select(node.alias("node"), "half", *names).repartition("node").sortWithinPartitions("node", "half", gray_rank(F.col("f0")))
    return dealt.withColumn("id", fingerprint_id(width)).mapInArrow(_node_stream(max_bits, width), "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, words: int = 5, max_bits: int = 4, masks: list[list[int]] | None = None, once: bool = False, node_rows: int = 8192
) -> DataFrame:
    """`doc_id`, `fingerprint` (16 hex digits a word), `component_id` of every row of `docs`.

    `component_id` is the smallest doc_id reachable over links of at most `max_bits` differing bits, itself
    included. The default masks, for 64-bit fingerprints, lose no link. Null, empty and wordless texts have
    fingerprint zero and link like any other; rows with a null doc_id take part and get the component of their
    fingerprint (null if no member has an id); repeated rows each get a row; an empty table gives an empty one;
    further columns are ignored.
    """
    names = [f"f{w}" for w in range(len(masks[0]) if masks else 1)]
    rows = written(fingerprints(docs, words, len(names), once), "fingerprints")
    total = rows.count()
    masks = masks or pigeonhole_masks(max_bits, block_count(total, max_bits))
    own_id = fingerprint_id(len(names))
    least = written(rows.groupBy(*names).agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).withColumn("id", own_id), "distinct")
    parts = connected_components(linked_fingerprints(least.select(*names), masks, max_bits, node_rows))
    members = least.join(parts, least.id == parts.node, "left").select("id", "least", "n", F.coalesce("component", "id").alias("part"))
    roots = members.groupBy("part").agg(F.min("least").alias("root"), F.count("*").alias("n"))
    classes = spread_join(members.withColumnRenamed("n", "times"), roots, "part", total).select("id", F.col("root").alias("component_id"), F.col("times").alias("n"))
    out = spread_join(rows.withColumn("id", own_id), classes, "id", total)
    digits = F.concat(*(F.lower(F.lpad(F.hex(f), 16, "0")) for f in names))
    return out.select("doc_id", digits.alias("fingerprint"), "component_id")


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint"), _text_hash().alias("hash"), F.coalesce("text", F.lit("")).cast("binary").alias("_raw"))


def _set_id(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), 7) - (1 << 63)


def shingle_sets(docs: DataFrame, words: int, width: int) -> DataFrame:
    """`doc_id`, `hash` (of the text), `set` (digest of the distinct shingles), `size` (their number) and fingerprint `f0`,
    `f1`... of every row."""
    names = [f"f{w}" for w in range(width)]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for raw in batch["_raw"]:
                own = np.unique(shingle_hashes(raw.as_py(), words))
                found.append((_set_id(own), len(own), *_majority(own, width).view(np.int64).tolist()))
            columns = np.array(found, np.int64).reshape(-1, 2 + width)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["hash"], *map(pa.array, columns.T)], ["doc_id", "hash", "set", "size", *names])

    return _keyed(docs).mapInArrow(hashed, ", ".join(f"{c} bigint" for c in ["doc_id", "hash", "set", "size", *names]))


def similar_sets(sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Spanning forest, as places in `sets`, of all pairs of sets of Jaccard similarity `similarity` or more.

    From each set in turn the search meets only sets that no class has reached yet, and only those of a size that
    allows the similarity, so a class of n near copies takes about n comparisons.
    """
    sizes = np.array([len(x) for x in sets], np.int64)
    rest = np.argsort(sizes, kind="stable")
    rest = rest[sizes[rest] > 0]
    if len(rest) < 2:
        return [], []
    values, places = np.unique(np.concatenate([sets[x] for x in rest]), return_inverse=True)
    mark, a, b = np.zeros(len(values), bool), [], []
    while len(rest) > 1:
        first, own = rest[0], places[: sizes[rest[0]]].copy()
        rest, places, work = rest[1:], places[len(own) :], [(first, own)]
        while work and len(rest):
            source, own = work.pop()
            n, ends = len(own), np.cumsum(sizes[rest])
            low, high = np.searchsorted(sizes[rest], [similarity * n * (1 - 1e-9), n / similarity * (1 + 1e-9)])
            if low == high:
                continue
            mark[own] = True
            starts = ends[low:high] - sizes[rest[low:high]]
            shared = np.add.reduceat(mark[places[starts[0] : ends[high - 1]]], starts - starts[0], dtype=np.int64)
            mark[own] = False
            hits = low + np.flatnonzero(shared / (n + sizes[rest[low:high]] - shared) >= similarity)
            if len(hits):
                work += [(rest[h], places[ends[h] - sizes[rest[h]] : ends[h]].copy()) for h in hits]  # a view would hold all places
                a += [int(source)] * len(hits)
                b += rest[hits].tolist()
                stay = np.ones(len(rest), bool)
                stay[hits] = False
                rest, places = rest[stay], places[stay.repeat(sizes[rest])]
    return a, b


def _similar_stream(words: int, similarity: float):
    """Reads texts sorted by candidate class; keeps the distinct shingle sets of one unfinished class between batches."""

    def linked(held: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        ids = list(held)
        a, b = similar_sets(list(held.values()), similarity)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array([ids[x] for x in a], pa.int64()), pa.array([ids[x] for x in b], pa.int64())], ["a", "b"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}
        for batch in batches:
            for now, own, raw in zip(batch["key"].to_pylist(), batch["set"].to_pylist(), batch["_raw"], strict=True):
                if now != key:
                    yield from linked(held)
                    key, held = now, {}
                held[own] = np.unique(shingle_hashes(raw.as_py(), words))
        yield from linked(held)

    return stream


def similar_links(docs: DataFrame, classes: DataFrame, rows: int, words: int, similarity: float, shingles: int = _SHINGLES) -> DataFrame:
    """Pairs `a`, `b` of sets of one candidate class whose exact Jaccard similarity is `similarity` or more: enough
    of them to connect all such pairs of the class.

    `classes`, of at most `rows` rows, has `set`, `size`, `least` (the doc_id and hash of the text that stands for the set) and `part`, the candidate class. A class of
    more than `shingles` shingles is cut into chunks, each pair of which is compared by itself.
    """
    several = classes.groupBy("part").agg(F.count("*").alias("n"), F.sum("size").alias("total")).filter("n > 1")
    chunks = F.when(F.col("total") > shingles, F.ceil(F.col("total") / shingles).cast("int"))
    chosen = spread_join(classes.drop("size"), several.select("part", "n", chunks.alias("chunks")), "part", rows)
    chosen = chosen.select("part", "set", "chunks", "least.doc_id", "least.hash").distinct()
    met = _keyed(docs).join(chosen, ["doc_id", "hash"]).select("part", "set", "_raw", F.inline(_meetings("set")))
    dealt = met.select(F.xxhash64("part", "x", "y").alias("key"), "set", "_raw").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_similar_stream(words, similarity), "a bigint, b bigint")


def near_copies(docs: DataFrame, words: int, similarity: float, width: int, node_bits: int, recall: float) -> DataFrame:
    """`doc_id`, `hash` of its text, and `root` (the least such pair reachable over pairs of shingle sets of Jaccard
    similarity `similarity` or more) of every row with a doc_id.

    Shingle sets of similarity s have cosine 2s / (1 + s), and a SimHash bit of theirs differs with probability
    acos(cosine) / pi. Candidates differ in at most that expectation over 64 * `width` bits plus three standard
    deviations, which 1 in 700 pairs at `similarity` itself exceeds; the masks find a pair at the expectation with
    probability `recall`, and one at the limit with 0.96 of the default. Candidate classes are then compared by their exact
    shingle sets.
    """
    bits, differ = 64 * width, math.acos(2 * similarity / (1 + similarity)) / math.pi
    max_bits = round(bits * differ + 3 * math.sqrt(bits * differ * (1 - differ)))
    masks = sampled_masks(width, round(bits * differ), node_bits, recall)
    names = [f"f{w}" for w in range(width)]
    rows = written(shingle_sets(docs.filter("doc_id is not null"), words, width), "fingerprints")
    total = rows.count()
    sets = rows.groupBy("set", "size", *names).agg(F.min(F.struct("doc_id", "hash")).alias("least"), F.count("*").alias("n")).withColumn("id", fingerprint_id(width))
    sets = written(sets, "sets")
    parts = connected_components(linked_fingerprints(sets.select(*names).distinct(), masks, max_bits))
    classes = sets.join(parts, sets.id == parts.node, "left").select("set", "size", "least", F.coalesce("component", "id").alias("part"))
    copies = connected_components(similar_links(docs, written(classes, "classes"), total, words, similarity))
    members = sets.join(copies, sets.set == copies.node, "left").select("set", "least", F.col("n").alias("times"), F.coalesce("component", "set").alias("component"))
    roots = members.groupBy("component").agg(F.min("least").alias("root"), F.count("*").alias("n"))
    found = spread_join(members, roots, "component", total).select("set", F.col("times").alias("n"), "root")
    return spread_join(rows.select("doc_id", "hash", "set"), found, "set", total).drop("set")


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8, width: int = 8, node_bits: int = 12, recall: float = 0.999) -> DataFrame:
    """Of each class of `near_copies` the row of `docs` with the smallest doc_id, with its columns as they were.

    Rows that repeat a doc_id are told apart by their texts: each is judged as if it had an id of its own, and of
    rows with the same doc_id and text one stays. Rows with a null doc_id stay, as no id can stand for them, and link no
    others.
    """
    found = written(near_copies(docs, words, similarity, width, node_bits, recall), "copies")
    gone = found.filter(F.col("root") != F.struct("doc_id", "hash")).select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash")).distinct()
    again = found.groupBy(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash")).count().filter("count > 1").drop("count")
    names = {c: f"_c{k}" for k, c in enumerate(docs.columns)}  # no name of theirs can clash
    keyed = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()), F.col("doc_id").cast("bigint").alias("_id"), _text_hash().alias("_hash"))
    left = keyed.join(gone, ["_id", "_hash"], "left_anti")
    once = left.join(again, ["_id", "_hash"], "left_semi").dropDuplicates(["_id", "_hash"])  # only rows that repeat are shuffled for it
    kept = left.join(again, ["_id", "_hash"], "left_anti").unionByName(once)
    return kept.select(*(F.col(n).alias(c) for c, n in names.items()))
