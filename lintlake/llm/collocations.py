"""Collocations from vertical positional lists: where each frequent phrase stands, extended word by word.

Texts are cut into segments of one language and about `segment_words` words, whose words and piece ends get places. A
phrase has one list of places in each segment it stands in, so no list grows with the corpus, and the lengths of its lists
add up to its exact frequency. A list is kept if that sum reaches the limit. Level k + 1 merge-joins the places of a
phrase of k words with the places, one further, of the kept phrases that begin with its second word: a place in both is one
of the extended phrase. So a word that is rare, and a phrase that ends in a rare phrase, is never extended.

A frequent word or phrase is named by a number of one of its lists, and a longer phrase by the two phrases that overlap in
it, so phrases are told apart exactly. Only dictionaries of segments, segments and lists of places move. Lists move in blocks: all those of a
segment whose phrases a hash deals to one bucket are one deflated row, sorted by phrase, and a bucket is added up as one group. So rows
grow with segments, not with the phrases that pass the limit. From three words on lists of several segments are joined together.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.llm.shared import dropped, in_small_batches, written

_GAP = 0xFF  # stands in no UTF-8 text
_SEPARATED = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\n\x0b\x0c\r\t", bytes(range(97, 123)) + bytes([_GAP] * 10) + b" ")
_GAP_WORD = bytes([_GAP])
_SPACED_GAP = b" " + _GAP_WORD + b" "
_SHIFT, _LOW = 32, (1 << 32) - 1
_BUCKET_WORDS = 20_000  # words of the table for each bucket, up to `buckets`


@dataclass(frozen=True)
class CollocationRules:
    """The least frequency of a phrase, its most words, and of which share of its frequency (in percent) a longer phrase that holds it drops it.

    A segment has about `segment_words` words, and phrases are added up in `buckets` groups at most."""

    least: int = 100
    most_words: int = 5
    absorbed_percent: int = 100
    segment_words: int = 4_000_000
    buckets: int = 1024


def _segments(docs: DataFrame, rules: CollocationRules) -> DataFrame:
    """seg, lang, words (distinct, as they first come), counts, places (deflated int32: number in `words` of the word at a place, -1 for an end)."""
    plain = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("_raw"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made, task = 0, TaskContext.get().partitionId()
        open_: dict[str, tuple[dict, list]] = {}
        held: dict[str, int] = {}

        def closed(lang: str) -> pa.RecordBatch:
            nonlocal made
            first, parts = open_.pop(lang)
            held.pop(lang)
            places = np.concatenate(parts)
            first.pop(_GAP_WORD, None)
            counts = np.bincount(places[places >= 0], minlength=len(first))
            seg, made = (task << 10) + made, made + 1  # up to 1024 segments a task
            columns = [
                pa.array([seg], pa.int64()), pa.array([lang], pa.string()), pa.array([[w.decode() for w in first]], pa.list_(pa.string())),
                pa.array([counts.tolist()], pa.list_(pa.int64())), pa.array([zlib.compress(places.tobytes(), 1)], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["seg", "lang", "words", "counts", "places"])

        for batch in in_small_batches(batches):
            for lang, raw in zip(batch["lang"].to_pylist(), batch["_raw"], strict=True):
                first, parts = open_.setdefault(lang, ({_GAP_WORD: -1}, []))
                words = (raw.as_py().translate(_SEPARATED) + _GAP_WORD).replace(_GAP_WORD, _SPACED_GAP).split()
                for w in set(words).difference(first):
                    first[w] = len(first) - 1
                parts.append(np.fromiter(map(first.__getitem__, words), np.int32, len(words)))
                held[lang] = held.get(lang, 0) + len(words)
                if held[lang] >= rules.segment_words:
                    yield closed(lang)
        for lang in list(open_):
            yield closed(lang)

    return plain.mapInArrow(scan, "seg bigint, lang string, words array<string>, counts array<bigint>, places binary")


def _packed(keys: list[np.ndarray], counts: np.ndarray, places: np.ndarray) -> bytes:
    """Keys (int64; of the first, which ascends, the steps), counts and places of lists, deflated byte plane by byte plane."""
    columns = [np.diff(keys[0], prepend=0), *keys[1:], counts.astype(np.int32), places]
    return zlib.compress(b"".join(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes() for x in columns), 1)


def _unpacked(data: bytes, n: int, keys: int, width: int) -> list[np.ndarray]:
    """What `_packed` packed of n lists with places of `width` bytes."""
    raw, low, found = zlib.decompress(data), 0, []
    for kind in [np.int64] * keys + [np.int32, np.int32 if width == 4 else np.int64]:
        size = np.dtype(kind).itemsize
        past = len(raw) if len(found) == keys + 1 else low + n * size
        found.append(np.ascontiguousarray(np.frombuffer(raw[low:past], np.uint8).reshape(size, -1).T).view(kind).ravel())
        low = past
    found[0] = np.cumsum(found[0])
    return found


_BLOCKS = "bucket bigint, seg bigint, n bigint, size bigint, data binary"


def _block_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    kinds = [pa.int64()] * 4 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["bucket", "seg", "n", "size", "data"])


def _blocks(seg: int, buckets: int, ids: np.ndarray, which: np.ndarray, places: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """The blocks of the longer phrases at `at`: the one there, ids[which], and the one that begins one word further; `places` ascend."""
    pairs = (which[at].astype(np.int64) << _SHIFT) | which[at + 1]
    order = np.argsort(pairs, kind="stable")
    ranked, places = pairs[order], places[at][order]
    edges = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
    counts = np.diff(edges, append=len(ranked))
    a, b = ids[ranked[edges] >> _SHIFT], ids[ranked[edges] & _LOW]
    mixed = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    bucket = ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((b, a, bucket))
    a, b, counts, edges, bucket = a[order], b[order], counts[order], edges[order], bucket[order]
    pasts = np.cumsum(counts)
    places = places[np.repeat(edges - (pasts - counts), counts) + np.arange(len(places))]
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)) if len(bucket) else np.zeros(0, np.int64)
    ends = np.concatenate([[0], pasts])
    rows = []
    for low, past in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
        own = places[ends[low] : ends[past]]
        rows.append((int(bucket[low]), seg, past - low, len(own), _packed([a[low:past], b[low:past]], counts[low:past], own)))
    return _block_rows(rows)


def _named(rows: DataFrame, key: list[str]) -> DataFrame:
    """`rows` by key, with numbers `own` and in `id` the least number of a key's rows, which names the key.

    Rows are numbered where they are grouped, so that no number moves; write the result, as another run numbers anew.
    """
    numbered = rows.repartition(*key).withColumn("own", F.monotonically_increasing_id())
    return numbered.withColumn("id", F.min("own").over(Window.partitionBy(*key)))


def _pairs(segments: DataFrame, frequent: DataFrame, buckets: int) -> DataFrame:
    """The blocks of all pairs of frequent words in each segment; places are int32, within the segment.

    `segments` and, in `frequent`, what is known of the words of each (no, id) meet by segment.
    """
    known = frequent.groupBy("seg").agg(F.collect_list(F.struct("no", "id")).alias("known"))
    both = segments.select("seg", "places").join(known, "seg").select("seg", "places", "known.no", "known.id")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                words = np.frombuffer(zlib.decompress(batch["places"][k].as_py()), np.int32)
                ids = np.full(max(int(words.max(initial=-1)), 0) + 2, -1, np.int64)  # the last slot is for -1
                ids[batch["no"][k].values.to_numpy()] = batch["id"][k].values.to_numpy()
                known = ids[words] >= 0
                at = np.flatnonzero(known[:-1] & known[1:])
                yield _blocks(batch["seg"][k].as_py(), buckets, ids, words, np.arange(len(words), dtype=np.int32), at)

    return both.mapInArrow(scan, _BLOCKS)


def _kept(blocks: DataFrame, width: int, rules: CollocationRules) -> DataFrame:
    """The blocks of the phrases that have `least` places or more together, and for each bucket a row without data that has these phrases.

    A phrase is named by its bucket and its number there; the row of a bucket has, by number, the two phrases a and b that overlap in each and its
    exact frequency f.
    """

    def added(table: pa.Table) -> pa.Table:
        bucket, sizes = table["bucket"][0].as_py(), table["n"].to_numpy()
        lists = [_unpacked(data, n, 2, width) for data, n in zip(table["data"].to_pylist(), sizes.tolist(), strict=True)]
        a, b, counts = (np.concatenate([x[k] for x in lists]) for k in range(3))
        order = np.lexsort((b, a))
        first = np.concatenate([[True], (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)])
        at = np.flatnonzero(first)
        f = np.add.reduceat(counts[order].astype(np.int64), at)
        kept = f >= rules.least
        number = np.empty(len(order), np.int64)
        number[order] = np.where(kept, np.cumsum(kept) - 1, -1)[np.cumsum(first) - 1]
        rows, low = [], 0
        for seg, (_, _, n, places) in zip(table["seg"].to_pylist(), lists, strict=True):
            own, low = number[low : low + len(n)], low + len(n)
            left = places[np.repeat(own >= 0, n)]
            if len(left):
                rows.append((bucket, seg, int((own >= 0).sum()), len(left), _packed([own[own >= 0]], n[own >= 0], left)))
        if not rows:
            return pa.table([pa.array([], k) for k in (*[pa.int64()] * 4, pa.binary(), *[pa.list_(pa.int64())] * 3)], names=names)
        own = order[at[kept]]
        phrases = [[None] * len(rows) + [x.tolist()] for x in (a[own], b[own], f[kept])]
        columns = _block_rows([*rows, (bucket, None, len(own), None, None)]).columns
        return pa.table([*columns, *(pa.array(x, pa.list_(pa.int64())) for x in phrases)], names=names)

    names = ["bucket", "seg", "n", "size", "data", "a", "b", "f"]
    return blocks.groupBy("bucket").applyInArrow(added, f"{_BLOCKS}, a array<bigint>, b array<bigint>, f array<bigint>")


def _extended(kept: DataFrame, group: Column, width: int, buckets: int) -> DataFrame:
    """The blocks of phrases one word longer, by a merge join within each group of segments; places are int64, within the group.

    A longer phrase is the one at a place (a) and the one that begins one word further (b). A place has one phrase of a length at most, so the
    phrase one word further is that of the next place or there is none.
    """

    def merge(table: pa.Table) -> pa.Table:
        segments = np.unique(table["seg"].to_numpy(), return_inverse=True)[1].tolist()
        names, places = [], []
        for bucket, seg, n, data in zip(table["bucket"].to_pylist(), segments, table["n"].to_pylist(), table["data"].to_pylist(), strict=True):
            number, counts, own = _unpacked(data, n, 1, width)
            names.append(np.repeat((bucket << _SHIFT) | number, counts))
            places.append((seg << _SHIFT) | own.astype(np.int64) if width == 4 else own)
        ids, which = np.unique(np.concatenate(names), return_inverse=True)
        places = np.concatenate(places)
        order = np.argsort(places, kind="stable")
        places, which = places[order], which.astype(np.int32)[order]
        at = np.flatnonzero(places[1:] == places[:-1] + 1)
        return pa.Table.from_batches([_blocks(table["grp"][0].as_py(), buckets, ids, which, places, at)])

    return kept.filter("seg is not null").select(group.alias("grp"), "bucket", "seg", "n", "data").groupBy("grp").applyInArrow(merge, _BLOCKS)


def frequent_phrases(docs: DataFrame, rules: CollocationRules = CollocationRules()) -> tuple[DataFrame, DataFrame]:
    """Two written tables: lang and n, the number of all word occurrences; and lang, size, phrase, f of all phrases of 1 to `most_words` words with f >= `least`."""
    segments = written(_segments(docs, rules), "segments")
    totals = written(segments.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("n")), "totals")
    dictionary = segments.select("seg", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("no", "x")).select("seg", "lang", "no", "x.words", "x.counts")
    dictionary = dictionary.select("seg", "lang", "no", F.col("words").alias("word"), "counts")
    named = _named(dictionary, ["lang", "word"]).withColumn("f", F.sum("counts").over(Window.partitionBy("lang", "word"))).filter(F.col("f") >= rules.least)
    named = written(named.select("seg", "no", "own", "id", "lang", "word", "f"), "words")
    names = named.filter("own = id").select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f")
    found = [names.select("lang", F.lit(1).alias("size"), "phrase", "f")]
    words = totals.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, min(rules.buckets, int(words) // _BUCKET_WORDS))
    lists = written(_kept(_pairs(segments, named.select("seg", "no", "id"), buckets), 4, rules), "lists")
    dropped(segments)
    # A group of segments has about as many places that are left as a segment may have.
    groups = -(-(lists.agg(F.sum("size")).first()[0] or 1) // rules.segment_words)
    group, width = F.pmod(F.xxhash64("seg"), F.lit(int(groups))), 4
    for size in range(2, rules.most_words + 1):
        second = names.select(F.col("id").alias("b"), F.col("last").alias("end"))
        phrases = lists.filter("seg is null").select("bucket", F.posexplode(F.arrays_zip("a", "b", "f")).alias("no", "x"))
        spelt = phrases.select(F.shiftleft("bucket", _SHIFT).bitwiseOR(F.col("no").cast("bigint")).alias("id"), "x.a", "x.b", "x.f").join(names.select(F.col("id").alias("a"), "lang", "phrase"), "a").join(second, "b")
        names = written(spelt.select("id", "lang", F.concat_ws(" ", "phrase", "end").alias("phrase"), F.col("end").alias("last"), "f"), "names")
        found.append(names.select("lang", F.lit(size).alias("size"), "phrase", "f"))
        if size < rules.most_words:
            longer = written(_kept(_extended(lists, group, width, buckets), 8, rules), "lists")
            dropped(lists)
            lists, group, width = longer, F.col("seg"), 8
    dropped(lists)
    every = found[0]
    for part in found[1:]:
        every = every.union(part)
    return totals, written(every, "phrases")


def _joined(ws: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(ws, start, size), " ")


def scored_phrases(totals: DataFrame, found: DataFrame, rules: CollocationRules = CollocationRules()) -> DataFrame:
    """lang, phrase, a, l, r, n, score of every phrase of two words or more that no longer one absorbs.

    The score is that of the cut that scores lowest, ties to the shortest first part: floor(1000 * a * n / (l * r)),
    in whole decimals of 38 digits.
    """
    long = found.filter("size >= 2").withColumn("ws", F.split("phrase", " "))
    parts = found.select("lang", "phrase", "f")
    size = F.col("size")
    cuts = long.select("lang", "phrase", "size", "ws", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _joined(F.col("ws"), F.lit(1), F.col("k")).alias("left"), _joined(F.col("ws"), F.col("k") + 1, size).alias("right"))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    whole = {c: F.col(c).cast("decimal(18,0)") for c in ("a", "l", "r", "n")}
    cuts = cuts.join(totals, "lang").withColumns({f"_{c}": v for c, v in whole.items()}).withColumn("score", F.expr("_a * 1000 * _n div (_l * _r)"))
    worst = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("x")).select("lang", "phrase", "x.*")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda s: _joined(F.col("ws"), s, m))))
    held = long.filter("size > 2").select("lang", "f", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    out = worst.join(held, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("longer") < rules.absorbed_percent * F.col("a"), F.lit(True)))
    return out.select("lang", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, top: int = 2000, rules: CollocationRules = CollocationRules()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first `top` phrases of each language, by score and frequency (highest first) and phrase.

    Null and empty texts have no words; a null lang is `und`. Repeated rows count each; a very long text is one
    segment; an empty table, or one without frequent phrases, gives no rows; further columns are ignored.
    """
    scored = scored_phrases(*frequent_phrases(docs, rules), rules)
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # The first of each of 64 shares, then the first of those: no task sorts all phrases of a language.
    shares = scored.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    shares = shares.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*best))).filter(F.col("rank") <= top)
    ranked = shares.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("bigint")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
