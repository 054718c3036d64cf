"""Best-fit packing of tokenized documents into sequences under several capacities.

A piece takes tokens, one place in the document count, and attention cost (its length squared). All three follow
from its length, so the table of lengths and their counts, at most `max_tokens` rows, says all that packing
needs. The driver packs that table: bins with equal contents are kept as one row with a multiplicity, lengths go
from long to short, and each goes to the bins in which it fits best. Pieces then find their sequence by
their rank among the pieces of their length, which Spark counts in salted buckets, so that a length that a
third of all pieces share is not ranked in one task.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintlake.llm.shared import written

_SLICE_BYTES = 4_000_000
_JOINED = 2000
_RECENT = 150_000
_MARKS = "".join(chr(b) for b in range(33, 127) if not chr(b).isalnum())
_LETTERS = "^[a-zÀ-ÖØ-öø-ÿ]+$"


@dataclass(frozen=True)
class Capacity:
    """Capacities of a sequence, and how bins are chosen.

    `select` is "residual" (least weighted norm of what stays free) or "dot" (largest weighted dot product of the
    piece and what is free, both as shares of the capacities). The defaults for documents and attention
    cannot bind before the tokens do.
    """

    max_tokens: int = 2048
    max_documents: int = 2048
    max_attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    select: str = "residual"


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _mark(path: str) -> tuple[int, str] | None:
    added = _tokenizer(path).get_added_tokens_decoder().items()
    return next(((i, t.content) for i, t in added if t.special), None)


@cache
def _ends_word(path: str) -> np.ndarray:
    """Whether each id ends a word, if the vocabulary marks that; else an empty array."""
    tokenizer = _tokenizer(path)
    suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
    vocab = tokenizer.get_vocab()
    ends = np.zeros(max(vocab.values()) + 1, bool)
    for token, i in vocab.items():
        ends[i] = bool(suffix) and token.endswith(suffix)
    return ends if suffix else ends[:0]


@cache
def _recent(path: str) -> list[dict[str, bytes]]:
    """Ids of the words of letters that this worker met last: the newer and the older half of what is kept."""
    return [{}, {}]


def _plain_ids(words: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, their number in each word) of words of letters alone, which end where an id ends a word."""
    newer, older = _recent(path)
    found = [newer.get(w) or older.get(w) for w in words]
    missing = [w for w, ids in zip(words, found, strict=True) if ids is None]
    if missing:
        joined = [" ".join(missing[k : k + _JOINED]) for k in range(0, len(missing), _JOINED)]
        ids = np.concatenate([np.array(e.ids, "<u4") for e in _tokenizer(path).encode_batch_fast(joined, add_special_tokens=False)])
        ends = np.flatnonzero(_ends_word(path)[ids]) + 1
        if len(ends) != len(missing) or ends[-1] != len(ids):
            ids, sizes = _any_ids(missing, path)
            ends = np.cumsum(sizes)
        raw, cuts = ids.tobytes(), (4 * ends).tolist()
        own = iter([raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False)])
        found = [next(own) if ids is None else ids for ids in found]
    newer.update(zip(words, found, strict=True))
    if len(newer) > _RECENT:
        _recent(path)[:] = {}, newer
    return np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4


def _any_ids(words: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, their number in each word) of any words; a special token between two keeps them apart."""
    tokenizer, mark = _tokenizer(path), _mark(path)
    if mark:
        ids = np.array(tokenizer.encode(mark[1].join(words), add_special_tokens=False).ids, "<u4")
        own = ids != mark[0]
        ends = np.append(np.flatnonzero(~own), len(ids))
        if len(ends) == len(words):
            return ids[own], np.diff(ends, prepend=-1) - 1
    found = [e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
    return np.array([i for own in found for i in own], "<u4"), np.array([len(own) for own in found], np.int64)


def _gathered(values: np.ndarray, sizes: np.ndarray, take: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, sizes) of the rows `take` of a ragged array."""
    starts, own = np.cumsum(sizes) - sizes, sizes[take]
    at = np.repeat(starts[take] - (np.cumsum(own) - own), own)
    return values[at + np.arange(len(at))], own


def _word_ids(words: pa.StringArray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, their number in each word) of distinct words in lower case.

    A letter and an ASCII mark after it are always apart, so that a word of ASCII or Latin-1 letters shares its ids with
    its forms before marks: the letters and the marks are encoded once each.
    """
    stems = pc.ascii_rtrim(words, characters=_MARKS)
    plain = pc.match_substring_regex(stems, _LETTERS).to_numpy(zero_copy_only=False) & bool(len(_ends_word(path)))
    letters = stems.filter(pa.array(plain)).dictionary_encode()
    marked = np.flatnonzero(plain & (pc.binary_length(words).to_numpy() > pc.binary_length(stems).to_numpy()))
    tails = [w[len(s) :] for w, s in zip(words.take(pa.array(marked)).to_pylist(), stems.take(pa.array(marked)).to_pylist(), strict=True)]
    rest = pa.array(tails + words.filter(pa.array(~plain)).to_pylist(), pa.string()).dictionary_encode()
    ids, sizes = _plain_ids(letters.dictionary.to_pylist(), path)
    more, more_sizes = _any_ids(rest.dictionary.to_pylist(), path) if len(rest) else (ids[:0], sizes[:0])
    none = len(sizes) + len(more_sizes)  # the part that has no ids
    parts = np.full((len(words), 2), none, np.int64)
    parts[plain, 0] = letters.indices.to_numpy()
    others = rest.indices.to_numpy() + len(sizes)
    parts[marked, 1], parts[~plain, 0] = others[: len(tails)], others[len(tails) :]
    flat, own = _gathered(np.concatenate([ids, more]), np.concatenate([sizes, more_sizes, [0]]), parts.ravel())
    return flat, own.reshape(-1, 2).sum(1)


def token_ids(texts: pa.StringArray, path: str, separator: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, their number in each text) of texts, each with the separator at its end, under a tokenizer that
    lower-cases and never joins across a blank.

    Each distinct blank-separated word is encoded once. A text that could hold a special token is encoded as it is.
    """
    special = np.flatnonzero(pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False))
    whole = [np.array(_tokenizer(path).encode(texts[int(k)].as_py(), add_special_tokens=False).ids, "<u4") for k in special]
    if len(special):
        kept = np.ones(len(texts), bool)
        kept[special] = False
        texts = pc.if_else(pa.array(kept), texts, "")
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = split.flatten().dictionary_encode()
    ids, sizes = _word_ids(words.dictionary, path)
    ids = np.concatenate([ids, *whole, np.array([separator], "<u4")])
    sizes = np.concatenate([sizes, np.array([len(x) for x in whole], np.int64), [1]])
    first = split.offsets.to_numpy().astype(np.int64)
    first = first - first[0]
    codes = words.indices.to_numpy().astype(np.int64)
    codes[first[special]] = len(words.dictionary) + np.arange(len(special))
    flat, own = _gathered(ids, sizes, np.insert(codes, first[1:], len(sizes) - 1))
    ends = np.concatenate([[0], np.cumsum(own)])[first + np.arange(len(first))]
    return flat, np.diff(ends)


def _slices(texts: pa.StringArray) -> Iterator[slice]:
    """Runs of texts of about `_SLICE_BYTES` in all; a longer text is one by itself."""
    seen = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
    first = 0
    while first < len(texts):
        before = seen[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(seen, before + _SLICE_BYTES, "right")))
        yield slice(first, last)
        first = last


def _strings(raw: pa.BinaryArray) -> pa.StringArray:
    try:
        return raw.cast(pa.string())
    except pa.ArrowInvalid:  # not UTF-8
        return pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())


def pieces(docs: DataFrame, tokenizer: str, max_tokens: int, separator: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each text's ids and the separator, cut only where over `max_tokens`."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _strings(batch["_raw"])
            for part in _slices(texts):
                ids, sizes = token_ids(texts[part], tokenizer, separator)
                many = -(-sizes // max_tokens)
                row = np.repeat(np.arange(len(sizes)), many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * max_tokens
                length = np.minimum(sizes[row] - start, max_tokens)
                whole, at = memoryview(ids.tobytes()), 4 * (np.repeat(np.cumsum(sizes) - sizes, many) + start)
                crc = [zlib.crc32(whole[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
                columns = [batch["doc_id"][part].take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    texts = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).cast("binary").alias("_raw"))
    return texts.mapInArrow(cut, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack_lengths(counts: dict[int, int], capacity: Capacity) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, how many such sequences) that hold `counts[length]` pieces of every length.

    Best-fit decreasing: a length goes to the open bins that hold it under every capacity, best first.
    """
    full = np.array([capacity.max_tokens, capacity.max_documents, capacity.max_attention], float)
    weights = np.array(capacity.weights)
    contents: list[tuple[int, ...]] = []
    free = np.zeros((0, 3))
    many = np.zeros(0, np.int64)
    for length in sorted(counts, reverse=True):
        left, need = counts[length], np.array([length, 1, length * length], float)
        if (need > full).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacity of a sequence")
        while left:
            fits = np.flatnonzero((many > 0) & (free >= need).all(axis=1)) if len(many) else np.zeros(0, np.int64)
            if len(fits):
                rest = (free[fits] - need) / full
                score = (rest**2 @ weights) if capacity.select == "residual" else -((free[fits] / full) * (need / full)) @ weights
                best = int(fits[np.argmin(score)])
                used = min(left, int(many[best]))
                many[best] -= used
                bin_, room = (*contents[best], length), free[best] - need
                left -= used
            else:  # new bins take as many of this length as they hold, and one bin the rest
                per = int(min(full[0] // length, full[1], full[2] // (length * length)))
                used, per = (left // per, per) if left >= per else (1, left)
                bin_, room = (length,) * per, full - need * per
                left -= used * per
            contents.append(bin_)
            free, many = np.vstack([free, room]), np.append(many, used)
    return [(c, int(m)) for c, m in zip(contents, many, strict=True) if m]


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, past rank, first sequence, offset): pieces of a length by rank, to places in sequences."""
    taken: dict[int, int] = {}
    first, rows = 0, []
    for lengths, many in patterns:
        offset = 0
        for length in lengths:
            rank = taken.get(length, 0)
            rows.append((length, rank, rank + many, first, offset))
            taken[length] = rank + many
            offset += length
        first += many
    return rows


def packed(docs: DataFrame, tokenizer: str, capacity: Capacity = Capacity(), bucket_rows: int = 250) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row of `docs`.

    A null or empty text is one piece with the separator alone; repeated rows each get their pieces; rows with a
    null doc_id are packed too; an empty table gives an empty one; further columns are ignored. Pieces that tie
    in length are interchangeable, so which of them goes where follows from hashes of their ids. The pieces of a
    length are ranked in buckets of about `bucket_rows`, or of the root of their number where that is more.
    """
    spark = docs.sparkSession
    found = written(pieces(docs, tokenizer, capacity.max_tokens), "pieces")
    salt = F.xxhash64("doc_id", "piece", "ids_crc32")
    counts = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}  # at most max_tokens rows
    dealt = [(n, max(1, round(c / max(bucket_rows, c**0.5)))) for n, c in counts.items()]
    buckets = F.broadcast(spark.createDataFrame(dealt, "length bigint, buckets bigint"))
    found = found.join(buckets, "length").withColumn("bucket", F.pmod(salt, "buckets")).drop("buckets")
    groups = found.groupBy("length", "bucket").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    groups = groups.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    slots = spark.createDataFrame(_slots(pack_lengths(counts, capacity)), "length bigint, low bigint, high bigint, first bigint, offset bigint")
    order = Window.partitionBy("length", "bucket").orderBy(salt, "doc_id", "piece", "ids_crc32")
    ranked = found.withColumn("own", F.row_number().over(order) - 1).join(groups, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("own"))
    place = slots.withColumnRenamed("length", "slot_length")
    on = (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    out = ranked.join(F.broadcast(place), on)
    sequence = F.col("first") + F.col("rank") - F.col("low")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), "offset")
