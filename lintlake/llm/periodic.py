"""Maximal runs of periodic words, and texts with every run cut down to its first period.

A run has a root, and some rotation of the root is the longest Lyndon word at its place under one of the two orders of
the words. A stack of Lyndon words, built from right to left, has the longest such word at every place; comparing the
suffixes on it gives how far two places agree, so that a candidate is extended to both ends by longest common
extensions. These are found by binary search over rolling hashes. Every run is then verified word by word.

Only stretches of words that lie in a repeated `_GRAM` can hold a run of `least` words or more, as such a run repeats each
of its grams one period further. They are found by sorting the grams' hashes (equal hashes of different grams only
make a stretch longer) and scanned one by one. A text is one row of one task; nothing moves between tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.shared import in_small_batches

_PRIME = (1 << 61) - 1
_BASE = 0x1B3E_9F5C_7A21_46D3 % _PRIME
_DIRECT = 8


@dataclass(frozen=True)
class RunRules:
    """The fewest words of a run; a run also has two periods at least."""

    least: int = 12


class _Extensions:
    """How far two places of `ids` agree, to the right and to the left."""

    def __init__(self, ids: list[int]):
        self.ids, self.n = ids, len(ids)
        self.sums = list(accumulate(ids, lambda h, x: (h * _BASE + x + 1) % _PRIME, initial=0))
        self.powers = list(accumulate(range(self.n), lambda p, _: p * _BASE % _PRIME, initial=1))

    def _agree(self, i: int, j: int, length: int) -> bool:
        s, p = self.sums, self.powers[length]
        return (s[i + length] - s[i] * p - s[j + length] + s[j] * p) % _PRIME == 0

    def _searched(self, most: int, agree: Callable[[int], bool]) -> int:
        """The largest length up to `most` for which `agree` holds; it holds for `_DIRECT` and for no length past a failing one."""
        if agree(most):  # as is common inside a run that ends its stretch
            return most
        low, step = _DIRECT, _DIRECT
        while low < most and agree(min(low + step, most)):
            low = min(low + step, most)
            step *= 2
        high = min(low + step, most + 1)  # fails, or is past the end
        while high - low > 1:
            middle = (low + high) // 2
            if agree(middle):
                low = middle
            else:
                high = middle
        return low

    def right(self, i: int, j: int) -> int:
        """Of the words from i and from j > i."""
        ids, most = self.ids, self.n - j
        for k in range(min(_DIRECT, most)):
            if ids[i + k] != ids[j + k]:
                return k
        return most if most <= _DIRECT else self._searched(most, lambda k: self._agree(i, j, k))

    def left(self, i: int, j: int) -> int:
        """Of the words up to i and up to j > i, these included; i may be -1."""
        ids, most = self.ids, i + 1
        for k in range(min(_DIRECT, most)):
            if ids[i - k] != ids[j - k]:
                return k
        return most if most <= _DIRECT else self._searched(most, lambda k: self._agree(i + 1 - k, j + 1 - k, k))


class _DirectExtensions(_Extensions):
    """The same without hashes, for a stretch in which two of them were found to clash."""

    def __init__(self, ids: list[int]):
        self.ids, self.n = ids, len(ids)

    def _agree(self, i: int, j: int, length: int) -> bool:
        return self.ids[i : i + length] == self.ids[j : j + length]


def _lyndon_runs(ids: list[int], least: int, extend: _Extensions) -> set[tuple[int, int, int]]:
    """(start, length, period) of all runs, by one scan from right to left under each order."""
    n, found = len(ids), set()
    for ascending in (True, False):
        past = [n] * (n + 1)  # where the longest Lyndon word at a place ends, which is where the next one of the stack begins
        for i in range(n - 1, -1, -1):
            j, agreed, first = i + 1, 0, ids[i]
            while j < n:
                if ids[j] != first:
                    agreed = 0
                    if (first < ids[j]) != ascending:
                        break
                else:
                    agreed = extend.right(i, j)
                    # A suffix that is a prefix of another one comes before it under both orders.
                    if j + agreed == n or (ids[i + agreed] < ids[j + agreed]) != ascending:
                        break
                j = past[j]
            past[i] = j
            period = j - i
            if j < n and agreed + 2 * period > max(least, 2 * period):
                start = i - extend.left(i - 1, j - 1)
                if j + agreed - start >= max(least, 2 * period):
                    found.add((start, j + agreed - start, period))
    return found


def _verified(ids: list[int], runs: set[tuple[int, int, int]]) -> bool:
    """Whether the words of every run repeat and its neighbours don't."""
    return all(
        ids[s : s + m - p] == ids[s + p : s + m] and (s == 0 or ids[s - 1] != ids[s - 1 + p]) and (s + m == len(ids) or ids[s + m] != ids[s + m - p])
        for s, m, p in runs
    )


def _stretches(ids: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """Maximal stretches of `least` words or more of which every word lies in a gram that occurs twice.

    In a run of m words and period q, the first m - q >= m / 2 words equal those q further; so grams of half of `least`
    words repeat all over it.
    """
    size = (least + 1) // 2
    if len(ids) < least:
        return
    key, odd = np.zeros(len(ids) - size + 1, np.uint64), np.uint64(0x9E37_79B9_7F4A_7C15)
    for k in range(size):
        key = (key + ids[k : k + len(key)].astype(np.uint64) + np.uint64(1)) * odd
        key ^= key >> np.uint64(29)
    ranked = np.sort(key)
    again = ranked[1:][ranked[1:] == ranked[:-1]]
    if not len(again):
        return
    twice = again[np.minimum(np.searchsorted(again, key), len(again) - 1)] == key
    steps = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + size, -1)
    inside = np.concatenate([[0], (np.cumsum(steps) > 0).astype(np.int8)])
    edges = np.flatnonzero(np.diff(inside))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if b - a >= least:
            yield a, b


def word_runs(words: list, rules: RunRules = RunRules()) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run of `words`, by start and then period."""
    first: dict = {}
    ids = list(map(first.setdefault, words, range(len(words))))
    found = []
    for a, b in _stretches(np.array(ids, np.int64), rules.least):
        own = ids[a:b]
        runs = _lyndon_runs(own, rules.least, _Extensions(own))
        if not _verified(own, runs):
            runs = _lyndon_runs(own, rules.least, _DirectExtensions(own))
        found += [(a + s, m, p) for s, m, p in runs]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    steps = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()]


RUN_COLUMNS = {"n_words": "bigint", "runs": "array<struct<start:bigint,length:bigint,period:bigint>>", "collapsed": "string"}


def periodic_runs(docs: DataFrame, carried: list[str], rules: RunRules = RunRules()) -> DataFrame:
    """The columns `carried` of every row of `docs` and `RUN_COLUMNS`: all runs by start and period, and the kept words.

    Words are what stands between blanks. A null or empty text has no words, no runs and an empty collapsed text; a very
    long one is scanned whole within its row, in memory that grows with its words. Repeated rows each get a row; an
    empty table gives an empty one; columns of `docs` may have any name, `runs` and `collapsed` included.
    """
    names = [f"_c{k}" for k in range(len(carried))]
    plain = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(carried, names, strict=True)), F.coalesce("text", F.lit("")).cast("binary").alias("_raw"))
    schema = ", ".join([*(f"{n} {plain.schema[n].dataType.simpleString()}" for n in names), *(f"{k} {v}" for k, v in RUN_COLUMNS.items())])
    run = pa.struct([(k, pa.int64()) for k in ("start", "length", "period")])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_small_batches(batches):
            counts, runs, kept = [], [], []
            for raw in batch["_raw"]:
                words = raw.as_py().split()
                own = word_runs(words, rules)
                counts.append(len(words))
                runs.append([{"start": s, "length": m, "period": p} for s, m, p in own])
                kept.append(b" ".join(collapsed(words, own)).decode())
            arrays = [pa.array(counts, pa.int64()), pa.array(runs, pa.list_(run)), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), *arrays], [*names, *RUN_COLUMNS])

    found = plain.mapInArrow(scan, schema)
    return found.select(*(F.col(n).alias(c) for n, c in zip(names, carried, strict=True)), *RUN_COLUMNS)
