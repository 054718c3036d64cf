"""Quality rules: base counts, and divergence of a document's histograms from its language's reference.

Two passes over the texts, neither of which moves a text: the first adds up, for each language with a word list and
for all documents together, the mean character-class and common-word histograms of all documents that are long enough;
the second compares each document with the reference of its language by Jensen-Shannon distance, or its character
classes alone, letters of all scripts as one, with that of all documents where its language is null, has no word list
or has too few documents. Between them only one row for a language and a task is shuffled, and one row for a language reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequent function words of each language.
COMMON_WORDS = {
    "en": "the of and to in a is that it for was on as with be by this are or from at an not have which but had they you were".split(),
    "fr": "de la le et les des en un une du que est pour qui dans par sur plus ne pas au ce il se sont avec ou son elle aux".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er hat aus bei war sie wird".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más o pero sus le ha me si sin".split(),
}

_CLASSES = 8
_WORD_SLOTS = max(map(len, COMMON_WORDS.values())) + 1


def _class_sums() -> np.ndarray:
    """256 x 8: byte to lower, upper, digit, blank, sentence mark, other mark, non-ASCII letter, control."""
    of = np.full(256, 7)
    of[ord("a") : ord("z") + 1] = 0
    of[ord("A") : ord("Z") + 1] = 1
    of[ord("0") : ord("9") + 1] = 2
    of[[9, 10, 11, 12, 13, 32]] = 3
    of[33:48], of[58:65], of[91:97], of[123:127] = 5, 5, 5, 5
    of[[ord(c) for c in ".,;:'\"!?-()"]] = 4
    of[0xC0:] = 6
    table = np.zeros((256, _CLASSES))
    table[np.arange(256), of] = 1
    table[0x80:0xC0] = 0  # further bytes of a character
    return table


_CLASS_SUMS = _class_sums()
_SYMBOLS = b"#*$%&|<>"
_PLAIN = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\"'()[]", bytes(range(97, 123)) + b" " * 12)


@dataclass(frozen=True)
class QualityRules:
    """Thresholds of the base rules and of the divergence rules.

    Distances are roots of the Jensen-Shannon divergence in bits (0 to 1). A short text's histogram strays from
    its language by chance alone, in proportion to 1 / sqrt(words), so each limit is `limit + slack / sqrt(words)`.
    Texts under `min_words` are never judged by distance, and a reference needs `min_reference` documents of at
    least `min_reference_bytes`.
    """

    min_words: int = 50
    max_repeat_percent: int = 50
    char_limit: float = 0.20
    char_slack: float = 0.9
    word_limit: float = 0.20
    word_slack: float = 1.1
    min_reference: int = 20
    min_reference_bytes: int = 1000


def _repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur at least twice, first occurrence included."""
    n = len(words)
    if n < 4:
        return 0
    first: dict[bytes, int] = {}
    ids = np.fromiter(map(first.setdefault, words, range(n)), np.int64, n)  # a word's first place
    if n < 2_000_000:
        key = (ids[:-2] * n + ids[1:-1]) * n + ids[2:]
    else:
        _, pairs = np.unique(ids[:-2] * n + ids[1:-1], return_inverse=True)
        key = pairs * n + ids[2:]
    ranked = np.sort(key)
    again = ranked[1:][ranked[1:] == ranked[:-1]]
    if not len(again):
        return 0
    twice = again[np.minimum(np.searchsorted(again, key), len(again) - 1)] == key
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : k + len(twice)] |= twice
    return int(covered.sum())


def _char_counts(raw: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASS_SUMS


def _any_script(shares: np.ndarray) -> np.ndarray:
    """Shares of classes with all letters as one, so that a script that is rare among all documents is no divergence."""
    return np.concatenate([[shares[0] + shares[1] + shares[6]], shares[2:6], shares[7:]])


def _word_shares(raw: bytes, common: dict[bytes, int]) -> np.ndarray:
    """Shares of the language's common words; the last slot has all other words."""
    plain = raw.translate(_PLAIN).split()
    slots = np.fromiter(map(common.get, plain, repeat(_WORD_SLOTS - 1)), np.int64, len(plain))
    return np.bincount(slots, minlength=_WORD_SLOTS) / max(len(plain), 1)


def _js_distance(p: np.ndarray, q: np.ndarray) -> float:
    m = (p + q) / 2

    def divergence(x: np.ndarray) -> float:
        on = x > 0
        return float((x[on] * np.log2(x[on] / m[on])).sum())

    return float(np.sqrt(max(0.0, (divergence(p) + divergence(q)) / 2)))


_ANY = ""  # stands for all documents among the references
_COMMON_SLOT = {lang: {w.encode(): i for i, w in enumerate(words)} for lang, words in COMMON_WORDS.items()}


def _input(docs: DataFrame, carried: list) -> DataFrame:
    return docs.select(*carried, F.coalesce("text", F.lit("")).cast("binary").alias("_raw"), F.col("lang").alias("_lang"))


def language_references(docs: DataFrame, rules: QualityRules = QualityRules()) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Mean histograms of each language that has common words listed, over all its documents long enough, and under
    `_ANY` the mean character classes of all documents long enough."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for raw, lang in zip(batch["_raw"].to_pylist(), batch["_lang"].to_pylist(), strict=True):
                if len(raw) >= rules.min_reference_bytes:
                    chars = _char_counts(raw)
                    shares = _word_shares(raw, _COMMON_SLOT[lang]) if lang in _COMMON_SLOT else np.zeros(_WORD_SLOTS)
                    both = np.concatenate([[1.0], chars / max(chars.sum(), 1), shares])
                    for name in {lang, _ANY} & {_ANY, *_COMMON_SLOT}:
                        total[name] = total.get(name, 0) + both
        names = sorted(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([total[n].tolist() for n in names], pa.list_(pa.float64()))], ["lang", "part"]
        )

    parts = _input(docs, []).mapInArrow(partial, "lang string, part array<double>")
    summed = parts.select("lang", F.posexplode("part")).groupBy("lang", "pos").agg(F.sum("col").alias("v"))
    rows = summed.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("vs")).collect()
    found = {}
    for row in rows:
        v = np.array([x["v"] for x in row["vs"]])
        if v[0] >= rules.min_reference:
            found[row["lang"]] = (v[1 : 1 + _CLASSES] / v[0], v[1 + _CLASSES :] / v[0])
    return found


VERDICT_COLUMNS = {
    "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint",
    "base_failed": "boolean", "char_distance": "double", "word_distance": "double", "kept": "boolean",
}


def _verdict(raw: bytes, lang: str | None, refs: dict, rules: QualityRules) -> tuple:
    words = raw.split()
    n, repeats = len(words), _repeat_words(words)
    dups = 0
    if b"\n" in raw:
        lines = [x for x in raw.split(b"\n") if x.strip()]
        dups = len(lines) - len(set(lines))
    blanks = len(raw) - len(raw.translate(None, b" \t\n\r\x0b\x0c"))
    counts = _char_counts(raw)
    points = int(counts.sum())
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    failed = n < rules.min_words or 100 * repeats > rules.max_repeat_percent * n
    chars = common = None
    kept = not failed
    if kept and (lang not in _COMMON_SLOT or lang not in refs) and _ANY in refs:
        chars = _js_distance(_any_script(counts / counts.sum()), _any_script(refs[_ANY][0]))
        kept = chars <= rules.char_limit + rules.char_slack / n**0.5
    elif kept and lang in refs:
        chars = _js_distance(counts / counts.sum(), refs[lang][0])
        common = _js_distance(_word_shares(raw, _COMMON_SLOT[lang]), refs[lang][1])
        kept = chars <= rules.char_limit + rules.char_slack / n**0.5 and common <= rules.word_limit + rules.word_slack / n**0.5
    return n, points - blanks, symbols, dups, repeats, failed, chars, common, kept


def _judged(docs: DataFrame, carried: list[str], refs: dict, rules: QualityRules) -> DataFrame:
    """The columns `carried` as _c0, _c1... (no name of theirs can clash) and `VERDICT_COLUMNS`."""
    plain = _input(docs, [F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(carried)])
    names = [f"_c{k}" for k in range(len(carried))]
    schema = plain.select(*names).schema.simpleString()[7:-1]
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_verdict(raw, lang, refs, rules) for raw, lang in zip(batch["_raw"].to_pylist(), batch["_lang"].to_pylist(), strict=True)]
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            arrays = [pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in range(len(carried))), *arrays], [*names, *VERDICT_COLUMNS])

    return plain.mapInArrow(judge, ", ".join([*([schema] if schema else []), *(f"{k} {v}" for k, v in VERDICT_COLUMNS.items())]))


def _named_back(judged: DataFrame, carried: list[str], *others: str) -> DataFrame:
    return judged.select(*(F.col(f"_c{k}").alias(c) for k, c in enumerate(carried)), *others)


def quality_verdicts(docs: DataFrame, carried: list[str], refs: dict, rules: QualityRules = QualityRules()) -> DataFrame:
    """The columns `carried` of every row of `docs` and `VERDICT_COLUMNS`.

    A null text counts as empty; an empty or short text fails the base rules and has null distances. Where the
    language is null, not listed or without a reference, the character classes alone are compared, with those of all documents,
    and word_distance is null; where too few documents are long enough for that either, both distances are null and
    reject nothing. Repeated rows each get a row; an empty table gives an empty one; further columns of `docs` are ignored.
    """
    return _named_back(_judged(docs, carried, refs, rules), carried, *VERDICT_COLUMNS)


def kept_documents(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows of `docs` that no rule rejects, with their columns as they were, whatever their names."""
    return _named_back(_judged(docs, docs.columns, language_references(docs, rules), rules).filter("kept"), docs.columns)
