"""A positional inverted index of documents, and exact phrase and proximity matches from it, in DataFrame expressions only.

The index is two written tables: `rows` with the text of every document and `postings` with (term, row, pos) for every
word. A part of the postings holds the documents that one task read, sorted by the term's hash, so that each term's lists
stand together, a part is written without a shuffle, and a frequent term is spread over all parts.

A phrase is matched from its rarest terms: their postings less their places in the phrase are starts, and a start that the
lists of all of them share is a candidate; what is left of the phrase is then compared word by word. So neither
lists of frequent terms nor documents without a candidate move. The small side of every join (terms, anchors) is a written
table whose size Spark knows when it plans, so it is broadcast only if it is small.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.llm.shared import dropped, written

_APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Index:
    """`rows`: row, doc_id, text. `postings`: hash, term, row, pos."""

    rows: DataFrame
    postings: DataFrame

    def dropped(self) -> None:
        dropped(self.postings)
        dropped(self.rows)


def words(text: Column) -> Column:
    """Runs of digits, ASCII letters and characters outside ASCII; only A-Z are lowered. A null text has none."""
    known = F.coalesce(text, F.lit(""))
    lowered = F.when(F.octet_length(known) == F.length(known), F.lower(known)).otherwise(F.translate(known, _UPPER, _LOWER))
    return F.array_remove(F.split(lowered, _APART), "")


def built(docs: DataFrame, key: str = "doc_id") -> Index:
    """The index of all rows of `docs` (`key`, text); further columns are ignored.

    A row gets a number of its own, so rows may repeat their id and a null id stays null. A row of a null or empty
    text has no postings; an empty table gives an empty index.
    """
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("doc_id"), "text"), "rows")
    postings = rows.select("row", F.posexplode(words(F.col("text"))).alias("pos", "term")).select(F.xxhash64("term").alias("hash"), "term", "row", "pos")
    return Index(rows, written(postings.sortWithinPartitions("hash"), "postings"))


#: Numbers of rows are broadcast up to this many (8 MB), and joined by a shuffle beyond.
_BROADCAST_ROWS = 1_000_000


def _only(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Those of `rows` that stand in the written table `wanted` (row)."""
    few = wanted.limit(_BROADCAST_ROWS + 1).count() <= _BROADCAST_ROWS
    return rows.join(F.broadcast(wanted) if few else wanted, "row", "left_semi")


def term_counts(index: Index, terms: DataFrame) -> DataFrame:
    """term, n: how often each of the distinct `terms` (term) stands in the documents, as a written table; terms without postings are left out."""
    wanted = written(terms.select(F.xxhash64("term").alias("hash"), "term").distinct(), "terms")
    return written(index.postings.join(wanted, ["hash", "term"], "left_semi").groupBy("term").agg(F.count("*").alias("n")), "counts")


def _ranked_terms(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """phrase, off, term, n, rarity (from 1) for the words of `phrases` (phrase, gram) all of whose words have postings."""
    counted = phrases.select("phrase", F.posexplode("gram").alias("off", "term")).join(counts, "term", "left")
    per_phrase = Window.partitionBy("phrase")
    ranked = counted.withColumn("least", F.min(F.coalesce("n", F.lit(0))).over(per_phrase)).filter("least > 0")
    return ranked.select("phrase", "off", "term", "n", F.row_number().over(per_phrase.orderBy("n", "off")).alias("rarity"))


def phrase_matches(index: Index, phrases: DataFrame, counts: DataFrame | None = None, lists: int = 2) -> DataFrame:
    """row, phrase, start, past of every place where the words `gram` of a row of `phrases` (phrase, gram) stand in a document.

    `phrase` tells distinct grams apart; an empty gram matches nowhere. `counts` are the `term_counts` of their words, if known.
    `lists` lists are intersected before words are compared, which changes no result.
    """
    if counts is None:
        counts = term_counts(index, phrases.select(F.explode("gram").alias("term")))
    anchors = _ranked_terms(phrases, counts).filter(F.col("rarity") <= lists)
    anchors = written(anchors.select(F.xxhash64("term").alias("hash"), "term", "phrase", "off"), "anchors")
    lengths = phrases.select("phrase", "gram", F.least(F.size("gram"), F.lit(lists)).alias("needed"))
    starts = index.postings.join(anchors, ["hash", "term"]).select("row", "phrase", (F.col("pos") - F.col("off")).alias("start"))
    shared = starts.filter("start >= 0").groupBy("row", "phrase", "start").agg(F.count("*").alias("n"))
    found = shared.join(lengths, "phrase").filter("n = needed")
    per_row = written(found.groupBy("row").agg(F.collect_list(F.struct("phrase", "start", "gram")).alias("places")), "starts")
    # One copy of a document's words for all its candidates; a document has no more of them than places for phrases.
    same = F.filter("places", lambda p: F.slice(F.col("words"), p["start"] + 1, F.size(p["gram"])) == p["gram"])
    texts = _only(index.rows.select("row", "text"), per_row.select("row")).join(per_row, "row")
    held = texts.select("row", "places", words(F.col("text")).alias("words")).select("row", F.explode(same).alias("p"))
    return held.select("row", "p.phrase", "p.start", (F.col("p.start") + F.size("p.gram")).alias("past"))


def proximity_matches(index: Index, groups: DataFrame, span: int) -> DataFrame:
    """row, grp, start of every place from which `span` consecutive words of a document hold all terms of a group.

    `groups` has one row (grp, term) for each distinct term of a group; terms may stand in any order. `start` is the place of
    a term. A group with a term that no document has matches nowhere.
    """
    sized = groups.select("grp", "term").distinct().withColumn("needed", F.count("*").over(Window.partitionBy("grp")))
    wanted = written(sized.select(F.xxhash64("term").alias("hash"), "term", "grp", "needed"), "groups")
    held = index.postings.join(wanted, ["hash", "term"]).select("row", "grp", "needed", "term", "pos")
    together = F.size(F.collect_set("term").over(Window.partitionBy("row", "grp").orderBy("pos").rangeBetween(0, span - 1)))
    return held.withColumn("together", together).filter("together = needed").select("row", "grp", F.col("pos").alias("start"))


@dataclass(frozen=True)
class ContaminationRules:
    """Words of a window; and of the proximity matches, how many of an item's rarest terms must stand in how many words."""

    window: int = 10
    near_terms: int = 5
    near_span: int = 20


def _distinct_texts(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item_id, own) of the items and (own, words) of their distinct word lists that aren't empty."""
    read = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("words"))
    texts = read.filter(F.size("words") > 0).select("words").distinct().withColumn("own", F.monotonically_increasing_id())
    texts = written(texts, "texts")
    return read.join(texts, "words").select("item_id", "own").distinct(), texts


def contamination(docs: DataFrame, items: DataFrame, rules: ContaminationRules = ContaminationRules()) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, item_ids, n_near of every row of `docs`.

    n_hit counts the words inside any occurrence of a window of an item: `window` consecutive words, or all of a shorter
    item. `item_ids` are the distinct ids, as sorted strings, of items with such windows. n_near counts distinct item
    texts of which the `near_terms` rarest distinct terms (all of fewer) stand within `near_span` words in any order.

    Null and empty texts of documents have no words and hits; such items have no windows. A null item_id marks words as
    hit but is not listed. Rows that repeat an id are judged each by its own text; empty tables give no rows or no
    hits; further columns are ignored, whatever their names.
    """
    ids, texts = _distinct_texts(items)
    index = built(docs)
    last = F.greatest(F.size("words") - rules.window, F.lit(0))
    grams = texts.select("own", F.explode(F.transform(F.sequence(F.lit(0), last), lambda k: F.slice("words", k + 1, rules.window))).alias("gram"))
    phrases = written(grams.select("gram").distinct().withColumn("phrase", F.monotonically_increasing_id()), "phrases")
    owners = grams.join(phrases, "gram").select("phrase", "own").distinct()
    terms = texts.select("own", F.explode(F.array_distinct("words")).alias("term"))
    counts = term_counts(index, terms)
    places = written(phrase_matches(index, phrases, counts), "places")

    # Sorted intervals: each adds what it has past the furthest end before it.
    before = Window.partitionBy("row").orderBy("start", "past").rowsBetween(Window.unboundedPreceding, -1)
    spans = places.select("row", "start", "past").distinct().withColumn("reached", F.coalesce(F.max("past").over(before), F.lit(0)))
    hits = spans.groupBy("row").agg(F.sum(F.greatest(F.col("past") - F.greatest("start", "reached"), F.lit(0))).alias("n_hit"))
    named = places.select("row", "phrase").distinct().join(owners, "phrase").select("row", "own").distinct().join(ids, "own")
    named = named.groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))

    by_rarity = Window.partitionBy("own").orderBy("n", "term")
    counted = terms.join(counts, "term", "left").fillna({"n": 0})
    groups = counted.withColumn("rarity", F.row_number().over(by_rarity)).filter(F.col("rarity") <= rules.near_terms)
    near = proximity_matches(index, groups.select(F.col("own").alias("grp"), "term"), rules.near_span)
    near = near.groupBy("row").agg(F.count_distinct("grp").alias("n_near"))

    lengths = index.postings.groupBy("row").agg(F.count("*").alias("n_words"))
    out = index.rows.select("row", "doc_id").join(lengths, "row", "left").join(hits, "row", "left").join(named, "row", "left").join(near, "row", "left")
    none = F.array().cast("array<string>")
    return out.select(
        "doc_id", F.coalesce("n_words", F.lit(0)).alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.size(F.coalesce("item_ids", none)).cast("bigint").alias("n_items"),
        F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("n_near", F.lit(0)).alias("n_near"),
    )
