"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm import bilinear, collocations, html_text, lattice_sampling, licenses, multi_index, packing, periodic, positional_index, quality, secret_spans, sharding, simhash


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lattice_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two distinct segmentations of every document."""
    return lattice_sampling.sampled_texts(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), 2)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.page_texts(_table(spark, sf_dir, "pages"), ["page_id", "url"])


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and texts of every document."""
    return licenses.license_labels(_table(spark, sf_dir, "documents"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at cosine 0.93 within a label."""
    return multi_index.near_vectors(_table(spark, sf_dir, "embeddings"))


def op5_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of equal row counts."""
    return sharding.sharded(_table(spark, sf_dir, "documents"))


def op6_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model score of every document."""
    return bilinear.scored(_table(spark, sf_dir, "documents"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4-word shingles, links at 4 bits or fewer."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=4, max_bits=4)


def op8_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens."""
    return packing.packed(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of base rules and divergence rules."""
    docs = _table(spark, sf_dir, "documents")
    return quality.quality_verdicts(docs, ["doc_id"], quality.language_references(docs))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans, and all spans."""
    spans = F.col("spans")
    found = secret_spans.secret_spans(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    counts = [secret_spans.n_spans(spans, k).alias(f"n_{k}") for k in secret_spans.KINDS]
    base = F.sha2(secret_spans.span_text(F.filter(spans, lambda s: s.kind_order < 3)), 256)
    return found.select("doc_id", *counts, base.alias("base_sha256"), secret_spans.span_text(spans).alias("spans"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of two to five words of every language."""
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside occurrences of 10-word windows of benchmark items."""
    found = positional_index.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, (F.col("n_hit") > 0).alias("contaminated"), "n_near")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, where the words of every document whose crc32(doc_id) ends in 0 repeat from a place on.

    Of n words, word i >= a becomes word a + (i - a) % p; a = g % n, p = 1 + floor((n - a) / (3 + g % 8)) and g = floor(crc32 / 10).
    A null id has no checksum and leaves its text as it is.
    """
    listed = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")
    listed = listed.withColumn("words", F.when(F.col("h") % 10 == 0, words))
    n, g = F.size("words"), F.floor(F.col("h") / 10)
    a = (g % n).cast("int")
    p = F.floor((n - a) / (3 + g % 8)).cast("int") + 1
    tail = F.flatten(F.array_repeat(F.slice("words", a + 1, p), F.ceil((n - a) / p).cast("int")))
    planted = F.array_join(F.concat(F.slice("words", 1, a), F.slice(tail, 1, n - a)), " ")
    return listed.select("doc_id", F.when(n > 0, planted).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, planted ones included: the longest one and digests of all and of the kept words."""
    found = periodic.periodic_runs(with_planted_runs(_table(spark, sf_dir, "documents")), ["doc_id"])
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("back"), (-r.period).alias("less"))))
    found = found.withColumn("best", best).withColumn("lines", F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""))
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("best.back")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.less")).alias("period"), F.expr("1000 * best.length div -best.less").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lattice_sampling": op1_lattice_sampling,
    "op2_html_text": op2_html_text,
    "op3_license_scan": op3_license_scan,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_bounded_ring": op5_bounded_ring,
    "op6_log_bilinear": op6_log_bilinear,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_vector_best_fit": op8_vector_best_fit,
    "op9_quality_rules": op9_quality_rules,
    "op10_secret_scan": op10_secret_scan,
    "op11_collocations": op11_collocations,
    "op12_decontamination": op12_decontamination,
    "op13_periodic_runs": op13_periodic_runs,
}

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"""regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

#: The others are not expressible in SQL as a whole; tests/llm holds each against a brute-force version.
ORACLE_SQL: dict[str, str] = {
    "op11_collocations": rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWERED}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, m, array_to_string(w[k + 1:k + m], ' ') AS phrase
      FROM (SELECT lang, w, m, unnest(range(len(w) - m + 1)) AS k FROM w, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
s AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS ws, unnest(range(1, m)) AS k FROM f WHERE m > 1),
c AS (SELECT s.lang, s.phrase, a, k, x.f AS l, y.f AS r, n, CAST((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
      FROM s JOIN t ON s.lang = t.lang JOIN f x ON x.lang = s.lang AND x.phrase = array_to_string(ws[1:k], ' ')
      JOIN f y ON y.lang = s.lang AND y.phrase = array_to_string(ws[k + 1:], ' ')),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
d AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.lang = b.lang AND f.f >= b.a AND length(f.phrase) > length(b.phrase)
      AND contains(' ' || f.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM d
QUALIFY rank <= 2000""",
    "op12_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
t AS (SELECT w, row_number() OVER () AS own FROM (SELECT DISTINCT w FROM b WHERE len(w) > 0)),
g AS (SELECT DISTINCT own, array_to_string(w[k + 1:k + least(10, len(w))], ' ') AS gram, least(10, len(w)) AS m
      FROM (SELECT own, w, unnest(range(greatest(len(w) - 9, 1))) AS k FROM t)),
o AS (SELECT row, k, m, array_to_string(w[k + 1:k + m], ' ') AS gram
      FROM (SELECT row, w, m, unnest(range(len(w) - m + 1)) AS k FROM d, (SELECT DISTINCT m FROM g) WHERE len(w) >= m)),
f AS (SELECT o.row, o.k, o.m, g.own FROM o JOIN g ON o.gram = g.gram AND o.m = g.m),
h AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT row, unnest(range(k, k + m)) AS p FROM f) GROUP BY row),
i AS (SELECT row, list_sort(list(DISTINCT item_id)) AS ids FROM f JOIN t USING (own) JOIN b ON b.w = t.w GROUP BY row),
p AS (SELECT row, unnest(w) AS term, unnest(range(len(w))) AS pos FROM d),
c AS (SELECT own, x.term, row_number() OVER (PARTITION BY own ORDER BY coalesce(n, 0), x.term) AS rarity
      FROM (SELECT DISTINCT own, unnest(w) AS term FROM t) x LEFT JOIN (SELECT term, count(*) AS n FROM p GROUP BY term) y ON x.term = y.term),
q AS (SELECT own, term, count(*) OVER (PARTITION BY own) AS needed FROM c WHERE rarity <= 5),
a AS (SELECT row, own, needed, q.term, pos FROM p JOIN q ON p.term = q.term),
v AS (SELECT row, count(DISTINCT own) AS n_near FROM (
      SELECT a.row, a.own FROM a JOIN a z ON a.row = z.row AND a.own = z.own AND z.pos BETWEEN a.pos AND a.pos + 19
      GROUP BY a.row, a.own, a.pos, a.term, a.needed HAVING count(DISTINCT z.term) = a.needed) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN h USING (row) LEFT JOIN i USING (row) LEFT JOIN v USING (row)""",
}
