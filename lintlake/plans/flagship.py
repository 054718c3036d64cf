"""The flagship query: documents as text sources, one rule, identities, dedupe and pillar scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.functions.columns import SCORED_PILLARS
from lintlake.operators import findings as O
from lintlake.operators import scoring, text_rules
from lintlake.plans import simulate


def assignment_findings(sources: DataFrame) -> DataFrame:
    """A finding for each line that assigns a secret-like value (a reconstructed rule: its wordlist is ours)."""
    hits = text_rules.lines(sources).filter(F.col("text").rlike(text_rules.ASSIGNMENT))
    fixed = {"rule_id": "sensitive-data.hardcoded-env-value", "message": "Hardcoded secret-like value", "severity": "error", "pillar": "sensitive-data", "confidence": "high"}
    shown = hits.select("file_path", "line", *(F.lit(v).alias(k) for k, v in fixed.items()), F.lit(None).cast("string").alias("symbol"), F.lit(0).alias("emit_seq"))
    return O.identified(shown)


def documents_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pillar scores of all documents."""
    return scoring.pillar_scores(O.deduped(assignment_findings(simulate.sources(spark, sf_dir))))


_SCORED = ", ".join(f"('{p}')" for p in SCORED_PILLARS)
ORACLE_SQL = f"""WITH {simulate.SOURCES_SQL}, hits AS (
  SELECT DISTINCT file_path, line FROM (SELECT file_path, unnest(l) AS text, generate_subscripts(l, 1) AS line FROM (SELECT file_path, string_split(content, chr(10)) AS l FROM sources))
  WHERE regexp_matches(text, '(?i)(password|passwd|secret|token|api_?key)["'']?\\s*[:=]\\s*["'']?[A-Za-z0-9+/_.=-]{{8,}}'))
SELECT pillar, CASE WHEN pillar = 'sensitive-data' THEN n ELSE 0 END AS findings, CASE WHEN pillar = 'sensitive-data' THEN 8.0::DOUBLE * n ELSE 0 END AS penalty,
  greatest(0.0::DOUBLE, 100.0 - CASE WHEN pillar = 'sensitive-data' THEN 8.0::DOUBLE * n ELSE 0 END) AS score, true AS scored FROM (VALUES {_SCORED}) s(pillar), (SELECT count(*) AS n FROM hits)"""
