"""Aggregates over findings: counts, pillar scores, composite, rankings, deltas, history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.functions.columns import SCORED_PILLARS, grade, penalty
from lintlake.operators.findings import report_order


def severity_summary(findings: DataFrame) -> DataFrame:
    """advisory, warning, error, total in one row."""
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in ("advisory", "warning", "error")]
    return findings.agg(*counts, F.count("*").alias("total"))


def _scored(findings: DataFrame, unscored_rules: Sequence[str]) -> Column:
    return F.when(F.col("rule_id").isin(*unscored_rules), 0.0).otherwise(penalty()) if unscored_rules else penalty()


def pillar_scores(findings: DataFrame, unscored_rules: Sequence[str] = (), pillars: Sequence[str] = SCORED_PILLARS) -> DataFrame:
    """pillar, findings, penalty, score for each scored pillar, and for others that have findings.

    Rules left out of the score count as findings but add no penalty.
    """
    listed = findings.sparkSession.createDataFrame([(p, True) for p in pillars], "pillar string, scored boolean")
    sums = findings.groupBy("pillar").agg(F.count("*").alias("findings"), F.sum(_scored(findings, unscored_rules)).alias("penalty"))
    both = listed.join(sums, "pillar", "full_outer")
    lost = F.coalesce("penalty", F.lit(0.0))
    return both.select(
        "pillar", F.coalesce("findings", F.lit(0).cast("bigint")).alias("findings"), lost.alias("penalty"),
        F.greatest(F.lit(0.0), 100.0 - lost).alias("score"), F.coalesce("scored", F.lit(False)).alias("scored"),
    )


def composite(scores: DataFrame) -> DataFrame:
    """score (mean over the scored pillars) and grade."""
    return scores.filter("scored").agg(F.avg("score").alias("score")).withColumn("grade", grade(F.col("score")))


def file_pillar_scores(findings: DataFrame) -> DataFrame:
    """file_path, pillar, findings, penalty, score, grade of every pillar that has findings in a file."""
    sums = findings.groupBy("file_path", "pillar").agg(F.count("*").alias("findings"), F.sum(penalty()).alias("penalty"))
    scores = sums.withColumn("score", F.greatest(F.lit(0.0), 100.0 - F.col("penalty")))
    return scores.withColumn("grade", grade(F.col("score")))


def top_files(findings: DataFrame, limit: int = 10) -> DataFrame:
    """Files with the lowest scores: file_path, findings, penalty, score. Every rule counts here."""
    sums = findings.groupBy("file_path").agg(F.count("*").alias("findings"), F.sum(penalty()).alias("penalty"))
    scores = sums.withColumn("score", F.greatest(F.lit(0.0), 100.0 - F.col("penalty")))
    return scores.orderBy("score", F.desc("findings"), "file_path").limit(limit)


def top_rules(findings: DataFrame, limit: int = 10) -> DataFrame:
    """rule_id, findings, severity of the first finding in report order."""
    first = F.min_by("severity", F.struct(F.col("file_path"), *report_order()))
    counts = findings.groupBy("rule_id").agg(F.count("*").alias("findings"), first.alias("severity"))
    return counts.orderBy(F.desc("findings"), "rule_id").limit(limit)


def pillar_digest(findings: DataFrame) -> DataFrame:
    """Scores by pillar with severity counts and grade."""
    by = findings.groupBy("pillar").agg(*(F.count_if(F.col("severity") == s).alias(s) for s in ("advisory", "warning", "error")))
    joined = pillar_scores(findings).join(by, "pillar", "left")
    zero = F.lit(0).cast("bigint")
    return joined.select("pillar", "findings", *(F.coalesce(s, zero).alias(s) for s in ("advisory", "warning", "error")), "score", grade(F.col("score")).alias("grade"), F.col("scored").alias("applicable"))


def movers(deltas: DataFrame, limit: int = 5) -> DataFrame:
    """The rules that improved and those that regressed most: direction, place, rule_id, net."""
    moved = deltas.filter("net <> 0").withColumn("direction", F.when(F.col("net") < 0, "improved").otherwise("regressed"))
    order = Window.partitionBy("direction").orderBy(F.abs("net").desc(), "rule_id")
    return moved.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).select("direction", "place", "rule_id", "net")


def complexity_histogram(findings: DataFrame) -> DataFrame:
    """bucket, findings over the complexity in the metadata of cyclomatic findings; all five buckets are listed."""
    value = F.get_json_object("metadata", "$.complexity").cast("bigint")
    bucket = F.when(value <= 5, 0).when(value <= 10, 1).when(value <= 15, 2).when(value <= 20, 3).otherwise(4)
    counts = findings.filter("rule_id = 'complexity.cyclomatic'").filter(value.isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("findings"))
    listed = findings.sparkSession.range(5).select(F.col("id").cast("int").alias("bucket"))
    return listed.join(counts, "bucket", "left").select("bucket", F.coalesce("findings", F.lit(0).cast("bigint")).alias("findings"))


def verdict(findings: DataFrame) -> DataFrame:
    """blocking (warnings and errors) and the number of pillars that they are in."""
    return findings.filter("severity in ('warning', 'error')").agg(F.count("*").alias("blocking"), F.countDistinct("pillar").alias("pillars"))


def history_tail(history: DataFrame, keep: int = 100) -> DataFrame:
    """The last rows of a history by recorded_at and seq, which must tell rows apart. A plain top-k, kept as rows."""
    return history.orderBy(F.desc("recorded_at"), F.desc("seq")).limit(keep)


def exit_code(findings: DataFrame, failures: int, fail_on: str | None) -> int:
    """2 after a failed run, 1 with a finding at or over `fail_on`, else 0."""
    if failures:
        return 2
    at_least = {"advisory": ("advisory", "warning", "error"), "warning": ("warning", "error"), "error": ("error",)}
    return int(bool(fail_on) and bool(findings.filter(F.col("severity").isin(*at_least[fail_on])).limit(1).count()))
