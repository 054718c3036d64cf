"""The rule catalogue as a table: listing, suggestions, thresholds."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lintlake.operators import rust_rules as R
from lintlake.operators.remedies import REMEDIES
from lintlake.sources.settings import Settings, confidence_name

# Rules with thresholds, and the thresholds.
THRESHOLDS = {
    "architecture.large-module": 25.0, "architecture.module-fan-out": 8.0, "architecture.public-api-surface": 12.0, "complexity.cognitive": 15.0, "complexity.cyclomatic": 10.0,
    "complexity.nesting-depth": 4.0, "dependency.duplicate-locked-version": 2.0, "metrics.halstead-volume": 1500.0, "metrics.maintainability-pressure": 45.0,
    "size.file-length": 600.0, "size.function-length": 50.0, "size.parameter-count": 5.0, "test-quality.long-test": 120.0,
}
_ELSEWHERE = [  # rules that are built where they are used: id, pillar, severity, confidence
    ("architecture.large-module", "design", "advisory", "high"), ("architecture.module-fan-out", "design", "advisory", "high"), ("architecture.public-api-surface", "design", "advisory", "high"),
    ("ci.github-event-shell-interpolation", "security", "warning", "high"), ("dead-code.unused-private-function", "dead-code", "advisory", "low"),
    ("dead-code.unused-private-item-candidate", "dead-code", "advisory", "medium"), ("dependency.duplicate-locked-version", "security", "advisory", "high"),
    ("dependency.git-source", "security", "warning", "high"), ("dependency.git-unpinned-revision", "security", "warning", "high"), ("dependency.missing-package-metadata", "documentation", "advisory", "high"),
    ("dependency.path-source", "security", "advisory", "high"), ("dependency.wildcard-version", "security", "warning", "high"), ("docs.missing-readme", "documentation", "advisory", "high"),
    ("modernisation.manual-strip-prefix", "modernisation", "advisory", "high"), ("modernisation.manual-unwrap-or-default", "modernisation", "advisory", "high"),
    ("modernisation.public-field", "modernisation", "advisory", "high"), ("modernisation.question-mark-candidate", "modernisation", "advisory", "high"), ("naming.identifier-shadow", "naming", "advisory", "high"),
    ("naming.short-variable", "naming", "advisory", "medium"), ("security.path-traversal-candidate", "security", "warning", "medium"), ("security.weak-crypto", "security", "warning", "medium"), ("size.file-length", "size", "warning", "high"),
]


OPTIONS = {"naming.generic-function": ["extraGenericNames"], "naming.boolean-prefix": ["predicatePrefixes"], "naming.placeholder-identifier": ["extraPlaceholders"]}


def cards(spark: SparkSession) -> DataFrame:
    """The rules with a title, the names of their options, and what to do about a finding."""
    rows = rules(spark)
    told = spark.createDataFrame([(r["rule_id"], OPTIONS.get(r["rule_id"], []), REMEDIES.get(r["rule_id"])) for r in rows.select("rule_id").collect()], "rule_id string, options array<string>, remediation string")
    title = F.initcap(F.translate(F.element_at(F.split("rule_id", r"\."), -1), "-", " "))
    return rows.withColumn("title", title).join(told, "rule_id")


def described(counts: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Counts by rule with the title, confidence and remediation that the catalogue has of it; custom rules have none."""
    return counts.join(catalogue.select("rule_id", "title", F.col("confidence").alias("rule_confidence"), "remediation"), "rule_id", "left")


def rules(spark: SparkSession) -> DataFrame:
    """rule_id, pillar, severity, confidence, threshold of every built-in rule."""
    listed = [(r.id, r.pillar, r.severity, r.confidence) for part in (R.BLOCK_RULES, R.LINE_RULES, R.COMMENT_RULES, R.TEXT_RULES, R.KEY_RULES, R.ENTROPY_RULES) for r in part]
    rows = [(*r, THRESHOLDS.get(r[0])) for r in sorted({*listed, *_ELSEWHERE})]
    return spark.createDataFrame(rows, "rule_id string, pillar string, severity string, confidence string, threshold double")


def selector_matches(catalogue: DataFrame, selectors: DataFrame) -> DataFrame:
    """selector, rank, rule_id: the rules that each of `selectors` (selector) takes, by the first kind of match that there is.

    Kinds are the exact id (0), a pillar's name in any case and spacing (1), and a dotted prefix with or without `.*` (2). A
    selector that takes none has one row without rank and rule. All three are equi joins.
    """
    plain = lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", ""))
    named = selectors.select("selector", F.trim("selector").alias("own")).distinct()
    parts = F.split("rule_id", r"\.")
    prefixes = catalogue.select("rule_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))).alias("prefix")).filter("prefix <> rule_id")
    kinds = [
        named.join(catalogue, F.col("own") == F.col("rule_id")).select("selector", F.lit(0).alias("rank"), "rule_id"),
        named.join(catalogue, plain("own") == plain("pillar")).select("selector", F.lit(1).alias("rank"), "rule_id"),
        named.withColumn("prefix", F.regexp_replace("own", r"\.\*$", "")).join(prefixes, "prefix").select("selector", F.lit(2).alias("rank"), "rule_id"),
    ]
    found = kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).withColumn("least", F.min("rank").over(Window.partitionBy("selector")))
    return named.select("selector").join(found.filter("rank = least").drop("least"), "selector", "left")


def expanded(catalogue: DataFrame, selectors: Sequence[str], where: str) -> list[str]:
    """The ids of the rules that the selectors take; one that is empty, malformed or takes none is an error."""
    for s in map(str.strip, selectors):
        if not s:
            raise ValueError(f"empty selector in {where}")
        if ":" in s or ("*" in s and not s.endswith(".*")):
            raise ValueError(f"unsupported selector {s!r} in {where}")
    rows = selector_matches(catalogue, catalogue.sparkSession.createDataFrame([(s,) for s in selectors], "selector string")).collect()  # no more than selectors times rules
    if unknown := sorted(r["selector"] for r in rows if r["rule_id"] is None):
        raise ValueError(f"unknown selector {unknown[0]!r} in {where}; expected a rule id, a dotted prefix or a pillar")
    return sorted({r["rule_id"] for r in rows})


def resolved(spark: SparkSession, settings: Settings) -> Settings:
    """The settings with rule ids in place of selectors. Custom rules count as rules; settings of unknown rules are errors."""
    custom = [(f"custom.{r['id'].removeprefix('custom.')}", r["pillar"], r["severity"], confidence_name(r.get("confidence")), None) for r in settings.custom_rules]
    catalogue = rules(spark)
    catalogue = catalogue.unionByName(spark.createDataFrame(custom, catalogue.schema)) if custom else catalogue
    known = {r["rule_id"] for r in catalogue.select("rule_id").collect()}
    if wrong := sorted({*settings.disabled, *settings.unscored, *settings.thresholds} - known):
        raise ValueError(f"settings for unknown rules: {', '.join(wrong)}")
    if unbounded := sorted(settings.thresholds.keys() - THRESHOLDS.keys()):
        raise ValueError(f"no threshold can be set for {', '.join(unbounded)}")
    return replace(settings, select=tuple(expanded(catalogue, settings.select, "rules.select")), ignore=tuple(expanded(catalogue, settings.ignore, "rules.ignore")))


def score_warnings(spark: SparkSession, settings: Settings) -> DataFrame:
    """A diagnostic for each rule on security or secrets that is left out of the score."""
    kept = rules(spark).filter(F.col("pillar").isin("security", "sensitive-data") & F.col("rule_id").isin(*settings.unscored)) if settings.unscored else rules(spark).limit(0)
    shown = F.regexp_replace(F.initcap(F.translate("pillar", "-", " ")), " ", "")
    said = F.concat(F.lit("Rule `"), "rule_id", F.lit("` ("), shown, F.lit(" pillar) is configured with `excludeFromScore: true`; its findings still surface but no longer affect the composite score."))
    return kept.orderBy("rule_id").select(F.lit("excluded-security-rule-from-score").alias("diagnostic_type"), said.alias("message"), F.lit(None).cast("string").alias("file_path"))


def suggestions(catalogue: DataFrame, wanted: str, most: int = 3, most_edits: int = 3) -> DataFrame:
    """The ids nearest to a mistyped one, at most `most_edits` edits away."""
    near = catalogue.select("rule_id", F.levenshtein("rule_id", F.lit(wanted)).alias("distance")).filter(F.col("distance") <= most_edits)
    return near.orderBy("distance", "rule_id").limit(most)


def with_threshold(rule: R.Rule, threshold: float, severity: str) -> R.Rule:
    """A block rule with another threshold and severity, in its condition, message and metadata.

    A rule that counts compares with the threshold's whole part.
    """
    if rule.id not in THRESHOLDS:
        raise ValueError(f"{rule.id} has no threshold")
    exact = rule.id.startswith("metrics.")
    shown = repr(float(threshold)) if exact else str(int(threshold))
    default = str(int(THRESHOLDS[rule.id]))
    changed, n = re.subn(rf"([<>]) {default}\b", rf"\1 {shown}", rule.when)
    if not n:
        raise ValueError(f"{rule.id} is not built from a condition")
    said = (rf"\b{default}\.0D", f"{shown}D") if exact else (rf"(threshold of |'threshold', ){default}\b", rf"\g<1>{shown}")
    return replace(rule, when=changed, severity=severity, message=re.sub(*said, rule.message), metadata=re.sub(*said, rule.metadata))
