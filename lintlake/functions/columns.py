"""Scalar columns of findings: identities, weights, grades, redaction, globs, entropy."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("advisory", "warning", "error")
# Penalties and weights of scoring.
SEVERITY_PENALTY = {"advisory": 1.5, "warning": 4.0, "error": 8.0}
CONFIDENCE_WEIGHT = {"low": 0.5, "medium": 0.75, "high": 1.0}
# The pillars that are scored, in report order.
SCORED_PILLARS = (
    "size", "complexity", "dead-code", "maintainability", "naming", "documentation", "modernisation", "security", "sensitive-data", "test-quality", "design",
)


def _digest(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 16)


def fingerprint() -> Column:
    """16 hex digits of SHA-256 over rule, file, line (0 if none) and symbol (empty if none)."""
    return _digest(F.col("rule_id"), F.col("file_path"), F.coalesce("line", F.lit(0)).cast("string"), F.coalesce("symbol", F.lit("")))


def stable_identity() -> Column:
    """The same over rule, file and the symbol or, without one, the message: it survives moved lines."""
    return _digest(F.col("rule_id"), F.col("file_path"), F.coalesce("symbol", "message"))


def severity_rank(severity: Column) -> Column:
    """0 to 2."""
    return F.when(severity == "advisory", 0).when(severity == "warning", 1).otherwise(2)


def penalty() -> Column:
    """Severity penalty times confidence weight; all products are dyadic, so sums are exact in any order."""
    by_severity, by_confidence = F.lit(None).cast("double"), F.lit(None).cast("double")
    for name, value in SEVERITY_PENALTY.items():
        by_severity = F.when(F.col("severity") == name, value).otherwise(by_severity)
    for name, value in CONFIDENCE_WEIGHT.items():
        by_confidence = F.when(F.col("confidence") == name, value).otherwise(by_confidence)
    return by_severity * by_confidence


def grade(score: Column) -> Column:
    """A from 90, B from 80, C from 70, D from 60, else F."""
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def redact(value: Column) -> Column:
    """Stars for eight characters or fewer; else the first and last four and the length."""
    n = F.length(value)
    short = F.concat(F.repeat(F.lit("*"), n), F.lit(""))
    long = F.concat(F.substring(value, 1, 4), F.lit("..."), F.right(value, F.lit(4)))
    return F.concat(F.when(n <= 8, short).otherwise(long), F.lit(" (redacted, "), n.cast("string"), F.lit(" chars)"))


def entropy(value: Column) -> Column:
    """Shannon entropy in bits a character."""
    n = F.length(value).cast("double")
    share = lambda c: (n - F.length(F.replace(value, c, F.lit("")))) / n
    return F.aggregate(F.array_distinct(F.split(value, "")), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))


def is_high_entropy(value: Column) -> Column:
    """At least 32 characters, of upper case, lower case and digits, with 4.2 bits or more."""
    mixed = value.rlike("[A-Z]") & value.rlike("[a-z]") & value.rlike("[0-9]")
    return F.when((F.length(value) >= 32) & mixed, entropy(value) >= 4.2).otherwise(F.lit(False))


def glob_regex(glob: str) -> str:
    """Pattern of a path glob: `*` stays in a segment, `**` crosses them, a leading `**/` may be absent, `x/**` is the
    tree below x, and a plain path is itself and all below it."""
    glob = re.sub(r"^\./", "", glob.replace("\\", "/")).rstrip("/")
    if glob.endswith("/**") and "*" not in glob[:-3]:
        return f"^{re.escape(glob[:-3])}(/.*)?$"
    if "*" not in glob and "?" not in glob:
        return f"^{re.escape(glob)}(/.*)?$"
    out, rest = "^", glob
    if rest.startswith("**/"):
        out, rest = "^(.*/)?", rest[3:]
    while rest:
        if rest.startswith("**/"):
            out, rest = out + "(.*/)?", rest[3:]
        elif rest.startswith("**"):
            out, rest = out + ".*", rest[2:]
        elif rest[0] == "*":
            out, rest = out + "[^/]*", rest[1:]
        elif rest[0] == "?":
            out, rest = out + "[^/]", rest[1:]
        else:
            out, rest = out + re.escape(rest[0]), rest[1:]
    return out + "$"


def github_escape(value: Column, is_property: bool = False) -> Column:
    """Text of a workflow command: percent, line ends and, in a property, colon and comma."""
    pairs = [("%", "%25"), ("\r", "%0D"), ("\n", "%0A")] + [(":", "%3A"), (",", "%2C")] * is_property
    for old, new in pairs:
        value = F.replace(value, F.lit(old), F.lit(new))
    return value


def html_escape(value: Column) -> Column:
    """Text of an HTML page."""
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        value = F.replace(value, F.lit(old), F.lit(new))
    return value
