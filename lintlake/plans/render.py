"""Findings as output rows and documents."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from datetime import UTC, datetime
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions.columns import github_escape
from lintlake.operators import scoring
from lintlake.operators.findings import Exclusion, exclusion_counts
from lintlake.operators.remedies import REMEDIES

if TYPE_CHECKING:
    from lintlake.plans.analyse import Scan


def github_commands(findings: DataFrame) -> DataFrame:
    """command: one workflow command for each finding."""
    level = F.when(F.col("severity") == "error", "::error").when(F.col("severity") == "warning", "::warning").otherwise("::notice")
    line = F.when(F.col("line").isNull(), "").otherwise(F.concat(F.lit(",line="), F.col("line").cast("string")))
    parts = [level, F.lit(" file="), github_escape(F.col("file_path"), True), line, F.lit(",title="), github_escape(F.col("rule_id"), True), F.lit("::"), github_escape(F.col("message"))]
    return findings.select(F.concat(*parts).alias("command"))


#: Diagnostics that are no failures.
NOTES = ("patch-filter", "excluded-security-rule-from-score")


def about(scan: Scan, root: str, form: str, fail_on: str, baseline: str | None) -> dict:
    """What a report says of the run. Diagnostics, ignored paths, exclusions and deltas are rows of paths and rules, not of findings."""
    rows = lambda df: [r.asDict() for r in df.collect()]
    diagnostics = rows(scan.diagnostics)
    counts = {r["exclusion"]: r["suppressed"] for r in exclusion_counts(scan.suppressed, scan.settings.exclusions).collect()} if scan.settings.exclusions else {}
    listed = [{"index": k, "rule": ", ".join(x.rules), "paths": list(x.paths), "messageContains": x.message_contains, "reason": x.reason, "suppressed": counts.get(k, 0)} for k, x in enumerate(scan.settings.exclusions)]
    out = {
        "schemaVersion": "lintlake.analysis.v1", "tool": {"name": "lintlake", "version": "1"},
        "run": {"projectRoot": root, "format": form, "failOn": fail_on, "generatedAt": datetime.now(UTC).isoformat()},
        "paths": {"analysedFiles": scan.sources.count(), "ignoredPaths": sorted(r["file_path"] for r in rows(scan.ignored)), "missingPaths": sorted(d["file_path"] for d in diagnostics if d["diagnostic_type"] == "missing-path")},
        "diagnostics": diagnostics, "suppressions": listed, "baseline": {"path": baseline} if baseline else None,
    }
    if scan.deltas is not None:
        out["perRuleDeltas"] = [{"ruleId": r["rule_id"], **{k: r[k] for k in ("introduced", "removed", "net")}} for r in rows(scan.deltas.orderBy("rule_id"))]
    return out


def uri(path: Column) -> Column:
    """A path as a URI: percent-encoded but for its slashes."""
    return F.replace(F.replace(F.url_encode(path), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))


def sarif_results(findings: DataFrame, reason: Column | None = None) -> DataFrame:
    """result: one SARIF 2.1.0 result object, as JSON, for each finding; with a `reason` they are suppressed ones."""
    level = F.when(F.col("severity") == "error", "error").when(F.col("severity") == "warning", "warning").otherwise("note")
    region = F.when(F.col("line").isNotNull(), F.struct(F.col("line").alias("startLine")))
    place = F.struct(F.struct(F.struct(uri(F.col("file_path")).alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    prints = F.struct(F.col("fingerprint").alias("primaryLocationLineHash"), F.col("stable_identity").alias("stableIdentity"))
    parts = [F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"), prints.alias("partialFingerprints")]
    if reason is not None:
        parts.append(F.array(F.struct(F.lit("external").alias("kind"), reason.alias("justification"))).alias("suppressions"))
    return findings.select(F.to_json(F.struct(*parts)).alias("result"))


def sarif_report(findings: DataFrame, rules: DataFrame | None = None, suppressed: DataFrame | None = None, diagnostics: Sequence[dict] = (), exclusions: Sequence[Exclusion] = ()) -> Iterator[str]:
    """A SARIF 2.1.0 document in parts: the rules, every result, the suppressed ones last, and the run's notifications.

    Results come one partition at a time.
    """
    listed = [] if rules is None else [
        {"id": r["rule_id"], "properties": {k: r[k] for k in ("pillar", "severity", "confidence", "threshold") if r[k] is not None}, "help": {"text": REMEDIES.get(r["rule_id"], "")}}
        for r in rules.orderBy("rule_id").collect()
    ]
    driver = json.dumps({"name": "lintlake", "rules": listed})
    yield '{"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": ' + driver + '}, "results": ['
    between = "\n"
    tables = [sarif_results(findings)]
    if suppressed is not None and exclusions:
        reason = F.element_at(F.array(*(F.lit(x.reason) for x in exclusions)), F.col("exclusion") + 1)
        tables.append(sarif_results(suppressed, reason))
    for table in tables:
        for row in table.toLocalIterator():
            yield between + row["result"]
            between = ",\n"
    notes = [{"descriptor": {"id": d["diagnostic_type"]}, "level": "note" if d["diagnostic_type"] in NOTES else "error", "message": {"text": d["message"]}} for d in diagnostics]
    invocation = {"executionSuccessful": all(d["diagnostic_type"] in NOTES for d in diagnostics), "toolExecutionNotifications": notes}
    yield '\n], "invocations": [' + json.dumps(invocation) + "]}]}\n"


def text_report(findings: DataFrame, unscored: Sequence[str] = (), about: dict | None = None) -> Iterator[str]:
    """The findings a line each, in report order, then diagnostics, exclusions and deltas where there are any, and the summary."""
    for f in ordered(findings).toLocalIterator():
        yield f"{f['severity']} {f['file_path']}{'' if f['line'] is None else ':' + str(f['line'])} {f['rule_id']} {f['message']}\n"
    about = about or {}
    for d in about.get("diagnostics", ()):
        yield f"{'note' if d['diagnostic_type'] in NOTES else 'problem'} {d['file_path'] or '-'} {d['diagnostic_type']} {d['message']}\n"
    for x in about.get("suppressions", ()):
        yield f"excluded {x['suppressed']} by rule {x['rule'] or 'any'}: {x['reason']}\n"
    for d in about.get("perRuleDeltas", ()):
        yield f"delta {d['ruleId']} +{d['introduced']} -{d['removed']}\n"
    document = report(findings, 0, unscored)
    counts = ", ".join(f"{document['summary'][k]} {k}" for k in ("error", "warning", "advisory"))
    yield f"score {document['score']['score']:.1f} ({document['score']['grade']}); {counts}\n"


def ordered(findings: DataFrame) -> DataFrame:
    """What a report shows of each finding, in report order."""
    shown = ("rule_id", "message", "file_path", "line", "severity", "pillar", "confidence", "symbol", "metadata", "remediation", "fingerprint")
    shown = tuple(c for c in shown if c in findings.columns)
    return findings.orderBy("file_path", *scoring.report_order()).select(*shown)


def report(findings: DataFrame, shown: int = 50, unscored: Sequence[str] = ()) -> dict:
    """The report document: summary, score, pillars, worst files and the first `shown` findings in order. The rules
    `unscored` add no penalty.

    Only aggregates and top-k rows reach the driver; all findings are written with `DataFrame.write`.
    """
    scores = scoring.pillar_scores(findings, unscored)
    first = ordered(findings).limit(shown)
    rows = lambda df: [r.asDict() for r in df.collect()]
    return {
        "summary": rows(scoring.severity_summary(findings))[0],
        "score": rows(scoring.composite(scores))[0],
        "pillars": sorted(rows(scores), key=lambda r: r["pillar"]),
        "topOffenders": rows(scoring.top_files(findings)),
        "findings": rows(first),
    }


def json_report(findings: DataFrame, unscored: Sequence[str] = (), about: dict | None = None) -> Iterator[str]:
    """The report document with all findings as JSON text, in parts; findings come one partition at a time."""
    head = json.dumps((about or {}) | report(findings, 0, unscored) | {"findings": []}, indent=2)
    yield head.removesuffix("]\n}")
    between = "\n    "
    for row in ordered(findings).toLocalIterator():
        yield between + json.dumps(row.asDict())
        between = ",\n    "
    yield "\n  ]\n}\n"


def markdown(document: dict) -> str:
    """A report document as Markdown."""
    out = [f"# Score {document['score']['score']:.1f} ({document['score']['grade']})", "", "| Pillar | Score | Findings |", "|---|---:|---:|"]
    out += [f"| {p['pillar']} | {p['score']:.1f} | {p['findings']} |" for p in document["pillars"]]
    out += ["", "## Findings", ""]
    plain = lambda text: re.sub(r"([\\\\`*_{}\[\]<>|])", r"\\\\\1", text)
    out += [f"- `{f['rule_id']}` {plain(f['file_path'])}:{f['line'] or '-'} {f['message']}" for f in document["findings"]]
    suppressed = sum(x["suppressed"] for x in document.get("suppressions", ()))
    out += ["", f"{suppressed} findings are excluded."] if suppressed else []
    return "\n".join(out) + "\n"


def hotspot(document: dict) -> str:
    """Score and worst files as JSON."""
    return json.dumps({"score": document["score"], "topOffenders": document["topOffenders"]}, indent=2)
