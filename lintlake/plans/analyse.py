"""The whole analysis of a source tree, and its command line."""

from __future__ import annotations

import argparse
import os
import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.operators import findings as O
from lintlake.operators import scoring, text_rules
from lintlake.operators.rust_rules import ABBREVIATIONS, BLOCK_RULES, NameOptions, Rule, _found, length_findings, rust_findings, sensitive_findings, workflow_findings
from lintlake.operators.rust_tables import exploded, parsed
from lintlake.plans import catalog, render
from lintlake.sources.discovery import source_files
from lintlake.sources.manifest import manifest_findings
from lintlake.sources.patch import parse_ranges, patch_tables
from lintlake.sources.settings import Settings, confidence_name, parse_settings
from lintlake.sources.stored import read_baseline, write_baseline


@dataclass(frozen=True)
class Scan:
    """Lazy results of an analysis. `deltas` (rule_id, introduced, removed, net) is there with a baseline or a patch.

    The scanned Rust table is persisted; `close` lets go of it.
    """

    sources: DataFrame
    findings: DataFrame
    suppressed: DataFrame
    diagnostics: DataFrame
    ignored: DataFrame
    deltas: DataFrame | None
    settings: Settings
    rust: DataFrame

    def close(self) -> None:
        self.findings.unpersist()
        self.rust.unpersist()


def custom_findings(sources: DataFrame, rules: tuple[dict, ...]) -> DataFrame | None:
    """Every match of every custom rule; the symbol is the byte at which the match starts.

    The scope is the whole text of all files, or the code or the comments of Rust files.
    """
    out = None
    for k, r in enumerate(rules):
        scope = {"text": "content", "rust-code": "code", "comments": "comment_text"}[r.get("scope", "text")]
        within = sources if scope == "content" else parsed(sources.filter("is_rust")).select("file_path", scope)
        if r.get("include_paths"):
            within = within.filter(O.Exclusion(paths=r["include_paths"]).matches())
        if r.get("exclude_paths"):
            within = within.filter(~O.Exclusion(paths=r["exclude_paths"]).matches())
        hits = text_rules.custom_matches(within, r["pattern"], scope)
        shown = hits.select("file_path", F.col("first_line").alias("line"), F.col("match_index").alias("seq"), F.concat(F.lit("byte:"), "start_byte").alias("name"))
        message = r["message"].replace("\\", "\\\\").replace("'", "\\'")
        part = _found(shown, [Rule(f"custom.{r['id'].removeprefix('custom.')}", r["pillar"], r["severity"], confidence_name(r.get("confidence")), "true", f"'{message}'")], 40 + k)
        out = part if out is None else out.unionByName(part)
    return out


def _block_rules(settings: Settings) -> list[Rule]:
    """The block rules under the thresholds of the settings."""
    return [catalog.with_threshold(r, *settings.thresholds[r.id]) if r.id in settings.thresholds else r for r in BLOCK_RULES]


def _names(settings: Settings) -> NameOptions:
    given = settings.options.get
    abbreviations = ABBREVIATIONS if settings.abbreviations is None else settings.abbreviations
    return NameOptions(given("naming.generic-function", ()), given("naming.boolean-prefix", ()), given("naming.placeholder-identifier", ()), abbreviations)


def analyse(
    spark: SparkSession, root: str, paths: tuple[str, ...] = (".",), settings: Settings = Settings(), baseline: DataFrame | None = None,
    patch: str | None = None, ranges: str | None = None, scope: str = "hunk",
) -> Scan:
    """Findings of a tree: rules, dedupe, baseline, exclusions and, with a patch or ranges of lines, changed lines only, in that order.

    Ranges hold for every file. With scope `symbol` a finding also stays if its smallest enclosing function has a changed line.
    """
    settings = catalog.resolved(spark, settings)
    sources, problems, ignored = source_files(spark, root, paths, settings.ignored_paths)
    problems = problems.unionByName(catalog.score_warnings(spark, settings))
    lines = files = None
    if patch is not None:
        lines, files = patch_tables(spark, patch)
        sources = sources.join(files.select("file_path").distinct(), "file_path", "left_semi")
    elif ranges is not None:
        files = sources.select("file_path", F.lit(False).alias("whole_file"))
        lines = O.explicit_ranges(parse_ranges(ranges), files)
    limits = {name: settings.thresholds.get(name, (default, None)) for name, default in catalog.THRESHOLDS.items()}
    project, more = manifest_findings(spark, root, int(limits["dependency.duplicate-locked-version"][0]))
    rust = parsed(sources.filter("is_rust")).persist()
    broken = rust.filter("error is not null").select(F.lit("parse-error").alias("diagnostic_type"), F.concat(F.lit("Rust parser error: "), "error").alias("message"), "file_path")
    modules = {name: int(limits[f"architecture.{name}"][0]) for name in ("module-fan-out", "public-api-surface", "large-module")}
    found = rust_findings(sources.filter("is_rust"), _block_rules(settings), _names(settings), rust, modules).drop("fingerprint", "stable_identity")
    texts = sources.filter("not is_rust")
    null = F.lit(None).cast("int")
    parts = (project, length_findings(sources, int(limits["size.file-length"][0])), sensitive_findings(texts), workflow_findings(texts), custom_findings(sources, settings.custom_rules))
    for part in parts:
        if part is not None:
            found = found.unionByName(part.withColumn("end_line", null), allowMissingColumns=True)
    for name, (_, severity) in settings.thresholds.items():
        found = found.withColumn("severity", F.when(F.col("rule_id") == name, severity).otherwise(F.col("severity")))
    found = O.deduped(O.identified(found.filter(settings.enabled())))
    deltas = None
    if baseline is not None:
        deltas = O.baseline_deltas(found, baseline)
        found = O.not_in_baseline(found, baseline)
    marked = O.with_exclusion(found, settings.exclusions)
    problems = problems.unionByName(more).unionByName(broken)
    if lines is not None:
        blocks = exploded(rust, "blocks").select("file_path", "name", "start_line", "line_count", F.col("seq").alias("block_seq")) if scope == "symbol" else None
        flagged = O.with_changed(marked, lines, files, blocks)
        shown = flagged.filter("exclusion is null")
        deltas = O.patch_deltas(shown)
        problems = problems.unionByName(O.patch_diagnostic(shown, O.unanalysed(files, sources)))
        marked = flagged.filter("changed").drop("changed")
    return Scan(sources, marked.filter("exclusion is null").drop("exclusion"), marked.filter("exclusion is not null"), problems, ignored, deltas, settings, rust)


def _read(name: str) -> str:
    return sys.stdin.read() if name == "-" else open(name, encoding="utf-8").read()


def _listed(spark: SparkSession, wanted: str) -> int:
    """Prints the rule list or one rule's card; an unknown name is answered with the nearest ones."""
    cards = catalog.cards(spark)
    rows = cards.orderBy("rule_id").collect() if wanted == "rules" else cards.filter(F.col("rule_id") == wanted).collect()
    for r in rows:
        shown = f"{r['rule_id']}\t{r['pillar']}\t{r['severity']}\t{r['confidence']}\t{'' if r['threshold'] is None else r['threshold']}"
        print(shown if wanted == "rules" else f"{r['title']}\n{shown}\noptions: {', '.join(r['options']) or 'none'}\n{r['remediation']}")
    if not rows:
        near = [r["rule_id"] for r in catalog.suggestions(cards, wanted).collect()]
        print(f"no folder or rule {wanted!r}{'; did you mean ' + ', '.join(near) + '?' if near else ''}", file=sys.stderr)
    return 0 if rows else 2


def main(arguments: list[str] | None = None) -> int:
    """Prints a report in the wanted form; the exit code tells what was found. JSON, text, SARIF and workflow commands hold
    all findings and are streamed. Findings are persisted while the report is made."""
    parser = argparse.ArgumentParser(prog="lintlake")
    parser.add_argument("root", help="a folder, or `rules` to list the rules, or a rule's id for its card")
    parser.add_argument("paths", nargs="*", default=["."])
    parser.add_argument("--format", choices=["json", "text", "markdown", "github", "sarif", "hotspot"], default="json")
    parser.add_argument("--config")
    parser.add_argument("--patch", help="a unified diff, or - for standard input")
    parser.add_argument("--ranges", help="changed lines of every file, such as 3-5,9")
    parser.add_argument("--scope", choices=["hunk", "symbol"], default="hunk")
    parser.add_argument("--baseline", help="folder or document of a baseline, whose findings are left out")
    parser.add_argument("--write-baseline", help="folder for a baseline of what is found")
    parser.add_argument("--fail-on", choices=["none", "advisory", "warning", "error"])
    args = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("lintlake").getOrCreate()
    if not os.path.exists(args.root):
        return _listed(spark, args.root)
    settings = parse_settings(_read(args.config)) if args.config else Settings()
    baseline = read_baseline(spark, args.baseline) if args.baseline else None
    scan = analyse(spark, args.root, tuple(args.paths), settings, baseline, _read(args.patch) if args.patch else None, args.ranges, args.scope)
    scan.findings.persist()
    level = args.fail_on or settings.minimum_severity.get("analyse")
    if args.write_baseline:
        write_baseline(scan.findings, args.write_baseline)
    about = render.about(scan, args.root, args.format, level or "none", args.baseline)
    streamed = {
        "github": lambda: (f"{r[0]}\n" for r in render.github_commands(scan.findings).toLocalIterator()),
        "sarif": lambda: render.sarif_report(scan.findings, catalog.rules(spark), scan.suppressed, about["diagnostics"], settings.exclusions),
        "json": lambda: render.json_report(scan.findings, settings.unscored, about), "text": lambda: render.text_report(scan.findings, settings.unscored, about),
    }
    if args.format in streamed:
        sys.stdout.writelines(streamed[args.format]())
    else:
        print({"markdown": render.markdown, "hotspot": render.hotspot}[args.format](about | render.report(scan.findings, unscored=settings.unscored)))
    failures = [d for d in about["diagnostics"] if d["diagnostic_type"] not in render.NOTES]
    code = scoring.exit_code(scan.findings, len(failures), None if level == "none" else level)
    scan.close()
    return code


if __name__ == "__main__":
    sys.exit(main())
