"""Set operators on a findings table: identities, dedupe, baseline, exclusions, changed regions.

Findings have rule_id, message, file_path, line, end_line, severity, pillar, confidence, symbol and emit_seq, which
orders findings that are otherwise equal. All joins carry the file or the full key, so they stay equi joins.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.functions.columns import fingerprint, glob_regex, stable_identity

KEY = ["fingerprint", "rule_id", "file_path"]


def identified(findings: DataFrame) -> DataFrame:
    """Adds fingerprint and stable_identity."""
    return findings.withColumns({"fingerprint": fingerprint(), "stable_identity": stable_identity()})


def report_order() -> list[Column]:
    """Line (0 if none), rule, message, then order of emission; within a file."""
    return [F.coalesce("line", F.lit(0)), F.col("rule_id"), F.col("message"), F.col("emit_seq")]


def deduped(findings: DataFrame) -> DataFrame:
    """Drops a finding whose fingerprint equals that of the one before it in report order. One window per file."""
    before = F.lag("fingerprint").over(Window.partitionBy("file_path").orderBy(*report_order()))
    return findings.withColumn("_before", before).filter("_before is null or _before <> fingerprint").drop("_before")


def not_in_baseline(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings that the baseline doesn't list."""
    return findings.join(baseline.select(*KEY).distinct(), KEY, "left_anti")


def _net(counts: DataFrame) -> DataFrame:
    return counts.filter("introduced + removed > 0").withColumn("net", F.col("introduced") - F.col("removed"))


def baseline_deltas(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """rule_id, introduced, removed, net: by rule, findings that the baseline doesn't list and its entries that are gone.

    Both sides are counted by key in one shuffle of pre-aggregated rows, and then by rule.
    """
    sides = findings.select(*KEY, F.lit(1).alias("now"), F.lit(0).alias("before")).unionByName(baseline.select(*KEY, F.lit(0).alias("now"), F.lit(1).alias("before")))
    keys = sides.groupBy(*KEY).agg(F.sum("now").alias("now"), F.sum("before").alias("before"))
    zero = F.lit(0).cast("bigint")
    counted = keys.groupBy("rule_id").agg(
        F.sum(F.when(F.col("before") == 0, F.col("now")).otherwise(zero)).alias("introduced"), F.sum(F.when(F.col("now") == 0, F.col("before")).otherwise(zero)).alias("removed")
    )
    return _net(counted)


def baseline_entries(findings: DataFrame) -> DataFrame:
    """What a baseline file lists."""
    return findings.select("fingerprint", "rule_id", "file_path", "line", "symbol", "message")


@dataclass(frozen=True)
class Exclusion:
    """Rules (empty: all), path globs (empty: all) and a part of the message (none: any)."""

    rules: Sequence[str] = ()
    paths: Sequence[str] = ()
    message_contains: str | None = None
    reason: str = ""

    def matches(self) -> Column:
        """Whether a finding is excluded."""
        out = F.lit(True)
        if self.rules:
            out &= F.col("rule_id").isin(*self.rules)
        if self.paths:
            out &= F.col("file_path").rlike("|".join(f"(?:{glob_regex(p)})" for p in self.paths))
        if self.message_contains is not None:
            out &= F.col("message").contains(self.message_contains)
        return out


def with_exclusion(findings: DataFrame, exclusions: Sequence[Exclusion]) -> DataFrame:
    """Adds exclusion: the place of the first entry that matches, null if none does. No join and no shuffle."""
    first = F.lit(None).cast("int")
    for k in reversed(range(len(exclusions))):
        first = F.when(exclusions[k].matches(), k).otherwise(first)
    return findings.withColumn("exclusion", first)


def exclusion_counts(marked: DataFrame, exclusions: Sequence[Exclusion]) -> DataFrame:
    """exclusion, reason, suppressed for every entry, those that match nothing included."""
    listed = marked.sparkSession.createDataFrame([(k, x.reason) for k, x in enumerate(exclusions)], "exclusion int, reason string")
    counted = marked.filter("exclusion is not null").groupBy("exclusion").agg(F.count("*").alias("suppressed"))
    return listed.join(counted, "exclusion", "left").withColumn("suppressed", F.coalesce("suppressed", F.lit(0).cast("bigint")))


def with_changed(findings: DataFrame, changed_lines: DataFrame, changed_files: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """Adds changed: whether a finding lies in a changed file and has no line there, or the file is changed as a whole, or a
    changed line lies between its lines or, with `blocks`, in its smallest enclosing block.

    `changed_lines`: file_path, line. `changed_files`: file_path, whole_file. `blocks`: file_path, name, start_line,
    line_count, block_seq; blocks named by the finding's symbol go first. The lines and blocks of a file are arrays of one row,
    so findings meet them in one equi join on the file, and repeated findings all stay.
    """
    about = changed_files.groupBy("file_path").agg(F.max("whole_file").alias("_whole"))
    about = about.join(changed_lines.groupBy("file_path").agg(F.collect_set("line").alias("_lines")), "file_path", "left")
    low, high = F.col("line"), F.greatest("line", F.coalesce("end_line", "line"))
    touched = lambda a, z: F.coalesce(F.exists("_lines", lambda x: (x >= a) & (x <= z)), F.lit(False))
    held = touched(low, high)
    if blocks is not None:
        last = F.col("start_line") + F.col("line_count") - 1
        about = about.join(blocks.groupBy("file_path").agg(F.collect_list(F.struct("line_count", "block_seq", "start_line", last.alias("last"), "name")).alias("_blocks")), "file_path", "left")
        around = F.filter("_blocks", lambda b: (F.col("line") >= b["start_line"]) & (F.col("line") <= b["last"]))
        named = lambda b: F.col("symbol").isNull() | (F.col("symbol") == b["name"]) | F.col("symbol").endswith(F.concat(F.lit("."), b["name"]))
        best = F.array_min(F.transform(around, lambda b: F.struct((~named(b)).alias("other"), b["line_count"].alias("n"), b["block_seq"].alias("seq"), b["start_line"].alias("first"), b["last"].alias("last"))))
        held = held | touched(best["first"], best["last"])
    placed = F.col("_whole").isNotNull() & (F.col("_whole") | F.col("line").isNull() | held)
    return findings.join(about, "file_path", "left").withColumn("changed", F.coalesce(placed, F.lit(False))).select(*findings.columns, "changed")


def changed_only(findings: DataFrame, changed_lines: DataFrame, changed_files: DataFrame) -> DataFrame:
    """Findings in changed files that have no line, lie in a file changed as a whole, or cover a changed line."""
    return with_changed(findings, changed_lines, changed_files).filter("changed").drop("changed")


def changed_by_symbol(findings: DataFrame, blocks: DataFrame, changed_lines: DataFrame, changed_files: DataFrame) -> DataFrame:
    """As `changed_only`, and also findings whose smallest enclosing block holds a changed line."""
    return with_changed(findings, changed_lines, changed_files, blocks).filter("changed").drop("changed")


def patch_deltas(flagged: DataFrame) -> DataFrame:
    """rule_id, introduced, removed, net: by rule, findings that a patch keeps (`changed`) and suppresses, in one pass."""
    return _net(flagged.groupBy("rule_id").agg(F.count_if("changed").alias("introduced"), F.count_if(~F.col("changed")).alias("removed")))


def by_place(findings: DataFrame) -> DataFrame:
    """file_path, line, end_line, severity, n: findings of one place and severity as one row with their number, which is all that the totals of a patch need."""
    return findings.groupBy("file_path", "line", "end_line", "severity").agg(F.count("*").alias("n"))


def patch_totals(flagged: DataFrame) -> DataFrame:
    """One row: total, kept, suppressed, and by severity what is kept. A row with `n`, as `by_place` gives, counts so often."""
    n = F.col("n") if "n" in flagged.columns else F.lit(1)
    count = lambda held: F.coalesce(F.sum(F.when(held, n)), F.lit(0)).cast("bigint")
    of = lambda level: count(F.col("changed") & (F.col("severity") == level)).alias(level)
    return flagged.agg(count(F.lit(True)).alias("total"), count(F.col("changed")).alias("kept"), count(~F.col("changed")).alias("suppressed"), *map(of, ("error", "warning", "advisory")))


def patch_diagnostic(flagged: DataFrame, missing: DataFrame) -> DataFrame:
    """The diagnostic row of a patch: what it kept, and the files of the patch that were not analysed (`missing`)."""
    listed = missing.agg(F.array_join(F.array_sort(F.collect_set("file_path")), ", ").alias("files"))
    said = F.concat(F.lit("Patch filter kept "), "kept", F.lit(" of "), "total", F.lit(" findings; suppressed "), "suppressed", F.lit(" outside changed new-side lines."))
    rest = F.when(F.col("files") == "", " All patch files were analysed.").otherwise(F.concat(F.lit(" Patch files not analysed: "), "files", F.lit(".")))
    # One row on either side.
    both = patch_totals(flagged).withColumn("_k", F.lit(1)).join(listed.withColumn("_k", F.lit(1)), "_k")
    return both.select(F.lit("patch-filter").alias("diagnostic_type"), F.concat(said, rest).alias("message"), F.lit(None).cast("string").alias("file_path"))


def explicit_ranges(ranges: Sequence[tuple[int, int]], files: DataFrame) -> DataFrame:
    """Changed lines of the same ranges in every file."""
    spans = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ranges))
    lines = F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s.a, s.b))))
    return files.select("file_path", F.explode(lines).alias("line"))


def unanalysed(changed_files: DataFrame, sources: DataFrame) -> DataFrame:
    """Files of a patch that were not analysed. Paths are told apart before the join: sources may be findings, millions of which share a path."""
    return changed_files.select("file_path").subtract(sources.select("file_path").distinct())
