"""Registered queries of the set operators, aggregates and text rules, and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.functions import columns as C
from lintlake.operators import findings as O
from lintlake.operators import project as P
from lintlake.operators import scoring as S
from lintlake.operators import text_rules as T
from lintlake.plans import simulate as M
from lintlake.sources.settings import Settings

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

EXCLUSIONS = (
    O.Exclusion(rules=("rule-1", "rule-2"), paths=("src/f1*",), reason="generated"),
    O.Exclusion(message_contains="m3", paths=("src/f2*", "src/f3.rs"), reason="known"),
    O.Exclusion(rules=("rule-1", "rule-5"), reason="noise"),
    O.Exclusion(rules=("no-such-rule",), reason="stale"),
)
_EXCLUSION_SQL = """
marked AS (SELECT *, CASE
  WHEN rule_id IN ('rule-1', 'rule-2') AND regexp_matches(file_path, '^src/f1[^/]*$') THEN 0
  WHEN contains(message, 'm3') AND (regexp_matches(file_path, '^src/f2[^/]*$') OR file_path = 'src/f3.rs' OR starts_with(file_path, 'src/f3.rs/')) THEN 1
  WHEN rule_id IN ('rule-1', 'rule-5') THEN 2 WHEN rule_id = 'no-such-rule' THEN 3 END AS exclusion FROM findings)"""
_DEDUPE_SQL = """
deduped AS (SELECT * FROM (SELECT *, lag(fingerprint) OVER (PARTITION BY file_path ORDER BY coalesce(line, 0), rule_id, message, emit_seq) AS p FROM findings)
  WHERE p IS NULL OR p <> fingerprint)"""
_SCORED = "(VALUES " + ", ".join(f"('{p}')" for p in C.SCORED_PILLARS) + ") s(pillar)"
_PILLAR_SQL = f"""
pillars AS (SELECT coalesce(s.pillar, f.pillar) AS pillar, coalesce(f.findings, 0) AS findings, coalesce(f.penalty, 0.0::DOUBLE) AS penalty,
  greatest(0.0::DOUBLE, 100.0 - coalesce(f.penalty, 0.0::DOUBLE)) AS score, s.pillar IS NOT NULL AS scored FROM {_SCORED}
  FULL OUTER JOIN (SELECT pillar, count(*) AS findings, sum(CASE WHEN {{unscored}} THEN 0.0::DOUBLE ELSE penalty END) AS penalty FROM findings GROUP BY pillar) f ON s.pillar = f.pillar)"""
_GRADE = "CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END"


def _query(sql: str | None = None, *parts: str) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL after the common tables `parts`."""

    def add(f: Query) -> Query:
        name = f.__name__
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = f"WITH {', '.join(parts)} {sql}" if parts else sql
        return f

    return add


_F, _B, _CH, _BL, _I, _SRC = M.FINDINGS_SQL, M.BASELINE_SQL, M.CHANGED_SQL, M.BLOCKS_SQL, M.ITEMS_SQL, M.SOURCES_SQL


@_query("SELECT fingerprint, stable_identity, rule_id, file_path, line, symbol FROM findings", _F)
def identities(spark, sf_dir):
    """Fingerprints and stable identities."""
    return M.findings(spark, sf_dir).select("fingerprint", "stable_identity", "rule_id", "file_path", "line", "symbol")


@_query("SELECT fingerprint, rule_id, file_path, line, message, severity, pillar, confidence, symbol FROM deduped", _F, _DEDUPE_SQL)
def dedupe_adjacent(spark, sf_dir):
    """Sort and adjacent dedupe."""
    shown = ("fingerprint", "rule_id", "file_path", "line", "message", "severity", "pillar", "confidence", "symbol")
    return O.deduped(M.findings(spark, sf_dir)).select(*shown)


@_query("SELECT fingerprint, rule_id, file_path, line, message FROM findings f WHERE NOT EXISTS (SELECT 1 FROM baseline b WHERE b.fingerprint = f.fingerprint AND b.rule_id = f.rule_id AND b.file_path = f.file_path)", _F, _B)
def baseline_suppress(spark, sf_dir):
    """Findings that the baseline doesn't list."""
    return O.not_in_baseline(M.findings(spark, sf_dir), M.baseline(spark, sf_dir)).select("fingerprint", "rule_id", "file_path", "line", "message")


_DELTA_SQL = """
new AS (SELECT rule_id, count(*) AS n FROM findings f WHERE NOT EXISTS (SELECT 1 FROM baseline b WHERE b.fingerprint = f.fingerprint AND b.rule_id = f.rule_id AND b.file_path = f.file_path) GROUP BY 1),
old AS (SELECT rule_id, count(*) AS n FROM baseline b WHERE NOT EXISTS (SELECT 1 FROM findings f WHERE b.fingerprint = f.fingerprint AND b.rule_id = f.rule_id AND b.file_path = f.file_path) GROUP BY 1),
deltas AS (SELECT coalesce(new.rule_id, old.rule_id) AS rule_id, coalesce(new.n, 0) AS introduced, coalesce(old.n, 0) AS removed, coalesce(new.n, 0) - coalesce(old.n, 0) AS net FROM new FULL OUTER JOIN old ON new.rule_id = old.rule_id)"""


@_query("SELECT * FROM deltas", _F, _B, _DELTA_SQL)
def rule_deltas(spark, sf_dir):
    """Introduced, removed and net by rule."""
    return O.baseline_deltas(M.findings(spark, sf_dir), M.baseline(spark, sf_dir))


@_query("SELECT direction, place, rule_id, net FROM (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY abs(net) DESC, rule_id) AS place FROM (SELECT *, CASE WHEN net < 0 THEN 'improved' ELSE 'regressed' END AS direction FROM deltas WHERE net <> 0)) WHERE place <= 5", _F, _B, _DELTA_SQL)
def rule_movers(spark, sf_dir):
    """The rules that moved most."""
    return S.movers(O.baseline_deltas(M.findings(spark, sf_dir), M.baseline(spark, sf_dir)))


@_query("SELECT fingerprint, rule_id, file_path, line, symbol, message FROM findings", _F)
def baseline_entries(spark, sf_dir):
    """Rows of a generated baseline."""
    return O.baseline_entries(M.findings(spark, sf_dir))


@_query("SELECT rule_id, file_path, message, line, exclusion FROM marked", _F, _EXCLUSION_SQL)
def exclude_first_match(spark, sf_dir):
    """The first exclusion that matches each finding."""
    return O.with_exclusion(M.findings(spark, sf_dir), EXCLUSIONS).select("rule_id", "file_path", "message", "line", "exclusion")


@_query("SELECT e.exclusion, e.reason, count(m.exclusion) AS suppressed FROM (VALUES (0, 'generated'), (1, 'known'), (2, 'noise'), (3, 'stale')) e(exclusion, reason) LEFT JOIN marked m ON m.exclusion = e.exclusion GROUP BY 1, 2", _F, _EXCLUSION_SQL)
def exclude_summary(spark, sf_dir):
    """Suppressed findings by exclusion, zeros included."""
    return O.exclusion_counts(O.with_exclusion(M.findings(spark, sf_dir), EXCLUSIONS), EXCLUSIONS)


@_query("SELECT count(*) AS suppressed FROM marked WHERE exclusion IS NOT NULL", _F, _EXCLUSION_SQL)
def suppressed_total(spark, sf_dir):
    """Findings that any exclusion suppresses."""
    marked = O.with_exclusion(M.findings(spark, sf_dir), EXCLUSIONS)
    return O.exclusion_counts(marked, EXCLUSIONS).agg(F.sum("suppressed").alias("suppressed"))


_DIRECT_SQL = """
direct AS (SELECT f.* FROM findings f JOIN changed_files c ON f.file_path = c.file_path WHERE c.whole_file OR f.line IS NULL
  OR EXISTS (SELECT 1 FROM changed_lines l WHERE l.file_path = f.file_path AND l.line = f.line))"""


@_query("SELECT fingerprint, rule_id, file_path, line, message FROM direct", _F, _CH, _DIRECT_SQL)
def diff_hunk(spark, sf_dir):
    """Findings on changed lines."""
    kept = O.changed_only(M.findings(spark, sf_dir), M.changed_lines(spark, sf_dir), M.changed_files(spark, sf_dir))
    return kept.select("fingerprint", "rule_id", "file_path", "line", "message")


@_query("""SELECT fingerprint, rule_id, file_path, line, symbol FROM direct UNION ALL
SELECT fingerprint, rule_id, file_path, line, symbol FROM (SELECT r.*, b.start_line, b.line_count, row_number() OVER (PARTITION BY r.n ORDER BY (r.symbol IS NOT NULL AND (r.symbol = b.name OR ends_with(r.symbol, '.' || b.name))) DESC, b.line_count, b.block_seq) AS k
  FROM (SELECT *, row_number() OVER () AS n FROM findings f WHERE line IS NOT NULL AND EXISTS (SELECT 1 FROM changed_files c WHERE c.file_path = f.file_path)
    AND NOT EXISTS (SELECT 1 FROM changed_files c WHERE c.file_path = f.file_path AND c.whole_file) AND NOT EXISTS (SELECT 1 FROM changed_lines l WHERE l.file_path = f.file_path AND l.line = f.line)) r
  JOIN blocks b ON b.file_path = r.file_path AND r.line BETWEEN b.start_line AND b.start_line + b.line_count - 1) x
WHERE k = 1 AND EXISTS (SELECT 1 FROM changed_lines l WHERE l.file_path = x.file_path AND l.line BETWEEN x.start_line AND x.start_line + x.line_count - 1)""", _F, _CH, _BL, _DIRECT_SQL)
def diff_symbol(spark, sf_dir):
    """Findings on changed lines or in changed blocks."""
    found = M.findings(spark, sf_dir)
    kept = O.changed_by_symbol(found, M.blocks(spark, sf_dir), M.changed_lines(spark, sf_dir), M.changed_files(spark, sf_dir))
    return kept.select("fingerprint", "rule_id", "file_path", "line", "symbol")


@_query("SELECT file_path, line FROM (SELECT DISTINCT file_path FROM findings), (SELECT i AS line FROM range(3, 6) a(i) UNION SELECT i FROM range(5, 9) b(i) UNION SELECT 20)", _F)
def changed_ranges(spark, sf_dir):
    """Explicit ranges, for every file."""
    return O.explicit_ranges([(3, 5), (5, 8), (20, 20)], M.findings(spark, sf_dir).select("file_path").distinct())


@_query("SELECT file_path FROM changed_files EXCEPT SELECT file_path FROM findings", _F, _CH)
def changed_files_except(spark, sf_dir):
    """Files of the patch that were not analysed."""
    return O.unanalysed(M.changed_files(spark, sf_dir), M.findings(spark, sf_dir))


@_query("SELECT count(*) FILTER (severity = 'advisory') AS advisory, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'error') AS error, count(*) AS total FROM findings", _F)
def severity_summary(spark, sf_dir):
    """Counts by severity."""
    return S.severity_summary(M.findings(spark, sf_dir))


@_query("SELECT * FROM pillars", _F, _PILLAR_SQL.format(unscored="false"))
def pillar_scores(spark, sf_dir):
    """Pillar scores of all files."""
    return S.pillar_scores(M.findings(spark, sf_dir))


@_query("SELECT * FROM pillars", _F, _PILLAR_SQL.format(unscored="rule_id IN ('rule-3', 'rule-7', 'rule-11')"))
def exclude_from_score(spark, sf_dir):
    """Pillar scores without the penalty of three rules."""
    return S.pillar_scores(M.findings(spark, sf_dir), ("rule-3", "rule-7", "rule-11"))


@_query(f"SELECT score, {_GRADE} AS grade FROM (SELECT avg(score) AS score FROM pillars WHERE scored)", _F, _PILLAR_SQL.format(unscored="false"))
def composite_grade(spark, sf_dir):
    """Composite score and grade of all files."""
    return S.composite(S.pillar_scores(M.findings(spark, sf_dir)))


@_query(f"SELECT *, {_GRADE} AS grade FROM (SELECT file_path, pillar, count(*) AS findings, sum(penalty) AS penalty, greatest(0.0::DOUBLE, 100.0 - sum(penalty)) AS score FROM findings GROUP BY ALL)", _F)
def file_pillar_scores(spark, sf_dir):
    """Scores of every file's pillars, of which fewer floor at 0 than of the whole table's."""
    return S.file_pillar_scores(M.findings(spark, sf_dir))


@_query("SELECT file_path, count(*) AS findings, sum(penalty) AS penalty, greatest(0.0::DOUBLE, 100.0 - sum(penalty)) AS score FROM findings GROUP BY 1 ORDER BY score, findings DESC, file_path LIMIT 10", _F)
def top_files(spark, sf_dir):
    """The ten worst files."""
    return S.top_files(M.findings(spark, sf_dir))


@_query("SELECT rule_id, count(*) AS findings, first(severity ORDER BY file_path, coalesce(line, 0), message, emit_seq) AS severity FROM findings GROUP BY 1 ORDER BY findings DESC, rule_id LIMIT 10", _F)
def top_rules(spark, sf_dir):
    """The ten most frequent rules."""
    return S.top_rules(M.findings(spark, sf_dir))


@_query(f"SELECT p.pillar, p.findings, coalesce(advisory, 0) AS advisory, coalesce(warning, 0) AS warning, coalesce(error, 0) AS error, score, {_GRADE} AS grade, scored AS applicable FROM pillars p LEFT JOIN (SELECT pillar, count(*) FILTER (severity = 'advisory') AS advisory, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'error') AS error FROM findings GROUP BY 1) c ON p.pillar = c.pillar", _F, _PILLAR_SQL.format(unscored="false"))
def pillar_digest(spark, sf_dir):
    """Digest by pillar."""
    return S.pillar_digest(M.findings(spark, sf_dir))


@_query("SELECT b.bucket, count(f.complexity) AS findings FROM (SELECT i::INT AS bucket FROM range(5) r(i)) b LEFT JOIN findings f ON f.rule_id = 'complexity.cyclomatic' AND b.bucket = CASE WHEN complexity <= 5 THEN 0 WHEN complexity <= 10 THEN 1 WHEN complexity <= 15 THEN 2 WHEN complexity <= 20 THEN 3 ELSE 4 END GROUP BY 1", _F)
def complexity_histogram(spark, sf_dir):
    """Histogram of cyclomatic complexity."""
    return S.complexity_histogram(M.findings(spark, sf_dir))


@_query("SELECT count(*) AS blocking, count(DISTINCT pillar) AS pillars FROM findings WHERE severity IN ('warning', 'error')", _F)
def verdict(spark, sf_dir):
    """Blocking findings and their pillars."""
    return S.verdict(M.findings(spark, sf_dir))


@_query("SELECT event_id AS seq, ts AS recorded_at, value AS score FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def history_tail(spark, sf_dir):
    """The last hundred runs."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id as seq", "ts as recorded_at", "value as score")
    return S.history_tail(rows)


@_query("SELECT fingerprint, rule_id, severity FROM findings WHERE (rule_id LIKE 'rule-1%' OR pillar = 'security') AND rule_id <> 'rule-13' AND severity IN ('warning', 'error')", _F)
def selector_enable(spark, sf_dir):
    """Findings of selected rules at or over a severity."""
    found = M.findings(spark, sf_dir)
    wanted = found.filter(F.col("rule_id").startswith("rule-1")).select("rule_id").distinct()
    settings = Settings(select=tuple(r["rule_id"] for r in wanted.collect()), ignore=("rule-13",))  # at most as many as there are rules
    chosen = settings.enabled() | ((F.col("pillar") == "security") & Settings(ignore=("rule-13",)).enabled())
    return found.filter(chosen & (C.severity_rank(F.col("severity")) >= 1)).select("fingerprint", "rule_id", "severity")


@_query("SELECT file_path, module_path, count(*) AS items, min(line) AS line FROM items WHERE NOT cfg_gated AND NOT test_context GROUP BY 1, 2 HAVING count(*) > 25", _I)
def large_module(spark, sf_dir):
    """Modules with many items."""
    return P.large_modules(M.items(spark, sf_dir))


@_query("SELECT file_path, module_path, count(*) AS items, min(line) AS line FROM items WHERE NOT cfg_gated AND NOT test_context AND public AND kind <> 'method' GROUP BY 1, 2 HAVING count(*) > 8", _I)
def public_surface(spark, sf_dir):
    """Modules with many public items."""
    return P.public_surface(M.items(spark, sf_dir), 8)


@_query("SELECT file_path, count(*) AS declared, min(line) AS line FROM items WHERE NOT cfg_gated GROUP BY 1 HAVING count(*) > 70", _I)
def module_fan_out(spark, sf_dir):
    """Files that declare many modules."""
    return P.module_fan_out(M.items(spark, sf_dir), 70)


@_query("SELECT p_brand AS name, list_sort(list(DISTINCT 'v' || (p_size % 7)))::VARCHAR AS versions, min(p_size) AS line FROM part GROUP BY 1 HAVING count(DISTINCT p_size % 7) > 2")
def duplicate_versions(spark, sf_dir):
    """Packages locked in many versions."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    packages = rows.selectExpr("p_brand as name", "concat('v', p_size % 7) as version", "p_size as line")
    found = P.duplicate_versions(packages)
    return found.withColumn("versions", F.concat(F.lit("["), F.array_join("versions", ", "), F.lit("]")))


@_query("SELECT word AS identifier, count(*) AS n FROM (SELECT unnest(regexp_extract_all(content, '[A-Za-z_][A-Za-z0-9_]*')) AS word FROM sources) GROUP BY 1", _SRC)
def identifier_counts(spark, sf_dir):
    """Identifiers of all texts."""
    return P.identifier_counts(M.sources(spark, sf_dir))


@_query("SELECT name, file_path, n FROM items i LEFT JOIN (SELECT p_partkey % 450 AS k, count(*) AS n FROM part GROUP BY 1) c ON i.name = 'n' || c.k WHERE NOT public AND NOT cfg_gated AND NOT test_context AND kind <> 'method' AND coalesce(n, 0) <= 1", _I)
def unused_items(spark, sf_dir):
    """Private items whose name hardly occurs."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    counts = rows.groupBy(F.expr("concat('n', p_partkey % 450)").alias("identifier")).agg(F.count("*").alias("n"))
    return P.unused_items(M.items(spark, sf_dir), counts).select("name", "file_path", "n")


@_query("""SELECT CASE severity WHEN 'error' THEN '::error' WHEN 'warning' THEN '::warning' ELSE '::notice' END || ' file=' || file_path || CASE WHEN line IS NULL THEN '' ELSE ',line=' || line END || ',title=' || rule_id || '::' || message AS command FROM findings""", _F)
def github_annotations(spark, sf_dir):
    """Workflow commands."""
    from lintlake.plans.render import github_commands

    return github_commands(M.findings(spark, sf_dir))


@_query("SELECT file_path, len(string_split(content, chr(10))) - (ends_with(content, chr(10)) OR content = '')::INT AS lines FROM sources WHERE lines > 50", _SRC)
def file_length(spark, sf_dir):
    """Texts of over fifty lines."""
    return T.file_length(M.sources(spark, sf_dir), 50)


@_query(r"""SELECT file_path, sum(len(regexp_extract_all(content, '(?i)(password|passwd|secret|token|api_?key)["'']?\s*[:=]\s*["'']?[A-Za-z0-9+/_.=-]{8,}'))) AS hits FROM sources GROUP BY 1 HAVING hits > 0""", _SRC)
def env_value(spark, sf_dir):
    """Assignments that look like secrets."""
    return T.assignment_hits(M.sources(spark, sf_dir))


@_query(r"""SELECT file_path, k - 1 AS match_index, m AS matched FROM (SELECT file_path, unnest(l) AS m, generate_subscripts(l, 1) AS k FROM (SELECT file_path, regexp_extract_all(content, '[A-Za-z0-9._]+@[A-Za-z0-9]+\.[A-Za-z.]+') AS l FROM sources) WHERE len(l) > 0)""", _SRC)
def custom_regex(spark, sf_dir):
    """Every match of a user's pattern."""
    found = T.custom_matches(M.sources(spark, sf_dir), r"[A-Za-z0-9._]+@[A-Za-z0-9]+\.[A-Za-z.]+")
    return found.select("file_path", "match_index", "matched")


@_query("SELECT p_name AS rule_id, levenshtein(p_name, 'part 12') AS distance FROM part WHERE levenshtein(p_name, 'part 12') <= 12 ORDER BY distance, rule_id LIMIT 3")
def nearest_names(spark, sf_dir):
    """The names nearest to a mistyped one."""
    from lintlake.plans.catalog import suggestions

    names = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_name").alias("rule_id"))
    return suggestions(names, "part 12", most_edits=12)


@_query(r"""SELECT file_path, token, CASE WHEN length(token) <= 8 THEN repeat('*', length(token)) ELSE left(token, 4) || '...' || right(token, 4) END || ' (redacted, ' || length(token) || ' chars)' AS preview FROM (SELECT file_path, unnest(regexp_extract_all(content, '[A-Za-z0-9+/_-]{16,}')) AS token FROM sources) WHERE regexp_matches(token, '[0-9]')""", _SRC)
def redact_preview(spark, sf_dir):
    """Previews of long tokens with a digit."""
    found = T.custom_matches(M.sources(spark, sf_dir), "[A-Za-z0-9+/_-]{16,}").withColumnRenamed("matched", "token")
    return found.filter(F.col("token").rlike("[0-9]")).select("file_path", "token", C.redact(F.col("token")).alias("preview"))


@_query(r"""SELECT file_path, token, round(e, 9) AS bits FROM (SELECT *, (SELECT sum(-p * log2(p)) FROM (SELECT count(*) / length(token)::DOUBLE AS p FROM (SELECT unnest(string_split(token, '')) AS ch) GROUP BY ch)) AS e FROM (SELECT file_path, unnest(regexp_extract_all(content, '[A-Za-z0-9+/_-]{24,}')) AS token FROM sources)) WHERE e >= 3.0""", _SRC)
def high_entropy(spark, sf_dir):
    """Long tokens of high entropy."""
    found = T.custom_matches(M.sources(spark, sf_dir), "[A-Za-z0-9+/_-]{24,}").withColumnRenamed("matched", "token")
    return found.withColumn("bits", C.entropy(F.col("token"))).filter("bits >= 3.0").select("file_path", "token", F.round("bits", 9).alias("bits"))


_LINES_SQL = "lines AS (SELECT file_path, unnest(l) AS text, generate_subscripts(l, 1) AS line FROM (SELECT file_path, string_split(content, chr(10)) AS l FROM sources WHERE content <> ''))"


@_query("SELECT file_path, line, text FROM (SELECT *, lag(text) OVER (PARTITION BY file_path ORDER BY line) AS before FROM lines) WHERE ends_with(before, '.') AND trim(text) NOT IN ('', '}') AND regexp_matches(before, '\\b(the|der)')", _SRC, _LINES_SQL)
def unreachable_lag(spark, sf_dir):
    """Lines after one that ends the flow; on prose, after a sentence that has an article."""
    return T.after_exit(T.lines(M.sources(spark, sf_dir)), r"\b(the|der)", ".")


@_query("SELECT file_path, line FROM (SELECT *, bool_or(contains(text, 'License')) OVER (PARTITION BY file_path ORDER BY line ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS near FROM lines) WHERE contains(text, 'the') AND near", _SRC, _LINES_SQL)
def line_window(spark, sf_dir):
    """Lines with a mark on them or up to three lines above."""
    found = T.lines(M.sources(spark, sf_dir))
    return T.near(found, F.col("text").contains("the"), F.col("text").contains("License"), 3).filter("near").select("file_path", "line")


@_query("SELECT file_path, word AS primitive, min(line) AS line FROM (SELECT file_path, line, unnest(regexp_extract_all(lower(text), '(that|der|que|les) ', 1)) AS word FROM lines) GROUP BY 1, 2", _SRC, _LINES_SQL)
def first_of_each(spark, sf_dir):
    """The first line of each word of a list in each text."""
    return T.first_of_each(T.lines(M.sources(spark, sf_dir)), "(that|der|que|les) ")


_FLAGGED_SQL = """
flagged AS (SELECT f.*, EXISTS (SELECT 1 FROM changed_files c WHERE c.file_path = f.file_path AND (c.whole_file OR f.line IS NULL OR EXISTS (
  SELECT 1 FROM changed_lines l WHERE l.file_path = f.file_path AND l.line = f.line))) AS changed FROM findings f)"""


def _flagged(spark, sf_dir):
    return O.with_changed(M.findings(spark, sf_dir), M.changed_lines(spark, sf_dir), M.changed_files(spark, sf_dir))


@_query("SELECT rule_id, count(*) FILTER (WHERE changed) AS introduced, count(*) FILTER (WHERE NOT changed) AS removed, count(*) FILTER (WHERE changed) - count(*) FILTER (WHERE NOT changed) AS net FROM flagged GROUP BY rule_id", _F, _CH, _FLAGGED_SQL)
def patch_deltas(spark, sf_dir):
    """By rule, findings that a patch keeps and suppresses."""
    return O.patch_deltas(_flagged(spark, sf_dir))


@_query(
    "SELECT 'patch-filter' AS diagnostic_type, 'Patch filter kept ' || k || ' of ' || n || ' findings; suppressed ' || (n - k) || ' outside changed new-side lines.' || CASE WHEN m IS NULL THEN ' All patch files were analysed.' "
    "ELSE ' Patch files not analysed: ' || m || '.' END AS message, CAST(NULL AS VARCHAR) AS file_path FROM (SELECT count(*) AS n, count(*) FILTER (WHERE changed) AS k FROM flagged), "
    "(SELECT string_agg(file_path, ', ' ORDER BY file_path) AS m FROM (SELECT file_path FROM changed_files EXCEPT SELECT file_path FROM findings))", _F, _CH, _FLAGGED_SQL,
)
def patch_diagnostic(spark, sf_dir):
    """What a patch kept, and which of its files were not analysed."""
    files, places = M.changed_files(spark, sf_dir), O.by_place(M.findings(spark, sf_dir))
    return O.patch_diagnostic(O.with_changed(places, M.changed_lines(spark, sf_dir), files), O.unanalysed(files, places))


@_query(
    "SELECT pillar, count(*) FILTER (WHERE changed) AS kept, count(*) FILTER (WHERE NOT changed) AS suppressed FROM flagged GROUP BY pillar", _F, _CH, _FLAGGED_SQL
)
def patch_pillars(spark, sf_dir):
    """By pillar, both sides of a patch in one pass."""
    flagged = _flagged(spark, sf_dir)
    return flagged.groupBy("pillar").agg(F.count_if("changed").alias("kept"), F.count_if(~F.col("changed")).alias("suppressed"))


@_query("""
WITH c AS (SELECT DISTINCT 'g' || (p_size % 10) || '.' || lower(split_part(p_type, ' ', 1)) AS rule_id, p_brand AS pillar FROM part),
s AS (SELECT DISTINCT unnest([p_brand, upper(p_brand), 'g' || (p_size % 12), 'g' || (p_size % 10) || '.*', 'g3.' || lower(split_part(p_type, ' ', 1))]) AS selector FROM part),
plain AS (SELECT selector, lower(regexp_replace(selector, '[^A-Za-z0-9]', '', 'g')) AS p FROM s),
m AS (SELECT selector, 0 AS rank, rule_id FROM s JOIN c ON selector = rule_id
  UNION ALL SELECT selector, 1, rule_id FROM plain JOIN c ON p = lower(regexp_replace(pillar, '[^A-Za-z0-9]', '', 'g'))
  UNION ALL SELECT selector, 2, rule_id FROM s JOIN c ON starts_with(rule_id, regexp_replace(selector, '\\.\\*$', '') || '.'))
SELECT s.selector, rank, rule_id FROM s LEFT JOIN (SELECT *, min(rank) OVER (PARTITION BY selector) AS least FROM m) m ON s.selector = m.selector AND rank = least""")
def selector_matches(spark, sf_dir):
    """Which rules selectors take, by the first kind of match; rules and selectors are made of the parts."""
    from lintlake.plans.catalog import selector_matches as matches

    rows = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("kind", F.lower(F.split("p_type", " ")[0]))
    catalogue = rows.selectExpr("concat('g', p_size % 10, '.', kind) as rule_id", "p_brand as pillar").distinct()
    selectors = rows.select(F.explode(F.expr("array(p_brand, upper(p_brand), concat('g', p_size % 12), concat('g', p_size % 10, '.*'), concat('g3.', kind))")).alias("selector")).distinct()
    return matches(catalogue, selectors)


@_query(r"""SELECT file_path, name, line, row_number() OVER (ORDER BY file_path, line, name) AS nth FROM (
  SELECT file_path, name, min(line) AS line FROM (SELECT file_path, line, unnest(regexp_extract_all(text, '\b([A-Za-z_][A-Za-z0-9_]*)\s*\.', 1)) AS name FROM (
    SELECT file_path, unnest(l) AS text, generate_subscripts(l, 1) AS line FROM (SELECT file_path, string_split(regexp_replace(content, '[^\x00-\x7F]', ' ', 'g'), chr(10)) AS l FROM sources)))
  WHERE name NOT IN ('if', 'for', 'while', 'match', 'loop', 'return', 'fn') GROUP BY 1, 2)""", _SRC)
def call_index(spark, sf_dir):
    """The names before a full stop in each text, which stands for a bracket, where each first stands, and its number in the order of all.

    Letters outside ASCII are blanks here, as engines differ on whether they bound a word.
    """
    plain = M.sources(spark, sf_dir).withColumn("content", F.regexp_replace("content", r"[^\x00-\x7F]", " "))
    return P.numbered(P.calls(plain, opens=r"\."), "file_path", "line", "name")


@_query("SELECT file_path, octet_length(encode(content)) AS bytes, row_number() OVER (ORDER BY file_path) AS nth FROM sources", _SRC)
def source_index(spark, sf_dir):
    """All texts with their bytes and numbers in the order of their paths."""
    return P.numbered(M.sources(spark, sf_dir).select("file_path", F.octet_length("content").alias("bytes")), "file_path")


@_query(r"""SELECT word AS identifier, count(*) AS n FROM (SELECT unnest(regexp_extract_all(content || ' ' || coalesce(array_to_string(regexp_extract_all(content, 'default="([A-Za-z_][A-Za-z0-9_:]*)"', 1), ' '), ''), '[A-Za-z_][A-Za-z0-9_]*')) AS word FROM (
  SELECT content || chr(10) || '#[serde(rename = "r", default="' || 'f' || (hash_of % 97) || '")]' AS content FROM (SELECT content, length(content) AS hash_of FROM sources WHERE content IS NOT NULL))) GROUP BY 1""", _SRC)
def reference_counts(spark, sf_dir):
    """Identifiers of all texts and, once more, those that only an attribute's value names."""
    sources = M.sources(spark, sf_dir).filter("content is not null")
    added = F.concat(F.col("content"), F.lit('\n#[serde(rename = "r", default="f'), (F.length("content") % 97).cast("string"), F.lit('")]'))
    referenced = sources.withColumn("content", added).withColumn("content", P.reference_source(F.col("content"), F.col("content")))
    return P.identifier_counts(referenced)
