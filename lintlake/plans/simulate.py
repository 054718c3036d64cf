"""Findings and their surroundings as deterministic projections of the benchmark tables, for queries at scale.

The tables hold no source code, so these queries exercise the set operators and aggregates, not the rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.functions.columns import SCORED_PILLARS
from lintlake.operators.findings import identified

PILLARS = (*SCORED_PILLARS, "waste")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One finding for each line item. `emit_seq` is total over everything that a finding shows."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    flag = "case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end"
    pillars = ", ".join(f"'{p}'" for p in PILLARS)
    shown = rows.selectExpr(
        "case when l_partkey % 79 = 0 then 'complexity.cyclomatic' else concat('rule-', l_partkey % 79) end as rule_id",
        "concat('m', cast(l_quantity as int) % 5) as message",
        "concat('src/f', l_orderkey % 500, '.rs') as file_path",
        "case when l_suppkey % 11 = 0 then null else l_linenumber * 4 end as line",
        "cast(null as int) as end_line",
        f"element_at(array('advisory', 'warning', 'error'), {flag} + 1) as severity",
        f"element_at(array({pillars}), cast(l_suppkey % 12 as int) + 1) as pillar",
        "element_at(array('low', 'medium', 'high'), l_linenumber % 3 + 1) as confidence",
        "case when l_partkey % 3 = 0 then null else concat('s', l_partkey % 13) end as symbol",
        "concat('{\"complexity\": ', l_linenumber * 4, '}') as metadata",
        f"((l_suppkey * 3 + {flag}) * 39 + l_partkey % 39) * 8 + l_linenumber as emit_seq",
    )
    return identified(shown)


#: DuckDB's form of `findings`.
FINDINGS_SQL = f"""
shown AS (SELECT
  CASE WHEN l_partkey % 79 = 0 THEN 'complexity.cyclomatic' ELSE 'rule-' || (l_partkey % 79) END AS rule_id,
  'm' || (CAST(trunc(l_quantity) AS INT) % 5) AS message,
  'src/f' || (l_orderkey % 500) || '.rs' AS file_path,
  CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE l_linenumber * 4 END AS line,
  CASE l_returnflag WHEN 'A' THEN 'advisory' WHEN 'N' THEN 'warning' ELSE 'error' END AS severity,
  ([{", ".join(f"'{p}'" for p in PILLARS)}])[l_suppkey % 12 + 1] AS pillar,
  (['low', 'medium', 'high'])[l_linenumber % 3 + 1] AS confidence,
  CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE 's' || (l_partkey % 13) END AS symbol,
  l_linenumber * 4 AS complexity,
  ((l_suppkey * 3 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END) * 39 + l_partkey % 39) * 8 + l_linenumber AS emit_seq
  FROM lineitem),
findings AS (SELECT *,
  substr(sha256(rule_id || chr(0) || file_path || chr(0) || coalesce(line, 0) || chr(0) || coalesce(symbol, '')), 1, 16) AS fingerprint,
  substr(sha256(rule_id || chr(0) || file_path || chr(0) || coalesce(symbol, message)), 1, 16) AS stable_identity,
  (CASE severity WHEN 'advisory' THEN 1.5::DOUBLE WHEN 'warning' THEN 4 ELSE 8 END) * (CASE confidence WHEN 'low' THEN 0.5::DOUBLE WHEN 'medium' THEN 0.75 ELSE 1 END) AS penalty
  FROM shown)"""


def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of one rule in three, and entries of files that are gone."""
    found = findings(spark, sf_dir).filter("emit_seq % 3 = 0")
    gone = found.filter("emit_seq % 21 = 0").withColumn("file_path", F.concat(F.lit("gone/"), "file_path"))
    return found.unionByName(gone).select("fingerprint", "rule_id", "file_path", "line", "symbol", "message")


BASELINE_SQL = """
baseline AS (SELECT fingerprint, rule_id, file_path FROM findings WHERE emit_seq % 3 = 0
  UNION ALL SELECT fingerprint, rule_id, 'gone/' || file_path FROM findings WHERE emit_seq % 21 = 0)"""


def changed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_path, line from the orders."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return rows.selectExpr("concat('src/f', o_orderkey % 700, '.rs') as file_path", "cast(o_custkey % 30 as int) as line").filter("line % 7 = 0").distinct()


def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_path, whole_file."""
    lines = changed_lines(spark, sf_dir).groupBy("file_path").agg(F.lit(False).alias("whole_file"))
    whole = spark.range(0, 700, 50).selectExpr("concat('src/f', id, '.rs') as file_path", "true as whole_file")
    return lines.unionByName(whole)


CHANGED_SQL = """
changed_lines AS (SELECT DISTINCT 'src/f' || (o_orderkey % 700) || '.rs' AS file_path, o_custkey % 30 AS line FROM orders WHERE o_custkey % 30 % 7 = 0),
changed_files AS (SELECT file_path, bool_or(whole) AS whole_file FROM (
  SELECT file_path, false AS whole FROM changed_lines UNION ALL SELECT 'src/f' || i || '.rs', true FROM range(0, 700, 50) r(i)) GROUP BY file_path)"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two function blocks in each file, one inside the other."""
    files = findings(spark, sf_dir).select("file_path").distinct()
    parts = "inline(array(struct(0 as block_seq, 's1' as name, 2 as start_line, 30 as line_count), struct(1 as block_seq, 's2' as name, 4 as start_line, 6 as line_count), struct(2 as block_seq, 'other' as name, 12 as start_line, 9 as line_count)))"
    return files.selectExpr("file_path", parts)


BLOCKS_SQL = """
blocks AS (SELECT file_path, block_seq, name, start_line, line_count FROM (SELECT DISTINCT file_path FROM findings),
  (VALUES (0, 's1', 2, 30), (1, 's2', 4, 6), (2, 'other', 12, 9)) b(block_seq, name, start_line, line_count))"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a project from the parts."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    return rows.selectExpr(
        "concat('src/', p_brand, '.rs') as file_path", "concat('m', p_size % 3) as module_path", "concat('n', p_partkey % 900) as name",
        "element_at(array('function', 'struct', 'enum', 'trait', 'method'), cast(p_partkey % 5 as int) + 1) as kind",
        "p_size as line", "p_partkey % 2 = 0 as public", "p_partkey % 17 = 0 as cfg_gated", "p_partkey % 19 = 0 as test_context",
    )


ITEMS_SQL = """
items AS (SELECT 'src/' || p_brand || '.rs' AS file_path, 'm' || (p_size % 3) AS module_path, 'n' || (p_partkey % 900) AS name,
  (['function', 'struct', 'enum', 'trait', 'method'])[p_partkey % 5 + 1] AS kind, p_size AS line, p_partkey % 2 = 0 AS public,
  p_partkey % 17 = 0 AS cfg_gated, p_partkey % 19 = 0 AS test_context FROM part)"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as text files: display_path, content."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return rows.select(F.concat(F.col("source"), F.lit("/"), "doc_id", F.lit(".txt")).alias("file_path"), F.col("text").alias("content"))


SOURCES_SQL = "sources AS (SELECT source || '/' || doc_id || '.txt' AS file_path, text AS content FROM documents)"
