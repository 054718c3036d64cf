"""Rust sources written from the documents, one for each, and how often rules fire on them.

What a source holds follows from its document's id and length, so SQL can count the findings that the scanner, the node
table and the rules must make of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.operators.rust_rules import rust_findings
from lintlake.operators.rust_tables import parsed
from lintlake.sources.stored import written

RULES = (
    "size.parameter-count", "size.function-length", "naming.generic-function", "naming.short-variable", "docs.missing-public-doc", "complexity.cyclomatic", "performance.clone-in-loop",
    "concurrency.lock-across-await", "error-handling.public-unwrap", "security.path-traversal-candidate",
)


def document_sources(docs: DataFrame) -> DataFrame:
    """file_path and content: a function whose name, parameters, documentation and body follow from doc_id and the text's length."""
    text = """
        concat(
            if(doc_id % 3 = 0, '', concat('/// Text of ', coalesce(length(text), 0), ' characters.\n')),
            'pub ', if(doc_id % 7 = 0, 'async ', ''), 'fn ', if(doc_id % 4 = 0, 'process', concat('name_', doc_id)), '(',
            array_join(transform(if(doc_id % 9 = 0, cast(array() as array<bigint>), sequence(1, doc_id % 9)), k -> concat('part', k, ': &P<A, B>')), ', '), ')', if(doc_id % 5 = 0, ' -> Items', ''), ' {\n',
            if(doc_id % 5 = 0,
                concat('    [\n', repeat('        1,\n', rows), '    ]\n'),
                concat(
                    repeat('    if a && "if {".len() > 0 { }\n', cast(doc_id % 14 as int)), if(doc_id % 6 = 0, '    for a in b {\n        c.clone(); // d.clone()\n    }\n', ''),
                    if(doc_id % 7 = 0, concat('    let guard = m.lock();\n', if(doc_id % 2 = 0, '    drop(guard);\n', ''), '    go().await;\n'), ''),
                    if(doc_id % 8 = 0, '    let (ab, _) = pair;\n', ''), if(doc_id % 9 = 0, '    x.unwrap();\n', ''), if(doc_id % 10 = 1, '    base.join(&name);\n', ''),
                    if(doc_id % 10 = 2, '    validate_name(&name)?;\n    base.join(&name);\n', ''), repeat('    step();\n', rows))),
            '}\n')"""
    sized = docs.filter("doc_id is not null").withColumn("rows", F.expr("cast(coalesce(length(text), 0) % 80 as int)"))
    return sized.select(F.concat(F.lit("src/d"), "doc_id", F.lit(".rs")).alias("file_path"), F.expr(text).alias("content"))


def document_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rule_id, findings, first_file of the rules `RULES` on the sources of all documents."""
    sources = document_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    table = written(parsed(sources), "parsed")  # every group of rules reads some of its columns
    found = rust_findings(sources, table=table).filter(F.col("rule_id").isin(*RULES))
    return found.groupBy("rule_id").agg(F.count("*").alias("findings"), F.min("file_path").alias("first_file"))


_CASES = {
    "size.parameter-count": "doc_id % 9 > 5",
    "size.function-length": "doc_id % 5 <> 0 AND (doc_id % 3 <> 0)::INT + 2 + n + doc_id % 14 + 3 * (doc_id % 6 = 0)::INT + (doc_id % 7 = 0)::INT * (2 + (doc_id % 2 = 0)::INT) + (doc_id % 8 = 0)::INT + (doc_id % 9 = 0)::INT + (doc_id % 10 = 1)::INT + 2 * (doc_id % 10 = 2)::INT > 50",
    "naming.generic-function": "doc_id % 4 = 0",
    "naming.short-variable": "doc_id % 5 <> 0 AND doc_id % 8 = 0",
    "docs.missing-public-doc": "doc_id % 3 = 0",
    "complexity.cyclomatic": "doc_id % 5 <> 0 AND 1 + 2 * (doc_id % 14) + (doc_id % 6 = 0)::INT + (doc_id % 10 = 2)::INT > 10",
    "performance.clone-in-loop": "doc_id % 5 <> 0 AND doc_id % 6 = 0",
    "concurrency.lock-across-await": "doc_id % 5 <> 0 AND doc_id % 7 = 0 AND doc_id % 2 = 1",
    "error-handling.public-unwrap": "doc_id % 5 <> 0 AND doc_id % 9 = 0",
    "security.path-traversal-candidate": "doc_id % 10 = 1",
}
ORACLE_SQL = "WITH d AS (SELECT doc_id, coalesce(length(text), 0) % 80 AS n FROM documents WHERE doc_id IS NOT NULL) " + " UNION ALL ".join(
    f"SELECT '{rule}' AS rule_id, count(*) AS findings, min('src/d' || doc_id || '.rs') AS first_file FROM d WHERE {when} HAVING count(*) > 0" for rule, when in _CASES.items()
)
