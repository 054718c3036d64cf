"""Set operators and aggregates on small tables, and every registered query against DuckDB on the smallest data."""

import math
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lintlake.functions.columns import entropy, fingerprint, glob_regex, redact
from lintlake.operators import findings as O
from lintlake.operators import scoring as S
from lintlake.operators import text_rules as T
from lintlake.plans import derived, flagship, queries

DATA = "/root/testdata/sf0.001"
COLUMNS = "rule_id string, message string, file_path string, line int, end_line int, severity string, pillar string, confidence string, symbol string, emit_seq bigint"


def finding(rule="r", file="a.rs", line=1, seq=0, symbol=None, severity="warning", pillar="security", message="m"):
    return (rule, message, file, line, None, severity, pillar, "high", symbol, seq)


def table(spark, *rows):
    return O.identified(spark.createDataFrame(list(rows), COLUMNS))


# The formula's results for a rule, file, line and symbol.
GOLDEN = [
    ("docs.missing-public-doc", "fixtures/sample.rs", 1, "SampleAnalyzer", "33f9dd5201230832"),
    ("modernisation.public-field", "fixtures/sample.rs", 2, None, "bc7bce7d0361e8e7"),
    ("security.process-command", "fixtures/sample.rs", 11, None, "c83527501efb5e12"),
    ("sensitive-data.aws-access-key", "fixtures/sample.rs", 16, None, "1aae444024c630df"),
    ("test-quality.sleep-in-test", "fixtures/sample.rs", 23, "test_sleeps_without_assertion", "8e9591ae5cdf9beb"),
]


def test_fingerprints_are_the_known_ones(spark):
    rows = spark.createDataFrame([g[:4] for g in GOLDEN], "rule_id string, file_path string, line int, symbol string")
    assert [r[0] for r in rows.select(fingerprint()).collect()] == [g[4] for g in GOLDEN]


def test_only_adjacent_repeats_are_dropped(spark):
    rows = [finding(seq=1), finding(seq=2), finding(rule="x", seq=3), finding(line=None, seq=4), finding(line=0, seq=5)]
    assert sorted(r["emit_seq"] for r in O.deduped(table(spark, *rows)).collect()) == [1, 3, 4]


def test_first_exclusion_wins_and_zeros_are_listed(spark):
    rules = (O.Exclusion(rules=("r",), paths=("src/**",)), O.Exclusion(message_contains="m"), O.Exclusion(rules=("none",)))
    marked = O.with_exclusion(table(spark, finding(file="src/a.rs"), finding(file="b.rs"), finding(file="c.rs", message="z")), rules)
    assert [r["exclusion"] for r in marked.orderBy("file_path").collect()] == [1, None, 0]
    assert [r["suppressed"] for r in O.exclusion_counts(marked, rules).orderBy("exclusion").collect()] == [1, 1, 0]


def test_changed_regions(spark):
    found = table(spark, finding(line=1, seq=1), finding(line=7, seq=2, symbol="f"), finding(line=None, seq=3), finding(file="z.rs", seq=4))
    lines = spark.createDataFrame([("a.rs", 1), ("a.rs", 9)], "file_path string, line int")
    files = spark.createDataFrame([("a.rs", False)], "file_path string, whole_file boolean")
    blocks = spark.createDataFrame([("a.rs", "f", 6, 5, 0), ("a.rs", "g", 7, 1, 1)], "file_path string, name string, start_line int, line_count int, block_seq int")
    assert sorted(r["emit_seq"] for r in O.changed_only(found, lines, files).collect()) == [1, 3]
    assert sorted(r["emit_seq"] for r in O.changed_by_symbol(found, blocks, lines, files).collect()) == [1, 2, 3]


def test_scores_of_nothing_are_full(spark):
    scores = S.pillar_scores(table(spark, finding()).filter("false"))
    assert scores.count() == 11
    assert S.composite(scores).first().asDict() == {"score": 100.0, "grade": "A"}


def test_exit_codes(spark):
    found = table(spark, finding())
    assert [S.exit_code(found, 1, None), S.exit_code(found, 0, "error"), S.exit_code(found, 0, "warning")] == [2, 0, 1]


@pytest.mark.parametrize(("glob", "path", "fits"), [("src/**", "src/a/b.rs", True), ("**/x.rs", "x.rs", True), ("src/*.rs", "src/a/b.rs", False), ("src", "src/a", True), ("src", "srcs", False)])
def test_globs(glob, path, fits):
    import re

    assert bool(re.search(glob_regex(glob), path)) is fits


def test_scalars(spark):
    row = spark.sql("select 'abcdefghij' as a, 'aab' as c").select(redact(F.col("a")).alias("a"), entropy(F.col("c")).alias("c")).first()
    assert row["a"] == "abcd...ghij (redacted, 10 chars)"
    assert math.isclose(row["c"], 0.9182958340544896)


def test_lines_have_no_extra_last_one(spark):
    rows = spark.createDataFrame([("a", "x\ny\n"), ("b", "x"), ("c", "")], "file_path string, content string")
    assert {r["file_path"]: r["lines"] for r in T.file_length(rows, -1).collect()} == {"a": 2, "b": 1, "c": 0}


def plain(value):
    if value is None or value is pd.NA or value != value:
        return None
    value = value.item() if hasattr(value, "item") else value
    if isinstance(value, float):
        return int(value) if value == int(value) else round(value, 9)
    return value if isinstance(value, (int, str)) else str(value)


def rows_of(frame):
    return sorted((tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    got, wanted = queries.QUERIES[name](spark, DATA).toPandas(), db.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert rows_of(got) == rows_of(wanted)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_flagship(spark):
    assert flagship.documents_score(spark, DATA).count() == 11


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_scores_over_all_findings(spark):
    total = queries.QUERIES["identities"](spark, DATA).count()
    assert queries.QUERIES["pillar_scores"](spark, DATA).agg(F.sum("findings")).first()[0] == total


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_rules_on_sources_of_documents_keep_nothing_in_memory(spark):
    """The parsed sources are many times the documents, so they are written and not kept by executors."""
    kept = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    before, db = kept(), duckdb.connect()
    db.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    got = derived.document_rules(spark, DATA).toPandas()
    assert kept() == before
    assert rows_of(got) == rows_of(db.execute(derived.ORACLE_SQL).df())


def test_paths_of_findings_are_told_apart_before_the_join(spark):
    """A path that millions of findings share is one row of the join, and null paths match as in EXCEPT."""
    files = spark.createDataFrame([("a.rs", False), ("a.rs", True), ("b.rs", False), (None, False)], "file_path string, whole_file boolean")
    found = spark.range(50_000).selectExpr("if(id % 3 = 0, null, 'b.rs') as file_path")
    missing = O.unanalysed(files, found)
    assert [r["file_path"] for r in missing.collect()] == ["a.rs"]
    assert missing._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 2


def test_totals_of_a_patch_from_counted_places(spark):
    found = table(spark, finding(seq=1), finding(seq=2, rule="x"), finding(line=7, seq=3, severity="error"), finding(line=None, seq=4), finding(file="z.rs", seq=5))
    lines = spark.createDataFrame([("a.rs", 1)], "file_path string, line int")
    files = spark.createDataFrame([("a.rs", False)], "file_path string, whole_file boolean")
    places = O.by_place(found)
    assert sorted(r["n"] for r in places.collect()) == [1, 1, 1, 2]
    one, many = (O.patch_totals(O.with_changed(x, lines, files)).first().asDict() for x in (places, found))
    assert one == many == {"total": 5, "kept": 3, "suppressed": 2, "error": 0, "warning": 3, "advisory": 0}
    assert O.patch_totals(O.with_changed(places.filter("false"), lines, files)).first()["total"] == 0
