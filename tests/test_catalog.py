"""The catalogue, thresholds, baselines and histories."""

import pytest

from lintlake.operators import findings as O
from lintlake.operators import rust_rules as R
from lintlake.plans import analyse, catalog, fixtures
from lintlake.sources import stored


def test_every_rule_is_listed(spark):
    ids = {r["rule_id"] for r in catalog.rules(spark).collect()}
    assert len(ids) == 79
    assert set(fixtures.CASES) <= ids and set(catalog.THRESHOLDS) <= ids


def test_suggestions(spark):
    near = catalog.suggestions(catalog.rules(spark), "size.file-lenght").collect()
    assert [(r["rule_id"], r["distance"]) for r in near] == [("size.file-length", 2)]


def test_thresholds():
    rule = next(r for r in R.BLOCK_RULES if r.id == "size.function-length")
    assert catalog.with_threshold(rule, 9.9, "error").when == "not test and line_count > 9 and not literal_body"
    with pytest.raises(ValueError, match="no threshold"):
        catalog.with_threshold(next(r for r in R.BLOCK_RULES if r.id == "design.god-function"), 1, "error")


def test_baseline_round_trip(spark, tmp_path):
    rows = [("r", "m", "a.rs", 1, None, "warning", "security", "high", None, 0), ("r", "m", "b.rs", None, None, "warning", "security", "high", "s", 1)]
    found = O.identified(spark.createDataFrame(rows, "rule_id string, message string, file_path string, line int, end_line int, severity string, pillar string, confidence string, symbol string, emit_seq bigint"))
    stored.write_baseline(found.filter("line = 1"), f"{tmp_path}/b")
    kept = O.not_in_baseline(found, stored.read_baseline(spark, f"{tmp_path}/b")).collect()
    assert [r["file_path"] for r in kept] == ["b.rs"]


def test_history_keeps_the_last(tmp_path):
    for k in range(5):
        got = stored.record_history(f"{tmp_path}/h.json", k, 1.0, keep=3)
    assert [r["findings"] for r in got] == [2, 3, 4]


def test_rule_list_and_cards(spark, capsys):
    assert analyse.main(["rules"]) == 0
    assert len(capsys.readouterr().out.splitlines()) == 79
    assert analyse.main(["naming.boolean-prefix"]) == 0
    out = capsys.readouterr().out
    assert "Boolean Prefix" in out and "predicatePrefixes" in out
    assert analyse.main(["naming.boolean-prefx"]) == 2
    assert "naming.boolean-prefix?" in capsys.readouterr().err
    cards = catalog.cards(spark)
    assert cards.filter("remediation is null or title = ''").count() == 0
    counts = spark.createDataFrame([("docs.stale-todo", 3), ("custom.x", 1)], "rule_id string, findings bigint")
    assert {r["rule_id"]: r["title"] for r in catalog.described(counts, cards).collect()} == {"docs.stale-todo": "Stale Todo", "custom.x": None}


def test_workflow_blocks(spark):
    flow = (
        "jobs:\n  a:\n    steps:\n      - run: |\n          echo ${{ github.event.a }}\n\n          echo ${{ github.event.b }}\n        env:\n          T: ${{ github.event.c }}\n"
        "      - run: echo ${{ github.event.d }}\n      - name: ${{ github.event.e }}\n        run: >\n         echo ${{ github.event.f }}\n      - uses: ${{ github.event.g }}\n"
    )
    sources = spark.createDataFrame([(".github/workflows/w.yml", flow), ("w.yml", flow)], "file_path string, content string")
    assert sorted(r["line"] for r in R.workflow_findings(sources).collect()) == [5, 7, 10, 13]


def test_lines_look_at_their_neighbours(spark):
    text = (
        "fn f() {\n    // SAFETY: the buffer is never shared\n    unsafe { a() }\n    unsafe { b() }\n    x();\n    y();\n    unsafe { c() }\n"
        "    Command::new(\"ls\")\n        .arg(given)\n        .spawn();\n    Command::new(\"ls\");\n    return;\n    z();\n}\n"
    )
    found = R.rust_findings(spark.createDataFrame([("a.rs", text)], "file_path string, content string"))
    got = sorted((r["rule_id"], r["line"]) for r in found.filter("rule_id in ('security.unsafe-block', 'security.process-command', 'waste.unreachable-code')").collect())
    assert got == [("security.process-command", 8), ("security.unsafe-block", 7), ("waste.unreachable-code", 13)]
