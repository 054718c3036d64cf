"""The node table against trees written by hand, and the rules that read it against expected rows."""

import pyarrow as pa
import pytest

from lintlake.functions.rust_source import Scan, byte_masks, comment_scope, loop_code, masked
from lintlake.operators import rust_facts as facts
from lintlake.operators import rust_tables
from lintlake.operators.rust_rules import BLOCK_RULES, NameOptions, rust_findings
from lintlake.operators.rust_tables import exploded, parsed


def tree(text):
    """Kinds and names of the nodes, each with its depth."""
    nodes = Scan(text).nodes
    depth = {-1: -1}
    for n in nodes:
        depth[n["node"]] = depth[n["parent"]] + 1
    return [(depth[n["node"]], n["kind"], n["text"]) for n in nodes]


TREES = {
    "fn f(a: u8, (b, _): (u8, M<A, B>)) {}": [(0, "fn", "f"), (1, "param", ""), (2, "binding", "a"), (1, "param", ""), (2, "binding", "b"), (1, "block", "")],
    "fn f() { let Point { ab, cd: ef } = go()?; }": [(0, "fn", "f"), (1, "block", ""), (2, "let", ""), (3, "binding", "ab"), (3, "binding", "ef"), (3, "call", "go")],
    "fn f() { x.iter().map(|q| q.len()).sum() }": [(0, "fn", "f"), (1, "block", ""), (2, "tail", ""), (3, "name", "x"), (3, "method", "iter"), (3, "method", "map"), (4, "closure", ""), (5, "param", ""), (6, "binding", "q"), (5, "name", "q"), (5, "method", "len"), (3, "method", "sum")],
    "fn f() { if a { b(); } else if let Some(c) = d { } else { e } }": [(0, "fn", "f"), (1, "block", ""), (2, "tail", ""), (3, "if", ""), (4, "name", "a"), (4, "block", ""), (5, "stmt", ""), (6, "call", "b"), (4, "name", "d"), (4, "block", ""), (4, "block", ""), (5, "tail", ""), (6, "name", "e")],
    "fn f() { match x { A => [1], B | C if y => { z } _ => S { t: 1 }, } }": [(0, "fn", "f"), (1, "block", ""), (2, "tail", ""), (3, "match", ""), (4, "name", "x"), (4, "arm", ""), (5, "array", ""), (4, "arm", ""), (5, "block", ""), (6, "tail", ""), (7, "name", "z"), (4, "arm", ""), (5, "struct", "S")],
    "mod m { impl T for S { async fn g(&self) { a.lock().await[0]; vec![1, 2]; [0; 3] } } }": [(0, "item", "mod"), (1, "item", "impl"), (2, "fn", "g"), (3, "param", ""), (3, "block", ""), (4, "stmt", ""), (5, "name", "a"), (5, "method", "lock"), (5, "await", ""), (5, "index", ""), (4, "stmt", ""), (5, "macro", "vec"), (4, "tail", ""), (5, "repeat", "")],
    "fn f() { for (i, v) in w { loop { break; } } while a < b {} }": [(0, "fn", "f"), (1, "block", ""), (2, "stmt", ""), (3, "for", ""), (4, "binding", "i"), (4, "binding", "v"), (4, "name", "w"), (4, "block", ""), (5, "tail", ""), (6, "loop", ""), (7, "block", ""), (8, "stmt", ""), (2, "tail", ""), (3, "while", ""), (4, "name", "a"), (4, "name", "b"), (4, "block", "")],
    "const A: [u8; 2] = [1, 2]; use b::{c, d}; struct E { f: u8 } fn g() { a::b::<u8>(1) }": [(0, "item", "const"), (1, "array", ""), (0, "item", "use"), (0, "item", "struct"), (0, "fn", "g"), (1, "block", ""), (2, "tail", ""), (3, "call", "b")],
}


@pytest.mark.parametrize("text", TREES)
def test_trees(text):
    assert tree(text) == TREES[text]


def test_intervals_nest():
    nodes = Scan("\n".join(TREES)).nodes
    for n in nodes:
        assert n["past"] > n["node"] and (n["parent"] < 0 or nodes[n["parent"]]["past"] >= n["past"] > n["node"] > n["parent"])
    assert Scan("fn a( {").error and Scan("fn a( {").nodes == []
    assert Scan("fn a() { " + "(" * 5000 + ")" * 5000 + " }").error == "nested too deeply"


def test_masks_keep_bytes():
    text = "let a = \"é\"; // ü 'x'\nlet b = '\"'; // not a comment here \" // c\n"
    kept, code = byte_masks(text)
    assert len(kept.encode()) == len(code.encode()) == len(text.encode())
    assert comment_scope(text).split("\n")[0].strip() == "// ü 'x'"
    assert comment_scope(text).split("\n")[1].strip() == "// c"
    assert "not a comment here" in masked(text)[0] and len(comment_scope(text).encode()) == len(text.encode())


LOOPS = {
    "fn f() {\n for a in b {\n  X\n }\n X\n}": 1,
    "fn f() {\n for a in b { X } X\n}": 1,
    "fn f() {\n for a in NAMES {\n  X\n }\n}": 0,
    "fn f() {\n for a in &NAMES.iter() {\n  X\n }\n}": 0,
    "fn f() { while a { if b { X } X } X }": 3,  # the first brace of a line with a loop is the loop's
    "fn f() {\n loop\n {\n  X { X }\n }\n X\n}": 2,
    "fn f() {\n for a in b {\n  for c in d { X }\n  X\n }\n X\n}": 2,
    "fn f() {\n for a in NAMES {\n  for c in d {\n X }\n  X\n }\n}": 1,
    "fn f() { X }": 0,
}


@pytest.mark.parametrize("code", LOOPS)
def test_loops(code):
    assert loop_code(code).count("X") == LOOPS[code]


@pytest.fixture(scope="module")
def findings(spark):
    def of(sources, **more):
        table = spark.createDataFrame(sorted(sources.items()), "file_path string, content string")
        read = parsed(table).persist()
        found = [r.asDict() for r in rust_findings(table, table=read, **more).collect()]
        read.unpersist()
        return found

    return of


LITERALS = {
    "array": ("fn f() -> V { [\n1,\n] }", True), "struct": ("fn f() -> S { S { a: 1 } }", True), "vec": ("fn f() -> V { vec![1, 2] }", True),
    "match": ("fn f(x: X) -> u8 { match x { A => 1, B => { } _ => g(2) } }", True), "other-macro": ("fn f() { println!(x) }", False),
    "busy-arm": ("fn f(x: X) -> u8 { match x { A => { g(); 1 } _ => 2 } }", False), "two": ("fn f() -> V { g(); [1] }", False), "semicolon": ("fn f() { [1]; }", False),
    "repeat": ("fn f() -> V { [0; 9] }", False), "method": ("fn f() -> V { [1].to_vec() }", False), "empty": ("fn f() {}", False), "reference": ("fn f() -> V { &[1] }", False),
}


def test_literal_bodies(spark):
    table = parsed(spark.createDataFrame([(k, t) for k, (t, _) in LITERALS.items()], "file_path string, content string"))
    got = {r["file_path"] for r in facts.literal_bodies(exploded(table, "nodes")).collect()}
    assert got == {k for k, (_, literal) in LITERALS.items() if literal}


GUARDS = {
    "held": ("let g = m.lock().unwrap();\n go().await;", "g"), "read": ("let mut g = m.read().unwrap();\n go().await;", "g"),
    "dropped": ("let g = m.lock().unwrap();\n drop(g);\n go().await;", None), "dropped-later": ("let g = m.lock().unwrap();\n go().await;\n drop(g);", "g"),
    "nested-end": ("{\n let g = m.lock().unwrap();\n }\n go().await;", None), "nested-await": ("let g = m.lock().unwrap();\n if a {\n go().await;\n }", "g"),
    "same-line": ("let g = m.lock().await;\n go();", None), "loop": ("for a in b {\n let g = m.write().unwrap();\n go(a).await;\n }", "g"),
    "shadowed": ("let g = m.lock().unwrap();\n let g = 1;\n go().await;", "g"), "other-drop": ("let g = m.lock().unwrap();\n drop(h);\n go().await;", "g"),
    "second": ("let g = m.lock().unwrap();\n drop(g);\n let h = n.lock().unwrap();\n go().await;", "h"), "pattern": ("let (g, h) = m.lock().unwrap();\n go().await;", None),
    "no-lock": ("let g = m.len();\n go().await;", None),
}


def test_guards(findings):
    found = findings({k: f"async fn f(m: M) {{\n {body}\n}}\n" for k, (body, _) in GUARDS.items()})
    got = {f["file_path"]: f for f in found if f["rule_id"] == "concurrency.lock-across-await"}
    assert {k: got[k]["metadata"] for k in got} == {k: f'{{"guard":"{g}"}}' for k, (_, g) in GUARDS.items() if g}
    assert got["second"]["message"] == "Async function `f` appears to hold lock guard `h` across await." and got["second"]["line"] == 1


PATHS = {
    "fires": ("let p = PathBuf::from(name);", True), "join": ("base.join(&name)", True), "twice": ("Path::new(name).join(name)", True), "safe": ("Path::new(file_name)", False),
    "typed": ("fn g(name: &Path) {\n Path::new(name);\n }", False), "typed-as": ("fn g(name: impl AsRef<Path>) {\n Path::new(name);\n }", False), "typed-str": ("fn g(name: &str) {\n Path::new(name);\n }", True),
    "loop": ("for name in [\"a\"] {\n base.join(name);\n }", False), "loop-other": ("for name in &names {\n base.join(name);\n }", True),
    "literal": ("let name = \"a\";\n base.join(name);", False), "literal-typed": ("let name: &str = \"a\";\n base.join(name);", False), "bound": ("let name = input();\n base.join(name);", True),
    "validated": ("validate_part(&name)?;\n base.join(name);", False), "checked": ("if name.contains(\"..\") {\n return;\n }\n base.join(name);", False),
    "after": ("let p = base.join(name).canonicalize();\n p.starts_with(base);", False), "after-half": ("let p = base.join(name).canonicalize();", True),
    "far": ("let name = \"a\";\n" + "x();\n" * 6 + "base.join(name);", True),
}


def test_path_suppressors(findings):
    found = findings({f"src/{k}.rs": f"fn f() {{\n {body}\n}}\n" for k, (body, _) in PATHS.items()} | {"tests/in_tests.rs": "fn f() { base.join(name); }"})
    got = [(f["file_path"], f["metadata"]) for f in found if f["rule_id"] == "security.path-traversal-candidate"]
    assert sorted(got) == sorted((f"src/{k}.rs", '{"argument":"name"}') for k, (_, fires) in PATHS.items() if fires)


def test_names_and_options(findings):
    text = (
        "fn f(ab: u8, (cd, foo): P) {\n let S { ef, gh: ij } = p;\n for kl in w {}\n x.map(|mn: u8, [op, ..]| 1);\n let _q = 1;\n if let Some(uv) = w {}\n let run_now = run_now(1);\n"
        " let tidy = go().tidy(2);\n let id @ st = 1;\n}\nfn run_now(n: u8) -> bool { true }\nfn tidy() {}\nimpl T { fn m() { let m = m(); } }\nfn churn() {}\n"
    )
    rows = lambda found, rule: sorted((f["symbol"], f["line"], f["file_path"]) for f in found if f["rule_id"] == rule)
    found = findings({"a.rs": text, "src/aws/b.rs": "fn f(cw: u8) {}"})
    assert rows(found, "naming.short-variable") == [(n, k, "a.rs") for n, k in sorted([("ab", 1), ("cd", 1), ("ef", 2), ("ij", 2), ("kl", 3), ("mn", 4), ("op", 4)])]
    assert rows(found, "naming.placeholder-identifier") == [("foo", 1, "a.rs")]
    assert rows(found, "naming.identifier-shadow") == [("run_now", 7, "a.rs")]
    assert rows(found, "naming.boolean-prefix") == [("run_now", 11, "a.rs")]
    names = NameOptions(("churn",), ("run_",), ("tidy", "it's"), ("AB", "cd", "ef", "ij", "kl", "mn"))
    found = findings({"a.rs": text}, names=names)
    assert rows(found, "naming.short-variable") == [("id", 9, "a.rs"), ("op", 4, "a.rs")]
    assert rows(found, "naming.placeholder-identifier") == [("foo", 1, "a.rs"), ("tidy", 8, "a.rs"), ("tidy", 12, "a.rs")]
    assert rows(found, "naming.generic-function") == [("churn", 14, "a.rs")] and rows(found, "naming.boolean-prefix") == []


def test_lines_messages_and_metadata(findings):
    text = (
        "pub fn f() -> Result<u8, E> {\n    Ok(1)\n}\n\nfn make_token() -> u8 {\n    let a = 1;\n    rand::random::<u8>()\n}\n\nfn table() -> V {\n    [\n" + "        1,\n" * 60 + "    ]\n}\n"
        "fn twice(w: W) {\n    for a in w { a.clone(); b.clone(); }\n    c.clone();\n}\n"
    )
    found = {f["rule_id"]: f for f in findings({"a.rs": text})}
    assert found["docs.missing-errors-section"]["message"] == "Public function `f` returns Result; its rustdoc needs a `# Errors` section describing when each Err variant fires."
    assert found["security.insecure-rng-for-secrets"]["line"] == 7 and '"call":"rand::random"' in found["security.insecure-rng-for-secrets"]["metadata"]
    assert "size.function-length" not in found
    assert found["performance.clone-in-loop"]["message"] == "Function `twice` calls clone() inside a loop 2 time(s)."
    assert found["performance.clone-in-loop"]["metadata"] == '{"pattern":"clone()","occurrences":2}'
    assert all(f["remediation"] for f in found.values())


def test_references_of_attributes(findings):
    text = "fn fallback() -> u8 { 1 }\nfn orphan() -> u8 { 1 }\nstruct S {\n    #[serde(rename = \"x\", default = \"fallback\")]\n    a: u8,\n}\n"
    found = findings({"src/deep/mod.rs": text})
    assert [f["symbol"] for f in found if f["rule_id"] == "dead-code.unused-private-function"] == ["orphan"]
    assert sorted(f["symbol"] for f in found if f["rule_id"] == "dead-code.unused-private-item-candidate") == ["deep::S", "deep::orphan"]


def test_every_block_rule_has_a_message():
    assert all(r.message.startswith(("concat(", "'")) and r.id.count(".") == 1 for r in BLOCK_RULES)


def test_files_are_scanned_in_parts_of_bounded_size():
    """A scan makes some hundred times its text in Python: a batch of 10,000 files took gigabytes."""
    texts = ["fn f() {}\n" * 3000, None, "", *["fn g() { a.b(); }\n" * 200] * 400, "x" * 1_000_000]
    batch = pa.RecordBatch.from_arrays([pa.array([str(k) for k in range(len(texts))]), pa.array(texts)], ["file_path", "content"])
    parts = list(rust_tables._in_parts(batch))
    assert pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()
    assert all(sum(len(t or "") for t in p["content"].to_pylist()) <= rust_tables._SCAN_BYTES for p in parts[:-1]) and parts[-1].num_rows == 1
    assert list(rust_tables._in_parts(batch.slice(0, 0))) == []
