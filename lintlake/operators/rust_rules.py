"""Rules on Rust sources, as Spark expressions over the tables of `rust_tables`.

A rule is a row: id, pillar, severity, confidence, condition, message. All block rules are evaluated in one pass over the
blocks, all line rules in one pass over the lines, so that no rule costs a shuffle of its own.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.functions.columns import is_high_entropy
from lintlake.operators import project as P
from lintlake.operators import rust_facts as facts
from lintlake.operators import text_rules
from lintlake.operators.findings import deduped, identified
from lintlake.operators.remedies import REMEDIES
from lintlake.operators.rust_tables import code_lines, exploded, parsed


@dataclass(frozen=True)
class Rule:
    """`when`, `message`, `symbol`, `metadata` (a JSON text) and `line` (else that of the row) are SQL over the table that the rule reads."""

    id: str
    pillar: str
    severity: str
    confidence: str
    when: str
    message: str
    symbol: str = "name"
    metadata: str = "null"
    line: str | None = None


_CYCLOMATIC = r"1 + regexp_count(masked_body, '\\b(if|else if|match|for|while|loop)\\b|\\?|&&|\\|\\|')"
_NESTING = "greatest(0, aggregate(split(regexp_replace(masked_body, '[^{}]', ''), ''), named_struct('d', 0, 'm', 0), (a, c) -> named_struct('d', a.d + if(c = '{', 1, if(c = '}', -1, 0)), 'm', greatest(a.m, a.d + if(c = '{', 1, 0)))).m - 1)"
_TOKENS = r"regexp_extract_all(masked_body, '[A-Za-z_][A-Za-z0-9_]*|\\d+(?:\\.\\d+)?|==|!=|<=|>=|&&|\\|\\||::|->|=>|[{}()\\[\\];,.:+\\-*/%&|^!<>?=]', 0)"
_INFRA = r"(file_path rlike '(^|/)tests/|(^|/)tests\\.rs$' and not file_path rlike '(^|/)fixtures/')"
_CALIBRATION = r"(file_path rlike '(^|/)tests/calibration/|(^|/)calibration_extras\\.rs$')"
_DOC = r"concat_ws('\n', filter(split(body, '\n'), x -> ltrim(x) like '///%'))"
_DOCUMENTED = r"(body rlike '(?m)^\\s*///')"
_PUBLIC = "externally_public and not is_test and not test_context"
_HEADING = lambda word: rf"({_DOC} rlike '(?mi)^\\s*///\\s*#+\\s*{word}\\b')"
_BRIDGE = r"(body rlike '#\\s*\\[\\s*(?:tauri\\s*::\\s*command|command|wasm_bindgen|pyfunction|pyo3\\s*::\\s*pyfunction)\\b')"
_RAND = r"'\\brand\\s*::\\s*(thread_rng|random)\\s*(?:::<[^>\n]+>)?\\s*\\('"
_UNNAMED = rf"filter(params, p -> not p like '\\_%' and p rlike '^[a-z]\\w*$' and not {_DOC} rlike concat('(?i)\\b', p, '\\b'))"
_UNWRAP = r"'\\.(unwrap|expect)\\s*\\('"

# What is counted in loops, and the lines that are left out.
_FORMAT_OWNED = (
    r"^\\s*[A-Za-z_][A-Za-z0-9_]*\\s*:\\s+[^=]*format!\\s*\\(|\\bErr\\(\\s*format!\\s*\\(|^\\s*return\\s+format!\\s*\\(|\\.(?:push_str|insert_str|write_str|write_all|write_fmt)\\s*\\(\\s*&?\\s*format!\\s*\\("
    r"|^\\s*&?format!\\s*\\(|^\\s*[^=;]+=>\\s*&?format!\\s*\\(|^\\s*let\\s+[A-Za-z_][A-Za-z0-9_]*(?:label|message|desc|summary|title|name)[A-Za-z0-9_]*\\s*=\\s*&?format!\\s*\\("
)
_CLONE_STRUCTURAL = r"^\\s*[A-Za-z_][A-Za-z0-9_]*\\s*:\\s+[^=]*\\.clone\\(\\)\\s*\\)*\\s*,?\\s*$|\\bSome\\(\\s*[^()]*\\.clone\\(\\)\\s*\\)|\\.(?:entry|insert)\\(\\s*&?\\s*\\(?[^=;]*\\.clone\\(\\)[^;]*\\)|^\\s*\\.clone\\(\\)\\s*$"
_LOOP_RULES = [  # rule, severity, confidence, label, pattern, lines left out
    ("performance.regex-in-loop", "warning", "high", "Regex::new", r"\\bRegex::new\\s*\\(", ""),
    ("performance.format-in-loop", "advisory", "medium", "format!", r"\\bformat!\\s*\\(", _FORMAT_OWNED),
    ("performance.clone-in-loop", "advisory", "medium", "clone()", r"\\.clone\\s*\\(", _CLONE_STRUCTURAL),
]


def _in_loop(rule: str, severity: str, confidence: str, label: str, pattern: str, left_out: str) -> Rule:
    """Counts matches that begin between a loop's braces; a line is left out by what stands on all of it."""
    counted = f"not x.whole rlike '{left_out}'" if left_out else "true"
    lines = r"arrays_zip(split(code_body, '\n', -1), split(loop_body, '\n', -1))"
    n = f"aggregate(transform({lines}, x -> named_struct('whole', x['0'], 'inner', x['1'])), 0, (n, x) -> n + if({counted}, regexp_count(x.inner, '{pattern}'), 0))"
    message = f"concat('Function `', name, '` calls {label} inside a loop ', {n}, ' time(s).')"
    return Rule(rule, "maintainability", severity, confidence, f"not test and {n} > 0", message, metadata=f"to_json(named_struct('pattern', '{label}', 'occurrences', {n}))")


# Rule ids, thresholds, word lists and patterns.
BLOCK_RULES = [
    Rule("size.function-length", "size", "warning", "high", "not test and line_count > 50 and not literal_body", "concat('Function `', name, '` has ', line_count, ' lines, above the threshold of 50.')", metadata="to_json(named_struct('lines', line_count, 'threshold', 50))"),
    Rule("size.parameter-count", "size", "warning", "high", "not test and size(params) > 5", "concat('Function `', name, '` declares ', size(params), ' parameters.')"),
    Rule("complexity.cyclomatic", "complexity", "warning", "high", "not test and cyclomatic > 10", "concat('Function `', name, '` has cyclomatic complexity ', cyclomatic, '.')", metadata="to_json(named_struct('complexity', cyclomatic))"),
    Rule("complexity.nesting-depth", "complexity", "warning", "high", "not test and nesting > 4", "concat('Function `', name, '` has nesting depth ', nesting, '.')", metadata="to_json(named_struct('nestingDepth', nesting))"),
    Rule("complexity.cognitive", "complexity", "warning", "high", "not test and cyclomatic + 2 * nesting > 15", "concat('Function `', name, '` has cognitive complexity ', cyclomatic + 2 * nesting, '.')", metadata="to_json(named_struct('complexity', cyclomatic + 2 * nesting, 'cyclomatic', cyclomatic, 'nestingDepth', nesting))"),
    Rule("metrics.halstead-volume", "complexity", "advisory", "medium", f"not test and not {_CALIBRATION} and volume > 1500", "concat('Function `', name, '` has Halstead-style volume ', format_string('%.1f', volume), ', above the threshold of ', format_string('%.1f', 1500.0D), '.')", metadata="to_json(named_struct('totalTokens', tokens, 'uniqueTokens', unique_tokens, 'halsteadVolume', round(volume, 1), 'threshold', 1500.0D))"),
    Rule("metrics.maintainability-pressure", "maintainability", "advisory", "medium", f"not test and not {_CALIBRATION} and maintainability < 45", "concat('Function `', name, '` has maintainability pressure score ', format_string('%.1f', maintainability), ', below the minimum of ', format_string('%.1f', 45.0D), '.')", metadata="to_json(named_struct('score', round(maintainability, 1), 'minimum', 45.0D, 'totalTokens', tokens, 'cyclomatic', cyclomatic, 'halsteadVolume', round(volume, 1)))"),
    Rule("design.god-function", "design", "warning", "high", "not test and line_count > 45 and cyclomatic > 10", "concat('Function `', name, '` is both long and complex.')"),
    Rule("naming.generic-function", "naming", "advisory", "high", "not test and lower(name) in ('process', 'handle', 'do_it', 'run', 'execute', 'manage')", "concat('Function `', name, '` is too generic to explain intent.')"),
    Rule("naming.boolean-prefix", "naming", "advisory", "high", "not test and returns_bool and (lower(name) rlike '(^|_)by$' or not (arrays_overlap(split(lower(name), '_'), array('is', 'has', 'can', 'should', 'allows', 'supports', 'contains', 'needs', 'uses', 'matches', 'in', 'intersects', 'overlaps')) or lower(name) like 'starts_with%' or lower(name) like 'ends_with%'))", "concat('Function `', name, '` returns bool without a predicate name.')"),
    Rule("naming.placeholder-identifier", "naming", "advisory", "medium", "not test and name in ('foo', 'bar', 'baz', 'qux')", "concat('Function `', name, '` uses a placeholder name instead of domain language.')"),
    Rule("docs.missing-public-doc", "documentation", "advisory", "high", f"{_PUBLIC} and not {_DOCUMENTED}", "concat('Public function `', name, '` needs a brief intent description above its signature (one plain-English line, not a restatement of the type signature).')"),
    Rule("docs.missing-errors-section", "documentation", "advisory", "high", f"{_PUBLIC} and returns_result and not {_HEADING('Errors')}", "concat('Public function `', name, '` returns Result; its rustdoc needs a `# Errors` section describing when each Err variant fires.')"),
    Rule("docs.missing-panics-section", "documentation", "advisory", "high", rf"{_PUBLIC} and {_DOCUMENTED} and (code_body rlike '\\bpanic!\\s*\\(' or code_body rlike {_UNWRAP}) and not {_HEADING('Panics')} and not {_INFRA}", "concat('Public function `', name, '` contains code that can panic (`panic!`, `unwrap`, or `expect`); its rustdoc needs a `# Panics` section.')"),
    Rule("docs.missing-safety-section", "documentation", "warning", "high", f"{_PUBLIC} and is_unsafe and not {_HEADING('Safety')}", "concat('Public `unsafe fn` `', name, '` needs a `# Safety` rustdoc section listing the invariants the caller must uphold.')"),
    Rule("docs.missing-param-doc", "documentation", "advisory", "medium", f"{_PUBLIC} and {_DOCUMENTED} and not {_BRIDGE} and size({_UNNAMED}) > 0", f"concat('Public function `', name, '` rustdoc does not mention parameter `', {_UNNAMED}[0], '` by name.')", metadata=f"to_json(named_struct('undocumented', {_UNNAMED}))"),
    Rule("docs.missing-return-doc", "documentation", "advisory", "medium", f"{_PUBLIC} and {_DOCUMENTED} and not {_BRIDGE} and returns and not returns_result and not {_DOC} rlike '(?i)returns?\\\\b'", "concat('Public function `', name, '` returns a value; its rustdoc does not describe what the return value represents.')"),
    Rule("error-handling.production-panic", "maintainability", "warning", "high", rf"not test and not {_INFRA} and masked_body rlike '\\bpanic!\\s*\\(' and not masked_body rlike '(PANIC|INVARIANT):'", "concat('Function `', name, '` calls panic! in production code.')", metadata="'{\"macro\":\"panic!\"}'"),
    Rule("error-handling.unimplemented-placeholder", "maintainability", "warning", "high", r"not test and masked_body rlike '\\b(todo!|unimplemented!)\\s*\\('", "concat('Function `', name, '` contains todo!/unimplemented! placeholder code.')", metadata="'{\"macros\":[\"todo!\",\"unimplemented!\"]}'"),
    Rule("error-handling.public-unwrap", "maintainability", "warning", "high", f"{_PUBLIC} and masked_body rlike {_UNWRAP}", "concat('Public function `', name, '` uses unwrap()/expect() in its implementation.')"),
    Rule("concurrency.blocking-call-in-async", "maintainability", "warning", "medium", "not test and is_async and blocking is not null", "concat('Async function `', name, '` calls blocking API `', blocking, '`.')", metadata="to_json(named_struct('pattern', blocking))"),
    Rule("concurrency.unbounded-channel", "maintainability", "advisory", "medium", r"not test and masked_body rlike '\\b(std::sync::mpsc::channel|mpsc::unbounded_channel|unbounded_channel)(?:\\s*::\\s*<[^>]+>)?\\s*\\('", "concat('Function `', name, '` creates an unbounded channel.')"),
    Rule("concurrency.lock-across-await", "maintainability", "warning", "medium", "not test and is_async and guard is not null", "concat('Async function `', name, '` appears to hold lock guard `', guard, '` across await.')", metadata="to_json(named_struct('guard', guard))"),
    *(_in_loop(*r) for r in _LOOP_RULES),
    Rule("security.insecure-rng-for-secrets", "security", "warning", "medium", f"not test and arrays_overlap(split(lower(name), '_'), array('token', 'tokens', 'secret', 'secrets', 'key', 'keys', 'password', 'passwords', 'nonce', 'nonces', 'salt', 'salts')) and code_body rlike {_RAND}", "concat('Function `', name, '` appears to generate secret material with non-cryptographic rand.')", metadata=f"to_json(named_struct('function', name, 'call', concat('rand::', regexp_extract(code_body, {_RAND}, 1))))", line=rf"start_line + regexp_count(regexp_extract(code_body, concat('(?s)^(.*?)', {_RAND}), 1), '\n')"),
    Rule("test-quality.no-assertions", "test-quality", "warning", "high", r"is_test and not masked_body rlike '\\b(assert!|assert_eq!|assert_ne!|matches!|panic!|assert_[A-Za-z0-9_]*\\s*\\()'", "concat('Test `', name, '` does not appear to make an assertion.')"),
    Rule("test-quality.trivial-assertion", "test-quality", "warning", "high", r"is_test and (masked_body rlike '\\bassert!\\s*\\(\\s*(true|false)\\s*\\)' or (masked_body rlike '\\bassert_eq!\\s*\\(\\s*[0-9]+\\s*,\\s*[0-9]+\\s*\\)' and regexp_extract(masked_body, '\\bassert_eq!\\s*\\(\\s*([0-9]+)\\s*,\\s*([0-9]+)\\s*\\)', 1) = regexp_extract(masked_body, '\\bassert_eq!\\s*\\(\\s*([0-9]+)\\s*,\\s*([0-9]+)\\s*\\)', 2)))", "concat('Test `', name, '` contains a trivial assertion.')"),
    Rule("test-quality.sleep-in-test", "test-quality", "advisory", "high", "is_test and masked_body rlike '(std::thread::sleep|tokio::time::sleep)'", "'Test sleeps instead of synchronising on behaviour.'"),
    Rule("test-quality.conditional-logic", "test-quality", "advisory", "high", r"is_test and masked_body rlike '\\b(if|match)\\b' and not masked_body rlike '\\bif\\s+cfg!\\s*\\('", "'Test contains conditional logic.'"),
    Rule("test-quality.unwrap-in-test", "test-quality", "advisory", "high", r"is_test and regexp_replace(masked_body, '\\bassert\\w*!\\s*\\([^;]*\\)\\s*\\.unwrap\\(\\)[^;]*;', '') rlike '\\.unwrap\\(\\)'", "'Test uses unwrap(), which can hide setup intent.'"),
    Rule("test-quality.ignored-without-reason", "test-quality", "advisory", "high", "is_test and ignored", "concat('Ignored test `', name, '` does not explain why it is skipped.')"),
    Rule("test-quality.long-test", "test-quality", "advisory", "high", f"is_test and line_count > 120 and not {_INFRA}", "concat('Test `', name, '` has ', line_count, ' lines, above the threshold of 120.')", metadata="to_json(named_struct('lines', line_count, 'threshold', 120))"),
    Rule("test-quality.should-panic-without-expected", "test-quality", "advisory", "high", r"is_test and body rlike '#\\s*\\[\\s*should_panic\\b' and not body rlike '#\\s*\\[\\s*should_panic\\s*\\([^)]*\\bexpected\\s*='", "concat('Test `', name, '` uses #[should_panic] without an `expected = \"...\"` clause.')"),
]
_CLONE_OWNED = (
    r"'\\.clone\\(\\)\\s*(?:\\?|\\.(?:unwrap_or_else|unwrap_or_default|unwrap_or|into_iter|into|collect)\\b)|^\\s*\\w+\\s*:\\s+[^=]*\\.clone\\(\\)\\s*\\)*\\s*,?\\s*$"
    r"|\\.(?:entry|insert|get|contains|contains_key|remove)\\([^=;]*\\.clone\\(\\)[^;]*\\)|\\bSome\\(\\s*[^()]*\\.clone\\(\\)\\s*\\)|\\blet\\s+(?:mut\\s+)?\\w+[^=]*=\\s*[^;]*\\.clone\\(\\);|^\\s*\\.clone\\(\\)\\s*$'"
)
_RISKY_COMMAND = r"""(near8 rlike '(?i)Command::new\\s*\\(\\s*"(?:sh|bash|dash|zsh|cmd|powershell|pwsh)"\\s*\\)' or near8 rlike '\\.(?:arg|args)\\s*\\([^)]*"(?:-c|/C)"' or near8 rlike 'Command::new\\s*\\(\\s*[A-Za-z_]' or near8 rlike '\\.(?:arg|args)\\s*\\(\\s*(?:&?[A-Za-z_]|\\[[^\\]]*(?:&?[A-Za-z_]|format!))')"""
LINE_RULES = [
    Rule("security.unsafe-block", "security", "warning", "high", r"code rlike '\\bunsafe\\s*\\{' and not above3 rlike 'SAFETY:'", "'Unsafe block lacks a nearby SAFETY rationale.'", "null"),
    Rule("docs.weak-safety-rationale", "documentation", "advisory", "medium", r"code rlike '\\bunsafe\\s*\\{' and above3 rlike 'SAFETY:' and length(trim(regexp_extract(above3, 'SAFETY:([^\n]*)', 1))) < 12", r"concat('Unsafe block\'s SAFETY rationale is too short or vague: `', trim(regexp_extract(above3, 'SAFETY:([^\n]*)', 1)), '`.')", "null"),
    Rule("security.tls-verification-disabled", "security", "warning", "high", r"code rlike '\\.(?:danger_accept_invalid_certs|accept_invalid_hostnames)\\s*\\(\\s*true\\s*\\)'", "'TLS certificate or hostname verification is explicitly disabled.'", "null"),
    Rule("security.process-command", "security", "warning", "high", rf"code rlike '(std::process::Command|Command)::new\\s*\\(' and {_RISKY_COMMAND}", "'Process command execution is used; validate command arguments are not user-controlled.'", "null"),
    Rule("security.sql-dynamic-query", "security", "warning", "high", r"code rlike '(?:^|\\W)(query|execute|prepare)\\s*\\(\\s*&?\\s*format!\\s*\\('", r"concat('Direct dynamic SQL argument passed to `', regexp_extract(code, '(?:^|\\W)(query|execute|prepare)\\s*\\(', 1), '(...)`; review query construction.')", r"regexp_extract(code, '(?:^|\\W)(query|execute|prepare)\\s*\\(', 1)"),
    Rule("security.hardcoded-bind-all-interfaces", "security", "warning", "high", rf"""not {_INFRA} and not ltrim(text) rlike '^(//|\\*|/\\*)' and text rlike '"(0\\.0\\.0\\.0|\\[::\\]|::0)(?::\\d+|/\\d+)?"'""", r"concat('Listener address `', regexp_extract(text, '\\x22((?:0\\.0\\.0\\.0|\\[::\\]|::0)(?::\\d+|/\\d+)?)\\x22', 1), '` binds to every network interface; review whether the bind should be restricted.')", "null"),
    Rule("modernisation.manual-is-empty", "modernisation", "advisory", "high", r"code rlike '(?:\\.len\\s*\\(\\s*\\)\\s*(?:==|!=)\\s*0\\b|\\b0\\s*(?:==|!=)\\s*[A-Za-z_][\\w\\.]*\\.len\\s*\\(\\s*\\))'", "'Use `.is_empty()` instead of comparing `.len()` against zero.'", "null"),
    Rule("modernisation.manual-contains", "modernisation", "advisory", "high", r"code rlike '\\.iter\\s*\\(\\s*\\)\\s*\\.any\\s*\\(\\s*\\|\\s*(\\w+)\\s*\\|\\s*(?:\\*\\s*\\w+\\s*==\\s*[A-Za-z_][\\w\\.]*|\\w+\\s*==\\s*&\\s*[A-Za-z_][\\w\\.]*)\\s*\\)'", "'Use `.contains(&value)` instead of `.iter().any(|x| x == &value)`.'", "null"),
    Rule("waste.unwrap-expect", "maintainability", "advisory", "high", rf"not in_test and not {_INFRA} and code rlike {_UNWRAP} and not text rlike '\\.expect\\s*\\(\\s*\\x22[^\\x22]{{15,}}\\x22'", "'unwrap()/expect() can turn recoverable errors into panics.'", "null"),
    Rule("waste.unnecessary-clone-candidate", "maintainability", "advisory", "high", rf"not in_test and not {_INFRA} and code rlike '\\.clone\\(\\)' and not code rlike {_CLONE_OWNED}", "'clone() call may be avoidable; confirm ownership requires it.'", "null"),
    Rule("waste.unreachable-code", "dead-code", "warning", "high", r"trim(masked) not in ('', '}') and rtrim(before) like '%;' and before rlike '\\b(return|panic!|todo!|unimplemented!)'", "'Statement appears after a terminating statement.'", "null"),
]
_STARTERS = "let |fn |pub fn |pub\\\\(|use |if |match |for |while |loop \\\\{|return |return;|struct |enum |trait |impl |type |const |static |async fn |unsafe |mod |mut |self\\\\."
COMMENT_RULES = [
    Rule("docs.stale-todo", "documentation", "advisory", "high", r"text rlike '(?<![A-Za-z0-9_])(TODO|FIXME|HACK|XXX)(?![A-Za-z0-9_])' and not text rlike '(TODO|FIXME|HACK|XXX)\\s*(\\([^)]*(#|@|GH-|://|:)[^)]*\\)|\\[[^\\]]*(#|@|GH-|://)[^\\]]*\\]|:\\s*\\S.{4,})'", r"concat(regexp_extract(text, '(TODO|FIXME|HACK|XXX)', 1), ' comment lacks an owner, issue reference, or reason.')", "null"),
    Rule("docs.commented-out-code", "documentation", "advisory", "medium", f"not is_doc and length(text) >= 5 and text rlike '^({_STARTERS})' and text rlike '[;{{}}]$'", "'Comment payload looks like disabled Rust code; remove or document intent.'", "null"),
]


# Reconstructed patterns: the cases that must and must not fire are known, the exact formats are not.
TEXT_RULES = [
    Rule("sensitive-data.api-key-pattern", "sensitive-data", "error", "high", r"text rlike '\\b(ghp_|gho_|github_pat_|glpat-|npm_)[A-Za-z0-9_-]{16,}|\\b[spr]k_(test|live)_[A-Za-z0-9]{10,}|\\bsk-[A-Za-z0-9_-]{20,}|\\bAIza[A-Za-z0-9_-]{30,}|\\b(SharedAccessKey|AccountKey)=[A-Za-z0-9+/=]{20,}|\\bxox[abp]-[A-Za-z0-9-]{10,}'", "'Text looks like an API key.'", "null"),
    Rule("sensitive-data.aws-access-key", "sensitive-data", "error", "high", r"text rlike '\\bAKIA[0-9A-Z]{16}\\b'", "'Text looks like an AWS access key.'", "null"),
    Rule("sensitive-data.database-url-password", "sensitive-data", "error", "high", r"text rlike '\\b(postgres(ql)?|mysql|mariadb|mongodb(\\+srv)?|redis|amqps?|mssql)://[^\\s:/@\\x22]+:[^\\s@/\\x22]+@'", "'Database URL holds a password.'", "null"),
    Rule("sensitive-data.url-embedded-credentials", "sensitive-data", "error", "high", r"text rlike '\\bhttps?://[^\\s:/@\\x22]+:[^\\s@/\\x22]+@'", "'URL holds credentials.'", "null"),
    Rule("sensitive-data.jwt-token", "sensitive-data", "error", "high", r"text rlike '\\beyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}'", "'Text looks like a JSON web token.'", "null"),
    Rule("sensitive-data.hardcoded-env-value", "sensitive-data", "error", "high", r"text rlike '(?i)[a-z0-9_-]*(password|passwd|secret|token|database_url)[\\x22]?\\s*[:=]\\s*[\\x22]?[^\\s\\x22\\x24\\x7b(<>]{8,}' and not text rlike '(?i)your_|example|changeme|[$][{]|::|\\(|;\\s*$'", "'Hardcoded secret-like value.'", "null"),
    Rule("sensitive-data.pii-test-fixture", "sensitive-data", "error", "high", r"file_path rlike '(?i)fixture|sample' and (text rlike '\\b[A-Za-z0-9._%+-]+@(?!example\\.|test\\.)[A-Za-z0-9-]+\\.[a-z]{2,}' or text rlike '\\b(?!000)[0-9]{3}-(?!00)[0-9]{2}-[0-9]{4}\\b' or text rlike '\\b(?!555)[2-9][0-9]{2}-(?!555)[0-9]{3}-[0-9]{4}\\b')", "'Fixture holds what looks like personal data.'", "null"),
]
KEY_RULES = [Rule("sensitive-data.private-key", "sensitive-data", "error", "high", r"content rlike '-----BEGIN [A-Z ]*PRIVATE KEY-----\\s*[A-Za-z0-9+/=\\s\\\\n]{16,}-----END'", "'Text holds a private key.'", "null")]
ENTROPY_RULES = [Rule("sensitive-data.high-entropy-string", "sensitive-data", "error", "medium", "hits > 0", "'String of high entropy.'", "null")]


def _found(table: DataFrame, rules: list[Rule], phase: int, line: str = "line") -> DataFrame:
    """Findings of all rules over one table in one pass. emit_seq orders by phase, row and rule."""

    def of(k: int, r: Rule) -> Column:
        parts = (F.lit(r.id).alias("rule_id"), F.expr(r.message).alias("message"), F.lit(r.severity).alias("severity"), F.lit(r.pillar).alias("pillar"), F.lit(r.confidence).alias("confidence"), F.expr(f"cast({r.symbol} as string)").alias("symbol"), F.expr(f"cast({r.metadata} as string)").alias("metadata"), F.expr(r.line or line).cast("int").alias("line"), F.lit(REMEDIES.get(r.id)).alias("remediation"), F.lit(k).alias("k"))
        return F.when(F.expr(r.when), F.struct(*parts))

    hits = table.select("file_path", F.col("seq"), F.explode(F.array_compact(F.array(*(of(k, r) for k, r in enumerate(rules))))).alias("x"))
    seq = F.lit(phase).cast("bigint") * 10**12 + F.col("seq").cast("bigint") * 1000 + F.col("x.k")
    return hits.select("file_path", *(f"x.{c}" for c in ("line", "rule_id", "message", "severity", "pillar", "confidence", "symbol", "metadata", "remediation")), seq.alias("emit_seq"))


def measured_blocks(table: DataFrame) -> DataFrame:
    """Function blocks with cyclomatic, nesting, tokens, volume, maintainability, the first blocking call, the first guard live at an await, whether the body is a literal, and `test`."""
    apis = ("std::thread::sleep", "std::fs::read_to_string", "std::fs::read", "std::fs::write", "std::process::Command::new")
    blocking = F.lit(None).cast("string")
    for api in reversed(apis):
        blocking = F.when(F.col("masked_body").contains(api), api).otherwise(blocking)
    found = exploded(table, "blocks").withColumns({"cyclomatic": F.expr(_CYCLOMATIC), "nesting": F.expr(_NESTING), "_tokens": F.expr(_TOKENS), "blocking": blocking, "test": F.expr("is_test or test_context")})
    unique = F.size(F.array_distinct("_tokens"))
    volume = F.when(unique > 1, F.size("_tokens") * F.log2(unique.cast("double"))).otherwise(0.0)
    found = found.withColumns({"tokens": F.size("_tokens"), "unique_tokens": unique, "volume": volume}).drop("_tokens")
    found = found.withColumn("maintainability", F.expr("100 - least(100.0D, 0.08D * tokens + 2 * cyclomatic + volume / 60)"))
    nodes = exploded(table, "nodes")
    found = found.join(facts.guards_across_await(nodes), ["file_path", "at"], "left")
    return found.join(facts.literal_bodies(nodes).withColumn("literal_body", F.lit(True)), ["file_path", "at"], "left").fillna(False, ["literal_body"])


def lines_in_context(table: DataFrame) -> DataFrame:
    """Lines with what the line rules look back and ahead to, and whether they lie in test code."""
    tests = exploded(table, "blocks").filter("is_test or test_context").groupBy("file_path").agg(F.collect_list(F.struct("start_line", (F.col("start_line") + F.col("line_count")).alias("past"))).alias("spans"))
    order = Window.partitionBy("file_path").orderBy("line")
    above = F.concat_ws("\n", *(F.lag("masked", k).over(order) for k in (3, 2, 1)), "masked")
    near = F.concat_ws("\n", "text", *(F.lead("text", k).over(order) for k in range(1, 8)))
    # Only the lines whose rules look at their neighbours join them.
    context = {"above3": F.when(F.col("code").contains("unsafe"), above), "near8": F.when(F.col("code").contains("Command"), near), "before": F.lag("masked").over(order)}
    found = code_lines(table).withColumns(context)
    inside = F.coalesce(F.exists("spans", lambda s: (F.col("line") >= s.start_line) & (F.col("line") < s.past)), F.lit(False))
    return found.join(tests, "file_path", "left").withColumns({"in_test": inside, "seq": F.col("line")})


# Abbreviations that are accepted where the settings name none, and in folders of one kind.
ABBREVIATIONS = ("age", "app", "db", "fs", "id", "io", "key", "log", "max", "min", "now", "raw", "rx", "tx", "ui", "url")
_CLOUD_ABBREVIATIONS = ("ca", "ce", "cn", "cw", "dp", "dt", "gb", "gw", "lb", "pm", "py", "sa", "sg", "sn", "td", "tg", "tp", "ym")
_PLACEHOLDERS = ("foo", "bar", "baz", "qux")


@dataclass(frozen=True)
class NameOptions:
    """Further generic function names, predicate prefixes and placeholders, and the accepted abbreviations."""

    generic: Sequence[str] = ()
    prefixes: Sequence[str] = ()
    placeholders: Sequence[str] = ()
    abbreviations: Sequence[str] = ABBREVIATIONS


def _any_of(column: str, values: Sequence[str]) -> str:
    """SQL: whether the column is one of the values."""
    listed = ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)
    return f"coalesce(array_contains(array({listed}), {column}), false)" if values else "false"


def named_rules(rules: Sequence[Rule], names: NameOptions) -> list[Rule]:
    """The block rules with the options of the naming rules."""
    prefixed = " or ".join(_any_of(f"left(name, {len(p)})", [p]) for p in names.prefixes) or "false"
    changed = {
        "naming.generic-function": lambda r: replace(r, when=f"({r.when}) or (not test and {_any_of('name', names.generic)})"),
        "naming.boolean-prefix": lambda r: replace(r, when=f"({r.when}) and not ({prefixed})"),
        "naming.placeholder-identifier": lambda r: replace(r, when=f"({r.when}) or (not test and {_any_of('name', names.placeholders)})"),
    }
    return [changed.get(r.id, lambda r: r)(r) for r in rules]


def item_findings(table: DataFrame, names: NameOptions = NameOptions()) -> DataFrame:
    """Rules on items, fields, names and references."""
    items = P.in_modules(exploded(table, "items"))
    public = Rule("docs.missing-public-doc", "documentation", "advisory", "medium", "externally_public and not documented and (kind in ('struct', 'enum', 'trait') or (kind = 'mod' and inline)) and not test_context", "concat('Public item `', name, '` needs a brief intent description above its declaration (one plain-English line, not a restatement of the type).')")
    field = Rule("modernisation.public-field", "modernisation", "advisory", "high", "true", "'Public struct field exposes representation; prefer accessors when invariants matter.'", "null")
    cloud = rf"(concat('/', file_path) rlike '/aws(/|\\.rs$)' and {_any_of('lower(name)', _CLOUD_ABBREVIATIONS)})"
    short = Rule("naming.short-variable", "naming", "advisory", "medium", f"octet_length(name) = 2 and not name like '\\\\_%' and not {_any_of('lower(name)', [n.lower() for n in names.abbreviations])} and not {cloud}", "concat('Variable `', name, '` is too short to explain intent.')")
    placeholder = Rule("naming.placeholder-identifier", "naming", "advisory", "medium", _any_of("name", (*_PLACEHOLDERS, *names.placeholders)), "concat('Variable `', name, '` uses a placeholder name instead of domain language.')")
    nodes = exploded(table, "nodes")
    bound = facts.bindings(nodes)
    out = _found(items, [public], 4).unionByName(_found(exploded(table, "fields"), [field], 5)).unionByName(_found(bound, [short, placeholder], 6))
    hidden = Rule("naming.identifier-shadow", "naming", "advisory", "high", "true", "concat('Local binding `', name, '` shadows same-file function `', name, '`.')", metadata="to_json(named_struct('shadows', name))")
    uses = table.select("file_path", F.explode(P.identifiers(P.reference_source(F.col("code"), F.col("content")))).alias("name")).groupBy("file_path", "name").agg(F.count("*").alias("uses"))
    named = items.groupBy("file_path", "name").agg(F.count_if(F.col("kind").isin("function", "method")).alias("defined"))
    parents = items.filter("kind = 'mod' and not inline").select("file_path").distinct()
    private = items.filter("kind in ('function', 'method') and not public and not test_context and not cfg_gated and name <> 'main' and within in ('', 'impl')").join(parents, "file_path", "left_anti")
    unused = private.join(uses, ["file_path", "name"]).join(named, ["file_path", "name"]).filter("uses - defined = 0")
    dead = Rule("dead-code.unused-private-function", "dead-code", "advisory", "low", "true", "concat('Private function `', name, '` appears to be unused in this file.')")
    candidate = Rule("dead-code.unused-private-item-candidate", "dead-code", "advisory", "medium", "true", "concat('Private ', kind, ' `', name, '` is an unused candidate; no other discovered Rust source references its name.')", "if(module_path = '', name, concat(module_path, '::', name))", "to_json(named_struct('kind', kind, 'module', module_path, 'candidate', true))")
    counts = uses.groupBy("name").agg(F.sum("uses").alias("n")).withColumnRenamed("name", "identifier")
    rare = P.unused_items(items.filter("kind <> 'mod'"), counts)
    return out.unionByName(_found(facts.shadowed_functions(nodes, items), [hidden], 7)).unionByName(_found(unused, [dead], 8)).unionByName(_found(rare, [candidate], 0))


def module_findings(table: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """Rules on the size and fan-out of modules; `limits` by the rules' names without their pillar."""
    limits = {"large-module": 25, "public-api-surface": 12, "module-fan-out": 8} | (limits or {})
    items = P.in_modules(exploded(table, "items"))
    label = "if(module_path = '', file_path, module_path)"
    large = Rule("architecture.large-module", "design", "advisory", "high", "true", f"concat('Module `', {label}, '` contains ', items, ' indexed items, above the threshold of {limits['large-module']}.')", label, f"to_json(named_struct('items', items, 'threshold', {limits['large-module']}, 'module', {label}))")
    surface = Rule("architecture.public-api-surface", "design", "advisory", "high", "true", f"concat('Module `', {label}, '` exposes ', items, ' public items, above the threshold of {limits['public-api-surface']}.')", label, f"to_json(named_struct('publicItems', items, 'threshold', {limits['public-api-surface']}, 'module', {label}))")
    fan = Rule("architecture.module-fan-out", "design", "advisory", "high", "true", f"concat('File `', file_path, '` declares ', declared, ' child modules, above the threshold of {limits['module-fan-out']}.')", "file_path", f"to_json(named_struct('modules', declared, 'threshold', {limits['module-fan-out']}))")
    own = items.filter("kind <> 'mod'")
    numbered = lambda df: df.withColumn("seq", F.lit(0))
    out = _found(numbered(P.large_modules(own, limits["large-module"])), [large], 0).unionByName(_found(numbered(P.public_surface(own, limits["public-api-surface"])), [surface], 0))
    return out.unionByName(_found(numbered(P.module_fan_out(items.filter("kind = 'mod'"), limits["module-fan-out"])), [fan], 0))


_PAIRED = [  # rule, message, pattern, pairs of groups that must agree
    ("modernisation.manual-strip-prefix", "Use `strip_prefix` instead of slicing after `starts_with`.", r"if\s+(\w+)\s*\.starts_with\s*\(\s*(\w+)\s*\)\s*\{\s*&\s*(\w+)\s*\[\s*(\w+)\s*\.len\s*\(\s*\)\s*\.\.\s*\]", ((1, 3), (2, 4))),
    ("modernisation.manual-unwrap-or-default", "Use `.unwrap_or_default()` instead of a manual `match` with `Default::default()`.", r"match\s+[A-Za-z_][\w\.]*\s*\{\s*Some\s*\(\s*(\w+)\s*\)\s*=>\s*(\w+)\s*,\s*None\s*=>\s*(?:Default\s*::\s*default|String\s*::\s*new|Vec\s*::\s*new)\s*\(\s*\)", ((1, 2),)),
    ("modernisation.question-mark-candidate", "Use `?` instead of a manual `match` / `if let Err` that returns the same error.", r"match\s+[A-Za-z_][\w\.()]*\s*\{\s*Ok\s*\(\s*(\w+)\s*\)\s*=>\s*(\w+)\s*,\s*Err\s*\(\s*(\w+)\s*\)\s*=>\s*return\s+Err\s*\(\s*(\w+)\s*\)\s*,?\s*\}", ((1, 2), (3, 4))),
    ("modernisation.question-mark-candidate", "Use `?` instead of a manual `match` / `if let Err` that returns the same error.", r"match\s+[A-Za-z_][\w\.()]*\s*\{\s*Err\s*\(\s*(\w+)\s*\)\s*=>\s*return\s+Err\s*\(\s*(\w+)\s*\)\s*,\s*Ok\s*\(\s*(\w+)\s*\)\s*=>\s*(\w+)\s*,?\s*\}", ((1, 2), (3, 4))),
    ("modernisation.question-mark-candidate", "Use `?` instead of a manual `match` / `if let Err` that returns the same error.", r"if\s+let\s+Err\s*\(\s*(\w+)\s*\)\s*=\s*[^{;]{1,200}?\{\s*return\s+Err\s*\(\s*(\w+)\s*\)\s*;?\s*\}", ((1, 2),)),
]


def paired_findings(table: DataFrame) -> DataFrame:
    """Shapes over several lines in which names must agree."""
    out = None
    for k, (rule, message, pattern, pairs) in enumerate(_PAIRED):
        hits = text_rules.custom_matches(table, pattern, "code")
        for a, b in pairs:
            hits = hits.filter(F.regexp_extract("matched", pattern, a) == F.regexp_extract("matched", pattern, b))
        shown = hits.select("file_path", F.col("first_line").alias("line"), F.col("match_index").alias("seq"))
        part = _found(shown, [Rule(rule, "modernisation", "advisory", "high", "true", f"'{message}'", "null")], 20 + k)
        out = part if out is None else out.unionByName(part)
    return out


def crypto_findings(table: DataFrame) -> DataFrame:
    """Weak primitives, each once per file, imports first."""
    lines = code_lines(table)
    used = F.regexp_extract("code", r"^\s*use\s+(md5|md_5|sha1|sha_1|rc4|des)(?:::|\s*;)", 1)
    made = F.regexp_extract("code", r"\b(Md5|Sha1|Rc4|Des)::new\s*\(", 1)
    hit = F.when(used != "", F.struct(F.lit(0).alias("late"), used.alias("name"))).when(made != "", F.struct(F.lit(1).alias("late"), made.alias("name")))
    hits = lines.withColumn("x", hit).filter("x is not null").select("file_path", "line", F.col("x.late").alias("late"), F.replace(F.lower("x.name"), F.lit("_"), F.lit("")).alias("name"))
    first = hits.groupBy("file_path", "name").agg(F.min(F.struct("late", "line")).alias("at")).select("file_path", "name", F.col("at.line").alias("line"), F.col("at.line").alias("seq"))
    rule = Rule("security.weak-crypto", "security", "warning", "medium", "true", "concat('Weak cryptographic primitive `', name, '` is referenced; review cryptographic use.')")
    return _found(first, [rule], 9)


def sensitive_findings(sources: DataFrame) -> DataFrame:
    """Secrets in any text, Rust or not. Reconstructed: built to the known cases that must and must not fire."""
    lines = sources.select("file_path", F.posexplode(F.split("content", "\n", -1)).alias("at", "text")).withColumns({"line": F.col("at") + 1, "seq": F.col("at")})
    keys = sources.select("file_path", "content", F.lit(0).alias("seq"), (F.regexp_count(F.substring_index("content", "-----BEGIN ", 1), F.lit("\n")) + 1).alias("line"))
    literal = F.filter(F.regexp_extract_all("text", F.lit('"([^"\\s]{32,})"'), F.lit(1)), lambda x: is_high_entropy(x) & ~x.rlike("^sha(256|512)-"))
    entropic = lines.withColumn("hits", F.size(literal))
    return _found(lines, TEXT_RULES, 10).unionByName(_found(keys, KEY_RULES, 11)).unionByName(_found(entropic, ENTROPY_RULES, 12))


def path_findings(table: DataFrame) -> DataFrame:
    """Paths made of a plain name, outside test folders."""
    rule = Rule("security.path-traversal-candidate", "security", "warning", "medium", f"not {_INFRA}", "concat('Filesystem path constructed from `', name, '`; review whether the value can escape the intended directory.')", "null", "to_json(named_struct('argument', name))")
    return _found(facts.path_traversals(table), [rule], 15)


def workflow_findings(sources: DataFrame) -> DataFrame:
    """`github.event.` inside a `run` value or its block, in workflow files.

    A block ends at the first line that is not blank and no deeper than its `run` key: a line is inside while the least indent
    since that key is deeper.
    """
    flows = sources.filter(F.col("file_path").rlike(r"(^|/)\.github/workflows/[^/]+\.ya?ml$"))
    lines = flows.select("file_path", F.posexplode(F.split("content", "\n", -1)).alias("at", "text"))
    indent = F.length(F.regexp_extract("text", r"^(\s*(?:-\s+)?)", 1))
    own = F.regexp_extract("text", r"^\s*(?:-\s+)?run:\s*(.*)$", 1)
    marked = lines.withColumns({"indent": indent, "is_run": F.col("text").rlike(r"^\s*(?:-\s+)?run:"), "value": own}).filter("trim(text) <> ''")
    before = Window.partitionBy("file_path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    opens = F.when(F.col("is_run") & F.col("value").rlike(r"^[|>]"), F.struct("at", "indent"))
    opened = marked.withColumn("run", F.last(opens, ignorenulls=True).over(before))
    since = Window.partitionBy("file_path", "run.at").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    opened = opened.withColumn("least", F.min("indent").over(since))
    inside = F.col("run").isNotNull() & (F.col("least") > F.col("run.indent"))
    hit = opened.filter(F.col("text").contains("github.event.") & (inside | (F.col("is_run") & ~F.col("value").rlike(r"^[|>]"))))
    rule = Rule("ci.github-event-shell-interpolation", "security", "warning", "high", "true", "'GitHub event data is interpolated directly into a workflow shell step.'", "null")
    return _found(hit.select("file_path", (F.col("at") + 1).alias("line"), F.col("at").alias("seq")), [rule], 13)


def length_findings(sources: DataFrame, threshold: int = 600) -> DataFrame:
    """Files of over `threshold` lines; lock files, Markdown and shell scripts are exempt."""
    kept = sources.filter(~F.lower("file_path").rlike(r"\.(lock|md|markdown|sh)$|(^|/)[^/]*lock\.(json|ya?ml)$"))
    rule = Rule("size.file-length", "size", "warning", "high", "true", f"concat('File has ', lines, ' lines, above the threshold of {threshold}.')", "null")
    return _found(text_rules.file_length(kept, threshold).withColumns({"line": F.lit(1), "seq": F.lit(0)}), [rule], 14)


def rust_findings(sources: DataFrame, block_rules: list[Rule] | None = None, names: NameOptions = NameOptions(), table: DataFrame | None = None, modules: dict[str, int] | None = None) -> DataFrame:
    """Identified, deduplicated findings of all Rust rules over sources (file_path, content).

    `table` is what `parsed` gives for the sources. Every group of rules reads it, so give a persisted one, and unpersist it
    when the findings have been used.
    """
    table = parsed(sources) if table is None else table
    rules = named_rules(BLOCK_RULES if block_rules is None else block_rules, names)
    found = _found(measured_blocks(table), rules, 1, "start_line")
    lines = _found(lines_in_context(table), LINE_RULES, 2)
    comments = _found(exploded(table, "comments"), COMMENT_RULES, 3)
    parts = (lines, comments, item_findings(table, names), module_findings(table, modules), crypto_findings(table), paired_findings(table), path_findings(table), sensitive_findings(sources))
    for part in parts:
        found = found.unionByName(part, allowMissingColumns=True)
    return deduped(identified(found.withColumn("end_line", F.lit(None).cast("int"))))
