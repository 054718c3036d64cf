"""Package manifests and lock files as tables, and the rules on them."""

from __future__ import annotations

import os
import re
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.operators import project as P
from lintlake.operators.rust_rules import Rule, _found

DEPENDENCY = "name string, section string, line int, requirement string, path string, git string, rev string"
SECTIONS = ("dependencies", "dev-dependencies", "build-dependencies")


def dependencies(text: str) -> list[tuple]:
    """Rows of `DEPENDENCY` from a manifest's text, those of `target` tables too."""
    data = tomllib.loads(text)
    tables = [(s, data.get(s, {})) for s in SECTIONS]
    tables += [(f"target.{t}.{s}", v.get(s, {})) for t, v in data.get("target", {}).items() for s in SECTIONS]
    lines = text.split("\n")
    rows = []
    for section, table in tables:
        for name, value in table.items():
            about = value if isinstance(value, dict) else {"version": value}
            at = next((k for k, x in enumerate(lines, 1) if re.match(rf"\s*\"?{re.escape(name)}\"?\s*[=.]|\[.*\.{re.escape(name)}\]", x)), 1)
            rows.append((name, section, at, *(about.get(k) for k in ("version", "path", "git", "rev"))))
    return sorted(rows, key=lambda r: (r[1], r[0]))


def locked_packages(text: str) -> list[tuple]:
    """(name, version, line, source) from a lock file's text, sorted."""
    lines = [k for k, x in enumerate(text.split("\n"), 1) if x.strip() == "[[package]]"]
    found = tomllib.loads(text).get("package", [])
    return sorted((p["name"], p["version"], at, p.get("source")) for p, at in zip(found, lines, strict=True))


def manifest_findings(spark: SparkSession, root: str, versions: int = 2) -> tuple[DataFrame, DataFrame]:
    """Findings on the root's manifest, lock file (packages in over `versions` versions) and README, and diagnostics for files that can't be parsed."""
    problems, deps, package, packages, manifest, at = [], [], {}, [], False, 1
    for name in ("Cargo.toml", "Cargo.lock"):
        try:
            text = open(os.path.join(root, name), encoding="utf-8").read()
            if name == "Cargo.toml":
                manifest, package, deps = True, tomllib.loads(text).get("package", {}), dependencies(text)
                at = next((k for k, line in enumerate(text.split("\n"), 1) if line.strip() == "[package]"), 1)
            else:
                packages = locked_packages(text)
        except FileNotFoundError:
            continue
        except (ValueError, KeyError) as error:
            problems.append(("manifest-parse-error" if name == "Cargo.toml" else "lockfile-parse-error", str(error), name))
    about = spark.createDataFrame([(k, *d) for k, d in enumerate(deps)], f"seq int, {DEPENDENCY}").withColumn("file_path", F.lit("Cargo.toml"))
    about = about.withColumn("wild", F.coalesce(F.exists(F.split("requirement", ","), lambda p: (F.trim(p) == "*") | F.trim(p).endswith(".*")), F.lit(False)))
    blank = "(rev is null or trim(rev) = '')"
    rules = [
        Rule("dependency.git-source", "security", "warning", "high", "git is not null", "concat('Dependency `', name, '` in `', section, '` uses a git source.')", metadata="to_json(named_struct('section', section, 'git', git))"),
        Rule("dependency.git-unpinned-revision", "security", "warning", "high", f"git is not null and {blank}", "concat('Git dependency `', name, '` is not pinned to a revision.')"),
        Rule("dependency.path-source", "security", "advisory", "high", "path is not null", "concat('Dependency `', name, '` in `', section, '` uses a local path source.')", metadata="to_json(named_struct('section', section, 'path', path))"),
        Rule("dependency.wildcard-version", "security", "warning", "high", "wild", "concat('Dependency `', name, '` in `', section, '` uses wildcard version `', requirement, '`.')", metadata="to_json(named_struct('section', section, 'requirement', requirement))"),
    ]
    out = _found(about, rules, 0)
    locked = spark.createDataFrame(packages, "name string, version string, line int, source string")
    many = P.duplicate_versions(locked, versions).withColumns({"file_path": F.lit("Cargo.lock"), "seq": F.lit(0)})
    out = out.unionByName(_found(many, [Rule("dependency.duplicate-locked-version", "security", "advisory", "high", "true", f"concat('Package `', name, '` is locked at ', size(versions), ' versions, above the threshold of {versions}.')", metadata="to_json(named_struct('versions', versions))")], 0))
    readme = any(n.lower() == "readme.md" for n in os.listdir(root))
    gaps = [k for k in ("description", "license") if manifest and not str(package.get(k, "")).strip()]
    facts = spark.createDataFrame([("Cargo.toml", at, 0, package.get("name") or "package", ", ".join(gaps), readme)], "file_path string, line int, seq int, name string, gaps string, readme boolean")
    whole = [
        Rule("dependency.missing-package-metadata", "documentation", "advisory", "high", "gaps <> ''", "concat('Package `', name, '` is missing Cargo metadata: ', gaps, '.')", metadata="to_json(named_struct('missing', split(gaps, ', ')))"),
        Rule("docs.missing-readme", "documentation", "advisory", "high", "not readme", "'Project root does not contain a README.md file.'", "null"),
    ]
    missing = _found(facts, whole, 0).withColumn("file_path", F.when(F.col("rule_id") == "docs.missing-readme", "README.md").otherwise(F.col("file_path")))
    return out.unionByName(missing), spark.createDataFrame(problems, "diagnostic_type string, message string, file_path string")
