"""Source trees as DataFrames: a data source whose tasks list and read folders.

The driver lists only the upper folders, until there are enough of them for the tasks; each task gets a folder with the ignore
rules of those above it, and lists and reads all below it. All executors must see the tree under the same path.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, StringStartsWith

from lintlake.functions.columns import glob_regex

# Folders that are skipped, and the text files that are read.
VERSION_FOLDERS = frozenset((".git", ".hg", ".svn"))
SKIPPED_FOLDERS = frozenset(".git .hg .svn .idea .vscode build cache coverage dist generated node_modules target tmp vendor".split())
TEXT_SUFFIXES = frozenset("bash conf config crt env gradle ini json key lock md markdown pem properties sh tf tfvars toml txt xml yaml yml".split())
TEXT_NAMES = frozenset(".dockerignore .netrc .npmrc .pypirc .yarnrc config containerfile dockerfile gnumakefile justfile makefile procfile".split())


def _ignore_rules(folder: str, base: str) -> list[tuple[re.Pattern, bool, bool]]:
    """(pattern over paths below the root, negated, folders only) of the ignore files of a folder, weakest first."""
    rules = []
    for name in (".git/info/exclude", ".gitignore", ".ignore"):
        try:
            lines = open(os.path.join(folder, name), encoding="utf-8").read().splitlines()
        except OSError:
            continue
        for line in lines:
            line = line.rstrip()
            if not line or line.startswith("#"):
                continue
            negated, line = line.startswith("!"), line.removeprefix("!")
            only_folders, glob = line.endswith("/"), line.strip("/")
            anchored = "/" in glob or line.startswith("/")
            body = glob_regex(glob if anchored or glob.startswith("**/") else f"**/{glob}").removeprefix("^")
            prefix = re.escape(f"{base}/") if base else ""
            rules.append((re.compile("^" + prefix + body), negated, only_folders))
    return rules


@dataclass
class Folder(InputPartition):
    """A folder below the root, the ignore rules of those above it, and whether what lies below it belongs to it."""

    base: str
    rules: list = field(default_factory=list)
    deep: bool = True


@dataclass(frozen=True)
class Walk:
    """What a walk leaves out: folders by name, `ignored` globs of the settings, and what ignore files list.

    Only the ignore files' own verdict can be turned round by a line with `!`. A walk that starts at a folder sees the ignore
    files from there on, and where that folder is itself ignored by the settings, the settings' globs don't count.
    """

    root: str
    start: str = ""
    ignored: tuple[str, ...] = ()
    include_ignored: bool = False
    below: tuple[str, ...] = ()

    def _by_settings(self, path: str) -> bool:
        return any(re.search(glob_regex(g), path) for g in self.ignored)

    def _verdict(self, path: str, name: str, is_folder: bool, rules: list, settings_count: bool) -> bool:
        if is_folder and name in VERSION_FOLDERS:
            return True
        if self.include_ignored:
            return False
        listed = False
        for pattern, negated, only_folders in rules:
            if pattern.search(path) and (is_folder or not only_folders):
                listed = not negated
        return listed or (is_folder and path.split("/")[0] in SKIPPED_FOLDERS) or (settings_count and self._by_settings(path))

    def _wanted(self, path: str) -> bool:
        """Whether the path, or one below it, begins as it must."""
        return not self.below or any(path.startswith(b) or b.startswith(f"{path}/") for b in self.below)

    def listed(self, at: Folder) -> tuple[list[tuple[str, bool]], list[Folder]]:
        """(path, whether it is ignored) of the files and ignored folders right in a folder, and its other folders."""
        settings_count = not (self.start and self._by_settings(self.start))
        rules = at.rules + ([] if self.include_ignored else _ignore_rules(os.path.join(self.root, at.base), at.base))
        found, folders = [], []
        with os.scandir(os.path.join(self.root, at.base)) as entries:
            for entry in sorted(entries, key=lambda e: e.name):
                path = f"{at.base}/{entry.name}" if at.base else entry.name
                is_folder = entry.is_dir(follow_symlinks=False)
                if not self._wanted(path) or not (is_folder or is_source(entry.name)):
                    continue
                ignored = self._verdict(path, entry.name, is_folder, rules, settings_count)
                if is_folder and not ignored:
                    folders.append(Folder(path, rules))
                elif not is_folder or not entry.is_symlink():
                    found.append((path, ignored))
        return found, folders

    def files(self, at: Folder) -> Iterator[tuple[str, bool]]:
        pending = [at]
        while pending:
            found, folders = self.listed(pending.pop())
            yield from found
            if at.deep:
                pending += folders

    def parts(self, enough: int) -> list[Folder]:
        """Folders that share the tree out. Only as many levels are listed as it takes to have `enough`."""
        level, done = [Folder(self.start)], []
        while level and len(level) + len(done) < enough:
            below = [f for at in level for f in self.listed(at)[1]]
            if not below:
                break
            done += [Folder(at.base, at.rules, deep=False) for at in level]
            level = below
        return done + level


class TreeReader(DataSourceReader):
    """Lists and reads folders."""

    def __init__(self, walked: Walk, enough: int, contents: bool):
        self.walk, self.enough, self.contents = walked, enough, contents

    def partitions(self) -> Sequence[InputPartition]:
        return self.walk.parts(self.enough)

    def read(self, partition: Folder) -> Iterator[tuple]:
        for path, ignored in self.walk.files(partition):
            content = None
            if self.contents and not ignored:
                with open(os.path.join(self.walk.root, path), "rb") as file:
                    content = file.read()
            yield path, ignored, content


class FilteredTreeReader(TreeReader):
    """Follows filters on the path, or on how it begins, while folders are listed."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, StringStartsWith | EqualTo) and f.attribute == ("file_path",):
                self.walk = replace(self.walk, below=(f.value,))
            yield f  # Spark tests it again: a folder may hold other paths


class TreeSource(DataSource):
    """Options: root, start (a folder below it), ignored (a JSON list of globs), includeIgnored, contents, parts, and pushdown, for sessions
    in which filters may be pushed to Python data sources."""

    @classmethod
    def name(cls) -> str:
        return "lintlake_tree"

    def schema(self) -> str:
        return "file_path string, ignored boolean, content binary"

    def reader(self, schema: object) -> TreeReader:
        o = self.options
        walked = Walk(o["root"], o.get("start", ""), tuple(json.loads(o.get("ignored", "[]"))), o.get("includeIgnored", "false") == "true")
        kind = FilteredTreeReader if o.get("pushdown", "false") == "true" else TreeReader
        return kind(walked, int(o.get("parts", "64")), o.get("contents", "true") == "true")


def tree(spark: SparkSession, root: str, start: str = "", ignored_globs: Sequence[str] = (), include_ignored: bool = False, contents: bool = True) -> DataFrame:
    """file_path, ignored, content (null of what is ignored) of the files of a tree, and its ignored folders."""
    spark.dataSource.register(TreeSource)
    options = {"root": os.path.abspath(root), "start": start, "ignored": json.dumps(list(ignored_globs)), "includeIgnored": str(include_ignored).lower(), "contents": str(contents).lower()}
    options["pushdown"] = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format(TreeSource.name()).options(**options).load()


def walk(root: str, ignored_globs: Sequence[str] = (), include_ignored: bool = False, start: str = "") -> Iterator[tuple[str, bool]]:
    """(path below the root, whether it is ignored) of every file that a scan would read or skip, and of ignored folders."""
    return Walk(root, start, tuple(ignored_globs), include_ignored).files(Folder(start))


def is_source(name: str) -> bool:
    """Rust files, and text files in which secrets are looked for."""
    lower = name.lower()
    suffix = lower.rpartition(".")[2] if "." in lower.lstrip(".") else ""
    return suffix == "rs" or suffix in TEXT_SUFFIXES or lower.startswith(".env") or lower in TEXT_NAMES


def source_files(spark: SparkSession, root: str, paths: Sequence[str] = (".",), ignored_globs: Sequence[str] = (), include_ignored: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(file_path, is_rust, content), each file once; diagnostics (diagnostic_type, message, file_path) for paths that are missing
    and files that are not UTF-8; and the ignored paths (file_path). A file named outright is read whatever is ignored."""
    problems, named, rows = [], [], []
    for path in paths:
        full = os.path.normpath(os.path.join(root, path))
        below = os.path.relpath(full, root)
        if os.path.isfile(full):
            named.append(below)
        elif os.path.isdir(full):
            rows.append(tree(spark, root, "" if below == "." else below, ignored_globs, include_ignored))
        else:
            problems.append(("missing-path", f"{path} does not exist", path))
    if named:
        read = spark.read.format("binaryFile").load([os.path.join(root, p) for p in sorted(set(named))])
        below = F.regexp_replace("path", "^file:/*" + re.escape(os.path.abspath(root).lstrip("/")) + "/", "")
        rows.append(read.select(below.alias("file_path"), F.lit(False).alias("ignored"), "content"))
    found = spark.createDataFrame([], TreeSource({}).schema())
    for part in rows:
        found = found.unionByName(part)
    found = found if len(rows) < 2 else found.dropDuplicates(["file_path", "ignored"])
    text = F.col("content").cast("string")
    kept = found.filter("not ignored").select("file_path", text.alias("text"), F.is_valid_utf8(text).alias("fine"))
    good = kept.filter("fine").select("file_path", F.lower("file_path").endswith(".rs").alias("is_rust"), F.col("text").alias("content"))
    bad = kept.filter("not fine").select(F.lit("read-error").alias("diagnostic_type"), F.lit("not UTF-8").alias("message"), "file_path")
    missing = spark.createDataFrame(problems, "diagnostic_type string, message string, file_path string")
    return good, missing.unionByName(bad), found.filter("ignored").select("file_path").distinct()
