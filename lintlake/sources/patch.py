"""Unified diffs and explicit ranges as the changed lines that the diff operators read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_HUNK = re.compile(r"@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@")
_ESCAPE = re.compile(rb"\\([0-7]{3}|.)")
_NAMED = {b"n": b"\n", b"t": b"\t", b"r": b"\r"}


def unquoted(path: str) -> str:
    """A path as git writes it, with octal escapes if quoted."""
    if not path.startswith('"'):
        return path.split("\t")[0]
    plain = lambda m: bytes([int(m[1], 8)]) if len(m[1]) == 3 else _NAMED.get(m[1], m[1])
    return _ESCAPE.sub(plain, path.strip('"').encode()).decode("utf-8", "replace")


def parse_patch(text: str) -> tuple[list[tuple[str, int]], list[str]]:
    """(file, line) of the new lines of every hunk, and the files of the patch. A file's deletions alone change no line.

    Lines inside a hunk are counted, so content that looks like a header is content. A patch with neither a hunk
    nor a file is an error.
    """
    lines, files, file, at, left = [], [], None, 0, 0
    for line in text.split("\n"):
        line = line.removesuffix("\r")
        if left > 0 and line[:1] in ("+", " "):
            if line[0] == "+":
                lines.append((file, at))
            at, left = at + 1, left - 1
        elif left > 0 and line[:1] in ("-", "\\"):
            continue
        elif line.startswith("+++ "):
            path = unquoted(line[4:])
            file = None if path == "/dev/null" else re.sub(r"^(?:b/)?(?:\./)?", "", path)
            if file is not None:
                files.append(file)
        elif (m := _HUNK.match(line)) and file is not None:
            at, left = int(m[1]), int(m[2] or 1)
    if text.strip() and not files:
        raise ValueError("the patch names no file")
    return [x for x in lines if x[0] is not None], files


def parse_ranges(text: str) -> list[tuple[int, int]]:
    """`a-b,c` as pairs."""
    out = []
    for part in text.split(","):
        m = re.fullmatch(r"\s*(\d+)(?:\s*-\s*(\d+))?\s*", part)
        low, high = (int(m[1]), int(m[2] or m[1])) if m else (0, 0)
        if not 0 < low <= high:
            raise ValueError(f"{part!r} is no range of lines")
        out.append((low, high))
    return out


def patch_tables(spark: SparkSession, text: str, whole_files: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """changed_lines (file_path, line) and changed_files (file_path, whole_file)."""
    lines, files = parse_patch(text) if text.strip() else ([], [])
    rows = [(f, False) for f in files] + [(f, True) for f in whole_files]
    return spark.createDataFrame(lines, "file_path string, line int"), spark.createDataFrame(rows, "file_path string, whole_file boolean")
