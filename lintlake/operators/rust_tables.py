"""Tables of Rust sources: one pass of the scanner over each file, then plain DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from lintlake.functions.rust_source import Scan, byte_masks, comment_scope, loop_code

_ABOUT = "name string, line int, module_path string, public boolean, externally_public boolean, cfg_gated boolean, test_context boolean, documented boolean, within string"
BLOCK = (
    _ABOUT + ", at int, start_line int, line_count int, params array<string>, body string, masked_body string, code_body string, loop_body string, is_test boolean, is_async boolean, "
    "is_unsafe boolean, returns_bool boolean, returns_result boolean, returns boolean, ignored boolean"
)
PARSED = {
    "blocks": f"array<struct<{BLOCK.replace(' ', ':').replace(',:', ',')}>>",
    "items": f"array<struct<{(_ABOUT + ', kind string, inline boolean').replace(' ', ':').replace(',:', ',')}>>",
    "fields": "array<struct<name:string,line:int>>",
    "comments": "array<struct<line:int,text:string,is_doc:boolean>>",
    "nodes": "array<struct<node:int,past:int,parent:int,kind:string,text:string,line:int,end_line:int,at:int,whole:boolean,fn:int,block:int>>",
}
_SCHEMA = "file_path string, content string, masked string, code string, comment_text string, error string, " + ", ".join(f"{k} {v}" for k, v in PARSED.items())
_SCAN_BYTES = 256 << 10  # of text; the rows of its nodes take some hundred times as much in Python


def _in_parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, in parts of about `_SCAN_BYTES` of content, or of one file that is larger."""
    low, held = 0, 0
    for k, size in enumerate(pc.binary_length(batch["content"]).to_pylist()):
        if k > low and held + (size or 0) > _SCAN_BYTES:
            yield batch.slice(low, k - low)
            low, held = k, 0
        held += size or 0
    if low < batch.num_rows:
        yield batch.slice(low)


def parsed(sources: DataFrame) -> DataFrame:
    """file_path, content, masked, code, comment_text, error, and the arrays of `PARSED`, for every Rust source (file_path, content).

    A file whose brackets don't match, or are nested too deeply, has an error and no items; its text columns are there all the same.
    Rows come in small batches, so that a worker's memory follows from the largest file and not from the number of files.
    """
    schema = StructType.fromDDL(_SCHEMA)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {f.name: to_arrow_type(f.dataType) for f in schema}
        for batch in (part for whole in batches for part in _in_parts(whole)):
            rows = []
            for path, text in zip(batch["file_path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                s = Scan(text or "")
                for b in s.blocks:
                    b["loop_body"] = loop_code(b["code_body"])
                kept, code = (s.masked, s.code) if s.text.isascii() else byte_masks(s.text)
                comments = [dict(zip(("line", "text", "is_doc"), c, strict=True)) for c in s.comments]
                rows.append((path, text, kept, code, comment_scope(s.text), s.error, s.blocks, s.items, s.fields, comments, s.nodes))
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))

    return sources.select("file_path", "content").mapInArrow(scan, schema)


def exploded(table: DataFrame, what: str) -> DataFrame:
    """Rows of one of the arrays, with file_path and their place `seq`."""
    return table.select("file_path", F.posexplode(what).alias("seq", "x")).select("file_path", "seq", "x.*")


def code_lines(table: DataFrame) -> DataFrame:
    """file_path, line, text, masked, code of every line."""
    zipped = F.arrays_zip(*(F.split(F.regexp_replace(c, "\r", ""), "\n", -1).alias(c) for c in ("content", "masked", "code")))
    found = table.select("file_path", F.posexplode(zipped).alias("at", "x"))
    return found.select("file_path", (F.col("at") + 1).alias("line"), F.col("x.content").alias("text"), F.col("x.masked").alias("masked"), F.col("x.code").alias("code"))
