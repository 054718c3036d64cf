"""Rules on text lines: lengths, patterns, line windows. All are built-in expressions, partitioned by file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ASSIGNMENT = r"""(?i)(password|passwd|secret|token|api_?key)["']?\s*[:=]\s*["']?[A-Za-z0-9+/_.=-]{8,}"""


def line_array(text: Column) -> Column:
    """Lines of a text: a last line end opens no further line."""
    parts = F.split(text, "\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def lines(sources: DataFrame) -> DataFrame:
    """file_path, line (from 1), text of every line."""
    found = sources.select("file_path", F.posexplode(F.split("content", "\n", -1)).alias("at", "text")).filter("text <> '' or at > 0")
    return found.select("file_path", (F.col("at") + 1).alias("line"), "text")


def file_length(sources: DataFrame, threshold: int = 600) -> DataFrame:
    """file_path, lines of texts with more lines than the threshold."""
    return sources.select("file_path", F.size(line_array(F.col("content"))).alias("lines")).filter(F.col("lines") > threshold)


def assignment_hits(sources: DataFrame) -> DataFrame:
    """file_path, hits: assignments of a value of eight characters or more to a secret-like name."""
    return sources.select("file_path", F.regexp_count("content", F.lit(ASSIGNMENT)).cast("bigint").alias("hits")).groupBy("file_path").agg(F.sum("hits").alias("hits")).filter("hits > 0")


def custom_matches(sources: DataFrame, pattern: str, text: str = "content") -> DataFrame:
    """file_path, match_index, matched, first_line, start_byte of every match of a pattern, in order.

    `first_line` is the line of the first character of the match that isn't blank.
    """
    whole = F.regexp_extract_all(F.col(text), F.lit(f"({pattern})"), F.lit(1))
    gaps = F.split(text, pattern, -1)
    hits = sources.filter(F.col(text).rlike(pattern)).select("file_path", gaps.alias("gaps"), whole.alias("all"), F.posexplode(whole).alias("match_index", "matched"))
    before = [F.array_join(F.slice(c, F.lit(1), n), "") for c, n in (("gaps", F.col("match_index") + 1), ("all", F.col("match_index")))]
    ends = sum((F.regexp_count(x, F.lit("\n")) for x in (*before, F.regexp_extract("matched", r"^\s*", 0))), F.lit(1))
    start = sum((F.octet_length(x) for x in before), F.lit(0))
    return hits.select("file_path", "match_index", "matched", ends.alias("first_line"), start.alias("start_byte"))


def after_exit(found: DataFrame, pattern: str = r"\b(return|panic!|todo!|unimplemented!)", end: str = ";") -> DataFrame:
    """Lines that are neither empty nor a closing brace, right after a line that has the pattern and ends in `end`."""
    before = F.lag("text").over(Window.partitionBy("file_path").orderBy("line"))
    marked = found.withColumn("before", before).filter(F.col("before").endswith(end) & F.col("before").rlike(pattern))
    return marked.filter(~F.trim("text").isin("", "}")).select("file_path", "line", "text")


def near(found: DataFrame, trigger: Column, mark: Column, above: int) -> DataFrame:
    """Lines with the trigger, and `near`: whether the mark is on them or up to `above` lines higher."""
    frame = Window.partitionBy("file_path").orderBy("line").rowsBetween(-above, 0)
    return found.withColumn("near", F.max(mark).over(frame)).filter(trigger)


def first_of_each(found: DataFrame, pattern: str) -> DataFrame:
    """file_path, primitive, line: where each matched word first stands in each file."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(1))
    return found.select("file_path", "line", F.explode(words).alias("primitive")).groupBy("file_path", "primitive").agg(F.min("line").alias("line"))
