"""Project-wide rules: grouped counts over modules, items, packages and identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def module_fan_out(modules: DataFrame, threshold: int = 8) -> DataFrame:
    """file_path, declared, line where a file declares over `threshold` modules outside cfg, main.rs aside."""
    counted = modules.filter("not cfg_gated").filter(~F.col("file_path").rlike(r"(^|/)main\.rs$"))
    return counted.groupBy("file_path").agg(F.count("*").alias("declared"), F.min("line").alias("line")).filter(F.col("declared") > threshold)


def _by_module(items: DataFrame, threshold: int) -> DataFrame:
    kept = items.filter("not cfg_gated and not test_context")
    return kept.groupBy("file_path", "module_path").agg(F.count("*").alias("items"), F.min("line").alias("line")).filter(F.col("items") > threshold)


def public_surface(items: DataFrame, threshold: int = 12) -> DataFrame:
    """Modules with over `threshold` public items that are no methods."""
    return _by_module(items.filter("public and kind <> 'method'"), threshold)


def large_modules(items: DataFrame, threshold: int = 25) -> DataFrame:
    """Modules with over `threshold` items."""
    return _by_module(items, threshold)


def duplicate_versions(packages: DataFrame, threshold: int = 2) -> DataFrame:
    """name, versions (sorted), line of packages locked in over `threshold` versions."""
    found = packages.groupBy("name").agg(F.sort_array(F.collect_set("version")).alias("versions"), F.min("line").alias("line"))
    return found.filter(F.size("versions") > threshold)


def identifiers(text: Column) -> Column:
    """Identifiers of a text, repeats included."""
    return F.regexp_extract_all(text, F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))


def reference_source(code: Column, content: Column) -> Column:
    """Code with the names that only attributes hold: of functions in serde's `default = "..."`."""
    attributes = F.regexp_extract_all(content, F.lit(r"(?s)#\s*\[\s*serde\s*\((.*?)\)\s*\]"), F.lit(1))
    names = F.transform(attributes, lambda a: F.regexp_extract_all(a, F.lit(r'\bdefault\s*=\s*"([A-Za-z_][A-Za-z0-9_:]*)"'), F.lit(1)))
    return F.concat_ws(" ", code, F.array_join(F.flatten(names), " "))


def file_module(file_path: Column) -> Column:
    """The module path that a file below `src/` stands for; empty for the root files and for files elsewhere."""
    inner = F.regexp_replace(F.regexp_extract(file_path, "^src/(.*)$", 1), r"/mod\.rs$|\.rs$", "")
    return F.when(file_path.isin("src/lib.rs", "src/main.rs"), "").otherwise(F.replace(inner, F.lit("/"), F.lit("::")))


def in_modules(items: DataFrame) -> DataFrame:
    """Items whose `module_path` is that of the file and of the inline modules around them."""
    own, outer = F.col("module_path"), file_module(F.col("file_path"))
    return items.withColumn("module_path", F.when(own == "", outer).when(outer == "", own).otherwise(F.concat_ws("::", outer, own)))


def identifier_counts(sources: DataFrame, text: str = "content") -> DataFrame:
    """identifier, n over all sources."""
    return sources.select(F.explode(identifiers(F.col(text))).alias("identifier")).groupBy("identifier").agg(F.count("*").alias("n"))


def call_names(text: Column, opens: str = r"\(") -> Column:
    """Names that stand before an opening bracket (what the pattern `opens` matches), keywords aside."""
    names = F.regexp_extract_all(text, F.lit(rf"\b([A-Za-z_][A-Za-z0-9_]*)\s*{opens}"), F.lit(1))
    return F.filter(names, lambda n: ~n.isin("if", "for", "while", "match", "loop", "return", "fn"))


def unused_items(items: DataFrame, counts: DataFrame) -> DataFrame:
    """Private items outside cfg and tests, other than methods and main, whose name occurs once at most."""
    own = items.filter("not public and not cfg_gated and not test_context and kind <> 'method' and name <> 'main'")
    return own.join(counts, own.name == counts.identifier, "left").filter("coalesce(n, 0) <= 1").drop("identifier")


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """`df` in a global order with its row numbers `nth`, from 1.

    Rows are range-partitioned and sorted by task; a task's first number is the count of the rows before it, of which only one
    row a task reaches the driver. Give a total order. The sorted rows are persisted, as they are counted and then
    numbered; `unpersist` the result's parts by `spark.catalog.clearCache()` or by the end of the session.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}).persist()
    starts, before = [], 1
    for part, n in sorted(tuple(r) for r in ranged.groupBy("_part").count().collect()):
        starts.append((part, before))
        before += n
    begun = df.sparkSession.createDataFrame(starts, "_part int, _start bigint")
    return ranged.join(F.broadcast(begun), "_part").withColumn("nth", F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def calls(sources: DataFrame, text: str = "content", opens: str = r"\(") -> DataFrame:
    """file_path, name, line: each name that a file calls, and the first line on which it does. Lines are counted from 1."""
    lines = sources.select("file_path", F.posexplode(F.split(text, "\n", -1)).alias("at", "line_text"))
    named = lines.select("file_path", (F.col("at") + 1).alias("line"), F.explode(call_names(F.col("line_text"), opens)).alias("name"))
    return named.groupBy("file_path", "name").agg(F.min("line").alias("line"))


def index(table: DataFrame, items: DataFrame) -> dict[str, DataFrame]:
    """The project's modules, items, calls and sources, each numbered in the order in which reports list them.

    `table` has file_path and code, `items` those of `in_modules`.
    """
    modules, own = items.filter("kind = 'mod'"), items.filter("kind <> 'mod'")
    path = F.when(F.col("module_path") == "", F.col("name")).otherwise(F.concat_ws("::", "module_path", "name"))
    return {
        "modules": numbered(modules.withColumn("module_path", path).select("file_path", "module_path", "line", "public", "inline", "cfg_gated"), "file_path", "line", "module_path"),
        "items": numbered(own.select("file_path", "module_path", "name", "kind", "line", "public", "externally_public", "cfg_gated", "test_context"), "file_path", "line", "name", "kind"),
        "calls": numbered(calls(table, "code"), "file_path", "line", "name"),
        "sources": numbered(table.select("file_path", F.octet_length("code").alias("bytes")), "file_path"),
    }
