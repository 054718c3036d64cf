"""Facts read from the node table of Rust sources by joins: bindings, literal bodies, shadowed functions, live guards.

A node's subtree is an interval of node numbers, so containment is an interval test; joins are equi joins on the file and
the function, parent or block besides it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintlake.operators import text_rules


def children(nodes: DataFrame, *kinds: str) -> DataFrame:
    """Nodes of some kinds as c_node, c_kind, c_text, c_whole... with file_path and the `node` that is their parent."""
    kept = nodes.filter(F.col("kind").isin(*kinds)).filter("parent >= 0")
    return kept.select("file_path", F.col("parent").alias("node"), *(F.col(c).alias(f"c_{c}") for c in ("node", "past", "kind", "text", "line", "whole")))


def bindings(nodes: DataFrame) -> DataFrame:
    """file_path, line, name, seq of every name that a `let`, a `for`, a parameter or a closure's input binds."""
    return nodes.filter("kind = 'binding'").select("file_path", "line", F.col("text").alias("name"), F.col("node").alias("seq"))


def literal_bodies(nodes: DataFrame) -> DataFrame:
    """file_path and at of functions whose whole body is one trailing array, struct, `vec!` or `match` of pure arms.

    An arm is pure unless it is a block with statements in it.
    """
    body = nodes.filter("kind = 'fn'").select("file_path", "node", "at").join(children(nodes, "block"), ["file_path", "node"])
    body = body.select("file_path", F.col("c_node").alias("node"), F.col("at").alias("fn_at"))
    parts = children(nodes, "let", "stmt", "tail", "item", "fn").groupBy("file_path", "node").agg(F.count("*").alias("n"), F.max("c_kind").alias("kind"), F.max("c_node").alias("tail"))
    single = body.join(parts.filter("n = 1 and kind = 'tail'"), ["file_path", "node"]).select("file_path", F.col("tail").alias("node"), "fn_at")
    shape = single.join(children(nodes, "array", "struct", "macro", "match").filter("c_whole and (c_kind <> 'macro' or c_text = 'vec')"), ["file_path", "node"])
    arms = nodes.filter("kind = 'arm'").select("file_path", "node", F.col("parent").alias("match"))
    busy = arms.join(children(nodes, "block").filter("c_whole and c_past > c_node + 1"), ["file_path", "node"]).select("file_path", "match").distinct()
    kept = shape.join(busy, (shape.file_path == busy.file_path) & (shape.c_node == busy["match"]), "left_anti")
    return kept.select("file_path", F.col("fn_at").alias("at"))


def shadowed_functions(nodes: DataFrame, items: DataFrame) -> DataFrame:
    """file_path, line, name, seq of `let x = x(...)` where x is a function of the file that stands in no impl or trait."""
    lets = nodes.filter("kind = 'let' and text <> ''").select("file_path", "node", F.col("text").alias("name"))
    calls = children(nodes, "call").filter("c_whole").select("file_path", "node", F.col("c_text").alias("name"))
    free = items.filter("kind = 'function' and within = ''").select("file_path", "name").distinct()
    bound = children(nodes, "binding").select("file_path", "node", F.col("c_line").alias("line"))
    return lets.join(calls, ["file_path", "node", "name"]).join(free, ["file_path", "name"]).join(bound, ["file_path", "node"]).select("file_path", "line", "name", F.col("node").alias("seq"))


def guards_across_await(nodes: DataFrame) -> DataFrame:
    """file_path, at and guard of functions, with the first guard that is live at an await.

    A guard is what a one-line `let` binds to a lock()'s, read()'s or write()'s result. It lives from the next line to the
    end of its block or to the line of a `drop` of its name, whichever comes first, wherever in the function that stands;
    a later binding of the same name doesn't end it. The first await after the guard's line decides.
    """
    lets = nodes.filter("kind = 'let' and text <> '' and line = end_line").select("file_path", "fn", "block", "node", "past", "line", F.col("text").alias("guard"))
    locks = nodes.filter("kind = 'method' and text in ('lock', 'read', 'write')").select("file_path", "fn", F.col("node").alias("m"))
    guards = lets.join(locks, ["file_path", "fn"]).filter("m > node and m < past").drop("m").distinct()
    ends = nodes.filter("kind = 'block'").select("file_path", F.col("node").alias("block"), F.col("past").alias("block_past"))
    guards = guards.join(ends, ["file_path", "block"])
    inside = nodes.select("file_path", "fn", F.col("node").alias("e"), F.col("line").alias("e_line"), "kind", F.col("text").alias("e_text"), "parent")
    awaits = inside.filter("kind = 'await'").select("file_path", "fn", "e", "e_line", F.lit(None).cast("string").alias("dropped"))
    named = inside.filter("kind = 'name'").select("file_path", "fn", F.col("parent").alias("node"), "e", "e_line", F.col("e_text").alias("dropped"))
    drops = named.join(nodes.filter("kind = 'call' and text = 'drop'").select("file_path", "node"), ["file_path", "node"]).drop("node")
    seen = guards.join(awaits.unionByName(drops), ["file_path", "fn"]).filter("e > node and e_line > line")
    key = ["file_path", "fn", "node", "guard"]
    first = seen.groupBy(*key).agg(F.min(F.when(F.col("dropped").isNull() & (F.col("e") < F.col("block_past")), F.col("e_line"))).alias("awaited"), F.min(F.when(F.col("dropped") == F.col("guard"), F.col("e_line"))).alias("gone"))
    held = first.filter("awaited is not null and (gone is null or gone > awaited)").groupBy("file_path", "fn").agg(F.min_by("guard", "node").alias("guard"))
    functions = nodes.filter("kind = 'fn'").select("file_path", F.col("node").alias("fn"), "at")
    return held.join(functions, ["file_path", "fn"]).select("file_path", "at", "guard")


# Names of arguments that are taken to be safe.
SAFE_ARGUMENTS = (
    "self", "root", "cwd", "tmp", "tempdir", "temp_dir", "out", "out_dir", "outdir", "manifest_dir", "prefix", "safe", "sanitized", "normalized", "validated",
    "file_name", "filename", "display_path",
)
# How a path is made of a plain name, and how far above and below its line a guard may stand.
_CONSTRUCTOR = r"\b(?:Path|PathBuf)\s*::\s*(?:new|from)\s*\(\s*&?\s*([a-z_][a-z0-9_]*)\s*\)"
_JOIN = r"\.join\s*\(\s*&?\s*([a-z_][a-z0-9_]*)\s*\)"
_ABOVE, _ABOVE_LET, _ABOVE_LOOP, _BELOW = 30, 4, 3, 25


def _places(table: DataFrame, pattern: str, order: int) -> DataFrame:
    """file_path, lines (of the code), line, argument, order and seq of every match. Only files with a match bring their lines."""
    hits = text_rules.custom_matches(table, pattern, "code")
    hits = hits.select("file_path", F.col("first_line").alias("line"), F.regexp_extract("matched", pattern, 1).alias("argument"), F.lit(order).alias("order"), F.col("match_index").alias("seq"))
    return hits.join(table.filter(F.col("code").rlike(pattern)).select("file_path", F.split("code", "\n", -1).alias("lines")), "file_path")


def path_traversals(table: DataFrame) -> DataFrame:
    """file_path, line, name, seq where a path is made of a plain name, one a line, that nothing nearby makes safe.

    Safe are the names of `SAFE_ARGUMENTS`; a parameter of a path type in the lines above; a loop's variable over a literal
    array; a name bound to a literal; an argument of a validating call, or one asked for `contains`, above; and
    code that is canonicalised and compared by its start below.
    """
    found = _places(table, _CONSTRUCTOR, 0).unionByName(_places(table, _JOIN, 1))
    window = lambda above: F.slice("lines", F.greatest(F.col("line") - above, F.lit(1)), F.least(F.col("line"), F.lit(above + 1)))
    wide, name = F.array_join(window(_ABOVE), "\n"), F.col("argument")
    # Only what follows the first `name:` of a line is looked at.
    typed = F.expr(
        f"exists(slice(lines, greatest(line - {_ABOVE}, 1), least(line, {_ABOVE + 1})), x -> contains(x, concat(argument, ':')) and "
        r"substring(x, locate(concat(argument, ':'), x) + length(argument) + 1) rlike '^\\s*(?:&?Path|&?impl AsRef<Path>)')"
    )
    looped = F.exists(window(_ABOVE_LOOP), lambda x: F.regexp_like(x, F.concat(F.lit(r"^\s*for "), name, F.lit(r"\s*in \s*&?\["))))
    literal = F.regexp_like(F.array_join(window(_ABOVE_LET), "\n"), F.concat(F.lit(r"^(?:(?!let "), name, F.lit(r")[\s\S])*let "), name, F.lit(r"\s*(?::[^=]*)?=\s*;")))
    checked = F.regexp_like(wide, F.concat(F.lit(r"(?:validate|verify|sanitize|check)_\w+\s*\([^)]*\b"), name, F.lit(r"\b[^)]*\)|if\s+"), name, F.lit(r"\s*\.\s*contains\s*\(")))
    below = F.array_join(F.slice("lines", F.col("line"), F.lit(_BELOW)), "\n")
    trusted = below.contains(".canonicalize(") & below.contains(".starts_with(")
    left = found.filter(~name.isin(*SAFE_ARGUMENTS) & ~typed & ~looped & ~literal & ~checked & ~trusted)
    nth = F.row_number().over(Window.partitionBy("file_path", "line").orderBy("order", "seq"))
    return left.withColumn("nth", nth).filter("nth = 1").select("file_path", "line", F.col("argument").alias("name"), F.col("line").alias("seq"))
