"""Review rows: schema checks, change-set filters, tree search, trends, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def redirect_constructors(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (src, dst) whose target is a class with a constructor (id, constructor) go to the constructor; each edge once."""
    to = classes.filter("constructor is not null").groupBy("id").agg(F.min("constructor").alias("_to"))
    return edges.join(to, F.col("dst") == F.col("id"), "left").select("src", F.coalesce("_to", "dst").alias("dst")).distinct()


def on_changed_lines(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Rows (file, line) on a commentable line (path, line), paths matched by component suffix.

    A file's suffixes are exploded once for each place (file, line), so the match is an equi-join; rows keep their number.
    """
    parts = F.split(F.regexp_replace("file", r"^(\./)+", ""), "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    places = rows.select("file", "line").filter("file <> '' and line is not null").distinct()
    wanted = lines.select(F.regexp_replace("path", r"^(\./)+", "").alias("_end"), "line").distinct()
    hit = places.select("file", "line", F.explode(ends).alias("_end")).join(wanted, ["_end", "line"], "left_semi").select("file", "line").distinct()
    return rows.join(hit, ["file", "line"], "left_semi")


def tree_search(tree: DataFrame, hit: Column, separator: str = ";") -> DataFrame:
    """Rows of a tree (path, ...) that match, and all their ancestors."""
    names = F.split("path", separator)
    ups = F.transform(F.sequence(F.lit(1), F.size(names)), lambda k: F.array_join(F.slice(names, 1, k), separator))
    return tree.join(tree.filter(hit).select(F.explode(ups).alias("path")).distinct(), "path", "left_semi")


def trend(samples: DataFrame, series: str, order: list[str], value: str) -> DataFrame:
    """up, down, steady or unknown by series: the last sample against the one at n div 4, within 5 percent.

    Unknown with fewer than four samples, or where both are 0; from 0 to more is up.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(series))
    ranked = samples.select(series, value, (F.row_number().over(Window.partitionBy(series).orderBy(*order)) - 1).alias("i"), n.alias("n"))
    ends = ranked.groupBy(series, "n").agg(F.max(F.when(F.col("i") == F.expr("n div 4"), F.col(value))).alias("was"), F.max(F.when(F.col("i") == F.col("n") - 1, F.col(value))).alias("now"))
    change = (F.col("now") - F.col("was")) / F.nullif("was", F.lit(0))
    told = F.when((F.col("n") < 4) | ((F.col("was") == 0) & (F.col("now") == 0)), "unknown").when((F.col("was") == 0) & (F.col("now") > 0) | (change > 0.05), "up").when(change < -0.05, "down").otherwise("steady")
    return ends.select(series, told.alias("trend"))


def event_errors() -> Column:
    """Names of the fields of an event that are missing or out of range for its type; empty for a valid event."""

    def bad(name: str, ok: Column) -> Column:
        return F.when(~F.coalesce(ok, F.lit(False)), F.lit(name))

    kind = F.col("type")
    trace, bundle, call = kind.isin("wall_trace", "cpu_trace"), kind.isin("wall_profile", "cpu_profile"), kind == "function_call"
    checks = [
        bad("type", trace | bundle | call | (kind == "profile_metadata")),
        F.when(trace | bundle, bad("period_ns", F.col("period_ns") > 0)),
        F.when(trace, bad("count", F.col("count") > 0)),
        F.when(trace, bad("frames", F.size("frames") > 0)),
        F.when(bundle, bad("samples", F.size("samples") > 0)),
        F.when(call, bad("duration_ns", F.col("duration_ns") >= 0)),
        F.when(call, bad("qualname", F.length("qualname") > 0)),
    ]
    return F.array_compact(F.array(*checks))


def left_out(frame: Column, paths: list[str]) -> Column:
    """Whether a frame's file holds one of the path parts."""
    return F.coalesce(F.exists(F.array(*[F.lit(p) for p in paths]), lambda p: F.contains(frame["file"], p)), F.lit(False))


def sarif_results(findings: DataFrame) -> DataFrame:
    """One SARIF result as JSON for each finding (id, kind, severity, file, line, message)."""
    level = F.when(F.col("severity") == "high", "error").when(F.col("severity") == "medium", "warning").otherwise("note")
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.greatest("line", F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("kind").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"))
    return findings.select("id", F.to_json(result).alias("result"))


def dot_lines(edges: DataFrame) -> DataFrame:
    """Lines of a DOT graph's body: an edge a row, quotes and backslashes escaped."""

    def quoted(c: str) -> Column:
        return F.concat(F.lit('"'), F.regexp_replace(c, r'(["\\])', r"\\$1"), F.lit('"'))

    return edges.select(F.concat(F.lit("  "), quoted("src"), F.lit(" -> "), quoted("dst"), F.lit(";")).alias("line"))


def static_nodes(tree: DataFrame) -> DataFrame:
    """Call-tree rows (path, depth, value_us, self_us) as static-schema nodes: nanoseconds, parent and subtree size.

    Every path adds one to each of its prefixes, so sizes are one aggregate and no self-join.
    """
    names = F.split("path", ";")
    ups = F.transform(F.sequence(F.lit(1), F.size(names)), lambda k: F.array_join(F.slice(names, 1, k), ";"))
    size = tree.select(F.explode(ups).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("subtree_size"))
    name = F.element_at(names, -1)
    return tree.join(size, "path").select("path", name.alias("name"), F.when(name.contains("."), "Method").otherwise("Function").alias("kind"), (F.col("value_us") * 1000).alias("total_ns"), (F.col("self_us") * 1000).alias("self_ns"), "subtree_size")


def user_sorted(rows: DataFrame, column: str, descending: bool, key: str) -> DataFrame:
    """Rows with their `place` in the order of a column that a user chose, up or down; ties by `key`.

    Numbers compare as numbers, nulls last; texts as readers expect (by the Unicode collation, not by code point), nulls as empty texts.
    Ranges are dealt out, no task sorts all rows.
    """
    from .profile import global_rank

    kind = rows.schema[column].dataType.typeName()
    if kind == "string":
        value = F.collate(F.coalesce(column, F.lit("")), "UNICODE")
        # a collated column can't be turned round: its rank can
        ranked = global_rank(rows.select(value.alias("_v")).distinct(), ["_v"]).withColumnRenamed("rank", "_o")
        own = rows.withColumn("_v", value).join(ranked, "_v").drop("_v")
        own = own.withColumn("_o", -F.col("_o")) if descending else own
    else:
        number = F.col(column).cast("double")
        own = rows.withColumns({"_o": F.coalesce(-number if descending else number, F.lit(float("inf")))})
    return global_rank(own, ["_o", key]).drop("_o").withColumnRenamed("rank", "place")
