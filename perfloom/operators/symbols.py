"""Ids, predicates and small relations of code symbols: expressions, and joins on keys that are made in the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def class_and_name(qualname: Column) -> Column:
    """struct(class, name) of `Class.name`; null for closures, bare names, and where a side is empty."""
    parts = F.struct(F.regexp_extract(qualname, r"(?s)^(.+)\.([^.]+)$", 1).alias("class"), F.regexp_extract(qualname, r"(?s)^(.+)\.([^.]+)$", 2).alias("name"))
    return F.when(~qualname.contains("<locals>") & qualname.rlike(r"(?s)^.+\.[^.]+$"), parts)


def node_id(file: Column, name: Column, qualname: Column) -> Column:
    """`file::class::name` where the qualified name has a class, else `file::name`; a null file is empty."""
    own, path = class_and_name(qualname), F.coalesce(file, F.lit(""))
    return F.when(own.isNotNull(), F.concat_ws("::", path, own["class"], own["name"])).otherwise(F.concat_ws("::", path, F.coalesce(name, F.lit(""))))


def is_accessor(name: Column) -> Column:
    """get, set or is before an upper-case letter, in names of four characters or more."""
    return (F.length(name) >= 4) & name.rlike(r"^(get|set|is)[A-Z]")


def share(part: Column, total: Column) -> Column:
    """Percent, 0 where the total is 0."""
    return F.when(total == 0, F.lit(0.0)).otherwise(part / total * 100)


def in_scope(rows: DataFrame, changed: DataFrame | None, column: str = "file") -> DataFrame:
    """Rows whose file is a changed path, or ends in one at a component; all rows without a list.

    A file's suffixes are exploded, as many as its components, so the join is an equi-join; rows keep their number.
    """
    if changed is None:
        return rows
    path = F.regexp_replace(F.col(column), r"^(\./)+", "")
    parts = F.split(path, "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    files = rows.select(column).filter(F.length(column) > 0).distinct()
    wanted = changed.select(F.regexp_replace("path", r"^(\./)+", "").alias("_end")).filter("_end <> ''").distinct()
    hit = files.select(column, F.explode(ends).alias("_end")).join(wanted, "_end", "left_semi").select(column).distinct()
    return rows.join(hit, column, "left_semi")


def merge_suggestions(first: DataFrame, second: DataFrame) -> DataFrame:
    """All rows of the first, and those of the second at places (file, line) that the first leaves free."""
    taken = first.select("file", "line").distinct()
    return first.unionByName(second.join(taken, ["file", "line"], "left_anti").select(*second.columns))


def level_view(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, level: the smallest) and distinct edges (src, dst) of root-first arrays `path`."""
    nodes = paths.select(F.posexplode("path").alias("level", "id")).groupBy("id").agg(F.min("level").alias("level"))
    steps = paths.filter(F.size("path") > 1).select(F.explode(F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("src"), F.slice("path", 2, F.size("path") - 1).alias("dst"))).alias("e"))
    return nodes, steps.select("e.src", "e.dst").distinct()


def cross_file_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct pairs of files that an edge joins."""
    a, b = nodes.select(F.col("id").alias("src"), F.col("file").alias("src_file")), nodes.select(F.col("id").alias("dst"), F.col("file").alias("dst_file"))
    return edges.join(a, "src").join(b, "dst").filter("src_file <> dst_file").select("src_file", "dst_file").distinct()


def subtree_shares(tree: DataFrame) -> DataFrame:
    """Rows of a call tree (path, depth, value_us) with their percent of all roots and of their parent."""
    parent = F.when(F.col("depth") > 1, F.regexp_replace("path", r";[^;]*$", ""))
    total = tree.filter("depth = 1").agg(F.sum("value_us").alias("total"))
    above = tree.select(F.col("path").alias("_parent"), F.col("value_us").alias("_above"))
    joined = tree.withColumn("_parent", parent).join(above, "_parent", "left").crossJoin(F.broadcast(total))
    of_all = share(F.col("value_us"), F.col("total"))
    return joined.select("path", "value_us", of_all.alias("percent_total"), F.coalesce(share(F.col("value_us"), F.col("_above")), of_all).alias("percent_parent"))


def icicle(tree: DataFrame) -> DataFrame:
    """Rows (path, x, width): x is the sum of the earlier siblings' widths, siblings by path."""
    parent = F.when(F.col("depth") > 1, F.regexp_replace("path", r";[^;]*$", "")).otherwise(F.lit(""))
    ahead = Window.partitionBy("_parent").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    return tree.withColumn("_parent", parent).select("path", F.coalesce(F.sum("value_us").over(ahead), F.lit(0)).cast("long").alias("x"), F.col("value_us").alias("width"))


def windowed_stacks(samples: DataFrame, window_us: int, expected: int) -> DataFrame:
    """Rows (start_us, stack, n) by window; a window with fewer samples than expected has the rest as `unknown`."""
    start = F.expr(f"time_us div {window_us} * {window_us}")
    counted = samples.filter("time_us is not null").groupBy(start.alias("start_us"), "stack").agg(F.sum("n").alias("n"))
    short = counted.groupBy("start_us").agg((F.lit(expected) - F.sum("n")).alias("n")).filter("n > 0")
    return counted.unionByName(short.select("start_us", F.lit("unknown").alias("stack"), "n"))


def facet_counts(declared: DataFrame, present: DataFrame) -> DataFrame:
    """Distinct ids by kind, of ids that are present."""
    return declared.join(present.select("id").distinct(), "id", "left_semi").groupBy("kind").agg(F.countDistinct("id").alias("n"))
