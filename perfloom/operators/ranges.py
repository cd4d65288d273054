"""Joins of ranges and what is built on them: ranges meet in bins, so a join is an equi-join and one file is no hot key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .profile import global_rank

#: Width of the narrowest bins, and how many times wider those of the next level are.
BIN, WIDER = 1024, 4


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], width: int = BIN) -> DataFrame:
    """Pairs of equal keys whose inclusive ranges [ls, le] and [rs, re] overlap; each pair once.

    Bins have levels, each WIDER than the one below. A range is at home in the first level whose bins are as wide as it is long, and
    in two bins of any level from there on, so its length costs nothing. A pair meets in the higher of both homes, and
    is told in the bin where the later of the two starts. Rows with a null or an end before the start meet nothing.
    """
    left, right = left.filter("ls <= le"), right.filter("rs <= re")
    spans = left.select((F.col("le") - F.col("ls")).alias("n")).union(right.select((F.col("re") - F.col("rs")).alias("n")))
    longest, levels = spans.agg(F.max("n")).first()[0] or 0, 1
    while width * WIDER ** (levels - 1) < longest + 1:
        levels += 1
    widths = [width * WIDER**k for k in range(levels)]

    def in_level(k: int, s: str, e: str, home: str) -> Column:
        bins = F.transform(F.sequence(F.floor(F.col(s) / widths[k]), F.floor(F.col(e) / widths[k])), lambda b: F.struct(F.lit(k).alias("_level"), b.alias("_bin")))
        return F.when(F.col(home) <= k, bins).otherwise(F.array().cast("array<struct<_level:int,_bin:bigint>>"))

    def binned(rows: DataFrame, s: str, e: str, home: str) -> DataFrame:
        at = F.coalesce(*[F.when(F.col(e) - F.col(s) < w, k) for k, w in enumerate(widths)])
        bins = F.flatten(F.array(*[in_level(k, s, e, home) for k in range(levels)]))
        return rows.withColumn(home, at).withColumn("_b", F.explode(bins)).select("*", "_b.*").drop("_b")

    # few rows can make many pairs, so bins are dealt to as many tasks as there may be, however small they are
    at, parts = [*keys, "_level", "_bin"], int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = binned(left, "ls", "le", "_lh").repartition(parts, *at).join(binned(right, "rs", "re", "_rh").repartition(parts, *at), at)
    wide = F.element_at(F.array(*[F.lit(w) for w in widths]), F.col("_level") + 1)
    met = both.filter("ls <= re and rs <= le and _level = greatest(_lh, _rh)").filter(F.col("_bin") == F.floor(F.greatest("ls", "rs") / wide))
    return met.drop("_bin", "_level", "_lh", "_rh")


def fuse(orm: DataFrame, sql: DataFrame) -> DataFrame:
    """ORM findings (ord, file, ls, le, confidence, severity) with the SQL findings (sid, file, rs, re, sql_confidence, sql_severity) they overlap.

    A SQL finding goes to the first ORM finding it overlaps, once. Confidence: 1 - product of (1 - c); severity: the largest.
    """
    # spans meet, not findings: of the ORM findings of a span the first counts, and the SQL findings of a span share their owner
    first = orm.groupBy("file", "ls", "le").agg(F.min("ord").alias("ord"))
    taken = overlaps(first, sql.select("file", "rs", "re").distinct(), ["file"]).groupBy("file", "rs", "re").agg(F.min("ord").alias("ord"))
    owner = sql.join(taken, ["file", "rs", "re"]).groupBy("sid", "sql_confidence", "sql_severity").agg(F.min("ord").alias("ord"))
    merged = owner.groupBy("ord").agg(F.product(F.lit(1.0) - F.col("sql_confidence")).alias("_miss"), F.max("sql_severity").alias("_worst"), F.count(F.lit(1)).alias("_n"))
    out = orm.join(merged, "ord", "left")
    return out.select("ord", (F.lit(1.0) - (F.lit(1.0) - F.col("confidence")) * F.coalesce("_miss", F.lit(1.0))).alias("confidence"), F.greatest("severity", "_worst").alias("severity"), F.coalesce("_n", F.lit(0)).cast("long").alias("fused"))


def change_status(symbols: DataFrame, files: DataFrame, hunks: DataFrame) -> DataFrame:
    """Symbols (id, file, ls, le) as unchanged, added, modified or removed, by how far hunks (file, rs, re) cover their lines.

    `files` (file, status) lists changed files: added and removed ones decide for their symbols, and so does the status of a
    file without hunks. Elsewhere all lines covered: added; some: modified; none, or no changed file: unchanged.
    """
    spans = hunks.filter("rs <= re").select("file", "rs", "re").distinct()
    # symbols of one extent are covered alike
    met = overlaps(symbols.select("file", "ls", "le").distinct(), spans, ["file"])
    clipped = met.select("file", "ls", "le", F.greatest("ls", "rs").alias("s"), F.least("le", "re").alias("e"))
    # lines past the furthest end so far are new: a running maximum in place of a list of lines
    ahead = Window.partitionBy("file", "ls", "le").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("e") - F.greatest(F.coalesce(F.max("e").over(ahead), F.col("s") - 1), F.col("s") - 1))
    extents = clipped.select("file", "ls", "le", new.alias("n")).groupBy("file", "ls", "le").agg(F.sum("n").alias("covered"))
    listed = files.join(spans.select("file").distinct().withColumn("_cut", F.lit(True)), "file", "left")
    out = symbols.join(listed, "file", "left").join(extents, ["file", "ls", "le"], "left")
    lines = F.col("le") - F.col("ls") + 1
    status = F.when(F.col("status").isNull(), "unchanged").when(F.col("status").isin("added", "removed") | F.col("_cut").isNull(), F.col("status"))
    status = status.when(F.coalesce("covered", F.lit(0)) == 0, "unchanged").when(F.col("covered") >= lines, "added").otherwise("modified")
    return out.select("id", status.alias("change"))


def deepest(findings: DataFrame, nodes: DataFrame) -> DataFrame:
    """Findings (fid, file, line) with the deepest node (node, file, line, loc, depth) over their line; ties: the smallest node."""
    places = findings.select("file", F.col("line").alias("ls"), F.col("line").alias("le")).distinct()
    spans = nodes.select("node", "file", "depth", F.col("line").alias("rs"), (F.col("line") + F.greatest("loc", F.lit(1))).alias("re"))
    # findings of one place share its node, and of the nodes of one span the deepest counts: spans are ranked by theirs
    first = F.min(F.struct((-F.col("depth")).alias("d"), "node")).alias("b")
    top = global_rank(spans.groupBy("file", "rs", "re").agg(first).select("file", "rs", "re", "b.*"), ["d", "node", "file", "rs", "re"])
    best = overlaps(places, top.select("file", "rs", "re", "rank"), ["file"]).groupBy("file", F.col("ls").alias("line")).agg(F.min("rank").alias("rank"))
    told = findings.select("fid", "file", "line").join(best, ["file", "line"]).groupBy("fid").agg(F.min("rank").alias("rank"))
    return told.join(top.select("rank", "node"), "rank").select("fid", "node")
