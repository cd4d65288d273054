"""Roots of a call graph, call trees below them, and what is read off the trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import is_private, is_synthetic, is_test_path
from .graph import dealt, reach, settle
from .reaching import reach_sizes
from .symbols import in_scope, is_accessor

MAX_DEPTH, MIN_REACH, MAX_ROOTS, LEAST_NODES = 12, 2, 200, 300
#: Callees of a node from which on a list is not cut: a budget so wide bounds nothing.
MOST_CALLEES = 100_000


def root_candidates(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Symbols (id, name, kind, file) that may be entry points: no class, no real caller, neither accessor, private nor a test's.

    A `<module>` that calls a function at load time is no real caller.
    """
    real = edges.join(symbols.filter(is_synthetic(F.col("name"))).select(F.col("id").alias("src")), "src", "left_anti")
    called = real.select(F.col("dst").alias("id")).distinct()
    fit = (F.col("kind") != "class") & ~is_accessor(F.col("name")) & ~is_private(F.col("name")) & ~is_test_path(F.col("file"))
    return symbols.filter(fit).join(called, "id", "left_anti")


def discover(symbols: DataFrame, edges: DataFrame, least: int = MIN_REACH, most: int = MAX_ROOTS, changed: DataFrame | None = None) -> DataFrame:
    """Roots (id, name, reach) that reach `least` symbols or more, themselves included: furthest reach first, then by name.

    With changed paths, roots inside them come first.
    """
    found = root_candidates(symbols, edges)
    sizes = reach_sizes(found.select("id"), edges).withColumnRenamed("root", "id").filter(F.col("reach") >= least)
    roots = found.select("id", "name", "file").join(sizes, "id")
    inside = F.lit(0)
    if changed is not None:
        roots = roots.join(in_scope(roots, changed).select("id", F.lit(1).alias("_in")), "id", "left")
        inside = F.coalesce("_in", F.lit(0))
    return roots.select("id", "name", "reach", inside.alias("inside")).orderBy(F.desc("inside"), F.desc("reach"), "name", "id").limit(most).drop("inside")


def node_budget(total: int, roots: int) -> int:
    """A tree's fair share of the nodes."""
    return max(total // max(roots, 1), LEAST_NODES)


def expand(roots: DataFrame, symbols: DataFrame, edges: DataFrame, depth: int = MAX_DEPTH, budget: int = 1 << 30, skip_accessors: bool = False) -> DataFrame:
    """Call trees: rows (root, seq, parent, id, depth, truncated), seq from 0 in the order of a depth-first walk.

    A node that the walk has met anywhere before is a `cycle` leaf; at the depth limit a node is a `max-depth` leaf; a node that
    stops for the budget is marked `node-budget`. Callees go in the order of their edges (`ord`). The walk depends on its order, so each
    root's part of the graph, no deeper than the limit, is walked in one task. Every callee takes a row, so a budget bounds that part: only the
    first few callees of each node are fetched, and again with more of them for the roots whose walk comes to the end of a list that was cut.
    """
    kept = edges.select("src", "dst", "ord").filter("dst is not null")
    if skip_accessors:
        kept = kept.join(symbols.filter(is_accessor(F.col("name"))).select(F.col("id").alias("dst")), "dst", "left_anti")
    found, left = [], settle(roots.select("id").distinct())
    # walks that never branch again fill the budget with these; no walk comes to more callees of a node than the budget
    fan = min(-(-budget * 5 // (4 * max(depth, 1))), budget)
    while True:
        tree = _walks(left, kept, depth, budget, fan if fan < MOST_CALLEES else None)
        if fan >= MOST_CALLEES:
            found.append(tree)
            break
        tree = settle(tree)
        found.append(tree.filter("seq >= 0"))
        left = settle(tree.filter("seq < 0").select(F.col("root").alias("id")))
        if fan >= budget or left.isEmpty():
            break
        fan = min(fan * 4, budget)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.hint("shuffle_merge")


def _walks(roots: DataFrame, kept: DataFrame, depth: int, budget: int, fan: int | None) -> DataFrame:
    """The trees of `expand` over the first `fan` callees of each node; one row with seq -1 for a root whose walk would need more."""
    if fan is None:
        part_of = kept = dealt(kept.withColumn("at", F.lit(0)))
    else:
        order = Window.partitionBy("src").orderBy(F.asc_nulls_last("ord"), "dst")
        # one more tells that the list goes on
        kept = dealt(kept.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= fan + 1))
        part_of = kept.filter(F.col("at") <= fan)
    # nodes at the depth limit are leaves, so their callees are not asked
    part = reach(roots, part_of, depth - 1)
    rows = part.join(kept, F.col("id") == F.col("src"), "left").select("root", F.col("id").alias("src"), "dst", "ord", "at")

    def walk(key, group):
        import pandas as pd

        below: dict = {}
        cut = set()
        for src, dst, at in group.sort_values(["src", "ord", "dst", "at"])[["src", "dst", "at"]].itertuples(index=False):
            if fan is not None and at > fan:
                cut.add(src)
            elif isinstance(dst, str):
                below.setdefault(src, []).append(dst)
        out, met = [], set()
        # (node, depth, parent's seq): an explicit stack keeps the walk's order without recursion; a frame is an open node
        stack = [(key[0], 0, -1, None)]
        while stack:
            node, level, above, children = stack.pop()
            if children is None:
                seq = len(out)
                again = node in met
                met.add(node)
                out.append([key[0], seq, above, node, level, "cycle" if again else "max-depth" if level >= depth else None])
                if again or level >= depth:
                    continue
                children = iter(below.get(node, ()))
                above = seq
            child = next(children, None)
            if child is None and node not in cut:
                continue
            if len(out) >= budget:
                out[above][5] = "node-budget"
                continue
            if child is None:
                out = [[key[0], -1, -1, None, 0, None]]
                break
            stack.append((node, level, above, children))
            stack.append((child, level + 1, above, None))
        return pd.DataFrame(out, columns=["root", "seq", "parent", "id", "depth", "truncated"])

    return rows.groupBy("root").applyInPandas(walk, "root string, seq long, parent long, id string, depth int, truncated string")


def paths(tree: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """The tree's rows with `path`, the seqs from the root on: a join for each level, on (root, parent)."""
    tree = settle(tree)
    level = dealt(tree.filter("depth = 0").withColumn("path", F.array("seq")))
    out = level
    for d in range(1, depth + 1):
        above = level.select("root", F.col("seq").alias("parent"), F.col("path").alias("_path"))
        level = dealt(tree.filter(F.col("depth") == d).join(above, ["root", "parent"]).withColumn("path", F.concat("_path", F.array("seq"))).drop("_path"))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return dealt(out)


def subtree(walked: DataFrame) -> DataFrame:
    """Rows (root, seq, subtree_size, percent_total, percent_parent) of walked trees (with `path`)."""
    ups = walked.select("root", F.explode("path").alias("seq"))
    size = ups.groupBy("root", "seq").agg(F.count(F.lit(1)).alias("subtree_size"))
    total = size.filter("seq = 0").select("root", F.col("subtree_size").alias("_total"))
    own = walked.select("root", "seq", "parent").join(size, ["root", "seq"])
    above = size.select("root", F.col("seq").alias("parent"), F.col("subtree_size").alias("_above"))
    return own.join(above, ["root", "parent"], "left").join(total, "root").select("root", "seq", "subtree_size", (F.col("subtree_size") / F.col("_total") * 100).alias("percent_total"), (F.col("subtree_size") / F.coalesce("_above", "_total") * 100).alias("percent_parent"))


def roots_overview(walked: DataFrame, findings: DataFrame, callees: int = 5) -> DataFrame:
    """One row for each root: subtree size, its share of all roots', findings by severity over the subtree, first callees."""
    size = walked.groupBy("root").agg(F.count(F.lit(1)).alias("subtree_size"))
    total = size.agg(F.sum("subtree_size").alias("_all"))
    hits = walked.select("root", "id").join(findings.select("id", "severity"), "id").groupBy("root").agg(*[F.count(F.when(F.col("severity") == s, 1)).alias(s) for s in ("high", "medium", "low")])
    first = walked.filter("depth = 1").withColumn("_r", F.row_number().over(Window.partitionBy("root").orderBy("seq"))).filter(F.col("_r") <= callees)
    listed = first.groupBy("root").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "id"))), lambda x: x["id"]).alias("first_callees"))
    out = size.crossJoin(F.broadcast(total)).join(hits, "root", "left").join(listed, "root", "left")
    zero = [F.coalesce(s, F.lit(0)).alias(s) for s in ("high", "medium", "low")]
    return out.select("root", "subtree_size", (F.col("subtree_size") / F.col("_all") * 100).alias("percent_of_all_roots"), *zero, F.coalesce("first_callees", F.array().cast("array<string>")).alias("first_callees"))


def hot_paths(walked: DataFrame, categories: DataFrame, most: int = 10) -> DataFrame:
    """The deepest paths (root, frames, depth, category) that end at a node with a category (id, category): depth, category, frames."""
    ends = walked.join(categories, "id").select("root", "seq", "depth", "category", F.posexplode("path").alias("at", "step"))
    names = walked.select("root", F.col("seq").alias("step"), "id")
    full = ends.join(names, ["root", "step"]).groupBy("root", "seq", "depth", "category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]), ";").alias("frames"))
    return full.select("root", "frames", "depth", "category").orderBy(F.desc("depth"), "category", "frames", "root").limit(most)


def categories_reached(walked: DataFrame, externals: DataFrame) -> DataFrame:
    """Numbers of external calls by category (root, category, n) over each root's tree; a node counts at each place it has."""
    return walked.select("root", "id").join(externals.select("id", "category"), "id").groupBy("root", "category").agg(F.count(F.lit(1)).alias("n"))


def in_languages(files: DataFrame) -> Column:
    from ..functions.scalars import language

    return language(files["path"])
