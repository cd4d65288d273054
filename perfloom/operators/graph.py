"""Graph operators: degrees, reachability, PageRank, recursion."""

from __future__ import annotations

import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; only a local session without it gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    master = spark.sparkContext.master
    if not folder and master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return folder or tempfile.mkdtemp(prefix="perfloom-graph-")


def settle(df: DataFrame) -> DataFrame:
    """Cuts lineage in the shared folder of spark.checkpoint.dir."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def dealt(df: DataFrame) -> DataFrame:
    """Settled rows whose joins shuffle: a size guessed from compressed files would broadcast millions of rows by way of the driver, round by round."""
    return settle(df).hint("shuffle_merge")


def page_rank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, most: int = 100) -> DataFrame:
    """Ranks (id, rank); mass of nodes without edges is shared by all; ends when ranks move less than the tolerance."""
    edges = settle(edges.select("src", "dst"))
    degree = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    # edges carry their source's degree, so a round is one join and one aggregate
    edges = settle(edges.join(degree.withColumnRenamed("id", "src"), "src"))
    # edges stay where their source's rank comes to: dealt once, kept by executors, made again from the checkpoint if one is lost
    spark = edges.sparkSession
    edges = edges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "src").persist(StorageLevel.DISK_ONLY)
    nodes = settle(nodes.select("id"))
    n = nodes.count()
    state = settle(nodes.join(degree, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"), F.lit(1.0 / max(n, 1)).alias("rank")))
    dangling = state.filter("degree = 0").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
    for _ in range(most):
        base = (1 - damping) / n + damping * dangling / n
        sent = state.filter("degree > 0").select(F.col("id").alias("src"), "rank").join(edges, "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("degree")).alias("got"))
        new = settle(state.join(sent, "id", "left").select("id", "degree", (F.lit(base) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"), F.col("rank").alias("was")))
        facts = new.agg(F.sum(F.abs(F.col("rank") - F.col("was"))).alias("moved"), F.coalesce(F.sum(F.when(F.col("degree") == 0, F.col("rank"))), F.lit(0.0)).alias("dangling")).first()
        state, dangling = new.drop("was"), facts.dangling
        if facts.moved is None or facts.moved < tolerance:
            break
    edges.unpersist()
    return state.select("id", "rank")


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def reach(seeds: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """Pairs (root, id) of all nodes reachable from each root, itself included.

    Each round writes its new pairs only; rounds are put together now and then, so that plans stay short.
    """
    edges = dealt(edges.select("src", "dst").distinct())
    parts = [settle(seeds.select(F.col("id").alias("root"), "id").distinct())]
    front, step = parts[0], 0
    while most is None or step < most:
        new = front.join(edges, F.col("id") == F.col("src")).select("root", F.col("dst").alias("id")).distinct()
        front = settle(new.hint("shuffle_merge").join(_all(parts), ["root", "id"], "left_anti"))
        if front.isEmpty():
            break
        parts.append(front)
        if len(parts) > 16:
            parts = [settle(_all(parts))]
        step += 1
    return _all(parts)


def _trimmed(e: DataFrame, most: int | None = None) -> tuple[DataFrame, int]:
    """The edges that are left when nodes without in- or out-edges are peeled off round by round, and their number."""
    n, step = e.count(), 0
    while n and (most is None or step < most):
        step += 1
        entered, left = e.select(F.col("dst").alias("src")).distinct(), e.select(F.col("src").alias("dst")).distinct()
        e = dealt(e.join(entered, "src", "left_semi").join(left, "dst", "left_semi").select("src", "dst"))
        was, n = n, e.count()
        if n == was:
            break
    return e, n


def functional(edges: DataFrame) -> DataFrame:
    """Pointers (id, next) of the nodes with exactly one edge out; edges are distinct."""
    return edges.groupBy("src").agg(F.min("dst").alias("next"), F.count(F.lit(1)).alias("_n")).filter("_n = 1").select(F.col("src").alias("id"), "next")


def functional_cycles(edges: DataFrame) -> DataFrame:
    """Rows (id, component) of the cycles in which every node has one edge out, by doubled pointers: rounds grow with the logarithm of their length."""
    p = dealt(functional(edges).withColumn("low", F.col("id")))
    led = p.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("next").alias("led")).first()
    for _ in range(led.n.bit_length()):
        ahead = p.select(F.col("id").alias("next"), F.col("next").alias("_next"), F.col("low").alias("_low"))
        p = dealt(p.join(ahead, "next").select("id", F.col("_next").alias("next"), F.least("low", "_low").alias("low"), (F.col("_low") < F.col("low")).alias("moved")))
        was, led = led, p.agg(F.countDistinct("next").alias("led"), F.count(F.when(F.col("moved"), 1)).alias("moved")).first()
        # as many nodes are led to as at half the distance: they are the cycles'; and each has its cycle's lowest
        if not led.led or (led.led == was.led and not led.moved):
            break
    # who still has a pointer leads to a cycle, and every node of a cycle is where one leads
    return dealt(p.join(p.select(F.col("next").alias("id")).distinct(), "id", "left_semi").select("id", F.col("low").alias("component")))


def strong_components(edges: DataFrame) -> DataFrame:
    """Rows (id, component) of the nodes in a cycle of two or more nodes; an edge from a node to itself makes none.

    Cycles of nodes with one edge out, or one edge in, among the rest go first. Then colouring: every node takes the largest node that reaches it, and what reaches a
    colour's own node inside the colour is its component. Components are taken out and the rest is coloured again. State is one row
    a node, never a pair of nodes; lineage is cut each round.
    """

    def without(e: DataFrame, ids: DataFrame) -> DataFrame:
        return dealt(e.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti"))

    e, left = _trimmed(dealt(edges.filter("src <> dst").select("src", "dst").distinct()), 2)
    found = e.select(F.col("src").alias("id"), F.col("src").alias("component")).limit(0)
    for way in (lambda x: x, flipped):
        if left:
            cycles = functional_cycles(way(e))
            found = found.union(cycles).hint("shuffle_merge")
            e, left = _trimmed(without(e, cycles.select("id")))
    while left:
        color = dealt(e.select(F.col("src").alias("id")).union(e.select(F.col("dst").alias("id"))).distinct().withColumn("color", F.col("id")))
        while True:
            sent = e.join(color.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.max("color").alias("got"))
            step = dealt(color.join(sent, "id", "left").select("id", F.greatest("color", F.coalesce("got", "color")).alias("color"), (F.col("got") > F.col("color")).alias("moved")))
            color = step.select("id", "color")
            if step.filter("moved").isEmpty():
                break
        to = color.select(F.col("id").alias("dst"), F.col("color").alias("to"))
        inside = dealt(e.join(color.withColumnRenamed("id", "src"), "src").join(to, "dst").filter("color = to").select("src", "dst"))
        seen = front = dealt(color.filter("id = color").select("id"))
        while True:
            front = dealt(inside.join(front.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id")).distinct().join(seen, "id", "left_anti"))
            if front.isEmpty():
                break
            seen = dealt(seen.union(front))
        whole = color.join(seen, "id", "left_semi")
        several = whole.groupBy("color").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("color")
        found = dealt(found.union(whole.join(several, "color", "left_semi").select("id", F.col("color").alias("component"))))
        e, left = _trimmed(without(e, seen))
    return found


def recursive(edges: DataFrame) -> DataFrame:
    """Nodes (id) in a cycle of two or more nodes."""
    return strong_components(edges).select("id")


def degrees(edges: DataFrame, side: str, n: int = 10) -> DataFrame:
    return edges.groupBy(F.col(side).alias("id")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "id").limit(n)


def clusters(pairs: DataFrame) -> DataFrame:
    """Nodes of pairs (a, b) with the smallest node they are linked to, by any number of links: rows (node, root).

    Each round takes the smallest neighbour's root, then that root's own root, so chains shorten by halves; lineage is cut each round.
    """
    links = dealt(pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a is not null and b is not null").distinct())
    state = dealt(links.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")))
    while True:
        near = links.join(state.select(F.col("node").alias("b"), F.col("root").alias("_near")), "b").groupBy("a").agg(F.min("_near").alias("_near"))
        step = state.join(near, F.col("node") == F.col("a")).select("node", F.col("root").alias("_was"), F.least("root", "_near").alias("_low"))
        jump = state.select(F.col("node").alias("_low"), F.col("root").alias("_jump"))
        step = dealt(step.join(jump, "_low", "left").select("node", "_was", F.least("_low", F.coalesce("_jump", "_low")).alias("root")))
        moved = step.filter("root <> _was").limit(1).count()
        state = step.select("node", "root")
        if not moved:
            return state


def distances(seeds: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """The number of steps (id, distance) from the nearest seed to each node it reaches: one row a node, round by round."""
    edges = settle(edges.select("src", "dst").distinct())
    seen = front = settle(seeds.select("id").distinct().withColumn("distance", F.lit(0)))
    step = 0
    while most is None or step < most:
        step += 1
        front = settle(edges.join(front.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("distance", F.lit(step)))
        if front.isEmpty():
            break
        seen = settle(seen.union(front))
    return seen


def flipped(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def signed_ranks(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (id, rank): steps down from the seeds, or minus the steps up to them, whichever are fewer; down where both are equal."""
    down, up = distances(seeds, edges), distances(seeds, flipped(edges)).withColumnRenamed("distance", "above")
    far = F.lit((1 << 31) - 1)
    return down.join(up, "id", "full").select("id", F.when(F.coalesce("distance", far) <= F.coalesce("above", far), F.col("distance")).otherwise(-F.col("above")).alias("rank"))


def around(seeds: DataFrame, edges: DataFrame, hops: int = 3, most: int = 80) -> tuple[DataFrame, DataFrame]:
    """The nodes (id, distance) within `hops` undirected steps of the seeds, the nearest `most`, ties by id; and the edges among them."""
    near = distances(seeds, edges.select("src", "dst").union(flipped(edges)), hops).orderBy("distance", "id").limit(most)
    ids = near.select("id")
    inside = edges.select("src", "dst").distinct().join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return near, inside


def neighbours(edges: DataFrame, node: str) -> DataFrame:
    """Direct neighbours (id, side) of a node: its callers and its callees."""
    callers = edges.filter(F.col("dst") == node).select(F.col("src").alias("id"), F.lit("caller").alias("side"))
    return callers.union(edges.filter(F.col("src") == node).select(F.col("dst").alias("id"), F.lit("callee").alias("side"))).distinct()


def entry_points(symbols: DataFrame, text: str) -> DataFrame:
    """Symbols (id, name) of exactly this name; only where there are none, those whose name holds it."""
    exact = symbols.filter(F.col("name") == text)
    some = exact.limit(1).agg(F.count(F.lit(1)).alias("_n"))
    return symbols.filter(F.contains("name", F.lit(text))).crossJoin(F.broadcast(some)).filter((F.col("_n") == 0) | (F.col("name") == text)).drop("_n")


def cover(sets: DataFrame, most: int | None = None, context: int = 2) -> DataFrame:
    """Greedy cover: rows (place, root, gain) of the roots by the new files each adds, then by changed nodes, then by name; then up to `context` roots without gain.

    sets: rows (root, file, nodes). A root that is the first, in that order, for each of its uncovered files is taken by the greedy order before any
    root that shares a file with it, and so with the gain it has now: all such roots are taken in one round. Gains only fall, so the greedy order is
    the order of the gains they were taken with.
    """
    left = settle(sets.select("root", "file").filter("root is not null and file is not null").distinct())
    weight = settle(sets.select("root", "file", "nodes").distinct().groupBy("root").agg(F.sum("nodes").alias("nodes")))
    taken = weight.select("root", F.lit(0).cast("long").alias("gain"), "nodes").limit(0)
    while True:
        gains = left.groupBy("root").agg(F.count(F.lit(1)).alias("gain")).join(weight, "root")
        first = left.join(gains, "root").groupBy("file").agg(F.min(F.struct(-F.col("gain"), -F.col("nodes"), F.col("root"))).alias("first")).select("file", F.col("first.root").alias("root"), (-F.col("first.col1")).alias("gain"))
        picks = settle(first.groupBy("root", "gain").agg(F.count(F.lit(1)).alias("n")).filter("n = gain").select("root", "gain"))
        if picks.isEmpty():
            break
        taken = settle(taken.union(picks.join(weight, "root").select("root", "gain", "nodes")))
        left = settle(left.join(left.join(picks, "root", "left_semi").select("file").distinct(), "file", "left_anti"))
    from .profile import global_rank

    order = global_rank(taken.withColumns({"_g": -F.col("gain"), "_n": -F.col("nodes")}), ["_g", "_n", "root"]).select(F.col("rank").alias("place"), "root", "gain")
    if most is not None:
        order = order.filter(F.col("place") < most)
    order = settle(order)
    rest = weight.join(order, "root", "left_anti").orderBy(F.desc("nodes"), "root").limit(context)
    n = order.count()
    placed = rest.withColumn("place", F.row_number().over(Window.orderBy(F.desc("nodes"), "root")) + (n - 1))  # a few rows
    return order.union(placed.select(F.col("place").cast("long"), "root", F.lit(0).cast("long").alias("gain")))
