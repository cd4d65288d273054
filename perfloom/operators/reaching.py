"""What many roots reach, 64 roots to a word: state is a row for each node and block of 64 roots, never a (root, node) pair.

Roots are numbered; a root is a bit of a word, and words travel along edges. Nodes of one cycle reach the same, so
strong components are one node. In what is left, chains of nodes with one edge out are covered by
pointers that double, so words pass a chain of any length in as many rounds as its length has binary digits;
the other edges take a round a step, in which only bits that are new to a node go on. Lineage is cut each round.

Defined cases: a root reaches itself; roots outside the edges reach only themselves; one root may start from several nodes; edges
from a node to itself change nothing; repeated rows count once; nulls are no nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import dealt, functional, strong_components

WORD = 64
#: Nodes of a component that are told of a word's roots by one row, pairs of a task, and most tasks of them.
LOT, PAIRS, MOST_TASKS = 256, 1 << 25, 20_000
#: Roots up to which their names are broadcast; beyond it there are many words, and a join by word is even.
BROADCAST_ROOTS = 50_000


def numbered(seeds: DataFrame) -> DataFrame:
    """Rows (root, block, bit) of the distinct roots."""
    from .profile import global_rank

    ranked = global_rank(seeds.select("root").distinct(), ["root"])
    return ranked.select("root", F.floor(F.col("rank") / WORD).cast("long").alias("block"), (F.col("rank") % WORD).cast("int").alias("bit"))


def _together(rows: DataFrame) -> DataFrame:
    return rows.groupBy("id", "block").agg(F.bit_or("bits").alias("bits"))


def _entered(edges: DataFrame) -> DataFrame:
    """The edges out of nodes that an edge leads to: no other is in a cycle."""
    return edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")


def _fresh(rows: DataFrame, state: DataFrame) -> DataFrame:
    """The bits of rows that the state has not."""
    had = state.withColumnRenamed("bits", "_had")
    left = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_had", F.lit(0).cast("long"))))
    return rows.join(had, ["id", "block"], "left").select("id", "block", left.alias("bits")).filter("bits <> 0")


def _levels(edges: DataFrame) -> list[DataFrame]:
    """Pointers (id, to) over 1, 2, 4, ... edges of nodes with one edge out, as long as there are any; edges have no cycles."""
    levels = [dealt(functional(edges).select("id", F.col("next").alias("to")))]
    while not levels[-1].isEmpty():
        last = levels[-1]
        levels.append(dealt(last.join(last.select(F.col("id").alias("to"), F.col("to").alias("_to")), "to").select("id", F.col("_to").alias("to"))))
    return levels[:-1]


class Reached:
    """What the roots of seeds (root, id) reach along edges (src, dst), within `most` steps if given; `tidy`: edges are settled and distinct already."""

    def __init__(self, seeds: DataFrame, edges: DataFrame, most: int | None = None, tidy: bool = False):
        seeds = dealt(seeds.select("root", "id").filter("root is not null and id is not null").distinct())
        e = edges.select("src", "dst").filter("src <> dst")
        e = e.hint("shuffle_merge") if tidy else dealt(e.distinct())
        self.roots = dealt(numbered(seeds))
        #: (id, component) of the nodes that stand for several; with a limit of steps there are none
        self.merged = strong_components(_entered(e)) if most is None else None
        word = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
        start = seeds.join(self.roots, "root").select("id", "block", word.alias("bits"))
        levels: list[DataFrame] = []
        if self.merged is not None:
            start = self._standing(start, "id")
            # many edges go into few components: one end first, so that the other is looked up for what is left
            e = self._standing(e, "dst").select("src", "dst").distinct()
            e = dealt(self._standing(e, "src").filter("src <> dst").select("src", "dst").distinct())
            levels = _levels(e)
            single = functional(e).select(F.col("id").alias("src"))
            e = dealt(e.join(single, "src", "left_anti"))
        state = front = dealt(self._down(_together(start), levels))
        step = 0
        while most is None or step < most:
            step += 1
            got = _together(front.join(e, front["id"] == e["src"]).select(F.col("dst").alias("id"), "block", "bits"))
            front = dealt(_fresh(got, state))
            if front.isEmpty():
                break
            if levels:
                front = dealt(_fresh(self._down(front, levels), state))
            state = dealt(_together(state.union(front)))
        #: (id, block, bits): by component, where there are some
        self.state = state

    def _standing(self, rows: DataFrame, column: str) -> DataFrame:
        to = self.merged.select(F.col("id").alias(column), F.col("component").alias("_to"))
        return rows.join(to, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")

    @staticmethod
    def _down(front: DataFrame, levels: list[DataFrame]) -> DataFrame:
        """The front with everything down the chains from it."""
        for level in levels:
            moved = front.join(level, "id").select(F.col("to").alias("id"), "block", "bits")
            front = dealt(_together(front.union(moved)))
        return front

    def sizes(self) -> DataFrame:
        """Rows (root, reach): how many nodes each root reaches, itself included."""
        rows = self.state
        weight = F.lit(1).cast("long")
        if self.merged is not None:
            several = self.merged.groupBy(F.col("component").alias("id")).agg(F.count(F.lit(1)).alias("_w"))
            rows, weight = rows.join(several, "id", "left"), F.coalesce("_w", weight)
        sums = rows.groupBy("block").agg(*[F.sum(F.getbit("bits", F.lit(k)).cast("long") * weight).alias(f"b{k}") for k in range(WORD)])
        each = sums.select("block", F.posexplode(F.array(*[f"b{k}" for k in range(WORD)])).alias("bit", "reach"))
        return self.roots.join(each, ["block", "bit"]).select("root", "reach")

    def at(self, nodes: DataFrame) -> DataFrame:
        """Rows (root, id) for those of the given nodes (id) that a root reaches."""
        own = nodes.select("id").distinct()
        if self.merged is not None:
            own = own.join(self.merged, "id", "left").select("id", F.coalesce("component", "id").alias("_at"))
        else:
            own = own.withColumn("_at", F.col("id"))
        own = dealt(own)
        lots = own.groupBy("_at").agg(F.count(F.lit(1)).alias("_n")).withColumn("_lots", F.ceil(F.col("_n") / LOT))
        reached = dealt(self.state.withColumnRenamed("id", "_at").join(lots, "_at"))
        facts = reached.agg(F.sum(F.bit_count("bits") * F.col("_n"))).first()
        # few rows make very many pairs: their number tells the tasks, not the bytes that go in
        spark = reached.sparkSession
        tasks = min(max((facts[0] or 0) // PAIRS, int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), MOST_TASKS)
        lot = F.pmod(F.xxhash64("id"), F.col("_lots")).alias("_lot")
        members = own.join(lots, "_at").select("_at", "id", lot).groupBy("_at", "_lot").agg(F.collect_list("id").alias("_ids"))
        place = F.struct("bit", "root")
        names = self.roots.groupBy("block").agg(F.transform(F.sort_array(F.collect_list(place)), lambda x: x["root"]).alias("_names"))
        names = names.hint("broadcast" if self.roots.count() <= BROADCAST_ROOTS else "shuffle_merge")
        named = reached.select("_at", "block", "bits", "_lots").join(names, "block")
        roots = F.filter("_names", lambda x, i: F.call_function("getbit", F.col("bits"), i) == 1)
        named = named.select("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_lots") - 1)).alias("_lot"), roots.alias("_roots"))
        both = named.repartition(tasks, "_at", "_lot").hint("shuffle_merge").join(members.repartition(tasks, "_at", "_lot"), ["_at", "_lot"])
        return both.select("_roots", F.explode("_ids").alias("id")).select(F.explode("_roots").alias("root"), "id")


def reach_sizes(seeds: DataFrame, edges: DataFrame, tidy: bool = False) -> DataFrame:
    """Rows (root, reach) for seeds (id)."""
    return Reached(seeds.select(F.col("id").alias("root"), "id"), edges, tidy=tidy).sizes()
