"""Filter interaction audit: what every order of five filters removes, step by step.

The failures of a document are five bits. For each of the 32 sets of bits and each of the 120 orders a
table, made once, holds the step at which the first failing filter stands. Tasks look their rows up in it, and one
`bincount` over (measure, order, step) gives the removals of a part; the arrays of the tasks are summed.
Everything else follows: what a filter fails is what it removes as the first of an order, what it alone
fails is what it removes as the last, and its Shapley sum goes over all orders.

A document fails the last filter if its text (by SHA-256) is that of a smaller doc_id anywhere in the table. The smallest
id of each repeated text is matched by `match_counted`: texts of very many copies come by broadcast.

Defined cases: a null text is empty; the part of a null source is the empty string; a row without an id has no smaller id,
is no smaller one and has no label; equal ids with equal texts fail nothing by each other; of several labels of an id one with the value 1 is
enough; an empty table has no parts; extra columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import UPPER, match_counted, settle, sum_arrays, table

FILTERS = "ABCDE"
#: Words under which A fails; the percentages of B and C; the characters of D.
LEAST_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, MARKS = 200, 50, 2, rb"[#$%&*|]"
#: Rows looked up at once, and parts whose arrays a task holds.
BLOCK, HELD_PARTS = 4096, 256


@lru_cache
def orders(filters: str = FILTERS) -> list[str]:
    return ["".join(p) for p in permutations(filters)]


@lru_cache
def first_failures(filters: str = FILTERS):
    """An array (sets of failures, orders) of the step, from 0, that removes; as many as there are filters: none."""
    import numpy as np

    k = len(filters)
    places = np.array([[o.index(f) for f in filters] for o in orders(filters)])
    fails = (np.arange(1 << k)[:, None] >> np.arange(k)) & 1
    return np.where(fails[:, None, :] == 1, places[None], k).min(axis=2).astype(np.int64)


def text_failures(text: bytes, chars: int) -> int:
    """Bits 0 to 3: the failures of A to D."""
    import re

    found = text.split()  # of bytes: at ASCII white space
    upper = len(text) - len(text.translate(None, UPPER.encode()))
    return (
        (len(found) < LEAST_WORDS)
        | (100 * len(set(found)) < DISTINCT_PERCENT * len(found)) << 1
        | (100 * upper > UPPER_PERCENT * chars) << 2
        | (re.search(MARKS, text) is not None) << 3
    )


def measured(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, part, fails, key): the failures a text shows by itself, and its SHA-256."""

    def run(batches):
        from hashlib import sha256

        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            texts, chars = batch.column(2).cast(pa.binary()), pc.utf8_length(batch.column(2)).to_pylist()
            fails, keys = [], []
            for t, n in zip(texts, chars, strict=True):
                text = t.as_py()
                fails.append(text_failures(text, n))
                keys.append(sha256(text).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fails, pa.int32()), pa.array(keys, pa.binary())], names=["doc_id", "part", "fails", "key"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return plain.mapInArrow(run, "doc_id long, part string, fails int, key binary")


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (part, fails, label): all five bits, and 1 for quality plus 2 for toxic."""
    own = settle(measured(docs))
    repeated = settle(own.groupBy("key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    copied = match_counted(own, repeated, "key").select("doc_id", "part", (F.col("fails") + F.when(F.col("doc_id") > F.col("first"), 16).otherwise(0)).alias("fails"), F.when(F.col("doc_id").isNull(), F.xxhash64("key")).otherwise(0).alias("_spread"))

    def one(c: str) -> Column:
        return F.max(F.when(F.col(c) == 1, 1).otherwise(0))

    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").filter("doc_id is not null and (quality = 1 or toxic = 1)").groupBy("doc_id").agg((one("quality") + 2 * one("toxic")).alias("label")).withColumn("_spread", F.lit(0).cast("long"))
    # rows without an id match nothing, and are dealt out by their texts
    return copied.join(told, ["doc_id", "_spread"], "left").select("part", "fails", F.coalesce("label", F.lit(0)).alias("label"))


def removals(rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Rows (part, counts) of each task: by measure (all, quality, toxic), order and step (the last: kept) the number of rows."""
    steps, n_orders, k = first_failures(filters), len(orders(filters)), len(filters)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        cells = n_orders * (k + 1)
        at = np.arange(n_orders) * (k + 1)
        held: dict[str, np.ndarray] = {}

        def told():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([x.ravel() for x in held.values()], pa.list_(pa.int64()))], names=["part", "counts"])

        for batch in batches:
            parts = batch.column(0).dictionary_encode()
            code, names = parts.indices.to_numpy(zero_copy_only=False), parts.dictionary.to_pylist()
            fails, label = (batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2))
            order = np.argsort(code, kind="stable")
            cuts = np.searchsorted(code[order], np.arange(len(names) + 1))
            for p, name in enumerate(names):
                if name not in held and len(held) >= HELD_PARTS:
                    yield told()
                    held.clear()
                total = held.setdefault(name, np.zeros((3, cells), np.int64))
                mine = order[cuts[p] : cuts[p + 1]]
                for a in range(0, len(mine), BLOCK):
                    rows = mine[a : a + BLOCK]
                    index = label[rows, None] * cells + at + steps[fails[rows]]
                    by = np.bincount(index.ravel(), minlength=4 * cells).reshape(4, cells)
                    total += (by.sum(axis=0), by[1] + by[3], by[2] + by[3])
        if held:
            yield told()

    return rows.select("part", "fails", "label").mapInArrow(run, "part string, counts array<bigint>")


def audit(rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row for each part, order and step, over rows (part, fails, label); `rows` is read once."""
    k, names = len(filters), orders(filters)
    cells = len(names) * (k + 1)
    summed = sum_arrays(removals(rows, filters), ["part"], "counts")
    place = F.col("pos") % cells

    def cell(measure: int, step: int) -> Column:
        return F.coalesce(F.sum(F.when((F.floor(F.col("pos") / cells) == measure) & (place % (k + 1) == step), F.col("n"))), F.lit(0)).cast("long")

    parts = summed.select("part").distinct()
    found = summed.groupBy("part", F.floor(place / (k + 1)).cast("int").alias("o")).agg(*[F.array(*[cell(m, s) for s in range(k + 1)]).alias(c) for m, c in enumerate(("all", "good", "toxic"))])
    # every order removes or keeps every row, so each part has all orders
    order = F.get(F.array(*[F.lit(o) for o in names]), F.col("o"))

    def after(i: Column) -> Column:
        return F.aggregate(F.slice("all", i + 2, F.lit(k)), F.lit(0).cast("long"), lambda a, x: a + x)

    step = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.struct((i + 1).alias("step"), F.get("all", i).alias("removed"), after(i).alias("kept"), F.get("good", i).alias("good_lost"), F.get("toxic", i).alias("toxic_lost")))
    steps = found.join(parts, "part").select("part", order.alias("filter_order"), F.inline(step)).withColumn("_filter", F.expr("substring(filter_order, step, 1)"))
    by = Window.partitionBy("part", "_filter")

    def at(s: int) -> Column:
        return F.max(F.when(F.col("step") == s, F.col("removed"))).over(by)

    return steps.select("part", "filter_order", F.col("step").cast("int").alias("step"), "kept", "removed", (at(1) - F.col("removed")).alias("redundant"), at(k).alias("unique_fails"), "good_lost", "toxic_lost", F.sum("removed").over(by).alias("shapley"))


def op11_filter_interaction_audit(spark, sf_dir: str) -> DataFrame:
    return audit(flagged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


#: The same by counts of each set of failures, every step asked for its earlier filters.
OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails FROM d),
c AS (SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS letter, list_transform(string_split(filter_order[1:step - 1], ''), lambda y: ascii(y) - 64) AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
g AS (SELECT part, filter_order, step, letter, n, good, toxic, fails[ascii(letter) - 64] AS bad, len(list_filter(fails, lambda y: y)) AS n_bad, step > 1 AND len(list_filter(before, lambda i: i > 0 AND fails[i])) > 0 AS gone FROM c, s),
r AS (SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (NOT gone AND NOT bad), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND bad), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (gone AND bad), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (bad AND n_bad = 1), 0)::BIGINT AS unique_fails,
coalesce(sum(good) FILTER (NOT gone AND bad), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND bad), 0)::BIGINT AS toxic_lost FROM g GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM r
"""
