"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time 0 to 1: a polyline of
knots. Its integral up to t, as a share of the whole, is the source's cumulative
token demand at t; times the source's target, that is how many words the source
has given by then. Documents of a source stand in a fixed pseudo-random order,
pass after pass, and each takes the time at which the cumulative demand, inverted,
reaches the middle of its words. Range-sorting occurrences by that time gives the
training order.

Targets: a total is shared by weight, but no source gives more than `most`
times its size; the excess is shared again by weight until none is above.

Defined cases: a null text has size 0 and is never taken; a null source is a
source of its own, last; sources of size 0 have target 0. The last document of
a pass is taken in part, so that a source gives exactly its target, rounded; with `whole` it is
taken whole or not at all, whichever comes nearer to the target. Order within
a source follows a hash of all columns; rows that agree in all of them are
interchangeable, others never stand for each other. An empty table gives no rows; extra columns are kept by `mix`.
The number of sources is bounded by what the driver holds of them: a row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, packed, row_hashes, same, settle, table, with_running, words

WORD_END = r"[^\x20\x09-\x0D]"
#: Documents of a source that one task orders.
BUCKET_DOCS = 1_000
#: Shapes of schedules (knots of time and relative weight), given to sources in turn: early, even, late, peaked.
SHAPES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 0.6), (0.5, 1.4), (1.0, 0.6)))


def water_fill(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """Targets: share * sum(sizes) by weight, none over most * its size."""
    total, caps = share * sum(sizes), [most * s for s in sizes]
    open_, targets = set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        unit = (total - sum(targets[i] for i in range(len(sizes)) if i not in open_)) / sum(weights[i] for i in open_)
        above = {i for i in open_ if unit * weights[i] > caps[i]}
        for i in above or open_:
            targets[i] = caps[i] if above else unit * weights[i]
        open_ -= above or open_
    return targets


def integrate(knots) -> list[tuple[float, float, float, float, float]]:
    """Segments (t, length, weight, slope, share of demand before), demand over all being 1."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False)]
    out, before = [], 0.0
    for (a, b), area in zip(zip(knots, knots[1:], strict=False), areas, strict=True):
        if area > 0:
            out.append((float(a[0]), float(b[0] - a[0]), a[1] / sum(areas), (b[1] - a[1]) / (b[0] - a[0]) / sum(areas), before / sum(areas)))
        before += area
    return out


def invert(q: Column, segments: Column) -> Column:
    """The time at which a share q of the demand is reached."""
    last = F.filter(segments, lambda s: s["before"] <= q)
    s = F.element_at(last, -1)
    rest = q - s["before"]
    # weight * x + slope * x * x / 2 = rest, in the form that also holds for slope 0
    root = F.sqrt(F.greatest(F.lit(0.0), s["weight"] * s["weight"] + 2 * s["slope"] * rest))
    x = F.when(rest <= 0, F.lit(0.0)).otherwise(2 * rest / (s["weight"] + root))
    return s["t"] + F.least(s["length"], x)


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def plan(docs: DataFrame, weights=(3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, shapes=SHAPES, seed: int = 42, whole: bool = False) -> DataFrame:
    """One row for each document: sizes, target, words taken, and `occurrences` (pass, words, position), in training order of the first."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    key, key2 = row_hashes(docs, seed)
    base = settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(text).alias("size"), key.alias("key"), key2.alias("key2")))
    found = base.groupBy("source").agg(F.sum("size").cast("long").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    found.sort(key=lambda r: (r.source is None, r.source or ""))
    weight = [weights[i % len(weights)] for i in range(len(found))]
    targets = water_fill([r["size"] for r in found], weight, share, most) if found else []
    rows = [(r.source, r["size"], t, max(1, -(-r.n // BUCKET_DOCS)), integrate(shapes[i % len(shapes)])) for i, (r, t) in enumerate(zip(found, targets, strict=True))]
    kinds = "array<struct<t double, length double, weight double, slope double, before double>>"
    sources = F.broadcast(spark.createDataFrame(rows, f"source string, source_size long, target double, n_buckets int, segments {kinds}"))
    placed = base.alias("l").join(sources.alias("r"), same("l", "r", "source")).select("l.*", "r.source_size", "r.target", "r.n_buckets", "r.segments")
    # keys are uniform: their top bits deal a source's documents to buckets in order
    high = F.shiftrightunsigned(F.col("key"), 33)
    bucketed = placed.withColumn("bucket", F.floor(high * F.col("n_buckets") / F.lit(float(1 << 31))).cast("int")).withColumn("_high", high)
    running = with_running(bucketed, ["source"], "bucket", ["_high", "key", "key2"], add="size")
    goal = F.round("target").cast("long")
    passes = F.when(F.col("size") > 0, F.sequence(F.lit(0), F.lit(int(-(-most // 1)) - 1))).otherwise(F.array().cast("array<int>"))

    def occurrence(p: Column) -> Column:
        start = p.cast("long") * F.col("source_size") + F.col("before")
        taken = F.greatest(F.lit(0), F.least(F.col("size"), goal - start))
        if whole:
            taken = F.when(taken * 2 >= F.col("size"), F.col("size")).otherwise(0)
        share_at = F.least(F.lit(1.0), (start + taken / 2) / F.greatest(F.lit(1), goal))
        return F.struct(p.alias("pass"), taken.cast("long").alias("words"), invert(share_at, F.col("segments")).alias("position"))

    given = running.withColumn("occurrences", F.filter(F.transform(passes, occurrence), lambda o: o["words"] > 0))
    taken = F.aggregate("occurrences", F.lit(0).cast("long"), lambda a, o: a + o["words"])
    out = given.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), F.get("occurrences", F.lit(0))["position"].alias("first_position"), "occurrences", "key", "key2")
    return out.repartitionByRange(F.col("first_position").asc_nulls_last(), F.col("key")).sortWithinPartitions(F.col("first_position").asc_nulls_last(), "key", "doc_id")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its nth word."""
    parts = F.split(text, rf"(?<={WORD_END})(?={SPACE})")
    return F.array_join(F.slice(parts, F.lit(1), n.cast("int")), "")


def mix(docs: DataFrame, **settings) -> DataFrame:
    """Documents as often as the mix takes them, texts cut where it takes a part (never with `whole`), range-sorted by position."""
    taken = plan(docs, **settings).select("key", "key2", F.explode("occurrences").alias("o"))
    key, key2 = row_hashes(docs, settings.get("seed", 42))
    # equal rows have equal keys, of 128 bits: one of them stands for each of their occurrences
    rows = docs.select(packed(docs).alias("row"), key.alias("key"), key2.alias("key2")).dropDuplicates(["key", "key2"])
    joined = rows.join(taken, ["key", "key2"])
    mixed = joined.select("row", "o", "key").repartitionByRange("o.position", "key").sortWithinPartitions("o.position", "key")
    if settings.get("whole"):
        return mixed.select("row.*")
    text = F.when(F.col("o.words") < n_words(F.col("row.text")), first_words(F.col("row.text"), F.col("o.words"))).otherwise(F.col("row.text"))
    cut = {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return mixed.select(*[(cut[c] if c in cut else F.col("row")[c]).alias(c) for c in docs.columns])


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    return plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_position", F.size("occurrences").alias("n_passes"))
