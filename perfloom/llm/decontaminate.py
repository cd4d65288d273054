"""Benchmark decontamination: MinHash containment search, partitioned by item size.

A test item is contaminated into a document if at least `threshold` of the
item's distinct shingles (five words, lower-cased letters and digits) are in it.
Items are partitioned by size in powers of two. In a partition with at most u
shingles, an item's MinHash sketch is its k = floor((1 - threshold) * u) + 1
smallest shingle hashes: a document that has the threshold's share of the item
misses too few of them to miss all k, so sketches lose no pair, however long
the document is. Documents probe an inverted index of the sketches with those of
their hashes that no sketch value exceeds. Candidates are verified by exact
containment of the shingles themselves.

Defined cases: an item with fewer than five words is one shingle, its whole
sequence; items and documents without words never match, nor do nulls; items
of equal words are one class, shown by their smallest id; repeated rows each
give their pairs; ids may be null; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, settle, table

SHINGLE, THRESHOLD = 5, 0.8
#: Sketch entries up to which the index is broadcast; beyond it, it is joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Bytes of all items' shingles up to which items are broadcast.
BROADCAST_BYTES = 64 << 20
TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(TOKEN), F.lit(0))


def windows(w: Column, length: int) -> Column:
    """The windows of `length` words, as arrays."""
    starts = F.when(F.size(w) >= length, F.sequence(F.lit(1), F.size(w) - (length - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(w, i, length))


def shingle_hashes(w: Column, width: int) -> Column:
    """Hashes of the windows of `width` words, told apart by width; no window is built."""
    starts = F.when(F.size(w) >= width, F.sequence(F.lit(0), F.size(w) - width)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.lit(width), *[F.get(w, i + k) for k in range(width)]))


def items_of(benchmark: DataFrame, threshold: float) -> DataFrame:
    """One row for each class of items: item_id, width (words of a shingle), shingles, and the sketch."""
    w = benchmark.select(F.col("item_id").cast("long").alias("item_id"), tokens(F.col("text")).alias("w")).filter(F.size("w") > 0)
    classes = w.groupBy("w").agg(F.min("item_id").alias("item_id"), F.count(F.lit(1)).alias("n_items")).withColumn("item", F.xxhash64("w"))
    width = F.least(F.lit(SHINGLE), F.size("w"))
    starts = F.sequence(F.lit(1), F.size("w") - width + 1)
    own = F.coalesce(*[F.when(width == k, shingle_hashes(F.col("w"), k)) for k in range(1, SHINGLE + 1)])
    cut = classes.select("item", "item_id", "n_items", F.array_sort(F.array_distinct(own)).alias("hashes"), width.alias("width"), F.array_distinct(F.transform(starts, lambda i: F.concat_ws(" ", F.slice("w", i, width)))).alias("shingles"))
    upper = F.pow(F.lit(2), F.floor(F.log2(F.size("shingles")))) * 2 - 1  # of the size partition
    k = (F.floor(F.lit(1 - threshold) * upper + F.lit(1e-9)) + 1).cast("int")
    return cut.select("*", F.floor(F.log2(F.size("shingles"))).cast("int").alias("partition"), F.slice("hashes", F.lit(1), k).alias("sketch")).drop("hashes")


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (key1, key2, item_id, n_items, n_shingles, n_shared, containment) for each distinct text and class of items it holds."""
    items = settle(items_of(benchmark, threshold))
    index = items.select("item", F.explode("sketch").alias("h"))
    facts = items.agg(F.collect_set("width").alias("widths"), F.max(F.array_max("sketch")).alias("top"), F.sum(F.size("sketch")).alias("n"), F.sum(F.aggregate("shingles", F.lit(0).cast("long"), lambda a, x: a + F.length(x) * 4)).alias("bytes")).first()
    text = F.col("text").cast("string")
    # a text decides, not its id: equal texts are one, by 128 bits of hashes
    key = [F.xxhash64(F.lit(k), text).alias(f"key{k}") for k in (1, 2)]
    base = docs.select(*key, text.alias("text"))
    widths, top = sorted(facts.widths) or [SHINGLE], facts.top if facts.top is not None else -(1 << 63)
    hint = F.broadcast if (facts.n or 0) <= BROADCAST_ROWS and (facts.bytes or 0) <= BROADCAST_BYTES else lambda x: x

    def probes(w: Column) -> Column:
        return F.filter(F.concat(*[shingle_hashes(w, k) for k in widths]), lambda h: h <= F.lit(top))

    # exploded as an expression: a filter inferred on a column would be pushed below and cut the text anew for every window
    cut = F.get(F.transform(F.array(tokens(F.col("text"))), probes), F.lit(0))
    probed = base.select("key1", "key2", F.explode(cut).alias("h"))
    pairs = settle(probed.join(hint(index), "h").select("key1", "key2", "item").distinct())
    full = items.select("item", F.struct("item_id", "n_items", "width", "shingles").alias("it"))
    near = F.broadcast if pairs.count() <= BROADCAST_ROWS else lambda x: x
    asked = pairs.select("key1", "key2").distinct()
    held = base.join(near(asked), ["key1", "key2"]).distinct().select("key1", "key2", tokens(F.col("text")).alias("w"))
    own = {width: F.transform(windows(F.col("w"), width), lambda s: F.concat_ws(" ", s)) for width in widths}
    wide = held.select("key1", "key2", *[F.array_distinct(x).alias(f"s{k}") for k, x in own.items()])
    met = wide.join(near(pairs), ["key1", "key2"]).join(hint(full), "item")
    pick = F.coalesce(*[F.when(F.col("it.width") == k, F.col(f"s{k}")) for k in widths])
    shared = met.select("key1", "key2", "it", F.size(F.array_intersect(pick, F.col("it.shingles"))).cast("long").alias("n_shared"))
    n = F.size("it.shingles").cast("long")
    out = shared.select("key1", "key2", F.col("it.item_id").alias("item_id"), F.col("it.n_items").alias("n_items"), n.alias("n_shingles"), "n_shared", (F.col("n_shared") / n).alias("containment"))
    return out.filter(F.col("n_shared") >= F.ceil(F.lit(threshold) * F.col("n_shingles") - F.lit(1e-9)))


def text_keys(docs: DataFrame) -> list[Column]:
    return [F.xxhash64(F.lit(k), F.col("text").cast("string")) for k in (1, 2)]


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, item_id, n_items, n_shingles, n_shared, containment) for each document row and class of items it holds."""
    found = settle(contaminated_texts(docs, benchmark, threshold))
    hint = F.broadcast if found.count() <= BROADCAST_ROWS else lambda x: x
    one, two = text_keys(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), one.alias("key1"), two.alias("key2"))
    return rows.join(hint(found), ["key1", "key2"]).drop("key1", "key2")


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, all columns as they are, whose text holds no item."""
    bad = settle(contaminated_texts(docs, benchmark, threshold).select("key1", "key2").distinct())
    hint = F.broadcast if bad.count() <= BROADCAST_ROWS else lambda x: x
    one, two = text_keys(docs)
    rows = docs.select(packed(docs).alias("row"), one.alias("key1"), two.alias("key2"))
    return rows.join(hint(bad), ["key1", "key2"], "left_anti").select("row.*")


def sketch_size(upper: int, threshold: float = THRESHOLD) -> int:
    return math.floor((1 - threshold) * upper + 1e-9) + 1


def op8_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP8_SQL = r"""
WITH t AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w FROM benchmark WHERE text IS NOT NULL),
c AS (SELECT min(item_id) item_id, count(*) n_items, w FROM t WHERE len(w) > 0 GROUP BY w),
i AS (SELECT DISTINCT item_id, n_items, least(5, len(w)) width, unnest(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda x: array_to_string(w[x:x + least(5, len(w)) - 1], ' '))) s FROM c),
z AS (SELECT item_id, count(*) n FROM i GROUP BY item_id),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w FROM documents WHERE text IS NOT NULL),
g AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda x: array_to_string(w[x:x + k - 1], ' '))) s FROM d, (SELECT DISTINCT width AS k FROM i) WHERE len(w) >= k)
SELECT doc_id, i.item_id, max(n_items) AS n_items, max(n) AS n_shingles, count(*) AS n_shared, count(*) / max(n)::DOUBLE AS containment
FROM g JOIN i ON g.s = i.s AND width = g.k JOIN z ON z.item_id = i.item_id
GROUP BY doc_id, i.item_id HAVING count(*) >= ceil(0.8 * max(n) - 1e-9)
"""
