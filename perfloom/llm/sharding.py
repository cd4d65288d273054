"""Sharding by a uniform shuffle with exact shard sizes, drawn as a communication matrix.

Rows are dealt to partitions by a hash. How many rows each partition sends to
each shard is a draw from the multivariate hypergeometric law given both
margins: partition sizes, and shard sizes that differ by one at most. Within a
partition rows are permuted, and the matrix row cuts the permutation into shares
for the shards; within a shard the arrivals are permuted again, which gives slots.

Permutations order rows by seeded hashes of all their columns and of the number of
a copy among rows equal in all of them, so reruns and retried tasks agree and copies
spread like any other rows. Equal rows are one row with a count until then: copies are
numbered by chunks of that count, so no task makes or sorts all copies of a row. Ranks come from two
levels of buckets: no task sorts a whole shard.

Defined cases: a null text has no bytes and the crc32 of no bytes; which of several rows equal in all columns
gets which of their places is all the same, others never stand for each other; an empty table gives none; extra columns go along in `shard`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, row_hashes, settle, table, with_running

#: Partitions of the matrix: rows of a partition, and the most partitions there are.
PARTITION_ROWS, MAX_PARTITIONS = 20_000, 4096
#: Copies of a row that one task numbers or places.
CHUNK = 10_000


def hypergeometric(rng, good: int, bad: int, drawn: int) -> int:
    """One draw. numpy's sampler holds below 1e9; above, inversion from the mode by log-gammas."""
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, drawn)) if drawn and good else 0
    low, high = max(0, drawn - bad), min(good, drawn)

    def log_p(k: int) -> float:
        lg = math.lgamma
        return lg(good + 1) - lg(k + 1) - lg(good - k + 1) + lg(bad + 1) - lg(drawn - k + 1) - lg(bad - drawn + k + 1) - lg(good + bad + 1) + lg(drawn + 1) + lg(good + bad - drawn + 1)

    mode = min(high, max(low, (drawn + 1) * (good + 1) // (good + bad + 2)))
    left = rng.random() - (p_mode := math.exp(log_p(mode)))
    up = down = p_mode
    i = j = mode
    while left > 0 and (i < high or j > low):
        if i < high:
            up *= (good - i) * (drawn - i) / ((i + 1) * (bad - drawn + i + 1))
            i += 1
            left -= up
            if left <= 0:
                return i
        if j > low:
            down *= j * (bad - drawn + j) / ((good - j + 1) * (drawn - j + 1))
            j -= 1
            left -= down
            if left <= 0:
                return j
        if up < 1e-18 and down < 1e-18:
            break
    return mode


def matrix(sizes: list[int], n_shards: int, seed: int) -> list[list[int]]:
    """Counts by partition and shard; rows sum to `sizes`, columns to sizes at most one apart."""
    import numpy as np

    rng, total = np.random.default_rng(seed), sum(sizes)
    left = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    out = []
    for size in sizes:
        row, need, there = [], size, sum(left)
        for s in range(n_shards):
            there -= left[s]
            k = hypergeometric(rng, left[s], there, need)
            row.append(k)
            need -= k
        left = [a - b for a, b in zip(left, row, strict=True)]
        out.append(row)
    return out


def _bucket(key: Column, n: Column) -> Column:
    """Buckets 0 to n - 1 in the order of the key's top 31 bits."""
    return F.floor(F.shiftrightunsigned(key, 33) * n / F.lit(float(1 << 31))).cast("int")


def assign(rows: DataFrame, key: str, n_shards: int, seed: int = 42) -> DataFrame:
    """Adds shard and slot to rows with a uniform 64-bit key; rows are read more than once."""
    spark = rows.sparkSession
    total = rows.count()
    n_parts = min(MAX_PARTITIONS, max(8, -(-total // PARTITION_ROWS)))
    dealt = rows.withColumn("_part", _bucket(F.xxhash64(F.lit(seed + 1), F.col(key)), F.lit(n_parts))).withColumn("_local", F.xxhash64(F.lit(seed + 2), F.col(key)))
    found = {r._part: r.n for r in dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = matrix([found.get(p, 0) for p in range(n_parts)], n_shards, seed)
    cuts = [(p, [sum(row[: s + 1]) for s in range(n_shards)]) for p, row in enumerate(counts)]
    sent = F.broadcast(spark.createDataFrame(cuts, "_part int, _cuts array<long>"))
    # a partition holds many rows at the largest sizes: sub-buckets keep a task's sort short
    subs = max(1, -(-total // n_parts // PARTITION_ROWS))
    local = with_running(dealt.withColumn("_sub", _bucket(F.col("_local"), F.lit(subs))), ["_part"], "_sub", ["_local", key])
    shard = F.size(F.filter("_cuts", lambda c: c <= F.col("before"))).cast("int")
    placed = local.join(sent, "_part").select(*rows.columns, shard.alias("shard")).withColumn("_order", F.xxhash64(F.lit(seed + 3), F.col(key)))
    per = max(1, -(-total // n_shards // PARTITION_ROWS))
    slots = with_running(placed.withColumn("_sub", _bucket(F.col("_order"), F.lit(per))), ["shard"], "_sub", ["_order", key])
    return slots.select(*rows.columns, "shard", F.col("before").alias("slot"))


def copies(counted: DataFrame) -> DataFrame:
    """Rows with a count `n` as n rows with `copy` from 0 and `chunk`; the copies of a frequent row are dealt out over tasks."""
    chunked = counted.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK))))
    frequent = counted.filter(F.col("n") > CHUNK).agg(F.sum("n")).first()[0]
    if frequent:  # a number of partitions of its own: by the few bytes that chunks have, they would be put together
        chunked = chunked.repartition(int(min(MAX_PARTITIONS, 8 + frequent // (4 * CHUNK))), "key", "key2", "chunk")
    first = F.col("chunk") * CHUNK
    return chunked.withColumn("copy", F.explode(F.sequence(first, F.least(first + (CHUNK - 1), F.col("n") - 1)))).drop("n")


def plan(docs: DataFrame, n_shards: int = 40, seed: int = 42) -> DataFrame:
    """One narrow row for each document: doc_id, size, text_crc32, key and key2 (hashes of all columns), chunk and copy among equal rows, shard and slot."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key, key2 = row_hashes(docs, seed)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), key.alias("key"), key2.alias("key2"))
    equal = settle(narrow.groupBy("key", "key2").agg(*[F.max(c).alias(c) for c in ("doc_id", "size", "text_crc32")], F.count(F.lit(1)).alias("n")))
    rows = settle(copies(equal).withColumn("place", F.xxhash64("key", "key2", "copy")))
    return assign(rows, "place", n_shards, seed).drop("place")


def shard(docs: DataFrame, n_shards: int = 40, seed: int = 42) -> DataFrame:
    """The documents with `shard` and `slot` (renamed with a leading _ if taken); write them with partitionBy of the shard."""
    names = {x: f"_{x}" if x in docs.columns else x for x in ("shard", "slot")}
    # equal rows have equal keys, of 128 bits: one of them goes to all their places
    where = settle(plan(docs, n_shards, seed).select("key", "key2", "chunk", "shard", "slot"))
    key, key2 = row_hashes(docs, seed)
    rows = docs.select(packed(docs).alias("row"), key.alias("key"), key2.alias("key2")).dropDuplicates(["key", "key2"])
    placed = rows.join(where.filter("chunk = 0").drop("chunk"), ["key", "key2"])
    more = where.filter("chunk > 0")
    if not more.isEmpty():  # of rows with more copies than a chunk, the further chunks
        chunks = more.groupBy("key", "key2").agg(F.max("chunk").alias("_last"))
        spread = rows.join(chunks, ["key", "key2"]).withColumn("chunk", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_last")))).drop("_last")
        placed = placed.unionByName(spread.join(more, ["key", "key2", "chunk"]).drop("chunk"))
    return placed.select("row.*", F.col("shard").alias(names["shard"]), F.col("slot").alias(names["slot"]))


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    return plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
