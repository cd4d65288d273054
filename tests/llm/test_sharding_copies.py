"""Equal rows spread over shards like any others, and many of them are not one task's work."""

from collections import Counter

from pyspark.sql import functions as F

from perfloom.llm import sharding


def test_copies_spread(spark):
    """3000 rows, each twice, on 40 shards: pairs in one shard within the 99.9 % range of 1/40, and neither next to each other."""
    docs = spark.range(6000).select((F.col("id") % 3000).alias("doc_id"), F.lit("t").alias("text"))
    places = {}
    for r in sharding.shard(docs).collect():
        places.setdefault(r.doc_id, []).append((r.shard, r.slot))
    assert all(len(set(p)) == 2 for p in places.values()) and len(places) == 3000
    together = [p for p in places.values() if p[0][0] == p[1][0]]
    assert 47 <= len(together) <= 105  # binomial(3000, 1/40)
    assert sum(abs(p[0][1] - p[1][1]) == 1 for p in together) <= 8
    slots = Counter(p for v in places.values() for p in v)
    assert max(slots.values()) == 1 and {s for s, _ in slots} == set(range(40)) and all({j for s, j in slots if s == k} == set(range(150)) for k in range(40))


def test_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK", 500)
    docs = spark.range(30_000).select(F.when(F.col("id") < 20_000, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") < 20_000, F.lit("hot")).otherwise(F.lit(None)).cast("string").alias("text"))
    plan = sharding.plan(docs, 40)
    sizes = Counter(r.shard for r in plan.collect())
    assert set(sizes.values()) == {750}
    hot = Counter(r.shard for r in sharding.shard(docs, 40).filter("text = 'hot'").collect())
    assert sum(hot.values()) == 20_000 and all(420 < hot[s] < 580 for s in range(40))
    one = sharding.copies(docs.groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("n")).withColumns({"key": F.xxhash64("doc_id"), "key2": F.lit(1)}))
    per_task = one.filter("doc_id = 7").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert per_task < 8000 and Counter(r.copy for r in one.filter("doc_id = 7").collect()) == Counter(range(20_000))
    again = {tuple(r) for r in sharding.plan(docs.repartition(3), 40).select("doc_id", "copy", "shard", "slot").collect()}
    assert again == {tuple(r) for r in plan.select("doc_id", "copy", "shard", "slot").collect()}
