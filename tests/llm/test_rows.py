"""Rows keep their identity: null and repeated ids, rows that differ in one further column, names that operators use themselves."""

import random
from collections import Counter

from pyspark.sql import functions as F

from perfloom.llm import mixing, queries, sharding
from tests.llm.test_documents import WORDS
from tests.llm.test_models import speech

NAMES = ["_key", "_id", "_text", "_bad", "_text_key", "_at", "row", "key", "key2", "found", "group", "more", "id", "h0", "root", "node", "at", "one", "o", "shard", "_shard"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in NAMES) + ", tags map<string,string>"


def rows_of(rng):
    a, b, c, d = (speech(rng, x, 60) for x in ("en", "de", "fr", "en"))
    item = speech(rng, "en", 30)
    mixed = f"{speech(rng, 'de', 40)} {item} {speech(rng, 'de', 30)}"
    base = [(3, a, "en", "s0"), (5, b, "de", "s1"), (5, c, "fr", "s1"), (None, d, "en", None), (None, mixed, "de", "s0"), (6, mixed, "de", "s0"), (None, a, "en", "s2"), (None, "12 34", None, "s0"), (7, None, None, "s1"), (7, "", "en", "s1")]
    base += [(20 + i, speech(rng, x, 50), x, f"s{i % 3}") for i, x in enumerate(("en", "de", "fr") * 8)]
    base += [(50, speech(rng, "fr", 40), "fr", "s0")] * 2
    full = [(*r, len(r[1] or ""), *[f"{c}{i}" for c in NAMES], {"k": str(i)}) for i, r in enumerate(base)]
    full[-1] = full[-2]  # one row twice, in all columns
    return full, item, (a, b, c, d, mixed)


def plain(r):
    return tuple(tuple(sorted(v.items())) if isinstance(v, dict) else v for v in r)


def test_stages_lose_and_leak_nothing(spark, tmp_path):
    import corpus_pipeline

    full, item, (a, b, c, d, mixed) = rows_of(random.Random(12))
    spark.createDataFrame(full, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = Counter(plain(r) for r in full)
    one = corpus_pipeline.identify_language(spark, docs, str(tmp_path))
    assert one.columns == docs.columns
    got = Counter(plain(r) for r in one.collect())
    assert got == Counter({r: n for r, n in want.items() if r[1] not in (None, "", "12 34")})
    two = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    assert two.columns == docs.columns
    got = [plain(r) for r in two.collect()]
    texts = Counter((r[1] or "") for r in got)
    assert set(texts) == {(r[1] or "") for r in full} and set(texts.values()) == {1} and all(r in want for r in got)
    kept = {r[1]: r[0] for r in got}
    assert kept[a] == 3 and kept[mixed] == 6 and kept[b] == kept[c] == 5 and kept[d] is None
    three = corpus_pipeline.decontaminate_benchmark(spark, docs, str(tmp_path))
    assert three.columns == docs.columns and Counter(plain(r) for r in three.collect()) == Counter({r: n for r, n in want.items() if r[1] != mixed})
    four = corpus_pipeline.mix_sources(spark, docs, str(tmp_path))
    assert four.columns == docs.columns and all(plain(r) in want for r in four.collect())
    five = corpus_pipeline.shard_documents(spark, docs, str(tmp_path))
    assert five.columns == [*docs.columns, "_shard", "slot"] or len(set(five.columns)) == len(docs.columns) + 2
    assert Counter(plain(r[: len(docs.columns)]) for r in five.collect()) == want
    none = docs.limit(0)
    for stage in (corpus_pipeline.drop_near_duplicates, corpus_pipeline.mix_sources, corpus_pipeline.shard_documents, corpus_pipeline.decontaminate_benchmark, corpus_pipeline.identify_language):
        assert stage(spark, none, str(tmp_path)).collect() == []


def test_mix_keeps_rows_that_differ_in_one_column(spark):
    rows = [(1, "a b c", "s", "en", "x"), (1, "a b c", "s", "fr", "y"), (2, "d e", "t", "en", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, _key string")
    got = Counter(tuple(r) for r in mixing.mix(df, whole=True).collect())
    assert set(got) <= set(rows) and got[rows[0]] and got[rows[1]]
    placed = sharding.shard(df, 2)
    assert Counter(tuple(r)[:5] for r in placed.collect()) == Counter(rows)


def test_registered_queries_on_a_small_table(spark, tmp_path):
    """Each query over a table with odd rows: one row a document or page, and the columns that can be told without the method."""
    import zlib

    full, item, _ = rows_of(random.Random(13))
    docs = spark.createDataFrame(full, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, "x y")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, f"http://{'ads' if i % 2 else 'www'}.x.org/p{i}/en", "h") for i in range(40)] + [(None, None, None)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(i, i % 2 == 0 and 1 or 0, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (None, None, None, None)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(i, [i / 64, -i / 64] * 16, i % 3) for i in range(20)] + [(None, None, None), (20, [float("nan")] * 32, 1)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    sf = str(tmp_path)
    run = {name: q(spark, sf).collect() for name, q in queries.QUERIES.items() if name.startswith("op")}
    assert len(run["op1_url_filters"]) == 41 and all(r.verdict in ("allow", "block") for r in run["op1_url_filters"])
    assert {r.page_id: r.verdict for r in run["op1_url_filters"]}[33] == "block"
    for name in ("op2_lm_scoring", "op3_language_id", "op4_mixing", "op5_sharding", "op6_line_dedup", "op7_quality_rules", "op9_simhash_near_dedup", "op13_secret_scans"):
        assert Counter(r.doc_id for r in run[name]) == Counter(r[0] for r in full), name
    n_words = Counter((r[0], len(WORDS.findall(r[1] or ""))) for r in full)
    assert Counter((r.doc_id, r.n_words) for r in run["op7_quality_rules"]) == n_words
    assert Counter((r.doc_id, r["size"]) for r in run["op4_mixing"]) == n_words
    assert Counter((r.doc_id, r.n_tokens - 1) for r in run["op2_lm_scoring"]) == n_words
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in run["op5_sharding"]) == Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in full)
    by_shard = Counter(r.shard for r in run["op5_sharding"])
    assert max(by_shard.values()) - min(by_shard.get(s, 0) for s in range(40)) <= 1
    assert all(r.taken <= 2 * r["size"] for r in run["op4_mixing"])
    assert {r.doc_id for r in run["op8_benchmark_decontamination"]} == {None, 6}
    assert len(run["op10_chat_formatting"]) == 3
    parts = Counter(r[3] or "" for r in full)
    assert Counter(r.part for r in run["op11_filter_interaction_audit"]) == {p: 600 for p in parts}
    assert all(r.kept + r.removed <= parts[r.part] for r in run["op11_filter_interaction_audit"])
    assert sorted(r.vec_id for r in run["op12_vector_code_compression"]) == list(range(20))


def test_sharding_is_uniform(spark):
    """Over several seeds, rows spread over shards as a uniform shuffle does (chi-square under its 99.9 % point)."""
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    seen = Counter((r.doc_id < 1000, r.shard) for seed in (1, 2, 3) for r in sharding.plan(docs, 8, seed).collect())
    chi = sum((seen[half, s] - 375) ** 2 / 375 for half in (True, False) for s in range(8))
    assert chi < 37.7
