"""The pipeline's near-duplicate stage against brute force over all pairs."""

import random

from tests.llm.test_lines_words import changed


def sets(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_stage_drops_near_copies(spark):
    import corpus_pipeline

    rng = random.Random(9)
    words = [f"w{i:03}" for i in range(400)]
    passage = " ".join(rng.choices(words, k=30))
    base = [" ".join(rng.choices(words, k=k)) for k in (3, 5, 30, 60, 90, 200, 400)] + [f"{' '.join(rng.choices(words, k=60))} {passage}" for _ in range(8)]
    texts = [x for b in base for x in [b, b.upper(), *(changed(rng, b, rng.choice([1, 1, 2, 3, 8])) for _ in range(6))]] + [None, "", " \n", *base[:4]]
    # a chain: only neighbours are alike
    long = rng.choices(words, k=200)
    texts += [" ".join(long[i : i + 100]) for i in range(0, 60, 8)]
    rng.shuffle(texts)
    docs = [(i, t, 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id long, text string, n int")
    own, root = [sets(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(own[i] & own[j]) >= 0.8 * len(own[i] | own[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    got = corpus_pipeline.drop_near_duplicates(spark, df, "")
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == sorted(set(root))
    assert corpus_pipeline.drop_near_duplicates(spark, df.limit(0), "").collect() == []
