"""The pipeline's mixing stage hands on whole texts, and as near the targets as these allow."""

import random
from collections import Counter

from perfloom.llm import mixing


def test_stage_keeps_texts_whole(spark):
    import corpus_pipeline

    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([5, 40, 300, 2000]))), f"s{i % 5}", 1) for i in range(60)] + [(90, "only one", "t", 1), (91, None, "u", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    texts, words = {i: t for i, t, *_ in rows}, Counter()
    for r in corpus_pipeline.mix_sources(spark, df, "").collect():
        assert r.text == texts[r.doc_id] and r.n_chars == 1
        words[r.source] += len(r.text.split())
    plan, taken = mixing.plan(df, whole=True).collect(), Counter()
    for r in plan:
        taken[r.source] += r.taken
        assert not r["size"] or r.taken % r["size"] == 0
    assert +taken == +words
    for s, target in {(r.source, r.target) for r in plan}:
        assert 2 * abs(words[s] - target) <= max(r["size"] for r in plan if r.source == s) + 1
