"""Language identification as mixture inference.

Each language has a distribution over byte trigrams of letters and word gaps
(hashed to BUCKETS), learnt from a bounded sample of labelled documents. A
document is a mixture: expectation-maximisation estimates the languages'
proportions from the trigrams' likelihoods. The set of languages is chosen by
penalised likelihood: starting from those with SMALLEST of the mixture of all, the smallest goes as long as the
likelihood less PENALTY * log(trigrams) for each language doesn't fall. The table of a language takes 256 kB;
any number of languages is learnt.

Defined cases: a null text, or one without a letter, is `und` with score 0, as
is every text if there is nothing to learn from; score is the share of the predicted language; ties go to the
first language by code point; repeated rows are predicted alike; extra columns
are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import packed, table

#: Labelled documents of a language that are learnt from (in expectation, by hash).
SAMPLE = 2000
BUCKETS = 1 << 16
STEPS, PENALTY, SMALLEST = 12, 3.0, 0.02
UND = "und"


def letters(text: Column) -> Column:
    """Lower-cased letters, other runs being one blank."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "), F.lit(" "))


def grams(text: bytes):
    """Buckets of the byte trigrams of a prepared text."""
    import numpy as np

    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(16)


def learn(labelled: DataFrame, sample: int = SAMPLE) -> tuple[list[str], object]:
    """Languages, and log-probabilities (BUCKETS, languages), from rows (doc_id, text, lang)."""
    import numpy as np

    usable = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sizes = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(sizes)
    if not names:
        return [], None
    rate = F.coalesce(*[F.when(F.col("lang") == x, F.lit(min(1.0, sample / n))) for x, n in sizes.items()])
    chance = F.pmod(F.xxhash64(F.lit(7), "doc_id", "text"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    chosen = usable.filter(chance < rate).select("lang", letters(F.col("text")).alias("text"))

    def count(batches):
        import pyarrow as pa

        sums: dict = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                found = np.bincount(grams(text.as_py()), minlength=BUCKETS)
                sums[lang] = sums[lang] + found if lang in sums else found
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(total[at])], names=["lang", "bucket", "n"])

    # at most languages * BUCKETS rows
    rows = chosen.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    table_ = np.full((BUCKETS, len(names)), 0.5)
    place = {x: i for i, x in enumerate(names)}
    at = np.array([place[x] for x in rows.column("lang").to_pylist()], np.int64)
    np.add.at(table_, (rows.column("bucket").to_numpy(), at), rows.column("n").to_numpy())
    return names, np.log(table_ / table_.sum(axis=0)).astype(np.float32)


def mixture(logp, weight, total: float, steps: int = STEPS):
    """Proportions and log-likelihood of the mixture of all columns of logp."""
    import numpy as np

    top = logp.max(axis=1, keepdims=True)
    p = np.exp(logp - top)
    share = np.full(logp.shape[1], 1 / logp.shape[1], p.dtype)
    for _ in range(steps):
        mixed = p @ share
        share = share * ((weight / mixed) @ p) / total
    return share, float(weight @ np.log(p @ share)) + float(weight @ top[:, 0])


def infer(found, logp, penalty: float = PENALTY):
    """(language index, its share, log-likelihood a trigram, languages of the set) of the buckets of a text."""
    import numpy as np

    counts = np.bincount(found, minlength=BUCKETS)
    at = np.flatnonzero(counts)
    weight, own, total = counts[at].astype(np.float32), logp[at], float(len(found))
    single = weight @ own
    cost = penalty * np.log(max(total, 2.0))
    best = int(np.argmax(single))
    share, like = mixture(own, weight, total) if logp.shape[1] > 1 else (np.ones(1), float(single[0]))
    active = np.flatnonzero(share >= SMALLEST)
    if len(active) <= 1:
        return best, 1.0, float(single[best]) / total, 1
    if len(active) < len(share):
        share, like = mixture(own[:, active], weight, total)
    while len(active) > 1:
        fewer = np.delete(active, np.argmin(share))
        less, lower = mixture(own[:, fewer], weight, total)
        if lower < like - cost:
            break
        active, share, like = fewer, less, lower
    k = int(np.argmax(share))
    return int(active[k]), float(min(1.0, share[k] / share.sum())), like / total, len(active)


def judged(spark: SparkSession, names: list[str], logp, text: Column) -> Column:
    """struct(lang_pred, score, mean_logp, n_languages) of a text; nothing else of the row is read."""
    model = spark.sparkContext.broadcast(logp)
    text = text.cast("string")
    ready = F.when(text.rlike(r"\p{L}"), letters(text))

    @F.arrow_udf("struct<lang_pred string, score double, mean_logp double, n_languages int>")
    def run(texts: pa.Array) -> pa.Array:
        from . import langid

        out = []
        for t in texts.cast(pa.binary()):
            if not names or t.as_py() is None:
                out.append((langid.UND, 0.0, None, 0))
                continue
            k, share, mean, n = langid.infer(langid.grams(t.as_py()), model.value)
            out.append((names[k], share, mean, n))
        cols = list(zip(*out, strict=True)) or [[], [], [], []]
        kinds = (pa.string(), pa.float64(), pa.float64(), pa.int32())
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["lang_pred", "score", "mean_logp", "n_languages"])

    return run(ready)


def predict(docs: DataFrame, names: list[str], logp) -> DataFrame:
    """Rows (doc_id, lang_pred, score, mean_logp, n_languages), one for each document; only the text is read."""
    found = judged(docs.sparkSession, names, logp, F.col("text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), found.alias("found")).select("doc_id", "found.*")


def spoken(docs: DataFrame, least: float) -> DataFrame:
    """The rows, all columns as they are, whose text has a language that explains its trigrams better than `least` in the mean."""
    names, logp = learn(_labelled(docs))
    rows = docs.select(packed(docs).alias("row"), judged(docs.sparkSession, names, logp, F.col("text")).alias("found"))
    return rows.filter((F.col("found.lang_pred") != UND) & (F.col("found.mean_logp") >= least)).select("row.*")


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def _labelled(docs: DataFrame) -> DataFrame:
    kinds = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return kinds.filter(~held_out(F.col("doc_id")))


def train_and_predict(docs: DataFrame) -> DataFrame:
    return predict(docs, *learn(_labelled(docs)))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = train_and_predict(table(spark, sf_dir, "documents"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "mean_logp", "n_languages")
