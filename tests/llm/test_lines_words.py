"""Lines of changed words against brute force over all pairs."""

import random

from pyspark.sql import functions as F

from perfloom.llm import lines
from tests.llm.test_models import edits


def changed(rng, line, n):
    w = line.split(" ")
    for _ in range(n):
        at = rng.randrange(len(w))
        match rng.randrange(3):
            case 0:
                w[at] = f"new{rng.randrange(9)}word"
            case 1:
                w.insert(at, "more")
            case _:
                del w[at]
    return " ".join(w)


def near(x, y):
    a, b = x.split(), y.split()
    s, t = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
    similar = s and t and len(s & t) / len(s | t) >= 0.8
    return edits(x, y) <= 2 or edits(a, b) <= min(len(a), len(b)) // 20 or similar


def test_changed_words(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i:03}" for i in range(300)]
    base = [" ".join(rng.choices(vocabulary, k=k)) for k in (8, 19, 20, 21, 28, 40, 45, 60, 110)]
    rows = [x for b in base for x in [b, *(changed(rng, b, rng.choice([1, 1, 2, 3, 5, 9])) for _ in range(7)), b + " " + " ".join(rng.choices(vocabulary, k=len(b.split()) // 5))]]
    rng.shuffle(rows)
    rows = list(dict.fromkeys(rows))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    want = {i for i, x in enumerate(rows) if any(near(x, y) for y in rows[:i])}
    got = {r.doc_id for r in lines.removals(df, words_per_edit=lines.WORDS_PER_EDIT).collect()}
    assert got == want
    # what two edits of characters reach is a part of it
    assert {r.doc_id for r in lines.removals(df).collect()} < want


def test_query_links_a_changed_word(spark, tmp_path):
    line = " ".join(f"word{i}" for i in range(28))
    spark.createDataFrame([(0, line), (1, line.replace("word9", "something"))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = lines.op6_line_dedup(spark, str(tmp_path)).groupBy().agg(F.sum("n_near").alias("n")).first()
    assert got.n == 1


def test_short_lines_and_many_variants(spark):
    """One edit for each 12 characters, up to two; variants of one line that are not all near each other; clashing columns."""
    rng = random.Random(11)
    texts = ["".join(rng.choices("abcd", k=k)) for k in (5, 11, 12, 13, 22, 23, 24, 25, 30, 40) for _ in range(2)]
    rows = []
    for t in texts:
        for _ in range(6):
            c = list(t)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                c[rng.randrange(len(c))] = rng.choice("abcdxy")
                if rng.random() < 0.3:
                    del c[rng.randrange(len(c))]
            rows.append("".join(c))
    base = "".join(rng.choices("abcdefgh", k=60))
    for i in range(60):
        at = rng.randrange(50)
        rows.append(base[:at] + f"{i:02}" + base[at + 2 :])
    rng.shuffle(rows)
    rows = [x for x in dict.fromkeys(rows) if x]

    def near(x, y):
        return edits(x, y) <= min(2, min(len(x), len(y)) // 12)

    df = spark.createDataFrame([(i, x, "k", 1) for i, x in enumerate(rows)], "doc_id long, text string, _text_key string, _id int")
    want = {i for i, x in enumerate(rows) if any(near(x, y) and min(len(x), len(y)) >= 12 for y in rows[:i])}
    got = {r.doc_id for r in lines.removals(df, min_chars=12, chars_per_edit=12).collect()}
    assert got == want and len(want) > 20
    clean = lines.dedupe(df, min_chars=12, chars_per_edit=12)
    assert clean.columns == df.columns
    assert {r.doc_id: (r.text, r._text_key, r._id) for r in clean.collect()} == {i: ("" if i in want else x, "k", 1) for i, x in enumerate(rows)}


def test_long_lines_need_no_segments(spark):
    """Edits of characters around the length from which shingles alone find them, words joined and split among them; with fewer keys a line."""
    rng = random.Random(3)
    rows = []
    for k in (12, 14, 15, 16, 17, 18, 19, 21, 30):
        for vocabulary in (["a", "bc", "d"], [f"w{i}" for i in range(500)]):
            base = " ".join(rng.choices(vocabulary, k=k)) + f" end{k}"
            rows.append(base)
            for _ in range(8):
                c = list(base)
                for _ in range(rng.choice([1, 2, 2, 3])):
                    at = rng.randrange(1, len(c) - 1)
                    match rng.randrange(4):
                        case 0:
                            c[at] = "x"
                        case 1:
                            c[at] = " "
                        case 2:
                            c.insert(at, " ")
                        case _:
                            spaces = [i for i, x in enumerate(c) if x == " " and 0 < i < len(c) - 1]
                            del c[rng.choice(spaces)]
                rows.append("".join(c))
    rng.shuffle(rows)
    rows = [x for x in dict.fromkeys(rows) if x == x.strip()]

    def near(x, y):
        a, b = x.split(), y.split()
        s, t = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
        return edits(x, y) <= min(2, min(len(x), len(y)) // 12) or edits(a, b) <= min(len(a), len(b)) // 20 or bool(s and t and len(s & t) / len(s | t) >= 0.8)

    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    want = {i for i, x in enumerate(rows) if any(near(x, y) and min(len(x), len(y)) >= 12 for y in rows[:i])}
    got = {r.doc_id for r in lines.removals(df, min_chars=12, words_per_edit=lines.WORDS_PER_EDIT, chars_per_edit=12).collect()}
    assert got == want and len(want) > 50
    twice = spark.createDataFrame([(" ".join(f"v{i}" for i in range(40)) + end,) for end in ("", "x")], "line string")
    keys = lines.shared_keys(twice, 2, 12, 12, lines.WORDS_PER_EDIT, bytes(lines.BUCKETS))
    assert keys.groupBy("a").count().agg(F.max("count")).first()[0] <= 2 * lines.TOUCHED + 1
    assert keys.filter("by_words = 0").isEmpty()


def test_common_passages_make_few_pairs(spark):
    """Lines that share a passage, and are else unlike, don't meet pair by pair; the ones that are near still do."""
    rng = random.Random(17)
    passage = " ".join(f"common{i}" for i in range(14))
    rows = [" ".join(f"v{rng.randrange(10**6)}" for _ in range(30)) + " " + passage for _ in range(300)]
    rows += [rows[k].replace("common3 ", "else ") for k in (5, 70, 299)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    late = lines.frequent(lines.sampled(df))
    met = lines.shared_keys(df.select(F.col("text").alias("line")), 2, 12, 12, lines.WORDS_PER_EDIT, late)
    assert met.groupBy("group").count().agg(F.max("count")).first()[0] < 30
    got = {r.doc_id for r in lines.removals(df, min_chars=12, words_per_edit=lines.WORDS_PER_EDIT, chars_per_edit=12).collect()}
    assert got == {300, 301, 302}


def test_expressions_are_worked_out_once(spark):
    """Spark adds a filter to an explode that works out the exploded array again."""
    df = spark.createDataFrame([(0, "a line of some words")], "doc_id long, text string")
    own = lines.line_keys(lines.lines_of(df).withColumn("a", F.xxhash64("line")), 2, 12, 12, lines.WORDS_PER_EDIT, bytes(lines.BUCKETS))
    plan = lines.exploded(own, "doc_id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_repeated_lines_and_odd_blanks(spark):
    """A line that a sample holds often has its keys made once, and partners all the same; blanks of any kind part words."""
    base = " ".join(f"word{i}" for i in range(22))
    rows = [base] * 50 + [base.replace("word9", "other"), base.replace(" ", "  "), base.replace(" ", "\t").replace("word3", "third"), "far away from all of these lines"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.why for r in lines.removals(df, min_chars=12, words_per_edit=lines.WORDS_PER_EDIT, chars_per_edit=12).collect()}
    assert got == {i: "exact" if i < 50 else "near" for i in range(1, 53)}


def test_shuffles_behind_kept_tables_are_removed(spark):
    import time

    from perfloom.llm.common import Scratch

    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    with Scratch(spark) as scratch:
        scratch.keep(spark.range(400_000).selectExpr("xxhash64(id) AS k").groupBy("k").count())
        before = files.getAllFiles().size()
        scratch.free()
        until = time.time() + 20
        while files.getAllFiles().size() >= before and time.time() < until:
            time.sleep(0.2)
        assert files.getAllFiles().size() < before
