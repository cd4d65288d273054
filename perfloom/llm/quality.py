"""Quality rules: a threshold table compiled into one projection of built-in functions.

A rule names a measure and the range it must stay in. `measures` gives the
expression of each measure; `judge` compiles a table of rules into a boolean and
the list of failed rules, all within one projection without shuffles.

Defined cases: a null text has no words, lines or symbols; ratios over nothing
are 0 (mean word length, too). Repeated rows are judged alike. Columns of the input
that are named like a measure are not read; only the id and the text are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, words

#: Characters that count as symbols.
SYMBOLS = r"[#*$%&|<>]"
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to a in is that for it as was with be by on not he this are or his from at which but have an had they you were "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an "
    "le la les de des et un une du en que est pour qui dans ce il ne sur se pas plus par avec "
    "el los las una que y por con para su al lo como más o pero sus"
).split()
#: Words of a window that counts as repeated.
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """Fails where the measure is under `least` or over `most`; from `from_words` words on."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None
    from_words: int = 0


#: The production table.
RULES = (
    Rule("too_short", "n_words", least=10),
    Rule("too_long", "n_words", most=1_000_000),
    Rule("repeated_windows", "repeat_word_ratio", most=0.20),
    Rule("symbols", "symbol_ratio", most=0.10),
    Rule("word_length", "mean_word_chars", least=2, most=12),
    Rule("stop_words", "stop_word_ratio", least=0.02, from_words=20),
    Rule("duplicate_lines", "dup_line_ratio", most=0.30),
    Rule("alphabetic_words", "alpha_word_ratio", least=0.7),
    Rule("shouting", "upper_ratio", most=0.6, from_words=20),
)


def repeat_words(w: Column) -> Column:
    """Words in windows of WINDOW words that occur twice or more in the text.

    Windows are hashed; a text whose hashes are distinct ends there. Else equal
    hashes become neighbours by sorting, and the union of their windows is measured.
    """
    n = F.size(w)
    starts = F.when(n >= WINDOW, F.sequence(F.lit(1), n - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
    tagged = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def at(a: Column, i: Column) -> Column:
        return F.get(a, i)["h"]

    def places(a: Column) -> Column:
        def equal(i: Column, j: Column) -> Column:
            return F.coalesce(at(a, i) == at(a, j), F.lit(False))

        again = F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: equal(i, i - 1) | equal(i, i + 1))
        return F.array_sort(F.transform(again, lambda i: F.get(a, i)["i"]))

    covered = F.aggregate(
        F.flatten(F.transform(F.array(tagged), places)),
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(WINDOW), p - s["last"])).alias("n")),
        lambda s: s["n"],
    )
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered).cast("long")


def _with(value: Column, name: str, f) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0)).alias(name)


def counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each document: the id and the counts that measures are made of."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    base = docs.select(F.col(id_column).cast("long").alias("doc_id"), text.alias("_t"), words(F.col(text_column)).alias("_w"))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD))
    stop = list(dict.fromkeys(STOP_WORDS))
    letters = F.length(F.regexp_replace("_t", r"[^\p{L}]", ""))
    return base.select(
        "doc_id",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_t", SPACE, "")).cast("long").alias("word_chars"),
        (F.octet_length("_t") - F.octet_length(F.regexp_replace("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _with(lines, "_dup_lines", lambda x: F.struct(F.size(x).cast("long").alias("all"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))),
        repeat_words(F.col("_w")).alias("n_repeat_words"),
        F.length(F.col("_t")).cast("long").alias("n_chars"),
        letters.cast("long").alias("n_letters"),
        (letters - F.length(F.regexp_replace("_t", r"[^\p{L}]|\p{Lu}", ""))).cast("long").alias("n_upper"),
        # a word counts as alphabetic by a letter, as a stop word as it stands
        F.size(F.filter("_w", lambda x: x.rlike(r"\p{L}"))).cast("long").alias("n_alpha_words"),
        F.size(F.filter("_w", lambda x: F.lower(x).isin(stop))).cast("long").alias("n_stop_words"),
    ).select("*", F.col("_dup_lines.dup").alias("n_dup_lines"), F.col("_dup_lines.all").alias("n_lines")).drop("_dup_lines")


def measures() -> dict[str, Column]:
    """Measures by name, over the columns of `counts`."""

    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return {
        "n_words": F.col("n_words").cast("double"),
        "repeat_word_ratio": share("n_repeat_words", "n_words"),
        "symbol_ratio": share("n_symbols", "word_chars"),
        "mean_word_chars": share("word_chars", "n_words"),
        "stop_word_ratio": share("n_stop_words", "n_words"),
        "dup_line_ratio": share("n_dup_lines", "n_lines"),
        "alpha_word_ratio": share("n_alpha_words", "n_words"),
        "upper_ratio": share("n_upper", "n_letters"),
    }


def failed_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the failed rules, in the order of the table."""
    known = measures()

    def fails(r: Rule) -> Column:
        bad = F.lit(False)
        if r.least is not None:
            bad = bad | (known[r.measure] < F.lit(float(r.least)))
        if r.most is not None:
            bad = bad | (known[r.measure] > F.lit(float(r.most)))
        return bad & (F.col("n_words") >= r.from_words)

    return F.filter(F.array(*[F.when(fails(r), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Counts, `failed` (rule names) and `kept` for each document."""
    return counts(docs, id_column, text_column).withColumn("failed", failed_rules(rules)).withColumn("kept", F.size("failed") == 0)


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    from .common import table

    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), (~base_failed & F.col("kept")).alias("kept")
    )
