"""Finding detectors over symbols and their external calls, and what is made of their findings.

symbols: rows (id, name, file, line, loc, complexity, nesting, is_async, call_sites, pagerank, is_recursive, percent_total);
externals: rows (id, ord, name, receiver, category, tier, line, in_loop, in_await), `ord` being the call's place in its symbol;
findings: rows (id, kind, severity, effort, confidence, line, n).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import bumped, is_method_call, is_synthetic

#: How sure a category is, by how it was told.
TIERS = {"imported_module": 0.95, "receiver_pattern": 0.80, "method_signature": 0.65}
#: What makes a body heavy, cached calls worthwhile, logs a burden.
COMPLEX, VERY_COMPLEX, LONG, VERY_LONG, NESTED, VERY_NESTED = 10, 15, 80, 150, 4, 5
CACHE_SITES, CACHE_COMPLEX, CACHE_LOC, LOG_CALLS, LOG_SITES = 5, 5, 20, 3, 10
SEVERITIES = ("low", "medium", "high")
EFFORTS = ("trivial", "small", "medium", "large")


def rank_of(column: Column | str, names: tuple[str, ...]) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(*[F.when(c == n, i) for i, n in enumerate(names)], F.lit(-1))


def _row(kind: str, severity, effort, confidence, line="line", n=None) -> list[Column]:
    def lit(x):
        return x if isinstance(x, Column) else F.lit(x)

    return [F.col("id"), F.lit(kind).alias("kind"), lit(severity).alias("severity"), lit(effort).alias("effort"), lit(confidence).cast("double").alias("confidence"), F.col(line).alias("line"), (F.lit(1) if n is None else n).cast("long").alias("n")]


def _calls(externals: DataFrame, symbols: DataFrame, which: Column, kind: str, severity: str, effort: str, confidence: float | None = None) -> DataFrame:
    """One finding for each symbol with offending calls, at the first one's line; confidence: the best tier's."""
    tier = F.coalesce(*[F.when(F.col("tier") == t, F.lit(c)) for t, c in TIERS.items()], F.lit(0.0))
    bad = externals.filter(which & is_method_call(F.col("name")))
    per = bad.groupBy("id").agg(F.max(tier).alias("best"), F.min_by("line", "ord").alias("line"), F.count(F.lit(1)).alias("n"))
    return per.join(symbols.select("id"), "id", "left_semi").select(*_row(kind, severity, effort, F.col("best") if confidence is None else F.lit(confidence), n=F.col("n")))


def n_plus_one(symbols: DataFrame, externals: DataFrame) -> DataFrame:
    return _calls(externals, symbols, F.col("in_loop") & F.col("category").isin("db", "cache"), "n_plus_one", "high", "small")


def blocking_in_async(symbols: DataFrame, externals: DataFrame) -> DataFrame:
    return _calls(externals, symbols.filter("is_async"), ~F.col("in_await") & F.col("category").isin("db", "network", "io"), "blocking_in_async", "high", "trivial")


def noisy_logs(symbols: DataFrame, externals: DataFrame) -> DataFrame:
    return _calls(externals, symbols, F.col("in_loop") & (F.col("category") == "log"), "noisy_log", "medium", "trivial", 0.85)


def expensive_compute(symbols: DataFrame) -> DataFrame:
    c, loc, nest = F.col("complexity"), F.col("loc"), F.col("nesting")
    heavy = symbols.filter((c >= COMPLEX) | (loc >= LONG) | (nest >= NESTED))
    severity = F.when((c >= VERY_COMPLEX) | (loc >= VERY_LONG), "high").when((c >= COMPLEX) | (loc >= LONG), "medium").otherwise("low")
    effort = F.when((loc >= VERY_LONG) | (nest >= VERY_NESTED), "large").when((loc >= LONG) | (c >= VERY_COMPLEX), "medium").otherwise("small")
    return heavy.select(*_row("expensive_compute", severity, effort, 0.70))


def recursive(symbols: DataFrame) -> DataFrame:
    return symbols.filter(F.col("is_recursive") & ~is_synthetic(F.col("name"))).select(*_row("recursive", "medium", "medium", 1.0))


def missing_caching(symbols: DataFrame, externals: DataFrame) -> DataFrame:
    """Symbols that are called often, do some work and seem pure: no call of theirs reaches outside."""
    effects = externals.filter(F.col("category").isin("db", "network", "io", "queue")).select("id").distinct()
    often = symbols.filter((F.col("call_sites") >= CACHE_SITES) & ((F.col("complexity") >= CACHE_COMPLEX) | (F.col("loc") >= CACHE_LOC)) & ~F.col("is_recursive") & is_method_call(F.col("name")))
    return often.join(effects, "id", "left_anti").select(*_row("missing_caching", "medium", "small", 0.55))


def log_amplification(symbols: DataFrame, externals: DataFrame, p90: float) -> DataFrame:
    logs = externals.filter("category = 'log'").groupBy("id").agg(F.count(F.lit(1)).alias("logs")).filter(F.col("logs") >= LOG_CALLS)
    hot = (F.lit(p90 > 0) & (F.col("pagerank") >= p90)) | (F.col("call_sites") >= LOG_SITES)
    return symbols.filter(hot).join(logs, "id").select(*_row("log_amplification", "medium", "trivial", 0.80, n=F.col("logs")))


def hot_logs(findings: DataFrame, symbols: DataFrame, p90: float) -> DataFrame:
    """The findings, noisy logs of the top tenth by rank being raised from medium to high."""
    if p90 <= 0:
        return findings
    hot = symbols.filter(F.col("pagerank") >= p90).select("id", F.lit(True).alias("_hot"))
    up = F.col("_hot") & (F.col("kind") == "noisy_log") & (F.col("severity") == "medium")
    return findings.join(hot, "id", "left").withColumn("severity", F.when(up, "high").otherwise(F.col("severity"))).drop("_hot")


def first_of(findings: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first finding of each key in an order that is stated."""
    return findings.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def detect(symbols: DataFrame, externals: DataFrame, p90: float) -> DataFrame:
    """All passes in their order: calls and bodies, recursion, caching, log volume, hot logs, impact; one finding for each (id, kind, line)."""
    found = noisy_logs(symbols, externals).unionByName(n_plus_one(symbols, externals)).unionByName(blocking_in_async(symbols, externals)).unionByName(expensive_compute(symbols))
    found = found.unionByName(recursive(symbols)).unionByName(missing_caching(symbols, externals)).unionByName(log_amplification(symbols, externals, p90))
    found = hot_logs(found, symbols, p90)
    impact = symbols.select("id", "percent_total", "pagerank", "call_sites")
    raised = found.join(impact, "id").withColumn("severity", bumped(F.col("severity"), F.col("percent_total"), F.col("pagerank"), F.col("call_sites"), F.lit(float(p90)))).drop("percent_total", "pagerank", "call_sites")
    return first_of(raised, ["id", "kind", "line"], [-rank_of("severity", SEVERITIES), F.desc("confidence")])


def graph_n_plus_one(nodes: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """Nodes (id, file, line, complexity, db_reached) of changed files that reach three or more database calls and branch; confidence grows with the calls."""
    from .symbols import in_scope

    bad = in_scope(nodes, changed).filter("db_reached >= 3 and complexity >= 3")
    sure = F.greatest(F.lit(0.75), F.least(F.lit(0.95), 0.65 + 0.04 * F.col("db_reached")))
    return bad.select("id", F.lit("graph_n_plus_one").alias("kind"), "line", F.round(sure, 6).alias("confidence"))


def dead_in_changed(symbols: DataFrame, edges: DataFrame, entries: DataFrame, changed: DataFrame) -> DataFrame:
    """Symbols (id, kind, file, line) of changed files that nothing calls and that are no entry and no class, by file and line."""
    from .symbols import in_scope

    called = edges.select(F.col("dst").alias("id")).distinct()
    dead = symbols.filter("kind <> 'class'").join(called, "id", "left_anti").join(entries.select("id").distinct(), "id", "left_anti")
    return in_scope(dead, changed).select("id", "file", "line").orderBy("file", "line", "id")


#: Text patterns that point to a defect: kind, severity, pattern of one line.
LINE_PATTERNS = (
    ("silent_except", "medium", r"^\s*except\b[^:]*:\s*(pass\s*)?(#.*)?$"),
    ("sql_concatenation", "high", r"""(?i)["'](select|insert|update|delete)\b[^"']*["']\s*(\+|%|\.format\()|f["'](select|insert|update|delete)\b[^"']*\{"""),
    ("sentinel_return", "low", r"^\s*return\s+(-1|None|null|\"\"|'')\s*;?\s*(#.*|//.*)?$"),
)


def text_patterns(files: DataFrame) -> DataFrame:
    """Rows (path, line, kind, severity) of the lines of files (path, text) that match a pattern; an `except` counts if it or the next line only passes.

    A line sees the next one inside the file's row: nothing is shuffled.
    """

    def hits(code: Column, at: Column) -> Column:
        passes = code.rlike(r"\bpass\b") | F.coalesce(F.get("_lines", at + 1).rlike(r"^\s*(pass|\.\.\.)\s*(#.*)?$"), F.lit(False))
        found = [F.when(code.rlike(p) & (passes if kind == "silent_except" else F.lit(True)), F.struct((at + 1).alias("line"), F.lit(kind).alias("kind"), F.lit(s).alias("severity"))) for kind, s, p in LINE_PATTERNS]
        return F.array_compact(F.array(*found))

    lines = files.select("path", F.split("text", "\n").alias("_lines"))
    return lines.select("path", F.inline(F.flatten(F.transform("_lines", hits))))


def ordered(findings: DataFrame, *more: str) -> DataFrame:
    """Severity from high to low, then the columns named."""
    return findings.orderBy(-rank_of("severity", SEVERITIES), *more)


def capped(findings: DataFrame, cap: int, order: list, quota: int | None = None) -> DataFrame:
    """The first rows in the order, no more of a kind than its quota; a kind keeps a bounded head before anything meets in one place."""
    quota = max(cap // 4, 3) if quota is None else quota
    head = findings.withColumn("_r", F.row_number().over(Window.partitionBy("kind").orderBy(*order))).filter(F.col("_r") <= quota).drop("_r")
    return head.orderBy(*order).limit(cap)


def union_first(sources: list[DataFrame], keys: list[str], cap: int, order: list[str]) -> DataFrame:
    """Rows of several sources, a key's first source winning, in the order of sources; at most `cap`."""
    all_ = None
    for k, s in enumerate(sources):
        own = s.withColumn("source", F.lit(k))
        all_ = own if all_ is None else all_.unionByName(own)
    return first_of(all_, keys, ["source", *order]).orderBy("source", *order, *keys).limit(cap)


def new_smells(base: DataFrame, now: DataFrame) -> DataFrame:
    """Rows (id, kind, change) of smells (id, kind) that are new or fixed, for nodes that both sides have."""
    both = base.select("id").distinct().join(now.select("id").distinct(), "id", "left_semi")
    a, b = (x.select("id", "kind").distinct() for x in (base.filter("kind is not null"), now.filter("kind is not null")))
    gone, new = a.join(b, ["id", "kind"], "left_anti").withColumn("change", F.lit("fixed")), b.join(a, ["id", "kind"], "left_anti").withColumn("change", F.lit("new"))
    return gone.unionByName(new).join(both, "id", "left_semi")


def signal_summary(signals: DataFrame, n_candidates: int) -> DataFrame:
    """One row: signals by tier, and their share of all candidates (1 where there are none)."""
    by = [F.count(F.when(F.col("tier") == i, 1)).alias(n) for i, n in enumerate(("minor", "important", "critical"))]
    ratio = F.lit(1.0) if n_candidates == 0 else F.count(F.lit(1)) / F.lit(float(n_candidates))
    return signals.agg(F.count(F.lit(1)).alias("signals"), *by, ratio.alias("ratio"))


def focal(suggestions: DataFrame, commentable: DataFrame, most: int) -> DataFrame:
    """The surest suggestions (id, file, line, confidence) with a valid place in a commentable file."""
    return suggestions.filter("file <> '' and line >= 1").join(commentable.select(F.col("path").alias("file")).distinct(), "file", "left_semi").orderBy(F.desc("confidence"), "file", "line", "id").limit(most)


def view(findings: DataFrame, kinds: list[str] | None = None, severities: list[str] | None = None, text: str | None = None) -> DataFrame:
    """Findings of the kinds and severities chosen, whose kind or file holds the text; the table's order."""
    out = findings
    if kinds:
        out = out.filter(F.col("kind").isin(*kinds))
    if severities:
        out = out.filter(F.col("severity").isin(*severities))
    if text:
        low = F.lit(text.lower())
        out = out.filter(F.contains(F.lower("kind"), low) | F.contains(F.lower("file"), low))
    return ordered(out, "file", "line")
