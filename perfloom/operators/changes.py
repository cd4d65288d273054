"""Rollups of findings, reports, commits and change sets; columns are named by the caller where they may differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import half_up
from .detectors import EFFORTS, SEVERITIES, capped, first_of, rank_of
from .graph import settle
from .profile import global_rank

#: Least confidence, rows of a category and rows in all that a review shows.
SURE, PER_CATEGORY, IN_ALL = 0.75, 5, 20


def by_kind(findings: DataFrame) -> DataFrame:
    return findings.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def by_category(findings: DataFrame) -> DataFrame:
    """Rows (category, kind, n, total): the category's total beside each kind's."""
    per = findings.groupBy("category", "kind").agg(F.count(F.lit(1)).alias("n"))
    total = per.groupBy("category").agg(F.sum("n").alias("total"))
    return per.join(total, "category").select("category", "kind", "n", "total")


def top_findings(findings: DataFrame, cap: int = 50) -> DataFrame:
    return capped(findings, cap, [-rank_of("severity", SEVERITIES), "id"])


def immediate_fixes(findings: DataFrame, cap: int = 50) -> DataFrame:
    """What is worth it now: not low, little effort; the worst and least laborious first."""
    quick = findings.filter((F.col("severity") != "low") & F.col("effort").isin("trivial", "small"))
    return capped(quick, cap, [-rank_of("severity", SEVERITIES), rank_of("effort", EFFORTS), "file", "line", "id"])


def refactor_candidates(findings: DataFrame, cap: int = 30) -> DataFrame:
    """Nodes with two findings, a laborious one, or a long body; most findings first."""
    per = findings.groupBy("node_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("kind").alias("kinds"), F.max(rank_of("severity", SEVERITIES)).alias("worst"), F.max(rank_of("effort", EFFORTS)).alias("effort"), F.max("loc").alias("loc"))
    return per.filter("n >= 2 or effort = 3 or loc >= 100").orderBy(F.desc("n"), F.desc("loc"), "node_id").limit(cap)


def tier_of(category: Column, severity: Column) -> Column:
    """2 critical, 1 important, 0 minor."""
    security, core = category == "security", category.isin("reliability", "sql")
    return F.when((security | core) & (severity == "high"), 2).when(security | (core & (severity == "medium")) | (severity == "high"), 1).otherwise(0)


def signals(findings: DataFrame) -> DataFrame:
    """Findings that clear the bar, one for each (file, line, kind): five of a category and twenty in all at most, by tier and impact."""
    told = findings.withColumns({"tier": tier_of(F.col("category"), F.col("severity")), "impact": (rank_of("severity", SEVERITIES) + 1) * F.col("confidence")})
    one = first_of(told.filter((F.col("confidence") >= SURE) & (F.col("tier") >= 1)), ["file", "line", "kind"], ["id"])
    order = [F.desc("tier"), F.desc("impact"), "id"]
    head = one.withColumn("_r", F.row_number().over(Window.partitionBy("category").orderBy(*order))).filter(F.col("_r") <= PER_CATEGORY).drop("_r")
    return head.orderBy(*order).limit(IN_ALL)


def diff(base: DataFrame, now: DataFrame, key: str, measure: str) -> DataFrame:
    """Rows (key, change, delta): added and removed keys, regressions and improvements of a measure that should be small."""
    a, b = base.select(key, F.col(measure).alias("_a")), now.select(key, F.col(measure).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_b") > F.col("_a"), "regression").when(F.col("_b") < F.col("_a"), "improvement").otherwise("same")
    return a.join(b, key, "full").select(key, change.alias("change"), (F.coalesce("_b", F.lit(0)) - F.coalesce("_a", F.lit(0))).alias("delta"))


def count_delta(base: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """Keys whose number of rows differs, with the difference; a key may be on one side alone."""
    both = base.select(key, F.lit(-1).alias("n")).unionByName(now.select(key, F.lit(1).alias("n")))
    return both.groupBy(key).agg(F.sum("n").alias("delta")).filter("delta <> 0")


def concentration(rows: DataFrame, key: str, amount: str) -> DataFrame:
    """One row: the sum of squared shares of the keys' amounts, and the number of keys."""
    per = rows.groupBy(key).agg(F.sum(amount).alias("_q"))
    sums = per.agg(F.sum("_q").alias("_t"), F.sum(F.col("_q") * F.col("_q")).alias("_s"), F.count(F.lit(1)).alias("files"))
    return sums.select(F.when(F.col("_t") == 0, F.lit(0.0)).otherwise(F.col("_s") / (F.col("_t") * F.col("_t"))).alias("herfindahl"), "files")


def health(findings: DataFrame, key: str, weights=(0.5, 0.2, 0.05)) -> DataFrame:
    """Ten less the weights of a key's high, medium and low findings, no less than 0."""
    lost = sum(F.count(F.when(F.col("severity") == s, 1)) * w for s, w in zip(("high", "medium", "low"), weights, strict=True))
    return findings.groupBy(key).agg(F.greatest(F.lit(0.0), 10 - lost).alias("score"))


def missing(covered: DataFrame, group: str, item: str, block: int = 1000) -> DataFrame:
    """The items that some group covers and this one doesn't; groups meet the items block by block, so no row holds them all."""
    have = settle(covered.select(group, item).filter(F.col(group).isNotNull() & F.col(item).isNotNull()).distinct())
    items = settle(have.select(item).distinct())
    blocks = items.count() // block + 1
    dealt = items.withColumn("_block", F.pmod(F.xxhash64(item), F.lit(blocks)).cast("int"))
    per = have.select(group).distinct().withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return per.join(dealt, "_block").select(group, item).join(have, [group, item], "left_anti")


def rates(samples: DataFrame, series: str, order: str, time_us: str, counter: str, last: int = 60) -> DataFrame:
    """Rates a second between neighbours among the last readings of a series; a counter that falls gives 0; the first has none."""
    few = samples.withColumn("_k", F.row_number().over(Window.partitionBy(series).orderBy(F.desc(order)))).filter(F.col("_k") <= last)
    w = Window.partitionBy(series).orderBy(order)
    step = few.withColumns({"_was": F.lag(counter).over(w), "_t": F.lag(time_us).over(w)}).filter("_was is not null")
    rate = F.greatest(F.lit(0.0), (F.col(counter) - F.col("_was")) / F.greatest((F.col(time_us) - F.col("_t")) / 1e6, F.lit(0.001)))
    return step.select(series, order, rate.alias("rate"))


def commit_kinds(messages: DataFrame) -> DataFrame:
    """Messages (id, text) by conventional kind: how many, how many breaking, and the distinct issues they fix and resolve."""
    first = F.trim(F.substring_index("text", "\n", 1))
    kind = F.regexp_extract(first, r"^([a-z]+)(\([^)]+\))?!?:\s*.+$", 1)
    fix = F.nullif(F.regexp_extract(F.lower("text"), r"\b(fix|fixes|fixed)\s+#([0-9]+)", 2), F.lit(""))
    done = F.nullif(F.regexp_extract(F.lower("text"), r"\b(close|closes|closed|resolve|resolves|resolved)\s+#([0-9]+)", 2), F.lit(""))
    rows = messages.select(kind.alias("kind"), first.rlike(r"^[a-z]+(\([^)]+\))?!:").alias("bang"), fix.alias("fix"), done.alias("done"))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("bang"), 1)).alias("breaking"), F.countDistinct("fix").alias("fix_refs"), F.countDistinct("done").alias("resolve_refs"))


def language_share(files: DataFrame, lang: str, size: str) -> DataFrame:
    """Files and bytes by language, with the percent of all bytes."""
    per = files.groupBy(lang).agg(F.count(F.lit(1)).alias("files"), F.sum(size).cast("long").alias("bytes"))
    total = per.agg(F.sum("bytes").alias("_t"))
    return per.crossJoin(F.broadcast(total)).select(lang, "files", "bytes", F.when(F.col("_t") == 0, F.lit(0.0)).otherwise(F.col("bytes") / F.col("_t") * 100).alias("percent"))


def most_common(rows: DataFrame, column: str) -> DataFrame:
    """The most frequent value that is not null; ties: the first by code point."""
    return rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(1)


def value_customer() -> Column:
    """struct(delta, confidence) from features, improvements, fixes and critical findings (f, i, x, crit)."""
    f, more, crit = F.col("f"), F.col("i") + F.col("x"), F.least(F.col("crit"), F.lit(3))
    delta = (60 * F.least(f / 3, F.lit(1.0)) + 40 * F.least(more / 3, F.lit(1.0))) * (1 - 0.15 * crit)
    sure = F.when(f + more == 0, "low").when((f + more >= 4) & (F.col("crit") == 0), "high").when(f + more >= 4, "medium").when(F.col("crit") > 0, "low").otherwise("medium")
    return F.struct(half_up(delta, 1).alias("delta"), sure.alias("confidence"))


def search(rows: DataFrame, text: dict[str, str]) -> DataFrame:
    """Rows of which any of the columns holds its text, case ignored; all rows without a text."""
    hits = [F.contains(F.lower(c), F.lit(t.lower())) for c, t in text.items() if t]
    out = hits[0] if hits else F.lit(True)
    for h in hits[1:]:
        out = out | h
    return rows.filter(out)


def noun_vote(votes: DataFrame) -> DataFrame:
    """The noun (noun, weight) with the most weight; ties: the last by code point; blank ones don't count."""
    return votes.filter("noun <> ''").groupBy("noun").agg(F.sum("weight").cast("long").alias("n")).orderBy(F.desc("n"), F.desc("noun")).limit(1)


def weighted_mean(rows: DataFrame, group: str, value: str, weight: str) -> DataFrame:
    """The mean of a value by weight; the plain mean where all weights are 0."""
    w = F.sum(weight)
    return rows.groupBy(group).agg(F.when(w > 0, F.sum(F.col(weight) * F.col(value)) / w).otherwise(F.avg(value)).alias("mean"))


def gate(suggestions: DataFrame, categories: list[str]) -> DataFrame:
    """Suggestions sure enough, with a reference, of the categories."""
    return suggestions.filter((F.col("confidence") >= SURE) & (F.size("refs") >= 1) & F.col("category").isin(*categories))


def debt_sites(symbols: DataFrame, most: int = 20, complexity: int = 10, loc: int = 80) -> DataFrame:
    """The most complex symbols over the limit, and the longest ones."""
    a = symbols.filter(F.col("complexity") > complexity).select(F.lit("complexity").alias("why"), "id", F.col("complexity").alias("n")).orderBy(F.desc("n"), "id").limit(most)
    return a.unionByName(symbols.filter(F.col("loc") >= loc).select(F.lit("loc").alias("why"), "id", F.col("loc").alias("n")).orderBy(F.desc("n"), "id").limit(most))


def calls_by_status(calls: DataFrame, name: str, failed: Column) -> DataFrame:
    return calls.groupBy(name).agg(F.count(F.lit(1)).alias("calls"), F.count(F.when(failed, 1)).alias("errors"))


def resolved(*values: Column) -> Column:
    """The first setting that is not empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def overall(axes: DataFrame, group: str, value: str, confidence: str) -> DataFrame:
    """The mean of the axes, as sure as the least sure of them."""
    return axes.groupBy(group).agg(F.avg(value).alias("mean"), F.min(confidence).alias("confidence"))


def counts_of_all(rows: DataFrame, column: str, all_: DataFrame) -> DataFrame:
    """Numbers of rows by value, with 0 for the values of a small table that have none."""
    per = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(all_).join(per, column, "left").select(column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def token_shingles(text: Column, n: int = 3) -> Column:
    """Distinct runs of n tokens; tokens are of ASCII letters, digits and underscores."""
    w = F.filter(F.split(text, r"[^A-Za-z0-9_]+"), lambda v: v != "")
    starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), " ")))


#: Ranks of a block in which neighbours are looked for.
BLOCK = 4096


def running_shingles(tokens: DataFrame, order: list[str], n: int = 3) -> DataFrame:
    """Rows (g, shingle): the distinct runs of n neighbours among a group's tokens (g, token and order columns, unique within g).

    Neighbours are found by their rank over all rows, in blocks of it, so no group is collected or sorted in one task.
    """
    ranked = global_rank(tokens, ["g", *order]).select("g", "token", "rank")
    # the first tokens of a block end the runs of the block before
    blocks = F.array_distinct(F.array(*[F.floor((F.col("rank") - k) / BLOCK) for k in (0, n - 1)]))
    dealt = ranked.select("g", "token", "rank", F.explode(blocks).alias("_block"))
    ahead = Window.partitionBy("_block").orderBy("rank")
    run = dealt.select("*", F.array("token", *[F.lead("token", k).over(ahead) for k in range(1, n)]).alias("_run"), F.lead("g", n - 1).over(ahead).alias("_last"))
    run = run.filter((F.floor(F.col("rank") / BLOCK) == F.col("_block")) & (F.col("g") == F.col("_last")))
    return settle(run.select("g", F.array_join("_run", " ").alias("shingle")).distinct())


def shingle_overlap(shingles: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows (a, b, jaccard) for pairs of groups: shingles (g, shingle, distinct) are met by shingle and counted, no group is one row; 0 where both have none."""
    sizes = shingles.groupBy("g").agg(F.count(F.lit(1)).alias("_n"))
    own = pairs.select("a", "b").join(shingles.select(F.col("g").alias("a"), "shingle"), "a")
    both = own.join(shingles.select(F.col("g").alias("b"), "shingle"), ["b", "shingle"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("_both"))
    out = pairs.select("a", "b").join(both, ["a", "b"], "left")
    for c in "ab":
        out = out.join(sizes.select(F.col("g").alias(c), F.col("_n").alias(f"_{c}")), c, "left")
    common, total = F.coalesce("_both", F.lit(0)), F.coalesce("_a", F.lit(0)) + F.coalesce("_b", F.lit(0))
    return out.select("a", "b", F.when(total == 0, F.lit(0.0)).otherwise(common / (total - common)).alias("jaccard"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 where both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def upper_median(values: Column) -> Column:
    """The middle of an array, of two middles the larger; null for none."""
    s = F.array_sort(values)
    return F.get(s, F.floor(F.size(s) / 2).cast("int"))


def cluster_similarity(clusters: DataFrame) -> DataFrame:
    """Rows (root, size, similarity): the upper median of the similarities of a cluster's pairs (root, a, b, x, y: shingles); largest first."""
    pairs = clusters.select("root", "a", "b", jaccard(F.col("x"), F.col("y")).alias("j"))
    ends = pairs.select("root", F.explode(F.array("a", "b")).alias("node")).groupBy("root").agg(F.countDistinct("node").alias("size"), F.min("node").alias("first"))
    n = Window.partitionBy("root")
    ranked = pairs.withColumns({"_i": F.row_number().over(n.orderBy("j")) - 1, "_n": F.count(F.lit(1)).over(n)}).filter(F.col("_i") == F.floor(F.col("_n") / 2))
    return ends.join(ranked.select("root", F.col("j").alias("similarity")), "root").orderBy(F.desc("size"), "first")


def file_impact(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """Changed paths with the number of nodes in files that end in them; 1 each where none has any."""
    parts = F.split("file", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    hits = nodes.select(F.explode(ends).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    own = files.select("path").distinct().join(hits, "path", "left").select("path", F.coalesce("n", F.lit(0)).alias("n"))
    any_ = own.agg(F.sum("n").alias("_all"))
    return own.crossJoin(F.broadcast(any_)).select("path", F.when(F.col("_all") == 0, 1).otherwise(F.col("n")).cast("long").alias("impact"))


def key_files(files: DataFrame, most: int = 8) -> DataFrame:
    """The files (path, impact, category) of most impact, grouped by category, else by the first part of the path."""
    top = files.orderBy(F.desc("impact"), "path").limit(most)
    group = F.coalesce("category", F.substring_index("path", "/", 1))
    return top.groupBy(group.alias("group")).agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias("paths"), F.sum("impact").alias("impact"))


def cohorts(files: DataFrame) -> DataFrame:
    """Files (path) by role: tests, docs, config, code; with how many."""
    from ..functions.scalars import is_test_path, language, language_kind

    kind = language_kind(language(F.col("path")))
    role = F.when(is_test_path(F.col("path")), "tests").when(kind == "prose", "docs").when(kind == "data", "config").when(kind.isNotNull(), "code").otherwise("other")
    return files.select("path", role.alias("role")).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


def new_tests(files: DataFrame, sample: int = 5) -> DataFrame:
    """One row: how many of the files (path, status) are new tests, and the first few."""
    from ..functions.scalars import is_test_path

    found = files.filter((F.col("status") == "added") & is_test_path(F.col("path")))
    few = found.orderBy("path").limit(sample).agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias("sample"))
    return found.agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(few))


def span(samples: DataFrame) -> DataFrame:
    """One row: first and last time, duration (0 without times), distinct services and pods that are named, events."""
    named = [F.array_join(F.array_sort(F.collect_set(F.nullif(F.col(c), F.lit("")))), ",").alias(f"{c}s") for c in ("service", "pod")]
    return samples.agg(F.min("time_us").alias("first_us"), F.max("time_us").alias("last_us"), F.coalesce(F.max("time_us") - F.min("time_us"), F.lit(0)).alias("duration_us"), *named, F.count(F.lit(1)).alias("events"))


def synthetic_root(top: DataFrame) -> DataFrame:
    """One row over the top nodes (value_us, memory_bytes, cpu): summed weight, means by weight (1 at least), memory cut to whole bytes."""
    w = F.greatest("value_us", F.lit(1))
    return top.agg(F.sum("value_us").alias("value_us"), F.floor(F.sum(F.col("memory_bytes") * w) / F.sum(F.when(F.col("memory_bytes").isNotNull(), w))).cast("long").alias("memory_bytes"), (F.sum(F.col("cpu") * w) / F.sum(F.when(F.col("cpu").isNotNull(), w))).alias("cpu"))


def top_by(rows: DataFrame, columns: list[str], name: str = "name", n: int = 5) -> DataFrame:
    """The top n names by each of the columns (metric, place, name, value)."""
    out = None
    for c in columns:
        few = rows.select(F.lit(c).alias("metric"), name, F.col(c).cast("double").alias("value")).orderBy(F.desc("value"), name).limit(n)
        own = few.withColumn("place", F.row_number().over(Window.orderBy(F.desc("value"), name)))
        out = own if out is None else out.unionByName(own)
    return out


def subscribers(joins: DataFrame) -> DataFrame:
    """Subscribers by topic, of rows (topic, client, joined, seq): the last row of a client says whether it is in."""
    last = joins.groupBy("topic", "client").agg(F.max_by("joined", "seq").alias("joined"))
    return last.groupBy("topic").agg(F.count(F.when(F.col("joined"), 1)).alias("subscribers"))


def stacks(samples: DataFrame) -> DataFrame:
    """The multiset of stacks: exact counts, however many there are."""
    return samples.groupBy("stack").agg(F.sum("n").alias("n"))
