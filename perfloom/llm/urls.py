"""URL filters: fixed host and path rules, and association rules mined from labelled URLs.

FP-growth mines frequent combinations of URL tokens together with the class of
labelled pages (bad: low quality or toxic). Tokens that stand in exactly the same labelled pages are one item,
a class of tokens, so that a template of any number of tokens makes one item and not all its subsets; any token of a class
meets a rule's need. Rules "tokens -> bad" remain that have
the least support and confidence, and that no rule with fewer of their tokens
equals in confidence. An inverted index holds each rule under its rarest token;
a URL looks up its tokens, and a rule fires if the URL has all of its tokens. The
best rule by confidence, support, then name speaks. Fixed rules come first.

Defined cases: a null url, or one without "://", has an empty host and path and
no tokens but is judged (allowed); repeated pages are judged alike; labels for no
page or with nulls in both classes teach nothing; without labelled pages no rule is mined; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lower_ascii, settle, table

#: Fixed rules of the filter list: (verdict, host and path).
FIXED = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
MIN_SUPPORT, MIN_CONFIDENCE, MIN_PAGES = 0.002, 0.6, 5
#: Rules, or sets of tokens that fire, up to which they are broadcast; beyond it, they are joined by a shuffle, salted for hot sets.
BROADCAST_RULES, SALTS = 100_000, 16
BAD, GOOD = "class=bad", "class=good"


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens_of(url: Column) -> Column:
    """Distinct tokens: host labels and their suffixes' ends, path words, query keys; numbers are one token."""
    labels = F.transform(F.split(F.regexp_replace(host_of(url), r":\d*$", ""), r"[.]"), lambda x: F.concat(F.lit("host:"), x))
    hyphen = F.transform(F.regexp_extract_all(host_of(url), F.lit(r"[^.:\-]+(?=-)|(?<=-)[^.:\-]+"), F.lit(0)), lambda x: F.concat(F.lit("part:"), x))
    path = F.transform(F.regexp_extract_all(F.lower(path_of(url)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, r"^[0-9]+$", "0")))
    keys = F.transform(F.regexp_extract_all(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\?([^#]*)", 1), F.lit(r"(?:^|[&;])([^=&;]+)"), F.lit(1)), lambda x: F.concat(F.lit("key:"), x))
    found = F.filter(F.array_distinct(F.concat(labels, hyphen, path, keys)), lambda x: ~x.isin("host:", "path:", "key:"))
    return F.when(F.coalesce(F.contains(url, F.lit("://")), F.lit(False)), found).otherwise(F.array().cast("array<string>"))


RULES = "name string, tokens array<string>, classes array<array<string>>, confidence double, n long"


def token_classes(labelled: DataFrame, least: float) -> DataFrame:
    """Rows (token, item, members) of tokens in `least` pages or more: item is the first of those that stand in the same pages.

    Sets of pages are told apart by their size and two sums of hashes. At most tokens a page / support rows.
    """
    sets = labelled.select(F.array_sort(F.array_distinct("tokens")).alias("tokens")).withColumns({f"h{k}": F.xxhash64(F.lit(k), "tokens").cast("decimal(38,0)") for k in (1, 2)})
    # pages of equal tokens stand or fall together, so the set of tokens may stand for the page
    each = sets.select("h1", "h2", F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum("h1").alias("a"), F.sum("h2").alias("b")).filter(F.col("n") >= least)
    members = each.groupBy("n", "a", "b").agg(F.array_sort(F.collect_list("token")).alias("members"))
    return members.select(F.explode("members").alias("token"), F.get("members", F.lit(0)).alias("item"), "members")


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_pages: int = MIN_PAGES) -> DataFrame:
    """Rules (name, tokens, classes, confidence, n) from rows (tokens, bad): `tokens` has the first token of each of the rule's classes."""
    spark = labelled.sparkSession
    pages = settle(labelled.filter("bad is not null").select(F.monotonically_increasing_id().alias("page"), F.array_distinct("tokens").alias("tokens"), F.when(F.col("bad"), BAD).otherwise(GOOD).alias("class")))
    n = pages.count()
    least = max(min_support, min_pages / max(n, 1))
    if not n or least > 1:
        return spark.createDataFrame([], RULES)
    classes = settle(token_classes(pages, least * n - 1e-6))
    items = pages.select("page", F.explode("tokens").alias("token")).join(F.broadcast(classes.select("token", "item")), "token").groupBy("page").agg(F.collect_set("item").alias("found"))
    baskets = settle(pages.join(items, "page", "left").select(F.concat(F.coalesce("found", F.array().cast("array<string>")), F.array("class")).alias("items")))
    sets = FPGrowth(itemsCol="items", minSupport=least, minConfidence=min_confidence).fit(baskets).freqItemsets
    known = settle(sets.select(F.array_sort(F.filter("items", lambda x: x != BAD)).alias("tokens"), F.array_contains("items", BAD).alias("bad"), F.array_contains("items", GOOD).alias("good"), "freq"))
    hits = known.filter("bad and size(tokens) > 0").select("tokens", F.col("freq").alias("n"))
    all_ = known.filter("not bad and not good").select("tokens", F.col("freq").alias("of"))
    rules = prune(hits.join(all_, "tokens").select("tokens", (F.col("n") / F.col("of")).alias("confidence"), "n").filter(F.col("confidence") >= min_confidence))
    of = F.broadcast(classes.filter("token = item").select("item", "members"))
    spread = rules.select("tokens", "confidence", "n", F.explode("tokens").alias("item")).join(of, "item")
    return spread.groupBy("tokens", "confidence", "n").agg(F.sort_array(F.collect_list("members")).alias("classes")).select(F.array_join("tokens", "+").alias("name"), "tokens", "classes", "confidence", "n")


def prune(rules: DataFrame) -> DataFrame:
    """Without rules that one with a token less equals in confidence; subsets are looked up, not compared in pairs."""
    less = rules.filter(F.size("tokens") > 1).select("tokens", "confidence", F.explode("tokens").alias("x"))
    less = less.select("tokens", "confidence", F.array_sort(F.array_remove("tokens", F.col("x"))).alias("rest"))
    beaten = less.join(rules.select(F.col("tokens").alias("rest"), F.col("confidence").alias("c")), "rest").filter("c >= confidence").select("tokens").distinct()
    return rules.join(beaten, "tokens", "left_anti")


def fixed_rule(host: Column, path: Column, fixed=FIXED) -> Column:
    """The longest fixed rule that fits, or null."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(fixed, key=lambda r: len(r[1])):
        rule_host, _, rest = rule.partition("/")
        fits = ((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(path, F.lit(f"/{rest}"))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def judge(pages: DataFrame, rules: DataFrame, fixed=FIXED) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, mined_rule, confidence), one for each page."""
    if "classes" not in rules.columns:  # rules of one's own: every token stands for itself
        rules = rules.withColumn("classes", F.transform("tokens", lambda t: F.array(t)))
    rules = settle(rules)
    url = F.col("url").cast("string")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), tokens_of(url).alias("tokens"))
    base = base.withColumn("rule", fixed_rule(F.col("host"), F.col("path"), fixed))
    # one lookup for each set of tokens: pages of a hot host share theirs
    sets = base.filter(F.size("tokens") > 0).select(F.array_sort("tokens").alias("tokens")).distinct()
    spread = rules.select("name", "classes", "confidence", "n", F.explode("classes").alias("class"))
    common = rules.select(F.explode(F.flatten("classes")).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    rarity = spread.select("name", "classes", "confidence", "n", "class", F.get("class", F.lit(0)).alias("t")).join(common, "t")
    rarest = Window.partitionBy("name").orderBy("df", "t")
    chosen = rarity.withColumn("_r", F.row_number().over(rarest)).filter("_r = 1")
    index = chosen.select(F.explode("class").alias("t"), F.struct(F.col("confidence").alias("confidence"), F.col("n").alias("n"), F.col("name").alias("name")).alias("r"), F.col("classes").alias("need"))
    hint = F.broadcast if rules.count() <= BROADCAST_RULES else lambda x: x
    met = sets.select("tokens", F.explode("tokens").alias("t")).join(hint(index), "t").filter(F.forall("need", lambda c: F.arrays_overlap(c, F.col("tokens"))))
    fired = settle(met.groupBy("tokens").agg(F.max("r").alias("best")))
    keyed = base.withColumn("_key", F.array_sort("tokens"))
    if fired.count() <= BROADCAST_RULES:
        judged = keyed.alias("b").join(F.broadcast(fired).alias("f"), F.col("b._key") == F.col("f.tokens"), "left")
    else:  # a hot set of tokens is dealt out over salts, and its one row to each of them
        salted = fired.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        judged = keyed.withColumn("_salt", F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(SALTS)).cast("int")).alias("b").join(salted.alias("f"), (F.col("b._key") == F.col("f.tokens")) & (F.col("b._salt") == F.col("f._salt")), "left")
    verdict = {rule: v for v, rule in fixed}
    fixed_verdict = F.coalesce(*[F.when(F.col("b.rule") == r, F.lit(v)) for r, v in verdict.items()])
    mined = F.when(F.col("f.best").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("b.page_id", "b.host", "b.path", "b.rule", F.coalesce(fixed_verdict, mined).alias("verdict"), F.col("f.best.name").alias("mined_rule"), F.col("f.best.confidence").alias("confidence"))


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (tokens, bad) of the pages that labels cover by id."""
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), True).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), False)
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("page_id")).agg(F.max(bad).alias("bad"))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), tokens_of(F.col("url").cast("string")).alias("tokens"))
    return own.join(marks, "page_id").select("tokens", "bad")


def op1_url_filters(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, mine(labelled_urls(pages, table(spark, sf_dir, "labels"))))
