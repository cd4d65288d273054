"""Joins of sampled to static nodes, path aliases, name resolution and ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .profile import global_rank
from .ranges import overlaps

#: Container prefixes that are tried, in this order, and the least share of paths that an alias explains.
CANDIDATE_PREFIXES = ("/usr/src/app/", "/usr/local/app/", "/home/app/", "/workspace/", "/srv/", "/code/", "/app/", "/www/", "/var/www/")
MIN_COVERAGE = 0.8


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def tier_score(a: str, b: str) -> Column:
    """The score of the best tier of two nodes of equal bare name; 0 under the last tier."""
    def eq(x: str) -> Column:
        return F.col(f"{a}.{x}") == F.col(f"{b}.{x}")

    base = basename(F.col(f"{a}.file")) == basename(F.col(f"{b}.file"))
    tiers = ((eq("file") & eq("qualified_name"), 0.95), (base & eq("qualified_name"), 0.85), (eq("file") & eq("parent_class"), 0.85), (eq("file"), 0.70), (base & eq("parent_class"), 0.65), (base, 0.50))
    return F.coalesce(*[F.when(c, F.lit(s)) for c, s in tiers], F.lit(0.0))


def fuzzy_join(sampled: DataFrame, static: DataFrame, alternatives: int = 3) -> DataFrame:
    """Left-preserving: (sid, best_id, score, alternatives) of each sampled node.

    Exact ids end it. For the rest each tier is a key: the name with what the tier compares. Of a key's static nodes
    only the first `alternatives` + 1 by id are met: a node behind them has as many before it that score no less.
    So a name that very many files have makes a few rows a sampled node, not a product.
    """
    ids = static.select("node_id").distinct()
    exact = sampled.join(ids, "node_id", "left_semi").select("sid", F.col("node_id").alias("best_id"), F.lit(1.0).alias("score"), F.lit("").alias("alternatives"))
    rest = sampled.join(ids, "node_id", "left_anti").withColumn("_base", basename(F.col("file")))
    # of equal ids on the static side the last is taken, as with a map
    last = static.groupBy("node_id").agg(F.max_by(F.struct("name", "file", "qualified_name", "parent_class"), "ord").alias("n")).select("node_id", "n.*").withColumn("_base", basename(F.col("file")))
    none = F.lit("")
    tiers = (("file", "qualified_name"), ("_base", "qualified_name"), ("file", "parent_class"), ("file", None), ("_base", "parent_class"), ("_base", None))
    keys = F.explode(F.array(*[F.struct(F.lit(t).alias("tier"), F.col(a).alias("k1"), (F.col(b) if b else none).alias("k2")) for t, (a, b) in enumerate(tiers)]))

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("_k", keys).select("*", "_k.*").drop("_k").filter("k1 is not null and k2 is not null")

    place = F.row_number().over(Window.partitionBy("tier", "name", "k1", "k2").orderBy("node_id"))
    index = keyed(last).withColumn("_r", place).filter(F.col("_r") <= alternatives + 1).drop("_r")
    met = keyed(rest.select("sid", "name", "file", "qualified_name", "parent_class", "_base")).alias("a").join(index.alias("b"), ["tier", "name", "k1", "k2"])
    scored = met.select("a.sid", F.col("b.node_id").alias("static_id"), tier_score("a", "b").alias("score")).filter("score >= 0.5").distinct()
    top = scored.withColumn("r", F.row_number().over(Window.partitionBy("sid").orderBy(F.desc("score"), "static_id"))).filter(F.col("r") <= alternatives + 1)
    ranked = top.groupBy("sid").agg(F.max_by("static_id", -F.col("r")).alias("best_id"), F.max("score").alias("score"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") > 1, F.struct("r", "static_id")))), lambda x: x["static_id"]), ",").alias("alternatives"))
    fuzzy = rest.select("sid").join(ranked, "sid", "left").select("sid", "best_id", "score", F.coalesce("alternatives", F.lit("")).alias("alternatives"))
    return exact.unionByName(fuzzy)


def path_alias(sampled: DataFrame, static: DataFrame) -> DataFrame:
    """At most one row (prefix, host_prefix, votes, matching): the alias with the most votes that explains enough paths.

    Static paths are indexed by each suffix after a slash, so tails meet them by equality.
    """
    order = F.create_map(*[F.lit(x) for i, p in enumerate(CANDIDATE_PREFIXES) for x in (p, i)])
    prefixes = F.filter(F.array(*map(F.lit, CANDIDATE_PREFIXES)), lambda p: F.startswith("file", p))
    tails = sampled.select("file").distinct().select("file", F.explode(prefixes).alias("prefix")).withColumn("tail", F.expr("substring(file, length(prefix) + 1)"))
    parts = F.split("file", "/")
    suffix = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    index = static.select("file", "ord").filter(F.contains("file", F.lit("/"))).select("file", "ord", F.explode(suffix).alias("tail")).groupBy("tail").agg(F.min_by("file", "ord").alias("host"))
    votes = tails.join(index, "tail").withColumn("host_prefix", F.expr("substring(host, 1, length(host) - length(tail))"))
    by_host = votes.groupBy("prefix", "host_prefix").agg(F.count(F.lit(1)).alias("votes"))
    best = by_host.groupBy("prefix").agg(F.max("votes").alias("votes"), F.min_by("host_prefix", F.struct(-F.col("votes"), F.col("host_prefix"))).alias("host_prefix"))
    matching = tails.groupBy("prefix").agg(F.count(F.lit(1)).alias("matching"))
    ok = best.join(matching, "prefix").filter(F.col("votes") >= MIN_COVERAGE * F.col("matching"))
    return ok.orderBy(F.desc("votes"), order[F.col("prefix")]).limit(1).select("prefix", "host_prefix", "votes", "matching")


def resolve_names(refs: DataFrame, symbols: DataFrame, most: int = 8) -> DataFrame:
    """Edges (ref, src, dst): same-file symbols of the name; else those of the language, if no more than `most`.

    Counts by (name, language) are made first: names with more candidates than can count are turned away before
    any match is made, so the second join gives at most `most` + 1 rows a reference.
    """
    own = refs.alias("r").join(symbols.alias("s"), (F.col("r.name") == F.col("s.name")) & (F.col("r.file") == F.col("s.file")) & (F.col("r.src") != F.col("s.id")))
    own = own.select("r.ref", "r.src", F.col("s.id").alias("dst"))
    few = symbols.groupBy("name", "lang").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") <= most + 1).select("name", "lang")
    rare = symbols.join(few, ["name", "lang"], "left_semi")
    # whether a reference has a symbol of its file is told by the first and the last of them, not by the matches
    ends = symbols.filter("id is not null").groupBy("name", "file").agg(F.min("id").alias("_first"), F.max("id").alias("_last"))
    has = refs.join(ends, ["name", "file"]).filter((F.col("src") != F.col("_first")) | (F.col("src") != F.col("_last")))
    rest = refs.join(has.select("ref").distinct(), "ref", "left_anti")
    met = rest.alias("r").join(rare.alias("s"), (F.col("r.name") == F.col("s.name")) & (F.col("r.lang") == F.col("s.lang")) & (F.col("r.src") != F.col("s.id")))
    wide = met.select("r.ref", "r.src", F.col("s.id").alias("dst"), F.count(F.lit(1)).over(Window.partitionBy("r.ref")).alias("_n"))
    return own.union(wide.filter(F.col("_n") <= most).drop("_n"))


def innermost(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """Each point's smallest range of its file that holds it: (point, range); ties: the first by order.

    Places, not points, meet spans, not ranges, in bins of positions: points of one place share its answer, and of equal ranges the first is met.
    """
    each = spans(ranges)
    at = points.select("file", F.col("pos").cast("long").alias("ls"), F.col("pos").cast("long").alias("le")).distinct()
    best = overlaps(at, each.select("file", "rs", "re", "rank"), ["file"], 64).groupBy("file", "ls").agg(F.min("rank").alias("rank"))
    told = points.select("point", "file", F.col("pos").cast("long").alias("ls")).join(best, ["file", "ls"])
    # a point that is named at several places has the smallest range of all of them
    return told.groupBy("point").agg(F.min("rank").alias("rank")).join(each.select("rank", "range"), "rank").select("point", "range")


def spans(ranges: DataFrame) -> DataFrame:
    """The distinct spans (file, rs, re) of ranges (range, file, s, e), each with its first range and its rank: the smallest span first, then the first range."""
    each = ranges.groupBy("file", F.col("s").cast("long").alias("rs"), F.col("e").cast("long").alias("re")).agg(F.min("range").alias("range"))
    return global_rank(each.withColumn("size", F.col("re") - F.col("rs")), ["size", "range", "file", "rs"])


def containment(ranges: DataFrame) -> DataFrame:
    """The smallest range (child, parent) of the file that strictly holds each range (range, file, s, e); equal ranges never pair.

    A range can only be held by ranges over its start, so starts are points that meet spans in bins; equal ranges are one span, and share its parent.
    """
    each = spans(ranges)
    own = each.select("file", F.col("rs").alias("ls"), F.col("rs").alias("le"), F.col("re").alias("end"))
    met = overlaps(own, each.select("file", "rs", "re", "rank"), ["file"], 64)
    strict = met.filter((F.col("re") >= F.col("end")) & (F.col("re") - F.col("rs") > F.col("end") - F.col("ls")))
    best = strict.groupBy("file", "ls", "end").agg(F.min("rank").alias("rank"))
    told = ranges.select(F.col("range").alias("child"), "file", F.col("s").cast("long").alias("ls"), F.col("e").cast("long").alias("end")).join(best, ["file", "ls", "end"])
    return told.groupBy("child").agg(F.min("rank").alias("rank")).join(each.select("rank", F.col("range").alias("parent")), "rank").select("child", "parent")


#: Endings and index files that a relative import may stand for, in order of preference.
ENDINGS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/__init__.py")


def relative_path(importer: Column, module: Column) -> Column:
    """The path that a module of `./` or `../` names from an importing file, without `.` and `..`; null for others and above the root."""
    parts = F.concat(F.slice(F.split(importer, "/"), F.lit(1), F.size(F.split(importer, "/")) - 1), F.split(module, "/"))

    def step(kept: Column, part: Column) -> Column:
        up = F.when(F.size(kept) > 0, F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
        return F.when(part.isin("", "."), kept).when(part == "..", up).otherwise(F.concat(kept, F.array(part)))

    done = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.when(module.rlike(r"^\.\.?/"), F.array_join(done, "/"))


def resolve_imports(refs: DataFrame, imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges (ref, src, dst) of references (ref, src, name, file) to a name that their file imports (file, name, module) from a relative module.

    A module stands for its path as it is, with an ending, or with an index file; the first that has a symbol of the name counts.
    """
    path = relative_path(F.col("file"), F.col("module"))
    wanted = imports.select("file", "name", path.alias("path")).filter("path is not null")
    ways = F.array(F.col("path"), *[F.concat("path", F.lit(e)) for e in ENDINGS])
    spread = wanted.select("file", "name", F.posexplode(ways).alias("way", "target"))
    # a reference isn't told as its own symbol, so two symbols are enough: of a target's name, and then of all that an import of a name offers
    target = symbols.select(F.col("file").alias("target"), "name", "id").filter("id is not null").distinct()
    heads = target.withColumn("_r", F.row_number().over(Window.partitionBy("target", "name").orderBy("id"))).filter(F.col("_r") <= 2).drop("_r")
    offers = spread.distinct().join(heads, ["target", "name"]).groupBy("file", "name", "id").agg(F.min("way").alias("way"))
    offers = offers.withColumn("_r", F.row_number().over(Window.partitionBy("file", "name").orderBy("way", "id"))).filter(F.col("_r") <= 2).drop("_r")
    met = refs.select("ref", "src", "file", "name").join(offers, ["file", "name"]).filter(F.col("src") != F.col("id"))
    best = met.groupBy("ref", "src").agg(F.min(F.struct("way", "id")).alias("b"))
    return best.select("ref", "src", F.col("b.id").alias("dst"))


def resolve(refs: DataFrame, imports: DataFrame, symbols: DataFrame, most: int = 8) -> DataFrame:
    """Edges by import where a reference has one, else by name."""
    first = resolve_imports(refs, imports, symbols)
    return first.unionByName(resolve_names(refs.join(first.select("ref").distinct(), "ref", "left_anti"), symbols, most))


def module_edges(refs: DataFrame, ranges: DataFrame) -> DataFrame:
    """Files (file, id) that get a `<module>` symbol: those with a reference (ref, file, pos) that no range of the file (range, file, s, e) holds."""
    points = refs.select(F.col("ref").alias("point"), "file", "pos")
    orphans = points.join(innermost(points, ranges).select("point"), "point", "left_anti")
    return orphans.select("file").distinct().withColumn("id", F.concat("file", F.lit("::<module>")))


def call_sites(edges: DataFrame) -> DataFrame:
    """Numbers of call sites (id, sites) of resolved references (ref, src, dst), each counted."""
    return edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("sites"))


def rewrite(path: Column, prefix: Column, host: Column) -> Column:
    """A path whose prefix is replaced by the host's; others as they are."""
    return F.when(F.startswith(path, prefix), F.concat(host, F.substring(path, F.length(prefix) + 1, F.length(path)))).otherwise(path)
