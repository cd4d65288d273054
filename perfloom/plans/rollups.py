"""Rollups of findings, reports and change sets over adapters of the driver's tables; their oracles are beside the adapters or below."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import changes as C
from ..operators import graph as G
from ..operators import profile as P
from ..operators import scores as V
from .findings import FINDINGS, near_names
from .joins import add, rows
from .profile import ROLL, samples
from .profile import S as EVENTS
from .scores import PATHS


def found(s, d, where: str = "true"):
    return rows(s, d, f"SELECT * FROM ({FINDINGS}) z WHERE {where}")


def part(s, d):
    return s.read.parquet(f"{d}/part.parquet")


add("findings_by_kind", lambda s, d: C.by_kind(found(s, d)))
add("findings_by_category", lambda s, d: C.by_category(found(s, d)))
add("findings_top", lambda s, d: C.top_findings(found(s, d)).select("id", "kind", "severity"))
add("immediate_fixes", lambda s, d: C.immediate_fixes(found(s, d)).select("id", "kind", "file", "line"))
add("refactor_candidates", lambda s, d: C.refactor_candidates(found(s, d)))
add("pr_signals", lambda s, d: C.signals(found(s, d)).select("id", "category", "tier", F.round("impact", 6).alias("impact")))


def yearly(s, d, odd: int):
    return rows(s, d, f"SELECT concat('s', o_custkey) AS id, count(*) AS n FROM orders WHERE year(o_orderdate) % 2 = {odd} GROUP BY o_custkey")


add("report_diff", lambda s, d: C.diff(yearly(s, d, 0), yearly(s, d, 1), "id", "n"))
add("category_delta", lambda s, d: C.count_delta(found(s, d, "id % 2 = 0 AND category <> 'sql'"), found(s, d, "id % 2 = 1"), "category"))
add("churn_concentration", lambda s, d: C.concentration(s.read.parquet(f"{d}/lineitem.parquet"), "l_suppkey", "l_quantity").withColumn("herfindahl", F.round("herfindahl", 9)))
add("health_score", lambda s, d: C.health(found(s, d), "file", (0.05, 0.02, 0.005)).withColumn("score", F.round("score", 6)))
add("nfr_missing", lambda s, d: C.missing(found(s, d, "severity = 'high'"), "node_id", "category"))
READINGS = "SELECT user_id % 50 AS container, event_id, CAST(floor(value * 100) AS BIGINT) AS rx, unix_micros(cast(ts as timestamp)) AS us FROM events"
add("counter_rates", lambda s, d: C.rates(rows(s, d, READINGS), "container", "event_id", "us", "rx").withColumn("rate", F.round("rate", 6)))
MESSAGES = "SELECT conv_id AS id, CASE conv_id % 6 WHEN 0 THEN concat('feat(x): ', text) WHEN 1 THEN concat('fix!: ', text, ' Fixes #', conv_id % 40) WHEN 2 THEN concat('docs: t', chr(10), 'closes #', conv_id % 30) ELSE text END AS text FROM conversations"
add("commit_tally", lambda s, d: C.commit_kinds(rows(s, d, MESSAGES)))
add("token_footprint", lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", S.token_footprint(F.octet_length("text"))["estimate"].alias("by_bytes")))
add("language_share", lambda s, d: C.language_share(s.read.parquet(f"{d}/documents.parquet"), "lang", "n_chars").withColumn("percent", F.round("percent", 6)))
CUSTOMERS = "SELECT o_custkey % 200 AS pr, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) % 5 AS f, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) % 4 AS i, count(CASE WHEN o_orderstatus = 'P' THEN 1 END) % 3 AS x, count(CASE WHEN o_orderpriority LIKE '1%' THEN 1 END) % 5 AS crit FROM orders GROUP BY o_custkey % 200"
add("value_customer", lambda s, d: rows(s, d, CUSTOMERS).select("pr", C.value_customer().alias("v")).select("pr", "v.*"))


def quality(s, d):
    g = part(s, d).groupBy(F.col("p_brand").alias("pr")).agg((F.avg("p_size") / 50).alias("a"), (F.max("p_retailprice") / 2500).alias("b"), (F.count(F.lit(1)) / 200).alias("c"))
    score = g.select("pr", V.composite({"a": 0.40, "b": 0.35, "c": 0.25}).alias("g"))
    return score.select("pr", F.round("g", 6).alias("score"), S.band(F.col("g")).alias("band"))


add("quality_composite", quality)
add("entry_search", lambda s, d: C.search(part(s, d), {"p_name": "RING", "p_type": "eco"}).select("p_partkey", "p_name"))
VOTES = "SELECT lower(regexp_extract(p_name, '^[A-Za-z]+', 0)) AS noun, 3 AS weight FROM part WHERE p_size % 3 = 0 UNION ALL SELECT lower(regexp_extract(p_type, '[A-Za-z]+$', 0)), 1 FROM part"
add("noun_vote", lambda s, d: C.noun_vote(rows(s, d, VOTES)))
add("weighted_mean", lambda s, d: C.weighted_mean(part(s, d).select(F.col("p_brand").alias("g"), "p_retailprice", (F.col("p_size") % 4).alias("w")), "g", "p_retailprice", "w").withColumn("mean", F.round("mean", 6)))
SUGGESTIONS = "SELECT p_partkey AS id, p_size / 50.0D AS confidence, CASE p_partkey % 3 WHEN 0 THEN array() WHEN 1 THEN array('https://a') ELSE array('https://a', 'https://b') END AS refs, substring(p_brand, 7, 1) AS category FROM part"
add("suggestion_gate", lambda s, d: C.gate(rows(s, d, SUGGESTIONS), ["1", "2", "3"]).select("id"))
add("debt_sites", lambda s, d: C.debt_sites(part(s, d).select(F.col("p_partkey").alias("id"), F.col("p_size").alias("complexity"), (F.col("p_size") * 3).alias("loc"))))
add("calls_by_status", lambda s, d: C.calls_by_status(s.read.parquet(f"{d}/events.parquet").withColumn("fn", F.col("user_id") % 30), "fn", F.col("event_id") % 11 == 0))
add("config_resolution", lambda s, d: part(s, d).select("p_partkey", C.resolved(F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_brand")), F.when(F.col("p_size") % 3 == 0, F.col("p_type")), F.lit("default")).alias("setting")))
add("axis_means", lambda s, d: C.overall(part(s, d).select(F.col("p_brand").alias("g"), "p_size", F.when(F.col("p_partkey") % 3 == 0, 2).when(F.col("p_partkey") % 3 == 1, 1).otherwise(0).alias("c")), "g", "p_size", "c").withColumn("mean", F.round("mean", 6)))


def duplicate_clusters(s, d):
    names = rows(s, d, "SELECT DISTINCT concat(p_name, ' ', p_brand) AS name FROM part")
    pairs = near_names(names).select("a", "b")
    roots = G.clusters(pairs).withColumnRenamed("node", "a")
    told = pairs.join(roots, "a").select("root", "a", "b", C.token_shingles(F.col("a")).alias("x"), C.token_shingles(F.col("b")).alias("y"))
    return C.cluster_similarity(told).select("root", "size", F.round("similarity", 9).alias("similarity"))


add("duplicate_clusters", duplicate_clusters, """WITH RECURSIVE n AS (SELECT DISTINCT concat(p_name, ' ', p_brand) AS name FROM part), q AS (SELECT a.name AS a, b.name AS b, levenshtein(a.name, b.name) AS d, length(a.name) + length(b.name) AS t FROM n a JOIN n b ON a.name < b.name), p AS (SELECT a, b FROM q WHERE round((t - d) / t * 100) >= 95),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), r AS (SELECT a AS node, a AS root FROM l UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node), c AS (SELECT node, min(root) AS root FROM r GROUP BY node), z AS (SELECT root, count(*) AS size, min(node) AS first FROM c GROUP BY root),
w AS (SELECT name, regexp_extract_all(name, '[A-Za-z0-9_]+') AS w FROM n), s AS (SELECT name, list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS s FROM w),
j AS (SELECT c.root, CASE WHEN len(x.s) + len(y.s) = 0 THEN 0 ELSE len(list_intersect(x.s, y.s)) / len(list_distinct(list_concat(x.s, y.s))) END AS j FROM p JOIN c ON c.node = p.a JOIN s x ON x.name = p.a JOIN s y ON y.name = p.b), k AS (SELECT root, j, row_number() OVER (PARTITION BY root ORDER BY j) - 1 AS i, count(*) OVER (PARTITION BY root) AS n FROM j)
SELECT z.root, size, round(k.j, 9)::DOUBLE AS similarity FROM z JOIN k ON k.root = z.root AND i = n // 2""")
CHANGED = "SELECT DISTINCT concat('src/', p_brand, '.py') AS path FROM part WHERE p_size > 40"
NODES = "SELECT concat('/root/src/', p_brand, '.py') AS file FROM part WHERE p_size < 20"
add("file_impact", lambda s, d: C.file_impact(rows(s, d, CHANGED), rows(s, d, NODES)), f"WITH c AS ({CHANGED}), n AS ({NODES}) SELECT path, (SELECT count(*) FROM n WHERE n.file LIKE '%/' || c.path) AS impact FROM c")
KEYS = "SELECT concat('d', p_partkey % 5, '/', p_partkey) AS path, CAST(p_size AS BIGINT) AS impact, CASE WHEN p_partkey % 4 = 0 THEN p_type END AS category FROM part"
add("key_files", lambda s, d: C.key_files(rows(s, d, KEYS)), f"WITH t AS (SELECT * FROM ({KEYS}) ORDER BY impact DESC, path LIMIT 8) SELECT coalesce(category, string_split(path, '/')[1]) AS \"group\", string_agg(path, ',' ORDER BY path) AS paths, sum(impact)::BIGINT AS impact FROM t GROUP BY 1")
add("file_cohorts", lambda s, d: C.cohorts(rows(s, d, "SELECT concat('src/', CASE p_partkey % 4 WHEN 0 THEN 'tests/' ELSE '' END, 'x', p_partkey, CASE p_size % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.md' WHEN 2 THEN '.json' WHEN 3 THEN '.css' ELSE '.bin' END) AS path FROM part")), "SELECT CASE WHEN p_partkey % 4 = 0 THEN 'tests' WHEN p_size % 5 = 1 THEN 'docs' WHEN p_size % 5 = 2 THEN 'config' WHEN p_size % 5 = 4 THEN 'other' ELSE 'code' END AS role, count(*) AS n FROM part GROUP BY 1")
ADDED = "SELECT concat(CASE WHEN p_partkey % 6 = 0 THEN 'tests/' ELSE 'lib/' END, p_partkey, '.py') AS path, CASE WHEN p_size % 2 = 0 THEN 'added' ELSE 'modified' END AS status FROM part"
add("new_test_files", lambda s, d: C.new_tests(rows(s, d, ADDED)), f"WITH f AS (SELECT path FROM ({ADDED}) WHERE status = 'added' AND path LIKE 'tests/%') SELECT count(*) AS n, (SELECT string_agg(path, ',' ORDER BY path) FROM (SELECT path FROM f ORDER BY path LIMIT 5)) AS sample FROM f")


def spanned(s, d):
    return C.span(samples(s, d).withColumns({"service": F.concat(F.lit("s"), F.col("seq") % 3), "pod": F.when(F.col("seq") % 4 > 0, F.concat(F.lit("p"), F.col("seq") % 4)).otherwise("")}))


add("time_span", spanned, EVENTS + " SELECT min(time_us) AS first_us, max(time_us) AS last_us, max(time_us) - min(time_us) AS duration_us, 's0,s1,s2' AS services, 'p1,p2,p3' AS pods, count(*) AS events FROM s")
add("synthetic_root", lambda s, d: C.synthetic_root(P.function_rollup(samples(s, d)).filter("name like 'user_%'").select(F.col("cumulative_us").alias("value_us"), F.col("memory_mean_bytes").alias("memory_bytes"), F.lit(2.5).alias("cpu"))).withColumn("cpu", F.round("cpu", 6)), ROLL + " SELECT sum(cumulative_us)::BIGINT AS value_us, floor(sum(memory_mean_bytes * greatest(cumulative_us, 1)) / sum(greatest(cumulative_us, 1)))::BIGINT AS memory_bytes, 2.5::DOUBLE AS cpu FROM f WHERE name LIKE 'user_%'")
add("top_by_metric", lambda s, d: C.top_by(P.function_rollup(samples(s, d)), ["cumulative_us", "self_us", "ncalls"]), ROLL + ", u AS (SELECT 'cumulative_us' AS metric, name, cumulative_us::DOUBLE AS value FROM f UNION ALL SELECT 'self_us', name, self_us FROM f UNION ALL SELECT 'ncalls', name, ncalls FROM f), z AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC, name)::INT AS place FROM u) SELECT metric, place, name, value FROM z WHERE place <= 5")
JOINED = "SELECT event_type AS topic, user_id AS client, value > 50 AS joined, event_id AS seq FROM events"
add("topic_subscribers", lambda s, d: C.subscribers(rows(s, d, JOINED)), f"WITH l AS (SELECT topic, client, arg_max(joined, seq) AS j FROM ({JOINED}) GROUP BY ALL) SELECT topic, count(*) FILTER (j) AS subscribers FROM l GROUP BY topic")
add("stack_multiset", lambda s, d: C.stacks(samples(s, d).select(F.array_join(F.transform("frames", lambda f: f["name"]), ";").alias("stack"), F.col("tick_count").alias("n"))), EVENTS + " SELECT array_to_string(names, ';') AS stack, sum(tick)::BIGINT AS n FROM s GROUP BY 1")
add("path_languages", lambda s, d: rows(s, d, PATHS).groupBy(S.language(F.col("path")).alias("lang")).agg(F.count(F.lit(1)).alias("n")), f"WITH p AS (SELECT lower(string_split(path, '/')[-1]) AS base FROM ({PATHS})) SELECT CASE WHEN base = 'dockerfile' THEN 'Dockerfile' WHEN base LIKE '%.py' THEN 'Python' WHEN base LIKE '%.tsx' THEN 'TypeScript' WHEN base LIKE '%.rs' THEN 'Rust' WHEN base LIKE '%.md' THEN 'Markdown' END AS lang, count(*) AS n FROM p GROUP BY 1")
