"""Findings, change sets, texts and values: adapters and oracles; plans that are rollups are in `rollups`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes as C
from ..operators.names import near_names
from ..operators.profile import global_rank
from .joins import add, rows
from .registry import ORACLES

FINDINGS = """SELECT o_orderkey AS id, concat('n', o_custkey % 300) AS node_id, concat('f', o_custkey % 50) AS file, o_orderkey % 400 AS line, concat('kind_', o_orderstatus, o_orderkey % 3) AS kind,
CASE WHEN o_orderpriority LIKE '1%' THEN 'high' WHEN o_orderpriority LIKE '2%' OR o_orderpriority LIKE '3%' THEN 'medium' ELSE 'low' END AS severity,
CASE o_orderkey % 4 WHEN 0 THEN 'trivial' WHEN 1 THEN 'small' WHEN 2 THEN 'medium' ELSE 'large' END AS effort,
CASE o_orderkey % 5 WHEN 0 THEN 'security' WHEN 1 THEN 'reliability' WHEN 2 THEN 'sql' WHEN 3 THEN 'observability' ELSE 'maintenance' END AS category,
(o_orderkey % 101) / 100.0D AS confidence, CAST(o_custkey % 120 AS BIGINT) AS loc FROM orders"""
RANKS = "CASE severity WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END AS sev, CASE effort WHEN 'trivial' THEN 0 WHEN 'small' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS eff"


def stated(name: str, sql: str, duck=lambda s: s.replace("100.0D", "100.0::DOUBLE")) -> None:
    """The oracle of a query whose plan is in `rollups`."""
    ORACLES[name] = duck(sql)


F1 = f"f AS (SELECT *, {RANKS} FROM ({FINDINGS}) z)"
stated("findings_by_kind", f"SELECT kind, count(*) AS n FROM ({FINDINGS}) z GROUP BY kind")
stated("findings_by_category", f"SELECT category, kind, count(*) AS n, sum(count(*)) OVER (PARTITION BY category) AS total FROM ({FINDINGS}) z GROUP BY category, kind", lambda s: s.replace("100.0D", "100.0::DOUBLE").replace("sum(count(*)) OVER (PARTITION BY category)", "CAST(sum(count(*)) OVER (PARTITION BY category) AS BIGINT)"))
# quota by kind over the global order, then the cap: each kind keeps a bounded head before anything meets in one place
stated("findings_top", f"WITH {F1}, q AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY sev DESC, id) AS r FROM f) SELECT id, kind, severity FROM q WHERE r <= 12 ORDER BY sev DESC, id LIMIT 50")
stated("immediate_fixes", f"WITH {F1}, q AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY sev DESC, eff, file, line, id) AS r FROM f WHERE severity <> 'low' AND effort IN ('trivial', 'small')) SELECT id, kind, file, line FROM q WHERE r <= 12 ORDER BY sev DESC, eff, file, line, id LIMIT 50")
stated("refactor_candidates", f"WITH {F1} SELECT node_id, count(*) AS n, count(DISTINCT kind) AS kinds, max(sev) AS worst, max(eff) AS effort, max(loc) AS loc FROM f GROUP BY node_id HAVING count(*) >= 2 OR max(eff) = 3 OR max(loc) >= 100 ORDER BY n DESC, loc DESC, node_id LIMIT 30")
stated(
    "pr_signals",
    f"""WITH {F1}, t AS (SELECT *, CASE WHEN category = 'security' AND severity = 'high' THEN 2 WHEN category = 'security' THEN 1 WHEN category IN ('reliability', 'sql') AND severity = 'high' THEN 2 WHEN category IN ('reliability', 'sql') AND severity = 'medium' THEN 1 WHEN severity = 'high' THEN 1 ELSE 0 END AS tier, (sev + 1) * confidence AS impact FROM f),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file, line, kind ORDER BY id) AS k FROM t WHERE confidence >= 0.75 AND tier >= 1) y WHERE k = 1),
c AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY tier DESC, impact DESC, id) AS r FROM o) SELECT id, category, tier, round(impact, 6) AS impact FROM c WHERE r <= 5 ORDER BY tier DESC, impact DESC, id LIMIT 20""",
)


def nearest_rank_p90(s, d):
    """The value at place min(floor(0.9 n), n - 1); ranks are dealt by ranges, not by one window."""
    v = rows(s, d, "SELECT p_retailprice AS x, p_partkey AS k FROM part")
    n = v.agg(F.count(F.lit(1)).alias("n"))
    return global_rank(v, ["x", "k"]).crossJoin(F.broadcast(n)).filter("rank = least(cast(floor(0.9D * n) as bigint), n - 1)").select(F.col("x").alias("p90"))


add("pagerank_p90", nearest_rank_p90, "WITH v AS (SELECT p_retailprice AS x, row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS r, count(*) OVER () AS n FROM part) SELECT x AS p90 FROM v WHERE r = least(CAST(floor(0.9 * n) AS BIGINT), n - 1)")
stated(
    "report_diff",
    """WITH a AS (SELECT concat('s', o_custkey) AS id, count(*) AS n FROM orders WHERE year(o_orderdate) % 2 = 0 GROUP BY o_custkey), b AS (SELECT concat('s', o_custkey) AS id, count(*) AS n FROM orders WHERE year(o_orderdate) % 2 = 1 GROUP BY o_custkey)
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' WHEN b.n > a.n THEN 'regression' WHEN b.n < a.n THEN 'improvement' ELSE 'same' END AS change, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta FROM a FULL OUTER JOIN b ON a.id = b.id""",
)
stated("category_delta", f"WITH f AS ({FINDINGS}), a AS (SELECT category, count(*) AS n FROM f WHERE id % 2 = 0 AND category <> 'sql' GROUP BY category), b AS (SELECT category, count(*) AS n FROM f WHERE id % 2 = 1 GROUP BY category) SELECT coalesce(a.category, b.category) AS category, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta FROM a FULL OUTER JOIN b ON a.category = b.category WHERE coalesce(b.n, 0) <> coalesce(a.n, 0)")
stated("churn_concentration", "WITH c AS (SELECT l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY l_suppkey), t AS (SELECT sum(q) AS t FROM c) SELECT round(sum(q / t * (q / t)), 9) AS herfindahl, count(*) AS files FROM c CROSS JOIN t")
stated("health_score", f"SELECT file, round(greatest(0.0, 10 - 0.05 * count(CASE WHEN severity = 'high' THEN 1 END) - 0.02 * count(CASE WHEN severity = 'medium' THEN 1 END) - 0.005 * count(CASE WHEN severity = 'low' THEN 1 END)), 6) AS score FROM ({FINDINGS}) z GROUP BY file", lambda s: s.replace("100.0D", "100.0::DOUBLE").replace("SELECT file, round(", "SELECT file, CAST(round(").replace(", 6) AS score", ", 6) AS DOUBLE) AS score"))
stated("nfr_missing", f"WITH c AS (SELECT DISTINCT node_id, category FROM ({FINDINGS}) z WHERE severity = 'high'), a AS (SELECT DISTINCT category FROM c), n AS (SELECT DISTINCT node_id FROM c) SELECT n.node_id, a.category FROM n CROSS JOIN a LEFT JOIN c ON c.node_id = n.node_id AND c.category = a.category WHERE c.category IS NULL")
stated(
    "counter_rates",
    "WITH r AS (SELECT user_id % 50 AS container, event_id, CAST(floor(value * 100) AS BIGINT) AS rx, {us} AS us, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id DESC) AS k FROM events), w AS (SELECT *, lag(rx) OVER (PARTITION BY container ORDER BY event_id) AS was, lag(us) OVER (PARTITION BY container ORDER BY event_id) AS t FROM r WHERE k <= 60) SELECT container, event_id, round(greatest(0.0, (rx - was) / greatest((us - t) / 1e6, 0.001)), 6) AS rate FROM w WHERE was IS NOT NULL".replace("{us}", "unix_micros(cast(ts as timestamp))"),
    lambda s: s.replace("unix_micros(cast(ts as timestamp))", "epoch_us(ts)"),
)
stated(
    "commit_tally",
    r"""WITH m AS (SELECT *, trim(split_part(text, chr(10), 1)) AS subject FROM (SELECT conv_id AS id, CASE conv_id % 6 WHEN 0 THEN concat('feat(x): ', text) WHEN 1 THEN concat('fix!: ', text, ' Fixes #', conv_id % 40) WHEN 2 THEN concat('docs: t', chr(10), 'closes #', conv_id % 30) ELSE text END AS text FROM conversations) z)
SELECT regexp_extract(subject, '^([a-z]+)(\\([^)]+\\))?!?:\\s*.+$', 1) AS kind, count(*) AS n, count(CASE WHEN regexp_matches(subject, '^[a-z]+(\\([^)]+\\))?!:') THEN 1 END) AS breaking, count(DISTINCT nullif(regexp_extract(lower(text), '\\b(fix|fixes|fixed)\\s+#([0-9]+)', 2), '')) AS fix_refs, count(DISTINCT nullif(regexp_extract(lower(text), '\\b(close|closes|closed|resolve|resolves|resolved)\\s+#([0-9]+)', 2), '')) AS resolve_refs FROM m GROUP BY 1""",
    lambda s: s.replace("\\\\", "\\"),
)
stated("token_footprint", "SELECT doc_id, CAST(ceil(octet_length(text) / 2.8D) AS BIGINT) AS by_bytes FROM documents", lambda s: s.replace("octet_length(text)", "octet_length(encode(text))").replace("2.8D", "2.8::DOUBLE"))
QUERY_SHARE = "WITH g AS (SELECT lang, count(*) AS files, sum(n_chars) AS bytes FROM documents GROUP BY lang) SELECT lang, files, CAST(bytes AS BIGINT) AS bytes, round(CAST(bytes AS DOUBLE) / CAST(sum(bytes) OVER () AS DOUBLE) * 100, 6) AS percent FROM g"
stated("language_share", QUERY_SHARE)
stated(
    "value_customer",
    """WITH c AS (SELECT o_custkey % 200 AS pr, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) % 5 AS f, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) % 4 AS i, count(CASE WHEN o_orderstatus = 'P' THEN 1 END) % 3 AS x, count(CASE WHEN o_orderpriority LIKE '1%' THEN 1 END) % 5 AS crit FROM orders GROUP BY o_custkey % 200)
SELECT pr, round((60 * least(f / 3.0E0, 1.0E0) + 40 * least((i + x) / 3.0E0, 1.0E0)) * (1 - 0.15E0 * least(crit, 3)), 1) AS delta, CASE WHEN f + i + x = 0 THEN 'low' WHEN f + i + x >= 4 AND crit = 0 THEN 'high' WHEN f + i + x >= 4 THEN 'medium' WHEN crit > 0 THEN 'low' ELSE 'medium' END AS confidence FROM c""",
)
stated(
    "quality_composite",
    "WITH c AS (SELECT p_brand AS pr, exp(0.40E0 * ln(greatest(avg(p_size) / 50, 0.01E0)) + 0.35E0 * ln(greatest(max(p_retailprice) / 2500, 0.01E0)) + 0.25E0 * ln(greatest(count(*) / 200.0E0, 0.01E0))) AS g FROM part GROUP BY p_brand) SELECT pr, round(g, 6) AS score, CASE WHEN g >= 0.66 THEN 'green' WHEN g >= 0.33 THEN 'amber' ELSE 'red' END AS band FROM c",
)
stated("entry_search", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_type), 'eco')")


def name_similarity(s, d):
    return near_names(rows(s, d, "SELECT DISTINCT concat(p_name, ' ', p_brand) AS name FROM part"))


add("name_similarity_pairs", name_similarity, "WITH n AS (SELECT DISTINCT concat(p_name, ' ', p_brand) AS name FROM part), p AS (SELECT a.name AS a, b.name AS b, levenshtein(a.name, b.name) AS d, length(a.name) + length(b.name) AS t FROM n a JOIN n b ON a.name < b.name) SELECT a, b, CAST(round((t - d) / t * 100) AS BIGINT) AS ratio FROM p WHERE round((t - d) / t * 100) >= 95")


def shingle_jaccard(s, d):
    """Jaccard of three-token shingles of a brand's catalogue, its texts in order, against the next brand's."""
    t = rows(s, d, "SELECT p_brand AS g, CAST(regexp_extract(p_brand, '[0-9]+', 0) AS INT) AS k, p_partkey, concat(p_name, ' ', p_type) AS x FROM part")
    tokens = t.select("g", "x", "p_partkey", F.posexplode(F.regexp_extract_all("x", F.lit("[A-Za-z0-9_]+"), F.lit(0))).alias("at", "token"))
    brands = t.select("g", "k").distinct()
    pairs = brands.select(F.col("g").alias("a"), "k").join(brands.select(F.col("g").alias("b"), (F.col("k") - 1).alias("k")), "k")
    return C.shingle_overlap(C.running_shingles(tokens, ["x", "p_partkey", "at"]), pairs).withColumn("jaccard", F.round("jaccard", 9))


add("shingle_jaccard", shingle_jaccard, """WITH t AS (SELECT p_brand AS g, CAST(regexp_extract(p_brand, '[0-9]+') AS INT) AS k, string_agg(x, ' ' ORDER BY x) AS x FROM (SELECT p_brand, concat(p_name, ' ', p_type) AS x FROM part) GROUP BY p_brand), w AS (SELECT g, k, regexp_extract_all(x, '[A-Za-z0-9_]+') AS w FROM t), s AS (SELECT g, k, list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS s FROM w)
SELECT a.g AS a, b.g AS b, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 9) AS jaccard FROM s a JOIN s b ON b.k = a.k + 1""")


def frame_filter(text: str, name_column: str = "name", file_column: str = "file"):
    """The filter language compiled to a Column: terms by blanks, name: and file: scopes, ! negates; all must hold."""
    name, file, out = F.col(name_column), F.col(file_column), F.lit(True)
    for term in text.split():
        negated, body = term.startswith("!"), term.lstrip("!")
        scope, _, rest = body.partition(":")
        path = F.coalesce(file, F.lit(""))
        hit = name.contains(rest) if scope == "name" and rest else path.contains(rest) if scope == "file" and rest else name.contains(body) | path.contains(body)
        out = out & (~hit if negated else hit)
    return out


add("frame_filter_dsl", lambda s, d: rows(s, d, "SELECT p_partkey, p_name AS name, CASE WHEN p_size > 5 THEN p_brand END AS file FROM part").filter(frame_filter("name:ring !file:#1 Brand")).select("p_partkey"), "SELECT p_partkey FROM (SELECT p_partkey, p_name AS name, coalesce(CASE WHEN p_size > 5 THEN p_brand END, '') AS file FROM part) WHERE contains(name, 'ring') AND NOT contains(file, '#1') AND (contains(name, 'Brand') OR contains(file, 'Brand'))")
