"""Symbol queries over nodes derived from the driver's tables, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes as C
from ..operators import profile as P
from ..operators import symbols as Y
from .findings import FINDINGS
from .joins import EDGES, NODES, add, rows
from .profile import S, samples

NAMED = """SELECT p_partkey AS id, CASE WHEN p_partkey % 9 > 0 THEN concat('./src/d', p_partkey % 7, '/m', p_size % 5, '.py') END AS file, concat(CASE p_partkey % 6 WHEN 0 THEN 'get' WHEN 1 THEN 'set' WHEN 2 THEN 'is' WHEN 3 THEN 'get_' ELSE '' END, upper(substr(p_name, 1, 1)), substr(p_name, 2, p_size % 4)) AS name,
CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'outer.<locals>.inner' WHEN 3 THEN concat('pkg.', p_brand, '.', 'run') ELSE '.odd' END AS qualname FROM part"""
CHANGED = "SELECT concat(CASE p_size % 2 WHEN 0 THEN './' ELSE '' END, 'd', p_partkey % 3, '/m', p_size % 2, '.py') AS path FROM part"
PLAIN = "regexp_replace({}, '^(\\./)+', '')"
TREE = S + ", p AS (SELECT w, unnest(generate_series(1, 4)) AS k, list_reverse(names) AS path FROM s), t AS (SELECT array_to_string(path[1:k], ';') AS path, CASE WHEN k > 1 THEN array_to_string(path[1:k - 1], ';') ELSE '' END AS parent, k, CAST(sum(w) AS BIGINT) AS v FROM p GROUP BY 1, 2, 3)"
FILES = f"SELECT id, concat('f', CAST(substr(id, 2) AS INT) % 20) AS file FROM ({NODES}) n"


def tree(s, d):
    return P.call_tree(samples(s, d))


def stacks(s, d):
    return samples(s, d).select("time_us", F.array_join(F.transform("frames", lambda f: f["name"]), ";").alias("stack"), F.col("tick_count").alias("n"))


def paths(s, d):
    return samples(s, d).select(F.reverse(F.transform("frames", lambda f: f["name"])).alias("path"))


add("node_ids", lambda s, d: rows(s, d, NAMED).select("id", Y.node_id(F.col("file"), F.col("name"), F.col("qualname")).alias("node_id")), f"SELECT id, CASE WHEN NOT contains(qualname, '<locals>') AND regexp_matches(qualname, '^.+\\.[^.]+$') THEN concat(coalesce(file, ''), '::', regexp_extract(qualname, '^(.+)\\.([^.]+)$', 1), '::', regexp_extract(qualname, '^(.+)\\.([^.]+)$', 2)) ELSE concat(coalesce(file, ''), '::', name) END AS node_id FROM ({NAMED}) z")
add("accessor_names", lambda s, d: rows(s, d, NAMED).filter(Y.is_accessor(F.col("name"))).select("id", "name"), f"SELECT id, name FROM ({NAMED}) z WHERE length(name) >= 4 AND (regexp_matches(name, '^[gs]et[A-Z]') OR regexp_matches(name, '^is[A-Z]'))")
add("scope_filter", lambda s, d: Y.in_scope(rows(s, d, NAMED), rows(s, d, CHANGED)).select("id", "file"), f"WITH n AS ({NAMED}), c AS (SELECT DISTINCT {PLAIN.format('path')} AS p FROM ({CHANGED}) y) SELECT id, file FROM n WHERE EXISTS (SELECT 1 FROM c WHERE {PLAIN.format('file')} = p OR ends_with({PLAIN.format('file')}, concat('/', p)))")
FOUND = f"SELECT id, file, line, kind FROM ({FINDINGS}) f"
DUCK = FOUND.replace("100.0D", "100.0::DOUBLE")
add("suggestion_merge", lambda s, d: Y.merge_suggestions(rows(s, d, f"{FOUND} WHERE id % 3 = 0"), rows(s, d, f"{FOUND} WHERE id % 3 > 0")), f"WITH f AS ({DUCK}) SELECT * FROM f WHERE id % 3 = 0 UNION ALL SELECT * FROM f WHERE id % 3 > 0 AND (file, line) NOT IN (SELECT (file, line) FROM f WHERE id % 3 = 0)")
add("level_nodes", lambda s, d: Y.level_view(paths(s, d))[0], S + " SELECT id, CAST(min(k) AS INT) AS level FROM (SELECT list_reverse(names)[k + 1] AS id, k FROM s, (SELECT unnest([0, 1, 2, 3]) AS k)) GROUP BY id")
add("level_edges", lambda s, d: Y.level_view(paths(s, d))[1], S + " SELECT DISTINCT names[i + 1] AS src, names[i] AS dst FROM s, (SELECT unnest([1, 2, 3]) AS i)")
add("cross_file_edges", lambda s, d: Y.cross_file_edges(rows(s, d, EDGES), rows(s, d, FILES)), f"WITH n AS ({FILES}) SELECT DISTINCT a.file AS src_file, b.file AS dst_file FROM ({EDGES}) e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst WHERE a.file <> b.file")
add("subtree_shares", lambda s, d: Y.subtree_shares(tree(s, d)).select("path", "value_us", F.round("percent_total", 6).alias("percent_total"), F.round("percent_parent", 6).alias("percent_parent")), TREE + " SELECT t.path, t.v AS value_us, round(t.v / (SELECT sum(v) FROM t WHERE k = 1) * 100, 6) AS percent_total, round(coalesce(t.v / u.v, t.v / (SELECT sum(v) FROM t WHERE k = 1)) * 100, 6) AS percent_parent FROM t LEFT JOIN t u ON u.path = t.parent")
add("icicle_layout", lambda s, d: Y.icicle(tree(s, d)), TREE + " SELECT path, CAST(coalesce(sum(v) OVER (PARTITION BY parent ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS x, v AS width FROM t")
add("windowed_stacks", lambda s, d: Y.windowed_stacks(stacks(s, d), 3_600_000_000, 40), S + ", c AS (SELECT time_us // 3600000000 * 3600000000 AS start_us, array_to_string(names, ';') AS stack, CAST(sum(tick) AS BIGINT) AS n FROM s GROUP BY 1, 2) SELECT * FROM c UNION ALL SELECT start_us, 'unknown', CAST(40 - sum(n) AS BIGINT) FROM c GROUP BY start_us HAVING sum(n) < 40")
add("facet_counts", lambda s, d: Y.facet_counts(rows(s, d, f"SELECT node_id AS id, kind FROM ({FINDINGS}) f"), rows(s, d, "SELECT concat('n', l_suppkey) AS id FROM lineitem")), f"SELECT kind, count(DISTINCT node_id) AS n FROM ({FINDINGS.replace('100.0D', '100.0::DOUBLE')}) f WHERE node_id IN (SELECT concat('n', l_suppkey) FROM lineitem) GROUP BY kind")
add("dominant_language", lambda s, d: C.most_common(s.read.parquet(f"{d}/documents.parquet"), "lang"), "SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang ORDER BY n DESC, lang LIMIT 1")
