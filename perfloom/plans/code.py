"""Symbols, calls, trees and findings over rows of `part` and `lineitem`; each oracle is written on its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import detectors as D
from ..operators import graph as G
from ..operators import joins as J
from ..operators import trees as T
from .joins import EDGES, NODES, RANGES, STEP, add, linked, rows

SYMS = """SELECT concat('P', p_partkey) AS id, CASE p_partkey % 11 WHEN 0 THEN 'Widget' WHEN 1 THEN 'getValue' WHEN 2 THEN '_hidden' WHEN 3 THEN '<module>' ELSE concat('fn_', p_partkey) END AS name, CASE WHEN p_partkey % 13 = 0 THEN 'class' ELSE 'function' END AS kind,
concat('src/', CASE WHEN p_size % 10 = 0 THEN 'tests/' ELSE '' END, p_brand, '.py') AS file, p_partkey % 500 + 1 AS line, p_partkey % 170 AS loc, p_size % 18 AS complexity, p_size % 7 AS nesting, p_partkey % 3 = 0 AS is_async, p_size % 14 AS call_sites, p_retailprice / 2000 AS pagerank, p_partkey % 19 = 0 AS is_recursive, CAST(p_size AS DOUBLE) AS percent_total FROM part"""
EXT = """SELECT concat('P', l_partkey) AS id, l_orderkey * 10 + l_linenumber AS ord, CASE l_linenumber % 4 WHEN 0 THEN 'Client' ELSE 'query' END AS name, 'db' AS receiver, CASE CASE WHEN l_partkey % 4 = 0 THEN 2 + l_suppkey % 2 * 4 ELSE l_suppkey % 7 END WHEN 0 THEN 'db' WHEN 1 THEN 'cache' WHEN 2 THEN 'log' WHEN 3 THEN 'network' WHEN 4 THEN 'io' WHEN 5 THEN 'queue' ELSE 'none' END AS category,
CASE l_linenumber % 3 WHEN 0 THEN 'imported_module' WHEN 1 THEN 'receiver_pattern' ELSE 'method_signature' END AS tier, CAST(l_linenumber AS BIGINT) AS line, l_linestatus = 'F' AS in_loop, l_returnflag = 'A' AS in_await FROM lineitem"""
FOREST = "SELECT concat('P', CAST(floor(p_partkey / 3) AS BIGINT)) AS src, concat('P', p_partkey) AS dst, 0 AS ord FROM part WHERE p_partkey >= 9"
TOPS = f"SELECT DISTINCT src AS id FROM ({FOREST}) z WHERE src IN ('P3', 'P4', 'P5', 'P6', 'P7', 'P8')"
P90 = 0.75
SURE = "CASE tier WHEN 'imported_module' THEN 0.95 WHEN 'receiver_pattern' THEN 0.80 ELSE 0.65 END"


def syms(s, d):
    return rows(s, d, SYMS)


def ext(s, d):
    # a call is told by its place in the symbol; equal places of a symbol are ranked by the supplier's category
    return rows(s, d, EXT)


def calls(where: str, kind: str, severity: str, effort: str, sure: str, more: str = "") -> str:
    return f"SELECT e.id, '{kind}' AS kind, '{severity}' AS severity, '{effort}' AS effort, {sure}::DOUBLE AS confidence, count(*) AS n FROM e JOIN y ON y.id = e.id WHERE e.name = 'query' AND {where} {more} GROUP BY e.id"


BASE = f"WITH y AS ({SYMS}), e AS ({EXT})"
DROP = ["line"]
add("detect_n_plus_one", lambda s, d: D.n_plus_one(syms(s, d), ext(s, d)).drop(*DROP), f"{BASE} " + calls("in_loop AND category IN ('db', 'cache')", "n_plus_one", "high", "small", f"max({SURE})"))
add("detect_blocking_async", lambda s, d: D.blocking_in_async(syms(s, d), ext(s, d)).drop(*DROP), f"{BASE} " + calls("NOT in_await AND category IN ('db', 'network', 'io')", "blocking_in_async", "high", "trivial", f"max({SURE})", "AND y.is_async"))
add("detect_noisy_logs", lambda s, d: D.noisy_logs(syms(s, d), ext(s, d)).drop(*DROP), f"{BASE} " + calls("in_loop AND category = 'log'", "noisy_log", "medium", "trivial", "0.85"))
HEAVY = "SELECT id, 'expensive_compute' AS kind, CASE WHEN complexity >= 15 OR loc >= 150 THEN 'high' WHEN complexity >= 10 OR loc >= 80 THEN 'medium' ELSE 'low' END AS severity, CASE WHEN loc >= 150 OR nesting >= 5 THEN 'large' WHEN loc >= 80 OR complexity >= 15 THEN 'medium' ELSE 'small' END AS effort, 0.7::DOUBLE AS confidence, 1::BIGINT AS n FROM y WHERE complexity >= 10 OR loc >= 80 OR nesting >= 4"
add("detect_expensive", lambda s, d: D.expensive_compute(syms(s, d)).drop(*DROP), f"{BASE} {HEAVY}")
add("detect_recursive", lambda s, d: D.recursive(syms(s, d)).select("id", "kind", "severity"), f"{BASE} SELECT id, 'recursive' AS kind, 'medium' AS severity FROM y WHERE is_recursive AND NOT starts_with(name, '<')")
add("detect_missing_caching", lambda s, d: D.missing_caching(syms(s, d), ext(s, d)).select("id", "confidence"), f"{BASE} SELECT id, 0.55::DOUBLE AS confidence FROM y WHERE call_sites >= 5 AND (complexity >= 5 OR loc >= 20) AND NOT is_recursive AND name <> 'Widget' AND NOT EXISTS (SELECT 1 FROM e WHERE e.id = y.id AND category IN ('db', 'network', 'io', 'queue'))")
add("detect_log_amplification", lambda s, d: D.log_amplification(syms(s, d), ext(s, d), P90).select("id", "severity", "n"), f"{BASE} SELECT y.id, 'medium' AS severity, count(*) AS n FROM y JOIN e ON e.id = y.id AND category = 'log' WHERE pagerank >= {P90} OR call_sites >= 10 GROUP BY y.id HAVING count(*) >= 3")
BUMP = f"(percent_total >= 20)::INT + (pagerank >= {P90})::INT + (call_sites >= 10)::INT"
add("detect_all", lambda s, d: D.detect(syms(s, d), ext(s, d), P90).groupBy("kind", "severity").agg(F.count(F.lit(1)).alias("n")), f"""{BASE}, f AS ({calls("in_loop AND category IN ('db', 'cache')", "n_plus_one", "high", "small", "0")} UNION ALL {calls("NOT in_await AND category IN ('db', 'network', 'io')", "blocking_in_async", "high", "trivial", "0", "AND y.is_async")} UNION ALL {calls("in_loop AND category = 'log'", "noisy_log", "medium", "trivial", "0.85")} UNION ALL {HEAVY}
UNION ALL SELECT id, 'recursive', 'medium', 'medium', 1, 1 FROM y WHERE is_recursive AND NOT starts_with(name, '<') UNION ALL SELECT id, 'missing_caching', 'medium', 'small', 0.55, 1 FROM y WHERE call_sites >= 5 AND (complexity >= 5 OR loc >= 20) AND NOT is_recursive AND name <> 'Widget' AND NOT EXISTS (SELECT 1 FROM e WHERE e.id = y.id AND category IN ('db', 'network', 'io', 'queue'))
UNION ALL SELECT y.id, 'log_amplification', 'medium', 'trivial', 0.8, count(*) FROM y JOIN e ON e.id = y.id AND category = 'log' WHERE pagerank >= {P90} OR call_sites >= 10 GROUP BY y.id HAVING count(*) >= 3),
h AS (SELECT f.id, f.kind, CASE WHEN f.kind = 'noisy_log' AND severity = 'medium' AND pagerank >= {P90} THEN 'high' ELSE severity END AS severity, {BUMP} AS b FROM f JOIN y ON y.id = f.id) SELECT kind, CASE WHEN severity = 'low' AND b = 3 THEN 'high' WHEN severity = 'low' AND b = 2 THEN 'medium' WHEN severity = 'medium' AND b >= 2 THEN 'high' ELSE severity END AS severity, count(*) AS n FROM h GROUP BY 1, 2""")
REACHED = "SELECT id, file, line, complexity, call_sites AS db_reached FROM ({}) z".format(SYMS)
add("graph_n_plus_one", lambda s, d: D.graph_n_plus_one(rows(s, d, REACHED), s.createDataFrame([("Brand#11.py",), ("src/Brand#3.py",)], "path string")), f"SELECT id, 'graph_n_plus_one' AS kind, line, round(greatest(0.75, least(0.95, 0.65 + 0.04 * db_reached)), 6)::DOUBLE AS confidence FROM ({REACHED}) WHERE db_reached >= 3 AND complexity >= 3 AND (file LIKE '%/Brand#11.py' OR file = 'src/Brand#3.py')")
add("dead_in_changed", lambda s, d: D.dead_in_changed(syms(s, d), G.flipped(rows(s, d, FOREST)), rows(s, d, TOPS), s.createDataFrame([("src/tests/Brand#5.py",), ("Brand#7.py",)], "path string")), f"SELECT id, file, line FROM ({SYMS}) WHERE kind <> 'class' AND id NOT IN (SELECT src FROM ({FOREST})) AND id NOT IN ({TOPS}) AND (file = 'src/tests/Brand#5.py' OR file LIKE '%/Brand#7.py') ORDER BY file, line, id")
SOURCE = "SELECT concat('f', p_partkey) AS path, concat('def a():', chr(10), CASE p_partkey % 5 WHEN 0 THEN concat('  try:', chr(10), '    x()', chr(10), '  except Exception:', chr(10), '    pass') WHEN 1 THEN '  return -1' WHEN 2 THEN concat('  q = \"select a from t where x=\" + ', p_name) WHEN 3 THEN '  except KeyError: pass' ELSE '  return 1' END, chr(10), '# end') AS text FROM part"
add("text_patterns", lambda s, d: D.text_patterns(rows(s, d, SOURCE.replace('\\"', '"'))), "SELECT concat('f', p_partkey) AS path, CASE p_partkey % 5 WHEN 0 THEN 4 ELSE 2 END::INT AS line, CASE p_partkey % 5 WHEN 0 THEN 'silent_except' WHEN 3 THEN 'silent_except' WHEN 1 THEN 'sentinel_return' ELSE 'sql_concatenation' END AS kind, CASE p_partkey % 5 WHEN 2 THEN 'high' WHEN 1 THEN 'low' ELSE 'medium' END AS severity FROM part WHERE p_partkey % 5 < 4")

# ---- trees
WALK = f"""WITH RECURSIVE f AS ({FOREST}), r(root, id, path, depth) AS (SELECT id, id, [id], 0 FROM ({TOPS}) UNION ALL SELECT root, dst, list_append(path, dst), depth + 1 FROM r JOIN f ON src = r.id), w AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY path) - 1 AS seq FROM r)"""


def walked(s, d):
    return T.expand(rows(s, d, TOPS), syms(s, d), rows(s, d, FOREST))


def pathed(s, d):
    return T.paths(walked(s, d))


add("call_trees", lambda s, d: walked(s, d).select("root", "seq", "id", "depth"), f"{WALK} SELECT root, seq, id, depth FROM w")
add("call_trees_of_cycles", lambda s, d: T.expand(rows(s, d, f"SELECT DISTINCT src AS id FROM ({EDGES}) z WHERE src LIKE 'S%'"), syms(s, d), rows(s, d, EDGES).withColumn("ord", F.lit(0)), budget=T.node_budget(30_000, 100)).groupBy("root", "truncated").agg(F.count(F.lit(1)).alias("n")), None)
add("tree_shares", lambda s, d: T.subtree(pathed(s, d)).select("root", "seq", "subtree_size", F.round("percent_total", 6).alias("percent_total"), F.round("percent_parent", 6).alias("percent_parent")), f"""{WALK}, u AS (SELECT root, unnest(path) AS id FROM w), z AS (SELECT root, id, count(*) AS n FROM u GROUP BY ALL)
SELECT w.root, w.seq, z.n AS subtree_size, round(z.n / t.n * 100, 6) AS percent_total, round(z.n / coalesce(a.n, t.n) * 100, 6) AS percent_parent FROM w JOIN z ON z.root = w.root AND z.id = w.id JOIN z t ON t.root = w.root AND t.id = w.root LEFT JOIN z a ON a.root = w.root AND a.id = w.path[-2]""")
FOUND = "SELECT id, CASE complexity % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity FROM ({}) z WHERE nesting > 2".format(SYMS)
add("roots_overview", lambda s, d: T.roots_overview(pathed(s, d), rows(s, d, FOUND)).withColumn("percent_of_all_roots", F.round("percent_of_all_roots", 6)).withColumn("first_callees", F.array_join("first_callees", ",")), f"""{WALK}, n AS (SELECT root, count(*) AS c FROM w GROUP BY root), h AS (SELECT root, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM w JOIN ({FOUND}) f ON f.id = w.id GROUP BY root)
SELECT n.root, c AS subtree_size, round(c / (SELECT sum(c) FROM n) * 100, 6)::DOUBLE AS percent_of_all_roots, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low, (SELECT string_agg(id, ',' ORDER BY seq) FROM (SELECT id, seq FROM w WHERE w.root = n.root AND depth = 1 ORDER BY seq LIMIT 5)) AS first_callees FROM n LEFT JOIN h ON h.root = n.root""")
CATS = "SELECT id, CASE complexity % 4 WHEN 0 THEN 'db' WHEN 1 THEN 'io' ELSE 'log' END AS category FROM ({}) z WHERE nesting > 3".format(SYMS)
add("hot_paths", lambda s, d: T.hot_paths(pathed(s, d), rows(s, d, CATS)), f"{WALK} SELECT root, array_to_string(path, ';') AS frames, depth, category FROM w JOIN ({CATS}) c ON c.id = w.id ORDER BY depth DESC, category, frames, root LIMIT 10")
add("categories_reached", lambda s, d: T.categories_reached(walked(s, d), ext(s, d)), f"{WALK} SELECT root, category, count(*) AS n FROM w JOIN ({EXT}) e ON e.id = w.id GROUP BY ALL")
add("root_discovery", lambda s, d: T.discover(syms(s, d), rows(s, d, FOREST), changed=s.createDataFrame([("Brand#7.py",)], "path string")), f"""WITH RECURSIVE f AS ({FOREST}), y AS ({SYMS}), c AS (SELECT * FROM y WHERE kind <> 'class' AND name NOT IN ('getValue', '_hidden') AND NOT contains(file, '/tests/') AND id NOT IN (SELECT dst FROM f JOIN y a ON a.id = f.src WHERE NOT starts_with(a.name, '<'))),
r(root, id) AS (SELECT id, id FROM c UNION SELECT root, dst FROM r JOIN f ON src = r.id), n AS (SELECT root, count(*) AS reach FROM r GROUP BY root HAVING count(*) >= 2) SELECT c.id, c.name, reach FROM n JOIN c ON c.id = n.root ORDER BY c.file LIKE '%/Brand#7.py' DESC, reach DESC, c.name, c.id LIMIT 200""")

# ---- graph
SEEDS = "SELECT concat('P', p_partkey) AS id FROM part WHERE p_brand = 'Brand#4'"
DOWN = "{n}(id, k) AS (SELECT id, 0 FROM ({seeds}) UNION SELECT {to}, k + 1 FROM {n} JOIN f ON {frm} = {n}.id WHERE k < 12)"
add("signed_ranks", lambda s, d: G.signed_ranks(rows(s, d, SEEDS), rows(s, d, FOREST)), f"WITH RECURSIVE f AS ({FOREST}), {DOWN.format(n='a', seeds=SEEDS, to='dst', frm='src')}, {DOWN.format(n='b', seeds=SEEDS, to='src', frm='dst')}, x AS (SELECT id, min(k) AS k FROM a GROUP BY id), z AS (SELECT id, min(k) AS k FROM b GROUP BY id) SELECT coalesce(x.id, z.id) AS id, CASE WHEN coalesce(x.k, 99) <= coalesce(z.k, 99) THEN x.k ELSE -z.k END::INT AS rank FROM x FULL JOIN z ON x.id = z.id")
add("scope_around", lambda s, d: G.around(rows(s, d, SEEDS), rows(s, d, FOREST))[0], f"WITH RECURSIVE g AS ({FOREST}), f AS (SELECT src, dst FROM g UNION ALL SELECT dst, src FROM g), {DOWN.format(n='a', seeds=SEEDS, to='dst', frm='src').replace('k < 12', 'k < 3')} SELECT id, min(k)::INT AS distance FROM a GROUP BY id ORDER BY distance, id LIMIT 80")
add("direct_neighbours", lambda s, d: G.neighbours(rows(s, d, FOREST), "P40"), f"SELECT src AS id, 'caller' AS side FROM ({FOREST}) WHERE dst = 'P40' UNION SELECT dst, 'callee' FROM ({FOREST}) WHERE src = 'P40'")
add("entry_points", lambda s, d: G.entry_points(syms(s, d).select("id", "name"), "fn_19"), f"WITH y AS ({SYMS}) SELECT id, name FROM y WHERE name = 'fn_19' OR (contains(name, 'fn_19') AND NOT EXISTS (SELECT 1 FROM y WHERE name = 'fn_19'))")
add("graph_top10", lambda s, d: G.page_rank(*linked(s, d), tolerance=0, most=2).select("id", F.round("rank", 9).alias("rank")).orderBy(F.desc("rank"), "id").limit(10), f"WITH e AS ({EDGES}), n AS ({NODES}), g AS (SELECT src, count(*) AS deg FROM e GROUP BY src), r0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM n) AS rank FROM n), " + ", ".join(STEP.format(n=i + 1, m=i) for i in range(2)) + " SELECT id, round(rank, 9) AS rank FROM r2 ORDER BY 2 DESC, id LIMIT 10")
COVER = "SELECT concat(p_type, p_partkey % 7) AS root, concat(p_brand, '-', p_size) AS file, CAST(count(*) AS BIGINT) AS nodes FROM part GROUP BY ALL"
add("root_cover", lambda s, d: G.cover(rows(s, d, COVER)), None)

# ---- references
IMPORTS = "SELECT concat('web/', p_type, '/f', p_partkey % 50, '.ts') AS file, p_name AS name, CASE p_partkey % 4 WHEN 0 THEN './lib' WHEN 1 THEN '../shared/./x' WHEN 2 THEN '../../../up' ELSE 'react' END AS module FROM part"
WANTED = "SELECT p_partkey AS ref, p_partkey AS src, p_name AS name, concat('web/', p_type, '/f', p_partkey % 50, '.ts') AS file, p_type AS lang FROM part"
HAVE = "SELECT p_partkey + 1000000 AS id, p_name AS name, CASE p_size % 3 WHEN 0 THEN concat('web/', p_type, '/lib/index.ts') WHEN 1 THEN 'web/shared/x.ts' ELSE concat('web/', p_type, '/lib.ts') END AS file, p_type AS lang FROM part"
IMPORTED = f"""i AS (SELECT DISTINCT file, name, CASE module WHEN './lib' THEN regexp_replace(file, '/[^/]*$', '') || '/lib' WHEN '../shared/./x' THEN 'web/shared/x' END AS path FROM ({IMPORTS}) WHERE module IN ('./lib', '../shared/./x')),
m AS (SELECT r.ref, r.src, y.id AS dst, CASE WHEN y.file = path || '.ts' THEN 1 ELSE 2 END AS way FROM r JOIN i ON i.file = r.file AND i.name = r.name JOIN y ON y.name = r.name AND (y.file = path || '.ts' OR y.file = path || '/index.ts')),
b AS (SELECT ref, src, arg_min(dst, (way, dst)) AS dst FROM m GROUP BY ref, src)"""
add("import_resolution", lambda s, d: J.resolve_imports(rows(s, d, WANTED), rows(s, d, IMPORTS).distinct(), rows(s, d, HAVE)), f"WITH r AS ({WANTED}), y AS ({HAVE}), {IMPORTED} SELECT ref, src, dst FROM b")
add("call_site_counts", lambda s, d: J.call_sites(J.resolve(rows(s, d, WANTED), rows(s, d, IMPORTS).distinct(), rows(s, d, HAVE))), f"WITH r AS ({WANTED}), y AS ({HAVE}), {IMPORTED}, q AS (SELECT * FROM r WHERE ref NOT IN (SELECT ref FROM b)), w AS (SELECT ref, y.id AS dst, q.file = y.file AS own FROM q JOIN y ON q.name = y.name AND (q.file = y.file OR q.lang = y.lang)), v AS (SELECT *, bool_or(own) OVER (PARTITION BY ref) AS a, count(*) OVER (PARTITION BY ref) AS n FROM w) SELECT dst AS id, count(*) AS sites FROM (SELECT dst FROM b UNION ALL SELECT dst FROM v WHERE own OR (NOT a AND n <= 8)) GROUP BY dst")
SPOTS = "SELECT l_orderkey * 10 + l_linenumber AS ref, concat('Brand#', l_suppkey % 40 + 1) AS file, l_partkey % 1000 AS pos FROM lineitem"
add("module_symbols", lambda s, d: J.module_edges(rows(s, d, SPOTS), rows(s, d, RANGES)), f"WITH p AS ({SPOTS}), r AS ({RANGES}) SELECT DISTINCT p.file, p.file || '::<module>' AS id FROM p WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.file = p.file AND p.pos BETWEEN r.s AND r.e)")
add("alias_rewrite", lambda s, d: rows(s, d, "SELECT p_partkey AS id, concat(CASE WHEN p_size % 2 = 0 THEN '/app/' ELSE '/srv/' END, p_type, '.py') AS file, '/app/' AS prefix, '/home/x/' AS host FROM part").select("id", J.rewrite(F.col("file"), F.col("prefix"), F.col("host")).alias("file")), "SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN '/home/x/' ELSE '/srv/' END || p_type || '.py' AS file FROM part")

# ---- orders, caps, sets
FIND = "SELECT id, concat('k', complexity % 5) AS kind, CASE nesting % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity, file, line, CAST(loc AS DOUBLE) / 200 AS confidence FROM ({}) z".format(SYMS)
RANK = "CASE severity WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END"
add("findings_capped", lambda s, d: D.capped(rows(s, d, FIND), 20, [-D.rank_of("severity", D.SEVERITIES), "file", "line", "id"]).select("id", "kind"), f"WITH f AS ({FIND}), q AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY {RANK} DESC, file, line, id) AS r FROM f) SELECT id, kind FROM q WHERE r <= 5 ORDER BY {RANK} DESC, file, line, id LIMIT 20")
add("findings_view", lambda s, d: D.view(rows(s, d, FIND), ["k1", "k2"], ["high", "medium"], "brand#1").select("id", "severity"), f"SELECT id, severity FROM ({FIND}) WHERE kind IN ('k1', 'k2') AND severity <> 'low' AND contains(lower(file), 'brand#1')")
add("findings_union", lambda s, d: D.union_first([rows(s, d, FIND).filter("kind = 'k1'"), rows(s, d, FIND).filter("severity = 'high'"), rows(s, d, FIND)], ["file", "kind", "line"], 24, ["file", "line", "kind", "id"]).select("id", "source"), f"WITH f AS ({FIND}), u AS (SELECT *, 0 AS source FROM f WHERE kind = 'k1' UNION ALL SELECT *, 1 FROM f WHERE severity = 'high' UNION ALL SELECT *, 2 FROM f), q AS (SELECT *, row_number() OVER (PARTITION BY file, kind, line ORDER BY source, file, line, kind, id) AS r FROM u) SELECT id, source FROM q WHERE r = 1 ORDER BY source, file, line, kind, id LIMIT 24")
OLD = "SELECT id, CASE WHEN complexity % 4 > 0 THEN concat('k', complexity % 5) END AS kind FROM ({}) z WHERE nesting <> 3".format(SYMS)
NOW = "SELECT id, concat('k', complexity % 3) AS kind FROM ({}) z WHERE nesting <> 4".format(SYMS)
add("smell_changes", lambda s, d: D.new_smells(rows(s, d, OLD), rows(s, d, NOW)), f"WITH a AS ({OLD}), b AS ({NOW}), i AS (SELECT id FROM a INTERSECT SELECT id FROM b) SELECT id, kind, 'new' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) WHERE id IN (FROM i) UNION ALL SELECT id, kind, 'fixed' FROM (SELECT * FROM a WHERE kind IS NOT NULL EXCEPT SELECT * FROM b) WHERE id IN (FROM i)")
add("signal_summary", lambda s, d: D.signal_summary(rows(s, d, f"SELECT complexity % 3 AS tier FROM ({SYMS}) z WHERE nesting > 2"), 4000).withColumn("ratio", F.round("ratio", 9)), f"SELECT count(*) AS signals, count(*) FILTER (complexity % 3 = 0) AS minor, count(*) FILTER (complexity % 3 = 1) AS important, count(*) FILTER (complexity % 3 = 2) AS critical, round(count(*) / 4000, 9) AS ratio FROM ({SYMS}) WHERE nesting > 2")
add("focal_suggestions", lambda s, d: D.focal(rows(s, d, FIND), s.createDataFrame([("src/Brand#2.py",), ("src/Brand#9.py",)], "path string"), 12).select("id", "confidence"), f"SELECT id, confidence FROM ({FIND}) WHERE line >= 1 AND file IN ('src/Brand#2.py', 'src/Brand#9.py') ORDER BY confidence DESC, file, line, id LIMIT 12")
add("test_symbols", lambda s, d: syms(s, d).groupBy(S.is_test_path(F.col("file")).alias("test"), S.language(F.col("file")).alias("lang")).agg(F.countDistinct("file").alias("files"), F.countDistinct("id").alias("symbols")), f"SELECT contains(file, '/tests/') AS test, 'Python' AS lang, count(DISTINCT file) AS files, count(DISTINCT id) AS symbols FROM ({SYMS}) GROUP BY 1, 2")
