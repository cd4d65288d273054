"""Events by way of JSON lines, classification, source texts, stores and declarations, each with an oracle written on its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as K
from ..operators import profile as P
from ..sources import events as E
from ..sources import store as T
from ..sources import texts as X
from .joins import add, rows

#: A log line for each event: traces, bundles, calls, malformed lines and headers in turn.
LOG = """SELECT event_id AS seq, CASE event_id % 5
WHEN 0 THEN concat('{"type":"wall_trace","time":"', unix_micros(cast(ts as timestamp)) * 1000, '","service":"s', event_id % 3, '","period_ns":10000000,"count":', event_id % 3, ',"frames":[{"name":"', event_type, '"},{"name":"main"}]}')
WHEN 1 THEN concat(' {"type":"cpu_profile","time":"', unix_micros(cast(ts as timestamp)) * 1000, '","period_ns":10000000,"samples":[{"count":2,"frames":[{"name":"', event_type, '"}]},{"count":0,"frames":[{"name":"gone"}]},{"count":1,"frames":[{"name":"main"}]}]} ')
WHEN 2 THEN concat('{"type":"function_call","time":"', unix_micros(cast(ts as timestamp)) * 1000, '","duration_ns":', event_id * 1000 + 1, ',"qualname":"A.', event_type, '","status":"ok"}')
WHEN 3 THEN concat('{"type":"wall_trace","count":', event_id)
ELSE concat('{"type":"profile_metadata","service":"s', event_id, '"}') END AS raw FROM events"""


def logged(s, d):
    return E.stack_samples(E.parse(rows(s, d, LOG)))


BASE = """b AS (SELECT event_id AS seq, epoch_us(ts) AS us, event_type AS t FROM events), e AS (SELECT seq, 0 AS ord, t || ';main' AS stack, seq % 3 * 10000 AS weight_us, seq % 3 AS tick_count, us AS time_us FROM b WHERE seq % 5 = 0 AND seq % 3 > 0
UNION ALL SELECT seq, 0, t, 20000, 2, us FROM b WHERE seq % 5 = 1 UNION ALL SELECT seq, 2, 'main', 10000, 1, us FROM b WHERE seq % 5 = 1 UNION ALL SELECT seq, 0, t, seq, 1, us FROM b WHERE seq % 5 = 2 AND seq > 0)"""
add("log_samples", lambda s, d: logged(s, d).select("seq", "ord", F.array_join(F.transform("frames", lambda f: f["name"]), ";").alias("stack"), "weight_us", "tick_count", "time_us"), f"WITH {BASE} SELECT seq, ord::INT AS ord, stack, weight_us::BIGINT AS weight_us, tick_count::BIGINT AS tick_count, time_us FROM e")
add("log_rollup", lambda s, d: P.function_rollup(logged(s, d)).select("name", "cumulative_us", "self_us", "ncalls"), f"WITH {BASE}, r AS (SELECT weight_us AS w, tick_count AS k, unnest(list_distinct(string_split(stack, ';'))) AS name, string_split(stack, ';')[1] AS leaf FROM e) SELECT name, sum(w)::BIGINT AS cumulative_us, coalesce(sum(w) FILTER (name = leaf), 0)::BIGINT AS self_us, coalesce(sum(k) FILTER (name = leaf), 0)::BIGINT AS ncalls FROM r GROUP BY name")
add("log_header", lambda s, d: X.metadata_header(rows(s, d, LOG)), """SELECT event_id AS seq, '{"type":"profile_metadata","service":"s' || event_id || '"}' AS raw FROM events WHERE event_id % 5 = 4 ORDER BY event_id LIMIT 1""")
add("log_accepted", lambda s, d: X.accepted(rows(s, d, LOG)).agg(F.count(F.lit(1)).alias("n")), "SELECT count(*) FILTER (event_id % 5 <> 3) AS n FROM events")
FOLDED = "SELECT concat(event_type, ';main ', CASE WHEN event_id % 7 = 0 THEN 'x' ELSE cast(event_id % 4 AS string) END) AS raw FROM events"
add("folded_stacks", lambda s, d: E.folded(rows(s, d, FOLDED)).groupBy("stack").agg(F.sum("n").alias("n")), "SELECT event_type || ';main' AS stack, sum(event_id % 4)::BIGINT AS n FROM events WHERE event_id % 7 > 0 GROUP BY 1")
CHANGES = "SELECT concat(CASE p_size % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'M' WHEN 2 THEN 'D' ELSE 'R090' END, chr(9), 'src/', p_partkey, CASE WHEN p_size % 4 = 3 THEN concat(chr(9), 'new/', p_partkey) ELSE '' END) AS raw FROM part"
add("change_list", lambda s, d: X.name_status(rows(s, d, CHANGES)), "SELECT CASE WHEN p_size % 4 = 3 THEN 'new/' || p_partkey ELSE 'src/' || p_partkey END AS path, CASE p_size % 4 WHEN 0 THEN 'added' WHEN 1 THEN 'modified' WHEN 2 THEN 'removed' ELSE 'renamed' END AS status, CASE WHEN p_size % 4 = 3 THEN 'src/' || p_partkey END AS old_path FROM part")

# ---- what calls and texts are about
CALLS = "SELECT p_partkey AS call, concat('f', p_partkey % 40) AS file, CASE p_size % 4 WHEN 0 THEN 'executemany' ELSE 'go' END AS name, CASE p_partkey % 5 WHEN 0 THEN 'orm' WHEN 1 THEN 'Cache' WHEN 2 THEN 'django' ELSE 'x' END AS receiver FROM part"
IMPORTS = "SELECT DISTINCT concat('f', p_partkey % 40) AS file, CASE p_partkey % 3 WHEN 0 THEN 'orm' WHEN 1 THEN 'm' ELSE 'httpx' END AS local, CASE p_partkey % 3 WHEN 0 THEN 'django.db.models' WHEN 1 THEN 'django.dbx' ELSE 'httpx' END AS module FROM part WHERE p_partkey % 40 < 20"


def classified(s, d):
    catalog = s.createDataFrame([("django", "network"), ("django.db", "db"), ("httpx", "network")], "prefix string, category string")
    receivers = s.createDataFrame([("cache", "cache"), ("orm", "io")], "pattern string, category string")
    methods = s.createDataFrame([("executemany", "db")], "method string, category string")
    return K.external_calls(rows(s, d, CALLS), rows(s, d, IMPORTS), catalog, receivers, methods)


add("external_calls", classified, f"""WITH c AS ({CALLS}), i AS ({IMPORTS}), n AS (SELECT file, local, CASE module WHEN 'django.db.models' THEN 'db' ELSE 'network' END AS category, string_split(module, '.')[1] AS first FROM i),
k AS (SELECT file, receiver, min(category) AS category FROM (SELECT file, local AS receiver, category FROM n UNION ALL SELECT file, first, category FROM n) GROUP BY ALL),
z AS (SELECT c.call, coalesce(k.category, CASE receiver WHEN 'Cache' THEN 'cache' WHEN 'orm' THEN 'io' END, CASE WHEN name = 'executemany' THEN 'db' END) AS category, CASE WHEN k.category IS NOT NULL THEN 'imported_module' WHEN receiver IN ('Cache', 'orm') THEN 'receiver_pattern' ELSE 'method_signature' END AS tier FROM c LEFT JOIN k USING (file, receiver)) SELECT * FROM z WHERE category IS NOT NULL""")
SAID = "SELECT p_partkey AS id, concat(p_name, CASE p_partkey % 7 WHEN 0 THEN ' Retry queue' WHEN 1 THEN ' rate-limit' WHEN 2 THEN ' memoized SPAN' WHEN 3 THEN ' spanner' WHEN 4 THEN ' Sanitize' ELSE '' END) AS text FROM part"
add("text_families", lambda s, d: rows(s, d, SAID).select("id", F.array_join(K.families(F.col("text")), ",").alias("families")), "SELECT p_partkey AS id, CASE p_partkey % 7 WHEN 0 THEN 'reliability,scalability' WHEN 1 THEN 'scalability' WHEN 2 THEN 'performance,observability' WHEN 4 THEN 'security,input_safety' ELSE '' END AS families FROM part")
CODE = """SELECT concat('f', p_partkey, CASE WHEN p_size % 2 = 0 THEN '.py' ELSE '.ts' END) AS path, concat(CASE WHEN p_size % 2 = 0 THEN '# TODO head' ELSE concat('/* open 9', chr(10), 'still 8 // x */') END, chr(10), 'x = ', p_size + 200, CASE WHEN p_size % 2 = 0 THEN ' # 77' ELSE ' // 77' END, chr(10), chr(10), 'LIMIT = 55', chr(10), 'y = "# 33 // 44" + 1') AS text FROM part"""
add("source_stats", lambda s, d: K.source_stats(rows(s, d, CODE)), "SELECT concat('f', p_partkey, CASE WHEN p_size % 2 = 0 THEN '.py' ELSE '.ts' END) AS path, 3 AS code_lines, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 2 END AS comment_lines, 1 AS blank_lines, 1 AS magic, 3 AS numbers, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS todos FROM part")
SPOTS = "SELECT concat('/r/src/', p_brand, '.py') AS file, CASE WHEN p_size % 3 > 0 THEN p_type END AS category FROM part"
add("dominant_category", lambda s, d: K.dominant_category(s.createDataFrame([("src/Brand#3.py",), ("Brand#9.py",)], "path string"), rows(s, d, SPOTS)), f"SELECT category, count(*) AS n FROM ({SPOTS}) WHERE (file LIKE '%/Brand#3.py' OR file LIKE '%/Brand#9.py') AND category IS NOT NULL GROUP BY 1 ORDER BY n DESC, category LIMIT 1")
CHAINS = "SELECT p_partkey AS chain, 'Order' AS model, array('customer', 'nation', CASE WHEN p_size % 2 = 0 THEN 'region' ELSE 'name' END) AS path FROM part"
FETCHED = "SELECT p_partkey AS chain, 'customer' AS field FROM part WHERE p_partkey % 3 > 0 UNION ALL SELECT p_partkey, 'nation' FROM part WHERE p_partkey % 4 > 0"


def unsafe(s, d):
    fields = s.createDataFrame([("Order", "customer", "Customer"), ("Customer", "nation", "Nation"), ("Nation", "region", "Region"), ("Nation", "name", None)], "model string, field string, target string")
    return K.unsafe_step(rows(s, d, CHAINS), fields, rows(s, d, FETCHED))


add("unsafe_chains", unsafe, "SELECT * FROM (SELECT p_partkey AS chain, CASE WHEN p_partkey % 3 = 0 THEN 0 WHEN p_partkey % 4 = 0 THEN 1 WHEN p_size % 2 = 0 THEN 2 END AS pos, CASE WHEN p_partkey % 3 = 0 THEN 'customer' WHEN p_partkey % 4 = 0 THEN 'nation' WHEN p_size % 2 = 0 THEN 'region' END AS field FROM part) WHERE pos IS NOT NULL")

# ---- stores and declarations
VERSIONS = "SELECT p_brand AS scan, p_partkey AS id FROM part WHERE p_size % 2 = {}"
add("suggestion_versions", lambda s, d: T.next_version(T.next_version(None, rows(s, d, VERSIONS.format(0)), "scan", ["id"]), rows(s, d, VERSIONS.format(1)), "scan", ["id"]), "WITH a AS (SELECT p_brand AS scan, count(*) AS n FROM part WHERE p_size % 2 = 0 GROUP BY 1) SELECT p_brand AS scan, p_partkey AS id, (coalesce((SELECT n FROM a WHERE a.scan = p_brand), 0) + row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey))::INT AS version FROM part WHERE p_size % 2 = 1")
CHATS = "SELECT conv_id AS id, turn AS updated_at, concat('t', turn) AS title, transform(sequence(1, cast(turn + 1 AS int)), i -> 'm') AS messages, turn = 3 AS deleted FROM conversations"
add("conversation_store", lambda s, d: T.conversation_list(T.latest(rows(s, d, CHATS), "id", "updated_at")), "WITH l AS (SELECT conv_id AS id, max(turn) AS t FROM conversations GROUP BY 1) SELECT id, 't' || t AS title, (t + 1)::INT AS message_count, t AS updated_at FROM l WHERE t <> 3")
add("compact_round_trip", lambda s, d: (lambda c: T.decode(c[0], c[1], ["p_name", "p_type"]))(T.encode(rows(s, d, "SELECT p_partkey, p_name, p_type FROM part"), ["p_name", "p_type"])), "SELECT p_partkey, p_name, p_type FROM part")
add("string_dictionary", lambda s, d: T.dictionary(rows(s, d, "SELECT p_type AS v FROM part"), "v"), "SELECT p_type AS value, row_number() OVER (ORDER BY p_type) AS code FROM (SELECT DISTINCT p_type FROM part) UNION ALL SELECT '', 0")
add("flat_nodes", lambda s, d: T.flat_nodes(rows(s, d, "SELECT l_partkey AS id, l_orderkey * 10 + l_linenumber AS seq, l_suppkey AS tree FROM lineitem")).groupBy("id").agg(F.min("seq").alias("seq"), F.count(F.lit(1)).alias("n")), "SELECT l_partkey AS id, min(l_orderkey * 10 + l_linenumber) AS seq, 1::BIGINT AS n FROM lineitem GROUP BY 1")
SPANS = "SELECT l_orderkey * 10 + l_linenumber AS id, concat('src/', l_returnflag, l_linestatus, '.py') AS file, l_partkey AS line FROM lineitem"
add("symbol_spans", lambda s, d: T.symbol_spans(rows(s, d, SPANS), s.createDataFrame([("AF.py",), ("src/NO.py",)], "path string")).groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.max("line").alias("last")), f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line, id) AS r FROM ({SPANS}) WHERE file IN ('src/AF.py', 'src/NO.py')) SELECT file, count(*) AS n, max(line) AS last FROM r WHERE r <= 120 GROUP BY 1")
add("profile_bundles", lambda s, d: T.profile_bundles(rows(s, d, "SELECT unix_micros(cast(ts as timestamp)) AS time_us, event_type AS stack, event_id % 5 AS n FROM events"), 3_600_000_000, 10_000_000), "SELECT epoch_us(ts) // 3600000000 * 3600000000 AS start_us, event_type AS stack, sum(event_id % 5)::BIGINT AS count, sum(event_id % 5)::BIGINT * 10000000 AS value_ns FROM events GROUP BY 1, 2")
TREE = "SELECT concat(CASE p_partkey % 6 WHEN 0 THEN 'node_modules/x/' WHEN 1 THEN 'gen/' WHEN 2 THEN 'a/gen/' ELSE 'src/' END, 'f', p_partkey, CASE p_size % 6 WHEN 0 THEN '.py' WHEN 1 THEN '.min.js' WHEN 2 THEN '.png' WHEN 3 THEN '.SQL' WHEN 4 THEN '.tmp' ELSE '.go' END) AS path, CAST(p_size AS BIGINT) AS size FROM part"
add("source_walk", lambda s, d: T.source_files(rows(s, d, TREE), ["# note", "/gen/", "*.tmp"]), f"SELECT path, size, CASE p % 6 WHEN 0 THEN 'Python' WHEN 3 THEN 'SQL' ELSE 'Go' END AS lang FROM (SELECT path, size, size AS p FROM ({TREE})) WHERE path NOT LIKE 'node_modules/%' AND path NOT LIKE 'gen/%' AND p % 6 IN (0, 3, 5)")
add("sql_files", lambda s, d: T.sql_files(rows(s, d, TREE)).select("path"), f"SELECT path FROM ({TREE}) WHERE path LIKE '%.SQL' AND path NOT LIKE 'node_modules/%'")
FILES = """SELECT concat('svc', p_partkey, CASE p_partkey % 4 WHEN 0 THEN '/Dockerfile' WHEN 1 THEN '/package.json' WHEN 2 THEN '/pyproject.toml' ELSE '/compose.yml' END) AS path, CASE p_partkey % 4
WHEN 0 THEN concat('FROM x', chr(10), 'CMD ["old"]', chr(10), 'CMD ["python", "app', p_size, '.py"]') WHEN 1 THEN concat('{"main":"index.js","scripts":{"start":"node s', p_size, '.js"}}')
WHEN 2 THEN concat('[project.scripts]', chr(10), 'cli = "pkg.m', p_size, ':go"', chr(10), '[tool]', chr(10), 'a = "b"') ELSE concat('services:', chr(10), '  web:', chr(10), '    command: "python -m pkg.m', p_size, '"') END AS text FROM part"""
add("entry_declarations", lambda s, d: T.entry_declarations(rows(s, d, FILES)).select("path", "kind", "name", F.array_join("argv", " ").alias("argv")), f"""WITH f AS (SELECT p_partkey AS k, p_size AS z, path FROM part JOIN ({FILES}) f ON f.path LIKE 'svc' || p_partkey || '/%') SELECT path, 'cmd' AS kind, '' AS name, 'python app' || z || '.py' AS argv FROM f WHERE k % 4 = 0 UNION ALL SELECT path, 'main', '', 'index.js' FROM f WHERE k % 4 = 1 UNION ALL SELECT path, 'script', 'start', 'node s' || z || '.js' FROM f WHERE k % 4 = 1
UNION ALL SELECT path, 'script', 'cli', 'pkg.m' || z || ':go' FROM f WHERE k % 4 = 2 UNION ALL SELECT path, 'command', '', 'python -m pkg.m' || z FROM f WHERE k % 4 = 3""")
HAVE = "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'main' WHEN 1 THEN 'go' ELSE 'other' END AS name, concat('r/pkg/m', p_size, '.py') AS file, p_partkey AS line, CAST(p_size AS BIGINT) AS loc FROM part"
add("entry_matches", lambda s, d: T.match_entries(T.entry_declarations(rows(s, d, FILES)).select(F.concat_ws("#", "path", "kind", "name").alias("entry"), "argv"), rows(s, d, HAVE)).select("entry", "id", "how"), f"""WITH y AS ({HAVE}), e AS (SELECT p_partkey AS k, p_size AS z FROM part WHERE p_partkey % 4 IN (2, 3)), m AS (SELECT k, z, y.id, row_number() OVER (PARTITION BY k ORDER BY CASE WHEN k % 4 = 2 AND name <> 'go' THEN 1 ELSE 0 END, CASE WHEN name = 'main' THEN 1 ELSE 9 END, line, id) AS r FROM e JOIN y ON y.file = 'r/pkg/m' || z || '.py')
SELECT 'svc' || k || CASE WHEN k % 4 = 2 THEN '/pyproject.toml#script#cli' ELSE '/compose.yml#command#' END AS entry, id, CASE WHEN k % 4 = 2 THEN 3 ELSE 2 END AS how FROM m WHERE r = 1""")
DECLARED = "SELECT p_partkey AS id, p_name AS raw, p_brand AS service, concat(p_type, '.py') AS file, p_name AS symbol, CASE WHEN p_size % 2 = 0 THEN 'cmd' ELSE 'script' END AS kind, p_size AS line FROM part"
add("declaration_search", lambda s, d: T.declaration_search(rows(s, d, DECLARED), "Ring").select("id", "kind"), f"SELECT id, kind FROM ({DECLARED}) WHERE contains(lower(raw), 'ring') OR contains(lower(service), 'ring') OR contains(lower(file), 'ring') OR contains(lower(kind), 'ring')")
