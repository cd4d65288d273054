"""The graph built whole, files' roots, labels, guards, envelopes and number functions, each with an oracle written on its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as K
from ..functions import scalars as S
from ..operators import detectors as D
from ..operators import extend as X
from ..operators import profile as P
from ..operators import review as R
from ..streaming import channels as H
from .code import FOREST, IMPORTED, IMPORTS, HAVE, SYMS, TOPS, WANTED, syms
from .joins import add, rows
from .profile import S as EVENTS
from .profile import samples

REFS = f"SELECT *, ref % 300 AS line FROM ({WANTED}) w"
CTORS = f"SELECT id, CASE WHEN id % 7 = 0 THEN id + 5000000 END AS constructor FROM ({HAVE}) h"
RESOLVED = f"""r AS ({WANTED}), y AS ({HAVE}), {IMPORTED}, q AS (SELECT * FROM r WHERE ref NOT IN (SELECT ref FROM b)), w AS (SELECT ref, q.src, y.id AS dst, q.file = y.file AS own FROM q JOIN y ON q.name = y.name AND (q.file = y.file OR q.lang = y.lang)),
v AS (SELECT *, bool_or(own) OVER (PARTITION BY ref) AS a, count(*) OVER (PARTITION BY ref) AS n FROM w), e AS (SELECT ref, src, dst FROM b UNION ALL SELECT ref, src, dst FROM v WHERE own OR (NOT a AND n <= 8))"""


def built(s, d):
    return X.build(rows(s, d, REFS), rows(s, d, HAVE), rows(s, d, IMPORTS).distinct(), rows(s, d, CTORS))


add("graph_edges", lambda s, d: built(s, d)[0], f"WITH {RESOLVED} SELECT DISTINCT src, CASE WHEN dst % 7 = 0 THEN dst + 5000000 ELSE dst END AS dst FROM e")
add("graph_outside_calls", lambda s, d: built(s, d)[1], f"WITH {RESOLVED}, z AS ({REFS}) SELECT src, name, line, count(*) AS n FROM z WHERE ref NOT IN (SELECT ref FROM e) GROUP BY ALL")
# symbols that nothing calls, in a changed file of their own
ALONE = "SELECT concat('Q', p_partkey) AS id, CASE WHEN p_size % 2 = 0 THEN 'src/alone.py' ELSE 'src/unchanged.py' END AS file FROM part"
UP = f"WITH RECURSIVE f AS ({FOREST}), y AS (SELECT id, file FROM ({SYMS}) UNION ALL {ALONE}), o AS (SELECT id, file FROM y WHERE file LIKE '%/Brand#8.py' OR file = 'src/alone.py'), r(symbol, id) AS (SELECT id, id FROM o UNION SELECT symbol, src FROM r JOIN f ON dst = r.id), h AS (SELECT DISTINCT o.file AS path, r.id AS root FROM o JOIN r ON r.symbol = o.id WHERE r.id IN ({TOPS}))"


def affected(s, d):
    changed = s.createDataFrame([("Brand#8.py",), ("src/alone.py",)], "path string")
    return X.affected_by_files(changed, syms(s, d).select("id", "file").unionByName(rows(s, d, ALONE)), rows(s, d, FOREST), rows(s, d, TOPS))


add("roots_of_files", lambda s, d: affected(s, d)[0], f"{UP} SELECT path, root FROM h")
add("files_without_root", lambda s, d: affected(s, d)[1], f"{UP} SELECT DISTINCT file AS path FROM o WHERE file NOT IN (SELECT path FROM h)")
# frames of installed packages, of the runtime, of a path of one's own, and without a file
PLACES = """SELECT event_id, CASE event_id % 6 WHEN 0 THEN '/usr/lib/python3.11/site-packages/x.py' WHEN 1 THEN concat('/app/', event_type, '.py') WHEN 2 THEN '<frozen importlib._bootstrap>' WHEN 3 THEN '/app/gen/made.py' WHEN 4 THEN '/srv/node_modules/y.js' END AS file FROM events"""
add("frame_labels", lambda s, d: rows(s, d, PLACES).select("event_id", F.get(S.label_frames(F.array(F.struct(F.lit("f").alias("name"), "file", F.lit(False).alias("is_system"))), ("/gen/",)), F.lit(0))["is_system"].alias("system")), "SELECT event_id, event_id % 6 IN (0, 2, 3) AS system FROM events")
GUARDED = "SELECT p_partkey AS id, CASE p_size % 6 WHEN 0 THEN concat('../', p_name) WHEN 1 THEN concat('a/', p_name) WHEN 2 THEN '' WHEN 3 THEN '.hidden' ELSE p_name END AS scan, concat(CASE WHEN p_size % 2 = 0 THEN 'prof-' ELSE 'app-' END, p_partkey) AS thread FROM part"
add("name_guards", lambda s, d: rows(s, d, GUARDED).select("id", S.is_scan_id(F.col("scan")).alias("scan"), S.is_internal_thread(F.col("thread"), "prof-").alias("internal")), "SELECT p_partkey AS id, p_size % 6 > 3 AS scan, p_size % 2 = 0 AS internal FROM part")
SPOTS = "SELECT p_partkey AS id, p_partkey % 100 AS at, array(named_struct('s', 10, 'e', 20), named_struct('s', p_size, 'e', p_size + 30)) AS loops, CASE p_size % 3 WHEN 0 THEN array('log', 'io') WHEN 1 THEN array('queue', 'db') ELSE array('none') END AS cats FROM part"
add("range_flags", lambda s, d: rows(s, d, SPOTS).select("id", S.in_ranges(F.col("at"), F.col("loops")).alias("in_loop"), S.self_category(F.col("cats")).alias("category"), S.wire_type(F.lit("wall")).alias("wire")), "SELECT p_partkey AS id, p_partkey % 100 BETWEEN 10 AND 20 OR p_partkey % 100 BETWEEN p_size AND p_size + 30 AS in_loop, CASE p_size % 3 WHEN 0 THEN 'io' WHEN 1 THEN 'db' END AS category, 'wall_trace' AS wire FROM part")
add("number_functions", lambda s, d: rows(s, d, "SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 0 THEN double('NaN') ELSE p_retailprice END AS x, p_size FROM part").select("id", F.round(S.clamp01(F.col("x") / 2000), 9).alias("clamped"), F.round(S.log_share(F.col("p_size").cast("double"), 30), 9).alias("share"), F.round(S.smoothstep(F.col("p_size").cast("double"), 10, 40), 9).alias("step"), S.band(F.col("p_size") / 50, False).alias("band"), S.tokens_of_lines(F.col("p_size")).alias("tokens")), "SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 0 THEN 0.0 ELSE round(least(p_retailprice / 2000, 1), 9) END::DOUBLE AS clamped, round(least(1, ln(1 + p_size) / ln(31)), 9) AS share, (SELECT round(t * t * (3 - 2 * t), 9) FROM (SELECT greatest(0, least(1, (p_size - 10) / 30)) AS t)) AS step, CASE WHEN 1 - p_size / 50 >= 0.66 THEN 'green' WHEN 1 - p_size / 50 >= 0.33 THEN 'amber' ELSE 'red' END AS band, (p_size * 13)::BIGINT AS tokens FROM part")
SQLS = "SELECT p_partkey AS id, concat('  select ', CASE WHEN p_size % 2 = 0 THEN '  ' ELSE '' END, p_type, chr(10), 'from t ') AS sql FROM part"
add("statement_identities", lambda s, d: rows(s, d, SQLS).groupBy(S.fingerprint(F.col("sql")).alias("print")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).select("n", "first"), "SELECT count(*) AS n, min(p_partkey) AS first FROM part GROUP BY p_type")
add("json_fields", lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", F.get_json_object("props", "$.k").alias("k")), "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
MESSAGES = """SELECT concat('c', user_id % 9) AS client, event_id AS seq, CASE event_id % 6 WHEN 0 THEN concat('["1","2","', event_type, '","phx_join",{}]') WHEN 1 THEN concat('["1","2","', event_type, '","say",{"a":', event_id, '}]') WHEN 2 THEN '[null,"3","phoenix","heartbeat",{}]' WHEN 3 THEN concat('["1","2","', event_type, '","phx_leave",{}]') WHEN 4 THEN 'no' ELSE '["1","2","","x",{}]' END AS raw FROM events"""
add("channel_verbs", lambda s, d: H.envelopes(rows(s, d, MESSAGES)).groupBy("verb", "ok").agg(F.count(F.lit(1)).alias("n")), "SELECT CASE event_id % 6 WHEN 0 THEN 'join' WHEN 2 THEN 'heartbeat' WHEN 3 THEN 'leave' ELSE 'broadcast' END AS verb, event_id % 6 < 4 AS ok, count(*) AS n FROM events GROUP BY 1, 2")
add("channel_broadcasts", lambda s, d: H.broadcasts(H.envelopes(rows(s, d, MESSAGES)), "click", "say").select("client", "seq", "payload"), "SELECT concat('c', user_id % 9) AS client, event_id AS seq, '{\"a\":' || event_id || '}' AS payload FROM events WHERE event_id % 6 = 1 AND event_type = 'click'")
add("children_in_order", lambda s, d: P.call_tree(samples(s, d)).filter("depth = 2").orderBy(F.desc("value_us"), "path").limit(3).select("path", "value_us"), EVENTS + " SELECT 'main;' || names[3] AS path, sum(w)::BIGINT AS value_us FROM s GROUP BY 1 ORDER BY value_us DESC, path LIMIT 3")
SUGGESTED = f"SELECT id, file, line, concat('k', nesting % 2) AS kind, CASE complexity % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity, loc / 170.0D AS confidence FROM ({SYMS}) z"
add("suggestions_in_order", lambda s, d: D.ordered(D.first_of(rows(s, d, SUGGESTED), ["file", "line", "kind"], [-D.rank_of("severity", D.SEVERITIES), F.desc("confidence"), "id"]), F.desc("confidence"), "id").limit(50).select("id", "severity"), f"WITH g AS ({SUGGESTED.replace('170.0D', '170.0::DOUBLE')}), q AS (SELECT *, CASE severity WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END AS s FROM g), r AS (SELECT *, row_number() OVER (PARTITION BY file, line, kind ORDER BY s DESC, confidence DESC, id) AS r FROM q) SELECT id, severity FROM r WHERE r = 1 ORDER BY s DESC, confidence DESC, id LIMIT 50")
# reports whose source root stands early, late in the prefix, beyond it, is no string, has escapes, or is not there
HEADS = """SELECT event_id, concat('{"tool":"t","pad":"', CASE event_id % 6 WHEN 1 THEN repeat('x', 8000) WHEN 2 THEN repeat('y', 8200) ELSE '' END, '",', CASE event_id % 6 WHEN 3 THEN '"source_root": 5' WHEN 4 THEN '"source_root" : "a/' || chr(92) || '"b' || chr(92) || chr(92) || 'c"' WHEN 5 THEN '"root":"z"' ELSE '"source_root":"/src/' || event_type || '"' END, '}') AS text FROM events"""
add("source_roots", lambda s, d: rows(s, d, HEADS).select("event_id", F.coalesce(S.prefix_field(F.col("text"), "source_root"), F.lit("none")).alias("root")), "SELECT event_id, CASE event_id % 6 WHEN 2 THEN 'none' WHEN 3 THEN 'none' WHEN 4 THEN 'a/\"b' || chr(92) || 'c' WHEN 5 THEN 'none' ELSE '/src/' || event_type END AS root FROM events")
# files of four languages with a line that names a library, a longer word, or nothing
NAMED = """SELECT concat('f', p_partkey, CASE p_partkey % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.TSX' WHEN 2 THEN '.rs' WHEN 3 THEN '.sc' ELSE '.txt' END) AS path, CASE p_size % 5 WHEN 0 THEN 'import zod from pydantic; use serde_json' WHEN 1 THEN 'pydanticx io-ts.type playjson' WHEN 2 THEN 'validator cats.data.Validated play-json' WHEN 3 THEN 'cats_data_Validated' END AS line, p_name FROM part"""
add("schema_libraries", lambda s, d: K.schema_libraries(rows(s, d, NAMED).select("path", F.array("line", "p_name").alias("texts"))), f"""WITH n AS ({NAMED}), x(ending, language, word, library) AS (VALUES ('.py', 'python', 'pydantic;', 'pydantic'), ('.TSX', 'typescript', ' zod ', 'zod'), ('.TSX', 'typescript', ' io-ts.', 'io-ts'), ('.rs', 'rust', 'use serde_json', 'serde_json'), ('.rs', 'rust', 'validator ', 'validator'), ('.sc', 'scala', ' playjson', 'play-json'), ('.sc', 'scala', ' play-json', 'play-json'), ('.sc', 'scala', 'cats.data.Validated', 'cats.data.Validated'))
SELECT path, language, library FROM n JOIN x ON ends_with(path, ending) AND contains(line, word)""")
LISTED = "SELECT p_partkey, CASE WHEN p_partkey % 9 > 0 THEN lower(p_type) END AS kind, CASE WHEN p_partkey % 8 > 0 THEN p_retailprice END AS price FROM part"
add("sorted_by_text", lambda s, d: R.user_sorted(rows(s, d, LISTED), "kind", True, "p_partkey").select("place", "p_partkey"), f"SELECT row_number() OVER (ORDER BY coalesce(kind, '') DESC, p_partkey) - 1 AS place, p_partkey FROM ({LISTED})")
add("sorted_by_number", lambda s, d: R.user_sorted(rows(s, d, LISTED), "price", False, "p_partkey").select("place", "p_partkey"), f"SELECT row_number() OVER (ORDER BY price NULLS LAST, p_partkey) - 1 AS place, p_partkey FROM ({LISTED})")
