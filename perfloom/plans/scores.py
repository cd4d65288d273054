"""Values and qualities of change sets, and scalar functions, over rows of `orders`, `part` and `documents`; each oracle is written on its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import scores as V
from .joins import add, rows

#: A change set for each customer: measures that both engines read alike.
CHANGES = """SELECT o_custkey AS pr, CAST(count(*) AS DOUBLE) AS files, CAST(sum(floor(o_totalprice / 2000)) AS DOUBLE) AS added, CAST(sum(floor(o_totalprice / 3000)) * (o_custkey % 4) AS DOUBLE) AS deleted,
CAST(count(CASE WHEN o_orderpriority LIKE '1%' THEN 1 END) AS DOUBLE) AS critical, CAST(count(CASE WHEN o_orderpriority LIKE '2%' THEN 1 END) AS DOUBLE) AS important, CAST(count(CASE WHEN o_orderpriority LIKE '3%' THEN 1 END) AS DOUBLE) AS minor,
CAST(count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS DOUBLE) AS fix_commits, CAST(count(CASE WHEN o_orderstatus = 'P' THEN 1 END) % 3 AS DOUBLE) AS perf_commits, CAST(count(CASE WHEN o_orderstatus = 'O' THEN 1 END) % 4 AS DOUBLE) AS docs_commits,
CAST(o_custkey % 5 AS DOUBLE) AS new_tests, CAST(o_custkey % 41 AS DOUBLE) AS roots, CAST(o_custkey % 7 AS DOUBLE) AS uncovered_roots, CAST(o_custkey % 9 AS DOUBLE) AS debt_sites, CAST(o_custkey % 3 AS DOUBLE) AS regressed_axes, CAST(o_custkey % 6 AS DOUBLE) AS risks,
CAST(o_custkey % 2 AS DOUBLE) AS breaking_commits, o_custkey % 3 = 0 AS touches_db, CAST(min(floor(o_totalprice)) % 20 AS DOUBLE) AS functions, CAST(max(floor(o_totalprice)) % 90 AS DOUBLE) AS callees, CAST(o_custkey % 13 AS DOUBLE) AS complexity, CAST(o_custkey % 11 AS DOUBLE) AS todos FROM orders GROUP BY o_custkey"""
PR = f"p AS (SELECT *, critical AS bad_critical, important AS bad_important, minor AS bad_minor, critical + important + minor AS findings, CASE WHEN pr % 8 > 0 THEN critical ELSE 0 END AS correctness_findings, CASE WHEN pr % 17 = 0 THEN 1.0 ELSE 0.0 END AS destructive, CASE WHEN pr % 5 = 0 THEN 1.0 ELSE 0.0 END AS blocking, (pr % 10) / 10.0 AS share FROM ({CHANGES}) z)"


def changes(s, d):
    p = rows(s, d, CHANGES)
    n = F.col("pr")
    return p.withColumns({"bad_critical": F.col("critical"), "bad_important": F.col("important"), "bad_minor": F.col("minor"), "findings": F.col("critical") + F.col("important") + F.col("minor"), "correctness_findings": F.when(n % 8 > 0, F.col("critical")).otherwise(0.0), "destructive": F.when(n % 17 == 0, 1.0).otherwise(0.0), "blocking": F.when(n % 5 == 0, 1.0).otherwise(0.0), "share": (n % 10) / 10})


def c01(x: str) -> str:
    return f"greatest(0.0, least(1.0, {x}))"


def sat(x: str, full: float) -> str:
    return c01(f"ln(1 + greatest({x}, 0)) / ln(1 + {full})")


def smooth(x: str, low: float, high: float) -> str:
    t = c01(f"(({x}) - {low}) / {high - low}")
    return f"({t} * {t} * (3 - 2 * {t}))"


def r6(name: str):
    return F.round(name, 6).alias(name)


add("value_runtime", lambda s, d: changes(s, d).select("pr", V.value_runtime().alias("delta")), f"WITH {PR} SELECT pr, greatest(-60, least(60, CASE WHEN perf_commits > 0 THEN least(15 * perf_commits, 60) WHEN deleted > floor(added * 1.5) AND deleted > 50 THEN 5 WHEN added > 1000 THEN -3 ELSE 0 END - least(12 * critical + 6 * important + 2 * minor, 60)))::DOUBLE AS delta FROM p")
add("value_money", lambda s, d: changes(s, d).select("pr", V.value_money().alias("m")).select("pr", *[F.round(f"m.{c}", 7).alias(c) for c in ("cost", "savings", "delta")]), f"""WITH {PR}, c AS (SELECT pr, (8 * critical + 3 * important + 0.5 * minor + 0.25 * findings + 0.002 * added) * 75 + 4 * 20000 * (1 + (files - 1) * 0.3) * least(1 + 0.4 * least(findings, 5), 3) * 3 / 1e6 + CASE WHEN touches_db THEN 0.096 * 730 ELSE 0 END AS cost,
fix_commits * 225 + greatest(deleted - added, 0) * 0.15 + CASE WHEN perf_commits > 0 AND critical = 0 THEN 0.096 * 730 * 12 ELSE 0 END AS savings FROM p) SELECT pr, round(cost, 7)::DOUBLE AS cost, round(savings, 7)::DOUBLE AS savings, round((savings - cost) / 12000 * 100, 7)::DOUBLE AS delta FROM c""")
add("value_ux", lambda s, d: changes(s, d).select("pr", V.value_ux().alias("u")).select("pr", "u.*"), f"WITH {PR} SELECT pr, least(5 * new_tests + 3 * fix_commits + 4 * docs_commits, 60)::DOUBLE AS delta, CASE WHEN new_tests >= 3 THEN 'medium' ELSE 'low' END AS confidence FROM p")
add("review_effort", lambda s, d: changes(s, d).select("pr", V.review_effort().alias("effort")), f"""WITH {PR}, e AS (SELECT pr, CASE WHEN files > 40 THEN 2 WHEN files > 15 THEN 1.5 WHEN files > 6 THEN 1 ELSE 0.5 END + CASE WHEN added > 1000 THEN 2 WHEN added > 400 THEN 1.5 WHEN added > 150 THEN 1 WHEN added > 0 THEN 0.5 ELSE 0 END + CASE WHEN roots > 30 THEN 1 WHEN roots > 12 THEN 0.5 ELSE 0 END
+ least(1.5, debt_sites * 0.25) + least(2, correctness_findings * 0.9) + least(1, regressed_axes * 0.5) + least(1, risks * 0.2) + CASE WHEN new_tests = 0 AND added > 150 THEN 0.5 ELSE 0 END AS x FROM p) SELECT pr, CASE WHEN x >= 7 THEN 5 WHEN x >= 5 THEN 4 WHEN x >= 3 THEN 3 WHEN x >= 1.5 THEN 2 ELSE 1 END AS effort FROM e""")


def operational(s, d):
    p = changes(s, d).withColumns({"removed_files": F.col("todos"), "max_centrality": F.col("complexity"), "max_percent": F.col("share") * 100, "max_fan_in": F.col("callees"), "io_roots": F.col("roots"), "blind_roots": F.col("uncovered_roots")})
    return p.select("pr", F.round(V.operational_risk(), 6).alias("risk"))


add("operational_risk", operational, f"""WITH {PR}, q AS (SELECT pr, destructive, greatest(destructive * 1.0, blocking * 0.6, CASE WHEN todos > 0 THEN 0.4 ELSE 0 END, CASE WHEN touches_db AND destructive = 0 AND blocking = 0 THEN 0.3 ELSE 0 END) AS back,
{c01(f"0.4 * {c01('roots / 20')} + 0.25 * {sat('complexity', 50)} + 0.2 * share + 0.15 * {sat('callees', 50)}")} AS spread, CASE WHEN roots > 0 THEN {c01('uncovered_roots / roots')} ELSE 0 END AS blind FROM p), w AS (SELECT pr, destructive, {c01('0.45 * back + 0.35 * spread + 0.20 * blind')} AS x FROM q)
SELECT pr, round(CASE WHEN destructive > 0 THEN greatest(x, 0.8) ELSE x END, 6)::DOUBLE AS risk FROM w""")
add("correctness_score", lambda s, d: changes(s, d).withColumns({"repeatability": 1 - F.col("share") / 2, "edge": F.col("share")}).select("pr", F.round(V.correctness(), 6).alias("score")), f"""WITH {PR}, b AS (SELECT *, CASE WHEN roots > 0 THEN {c01('greatest(roots - uncovered_roots, 0) / roots')} ELSE 1 END * CASE WHEN new_tests > 0 THEN 1 ELSE 0.6 END AS base FROM p), k AS (SELECT pr, share, CASE WHEN added < 20 THEN greatest(base, 0.8) ELSE base END AS cov FROM b)
SELECT pr, round({c01('greatest(cov, 0.01) ** 0.45 * greatest(1 - share / 2, 0.01) ** 0.30 * greatest(share, 0.01) ** 0.25')}, 6)::DOUBLE AS score FROM k""")
NODES = "SELECT p_brand AS pr, p_partkey AS id, CAST(p_size AS DOUBLE) AS call_sites, CAST(p_partkey % 23 AS DOUBLE) AS callees, CASE WHEN p_brand = 'Brand#1' THEN 0.0 ELSE p_retailprice / 1000000 END AS pagerank, CAST(p_partkey % 300 AS DOUBLE) AS loc, 1.0 AS percent_total FROM part"
add("fragility", lambda s, d: V.weighted_fragility(rows(s, d, NODES.replace("1.0 AS percent_total", "CAST(1 AS DOUBLE) AS percent_total")), "pr", 2000).select("pr", r6("fragility"), r6("worst")), f"""WITH n AS ({NODES}), f AS (SELECT pr, pagerank AS w, {c01(f"0.35 * {sat('call_sites', 50)} + 0.30 * {sat('pagerank * 2000', 50)} + 0.20 * {sat('loc * (call_sites * callees) ** 2', 2.2e7)} + 0.15 * {sat('callees', 25)}")} AS f FROM n)
SELECT pr, round(CASE WHEN sum(w) > 1e-12 THEN sum(w * f) / sum(w) ELSE avg(f) END, 6)::DOUBLE AS fragility, round(max(f), 6)::DOUBLE AS worst FROM f GROUP BY pr""")
add("longevity_score", lambda s, d: changes(s, d).withColumns({"fragility": F.col("share"), "refactor_commits": F.col("docs_commits"), "code_lines": F.col("added"), "magic": F.col("complexity")}).select("pr", F.round(V.longevity(), 6).alias("score")), f"""WITH {PR}, x AS (SELECT pr, share, greatest(added, 1) AS code, {c01('((8 * critical + 3 * important + 0.5 * minor + 0.25 * findings + 0.002 * added) - ((fix_commits + docs_commits) * 3 + greatest(deleted - added, 0) * 0.002)) * 60 / (30 * greatest(added, 1))')} AS ratio, todos, complexity FROM p)
SELECT pr, round({c01(f"1 - (0.45 * share + 0.35 * ratio + 0.20 * (0.5 * {c01('todos / code / 0.15')} + 0.5 * {c01('complexity / code / 0.1')}))")}, 6)::DOUBLE AS score FROM x""")
add("comprehensibility_score", lambda s, d: changes(s, d).withColumns({"flow": F.col("share"), "comment_density": F.when(F.col("pr") % 6 > 0, F.col("share")), "naming": 1 - F.col("share"), "magic_ratio": F.col("share") / 8, "narrative": F.col("docs_commits") > 0, "context_cost": F.col("complexity") / 13}).select("pr", F.round(V.comprehensibility(), 6).alias("score")), f"""WITH {PR}, x AS (SELECT *, CASE WHEN pr % 6 = 0 THEN 0.5 WHEN share <= 0 THEN 0.3 WHEN share < 0.2 THEN 0.3 + 0.7 * share / 0.2 WHEN share <= 0.4 THEN 1 ELSE {c01('1 - (share - 0.4)')} END AS cs FROM p),
y AS (SELECT pr, complexity, {c01('0.45 * share + 0.30 * cs + 0.25 * (1 - share)')} AS ex, {c01(f"0.5 * {c01('1 - share / 8 / 0.1')} + 0.5 * CASE WHEN docs_commits > 0 THEN 1 ELSE 0.4 END - least({c01('todos / greatest(functions, 1)')}, 0.3)")} AS tr FROM x)
SELECT pr, round({c01('0.45 * ex + 0.30 * tr + 0.25 * (1 - complexity / 13)')}, 6)::DOUBLE AS score FROM y""")
add("team_process_score", lambda s, d: changes(s, d).select("pr", F.round(V.team_process(), 6).alias("score")), f"WITH {PR} SELECT pr, round(1 - greatest({smooth('added + deleted', 200, 400)}, {smooth('files', 10, 50)}), 6)::DOUBLE AS score FROM p")
add("reviewability_score", lambda s, d: changes(s, d).select("pr", F.round(V.reviewability(), 10).alias("score")), f"""WITH {PR} SELECT pr, round({c01(f"1 - (0.45 * {c01('(round((added + deleted) * 13) + 25000) / 300000')} + 0.25 * {c01('callees / 100')} + 0.20 * {smooth('files', 10, 50)} + 0.10 * {c01('files / greatest(functions, 1)')})")}, 10)::DOUBLE AS score FROM p""")
add("semantic_density", lambda s, d: changes(s, d).withColumn("categories", F.col("regressed_axes")).select("pr", V.density().alias("x")).select("pr", "x.*"), f"WITH {PR}, x AS (SELECT pr, round((added + deleted) * 13) / greatest(greatest(functions, 1) + complexity + findings + regressed_axes, 1) AS v FROM p) SELECT pr, (floor(v * 100 + 0.5) / 100)::DOUBLE AS value, CASE WHEN v < 200 THEN 'dense' WHEN v > 800 THEN 'boilerplate' ELSE 'normal' END AS band FROM x")


def quality_gauges(s, d):
    p = changes(s, d).select("pr", V.team_process().alias("team"), (F.col("share")).alias("fragility"), F.when(F.col("pr") % 2 == 0, F.col("share")).alias("coverage"))
    return V.gauges(p, "pr").withColumn("value", F.round("value", 6))


BAND = "CASE WHEN {x} >= 0.66 THEN 'green' WHEN {x} >= 0.33 THEN 'amber' ELSE 'red' END"
add("quality_gauges", quality_gauges, f"""WITH {PR}, t AS (SELECT pr, share::DOUBLE AS share, (1 - greatest({smooth('added + deleted', 200, 400)}, {smooth('files', 10, 50)}))::DOUBLE AS team FROM p)
SELECT pr, 'team_process' AS gauge, round(team, 6) AS value, 'higher' AS polarity, {BAND.format(x='team')} AS band FROM t UNION ALL SELECT pr, 'fragility', round(share, 6), 'lower', {BAND.format(x='(1 - share)')} FROM t UNION ALL SELECT pr, 'coverage', round(share, 6), 'higher', {BAND.format(x='share')} FROM t WHERE pr % 2 = 0""")
add("change_risks", lambda s, d: changes(s, d).select("pr", F.explode(V.risks()).alias("r")).select("pr", "r.*"), f"""WITH {PR}, r AS (SELECT pr, 'size' AS label, least(files / 100, 1) AS l, least(files / 200 + 0.3, 1) AS s FROM p UNION ALL SELECT pr, 'breaking', 0.85, 0.9 FROM p WHERE breaking_commits > 0 UNION ALL SELECT pr, 'blast_radius', least(0.4 + roots / 50, 1), least(0.5 + roots / 40, 1) FROM p WHERE roots >= 5 UNION ALL SELECT pr, 'untested', 0.6, 0.7 FROM p WHERE added >= 200 AND new_tests = 0)
SELECT pr, label, (floor(l * 100 + 0.5) / 100)::DOUBLE AS likelihood, (floor(s * 100 + 0.5) / 100)::DOUBLE AS severity, CASE WHEN s >= 0.5 AND l >= 0.5 THEN 'act_before_merge' WHEN s >= 0.5 THEN 'monitor_closely' WHEN l >= 0.5 THEN 'document_and_ship' ELSE 'acceptable' END AS quadrant FROM r""")

FRAMES = "SELECT p_partkey AS id, concat(p_name, CASE p_partkey % 9 WHEN 0 THEN '.Redis' WHEN 1 THEN '.httpx' WHEN 2 THEN '.rwlock' WHEN 3 THEN ' gc.' WHEN 4 THEN '.toJSON' WHEN 5 THEN '.fsync' WHEN 6 THEN '.encode' ELSE '.tick' END) AS frame, concat('/usr/lib/python3.', p_size % 3, '/', p_type, CASE WHEN p_size % 2 = 0 THEN '/site-packages/x.py' ELSE '.py' END) AS file, CAST(p_size AS DOUBLE) AS own, p_retailprice / 40 AS total FROM part"
add("frame_categories", lambda s, d: rows(s, d, FRAMES).select("id", S.frame_category(F.col("frame")).alias("category"), S.hotspot_severity(F.col("own"), F.col("total")).alias("severity"), S.is_system_frame(F.col("file")).alias("system")), f"""WITH f AS ({FRAMES}) SELECT id, CASE WHEN lower(frame) LIKE '%redis%' THEN 'database' WHEN lower(frame) LIKE '%httpx%' THEN 'network' WHEN lower(frame) LIKE '%lock%' THEN 'lock' WHEN lower(frame) LIKE '%gc.%' THEN 'gc' WHEN lower(frame) LIKE '%json%' THEN 'serde' WHEN lower(frame) LIKE '%fsync%' THEN 'filesystem' WHEN lower(frame) LIKE '%encode%' THEN 'cpu' ELSE 'unknown' END AS category,
CASE WHEN own >= 20 OR total >= 60 THEN 'critical' WHEN own >= 10 OR total >= 35 THEN 'high' WHEN own >= 3 OR total >= 15 THEN 'medium' ELSE 'low' END AS severity, contains(file, '/lib/python3.') OR contains(file, '/site-packages/') AS system FROM f""")
PATHS = "SELECT p_partkey AS id, concat('src/', CASE p_partkey % 6 WHEN 0 THEN 'tests/' WHEN 1 THEN 'contests/' WHEN 2 THEN 'lib/UserSpec' WHEN 3 THEN 'testUtil' WHEN 4 THEN 'mock_' ELSE '' END, replace(p_name, ' ', '_'), CASE p_size % 7 WHEN 0 THEN '.py' WHEN 1 THEN '.tsx' WHEN 2 THEN '.RS' WHEN 3 THEN '.md' WHEN 4 THEN '/Dockerfile' WHEN 5 THEN '.zzz' ELSE '' END) AS path FROM part"
TEST = r"(regexp_matches({x}, '^[Tt]est[A-Z]') OR regexp_matches({x}, '(^|[a-z0-9])(Tests?|Specs?|Mocks?)$') OR regexp_matches({x}, '(^|[^a-zA-Z0-9])(?i:tests?|specs?|mocks?|testdata)([^a-zA-Z0-9]|$)'))"
add("path_kinds", lambda s, d: rows(s, d, PATHS).select("id", S.language(F.col("path")).alias("lang"), S.language_kind(S.language(F.col("path"))).alias("kind"), S.is_test_path(F.col("path")).alias("test")), f"""WITH p AS ({PATHS}), q AS (SELECT id, path, string_split(path, '/') AS parts, lower(string_split(path, '/')[-1]) AS base FROM p), l AS (SELECT *, CASE WHEN base = 'dockerfile' THEN 'Dockerfile' WHEN base LIKE '%.py' THEN 'Python' WHEN base LIKE '%.tsx' THEN 'TypeScript' WHEN base LIKE '%.rs' THEN 'Rust' WHEN base LIKE '%.md' THEN 'Markdown' END AS lang FROM q)
SELECT id, lang, CASE WHEN lang = 'Markdown' THEN 'prose' WHEN lang IS NOT NULL THEN 'programming' END AS kind, len(list_filter(parts[:-2], lambda x: {TEST.format(x='x')})) > 0 OR {TEST.format(x="regexp_replace(parts[-1], '[.][^.]*$', '')")} AS test FROM l""")
LABELS = "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN '<module>' WHEN 1 THEN '<anonymous@3>' ELSE p_name END AS name, CASE p_size % 3 WHEN 0 THEN p_brand WHEN 1 THEN '<module>' ELSE '' END AS parent, concat('/app/', p_type, '.ts') AS file, p_size AS line FROM part"
add("symbol_labels", lambda s, d: rows(s, d, LABELS).select("id", S.symbol_label(*map(F.col, ("name", "parent", "file", "line"))).alias("label"), S.relative_to(F.col("file"), "/app").alias("file"), S.folder_fingerprint(F.col("file")).alias("print"), S.duration_text(F.col("id") * 1024).alias("took"), S.truncated(F.col("name"), 9).alias("short")), f"""WITH n AS ({LABELS}), q AS (SELECT *, CASE WHEN parent <> '' AND parent <> '<module>' THEN parent END AS named, substr(file, 6) AS base FROM n)
SELECT id, CASE WHEN name = '<module>' THEN base WHEN name LIKE '<anon%' THEN coalesce(named || ' · ', '') || 'anon <' || base || ':' || line || '>' ELSE coalesce(named || '.', '') || name END AS label, base AS file, left(sha256(file), 16) AS print,
CASE WHEN id * 1024 < 1000 THEN (id * 1024) || ' µs' WHEN id * 1024 < 1000000 THEN printf('%.2f', id * 1024 / 1000.0) || ' ms' ELSE printf('%.2f', id * 1024 / 1e6) || ' s' END AS took, CASE WHEN strlen(name) > 9 THEN left(name, 9) || '…' ELSE name END AS short FROM q""")
add("token_estimates", lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", S.token_footprint(F.octet_length("text"), S.word_tokens(F.col("text"))).alias("f"), S.context_pressure(F.octet_length("text")).alias("c")).select("doc_id", "f.*", F.col("c.band").alias("band"), F.round("c.load", 9).alias("load")), r"""WITH t AS (SELECT doc_id, octet_length(encode(text)) AS b, len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS w FROM documents), e AS (SELECT doc_id, b, CASE WHEN b IS NULL THEN NULL ELSE floor((ceil(b / 2.8::DOUBLE) + floor(w * 2.1::DOUBLE + 0.5)) / 2 + 0.5) END AS x FROM t)
SELECT doc_id, x::BIGINT AS estimate, floor(x * 0.8::DOUBLE)::BIGINT AS lo, ceil(x * 1.2::DOUBLE)::BIGINT AS hi, CASE WHEN b < 45000 THEN 'green' WHEN b < 110000 THEN 'yellow' ELSE 'red' END AS band, round((b + 25000) / 300000::DOUBLE, 9) AS load FROM e""")
NAMEPAIRS = "SELECT a.p_partkey AS id, a.p_name AS x, b.p_name AS y FROM part a JOIN part b ON a.p_partkey + 1 = b.p_partkey"
add("name_distances", lambda s, d: rows(s, d, NAMEPAIRS).select("id", S.bounded_distance(F.col("x"), F.col("y"), F.lit(4)).alias("distance"), S.similarity(F.col("x"), F.col("y"), 60).alias("ratio"), S.is_comparable_name(F.col("x")).alias("comparable")), f"WITH p AS ({NAMEPAIRS}), q AS (SELECT id, x, levenshtein(x, y) AS d, length(x) + length(y) AS t FROM p) SELECT id, least(d, 5)::INT AS distance, CASE WHEN d > ceil(40 * t / 100) THEN 0 ELSE floor((t - d) / t * 100 + 0.5) END::BIGINT AS ratio, strlen(x) >= 4 AND NOT starts_with(x, '_') AS comparable FROM q")
IMPACT = "SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS severity, CAST(p_partkey % 40 AS DOUBLE) AS percent_total, p_retailprice AS pagerank, p_size AS call_sites FROM part"
add("severity_by_impact", lambda s, d: rows(s, d, IMPACT).select("id", S.bumped(F.col("severity"), F.col("percent_total"), F.col("pagerank"), F.col("call_sites"), F.lit(1500.0)).alias("severity")), f"WITH i AS (SELECT *, (percent_total >= 20)::INT + (pagerank >= 1500)::INT + (call_sites >= 10)::INT AS b FROM ({IMPACT})) SELECT id, CASE WHEN severity = 'low' AND b = 3 THEN 'high' WHEN severity = 'low' AND b = 2 THEN 'medium' WHEN severity = 'medium' AND b >= 2 THEN 'high' ELSE severity END AS severity FROM i")
