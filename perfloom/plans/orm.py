"""Queries over chains, predicted statements and relations, for rows derived from `lineitem` and `part`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import orm as O
from .joins import add, rows

# a chain for each line of an order
CHAINS = """SELECT l_orderkey * 10 + l_linenumber AS chain, CASE l_orderkey % 5 WHEN 4 THEN 'unknown' WHEN 3 THEN 'module' ELSE 'name' END AS root_kind,
CASE l_linenumber % 5 WHEN 0 THEN 'Account' WHEN 1 THEN 'db' WHEN 2 THEN 'tx' WHEN 3 THEN 'accounts' ELSE 'Order' END AS root,
CASE l_partkey % 10 WHEN 0 THEN 'findAll' WHEN 1 THEN 'map;findByPk' WHEN 2 THEN 'Where;Order;Limit;Offset;Find' WHEN 3 THEN 'Where;Delete' WHEN 4 THEN 'Model;Updates' WHEN 5 THEN 'Preload;First' WHEN 6 THEN 'filter;update' WHEN 7 THEN 'user;findMany;upsert' WHEN 8 THEN 'Where;Scan' ELSE 'Count;Where' END AS said,
CASE WHEN l_partkey % 10 = 2 THEN concat('x = ?;;', CAST(l_suppkey AS VARCHAR(9)), ';', CAST(l_partkey AS VARCHAR(9)), ';') ELSE '' END AS args FROM lineitem"""


def chains(s, d):
    return rows(s, d, CHAINS).select("chain", "root_kind", "root", F.split("said", ";").alias("methods"), F.split("args", ";").alias("args"))


W = "string_split(said, ';')"
KNOWN = "root_kind <> 'unknown'"
PRISMA = "list_has_any({}, ['findMany', 'upsert'])".format(W)
SEQUELIZE = f"(list_contains({W}, 'findByPk') OR ({W}[1] = 'findAll' AND {KNOWN} AND root IN ('Account', 'Order')))"
GORM = f"(list_contains({W}, 'Preload') OR ({KNOWN} AND {W}[1] = 'Where' AND root IN ('db', 'tx') AND list_has_any({W}, ['Find', 'First', 'Take', 'Last', 'Count'])) OR ({KNOWN} AND {W}[1] = 'Model' AND root = 'db' AND list_has_any({W}, ['Updates', 'Update', 'Where'])))"
add("chain_shapes", lambda s, d: O.chain_shapes(chains(s, d)).select("chain", F.array_join("orms", ",").alias("orms")), f"SELECT chain, concat_ws(',', CASE WHEN {PRISMA} THEN 'prisma' END, CASE WHEN {SEQUELIZE} THEN 'sequelize' END, CASE WHEN {GORM} THEN 'gorm' END) AS orms FROM ({CHAINS})")
MODELS = "SELECT chain, 'sequelize' AS orm, CASE WHEN said = 'filter;update' THEN 'update' ELSE 'select' END AS op, lower(root) AS target, false AS has_where, false AS ordered, NULL AS limit_n, NULL AS offset_n, 'skeletal' AS fidelity FROM c WHERE root IN ('Account', 'Order') AND said IN ('findAll', 'map;findByPk', 'filter;update')"
HANDLES = """SELECT chain, 'gorm', CASE WHEN ends_with(said, 'Delete') THEN 'delete' WHEN ends_with(said, 'Updates') THEN 'update' ELSE 'select' END, '', starts_with(said, 'Where'), contains(said, 'Order') OR ends_with(said, 'First'), CASE WHEN ends_with(said, 'First') THEN 1 WHEN contains(said, 'Limit') THEN CAST(string_split(args, ';')[3] AS BIGINT) END, CASE WHEN contains(said, 'Offset') THEN CAST(string_split(args, ';')[4] AS BIGINT) END,
CASE WHEN args <> '' THEN 'partial' ELSE 'skeletal' END FROM c WHERE root IN ('db', 'tx') AND said IN ('Where;Order;Limit;Offset;Find', 'Where;Delete', 'Model;Updates', 'Preload;First', 'Where;Scan')"""
add("predicted_sql", lambda s, d: O.predicted(chains(s, d), [O.ModelCalls(), O.HandleCalls()]).select("chain", "orm", "op", "target", "has_where", "ordered", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("limit_n", "offset_n")], "fidelity"), f"WITH c AS (SELECT * FROM ({CHAINS}) WHERE {KNOWN}), p AS ({MODELS} UNION ALL {HANDLES}) SELECT * REPLACE (coalesce(limit_n, -1)::BIGINT AS limit_n, coalesce(offset_n, -1)::BIGINT AS offset_n) FROM p")

# chains with an argument each: one for each order; chr(36) is a dollar sign, which Spark would take for a variable
CALLED = """SELECT o_orderkey AS chain, CASE WHEN o_custkey % 10 = 9 THEN 'module' ELSE 'name' END AS root_kind, o_orderkey % 3 > 0 AS in_loop,
CASE o_custkey % 7 WHEN 0 THEN 'User' WHEN 1 THEN 'db' WHEN 2 THEN 'sequelize' WHEN 3 THEN 'userRepo' WHEN 4 THEN 'this' WHEN 5 THEN 'prisma' ELSE 'item' END AS root,
CASE o_orderkey % 19 WHEN 0 THEN 'findByPk' WHEN 1 THEN 'query' WHEN 2 THEN 'save' WHEN 3 THEN 'sync' WHEN 4 THEN 'find;populate;populate;populate' WHEN 5 THEN 'findById' WHEN 6 THEN 'x;toJSON' WHEN 7 THEN 'find;lean;toObject' WHEN 8 THEN 'findOne' WHEN 9 THEN 'db;First' WHEN 10 THEN 'Raw' WHEN 11 THEN 'AutoMigrate'
WHEN 12 THEN 'Model;Updates' WHEN 13 THEN 'createQueryBuilder;where' WHEN 14 THEN 'DataSource' WHEN 15 THEN 'prisma;findFirst' WHEN 16 THEN concat(chr(36), 'queryRawUnsafe') WHEN 17 THEN 'select;where;limit' ELSE 'select;update' END AS said,
CASE o_custkey % 8 WHEN 0 THEN concat('`a ', chr(36), '{x}`') WHEN 1 THEN 'fmt.Sprintf(q)' WHEN 2 THEN '{ force: true }' WHEN 3 THEN concat('{ ', chr(36), 'where: `', chr(36), '{x}` }') WHEN 4 THEN '{ synchronize: true }' WHEN 5 THEN '{ take: 5, skip: 2000 }' WHEN 6 THEN 'a + b' ELSE '{ skip: 999 }' END AS arg FROM orders"""


def called(s, d):
    # the last method has the argument
    c = rows(s, d, CALLED).withColumn("methods", F.split("said", ";"))
    n = F.size("methods")
    args = F.transform("methods", lambda m, i: F.when(i == n - 1, F.array("arg")).otherwise(F.array().cast("array<string>")))
    return c.withColumn("args", args)


NAMED, LAST = "root_kind = 'name'", "string_split(said, ';')[-1]"
MODEL, HANDLE = f"({NAMED} AND root = 'User' AND said IN ('findByPk', 'findOne', 'select;update'))", f"(({NAMED} AND root = 'db') OR said = 'db;First')"
PRISMA_CHAIN = f"({NAMED} AND (root IN ('prisma', 'db') OR (root = 'this' AND said = 'prisma;findFirst')))"
SAYS = {
    "SEQ-N1-001": f"in_loop AND {MODEL} AND said IN ('findByPk', 'findOne')",
    "SEQ-RAW-002": f"{NAMED} AND root IN ('sequelize', 'db') AND said = 'query' AND starts_with(arg, '`a')",
    "SEQ-SAVE-003": f"in_loop AND NOT {MODEL} AND said IN ('save', 'select;update')",
    "SEQ-SYNC-004": f"{NAMED} AND root IN ('sequelize', 'db') AND said = 'sync' AND contains(arg, 'force')",
    "MNG-POP-001": "contains(said, 'populate')",
    "MNG-N1-002": f"in_loop AND {NAMED} AND root = 'User' AND said IN ('findById', 'findOne')",
    "MNG-LEAN-003": "in_loop AND said = 'x;toJSON'",
    "MNG-RAW-004": "said = 'findOne' AND contains(arg, '$where')",
    "GORM-N1-001": f"in_loop AND {HANDLE} AND said = 'db;First'",
    "GORM-RAW-002": "said = 'Raw' AND contains(arg, 'Sprintf')",
    "GORM-AUTO-003": f"{HANDLE} AND said = 'AutoMigrate'",
    "GORM-SAVE-004": f"in_loop AND {HANDLE} AND said = 'Model;Updates'",
    "TO-N1-001": f"in_loop AND {NAMED} AND root = 'userRepo' AND said = 'findOne'",
    "TO-QB-003": "said = 'createQueryBuilder;where' AND starts_with(arg, '`a')",
    "TO-SYNC-004": "said = 'DataSource' AND contains(arg, 'synchronize')",
    "PRI-N1-002": f"in_loop AND {PRISMA_CHAIN} AND said = 'prisma;findFirst'",
    "PRI-RAW-003": "said = '$queryRawUnsafe' AND (starts_with(arg, '`a') OR arg = 'a + b')",
    "PRI-PAG-004": f"{PRISMA_CHAIN} AND said = 'prisma;findFirst' AND contains(arg, '2000')",
    "DRZ-LMT-001": f"{NAMED} AND root = 'db' AND said = 'select;where;limit'",
    "DRZ-N1-002": f"in_loop AND {NAMED} AND root = 'db' AND said = 'select;where;limit'",
}
add(
    "chain_findings",
    lambda s, d: O.chain_findings(called(s, d)),
    f"WITH c AS ({CALLED}) " + " UNION ALL ".join(f"SELECT chain, '{r.id}' AS rule, '{r.severity}' AS severity, '{r.effort}' AS effort, {r.confidence}::DOUBLE AS confidence FROM c WHERE {SAYS[r.id]}" for r in O.CHAIN_RULES),
)

# ---- statements in relational form: a statement for each order
LINES = "(SELECT o_orderkey AS k, o_orderkey % 7 AS line, o_custkey AS cust, (o_orderkey * 37 + o_custkey) % 2000 AS n, o_orderstatus AS status FROM orders) t"
STATEMENTS = f"""SELECT k * 10 + line AS stmt, concat('m', CAST(cust % 40 AS VARCHAR(9)), '.py') AS file, n % 1000 AS pos, CASE line % 4 WHEN 0 THEN 'select' WHEN 1 THEN 'insert' WHEN 2 THEN 'update' ELSE 'delete' END AS op,
CASE (cust + k) % 7 WHEN 0 THEN 'full' WHEN 1 THEN 'full' WHEN 2 THEN 'aggregate' ELSE 'unspecified' END AS projection, CASE WHEN k % 2 = 0 THEN 'count(_per_outer_row_)' ELSE 'count(*)' END AS projection_text,
k % 3 = 0 AS limited, CASE WHEN k % 3 = 0 THEN n END AS offset_n, CASE status WHEN 'F' THEN 'concrete' WHEN 'O' THEN 'partial' ELSE 'skeletal' END AS fidelity, k, line, n, cust FROM {LINES}"""
PARTS = {
    "tables": f"SELECT k * 10 + line AS stmt FROM {LINES} UNION ALL SELECT k * 10 + line FROM {LINES} WHERE cust % 6 = 0",
    "joins": f"SELECT k * 10 + line AS stmt, CASE WHEN cust % 11 = 0 THEN 'cartesian' ELSE 'inner' END AS kind, cust % 7 > 0 AS has_on FROM {LINES} WHERE cust % 4 = 0",
    "predicates": f"""SELECT k * 10 + line AS stmt, 1 AS level, CASE n % 5 WHEN 0 THEN 'or' WHEN 1 THEN 'and' WHEN 2 THEN 'function' ELSE 'eq' END AS kind, 'x' AS value, false AS variable FROM {LINES} WHERE n % 4 > 0
UNION ALL SELECT k * 10 + line, line % 4 + 1, 'like', CASE WHEN cust % 2 = 0 THEN '%x' ELSE 'x%' END, cust % 3 = 0 FROM {LINES} WHERE n % 4 > 0 AND n % 5 < 2""",
    "orders": f"SELECT k * 10 + line AS stmt FROM {LINES} WHERE cust % 5 = 0",
}
RANGES = "SELECT p_partkey AS range, CASE WHEN p_size % 2 = 0 THEN 'loop' ELSE 'await' END AS kind, concat('m', CAST(p_partkey % 40 AS VARCHAR(9)), '.py') AS file, p_partkey % 1000 AS s, p_partkey % 1000 + p_size AS e FROM part"


def featured(s, d):
    return O.features(rows(s, d, STATEMENTS), *[rows(s, d, PARTS[k]) for k in ("tables", "joins", "predicates", "orders")])


SOME = "n % 4 > 0"
#: What each rule means for these rows, said without the operator's features.
MEANT = {
    "SQLIR-001": "op = 'select' AND projection = 'full'",
    "SQLIR-002": f"op IN ('update', 'delete') AND NOT {SOME}",
    "SQLIR-003": "op = 'insert' AND projection = 'full'",
    "SQLIR-004": f"{SOME} AND n % 5 < 2 AND cust % 2 = 0 AND cust % 3 > 0",
    "SQLIR-005": "limited AND cust % 5 > 0",
    "SQLIR-006": f"{SOME} AND n % 5 = 0",
    "SQLIR-007": f"{SOME} AND n % 5 = 2",
    "SQLIR-008": f"{SOME} AND n % 5 < 2 AND line % 4 = 3",
    "SQLIR-009": f"(cust % 4 = 0 AND cust % 11 = 0) OR (cust % 6 = 0 AND NOT {SOME} AND cust % 4 > 0)",
    "SQLIR-010": "op = 'update' AND NOT limited",
    "SQLIR-011": "projection = 'aggregate' AND k % 2 = 0",
    "SQLIR-012": f"op = 'select' AND NOT {SOME} AND NOT limited",
    "SQLIR-013": "offset_n >= 1000",
    "SQLIR-014": "cust % 4 = 0 AND cust % 11 > 0 AND cust % 7 = 0",
}


def _rule(r: O.StatementRule) -> None:
    a, b, c = O.WEIGHTS[r.weight]
    add(
        f"statement_rule_{r.id[-3:]}",
        lambda s, d: O.statement_findings(featured(s, d), (r,)).select("stmt", "rule", "severity", F.round("confidence", 6).alias("confidence")),
        f"SELECT stmt, '{r.id}' AS rule, '{r.severity}' AS severity, round({r.confidence}::DOUBLE * CASE fidelity WHEN 'concrete' THEN {a} WHEN 'partial' THEN {b} ELSE {c} END::DOUBLE, 6) AS confidence FROM ({STATEMENTS}) WHERE {MEANT[r.id]}",
    )


for _r in O.STATEMENT_RULES:
    _rule(_r)


def in_loops(s, d):
    found = O.statement_findings(featured(s, d)).join(O.in_ranges(rows(s, d, STATEMENTS), rows(s, d, RANGES)), "stmt")
    return found.groupBy("rule", "in_loop", "in_await").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("confidence"), 6).alias("confidence"))


HITS = " UNION ALL ".join(f"SELECT *, '{r.id}' AS rule, {r.confidence}::DOUBLE * CASE fidelity WHEN 'concrete' THEN {O.WEIGHTS[r.weight][0]} WHEN 'partial' THEN {O.WEIGHTS[r.weight][1]} ELSE {O.WEIGHTS[r.weight][2]} END::DOUBLE AS confidence FROM z WHERE {MEANT[r.id]}" for r in O.STATEMENT_RULES)
add("statement_findings", in_loops, f"WITH z AS ({STATEMENTS}), g AS ({RANGES}), k AS (SELECT DISTINCT stmt, kind FROM z JOIN g ON g.file = z.file AND pos BETWEEN s AND e), f AS ({HITS}) SELECT rule, stmt IN (SELECT stmt FROM k WHERE kind = 'loop') AS in_loop, stmt IN (SELECT stmt FROM k WHERE kind = 'await') AS in_await, count(*) AS n, round(sum(confidence), 6) AS confidence FROM f GROUP BY ALL")

# ---- relations: a queryset for each part, a chain for each line of an order
FOLLOWED = "SELECT l_orderkey * 10 + l_linenumber AS chain, l_partkey AS source, CASE l_linenumber % 5 WHEN 0 THEN 'customer.nation.region.name' WHEN 1 THEN 'customer.name' WHEN 2 THEN 'lines' WHEN 3 THEN 'customer.nation.customer.orders.lines' ELSE 'customer.manager.boss' END AS said FROM lineitem"
SOURCES = "SELECT p_partkey AS source, CASE WHEN p_partkey % 13 > 0 THEN 'Order' END AS model, p_partkey % 17 = 0 AS values_only FROM part"
LOADED = "SELECT p_partkey AS source, 'prefetched' AS tree, CASE p_size % 3 WHEN 0 THEN 'customer__nation' WHEN 1 THEN 'customer' ELSE '' END AS path FROM part UNION ALL SELECT p_partkey, 'selected', CASE p_partkey % 3 WHEN 0 THEN 'nation__region' WHEN 1 THEN 'customer__nation__customer' ELSE 'lines' END FROM part"
MODELS_OF = [("Order", "customer", "Customer", False), ("Order", "lines", "Line", False), ("Customer", "name", None, True), ("Customer", "nation", "Nation", False), ("Customer", "manager", None, False), ("Customer", "orders", "Order", False), ("Nation", "region", "Region", False), ("Nation", "customer", "Customer", False), ("Region", "name", None, True)]


def verdicts(s, d):
    fields = s.createDataFrame(MODELS_OF, "model string, field string, target string, scalar boolean")
    followed = rows(s, d, FOLLOWED).select("chain", "source", F.split("said", r"\.").alias("path"))
    return O.prefetch_verdicts(followed, rows(s, d, SOURCES), rows(s, d, LOADED), fields)


VALUES = ", ".join(f"('{m}', '{f}', {repr(t) if t else 'NULL'}, {str(x).lower()})" for m, f, t, x in MODELS_OF)
add(
    "prefetch_verdicts",
    verdicts,
    f"""WITH RECURSIVE f(model, field, target, scalar) AS (VALUES {VALUES}), c AS (SELECT chain, o.source, model, string_split(said, '.') AS w FROM ({FOLLOWED}) o JOIN ({SOURCES}) s ON s.source = o.source WHERE NOT values_only),
p AS (SELECT source, list(path) FILTER (tree = 'prefetched') AS a, list(path) FILTER (tree = 'selected') AS b FROM ({LOADED}) GROUP BY source),
w(chain, pos, w, model, a, b, x, y, verdict) AS (SELECT chain, 0, w, model, a, b, '', '', '' FROM c JOIN p USING (source)
UNION ALL SELECT chain, pos + 1, w, target, a, b, CASE WHEN pa THEN na ELSE x END, CASE WHEN pb THEN nb ELSE y END, CASE WHEN model IS NOT NULL AND coalesce(scalar, false) THEN 'plain' WHEN NOT pa AND NOT pb THEN 'unsafe' WHEN model IS NULL OR target IS NULL THEN 'end' ELSE '' END
FROM (SELECT t.*, f.target, f.scalar, len(list_filter(a, lambda q: starts_with(q || '__', na || '__'))) > 0 AS pa, len(list_filter(b, lambda q: starts_with(q || '__', nb || '__'))) > 0 AS pb FROM (SELECT *, x || CASE WHEN x = '' THEN '' ELSE '__' END || w[pos + 1] AS na, y || CASE WHEN y = '' THEN '' ELSE '__' END || w[pos + 1] AS nb FROM w WHERE verdict = '' AND pos < len(w)) t LEFT JOIN f ON f.model = t.model AND f.field = t.w[t.pos + 1]))
SELECT chain, pos - 1 AS pos, w[pos] AS field FROM w WHERE verdict = 'unsafe'""",
)
