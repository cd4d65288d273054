"""SQL lint over statements chosen by `part`; the oracle states the rules each must break."""

from __future__ import annotations

from ..functions import sqltext
from .joins import add, rows

#: Text of a case, and the rules with severities that it breaks.
CASES = [
    ("SELECT * FROM t -- DROP TABLE x", [("SQL001", "low")]),
    ("DELETE FROM t; UPDATE t SET a = 1", [("SQL002", "high"), ("SQL003", "high")]),
    ("DELETE FROM t WHERE a = ''; x; ''", []),
    ("INSERT INTO t VALUES (1)", [("SQL004", "low")]),
    ("SELECT a FROM t WHERE b LIKE ''%x''", [("SQL005", "medium")]),
    ("SELECT a FROM t ORDER BY random()", [("SQL006", "medium")]),
    ("SELECT a FROM t WHERE a NOT IN (SELECT b FROM u) UNION SELECT 1", [("SQL011", "medium"), ("SQL015", "low")]),
    ("ALTER TABLE t DROP COLUMN c", [("MIG_DROP_COLUMN", "high")]),
    ("CREATE INDEX i ON t (a)", [("MIG_CREATE_INDEX_NOT_CONCURRENT", "high")]),
    ("SELECT a FROM t /* SELECT * */ LIMIT 5 OFFSET 2000", [("SQL_OFFSET_DEEP_PAGINATION", "medium")]),
    ("SELECT a FROM t WHERE lower(b) = 1 AND c IN (SELECT d FROM u)", [("SQL009", "medium")]),
    ("SELECT t.a FROM t, u WHERE t.a > 3", [("SQL010", "high")]),
    ("SELECT t.a FROM t, u WHERE t.a = u.b", []),
    ("SELECT a FROM t " + " ".join(f"JOIN u{i} USING (k)" for i in range(6)), [("SQL_COMPLEX_JOINS", "medium")]),
    ("SELECT a FROM (SELECT a FROM (SELECT a FROM (SELECT a FROM t) x) y) z", [("SQL_COMPLEX_SUBQUERY_DEPTH", "medium")]),
    ("SELECT a FROM (SELECT a FROM (SELECT (a) FROM t) y) z", []),
    ("SELECT a FROM t WHERE " + " OR ".join(f"c{i} > 1" for i in range(7)), [("SQL_COMPLEX_OR_CHAIN", "low")]),
    ("SELECT a FROM t WHERE " + " OR ".join(f"c{i} > 1" for i in range(6)), []),
    ("SELECT a FROM t WHERE b IN (" + ", ".join(map(str, range(100))) + ")", [("SQL_LARGE_IN_LIST", "medium")]),
    ("SELECT a, row_number() OVER (ORDER BY b) FROM t", [("SQL_WIN_NO_PARTITION", "medium")]),
    ("SELECT a, row_number() OVER (PARTITION BY c ORDER BY b) FROM t", []),
    ("SELECT a, (SELECT max(b) FROM u) AS m FROM t", [("SQL_SUB_SCALAR_IN_PROJECTION", "high")]),
    ("SELECT a FROM t GROUP BY a HAVING a > 3", [("SQL014_HAVING_NO_AGGREGATE", "low")]),
    ("SELECT a FROM t GROUP BY a HAVING count(*) > 3", []),
    ("SELECT a, count(*) FROM t", [("SQL017_AMBIGUOUS_GROUP", "high")]),
    ("SELECT count(*), max(a) FROM t", []),
    ("SELECT a FROM t ORDER BY 1, 2 DESC LIMIT 3", [("SQL022_ORDER_BY_CONSTANT", "low")]),
    ("SELECT DISTINCT a FROM t", [("SQL_DISTINCT_NO_ORDER_BY", "low")]),
    ("SELECT a, count(*) FROM t GROUP BY 1", [("SQL021_GROUP_BY_ORDINAL", "low")]),
    ("SELECT a FROM t WHERE b NOT IN (1, NULL)", [("SQL023_NOT_IN_WITH_NULL", "high")]),
    ("SELECT a FROM t WHERE b = 1 OR b = 2 OR b = 3", [("SQL007", "low")]),
    ("SELECT a FROM t WHERE b->>''k'' > 1", [("SQL025_JSON_PATH_IN_WHERE", "medium")]),
    ("DROP TABLE t", [("MIG_DROP_TABLE", "high")]),
    ("ALTER TABLE t ALTER COLUMN c TYPE bigint", [("MIG_ALTER_COLUMN_TYPE", "high")]),
    ("ALTER TABLE t ADD CONSTRAINT f FOREIGN KEY (a) REFERENCES u (b)", [("MIG_ADD_FK_NOT_VALID", "high")]),
    ("ALTER TABLE t ADD COLUMN c int NOT NULL", [("MIG_ADD_COLUMN_NOT_NULL_NO_DEFAULT", "high")]),
]
TEXTS = f"SELECT p_partkey AS id, CASE p_partkey % {len(CASES)} " + " ".join(f"WHEN {k} THEN '{t}'" for k, (t, _) in enumerate(CASES)) + " END AS sql FROM part"
BROKEN = ", ".join(f"({k}, {n if k == 1 else 0}, '{r}', '{s}')" for k, (_, broken) in enumerate(CASES) for n, (r, s) in enumerate(broken))
add("sql_lint", lambda s, d: sqltext.lint(rows(s, d, TEXTS.replace("''", r"\'"))), f"SELECT p_partkey AS id, CAST(n AS INT) AS statement, rule, severity FROM part JOIN (VALUES {BROKEN}) v(k, n, rule, severity) ON v.k = p_partkey % {len(CASES)}")
