"""Lint of SQL text: statements, then rules as one array of conditions over masked text, all inside one projection.

The rules judge text, not a syntax tree: literals and comments are masked first, so that only code is seen; rules of a statement's own
level see it with its parentheses collapsed, others see a nested query as part of its statement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Left to right: comments go; a literal keeps its quotes and a leading percent sign; a dollar-quoted body goes.
MASK = r"(?s)--[^\n]*|/\*.*?\*/|\$([A-Za-z_]*)\$.*?\$\1\$|(')(%?)(?:[^']|'')*(')"


def masked(text: Column) -> Column:
    """Lower-case code of an SQL text with blanks as one space; null stays null."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, MASK, "$2$3$4")), r"\s+", " "))


def rules(q: Column) -> list[tuple[str, str, Column]]:
    """(rule, severity, condition) over one masked statement."""

    def has(pattern: str) -> Column:
        return q.rlike(pattern)

    index, alter = has(r"^create (unique )?index\b"), has(r"^alter table\b")
    return [
        ("SQL004", "low", has(r"^insert into [\w.\"`]+ values\b")),
        ("SQL005", "medium", has(r"\bi?like '%")),
        ("SQL006", "medium", has(r"\border by (random|rand|newid) ?\(")),
        ("SQL007", "low", has(r"\b([\w.]+) ?= ?\S+ or \1 ?= ?\S+ or \1 ?= ")),
        ("SQL011", "medium", has(r"\bnot in ?\( ?select\b")),
        ("SQL015", "low", has(r"\bunion (?!all\b)")),
        ("SQL_DISTINCT_NO_ORDER_BY", "low", has(r"^select distinct\b(?! on\b)") & ~has(r"\border by\b")),
        ("SQL_OFFSET_DEEP_PAGINATION", "medium", has(r"\boffset 0*[1-9][0-9]{3,}\b")),
        ("SQL021_GROUP_BY_ORDINAL", "low", has(r"\bgroup by ([^()]*, ?)?[0-9]+( |,|$)")),
        ("SQL023_NOT_IN_WITH_NULL", "high", has(r"\bnot in ?\(([^()]*, ?)?null\b")),
        ("SQL025_JSON_PATH_IN_WHERE", "medium", has(r"\bwhere\b.*->")),
        ("MIG_CREATE_INDEX_NOT_CONCURRENT", "high", index & ~has(r"^create (unique )?index concurrently\b")),
        ("MIG_DROP_TABLE", "high", has(r"^drop table\b")),
        ("MIG_DROP_COLUMN", "high", alter & has(r"\bdrop column\b")),
        ("MIG_ALTER_COLUMN_TYPE", "high", alter & has(r"\balter (column )?\S+ (set data )?type\b")),
        ("MIG_ADD_FK_NOT_VALID", "high", alter & has(r"\bforeign key\b") & ~has(r"\bnot valid\b")),
        ("MIG_ADD_COLUMN_NOT_NULL_NO_DEFAULT", "high", alter & has(r"\badd (column )?(?!constraint\b)[^,]*\bnot null\b") & ~has(r"\bdefault\b")),
    ]


def statements(texts: DataFrame) -> DataFrame:
    """Rows (id, statement, sql) of the masked statements of texts (id, sql); empty ones go."""
    return texts.select("id", F.posexplode(F.split(masked(F.col("sql")), ";")).alias("statement", "sql")).withColumn("sql", F.trim("sql")).filter("sql <> ''")


#: What stands for a collapsed subquery, and for any other collapsed parenthesis.
SUBQUERY, NESTED = "\u27e6q\u27e7", "\u27e6p\u27e7"
AGGREGATE = r"\b(count|sum|avg|min|max|stddev|variance|array_agg|string_agg|group_concat|bool_and|bool_or) ?(\(|\u27e6)"
POSITIONAL = r"\b(row_number|rank|dense_rank|percent_rank|cume_dist|ntile|lag|lead|first_value|last_value|nth_value) ?\([^()]*\) over ?\( ?order by\b"


def _times(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def shape(q: Column) -> Column:
    """struct(flat, joins, ors, depth) of one masked statement.

    flat: its own level, parentheses collapsed from the inside out; joins and ors: the most in any one level; depth: nested queries,
    the statement itself being one. As many levels are looked into as there are parentheses.
    """
    # a query in parentheses of its own is the same query
    again = rf"\s*{SUBQUERY}\s*\)"
    inner, other = rf"\(\s*(?:select|with)\b[^()]*\)|\({again}", rf"\((?!\s*(?:select|with)\b|{again})[^()]*\)"

    def most(parts: Column, pattern: str) -> Column:
        return F.coalesce(F.array_max(F.transform(parts, lambda x: _times(x, pattern))), F.lit(0))

    def step(s: Column, _: Column) -> Column:
        queries, others = (F.regexp_extract_all(s["flat"], F.lit(p), F.lit(0)) for p in (inner, other))
        left = F.regexp_replace(F.regexp_replace(s["flat"], inner, SUBQUERY), other, NESTED)
        return F.struct(left.alias("flat"), F.greatest(s["joins"], most(queries, r"\bjoin\b")).alias("joins"), F.greatest(s["ors"], most(F.concat(queries, others), r"\bor\b")).alias("ors"))

    start = F.struct(q.alias("flat"), F.lit(0).alias("joins"), F.lit(0).alias("ors"))

    def level(s: Column, i: Column) -> Column:
        return F.when(F.contains(s["flat"], F.lit("(")), step(s, i)).otherwise(s)

    end = F.aggregate(F.sequence(F.lit(0), _times(q, r"\(")), start, level)

    def nest(s: Column, t: Column) -> Column:
        # the stack has a 1 for each open parenthesis that begins a query
        opened = F.concat(s["stack"], F.array(F.lit(0)))
        marked = F.concat(F.slice(s["stack"], F.lit(1), F.size(s["stack"]) - 1), F.array(F.lit(1)))
        stack = F.when(t == "(", opened).when((t == ")") & (F.size(s["stack"]) > 0), F.slice(s["stack"], F.lit(1), F.size(s["stack"]) - 1)).when((t == "select") & (F.size(s["stack"]) > 0), marked).otherwise(s["stack"])
        return F.struct(stack.alias("stack"), s["most"].alias("most"))

    def deepest(s: Column, t: Column) -> Column:
        new = nest(s, t)
        return F.struct(new["stack"].alias("stack"), F.greatest(s["most"], F.aggregate(new["stack"], F.lit(0), lambda a, x: a + x)).alias("most"))

    tokens = F.regexp_extract_all(q, F.lit(r"\(|\)|\bselect\b"), F.lit(0))
    depth = F.aggregate(tokens, F.struct(F.array().cast("array<int>").alias("stack"), F.lit(0).alias("most")), deepest, lambda s: s["most"] + 1)
    return F.get(F.transform(F.array(end), lambda e: F.struct(e["flat"].alias("flat"), F.greatest(e["joins"], _times(e["flat"], r"\bjoin\b")).alias("joins"), F.greatest(e["ors"], _times(e["flat"], r"\bor\b")).alias("ors"), depth.alias("depth"))), F.lit(0))


def shape_rules(q: Column, s: Column) -> list[tuple[str, str, Column]]:
    """(rule, severity, condition) over a masked statement and its shape."""
    flat, query = s["flat"], q.rlike(r"^(select|with)\b")
    items = F.split(F.regexp_extract(flat, r"^select (?:distinct |all )?(.*?)(?: from\b.*)?$", 1), ",")
    sources = F.regexp_extract(flat, r"^select\b.*? from (.*?)(?: where\b.*| group by\b.*| order by\b.*| limit\b.*| having\b.*)?$", 1)
    where = F.regexp_extract(q, r"\bwhere\b(.*)$", 1)
    having = F.regexp_extract(flat, r"\bhaving\b(.*?)(?: order by\b.*| limit\b.*)?$", 1)
    order = F.split(F.regexp_extract(flat, r"\border by (.*?)(?: limit\b.*| offset\b.*)?$", 1), ",")
    lists = F.regexp_extract_all(q, F.lit(r"\bin ?\((?!\s*select\b)[^()]*\)"), F.lit(0))
    sums = F.exists(items, lambda x: x.rlike(AGGREGATE) & ~x.rlike(r"\bover\b"))
    bare = F.exists(items, lambda x: F.trim(x).rlike(r"^[a-z_][\w.]*( as \w+| \w+)?$"))
    call = r"\b(?!(?:in|and|or|not|exists|any|all|some|values|when|then|else)\b)[a-z_]\w* ?\( ?[a-z_][\w.]* ?(?:,[^()]*)?\)"
    own_where = flat.rlike(r"\bwhere\b")
    return [
        ("SQL001", "low", flat.rlike(r"^(?:with\b[^*]*? )?select (distinct |all )?(\w+\.)?\*( |,|$)")),
        ("SQL002", "high", flat.rlike(r"^(?:with\b.*? )?delete from\b") & ~own_where),
        ("SQL003", "high", flat.rlike(r"^(?:with\b.*? )?update\b.*\bset\b") & ~own_where),
        ("SQL009", "medium", where.rlike(call + r" ?(=|<>|!=|<=|>=|<|>)") | where.rlike(r"(=|<>|!=|<=|>=|<|>) ?" + call)),
        ("SQL010", "high", query & (F.size(F.split(sources, ",")) > 1) & ~flat.rlike(r"\bjoin\b") & ~where.rlike(r"[^<>!]=")),
        ("SQL_COMPLEX_JOINS", "medium", query & (s["joins"] >= 6)),
        ("SQL_COMPLEX_SUBQUERY_DEPTH", "medium", query & (s["depth"] >= 4)),
        ("SQL_COMPLEX_OR_CHAIN", "low", s["ors"] >= 6),
        ("SQL_LARGE_IN_LIST", "medium", F.coalesce(F.array_max(F.transform(lists, lambda x: F.size(F.split(x, ",")))), F.lit(0)) >= 100),
        ("SQL_WIN_NO_PARTITION", "medium", query & q.rlike(POSITIONAL)),
        ("SQL_SUB_SCALAR_IN_PROJECTION", "high", query & F.exists(items, lambda x: F.trim(x).rlike(f"^{SUBQUERY}( as \\w+| \\w+)?$"))),
        ("SQL014_HAVING_NO_AGGREGATE", "low", flat.rlike(r"\bhaving\b") & ~having.rlike(AGGREGATE)),
        ("SQL017_AMBIGUOUS_GROUP", "high", query & sums & bare & ~flat.rlike(r"\bgroup by\b")),
        ("SQL022_ORDER_BY_CONSTANT", "low", flat.rlike(r"\border by\b") & F.forall(order, lambda x: F.trim(x).rlike(r"^(''|\d+(\.\d+)?|null|true|false)( asc| desc)?$"))),
    ]


def lint(texts: DataFrame, more=()) -> DataFrame:
    """Rows (id, statement, rule, severity), one for each rule that a statement breaks.

    more: rules of one's own, each (rule, severity, function of the masked statement and its shape to a condition).
    """
    q, s = F.col("sql"), F.col("shape")
    all_ = [*rules(q), *shape_rules(q, s), *((r, v, f(q, s)) for r, v, f in more)]
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(r).alias("rule"), F.lit(v).alias("severity"))) for r, v, c in all_]))
    shaped = statements(texts).withColumn("shape", shape(q))
    return shaped.select("id", "statement", F.explode(found).alias("f")).select("id", "statement", "f.rule", "f.severity")
