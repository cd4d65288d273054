"""Call chains of object mappers: which mapper a chain is of, the statements it predicts, rules over those, relations it follows.

A chain is a row (chain, root_kind, root, methods): `db.Where(..).Find(..)` has the root db and the methods Where, Find.
Root kinds: name (an identifier, binding or loop variable), module (an attribute of a module, `root` is the module), unknown.

Shapes are rows; they are compiled into one automaton whose state is a few words of bits, and one `aggregate` folds it
over the methods of a chain. Dialects are classes that a user registers; a table function asks them and a lateral join adds the statements they
predict. Rules over statements are rows, too: conditions over the features of a statement, which come from its tables, joins,
predicates and orders by one aggregate. Prefetched paths are a prefix tree in rows, which all chains descend together, a step a round.

Defined cases: a chain without methods has no shape and predicts nothing; null methods match nothing; a statement without detail rows has none of
their features; a statement outside all loops is in none; a chain of a queryset without a known model is judged by its first step alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import settle
from .joins import innermost

#: Bits of a word of the automaton.
WORD = 62


@dataclass(frozen=True)
class Shape:
    """A row of the table. Anchor (no test): the method anywhere in a chain. Else: the first method, the root, and any of `then` if there are some."""

    orm: str
    method: str
    test: str = ""  # any, contains (in either case), equals, upper (its first letter), module
    root: str = ""
    then: tuple[str, ...] = ()


def anchors(orm: str, *methods: str) -> tuple[Shape, ...]:
    return tuple(Shape(orm, m) for m in methods)


READS = ("Find", "First", "Take", "Last", "Count")
#: Method names that only one mapper has, and roots that tell common ones apart.
SHAPES = (
    *anchors("prisma", "$queryRaw", "$queryRawUnsafe", "$executeRaw", "$executeRawUnsafe", "$transaction", "$connect", "$disconnect", "findUniqueOrThrow", "findFirstOrThrow", "findUnique", "findMany", "createMany", "upsert", "groupBy"),
    *anchors("sequelize", "findAndCountAll", "findOrCreate", "findCreateFind", "bulkCreate", "findByPk", "increment", "decrement"),
    Shape("sequelize", "findAll", "upper"),
    *anchors("gorm", "AutoMigrate", "Preload", "Joins", "FirstOrCreate", "FirstOrInit", "Scopes", "Pluck", "Omit"),
    Shape("gorm", "Where", "equals", "db", READS),
    Shape("gorm", "Where", "equals", "tx", READS),
    Shape("gorm", "Model", "equals", "db", ("Updates", "Update", "Where")),
    *anchors("mongoose", "findByIdAndUpdate", "findByIdAndRemove", "findByIdAndDelete", "findOneAndUpdate", "findOneAndReplace", "findOneAndDelete", "markModified"),
    Shape("mongoose", "find", "upper", "", ("populate", "lean", "select", "exec")),
)


def _root_test(test: str, value: str) -> Column:
    named = F.col("root_kind") != "unknown"
    return F.coalesce(
        {
            "any": lambda: F.lit(True),
            "contains": lambda: named & F.contains(F.lower("root"), F.lit(value.lower())),
            "equals": lambda: named & (F.col("root") == value),
            "upper": lambda: named & F.col("root").rlike(r"^\p{Lu}"),
            "module": lambda: (F.col("root_kind") == "module") & (F.col("root") == value),
        }[test](),
        F.lit(False),
    )


def shape_bits(shapes: tuple[Shape, ...]) -> list[Column]:
    """A word of bits for each WORD shapes: 1 where the chain has the shape. One fold over the methods, whatever the number of shapes."""
    words = range(-(-len(shapes) // WORD))
    found = {m: [0] * len(words) for s in shapes for m in (s.method, *s.then)}  # bits that a method anywhere sets
    first = {s.method: [0] * len(words) for s in shapes}  # bits that a first method allows
    roots: dict[tuple[str, str], list[int]] = {}  # bits that a root allows
    free = [0] * len(words)  # bits that ask nothing of further methods
    for k, s in enumerate(shapes):
        w, bit = k // WORD, 1 << (k % WORD)
        if not s.test:
            found[s.method][w] |= bit
        else:
            first[s.method][w] |= bit
            roots.setdefault((s.test, s.root), [0] * len(words))[w] |= bit
            for m in s.then:
                found[m][w] |= bit
            if not s.then:
                free[w] |= bit
    anchored = [sum(1 << (k % WORD) for k, s in enumerate(shapes) if not s.test and k // WORD == w) for w in words]

    def table(of: dict[str, list[int]]) -> Column:
        return F.create_map(*[x for m, bits in of.items() for x in (F.lit(m), F.array(*[F.lit(b).cast("long") for b in bits]))])

    def word(bits: Column, w: int) -> Column:
        return F.coalesce(F.get(bits, F.lit(w)), F.lit(0).cast("long"))

    zero = F.struct(*[F.lit(0).cast("long").alias(f"w{w}") for w in words])

    def step(state: Column, method: Column) -> Column:
        return F.get(F.transform(F.array(F.try_element_at(table(found), method)), lambda b: F.struct(*[state[f"w{w}"].bitwiseOR(word(b, w)).alias(f"w{w}") for w in words])), F.lit(0))

    seen = F.aggregate(F.coalesce("methods", F.array().cast("array<string>")), zero, step)
    begin = F.try_element_at(table(first), F.get("methods", F.lit(0)))
    out = []
    for w in words:
        allowed = reduce(lambda a, b: a.bitwiseOR(b), [F.when(_root_test(*r), F.lit(bits[w]).cast("long")).otherwise(F.lit(0).cast("long")) for r, bits in roots.items()], F.lit(0).cast("long"))
        combined = seen[f"w{w}"].bitwiseOR(F.lit(free[w])).bitwiseAND(word(begin, w)).bitwiseAND(allowed)
        out.append(seen[f"w{w}"].bitwiseAND(F.lit(anchored[w])).bitwiseOR(combined))
    return out


def chain_shapes(chains: DataFrame, shapes: tuple[Shape, ...] = SHAPES) -> DataFrame:
    """The chains with `orms`, the mappers whose shapes they have, in the table's order; none: an empty array."""
    words = shape_bits(shapes)
    names = list(dict.fromkeys(s.orm for s in shapes))
    told = chains.withColumns({f"_w{w}": c for w, c in enumerate(words)})

    def has(orm: str) -> Column:
        masks = [sum(1 << (k % WORD) for k, s in enumerate(shapes) if s.orm == orm and k // WORD == w) for w in range(len(words))]
        return reduce(lambda a, b: a | b, [F.col(f"_w{w}").bitwiseAND(F.lit(m)) != 0 for w, m in enumerate(masks)])

    return told.withColumn("orms", F.array_compact(F.array(*[F.when(has(n), F.lit(n)) for n in names]))).drop(*[f"_w{w}" for w in range(len(words))])


# ---- rules over chains
@dataclass(frozen=True)
class ChainRule:
    """A row of the table: all that is given must hold of a chain."""

    id: str
    severity: str
    effort: str
    confidence: float
    guard: str = ""  # of GUARDS, `!` before it negates
    in_loop: bool = False
    last: tuple[str, ...] = ()  # the last method is one of them
    all_of: tuple[str, ...] = ()
    any_of: tuple[str, ...] = ()
    none_of: tuple[str, ...] = ()
    least: tuple[str, int] | None = None  # a method so many times or more
    said: tuple[tuple[str, ...], str] | None = None  # an argument of one of these methods (none: of any) has this pattern


#: Which chains belong to a mapper, as conditions over `name` (the root, if it is a name), `first` and `methods`.
GUARDS = {
    "model": r"name rlike '^\\p{Lu}' AND arrays_overlap(methods, array('findAll', 'findOne', 'findByPk', 'findOrCreate', 'create', 'bulkCreate', 'update', 'destroy', 'count'))",
    "pascal": r"name rlike '^\\p{Lu}'",
    "sequelize": "name IN ('sequelize', 'db')",
    "handle": "name rlike '^(db|tx|.*DB)$' OR first rlike '^(db|tx|.*DB)$'",
    "repository": "name rlike '(Repo|Repository)$|^(this[.])*repo$' OR (name = 'this' AND first rlike '(Repo|Repository)$|^repo$')",
    "prisma": "name IN ('prisma', 'db', 'client') OR (name IN ('this', 'self') AND first IN ('prisma', 'db', 'client'))",
    "drizzle": "arrays_overlap(methods, array('select', 'insert', 'update', 'delete')) AND (name IN ('db', 'drizzle', 'tx') OR (name IN ('this', 'self') AND first IN ('db', 'drizzle', 'client', 'rlsBase', 'admin')))",
}
TEMPLATE = r"(?s)^`.*\$\{"
#: Identifiers, severities, efforts, confidences and method names.
CHAIN_RULES = (
    ChainRule("SEQ-N1-001", "high", "small", 0.90, "model", in_loop=True, last=("findByPk", "findOne")),
    ChainRule("SEQ-RAW-002", "high", "small", 0.95, "sequelize", said=(("query",), TEMPLATE)),
    ChainRule("SEQ-SAVE-003", "high", "small", 0.85, "!model", in_loop=True, last=("save", "update", "destroy")),
    ChainRule("SEQ-SYNC-004", "high", "trivial", 0.95, "sequelize", said=(("sync",), r"(?s)^(?=.*force)(?=.*true)")),
    ChainRule("MNG-POP-001", "medium", "medium", 0.80, least=("populate", 3)),
    ChainRule("MNG-N1-002", "high", "small", 0.90, "pascal", in_loop=True, last=("findById", "findOne")),
    ChainRule("MNG-LEAN-003", "low", "trivial", 0.70, in_loop=True, any_of=("toObject", "toJSON"), none_of=("lean",)),
    ChainRule("MNG-RAW-004", "high", "small", 0.95, said=(("find", "findOne"), r"(?s)^(?=.*\$where)(?=.*\$\{)")),
    ChainRule("GORM-N1-001", "high", "small", 0.90, "handle", in_loop=True, last=("First", "Take", "Last", "FirstOrInit", "FirstOrCreate")),
    ChainRule("GORM-RAW-002", "high", "small", 0.95, said=(("Raw", "Exec"), r'fmt\.Sprint|" \+ | \+ "')),
    ChainRule("GORM-AUTO-003", "high", "medium", 0.95, "handle", last=("AutoMigrate",)),
    ChainRule("GORM-SAVE-004", "high", "small", 0.90, "handle", in_loop=True, last=("Create", "Save", "Update", "Updates")),
    ChainRule("TO-N1-001", "high", "small", 0.90, "repository", in_loop=True, last=("findOne", "findOneBy", "findOneByOrFail")),
    ChainRule("TO-QB-003", "high", "small", 0.95, all_of=("createQueryBuilder",), said=(("where", "andWhere", "orWhere"), TEMPLATE)),
    ChainRule("TO-SYNC-004", "high", "small", 0.95, all_of=("DataSource",), said=((), r"(?s)^(?=.*synchronize)(?=.*true)")),
    ChainRule("PRI-N1-002", "high", "small", 0.90, "prisma", in_loop=True, last=("findUnique", "findFirst")),
    ChainRule("PRI-RAW-003", "high", "small", 0.95, said=(("$queryRawUnsafe", "$executeRawUnsafe"), rf"{TEMPLATE}| \+ ")),
    ChainRule("PRI-PAG-004", "medium", "medium", 0.95, "prisma", said=(("findMany", "findFirst"), r"^(?:(?!skip)[\s\S])*skip[:\s]*0*[1-9][0-9]{3}")),
    ChainRule("DRZ-LMT-001", "medium", "trivial", 0.90, "drizzle", all_of=("limit",), none_of=("orderBy",)),
    ChainRule("DRZ-N1-002", "high", "small", 0.85, "drizzle", in_loop=True, all_of=("select", "where")),
)


def chain_findings(chains: DataFrame, rules: tuple[ChainRule, ...] = CHAIN_RULES) -> DataFrame:
    """Rows (chain, rule, severity, effort, confidence) of the rules that fire on chains, all in one projection.

    chains: (chain, root_kind, root, methods, args, in_loop), args an array of the arguments' texts for each method.
    """
    base = chains.select("chain", F.when(F.col("root_kind") == "name", F.col("root")).alias("name"), F.array_compact(F.coalesce("methods", F.array().cast("array<string>"))).alias("methods"), F.arrays_zip("methods", "args").alias("steps"), F.coalesce("in_loop", F.lit(False)).alias("in_loop"))
    base = base.select("*", F.get("methods", F.lit(0)).alias("first"), F.when(F.size("methods") > 0, F.element_at("methods", -1)).alias("last"))
    base = base.select("*", *[F.coalesce(F.expr(sql), F.lit(False)).alias(f"is_{name}") for name, sql in GUARDS.items()])

    def names(values: tuple[str, ...]) -> Column:
        return F.array(*[F.lit(v) for v in values])

    def told(methods: tuple[str, ...], pattern: str) -> Column:
        def step(x: Column) -> Column:
            own = F.exists(F.coalesce(x["args"], F.array().cast("array<string>")), lambda a: F.coalesce(a.rlike(pattern), F.lit(False)))
            return own & F.coalesce(x["methods"].isin(*methods), F.lit(False)) if methods else own

        return F.coalesce(F.exists("steps", step), F.lit(False))

    def fires(r: ChainRule) -> Column:
        tests = [F.col("in_loop")] if r.in_loop else []
        if r.guard:
            own = F.col(f"is_{r.guard.lstrip('!')}")
            tests.append(~own if r.guard.startswith("!") else own)
        if r.last:
            tests.append(F.coalesce(F.col("last").isin(*r.last), F.lit(False)))
        tests += [F.array_contains("methods", m) for m in r.all_of]
        if r.any_of:
            tests.append(F.arrays_overlap("methods", names(r.any_of)))
        if r.none_of:
            tests.append(~F.arrays_overlap("methods", names(r.none_of)))
        if r.least:
            tests.append(F.size(F.filter("methods", lambda m: m == r.least[0])) >= r.least[1])
        if r.said:
            tests.append(told(*r.said))
        return reduce(lambda a, b: a & b, tests)

    found = [F.when(fires(r), F.struct(F.lit(r.id).alias("rule"), F.lit(r.severity).alias("severity"), F.lit(r.effort).alias("effort"), F.lit(r.confidence).alias("confidence"))) for r in rules]
    return base.select("chain", F.explode(F.array_compact(F.array(*found))).alias("f")).select("chain", "f.*")


# ---- dialects
@dataclass(frozen=True)
class Statement:
    """What a dialect predicts of a chain."""

    op: str  # select, insert, update, delete
    target: str
    projection: str = "unspecified"  # full, unspecified, columns, aggregate
    has_where: bool = False
    ordered: bool = False
    limit: int | None = None
    offset: int | None = None
    fidelity: str = "skeletal"  # concrete, partial, skeletal


class Dialect:
    """One mapper: whether a chain is of it, and the statements that the chain stands for."""

    orm = ""

    def matches(self, root_kind: str, root: str, methods: list[str]) -> bool:
        raise NotImplementedError

    def predict(self, root: str, methods: list[str], args: list[str]) -> Iterable[Statement]:
        raise NotImplementedError


class ModelCalls(Dialect):
    """Calls of a model class: User.findAll(), User.findOne(), User.bulkCreate()."""

    orm = "sequelize"
    OPS = {"findAll": "select", "findOne": "select", "findByPk": "select", "count": "select", "create": "insert", "bulkCreate": "insert", "update": "update", "destroy": "delete"}

    def matches(self, root_kind, root, methods):
        return root_kind != "unknown" and root[:1].isupper() and methods[-1] in self.OPS

    def predict(self, root, methods, args):
        yield Statement(self.OPS[methods[-1]], root.lower())


class HandleCalls(Dialect):
    """Chains of a handle: db.Where(..).Limit(10).Find(..); literals of limits and offsets are known."""

    orm = "gorm"
    OPS = {"First": "select", "Take": "select", "Last": "select", "Find": "select", "Scan": "select", "Pluck": "select", "Update": "update", "Updates": "update", "Delete": "delete", "Unscoped": "delete"}

    def matches(self, root_kind, root, methods):
        return root_kind != "unknown" and root in ("db", "tx") and methods[-1] in self.OPS

    def predict(self, root, methods, args):
        def number(name: str) -> int | None:
            said = next((a for m, a in zip(methods, args) if m == name), None)
            return int(said) if said and said.isdigit() else None

        limit = 1 if methods[-1] in ("First", "Take", "Last") else number("Limit")
        yield Statement(self.OPS[methods[-1]], "", "unspecified", "Where" in methods, "Order" in methods or methods[-1] in ("First", "Last"), limit, number("Offset"), "partial" if any(args) else "skeletal")


PREDICTED = "orm string, op string, target string, projection string, has_where boolean, ordered boolean, limit_n long, offset_n long, fidelity string"


def register(spark: SparkSession, dialects: list[Dialect], name: str = "predict_sql") -> str:
    """Registers the dialects as a table function of (root_kind, root, methods, args), for lateral joins in SQL."""
    from pyspark.sql.functions import udtf

    class Predict:
        def eval(self, root_kind: str, root: str, methods: list, args: list):
            if not methods or root is None or root_kind is None:
                return
            said = [a or "" for a in args or []]
            said += [""] * (len(methods) - len(said))
            for d in dialects:
                if d.matches(root_kind, root, methods):
                    for s in d.predict(root, methods, said):
                        yield d.orm, s.op, s.target, s.projection, s.has_where, s.ordered, s.limit, s.offset, s.fidelity

    spark.udtf.register(name, udtf(Predict, returnType=PREDICTED))
    return name


def predicted(chains: DataFrame, dialects: list[Dialect]) -> DataFrame:
    """The chains (with `args`, a text for each method) with every statement that a dialect predicts, by a lateral join."""
    spark = chains.sparkSession
    name = register(spark, dialects, f"predict_{uuid.uuid4().hex}")
    return spark.sql(f"SELECT c.*, p.* FROM {{chains}} c, LATERAL {name}(c.root_kind, c.root, c.methods, c.args) p", chains=chains)


# ---- rules over predicted statements
#: What a rule's confidence counts at each fidelity: concrete, partial, skeletal.
WEIGHTS = {"default": (1.0, 0.6, 0.3), "literal": (1.0, 0.3, 0.05), "cardinality": (1.0, 0.5, 0.1), "shape": (1.0, 0.8, 0.5)}


@dataclass(frozen=True)
class StatementRule:
    id: str
    severity: str
    effort: str
    confidence: float
    weight: str
    condition: str  # over the columns of `features`


#: Identifiers, severities, efforts and confidences.
STATEMENT_RULES = (
    StatementRule("SQLIR-001", "medium", "small", 0.85, "shape", "op = 'select' AND projection = 'full'"),
    StatementRule("SQLIR-002", "high", "small", 0.95, "shape", "op IN ('update', 'delete') AND n_predicates = 0"),
    StatementRule("SQLIR-003", "low", "small", 0.80, "shape", "op = 'insert' AND projection = 'full'"),
    StatementRule("SQLIR-004", "high", "small", 0.95, "literal", "leading_wildcard"),
    StatementRule("SQLIR-005", "medium", "small", 0.85, "shape", "limited AND n_orders = 0"),
    StatementRule("SQLIR-006", "low", "medium", 0.65, "default", "has_or"),
    StatementRule("SQLIR-007", "medium", "medium", 0.70, "default", "has_function"),
    StatementRule("SQLIR-008", "low", "medium", 0.75, "shape", "depth > 3"),
    StatementRule("SQLIR-009", "high", "medium", 0.95, "shape", "has_cartesian OR (n_tables > 1 AND n_predicates = 0 AND n_joins = 0)"),
    StatementRule("SQLIR-010", "medium", "small", 0.80, "shape", "op = 'update' AND NOT limited"),
    StatementRule("SQLIR-011", "high", "medium", 0.85, "cardinality", "projection = 'aggregate' AND contains(projection_text, '_per_outer_row_')"),
    StatementRule("SQLIR-012", "medium", "small", 0.85, "shape", "op = 'select' AND n_predicates = 0 AND NOT limited"),
    StatementRule("SQLIR-013", "high", "medium", 0.95, "literal", "offset_n >= 1000"),
    StatementRule("SQLIR-014", "high", "medium", 0.95, "shape", "has_bare_join"),
)


def features(statements: DataFrame, tables: DataFrame, joins: DataFrame, predicates: DataFrame, orders: DataFrame) -> DataFrame:
    """The statements (stmt, op, projection, projection_text, limited, offset_n, fidelity, ...) with what rules ask of their parts.

    tables: a row (stmt) each; joins: (stmt, kind, has_on); predicates: nodes (stmt, level, kind, value, variable) of the condition's tree, the
    root at level 1; orders: (stmt). All parts are one table, so one aggregate by statement is the only exchange beside the join.
    """
    none = {"is_table": False, "is_join": False, "is_order": False, "level": 0, "wildcard": False, "is_or": False, "is_function": False, "cartesian": False, "bare": False}

    def part(df: DataFrame, **own: Column) -> DataFrame:
        return df.select("stmt", *[F.coalesce(own[c], F.lit(v)).alias(c) if c in own else F.lit(v).alias(c) for c, v in none.items()])

    kind = F.col("kind")
    parts = part(tables, is_table=F.lit(True))
    parts = parts.unionByName(part(joins, is_join=F.lit(True), cartesian=kind == "cartesian", bare=(kind != "cartesian") & ~F.col("has_on")))
    parts = parts.unionByName(part(predicates, level=F.col("level").cast("int"), wildcard=(kind == "like") & ~F.col("variable") & F.col("value").startswith("%"), is_or=kind == "or", is_function=kind == "function"))
    parts = parts.unionByName(part(orders, is_order=F.lit(True)))

    def n(c: str) -> Column:
        return F.count(F.when(F.col(c), 1))

    found = parts.groupBy("stmt").agg(
        n("is_table").alias("n_tables"),
        n("is_join").alias("n_joins"),
        n("is_order").alias("n_orders"),
        F.count(F.when(F.col("level") > 0, 1)).alias("n_predicates"),
        F.max("level").alias("depth"),
        *[F.bool_or(c).alias(a) for c, a in (("wildcard", "leading_wildcard"), ("is_or", "has_or"), ("is_function", "has_function"), ("cartesian", "has_cartesian"), ("bare", "has_bare_join"))],
    )
    counts = ("n_tables", "n_joins", "n_orders", "n_predicates", "depth")
    flags = ("leading_wildcard", "has_or", "has_function", "has_cartesian", "has_bare_join")
    return statements.join(found, "stmt", "left").withColumns({**{c: F.coalesce(c, F.lit(0)) for c in counts}, **{c: F.coalesce(c, F.lit(False)) for c in flags}})


def statement_findings(featured: DataFrame, rules: tuple[StatementRule, ...] = STATEMENT_RULES) -> DataFrame:
    """Rows (stmt, rule, severity, effort, confidence) of the rules that fire, all in one projection over `features`."""

    def confidence(r: StatementRule) -> Column:
        concrete, partial, skeletal = WEIGHTS[r.weight]
        by = F.when(F.col("fidelity") == "concrete", concrete).when(F.col("fidelity") == "partial", partial).otherwise(skeletal)
        return F.least(F.greatest(F.lit(r.confidence) * by, F.lit(0.0)), F.lit(1.0))

    fired = [F.when(F.coalesce(F.expr(r.condition), F.lit(False)), F.struct(F.lit(r.id).alias("rule"), F.lit(r.severity).alias("severity"), F.lit(r.effort).alias("effort"), confidence(r).alias("confidence"))) for r in rules]
    return featured.select("stmt", F.explode(F.array_compact(F.array(*fired))).alias("f")).select("stmt", "f.*")


def in_ranges(statements: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows (stmt, in_loop, in_await) by the place (file, pos) of statements; ranges: (range, kind, file, s, e), kind loop or await."""
    points = statements.select(F.col("stmt").alias("point"), "file", "pos")
    out = statements.select("stmt")
    for kind in ("loop", "await"):
        hit = innermost(points, ranges.filter(F.col("kind") == kind).select("range", "file", "s", "e")).filter("range is not null")
        out = out.join(hit.select(F.col("point").alias("stmt"), F.lit(True).alias(f"in_{kind}")).distinct(), "stmt", "left")
    return out.select("stmt", *[F.coalesce(f"in_{k}", F.lit(False)).alias(f"in_{k}") for k in ("loop", "await")])


# ---- relations followed
def prefix_tree(paths: DataFrame) -> DataFrame:
    """The tree's edges (source, tree, parent, segment, node) of paths (source, tree, path), `a__b__c`; a node is its path from the root, the empty one."""
    parts = paths.filter(F.length("path") > 0).select("source", "tree", F.split("path", "__").alias("p"))
    steps = parts.select("source", "tree", "p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("n"))
    node = F.array_join(F.slice("p", F.lit(1), F.col("n")), "__")
    parent = F.array_join(F.slice("p", F.lit(1), F.col("n") - 1), "__")
    return steps.select("source", "tree", parent.alias("parent"), F.get("p", F.col("n") - 1).alias("segment"), node.alias("node")).distinct()


def prefetch_verdicts(chains: DataFrame, sources: DataFrame, paths: DataFrame, fields: DataFrame) -> DataFrame:
    """Rows (chain, pos, field) of the chains whose step at `pos` follows a relation that was not loaded before: the first such step.

    chains: (chain, source, path array); sources: (source, model, values_only); paths: (source, tree, path), the trees prefetched and selected; fields:
    (model, field, target, scalar), the workspace's models. A step is safe if either tree has it below the node reached so far; a plain column, or a
    relation of unknown target, ends the walk. Chains of one source and path fare alike, so each such pair walks once and chains are joined to its end. All
    pairs take a step together in a round of joins; who is decided leaves, so rounds are as many as the longest walk has steps.
    """
    tree = settle(prefix_tree(paths))
    fields = settle(fields.select("model", "field", "target", "scalar").distinct())
    known = not fields.isEmpty()
    chains = chains.select("chain", "source", "path").filter("size(path) > 0")
    ahead = chains.select("source", "path").distinct().join(sources, "source").filter("not coalesce(values_only, false)")
    state = settle(ahead.select("source", F.col("model").alias("at"), "path", F.lit(0).alias("pos"), F.lit("").alias("prefetched"), F.lit("").alias("selected")))
    found = state.select("source", "path", "pos", F.lit("").alias("field")).limit(0)
    while not state.isEmpty():
        step = state.withColumn("segment", F.get("path", F.col("pos")))
        for t in ("prefetched", "selected"):
            below = tree.filter(F.col("tree") == t).select("source", F.col("parent").alias(t), "segment", F.col("node").alias(f"_{t}"))
            step = step.join(below, ["source", t, "segment"], "left")
        step = step.join(fields.select(F.col("model").alias("at"), F.col("field").alias("segment"), F.col("target").alias("_target"), "scalar"), ["at", "segment"], "left")
        covered = F.col("_prefetched").isNotNull() | F.col("_selected").isNotNull()
        modelled = F.lit(known) & F.col("at").isNotNull()
        plain = modelled & F.coalesce("scalar", F.lit(False))
        step = settle(step.withColumns({"_bad": ~plain & ~covered, "_on": modelled & ~plain & covered & F.col("_target").isNotNull() & (F.col("pos") + 1 < F.size("path"))}))
        found = found.union(step.filter("_bad").select("source", "path", "pos", F.col("segment").alias("field")))
        state = step.filter("_on").select("source", F.col("_target").alias("at"), "path", (F.col("pos") + 1).alias("pos"), *[F.coalesce(f"_{t}", t).alias(t) for t in ("prefetched", "selected")])
    return chains.join(found, ["source", "path"]).select("chain", "pos", "field")
