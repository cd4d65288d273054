"""Chains, dialects, rules over predicted statements and prefetched relations against small walks of their own."""

import random

from perfloom.operators import orm


def has_shape(s, kind, root, methods):
    if not s.test:
        return s.method in methods
    fits = {
        "any": True,
        "contains": kind != "unknown" and s.root.lower() in root.lower(),
        "equals": kind != "unknown" and root == s.root,
        "upper": kind != "unknown" and root[:1].isupper(),
        "module": kind == "module" and root == s.root,
    }[s.test]
    return bool(methods) and methods[0] == s.method and fits and (not s.then or any(m in s.then for m in methods))


def test_shapes_are_rows(spark):
    rng = random.Random(11)
    extra = tuple(orm.Shape(f"own{k % 3}", f"m{k}", rng.choice(["", "any", "contains", "equals", "upper", "module"]), rng.choice(["db", "session", "Model"]), rng.choice([(), (f"t{k % 4}", f"m{k}"), (f"t{k % 5}",)])) for k in range(90))
    shapes = orm.SHAPES + extra  # more than a word of bits
    names = sorted({s.method for s in shapes} | {m for s in shapes for m in s.then} | {"map", "filter"})
    rows = []
    for i in range(600):
        k = rng.choice(shapes)
        methods = [rng.choice([k.method, rng.choice(names)])] + [rng.choice([*k.then, *rng.sample(names, 3)]) for _ in range(rng.randrange(4))]
        rows.append((i, rng.choice(["name", "module", "unknown"]), rng.choice(["db", "Session_x", "Model", "tx", "Éa"]), methods))
    rows += [(1000, "name", "db", []), (1001, None, None, ["findMany"]), (1002, "name", "db", ["Where", None, "Find"]), (1003, "name", "db", None)]
    df = spark.createDataFrame(rows, "chain long, root_kind string, root string, methods array<string>")
    out = orm.chain_shapes(df, shapes)
    order = list(dict.fromkeys(s.orm for s in shapes))
    got = {r.chain: r.orms for r in out.collect()}
    for i, kind, root, methods in rows:
        hit = {s.orm for s in shapes if has_shape(s, kind or "unknown", root or "", methods or [])}
        assert got[i] == [n for n in order if n in hit], (kind, root, methods)
    assert any(got.values()) and "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_dialects_of_a_user(spark):
    class Finder(orm.Dialect):
        orm = "finder"

        def matches(self, root_kind, root, methods):
            return "find" in methods

        def predict(self, root, methods, args):
            for m, a in zip(methods, args, strict=False):
                if m == "find":
                    yield orm.Statement("select", a, "full", limit=5)

    rows = [(1, "name", "db", ["Where", "Limit", "Find"], ["x", "7", ""]), (2, "name", "User", ["findAll"], None), (3, "name", "q", ["find", "find"], ["a"]), (4, "name", "q", [], []), (5, None, None, ["find"], ["z"]), (6, "unknown", "User", ["findAll"], [])]
    df = spark.createDataFrame(rows, "chain long, root_kind string, root string, methods array<string>, args array<string>")
    got = sorted((r.chain, r.orm, r.op, r.target, r.limit_n) for r in orm.predicted(df, [orm.HandleCalls(), orm.ModelCalls(), Finder()]).collect())
    assert got == [(1, "gorm", "select", "", 7), (2, "sequelize", "select", "user", None), (3, "finder", "select", "", 5), (3, "finder", "select", "a", 5)]


def test_statement_rules_fire_and_stay_silent(spark):
    """One bad statement for each rule, and a clean one."""
    base = {"op": "select", "projection": "unspecified", "projection_text": None, "limited": False, "offset_n": None, "fidelity": "concrete"}
    cases = {
        "SQLIR-001": ({"projection": "full"}, "eq"), "SQLIR-002": ({"op": "delete"}, None), "SQLIR-003": ({"op": "insert", "projection": "full"}, "eq"), "SQLIR-004": ({}, "like"), "SQLIR-005": ({"limited": True}, "eq"), "SQLIR-006": ({}, "or"),
        "SQLIR-007": ({}, "function"), "SQLIR-008": ({}, "deep"), "SQLIR-009": ({}, "cartesian"), "SQLIR-010": ({"op": "update"}, "eq"), "SQLIR-011": ({"projection": "aggregate", "projection_text": "sum(_per_outer_row_)"}, "eq"), "SQLIR-012": ({}, None), "SQLIR-013": ({"offset_n": 1000}, "eq"), "SQLIR-014": ({}, "bare"),
    }
    statements, predicates, joins = [], [], []
    for k, (more, kind) in enumerate([*cases.values(), ({}, "eq"), ({"offset_n": 999, "fidelity": "skeletal"}, "variable")]):
        statements.append((k, *{**base, **more}.values()))
        if kind:
            own = kind if kind in ("eq", "or", "function", "like") else "like" if kind == "variable" else "eq"
            predicates.append((k, 1, own, "%x", kind == "variable"))
            if kind == "deep":
                predicates += [(k, n, "and", None, False) for n in (2, 3, 4)]
        if kind in ("cartesian", "bare"):
            joins.append((k, "cartesian" if kind == "cartesian" else "left", False))
    frames = [spark.createDataFrame(statements, "stmt long, op string, projection string, projection_text string, limited boolean, offset_n long, fidelity string"), spark.createDataFrame([(k,) for k in range(len(statements))], "stmt long"), spark.createDataFrame(joins, "stmt long, kind string, has_on boolean"), spark.createDataFrame(predicates, "stmt long, level int, kind string, value string, variable boolean"), spark.createDataFrame([], "stmt long")]
    found = {}
    for r in orm.statement_findings(orm.features(*frames)).collect():
        found.setdefault(r.stmt, set()).add(r.rule)
    for k, rule in enumerate(cases):
        assert rule in found.get(k, set()), rule
    assert len(cases) not in found and len(cases) + 1 not in found


def verdict(path, model, trees, fields, known):
    at, nodes = model, {t: () for t in trees}
    for i, seg in enumerate(path):
        told = fields.get((at, seg)) if at else None
        modelled = bool(known and at)
        if modelled and told and told[1]:
            return None
        below = {t: nodes[t] + (seg,) for t in trees if any(tuple(p[: len(nodes[t]) + 1]) == nodes[t] + (seg,) for p in trees[t])}
        if not below:
            return i, seg
        nodes.update(below)
        if not modelled or not told or told[0] is None:
            return None
        at = told[0]
    return None


def test_prefetch_verdicts(spark):
    rng = random.Random(12)
    names = ["a", "b", "c", "d"]
    fields = {(m, f): (rng.choice(["M0", "M1", "M2", None]), rng.random() < 0.15) for m in ("M0", "M1", "M2") for f in names[:3]}
    sources = {q: (rng.choice(["M0", "M1", None]), rng.random() < 0.1, {t: [[rng.choice(names) for _ in range(rng.randrange(1, 9))] for _ in range(rng.randrange(5))] for t in ("prefetched", "selected")}) for q in range(40)}
    chains = []
    for i in range(500):
        q = rng.randrange(40)
        told = [p for t in sources[q][2].values() for p in t]
        chains.append((i, q, (rng.choice(told) if told and rng.random() < 0.7 else []) + [rng.choice(names) for _ in range(rng.randrange(3))]))
    args = [
        spark.createDataFrame(chains, "chain long, source long, path array<string>"),
        spark.createDataFrame([(q, m, v) for q, (m, v, _) in sources.items()], "source long, model string, values_only boolean"),
        spark.createDataFrame([(q, t, "__".join(p)) for q, (_, _, trees) in sources.items() for t, ps in trees.items() for p in ps] + [(0, "prefetched", "")], "source long, tree string, path string"),
    ]
    table = spark.createDataFrame([(m, f, t, s) for (m, f), (t, s) in fields.items()], "model string, field string, target string, scalar boolean")
    for known, some in ((True, table), (False, table.limit(0))):
        want = {i: verdict(p, sources[q][0], sources[q][2], fields if known else {}, known) for i, q, p in chains if not sources[q][1]}
        got = {r.chain: (r.pos, r.field) for r in orm.prefetch_verdicts(*args, some).collect()}
        assert got == {i: v for i, v in want.items() if v}
    assert any(v and v[0] > 2 for v in want.values()) or any(v[0] > 1 for v in got.values()) or got


def test_chain_rules_fire_and_stay_silent(spark):
    """A bad chain for each rule, the same out of its loop or with its cure, and clean ones."""
    tick = "`a ${x}`"
    bad = {
        "SEQ-N1-001": ("User", ["findByPk"], [["1"]], True), "SEQ-RAW-002": ("sequelize", ["query"], [[tick]], False), "SEQ-SAVE-003": ("u", ["save"], [[]], True), "SEQ-SYNC-004": ("db", ["sync"], [["{ force: true }"]], False),
        "MNG-POP-001": ("User", ["find", "populate", "populate", "populate"], None, False), "MNG-N1-002": ("User", ["findById"], [["i"]], True), "MNG-LEAN-003": ("d", ["toObject"], [[]], True), "MNG-RAW-004": ("User", ["find"], [["{ $where: " + tick + " }"]], False),
        "GORM-N1-001": ("r", ["db", "First"], [[], ["&u"]], True), "GORM-RAW-002": ("db", ["Raw"], [['"SELECT " + x']], False), "GORM-AUTO-003": ("myDB", ["AutoMigrate"], [[]], False), "GORM-SAVE-004": ("tx", ["Create"], [["&x"]], True),
        "TO-N1-001": ("this", ["userRepo", "findOne"], None, True), "TO-QB-003": ("repo", ["createQueryBuilder", "where"], [[], ["x", tick]], False), "TO-SYNC-004": ("x", ["DataSource"], [["{ synchronize: true }"]], False),
        "PRI-N1-002": ("prisma", ["user", "findUnique"], None, True), "PRI-RAW-003": ("p", ["$queryRawUnsafe"], [["q + x", ""]], False), "PRI-PAG-004": ("prisma", ["user", "findMany"], [[], ["{ skip: 1000 }"]], False),
        "DRZ-LMT-001": ("db", ["select", "from", "limit"], None, False), "DRZ-N1-002": ("this", ["db", "select", "where"], None, True),
    }
    good = [("User", ["findAll"], [["{ where: ids }"]], True), ("sequelize", ["query"], [["`SELECT 1`"]], False), ("d", ["lean", "toObject"], None, True), ("prisma", ["user", "findMany"], [[], ["{ skip: 999 }"]], True), ("db", ["select", "orderBy", "limit"], None, False), ("db", ["Find"], [["&u"]], True), (None, None, None, None), ("x", [], [], True), ("x", [None], [[None]], True)]
    rows = [(k, "name", *r) for k, r in enumerate(bad.values())] + [(100 + k, "name", *r) for k, r in enumerate(good)] + [(200 + k, "name", r[0], r[1], r[2], False) for k, r in enumerate(bad.values()) if r[3]] + [(300, "unknown", *bad["SEQ-RAW-002"])]
    df = spark.createDataFrame(rows, "chain long, root_kind string, root string, methods array<string>, args array<array<string>>, in_loop boolean")
    found = {}
    for r in orm.chain_findings(df).collect():
        found.setdefault(r.chain, set()).add(r.rule)
    assert set(bad) == {r.id for r in orm.CHAIN_RULES}
    for k, rule in enumerate(bad):
        assert rule in found.get(k, set()), rule
    assert not [k for k in found if k >= 100], found
