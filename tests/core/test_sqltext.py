"""SQL lint on single texts."""

import pytest

from perfloom.functions import sqltext

CASES = {
    "select t.*, a from t": {"SQL001"},
    "select count(*) from t": set(),
    "select a from t where b = 'delete from x; select *'": set(),
    "select distinct a from t group by 1": {"SQL_DISTINCT_NO_ORDER_BY", "SQL021_GROUP_BY_ORDINAL"},
    "select a from t where a = 1 or a = 2 or a = 3": {"SQL007"},
    "select a from t where a not in (1, NULL)": {"SQL023_NOT_IN_WITH_NULL"},
    "select a from t where d->>'k' = 'v'": {"SQL025_JSON_PATH_IN_WHERE"},
    "select a from t union all select b from u": set(),
    "create index concurrently i on t (a)": set(),
    "alter table t alter column c type bigint": {"MIG_ALTER_COLUMN_TYPE"},
    "alter table t add constraint f foreign key (a) references u (a)": {"MIG_ADD_FK_NOT_VALID"},
    "alter table t add constraint f foreign key (a) references u (a) not valid": set(),
    "alter table t add column c int not null": {"MIG_ADD_COLUMN_NOT_NULL_NO_DEFAULT"},
    "alter table t add column c int not null default 0": set(),
    "drop table t": {"MIG_DROP_TABLE"},
    "$f$ drop table t $f$": set(),
    "": set(),
    "delete from t where a in (select a from u)": set(),
    "delete from t using (select a from u where b = 1) x": {"SQL002"},
    "update t set a = (select b from u where c = 1)": {"SQL003"},
    "with x as (select a from t where b = 1) select * from x": {"SQL001"},
    "select a from t where b = " + "(" * 40 + "1" + ")" * 40 + " and c in (select c from u)": set(),
    "select " + "(" * 30 + "select a from v" + ")" * 30 + " from t": {"SQL_SUB_SCALAR_IN_PROJECTION"},
}


@pytest.fixture(scope="module")
def broken(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(CASES)] + [(-1, None)], "id int, sql string")
    out = {}
    for r in sqltext.lint(df).collect():
        out.setdefault(r.id, set()).add(r.rule)
    return out


@pytest.mark.parametrize("k", range(len(CASES)))
def test_rules(broken, k):
    assert broken.get(k, set()) == list(CASES.values())[k]


def test_null_has_no_rows(broken):
    assert -1 not in broken
