import pytest

from querygavel.plans.safety import PARSE_ERROR, REJECTED, TextGuard, candidate_settings

ALLOWED = [
    "select * from t",
    "SELECT * FROM T WHERE a IN (SELECT a FROM u)",
    "with x as (select * from t), y as (select * from x) select * from y join u on x.a = u.a",
    "with recursive n(i) as (select 1 union all select i + 1 from n where i < 3) select * from n, t",
    "from t |> where a = 1 |> aggregate count(*) group by b",
    "values (1, 'a')",
    "select * from range(3) r join t on r.id = t.a",
    "select * from t where note like '%reflect%' or identifier = 2",
    "select * from (select a from t) pivot (count(1) for a in (1, 2))",
    "select * from t tablesample (10 percent)",
    "select * from t lateral view explode(b) as x",
    "select a, sum(b) over w from t window w as (partition by a)",
    "select * from t unpivot (v for n in (a, b))",
    "select a from t group by cube(a, b) having count(*) > 1 order by 1 limit 3 offset 1",
    "(select a from t) except all (select a from u)",
]

REFUSED = [
    "drop table t", "create table x as select * from t", "insert into t select * from u",
    "with a as (select 1) insert into t select * from a", "from t insert into u select *",
    "set a = b", "cache table t", "explain select * from t", "show tables", "describe t",
    "update t set a = 1", "delete from t", "merge into t using u on t.a = u.a when matched then delete",
    "call p()", "execute immediate 'select 1'", "begin select 1; end", "use db",
    "select * from v", "select * from db.t", "select * from parquet.`/etc`",
    "with t2 as (select * from t) select * from v",
    "select * from (with v as (select 1) select * from v) x join v on true",
    "with v as (select * from v) select * from v",
    "select reflect('a', 'b') from t", "select `REFLECT`('a', 'b') from t",
    "select reflect/**/('a', 'b') from t", "select a from t where b = (select max(java_method('a', 'b')) from u)",
    "select try_reflect('a', 'b') from t", "select identifier('ref' || 'lect')('a', 'b') from t",
    "select * from identifier('v')", "select transform(a) using 'cat' as b from t",
    "select * from t positional join u", "select * from t where exists (select 1 from v)",
    "with a as (select java_method('a', 'b') from t) select * from a",
]


@pytest.fixture(scope="module")
def guard(spark):
    with candidate_settings(spark):
        yield TextGuard(spark, ["t", "u"])


@pytest.mark.parametrize("text", ALLOWED)
def test_allowed(guard, text):
    assert guard.check(text) is None


@pytest.mark.parametrize("text", REFUSED)
def test_refused(guard, text):
    assert guard.check(text) == REJECTED


@pytest.mark.parametrize("text", ["selec *", "select 1; drop table t", "select '", "select * from t) select * from v --"])
def test_unparsable(guard, text):
    assert guard.check(text) == PARSE_ERROR


@pytest.mark.parametrize(
    "text, outcome",
    [
        ("a = 1 and b like 'x%'", None), ("a = 1 -- note", None), ("extract(year from b) = 2020", None),
        ("a = 1) or (b = 2", PARSE_ERROR), ("a =", PARSE_ERROR), ("reflect('a', 'b') = 1", REJECTED),
        ("a in (select a from v)", REJECTED), ("exists (table v)", REJECTED), ("a = 1 /*", PARSE_ERROR),
    ],
)
def test_conditions(guard, text, outcome):
    assert guard.check_predicate(text) == outcome


@pytest.mark.parametrize("text", ["select /*+ BROADCAST(t) */ * from t", "select * from t, v", "select * from (table v)"])
def test_hints_and_foreign_tables(guard, text):
    assert guard.check(text) == REJECTED


def test_nothing_runs_without_a_parser():
    assert TextGuard(object(), ["t"]).check("select * from t") == REJECTED
