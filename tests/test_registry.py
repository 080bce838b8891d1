import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from querygavel.registry import REGISTERED
from tests.conftest import SMALL
from tools.check_oracle import TABLES, normal


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SMALL}/{name}.parquet')")
    return con


def test_every_query_has_a_check():
    assert all(sql for _, sql in REGISTERED.values())
    assert set(REGISTERED) <= set(queries()) and set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(REGISTERED))
def test_query_equals_sql(spark, duck, name):
    df = queries()[name](spark, SMALL)
    result = duck.execute(oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "EvalPython" not in plan and "InPandas" not in plan
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(result.fetchall(), names)


@pytest.mark.parametrize("name", ["chat_render", "asof_join", "class_capped_mix", "threshold_sweep", "prompt_p90_cut"])
def test_partitions_do_not_matter(spark, name):
    def rows(partitions):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            df = queries()[name](spark, SMALL)
            return normal([tuple(r) for r in df.collect()], df.columns)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 8)

    assert rows(2) == rows(13)
