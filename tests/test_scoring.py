import json

import pytest
from pyspark.sql import functions as F

from querygavel.operators.class_counts import Limits
from querygavel.operators.scoring import class_maps, score_candidates, with_metrics_json
from querygavel.plans.batch import score_completions, score_file

TEXTS = {
    "all": "select * from t",
    "semicolons": "select * from t;;",
    "semicolon and space": "select * from t; ",
    "both": "select * from t where KIND = 'bad'",
    "value": "select *, 'BAD' as x from t",
    "leak before error": "selec 'kind bad'",
    "column only": "select * from t where kind <> 'good'",
    "parse": "selec *",
    "no label": "select id from t",
    "two labels": "select *, 'x' as Kind from t",
    "empty": "select * from t where 1 = 0",
    "repeated": "select * from t where id < 3 union all select * from t where id < 3",
    "runtime": "select * from t where cast(name as int) = id",
    "runtime division": "select * from t where 1 / (id - 1) > 0",
    "command": "drop view t",
    "insert": "with a as (select * from t) insert into t select * from a",
    "file": "select kind from parquet.`/tmp`",
    "calls": "select *, reflect('java.lang.System', 'nanoTime') as r from t",
    "other": "select * from hidden",
    "null class": "select id, cast(null as string) as kind from t where id < 2",
    "number label": "select id as kind from t",
    "quoted": 'select * from t where "id" < 3',
    "blank": " \n",
}


@pytest.fixture(scope="module")
def t(spark):
    rows = [(i, "bad" if i < 3 else "good", f"n{i}") for i in range(10)]
    df = spark.createDataFrame(rows, "id long, kind string, name string")
    df.createOrReplaceTempView("hidden")
    return df


def candidates(spark, texts, label="kind", value="bad", target="3", total="10"):
    rows = [(name, sql, label, value, target, total) for name, sql in texts.items()]
    return spark.createDataFrame(
        rows,
        "candidate_id string, sql string, label_col string, positive_value string, target_rows string, total_rows string",
    )


@pytest.fixture(scope="module")
def scored(spark, t):
    return score_candidates(candidates(spark, TEXTS), {"t": t}, limits=Limits(queries_per_job=8))


def test_outcomes(scored):
    got = {r.candidate_id: r for r in scored.records.collect()}
    assert set(got) == set(TEXTS)
    status = {name: r.status for name, r in got.items()}
    assert status == {
        "all": "ok", "semicolons": "ok", "semicolon and space": "parse_error", "both": "leak_both",
        "value": "leak_value", "leak before error": "leak_both", "column only": "ok",
        "parse": "parse_error", "no label": "analysis_error", "two labels": "analysis_error",
        "empty": "ok", "repeated": "ok", "runtime": "runtime_error",
        "runtime division": "runtime_error", "command": "rejected", "insert": "rejected",
        "file": "rejected", "calls": "rejected", "other": "rejected", "null class": "ok",
        "number label": "ok", "quoted": "ok", "blank": "skipped",
    }
    score = {name: r.score for name, r in got.items()}
    assert score["column only"] == 4.0 and score["quoted"] == 4.0
    assert score["both"] == -5.0 and score["value"] == -2.0 and score["leak before error"] == -5.0
    assert score["blank"] is None and score["empty"] == 0.0
    assert score["repeated"] == pytest.approx(4.428571, abs=1e-6)
    for name, value in status.items():
        if value.endswith("error") or value == "rejected":
            assert score[name] == -20.0 and got[name].f1 == -20.0 and got[name].tp == 0
    repeated = got["repeated"]
    assert (repeated.tp, repeated.fp, repeated.fn, repeated.tn, repeated.recall) == (6, 0, -3, 7, 2.0)
    assert repeated.recall_over_one and not got["all"].recall_over_one
    assert (got["empty"].fn, got["empty"].tn) == (3, 7)
    assert (got["null class"].tp, got["null class"].fp) == (0, 2)
    assert (got["number label"].tp, got["number label"].fp) == (0, 10)
    for r in got.values():
        if r.status == "ok":
            assert r.tp + r.fp + r.fn + r.tn == 10


def test_maps_and_json(scored):
    maps = {r.candidate_id: r.output for r in class_maps(scored).collect()}
    assert maps["all"] == {"bad": 3, "good": 7}
    assert maps["null class"] == {"null": 2}
    assert maps["number label"]["7"] == 1
    records = {r.candidate_id: r.metrics for r in with_metrics_json(scored).collect()}
    assert records["blank"] is None
    assert json.loads(records["both"]) == {
        "output": None, "tp": 0, "fp": 0, "tn": 0, "fn": 0, "precision": 0.0, "recall": 0.0,
        "f1": -5.0, "f2": -5.0,
    }
    assert json.loads(records["empty"])["output"] == {}
    assert json.loads(records["column only"])["f2"] == 4.0
    assert scored.class_counts.where("candidate_id = 'number label'").count() == 10


def test_counts_from_the_candidate(spark, t):
    texts = {"a": "select * from t where id < 3"}
    for target, total, status, score in [
        ("1,0", "1e1", "ok", None), (" ", "10", "null_target", -20.0), (None, "10", "null_target", -20.0),
        ("3", "many", "bad_count", -20.0),
    ]:
        row = score_candidates(candidates(spark, texts, target=target, total=total), {"t": t}).records.first()
        assert row.status == status
        if score is not None:
            assert row.score == score
        else:
            assert (row.fn, row.tn) == (7, 0)


def test_guard_failures_and_switch(spark, t):
    texts = {"a": "select * from t where kind = 'bad'"}
    missing = candidates(spark, texts, value=None)
    assert score_candidates(missing, {"t": t}).records.first().score is None
    assert score_candidates(missing, {"t": t}, on_error="penalty").records.first().score == -20.0
    assert score_candidates(candidates(spark, texts), {"t": t}, guard=False).records.first().score == 4.0


def test_label_with_space(spark, t):
    spaced = t.withColumnRenamed("kind", "the `kind`")
    row = score_candidates(
        candidates(spark, {"a": "select * from s where id < 3"}, label="the `kind`"), {"s": spaced}
    ).records.first()
    assert row.score == 4.0


CONDITIONS = {
    "low": "id < 3", "all": "true", "none": "id > 99", "null": "cast(null as boolean)", "words": "name like 'n%'",
    "sub": "id < (select avg(id) from t)", "bad cast": "cast(name as int) > 1", "parse": "id <",
    "column": "nope = 1", "escape": "id < 3) or (1 = 1", "aggregate": "count(*) > 1",
    "comment": "id < 3 -- all", "in": "id in (1, 2)", "number": "id + 1",
}


def test_conditions_equal_queries(spark, t):
    texts = {name: f"select * from t where {c}" for name, c in CONDITIONS.items() if name not in ("escape", "sub")}
    by_query = score_candidates(candidates(spark, texts), {"t": t}).records
    by_scan = score_candidates(
        candidates(spark, CONDITIONS), table=t, limits=Limits(conditions_per_job=5, parallel_jobs=2)
    ).records
    columns = ("status", "tp", "fp", "tn", "fn", "score")
    queries = {r.candidate_id: tuple(r[c] for c in columns) for r in by_query.collect()}
    scans = {r.candidate_id: tuple(r[c] for c in columns) for r in by_scan.collect()}
    assert {name: scans[name] for name in queries} == queries
    assert scans["low"][-1] == 4.0
    assert scans["escape"][0] == "parse_error"
    assert scans["sub"][0] == "rejected"  # conditions may only read their own table


def test_copies_run_once_and_all_score(spark, t):
    base = candidates(spark, {"x": "select * from t where id < 3"})
    many = base.crossJoin(spark.range(500)).withColumn("candidate_id", F.col("id").cast("string"))
    rows = score_candidates(many, {"t": t})
    assert rows.records.groupBy("score").count().collect() == [(4.0, 500)]


def test_timeout(spark, t):
    slow = (
        "select a.* from t a join (select max(java_len) as m from (select length(repeat(cast(r.id as string), 50))"
        " as java_len from range(0, 4000000000) r)) b on a.id < b.m"
    )
    texts = {"slow": slow, "quick": "select * from t where id < 3"}
    rows = score_candidates(candidates(spark, texts), {"t": t}, limits=Limits(seconds_per_job=6)).records
    assert {r.candidate_id: (r.status, r.score) for r in rows.collect()} == {
        "slow": ("timeout", -20.0), "quick": ("ok", 4.0)
    }


def test_settings_are_restored(spark, t):
    before = spark.conf.get("spark.sql.ansi.doubleQuotedIdentifiers")
    score_candidates(candidates(spark, {"a": "select * from t"}), {"t": t}).records.count()
    assert spark.conf.get("spark.sql.ansi.doubleQuotedIdentifiers") == before
    assert not spark.catalog.tableExists("t")
    assert spark.catalog.tableExists("hidden")


def test_completions(spark, t):
    rows = [
        ("fenced", [("```sql\nselect * from t where id < 3\n```",)]), ("plain", [("\n select * from t where id < 3 ; ",)]),
        ("blank", [(" ",)]), ("nothing", []),
    ]
    df = spark.createDataFrame(rows, "candidate_id string, completion array<struct<content:string>>").withColumns(
        {"column": F.lit("kind"), "value": F.lit("bad"), "target_score": F.lit(3), "total_rows": F.lit(10)}
    )
    got = {r.candidate_id: r.score for r in score_completions(df, {"t": t}).records.collect()}
    assert got == {"fenced": -20.0, "plain": 4.0, "blank": -20.0, "nothing": -20.0}
    got = {r.candidate_id: r.score for r in score_completions(df, {"t": t}, fences=True).records.collect()}
    assert got["fenced"] == 4.0


def test_score_file(spark, t, tmp_path):
    lines = [
        "Output,Column,Attack Type,Expected Rows,Total Rows,Note",
        '"select *\nfrom t where ""id"" < 3",kind,bad,"3","1,0",first',
        "NA,kind,bad,3,10,second",
        "select * from t where 1 = 0,kind,bad,3.0,10,third",
        "select * from t,NaN,bad,3,10,fourth",
    ]
    path = tmp_path / "in.csv"
    path.write_text("\n".join(lines) + "\n")
    out = score_file(spark, str(path), {"t": t})
    assert out == str(tmp_path / "in_scored.csv")
    back = spark.read.options(header=True, multiLine=True, escape='"').csv(out)
    got = {r.Note: (r.Score, r.Metrics) for r in back.collect()}
    assert got["first"][0] == "4.0" and json.loads(got["first"][1])["output"] == {"bad": 3}
    assert got["second"] == (None, None)
    assert got["third"][0] == "0.0"
    assert got["fourth"][0] is None and json.loads(got["fourth"][1])["f2"] is None


def test_views_of_the_caller_survive(spark, t):
    spark.range(3).createOrReplaceTempView("t")
    try:
        score_candidates(candidates(spark, {"a": "select * from t"}), {"t": t}).records.collect()
        assert spark.table("t").count() == 3 and spark.table("t").columns == ["id"]
    finally:
        spark.catalog.dropTempView("t")


def test_maps_of_many_classes(spark):
    wide = spark.range(10_050).select(F.col("id").cast("string").alias("kind"))
    scored = score_candidates(candidates(spark, {"a": "select * from w"}), {"w": wide})
    assert len(class_maps(scored).first().output) == 10_050
