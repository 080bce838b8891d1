import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from querygavel.functions.categories import KEPT_CATEGORIES, keep_categories
from querygavel.functions.tokens import tokenizer_count
from querygavel.operators.chats import chat_lengths
from querygavel.plans.corpus import build_corpus
from querygavel.plans.prompts import build_prompts, prompt_rows
from querygavel.session import scratch_path, shared_root
from querygavel.sources.candidates import read_candidates, read_prompt_rows, read_table_csv
from querygavel.sources.reward_log import numbered_lines, reward_curve, run_statistics
from querygavel.sources.sinks import scored_name, write_json, write_scored
from querygavel.sources.tables import open_table, read_corpus
from querygavel.streaming.arriving import score_arrivals


def test_categories(spark):
    assert len(KEPT_CATEGORIES) == len(set(KEPT_CATEGORIES)) == 76
    df = spark.createDataFrame([("sql/aggregates",), ("sql/other",), (None,)], "category string")
    assert keep_categories(df).count() == 1


def test_missing_columns(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("SQL Context,Question,Answer\nx,y,1\n")
    with pytest.raises(ValueError, match=r"missing required columns: \['Answer Field', 'Total Rows', 'Attack Type', 'Question Context'\]"):
        read_prompt_rows(spark, str(path))
    with pytest.raises(ValueError, match="Output"):
        read_candidates(spark, str(path))


PROMPT_CSV = """SQL Context,Question,Answer Field,Answer,Total Rows,Attack Type,Question Context
" t(a)
",  q one ,Label,12.0,100,X, about
,q two,Label,7,100,Y,
"""


def test_prompts(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text(PROMPT_CSV)
    rows = read_prompt_rows(spark, str(path))
    got = {r.value: r for r in prompt_rows(rows).collect()}
    assert got["X"].prompt[1].content == "about\nRequest:\nq one\n\nSQL Context:\n\nt(a)\n\n"
    assert got["Y"].prompt[1].content == "nan\nRequest:\nq two\n\nSQL Context:\n\nnan\n\n"
    assert (got["X"].target_score, got["X"].total_rows, got["X"].column) == (12, 100, "Label")
    assert [f.dataType.simpleString() for f in prompt_rows(rows).schema.fields] == [
        "array<struct<role:string,content:string>>", "string", "string", "bigint", "bigint"
    ]
    for bad in ("1,234", None):
        with pytest.raises(Exception):
            prompt_rows(rows.withColumn("Answer", F.lit(bad).cast("string"))).collect()


def test_prompt_plan(spark):
    rows = spark.range(100).select(
        F.col("id").alias("row"), *[F.lit("x").alias(n) for n in ("SQL Context", "Answer Field", "Attack Type", "Question Context")],
        F.repeat(F.lit("word "), F.col("id").cast("int")).alias("Question"), F.lit("1").alias("Answer"), F.lit("2").alias("Total Rows"),
    )
    training, sample = build_prompts(rows, "row")
    assert training.count() == 90 and sample.count() == 32
    training, sample = build_prompts(rows, "row", small=True)
    assert training.count() == 28 and sample.count() == 8


def test_corpus_plan(spark, tmp_path):
    rows = spark.range(1000).select(
        "id", F.when(F.col("id") % 2 == 0, "sql/aggregates").otherwise("none").alias("category"),
        F.lit("p").alias("prompt"), F.lit(" q ").alias("query"), F.lit(None).cast("string").alias("schema"),
    )
    rows.write.parquet(str(tmp_path / "corpus"))
    corpus = read_corpus(spark, str(tmp_path / "corpus"))
    assert build_corpus(corpus, "id").count() == 500
    assert build_corpus(corpus, "id", small=True).count() == 500
    assert [r.id for r in build_corpus(corpus, "id", budget=1).collect()] == [0]
    assert build_corpus(corpus, "id").first().text.endswith("Request:\np<|im_end|>q<|im_end|>")
    # One pass over the texts: no exchange but for the one-row subqueries.
    plan = build_corpus(corpus, "id")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "CartesianProduct" not in plan


def test_external_tokenizer(spark):
    rows = spark.createDataFrame(
        [(0, "sql/aggregates", "p q", "a", None), (1, "sql/aggregates", "p", "a b c", None)],
        "id long, category string, prompt string, query string, schema string",
    )
    count = tokenizer_count(lambda: str.split)
    built = {r.id: (r.n_tokens, r.text) for r in build_corpus(rows, "id", counter=count).collect()}
    assert len(built) == 2 and all(n == len(text.split()) for n, text in built.values())
    turns = spark.createDataFrame([(1, 0, "user", "a b"), (1, 1, "user", None)], "conv_id long, turn long, role string, text string")
    assert chat_lengths(turns, "x y z", count).first().n_tokens == 4 + 3 + 1


def test_reward_log_over_splits(spark, tmp_path):
    lines = [f"{(i % 7) - 5 + 0.25}, {i / 10}" for i in range(2000)]
    (tmp_path / "a.log").write_text("\n".join(lines) + "\n{'train_runtime': 12.5, 'train_loss': 0.0016, 'epoch': 214.29\n")
    (tmp_path / "b.log").write_text("\n".join(lines[:3]) + "\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        read = numbered_lines(spark, str(tmp_path))
        assert read.select("file", F.spark_partition_id()).distinct().count() > 2
        curve = reward_curve(read)
        got = sorted((r.line_no, r.reward, r.epoch) for r in curve.where("file like '%a.log'").collect())
        statistics = run_statistics(read).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert got == [(i + 1, *map(float, line.split(","))) for i, line in enumerate(lines)]
    assert [(r.line_no, r.train_runtime, r.train_loss, r.epoch, r.train_steps_per_second) for r in statistics] == [
        (2001, 12.5, 0.0016, 214.29, None)
    ]


def test_json_summary(spark, tmp_path):
    df = spark.createDataFrame([("a", float("inf")), ("b", None), ("c", 1.5)], "name string, change double")
    write_json(df, str(tmp_path / "s"))
    lines = [json.loads(x) for p in (tmp_path / "s").glob("part-*") for x in p.read_text().splitlines()]
    assert {r["name"]: (r["change"], r["change_infinite"]) for r in lines} == {
        "a": (None, True), "b": (None, False), "c": (1.5, False)
    }


def test_names_and_places(spark, tmp_path):
    assert scored_name("/x/in.csv") == "/x/in_scored.csv"
    assert scratch_path(spark, "a") != scratch_path(spark, "a")
    cluster = SimpleNamespace(conf={"spark.checkpoint.dir": str(tmp_path) + "/"})
    assert shared_root(cluster) == str(tmp_path)
    lost = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master="yarn", getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_root(lost)
    spark.range(3).write.parquet(str(tmp_path / "t"))
    open_table(spark, str(tmp_path / "t"), "opened")
    assert open_table(spark, "opened").count() == 3
    spark.catalog.dropTempView("opened")


def test_arrivals(spark, tmp_path):
    t = spark.createDataFrame([(i, "bad" if i < 3 else "good") for i in range(10)], "id long, kind string")
    place = {name: str(tmp_path / name) for name in ("in", "out", "state")}

    def arrive(start, count):
        spark.range(start, start + count).select(
            F.col("id").alias("candidate_id"),
            F.concat(F.lit("select * from t where id < "), (F.col("id") % 5).cast("string")).alias("sql"),
            F.lit("kind").alias("label_col"), F.lit("bad").alias("positive_value"),
            F.lit("3").alias("target_rows"), F.lit("10").alias("total_rows"),
        ).coalesce(1).write.mode("append").parquet(place["in"])

    def run():
        query = score_arrivals(spark, place["in"], {"t": t}, place["out"], place["state"], files_per_batch=1)
        query.awaitTermination()
        return {r.candidate_id: r.score for r in spark.read.parquet(place["out"]).collect()}

    arrive(0, 5)
    first = run()
    assert set(first) == set(range(5)) and first[3] == 4.0 and first[0] == 0.0
    assert run() == first
    arrive(5, 5)
    second = run()
    assert set(second) == set(range(10)) and spark.read.parquet(place["out"]).count() == 10


def test_cells_come_back_untouched(spark, tmp_path):
    cells = ["  lead", "trail \t", "a\r\nb ", " ; ", 'say "x" ']
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    back = read_table_csv(spark, write_scored(df, f"{tmp_path}/cells"))
    assert {int(r.i): r.c for r in back.collect()} == dict(enumerate(cells))


def test_files_with_other_headers_fail(spark, tmp_path):
    for name, text in (("a", "Output,Column\nselect 1,lab\n"), ("b", "Column,Output\nlab2,select 2\n")):
        (tmp_path / f"{name}.csv").write_text(text)
    with pytest.raises(Exception, match="(?i)header"):
        read_table_csv(spark, str(tmp_path)).collect()
