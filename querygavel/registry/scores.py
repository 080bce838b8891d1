"""Registered queries: scoring of candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querygavel.functions import measures
from querygavel.functions.leak import leak_penalty
from querygavel.operators.census import threshold_sweep
from querygavel.operators.scoring import score_candidates, with_metrics_json
from querygavel.operators.summary import group_advantage, score_change, score_summary
from querygavel.plans.batch import evaluate_completions, score_completions, score_file, write_evaluation
from querygavel.registry.common import (
    ORDERS_SQL,
    TRUTH_SQL,
    measures_sql,
    number_text,
    orders_labelled,
    rounded,
    table,
    with_targets,
)
from querygavel.session import scratch_path
from querygavel.sources.candidates import read_table_csv
from querygavel.sources.sinks import write_scored
from querygavel.streaming.arriving import score_arrivals

RATES = ("precision", "recall", "f1", "weighted_f", "score")
COUNTS = ("tp", "fp", "tn", "fn")

SWEEP = [10_000.0 * i for i in range(45)] + [442_000.0, 446_000.0, 455_000.0, 470_000.0]
SWEEP_SQL = ", ".join(f"({k!r})" for k in sorted({*SWEEP}))


# Candidates made from the tables: thresholds that reach every tier.

def supplier_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.lit(300_000) + F.pmod(F.col("s_suppkey"), F.lit(1000)) * 1750
    rows = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("candidate_id"),
        F.concat(F.lit("o_totalprice >= "), number_text(k)).alias("sql"),
    )
    return with_targets(rows, orders_labelled(spark, sf_dir))


SUPPLIER_SQL = "SELECT s_suppkey AS candidate_id, 300000 + (s_suppkey % 1000) * 1750 AS k FROM supplier"

CONDITIONS_SQL = f"""
SELECT candidate_id, CAST(count(*) FILTER (WHERE band = 'HIGH') AS BIGINT) AS tp,
       CAST(count(*) FILTER (WHERE band <> 'HIGH') AS BIGINT) AS fp,
       any_value(target) AS target, any_value(total) AS total
FROM ({SUPPLIER_SQL}) CROSS JOIN ({TRUTH_SQL})
LEFT JOIN ({ORDERS_SQL}) ON o_totalprice >= k GROUP BY candidate_id
"""


def nation_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SELECT texts; some leak, some are blank or broken."""
    k = number_text(F.lit(350_000) + F.col("n_nationkey") * 5000)
    base = F.concat(F.lit("select * from orders_labelled\nwhere o_totalprice >= "), k)
    part = F.col("n_nationkey") % 12
    sql = (
        F.when(part == 1, F.concat(base, F.lit(" and BAND = 'high'")))
        .when(part == 3, F.concat(F.lit("select *, 'high' as x from orders_labelled where o_custkey < "), k))
        .when(part == 5, F.lit(" \n\t"))
        .when(part == 7, F.concat(F.lit("selec * from orders_labelled where x = "), k))
        .when(part == 8, F.concat(base, F.lit(" or false;;")))
        .when(part == 9, F.concat(base, F.lit(" union all "), base))
        .when(part == 11, F.concat(base, F.lit(" and 1 = 0")))
        .otherwise(base)
    )
    rows = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("candidate_id"), sql.alias("sql")
    )
    return with_targets(rows, orders_labelled(spark, sf_dir))


NATION_SQL = """
SELECT CAST(n_nationkey AS BIGINT) AS candidate_id, 350000 + n_nationkey * 5000 AS k,
       n_nationkey % 12 AS part FROM nation
"""

# Rows of the result of each text, with repeats.
NATION_ROWS_SQL = f"""
SELECT candidate_id, part, band, copies * n AS n FROM (
  SELECT candidate_id, part, band, CASE part WHEN 9 THEN 2 ELSE 1 END AS copies, count(*) AS n
  FROM ({NATION_SQL}) JOIN ({ORDERS_SQL})
    ON CASE WHEN part = 3 THEN o_custkey < k WHEN part IN (5, 7, 11) THEN FALSE
            WHEN part = 1 THEN o_totalprice >= k AND band = 'high'
            ELSE o_totalprice >= k END
  GROUP BY ALL)
"""

NATION_COUNTS_SQL = f"""
SELECT c.candidate_id, c.part, CAST(coalesce(sum(n) FILTER (WHERE band = 'HIGH'), 0) AS BIGINT) AS tp,
       CAST(coalesce(sum(n) FILTER (WHERE band <> 'HIGH'), 0) AS BIGINT) AS fp,
       any_value(target) AS target, any_value(total) AS total
FROM ({NATION_SQL}) c CROSS JOIN ({TRUTH_SQL})
LEFT JOIN ({NATION_ROWS_SQL}) r ON r.candidate_id = c.candidate_id GROUP BY ALL
"""


def nation_scores_sql(guard: bool, blank: str) -> str:
    """Scores of the nation texts, with the outcome of each part written out."""
    guarded = "part = 1 OR part = 3" if guard else "FALSE"
    penalty = "CASE part WHEN 1 THEN -5 WHEN 3 THEN -2 ELSE -20 END"
    blank_value = "NULL" if blank == "skip" else "0"
    off = f"({guarded}) OR part IN (5, 7)"
    zero = f"CASE WHEN part = 5 THEN {blank_value} WHEN {off} THEN 0 ELSE {{c}} END AS {{c}}"
    blank_score = "NULL" if blank == "skip" else "-20"
    rate = (
        f"round(CAST(CASE WHEN part = 5 THEN {blank_score} WHEN {off} THEN {penalty} ELSE {{c}} END"
        " AS DOUBLE), 6) AS {c}"
    )
    share = (
        f"round(CAST(CASE WHEN part = 5 THEN {blank_value} WHEN {off} THEN 0 ELSE \"{{c}}\" END"
        " AS DOUBLE), 6) AS \"{c}\""
    )
    status = f"""CASE WHEN part = 1 AND ({guarded}) THEN 'leak_both' WHEN part = 3 AND ({guarded})
        THEN 'leak_value' WHEN part = 5 THEN '{"skipped" if blank == "skip" else "parse_error"}'
        WHEN part = 7 THEN 'parse_error' ELSE 'ok' END AS status"""
    return f"""
SELECT candidate_id, {status}, {', '.join(zero.format(c=c) for c in COUNTS)},
       {share.format(c='precision')}, {share.format(c='recall')}, {rate.format(c='f1')},
       {rate.format(c='score')}
FROM ({measures_sql(NATION_COUNTS_SQL)})
"""


NATION_COLUMNS = ("candidate_id", "status", *COUNTS, "precision", "recall", "f1", "score")


def _nation_records(records: DataFrame) -> DataFrame:
    return rounded(records.select(*NATION_COLUMNS), "precision", "recall", "f1", "score")


# Measures on counts that come from plain grouping.

def confusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's lines as a result, returned lines as the class to find."""
    lines = table(spark, sf_dir, "lineitem")
    is_hit = F.col("l_returnflag").eqNullSafe("R")
    found = lines.groupBy(F.col("l_suppkey").alias("candidate_id")).agg(
        F.count_if(is_hit).alias("tp"), F.count_if(~is_hit).alias("fp")
    )
    truth = lines.agg(
        F.struct(F.count_if(is_hit).alias("target"), F.count(F.lit(1)).alias("total"))
    ).scalar()
    counted = found.withColumns({"target": truth["target"], "total": truth["total"]})
    rated = measures.with_measures(counted)
    return rated.select("candidate_id", *COUNTS)


CONFUSION_SQL = """
SELECT l_suppkey AS candidate_id, count(*) FILTER (WHERE l_returnflag = 'R') AS tp,
       count(*) FILTER (WHERE l_returnflag IS DISTINCT FROM 'R') AS fp,
       (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS target,
       (SELECT count(*) FROM lineitem) AS total
FROM lineitem GROUP BY l_suppkey
"""


def precision_recall_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for customers of each segment as results and low balances as the class."""
    customers = table(spark, sf_dir, "customer")
    low = F.col("c_acctbal") < 0
    found = customers.groupBy("c_mktsegment", "c_nationkey").agg(
        F.count_if(low).alias("tp"), F.count_if(~low).alias("fp")
    )
    truth = customers.agg(
        F.struct(F.count_if(low).alias("target"), F.count(F.lit(1)).alias("total"))
    ).scalar()
    counted = found.withColumns({"target": truth["target"], "total": truth["total"]})
    return rounded(
        measures.with_measures(counted).select(
            "c_mktsegment", "c_nationkey", "precision", "recall", "f1"
        ),
        "precision", "recall", "f1", digits=9,
    )


PRF_SQL = """
SELECT c_mktsegment, c_nationkey, count(*) FILTER (WHERE c_acctbal < 0) AS tp,
       count(*) FILTER (WHERE NOT c_acctbal < 0) AS fp,
       (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS target,
       (SELECT count(*) FROM customer) AS total
FROM customer GROUP BY ALL
"""


def _sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold_sweep(orders_labelled(spark, sf_dir), "o_totalprice", "band", "HIGH", SWEEP)


SWEEP_COUNTS_SQL = f"""
SELECT CAST(k AS DOUBLE) AS k, CAST(count(*) FILTER (WHERE band = 'HIGH') AS BIGINT) AS tp,
       CAST(count(*) FILTER (WHERE band <> 'HIGH') AS BIGINT) AS fp,
       any_value(target) AS target, any_value(total) AS total
FROM (VALUES {SWEEP_SQL}) t(k) CROSS JOIN ({TRUTH_SQL})
LEFT JOIN ({ORDERS_SQL}) ON o_totalprice >= k GROUP BY k
"""


def weighted_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_sweep(spark, sf_dir).select("k", "weighted_f"), "weighted_f", digits=12)


def score_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_sweep(spark, sf_dir).select("k", "score"), "score", digits=12)


def threshold_sweep_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_sweep(spark, sf_dir).select("k", *COUNTS, *RATES), *RATES)


def leak_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as texts, their source as label column and their language as class."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", leak_penalty(F.col("text"), F.substring("source", 4, 2), F.col("lang")).alias("penalty")
    )


LEAK_SQL = """
SELECT doc_id, CAST(CASE
    WHEN contains(lower(text), lower(lang)) AND contains(lower(text), lower(substr(source, 4, 2))) THEN -5
    WHEN contains(lower(text), lower(lang)) THEN -2 END AS DOUBLE) AS penalty
FROM documents
"""


# Whole candidate tables.

def candidate_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = {"orders_labelled": orders_labelled(spark, sf_dir)}
    scored = score_candidates(nation_queries(spark, sf_dir), views)
    return scored.class_counts.select("candidate_id", "class", "n")


def score_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions, many to a scan."""
    scored = score_candidates(
        supplier_conditions(spark, sf_dir), table=orders_labelled(spark, sf_dir)
    )
    return _supplier_records(scored.records)


def _supplier_records(records: DataFrame) -> DataFrame:
    return rounded(records.select("candidate_id", "status", *COUNTS, *RATES), *RATES)


def supplier_scores_sql(counts: str) -> str:
    rates = ", ".join(f'round("{c}", 6) AS "{c}"' for c in RATES)
    return f"SELECT candidate_id, 'ok' AS status, tp, fp, tn, fn, {rates} FROM ({measures_sql(counts)})"


SCORE_BATCH_SQL = supplier_scores_sql(CONDITIONS_SQL)


def score_batch_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = {"orders_labelled": orders_labelled(spark, sf_dir)}
    return _nation_records(score_candidates(nation_queries(spark, sf_dir), views).records)


def score_batch_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conditions of ``score_batch`` as SELECT texts, one for each supplier."""
    orders = orders_labelled(spark, sf_dir)
    texts = supplier_conditions(spark, sf_dir).withColumn("sql", F.concat(F.lit("select * from orders_labelled where "), "sql"))
    return _supplier_records(score_candidates(texts, {"orders_labelled": orders}).records)


def column_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions over several columns of orders, one for each supplier: ranges, lists, negations, other types."""
    key = F.col("s_suppkey")
    low = number_text(F.lit(1000) + F.pmod(key, F.lit(400)) * 1000)
    high = number_text(F.lit(1000) + F.pmod(key * 7, F.lit(550)) * 1000)
    date = F.date_format(F.date_add(F.lit("1992-01-01").cast("date"), F.pmod(key * 3, F.lit(2400)).cast("int")), "yyyy-MM-dd")
    sql = (
        F.when(key % 4 == 0, F.concat(F.lit("o_totalprice between "), low, F.lit(" and "), high))
        .when(key % 4 == 1, F.concat(F.lit("not (o_orderdate < date'"), date, F.lit("' or o_totalprice < "), low, F.lit(")")))
        .when(key % 4 == 2, F.concat(F.lit("o_orderstatus in ('F', 'P') and o_totalprice > "), high))
        .otherwise(F.concat(F.lit("o_orderpriority >= '3' and o_orderdate <> '"), date, F.lit("' and "), low, F.lit(" <= o_totalprice")))
    )
    rows = table(spark, sf_dir, "supplier").select(key.alias("candidate_id"), sql.alias("sql"))
    return with_targets(rows, orders_labelled(spark, sf_dir))


def score_batch_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of conditions over several columns."""
    return _supplier_records(score_candidates(column_conditions(spark, sf_dir), table=orders_labelled(spark, sf_dir)).records)


COLUMN_COUNTS_SQL = f"""
SELECT candidate_id, CAST(count(*) FILTER (WHERE band = 'HIGH') AS BIGINT) AS tp,
       CAST(count(*) FILTER (WHERE band <> 'HIGH') AS BIGINT) AS fp,
       any_value(target) AS target, any_value(total) AS total
FROM (
  SELECT s_suppkey AS candidate_id, s_suppkey % 4 AS part, 1000 + (s_suppkey % 400) * 1000 AS low,
         1000 + (s_suppkey * 7 % 550) * 1000 AS high, DATE '1992-01-01' + CAST(s_suppkey * 3 % 2400 AS INTEGER) AS day
  FROM supplier
) CROSS JOIN ({TRUTH_SQL})
LEFT JOIN ({ORDERS_SQL}) ON CASE part
  WHEN 0 THEN o_totalprice BETWEEN low AND high
  WHEN 1 THEN NOT (o_orderdate < day OR o_totalprice < low)
  WHEN 2 THEN o_orderstatus IN ('F', 'P') AND o_totalprice > high
  ELSE o_orderpriority >= '3' AND o_orderdate <> day AND low <= o_totalprice END
GROUP BY candidate_id
"""


def score_batch_noguard(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = {"orders_labelled": orders_labelled(spark, sf_dir)}
    return _nation_records(score_candidates(nation_queries(spark, sf_dir), views, guard=False).records)


def score_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One way to fail per nation, next to texts that work."""
    key = F.col("n_nationkey")
    bad = [
        "selec *",
        "select o_orderkey from orders_labelled",
        "select * from orders_labelled where cast(o_orderstatus as int) = o_custkey",
        "drop view orders_labelled",
        "with a as (select 1) insert into orders_labelled select * from a",
        "select *, reflect('java.lang.System', 'lineSeparator') from orders_labelled",
        "select band from parquet.`/tmp/x`",
        "select * from orders_labelled; ",
        "select * from other_table",
        "set spark.sql.ansi.enabled=false",
    ]
    sql = F.lit("select * from orders_labelled where o_totalprice >= 440000")
    for i, text in enumerate(bad):
        sql = F.when(key == i, F.lit(text)).otherwise(sql)
    rows = table(spark, sf_dir, "nation").select(
        key.cast("bigint").alias("candidate_id"), sql.alias("sql")
    )
    views = {"orders_labelled": orders_labelled(spark, sf_dir)}
    targeted = with_targets(rows, views["orders_labelled"]).withColumn(
        "target_rows",
        F.when(F.col("candidate_id") == 20, F.lit(" "))
        .when(F.col("candidate_id") == 21, F.lit("a few"))
        .otherwise(F.col("target_rows")),
    )
    records = score_candidates(targeted, views).records
    return rounded(records.select("candidate_id", "status", "tp", "fp", "score"), "score")


SCORE_ERRORS_SQL = f"""
SELECT candidate_id, status, CASE WHEN status = 'ok' THEN tp ELSE 0 END AS tp,
       CASE WHEN status = 'ok' THEN fp ELSE 0 END AS fp,
       round(CASE WHEN status = 'ok' THEN score ELSE CAST(-20 AS DOUBLE) END, 6) AS score
FROM (
  SELECT CAST(n_nationkey AS BIGINT) AS candidate_id, CASE
    WHEN n_nationkey IN (0, 7) THEN 'parse_error' WHEN n_nationkey = 1 THEN 'analysis_error'
    WHEN n_nationkey = 2 THEN 'runtime_error'
    WHEN n_nationkey IN (3, 4, 5, 6, 8, 9) THEN 'rejected' WHEN n_nationkey = 20 THEN 'null_target'
    WHEN n_nationkey = 21 THEN 'bad_count' ELSE 'ok' END AS status FROM nation)
CROSS JOIN ({measures_sql(f'''
  SELECT count(*) FILTER (WHERE band = 'HIGH') AS tp, count(*) FILTER (WHERE band <> 'HIGH') AS fp,
         any_value(target) AS target, any_value(total) AS total
  FROM ({ORDERS_SQL}) CROSS JOIN ({TRUTH_SQL}) WHERE o_totalprice >= 440000''')})
"""


def metrics_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON text taken apart again, and the class map as text."""
    scored = score_candidates(
        supplier_conditions(spark, sf_dir), table=orders_labelled(spark, sf_dir)
    )
    parsed = with_metrics_json(scored).withColumn(
        "m",
        F.from_json(
            "metrics",
            "output map<string,bigint>, tp bigint, fp bigint, tn bigint, fn bigint, f1 double, f2 double",
        ),
    )
    return parsed.select(
        "candidate_id",
        F.to_json("m.output").alias("output"),
        *[F.col(f"m.{name}").alias(name) for name in COUNTS],
        F.round("m.f1", 6).alias("f1"),
        F.round("m.f2", 6).alias("f2"),
    )


METRICS_JSON_SQL = f"""
SELECT candidate_id, CASE WHEN tp > 0 AND fp > 0 THEN '{{"HIGH":' || tp || ',"LOW":' || fp || '}}'
    WHEN tp > 0 THEN '{{"HIGH":' || tp || '}}' WHEN fp > 0 THEN '{{"LOW":' || fp || '}}'
    ELSE '{{}}' END AS output, tp, fp, tn, fn, round(f1, 6) AS f1, round(score, 6) AS f2
FROM ({measures_sql(CONDITIONS_SQL)})
"""


def _completions(spark: SparkSession, sf_dir: str, fenced: bool) -> DataFrame:
    rows = nation_queries(spark, sf_dir).withColumn("generation_id", F.lit(0))
    text = F.col("sql")
    if fenced:
        text = F.concat(F.lit("```SQL\n"), text, F.lit("\n```"))
    return rows.select(
        "candidate_id",
        "generation_id",
        F.array(F.struct(F.concat(F.lit(" \n"), text, F.lit("\n")).alias("content"))).alias("completion"),
        F.col("label_col").alias("column"),
        F.col("positive_value").alias("value"),
        F.replace("target_rows", F.lit(",")).cast("bigint").alias("target_score"),
        F.replace("total_rows", F.lit(",")).cast("bigint").alias("total_rows"),
    )


def reward_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = {"orders_labelled": orders_labelled(spark, sf_dir)}
    return _nation_records(score_completions(_completions(spark, sf_dir, False), views).records)


def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = {"orders_labelled": orders_labelled(spark, sf_dir)}
    _, summary = evaluate_completions(_completions(spark, sf_dir, True), views)
    return rounded(summary, "average_score")


EVAL_SUMMARY_SQL = f"""
SELECT count(*) AS sample_count, round(avg(score), 6) AS average_score
FROM ({nation_scores_sql(True, 'error')})
"""


def candidate_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate CSV scored into a file beside it, and that file read again."""
    rows = nation_queries(spark, sf_dir).select(
        F.col("candidate_id").alias("Key"),
        F.col("sql").alias("Output"),
        F.col("label_col").alias("Column"),
        F.col("positive_value").alias("Attack Type"),
        F.col("target_rows").alias("Expected Rows"),
        F.col("total_rows").alias("Total Rows"),
    )
    given = write_scored(rows, scratch_path(spark, "candidates") + ".csv")
    back = read_table_csv(spark, score_file(spark, given, {"orders_labelled": orders_labelled(spark, sf_dir)}))
    metrics = F.from_json("Metrics", "tp bigint, fp bigint")
    return back.select(
        F.col("Key").cast("bigint").alias("candidate_id"),
        F.round(F.col("Score").cast("double"), 6).alias("score"),
        F.coalesce(metrics["tp"], F.lit(0)).alias("tp"),
        F.coalesce(metrics["fp"], F.lit(0)).alias("fp"),
    )


CANDIDATE_FILE_SQL = f"""
SELECT candidate_id, score, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp FROM ({nation_scores_sql(True, 'skip')})
"""


def evaluation_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scored runs, with and without the guard, as the JSON document of an evaluation."""
    views = {"orders_labelled": orders_labelled(spark, sf_dir)}
    runs = [
        score_completions(_completions(spark, sf_dir, True), views, fences=True, guard=guard).records
        for guard in (True, False)
    ]
    document, scores = write_evaluation(*runs, scratch_path(spark, "evaluation"), ["candidate_id", "status", "score"])
    side = "struct<sample_count:bigint,average_score:double>"
    back = spark.read.schema(
        f"initial {side}, final {side}, overall_percent_difference double, overall_percent_difference_infinite boolean"
    ).json(document)
    lines = spark.read.schema("phase string, candidate_id bigint, status string, score double").json(scores)
    return back.select(
        F.col("initial.sample_count").alias("initial_count"),
        F.round("initial.average_score", 6).alias("initial_average"),
        F.col("final.sample_count").alias("final_count"),
        F.round("final.average_score", 6).alias("final_average"),
        F.round("overall_percent_difference", 4).alias("overall_percent_difference"),
        F.col("overall_percent_difference_infinite").alias("infinite"),
        lines.agg(F.count_if(F.col("status") == "ok")).scalar().alias("n_ok"),
    )


EVALUATION_SQL = f"""
WITH r AS (SELECT 'i' AS phase, * FROM ({nation_scores_sql(True, 'error')})
           UNION ALL SELECT 'f', * FROM ({nation_scores_sql(False, 'error')})),
s AS (SELECT count(*) FILTER (WHERE phase = 'i') AS initial_count, avg(score) FILTER (WHERE phase = 'i') AS i,
             count(*) FILTER (WHERE phase = 'f') AS final_count, avg(score) FILTER (WHERE phase = 'f') AS f,
             count(*) FILTER (WHERE status = 'ok') AS n_ok FROM r)
SELECT initial_count, round(i, 6) AS initial_average, final_count, round(f, 6) AS final_average,
       round((f - i) / abs(i) * 100, 4) AS overall_percent_difference, FALSE AS infinite, n_ok FROM s
"""


def eval_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values in whole cents as scores, even and odd events as the two phases.

    Sums of whole numbers are exact in any order, so both sides round the same means.
    """
    cents = F.round(F.col("value") * 100)
    records = table(spark, sf_dir, "events").select(
        F.when(F.col("event_id") % 2 == 0, "initial").otherwise("final").alias("phase"),
        F.when(F.col("event_type") != "view", F.col("event_type"))
        .when(F.col("event_id") % 2 == 0, "only_before")
        .otherwise("only_after")
        .alias("positive_value"),
        F.when(F.col("event_type") != "click", cents)
        .when(F.col("event_id") % 2 == 0, F.lit(0.0))
        .otherwise(cents)
        .alias("score"),
    )
    changed = rounded(score_change(records), "initial", "final", "percent_change", digits=4)
    return changed.withColumn("percent_change", F.col("percent_change").cast("string"))


EVAL_CHANGE_SQL = """
WITH r AS (
  SELECT CASE WHEN event_id % 2 = 0 THEN 'initial' ELSE 'final' END AS phase,
    CASE WHEN event_type <> 'view' THEN event_type WHEN event_id % 2 = 0 THEN 'only_before'
         ELSE 'only_after' END AS positive_value,
    CASE WHEN event_type <> 'click' THEN round(value * 100) WHEN event_id % 2 = 0 THEN CAST(0 AS DOUBLE)
         ELSE round(value * 100) END AS score FROM events),
m AS (
  SELECT positive_value, FALSE AS overall, avg(score) FILTER (WHERE phase = 'initial') AS i,
         avg(score) FILTER (WHERE phase = 'final') AS f FROM r GROUP BY positive_value
  UNION ALL
  SELECT NULL, TRUE, avg(score) FILTER (WHERE phase = 'initial'),
         avg(score) FILTER (WHERE phase = 'final') FROM r)
SELECT positive_value, overall, round(i, 4) AS initial, round(f, 4) AS final,
  CASE WHEN i IS NULL OR f IS NULL THEN NULL
       WHEN i <> 0 THEN CAST(round((f - i) / abs(i) * 100, 4) AS VARCHAR)
       WHEN f <> 0 THEN 'Infinity' ELSE '0.0' END AS percent_change
FROM m
"""


def group_advantages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as the completions of a prompt."""
    records = table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("prompt_id"), F.col("value").alias("score")
    )
    return rounded(group_advantage(records).select("event_id", "prompt_id", "advantage"), "advantage")


ADVANTAGE_SQL = """
SELECT event_id, user_id AS prompt_id,
  round((value - avg(value) OVER w) / (coalesce(stddev_samp(value) OVER w, 0) + CAST(0.0001 AS DOUBLE)), 6)
    AS advantage
FROM events WINDOW w AS (PARTITION BY user_id)
"""


def score_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nation texts as arriving files."""
    place = scratch_path(spark, "stream")
    arriving = nation_queries(spark, sf_dir).select(
        "candidate_id", "sql", "label_col", "positive_value", "target_rows", "total_rows"
    )
    arriving.repartition(3, "candidate_id").write.parquet(f"{place}/in")
    views = {"orders_labelled": orders_labelled(spark, sf_dir)}
    query = score_arrivals(
        spark, f"{place}/in", views, f"{place}/out", f"{place}/state", files_per_batch=2
    )
    query.awaitTermination()
    return _nation_records(spark.read.parquet(f"{place}/out"))


QUERIES = {
    "score_batch": (score_batch, SCORE_BATCH_SQL),
    "score_batch_texts": (score_batch_texts, SCORE_BATCH_SQL),
    "score_batch_columns": (score_batch_columns, supplier_scores_sql(COLUMN_COUNTS_SQL)),
    "score_batch_queries": (score_batch_queries, nation_scores_sql(True, "skip")),
    "score_batch_noguard": (score_batch_noguard, nation_scores_sql(False, "skip")),
    "score_errors": (score_errors, SCORE_ERRORS_SQL),
    "candidate_class_counts": (
        candidate_class_counts,
        f"SELECT candidate_id, band AS class, CAST(n AS BIGINT) AS n FROM ({NATION_ROWS_SQL}) WHERE part NOT IN (1, 3)",
    ),
    "confusion_counts": (
        confusion_counts,
        f"SELECT candidate_id, tp, fp, tn, fn FROM ({measures_sql(CONFUSION_SQL)})",
    ),
    "precision_recall_f1": (
        precision_recall_f1,
        'SELECT c_mktsegment, c_nationkey, round("precision", 9) AS "precision",'
        f' round("recall", 9) AS "recall", round(f1, 9) AS f1 FROM ({measures_sql(PRF_SQL)})',
    ),
    "weighted_f": (
        weighted_f, f"SELECT k, round(weighted_f, 12) AS weighted_f FROM ({measures_sql(SWEEP_COUNTS_SQL)})"
    ),
    "score_tiers": (
        score_tiers, f"SELECT k, round(score, 12) AS score FROM ({measures_sql(SWEEP_COUNTS_SQL)})"
    ),
    "threshold_sweep": (
        threshold_sweep_all,
        f"""SELECT k, tp, fp, tn, fn, {', '.join(f'round("{c}", 6) AS "{c}"' for c in RATES)}
        FROM ({measures_sql(SWEEP_COUNTS_SQL)})""",
    ),
    "leak_guard": (leak_guard, LEAK_SQL),
    "metrics_json": (metrics_json, METRICS_JSON_SQL),
    "reward_batch": (reward_batch, nation_scores_sql(True, "error")),
    "eval_summary": (eval_summary, EVAL_SUMMARY_SQL),
    "candidate_file": (candidate_file, CANDIDATE_FILE_SQL),
    "evaluation_document": (evaluation_document, EVALUATION_SQL),
    "eval_change": (eval_change, EVAL_CHANGE_SQL),
    "group_advantage": (group_advantages, ADVANTAGE_SQL),
    "score_stream": (score_stream, nation_scores_sql(True, "error")),
}
