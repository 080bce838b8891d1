"""Registered queries: labelled tables, curves, files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querygavel.operators.asof import asof_join
from querygavel.operators.census import class_mix, label_census
from querygavel.operators.curves import curve_summary, moving_mean
from querygavel.operators.quantile import at_least_quantile
from querygavel.operators.sampling import stratified_sample, uniform_sample, weighted_sample
from querygavel.operators.summary import percent_change
from querygavel.registry.common import table
from querygavel.session import scratch_path
from querygavel.sources.candidates import read_candidates
from querygavel.sources.reward_log import numbered_lines, reward_curve, run_statistics
from querygavel.sources.sinks import scored_name, write_json, write_scored

CAPS = {"purchase": 300, "error": 50, "click": 1}


def census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_census(table(spark, sf_dir, "events"), "event_type")


def filtered_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_census(table(spark, sf_dir, "events"), "event_type", "value >= 50")


def quantile_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return at_least_quantile(events, "value", 0.99).select("event_id", "event_type", "value")


def class_capped_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    return class_mix(events, "event_type", "event_id", CAPS)


def class_capped_mix_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal rows kept once, after the caps."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    return class_mix(events, "event_type", "event_id", CAPS, distinct=True, columns=["event_type", "user_id"])


MIX_SQL = "SELECT event_id, event_type, user_id FROM (" + " UNION ALL ".join(
    f"(SELECT * FROM events WHERE event_type = '{name}' ORDER BY event_id LIMIT {cap})"
    for name, cap in CAPS.items()
) + ")"


SAMPLE_SEED = 7
CLASS_SIZES = {"purchase": 150, "error": 40, "click": 10**9, "view": 0}


def uniform_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uniform_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 120, SAMPLE_SEED)


def stratified_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact sizes: a part of two classes, all of one, none of another."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return stratified_sample(events, "event_type", "event_id", CLASS_SIZES, SAMPLE_SEED)


def weighted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every class, rows drawn by their value."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return weighted_sample(events, "event_id", "value", 100, SAMPLE_SEED, label="event_type")


BITS_SQL = f"CAST('0x' || substr(md5(concat('{SAMPLE_SEED}:', {{}})), 1, 13) AS BIGINT)"
STRATIFIED_SQL = f"""
SELECT event_id, event_type, value FROM events QUALIFY row_number() OVER (
    PARTITION BY event_type ORDER BY {BITS_SQL.format('event_id')}, event_id
  ) <= CASE event_type {' '.join(f"WHEN '{name}' THEN {size}" for name, size in CLASS_SIZES.items())} ELSE 0 END
"""
WEIGHTED_SQL = f"""
SELECT event_id, event_type, value FROM events WHERE value > 0 QUALIFY row_number() OVER (PARTITION BY event_type
    ORDER BY -ln(({BITS_SQL.format('event_id')} + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / value, event_id) <= 100
"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as reward logs: a folder of files per part of the users, with a statistics line at the end."""
    lines = table(spark, sf_dir, "events").select(
        F.pmod("user_id", F.lit(8)).alias("run"),
        "event_id",
        F.concat_ws(
            ", ", (F.col("value") - 20).cast("string"), (F.col("event_id") / 100).cast("string")
        ).alias("value"),
    )
    last = lines.groupBy("run").agg(
        F.max("event_id").alias("event_id"),
        F.format_string(
            "{'train_runtime': %d.5, 'train_loss': 1e-3, 'epoch': %d.25", F.count(F.lit(1)), F.max("event_id")
        ).alias("value"),
    )
    place = scratch_path(spark, "logs")
    (
        lines.withColumn("end", F.lit(0))
        .unionByName(last.withColumn("end", F.lit(1)))
        .repartitionByRange("run", "end", "event_id")
        .sortWithinPartitions("run", "end", "event_id")
        .select("run", "value")
        .write.partitionBy("run")
        .text(place)
    )
    return numbered_lines(spark, place, whole_folders=True)


def _with_run(lines: DataFrame) -> DataFrame:
    return lines.withColumn("run", F.regexp_extract("file", r"run=(\d+)", 1).cast("int"))


def _curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_run(reward_curve(_log(spark, sf_dir)))


LOG_SQL = """
SELECT CAST(user_id % 8 AS INTEGER) AS run,
       row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) AS line_no,
       value - 20 AS reward, event_id / CAST(100 AS DOUBLE) AS epoch FROM events
"""


def reward_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = moving_mean(_curve(spark, sf_dir), "run")
    return curve.select(
        "run", "line_no", F.round("reward", 6).alias("reward"), "epoch",
        F.round("moving_reward", 6).alias("moving_reward"),
    )


def reward_curve_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = curve_summary(_curve(spark, sf_dir))
    return summary.withColumns(
        {"mean_reward": F.round("mean_reward", 6), "best_reward": F.round("best_reward", 6)}
    )


def reward_log_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_run(run_statistics(_log(spark, sf_dir))).select(
        "run", "line_no", "train_runtime", "train_samples_per_second", "train_loss", "epoch"
    )


LOG_STATISTICS_SQL = """
SELECT CAST(user_id % 8 AS INTEGER) AS run, count(*) + 1 AS line_no,
       count(*) + CAST(0.5 AS DOUBLE) AS train_runtime, CAST(NULL AS DOUBLE) AS train_samples_per_second,
       CAST(0.001 AS DOUBLE) AS train_loss, max(event_id) + CAST(0.25 AS DOUBLE) AS epoch
FROM events GROUP BY user_id % 8
"""


def _asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    bought = events.where(F.col("event_type") == "purchase").select("event_id", "user_id", "ts", "value")
    clicked = events.where(F.col("event_type") == "click").select(
        "user_id", "ts", F.col("event_id").alias("click_id"), F.col("value").alias("click_value")
    )
    return asof_join(bought, clicked, "user_id", "ts", ["click_id", "click_value"])


ASOF_SQL = """
SELECT l.event_id, l.user_id, l.ts, l.value, r.event_id AS click_id, r.value AS click_value
FROM (SELECT * FROM events WHERE event_type = 'purchase') l
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') r
  ON l.user_id = r.user_id AND l.ts >= r.ts
"""


def csv_candidates_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as candidate cells: quotes, commas and line ends survive, marks of absence do not."""
    part = F.col("doc_id") % 5
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.col("text").alias("Output"),
        F.concat(F.lit('a "b",\n'), F.col("source")).alias("Column"),
        F.when(part == 0, "NA").when(part == 1, "nan").otherwise(F.col("lang")).alias("Attack Type"),
        F.format_number(F.col("n_chars") * 1000, 0).alias("Expected Rows"),
        F.when(part == 2, F.lit(None)).otherwise(F.col("n_chars").cast("string")).alias("Total Rows"),
    )
    place = scratch_path(spark, "csv") + ".csv"
    write_scored(rows, place)
    back = read_candidates(spark, place)
    return back.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("Output").alias("output_text"),
        F.col("Column").alias("label_col"),
        F.col("Attack Type").alias("positive_value"),
        F.col("Expected Rows").alias("expected_rows"),
        F.col("Total Rows").alias("total_rows"),
    )


CSV_SQL = """
SELECT doc_id, text AS output_text, concat('a "b",', chr(10), source) AS label_col,
       CASE WHEN doc_id % 5 > 1 THEN lang END AS positive_value,
       format('{:,}', n_chars * 1000) AS expected_rows,
       CASE WHEN doc_id % 5 <> 2 THEN CAST(n_chars AS VARCHAR) END AS total_rows
FROM documents
"""


def scored_sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scored table, written under the default name and read again."""
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.concat(F.lit("select *\nfrom t where \"k\" = "), F.col("o_orderkey").cast("string")).alias("Output"),
        (F.col("o_totalprice") / 1000).alias("Score"),
    )
    place = write_scored(rows, scored_name(scratch_path(spark, "sink") + ".csv"))
    back = (
        spark.read.schema("o_orderkey bigint, Output string, Score double")
        .options(header=True, multiLine=True, quote='"', escape='"')
        .csv(place)
    )
    return back.select("o_orderkey", F.col("Output").alias("output_text"), F.round("Score", 6).alias("score"))


SINK_SQL = """
SELECT o_orderkey, concat('select *', chr(10), 'from t where "k" = ', o_orderkey) AS output_text,
       round(o_totalprice / 1000, 6) AS score FROM orders
"""


def summary_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes per user written as JSON; infinite ones come back as NULL with a flag."""
    events, cents = table(spark, sf_dir, "events"), F.round(F.col("value") * 100)
    sides = events.groupBy("user_id").agg(
        F.sum(F.when(F.col("event_type") == "click", cents).otherwise(0.0)).alias("before"),
        F.sum(F.when(F.col("event_type") == "view", cents).otherwise(0.0)).alias("after"),
    )
    changes = sides.select(
        "user_id", percent_change(F.col("before"), F.col("after")).alias("percent_change")
    )
    place = write_json(changes, scratch_path(spark, "json"))
    back = spark.read.schema(
        "user_id bigint, percent_change double, percent_change_infinite boolean"
    ).json(place)
    return back.withColumn("percent_change", F.round("percent_change", 4))


SUMMARY_JSON_SQL = """
SELECT user_id, CASE WHEN b <> 0 THEN round((a - b) / abs(b) * 100, 4) WHEN a = 0 THEN CAST(0 AS DOUBLE) END
         AS percent_change, b = 0 AND a <> 0 AS percent_change_infinite
FROM (SELECT user_id, coalesce(sum(round(value * 100)) FILTER (WHERE event_type = 'click'), 0) AS b,
             coalesce(sum(round(value * 100)) FILTER (WHERE event_type = 'view'), 0) AS a FROM events GROUP BY user_id)
"""

QUERIES = {
    "label_census": (census, "SELECT event_type, count(*) AS n FROM events GROUP BY event_type"),
    "filtered_census": (
        filtered_census,
        "SELECT event_type, count(*) AS n FROM events WHERE value >= 50 GROUP BY event_type",
    ),
    "quantile_filter": (
        quantile_filter,
        "SELECT event_id, event_type, value FROM events WHERE value >= (SELECT quantile_cont(value, 0.99) FROM events)",
    ),
    "class_capped_mix": (class_capped_mix, MIX_SQL),
    "class_capped_mix_distinct": (
        class_capped_mix_distinct, f"SELECT DISTINCT event_type, user_id FROM ({MIX_SQL})"
    ),
    "uniform_sample": (
        uniform_rows, f"SELECT doc_id, lang FROM documents ORDER BY {BITS_SQL.format('doc_id')}, doc_id LIMIT 120"
    ),
    "stratified_sample": (stratified_rows, STRATIFIED_SQL),
    "weighted_sample": (weighted_rows, WEIGHTED_SQL),
    "reward_curve": (
        reward_curves,
        f"""SELECT run, line_no, round(reward, 6) AS reward, epoch, round(avg(reward) OVER (
            PARTITION BY run ORDER BY line_no ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS moving_reward
        FROM ({LOG_SQL})""",
    ),
    "reward_curve_summary": (
        reward_curve_summary,
        f"""SELECT run, count(*) AS n_lines, round(avg(reward), 6) AS mean_reward,
            min(line_no) FILTER (WHERE reward > 0) AS first_positive_line,
            round(max(reward), 6) AS best_reward, arg_max(line_no, (reward, -line_no)) AS best_line
        FROM ({LOG_SQL}) GROUP BY run""",
    ),
    "reward_log_statistics": (reward_log_statistics, LOG_STATISTICS_SQL),
    "asof_join": (_asof, ASOF_SQL),
    "csv_candidates_roundtrip": (csv_candidates_roundtrip, CSV_SQL),
    "scored_sink_roundtrip": (scored_sink_roundtrip, SINK_SQL),
    "summary_json": (summary_json, SUMMARY_JSON_SQL),
}
