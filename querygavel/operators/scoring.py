"""Score a table of candidates against labelled tables."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querygavel.functions import leak, measures
from querygavel.functions.text import is_bad_count, is_blank, parse_count
from querygavel.operators.class_counts import Limits, run_conditions, run_queries
from querygavel.plans.safety import PARSE_ERROR

# Columns a candidate table needs; the counts may be text.
NEEDED = ("candidate_id", "sql", "label_col", "positive_value", "target_rows", "total_rows")

SKIPPED = "skipped"
GUARD_ERROR = "guard_error"


@dataclass(frozen=True)
class Scored:
    """``records`` has one row per candidate, ``class_counts`` one per candidate and class."""

    records: DataFrame
    class_counts: DataFrame


def score_candidates(
    candidates: DataFrame,
    views: Mapping[str, DataFrame] | None = None,
    table: DataFrame | None = None,
    guard: bool = True,
    blank: str = "skip",
    on_error: str = "null",
    limits: Limits = Limits(),
) -> Scored:
    """Guard, run, count and rate every candidate.

    ``views`` makes ``sql`` a SELECT text over the named tables; ``table`` makes it a
    condition over that table. ``blank`` text is skipped, or is an error; a candidate whose
    guard cannot be tried scores NULL, or -20 with ``on_error="penalty"``.
    """
    if (views is None) == (table is None):
        raise ValueError("give either views or a table")
    judged = _judge(candidates, guard, blank)
    distinct = (
        judged.where(F.col("status").isNull())
        .groupBy("query_key")
        .agg(F.min("text").alias("text"), F.min("label_col").alias("label_col"))
    )
    if views is not None:
        counts, failures = run_queries(distinct, views, limits)
    else:
        counts, failures = run_conditions(distinct, table, limits)
    return Scored(_rate(judged, counts, failures, on_error), _per_candidate(judged, counts))


def _judge(candidates: DataFrame, guard: bool, blank: str) -> DataFrame:
    """What can be told without running: a status, or NULL for a candidate to run.

    Candidates with the same text and label share a key, so each text runs once.
    """
    sql = F.col("sql")
    text = F.rtrim(sql, F.lit(";"))
    target, total = F.col("target_rows").cast("string"), F.col("total_rows").cast("string")
    empty = is_blank(sql)
    status = F.when(empty, F.lit(SKIPPED)) if blank == "skip" else None

    def otherwise(so_far, condition, value):
        return so_far.when(condition, value) if so_far is not None else F.when(condition, value)

    if guard:
        unusable = F.col("label_col").isNull() | F.col("positive_value").isNull()
        leaking = leak.leak_status(sql, F.col("label_col"), F.col("positive_value"))
        status = otherwise(status, unusable, F.lit(GUARD_ERROR)).when(leaking.isNotNull(), leaking)
    status = otherwise(status, empty, F.lit(PARSE_ERROR))
    # Semicolons before trailing space stay, and cannot be part of a query.
    status = status.when(text.rlike(r";\s+$"), F.lit(PARSE_ERROR))
    status = status.when(is_bad_count(target) | is_bad_count(total), F.lit("bad_count"))
    status = status.when(
        parse_count(target).isNull() | parse_count(total).isNull(), F.lit("null_target")
    )
    status = status.when(F.col("label_col").isNull(), F.lit("analysis_error"))
    return candidates.withColumns(
        {
            "text": text,
            "query_key": F.sha2(F.to_json(F.struct(text.alias("t"), "label_col")), 256),
            "target": parse_count(target),
            "total": parse_count(total),
            "status": status,
        }
    )


def _rate(judged: DataFrame, counts: DataFrame, failures: DataFrame, on_error: str) -> DataFrame:
    """Look up each candidate's counts; a result without rows has none and rates 0."""
    selected = counts.groupBy("query_key").agg(F.sum("n").alias("selected"))
    outcomes = selected.select(
        "query_key", F.lit(None).cast("string").alias("failure"), "selected"
    ).unionByName(
        failures.select(
            "query_key", F.col("status").alias("failure"), F.lit(0).cast("bigint").alias("selected")
        )
    )
    hits = counts.where("is_text").select(
        F.col("query_key").alias("hit_key"), F.col("class").alias("hit_class"), F.col("n").alias("hits")
    )
    ran = F.col("own_status").isNull()
    looked_up = (
        judged.withColumnRenamed("status", "own_status")
        .join(outcomes, "query_key", "left")
        .join(
            hits,
            (F.col("query_key") == F.col("hit_key"))
            & (F.col("positive_value") == F.col("hit_class")),
            "left",
        )
        .withColumn("status", F.coalesce("own_status", F.when(ran, F.col("failure")), F.lit("ok")))
    )
    good = F.col("status") == "ok"
    zero = F.lit(0).cast("bigint")
    counted = looked_up.withColumn("tp", F.when(good, F.coalesce("hits", zero)).otherwise(zero))
    counted = counted.withColumn(
        "fp", F.when(good, F.coalesce("selected", zero) - F.col("tp")).otherwise(zero)
    )
    rated = measures.with_measures(counted)
    penalty = (
        F.when(F.col("status") == "leak_both", F.lit(leak.LEAK_BOTH))
        .when(F.col("status") == "leak_value", F.lit(leak.LEAK_VALUE))
        .when(
            F.col("status") == GUARD_ERROR,
            F.lit(None if on_error == "null" else leak.FAILED).cast("double"),
        )
        .otherwise(F.lit(leak.FAILED))
    )
    unscored = F.col("status") == SKIPPED
    if on_error == "null":
        unscored = unscored | (F.col("status") == GUARD_ERROR)
    columns = {}
    for name in ("tp", "fp", "tn", "fn"):
        columns[name] = F.when(good, F.col(name)).when(~unscored, zero)
    for name in ("precision", "recall", "weighted_f"):
        columns[name] = F.when(good, F.col(name)).when(~unscored, F.lit(0.0))
    for name in ("f1", "score"):
        columns[name] = F.when(good, F.col(name)).when(~unscored, penalty)
    columns["recall_over_one"] = F.coalesce(good & (F.col("recall") > 1), F.lit(False))
    kept = [name for name in judged.columns if name not in ("text", "target", "total", "status")]
    return rated.withColumns(columns).select(
        *kept, "status", *[name for name in columns if name != "recall_over_one"], "recall_over_one"
    )


def _per_candidate(judged: DataFrame, counts: DataFrame) -> DataFrame:
    runs = judged.where(F.col("status").isNull()).select("candidate_id", "query_key")
    return runs.join(counts, "query_key").select("candidate_id", "class", "is_text", "n")


def class_maps(scored: Scored) -> DataFrame:
    """``candidate_id, output``: class to row number, with the text ``null`` for a NULL class.

    A map is one cell, so Spark's cell size bounds it; the long table has the classes apart.
    """
    named = scored.class_counts.groupBy(
        "candidate_id", F.coalesce("class", F.lit("null")).alias("class")
    ).agg(F.sum("n").alias("n"))
    return named.groupBy("candidate_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("class", "n")))).alias("output")
    )


def with_metrics_json(scored: Scored) -> DataFrame:
    """Records plus ``output`` and ``metrics``, all measures as one JSON text."""
    status = F.col("status")
    # A query that ran and found nothing has an empty output, one that did not run has none.
    nothing = F.create_map().cast("map<string,bigint>")
    joined = scored.records.join(class_maps(scored), "candidate_id", "left").withColumn(
        "output", F.coalesce("output", F.when(status == "ok", nothing))
    )
    record = F.struct(
        "output", "tp", "fp", "tn", "fn", "precision", "recall", "f1", F.col("score").alias("f2")
    )
    error = F.struct(status.alias("error"), F.col("score").alias("f2"))
    options = {"ignoreNullFields": "false"}
    metrics = F.when(status == GUARD_ERROR, F.to_json(error, options)).when(
        status != SKIPPED, F.to_json(record, options)
    )
    return joined.withColumn("metrics", metrics)
