"""Score candidate files: CSV in, scored table out."""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querygavel.functions.chat import completion_text
from querygavel.functions.text import strip_fence
from querygavel.operators.class_counts import Limits
from querygavel.operators.scoring import Scored, score_candidates, with_metrics_json
from querygavel.operators.summary import percent_change, score_summary
from querygavel.sources.candidates import read_candidates
from querygavel.sources.sinks import scored_name, write_json, write_scored


def candidates_of(df: DataFrame) -> DataFrame:
    """Columns of a candidate file under the names the scoring operators use."""
    return df.select(
        "candidate_id",
        F.col("Output").alias("sql"),
        F.col("Column").alias("label_col"),
        F.col("`Attack Type`").alias("positive_value"),
        F.col("`Expected Rows`").alias("target_rows"),
        F.col("`Total Rows`").alias("total_rows"),
    )


def score_table(
    df: DataFrame, views: Mapping[str, DataFrame], guard: bool = True, limits: Limits = Limits()
) -> DataFrame:
    """A candidate table with a unique ``candidate_id``, plus Score and Metrics.

    Columns of these names are replaced.
    """
    scored = score_candidates(candidates_of(df), views, guard=guard, limits=limits)
    marks = with_metrics_json(scored).select(
        "candidate_id", F.col("score").alias("Score"), F.col("metrics").alias("Metrics")
    )
    return df.drop("Score", "Metrics").join(marks, "candidate_id", "left")


def score_file(
    spark: SparkSession,
    csv_path: str,
    views: Mapping[str, DataFrame],
    output_path: str | None = None,
    guard: bool = True,
    limits: Limits = Limits(),
) -> str:
    """Score a candidate CSV; the result is a folder, by default ``<input>_scored<ext>``."""
    rows = read_candidates(spark, csv_path)
    # A row id that is the same in every pass: the file and the place in it.
    row_id = F.concat_ws(":", F.input_file_name(), F.monotonically_increasing_id())
    scored = score_table(rows.drop("candidate_id").withColumn("candidate_id", row_id), views, guard, limits)
    return write_scored(scored.drop("candidate_id"), output_path or scored_name(csv_path))


def score_completions(
    completions: DataFrame,
    views: Mapping[str, DataFrame],
    fences: bool = False,
    guard: bool = True,
    limits: Limits = Limits(),
) -> Scored:
    """Score generated completions (``candidate_id, completion, column, value, target_score,
    total_rows`` and any other columns).

    Every completion gets a number: blank text and failures score -20. Code fences are only
    taken off on request, as in the summary of an evaluation.
    """
    text = completion_text(F.col("completion"))
    if fences:
        text = strip_fence(text)
    candidates = completions.withColumn("sql", text).withColumnsRenamed(
        {
            "column": "label_col",
            "value": "positive_value",
            "target_score": "target_rows",
        }
    )
    return score_candidates(
        candidates, views, guard=guard, blank="error", on_error="penalty", limits=limits
    )


def evaluate_completions(
    completions: DataFrame, views: Mapping[str, DataFrame], limits: Limits = Limits()
) -> tuple[DataFrame, DataFrame]:
    """Details per completion and the one-row summary."""
    records = score_completions(completions, views, fences=True, limits=limits).records
    return records, score_summary(records)


def write_evaluation(initial: DataFrame, final: DataFrame, path: str, columns: list[str]) -> tuple[str, str]:
    """The records of two scored runs as JSON: a folder ``document`` with ``initial``, ``final`` and
    ``overall_percent_difference``, and one ``scores`` with a line for each record of both.

    A run without records is NULL, and so is the difference then; from an average of 0 it is infinite, which JSON has
    not, so it becomes NULL with a flag. Records stay out of the document, since they grow with the run.
    """
    summary = F.struct("sample_count", "average_score")
    sides = initial.sparkSession.range(1).select(
        score_summary(initial).select(summary).scalar().alias("initial"),
        score_summary(final).select(summary).scalar().alias("final"),
    )
    change = percent_change(F.col("initial.average_score"), F.col("final.average_score"))
    document = write_json(sides.withColumn("overall_percent_difference", change), f"{path}/document")
    both = initial.select(F.lit("initial").alias("phase"), *columns).unionByName(
        final.select(F.lit("final").alias("phase"), *columns)
    )
    return document, write_json(both, f"{path}/scores")
