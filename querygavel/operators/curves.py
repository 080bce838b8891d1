"""Summaries of reward curves: ``run, line_no, reward``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querygavel.operators.ranges import moving_means

# Fixed value: lines per moving mean.
MOVING_LINES = 20


def moving_mean(
    curve: DataFrame, run: str = "run", lines: int = MOVING_LINES, ranges: int | None = None
) -> DataFrame:
    """Add ``moving_reward``, the mean of this and the preceding lines of its run.

    Lines are dealt once to ranges of (run, line number), so a long run spreads over many tasks and gaps
    between line numbers do not matter; the last lines of a range are handed on.
    """
    return moving_means(curve, run, [F.col("line_no")], "reward", lines, "moving_reward", ranges)


def curve_summary(curve: DataFrame, run: str = "run") -> DataFrame:
    """Per run: lines, mean, first line with a positive reward, best line and reward."""
    return curve.groupBy(run).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.avg("reward").alias("mean_reward"),
        F.min(F.when(F.col("reward") > 0, F.col("line_no"))).alias("first_positive_line"),
        F.max("reward").alias("best_reward"),
        F.max_by("line_no", F.struct("reward", -F.col("line_no"))).alias("best_line"),
    )
