"""Summaries of scored candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score_summary(records: DataFrame) -> DataFrame:
    """One row ``sample_count, average_score``; penalties count, an unscored row counts as 0.

    No row at all for an empty table.
    """
    return records.agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.coalesce(F.avg(F.coalesce("score", F.lit(0.0))), F.lit(0.0)).alias("average_score"),
    ).where(F.col("sample_count") > 0)


def percent_change(initial, final):
    """Change in percent; infinite from 0, NULL when a side is missing."""
    change = (final - initial) / F.abs(initial) * F.lit(100.0)
    return (
        F.when(initial.isNull() | final.isNull(), F.lit(None).cast("double"))
        .when(initial != 0, change)
        .when(final != 0, F.lit(float("inf")))
        .otherwise(F.lit(0.0))
    )


def score_change(records: DataFrame, phase: str = "phase", by: str = "positive_value") -> DataFrame:
    """``by, initial, final, percent_change`` per class, and a row with NULL for all classes.

    Sums and counts per class come from one aggregate over both phases; the overall row is
    built from those few rows.
    """

    def side(name: str):
        return F.when(F.col(phase) == name, F.coalesce("score", F.lit(0.0)))

    sums = records.groupBy(F.col(by).alias(by)).agg(
        F.sum(side("initial")).alias("s0"),
        F.count(side("initial")).alias("n0"),
        F.sum(side("final")).alias("s1"),
        F.count(side("final")).alias("n1"),
    )
    overall = sums.agg(
        F.lit(None).cast("string").alias(by),
        *[F.sum(name).alias(name) for name in ("s0", "n0", "s1", "n1")],
    )

    def mean(total: str, number: str):
        return F.when(F.col(number) > 0, F.col(total) / F.col(number))

    rows = sums.withColumn("overall", F.lit(False)).unionByName(
        overall.withColumn("overall", F.lit(True))
    )
    means = rows.select(
        by, "overall", mean("s0", "n0").alias("initial"), mean("s1", "n1").alias("final")
    )
    return means.withColumn("percent_change", percent_change(F.col("initial"), F.col("final")))


def group_advantage(
    records: DataFrame, group: str = "prompt_id", score: str = "score", eps: float = 1e-4
) -> DataFrame:
    """Add ``advantage``: the score against the mean of its group, in sample deviations.

    Group-relative normalisation as in the published policy-optimisation paper. Means are
    aggregated and joined back rather than taken in a window, so a group with a large part
    of all rows is combined before the shuffle and can be split in the join.
    """
    groups = records.groupBy(F.col(group).alias("_group")).agg(
        F.avg(score).alias("_mean"), F.coalesce(F.stddev_samp(score), F.lit(0.0)).alias("_dev")
    )
    joined = records.join(groups, F.col(group).eqNullSafe(F.col("_group")), "left")
    advantage = (F.col(score) - F.col("_mean")) / (F.col("_dev") + F.lit(eps))
    return joined.withColumn("advantage", advantage).drop("_group", "_mean", "_dev")
