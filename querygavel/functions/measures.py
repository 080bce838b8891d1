"""Measures of a candidate's result, as columns over its confusion counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The weight, the value of the raw measure for a perfect result, the tiers.
BETA = 1.5
PERFECT = 1.3
GOOD_LEVEL, GOOD_BONUS = 0.8, 1.0
GREAT_LEVEL, GREAT_BONUS = 0.95, 2.0


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


def false_negatives(tp: Column, target: Column) -> Column:
    """May be negative when a result repeats rows."""
    return target - tp


def true_negatives(tp: Column, fp: Column, fn: Column, total: Column) -> Column:
    """May be negative when a result repeats rows."""
    return total - tp - fp - fn


def precision(tp: Column, fp: Column) -> Column:
    return _share(tp, tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    return _share(tp, tp + fn)


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, F.lit(2.0) * p * r / (p + r)).otherwise(F.lit(0.0))


def weighted_f(p: Column, r: Column) -> Column:
    """Recall-leaning F, scaled to 1 at p = r = 1.

    The denominator is beta*p + r, not the textbook beta^2*p + r; results rest on it.
    """
    raw = F.lit(1.0 + BETA**2) * p * r / (F.lit(BETA) * p + r)
    return F.when(p + r > 0, raw).otherwise(F.lit(0.0)) / F.lit(PERFECT)


def tiered_score(p: Column, r: Column) -> Column:
    """Weighted F plus a bonus for each tier that both p and r exceed."""
    base = weighted_f(p, r)
    good = (p > GOOD_LEVEL) & (r > GOOD_LEVEL)
    great = (p > GREAT_LEVEL) & (r > GREAT_LEVEL)
    return (
        F.when(great, base + F.lit(GOOD_BONUS) + F.lit(GREAT_BONUS))
        .when(good, base + F.lit(GOOD_BONUS))
        .otherwise(base)
    )


def with_measures(
    df, tp: str = "tp", fp: str = "fp", target: str = "target", total: str = "total"
):
    """Add fn, tn, precision, recall, f1, weighted_f and score to confusion counts."""
    hits, misses = F.col(tp), F.col(fp)
    counted = df.withColumn("fn", false_negatives(hits, F.col(target)))
    counted = counted.withColumn("tn", true_negatives(hits, misses, F.col("fn"), F.col(total)))
    rated = counted.withColumns(
        {"precision": precision(hits, misses), "recall": recall(hits, F.col("fn"))}
    )
    p, r = F.col("precision"), F.col("recall")
    return rated.withColumns(
        {"f1": f1(p, r), "weighted_f": weighted_f(p, r), "score": tiered_score(p, r)}
    )
