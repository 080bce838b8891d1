"""Class numbers of labelled tables, mixes of classes, and threshold sweeps."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querygavel.functions.measures import with_measures
from querygavel.functions.text import quoted
from querygavel.operators.firsts import first_rows


def label_census(df: DataFrame, label: str, where: str | Column | None = None) -> DataFrame:
    """``label, n``: rows per class, of all rows or of those that meet a condition."""
    rows = df if where is None else df.where(where)
    return rows.groupBy(F.col(quoted(label)).alias(label)).agg(F.count(F.lit(1)).alias("n"))


def class_mix(
    df: DataFrame,
    label: str,
    order_by: str,
    caps: Mapping[str, int],
    distinct: bool = False,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """The first ``caps[class]`` rows of each named class, never more; ``columns`` of them.

    Ties are broken by the other columns, and rows without an order value come last. Cuts from a sketch
    of each class let most rows pass or fall out unranked; only rows near a cap are
    numbered, over ranges. With ``distinct``, equal rows are kept once, after the caps.
    """
    wanted = [(name, cap) for name, cap in caps.items() if cap > 0]
    kept = [F.col(quoted(name)) for name in columns or df.columns]
    if not wanted:
        return df.where(F.lit(False)).select(*kept)
    # Classes are named by text; a label of another type is compared by its text.
    named = df.withColumn("_named", F.col(quoted(label)).cast("string"))
    ties = [F.col(quoted(name)) for name in df.columns if name not in (label, order_by)]
    table = df.sparkSession.createDataFrame(wanted, "_named string, cap bigint")
    mixed = first_rows(named, "_named", order_by, [F.xxhash64(*ties)] if ties else [], table).select(*kept)
    return mixed.distinct() if distinct else mixed


def threshold_sweep(
    df: DataFrame, value: str, label: str, positive: str, thresholds: Sequence[float]
) -> DataFrame:
    """``k, tp, fp, …, score`` of the rule ``value >= k`` for every threshold.

    One scan for any number of thresholds: each row falls into one bucket between
    neighbouring thresholds, and running sums over the buckets give all counts.
    """
    spark = df.sparkSession
    ks = sorted({float(k) + 0.0 for k in thresholds})
    # Adding zero makes -0.0 and 0.0 one value, as they are in a comparison.
    number = F.col(value).cast("double") + F.lit(0.0)
    # NaN is greater than every number in Spark, and NULL meets no threshold.
    number = F.when(F.isnan(number), F.lit(float("inf"))).otherwise(number)
    rows = df.select(number.alias("v"), F.col(quoted(label)).eqNullSafe(positive).alias("hit"))
    below = F.col("v").isNull() | (F.col("v") < ks[0])
    inner = Bucketizer(
        splits=[ks[0], *ks[1:], float("inf")] if len(ks) > 1 else [float("-inf"), ks[0], float("inf")],
        inputCol="v",
        outputCol="slot",
        handleInvalid="keep",
    )
    placed = inner.transform(rows.withColumn("v", F.when(~below, F.col("v"))))
    offset = 0 if len(ks) > 1 else -1
    slot = F.when(F.col("v").isNull(), F.lit(-1)).otherwise(
        F.col("slot").cast("int") + F.lit(offset)
    )
    counts = placed.groupBy(slot.alias("slot")).agg(
        F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses")
    )
    steps = spark.createDataFrame(
        [(-1, None), *enumerate(ks)], T.StructType().add("slot", "integer").add("k", "double")
    )
    zero = F.lit(0).cast("bigint")
    # As many rows as thresholds, whatever the size of the table.
    from_here = Window.orderBy("slot").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy("slot").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    filled = steps.join(counts, "slot", "left").select(
        "slot", "k", F.coalesce("hits", zero).alias("h"), F.coalesce("misses", zero).alias("m")
    )
    swept = filled.select(
        "k",
        F.sum("h").over(from_here).alias("tp"),
        F.sum("m").over(from_here).alias("fp"),
        F.sum("h").over(everything).alias("target"),
        F.sum(F.col("h") + F.col("m")).over(everything).alias("total"),
    ).where(F.col("k").isNotNull())
    return with_measures(swept)
