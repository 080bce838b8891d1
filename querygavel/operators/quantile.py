"""Exact ranks and quantiles of columns of any size, and filters by them."""

from __future__ import annotations

import math
from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querygavel.session import scratch_path

# Size of the KLL sketch, the steps its quantiles are read at, and the share left on either side of the wanted
# ranks: four times the sketch's rank error at 99 percent.
SKETCH_K, STEPS, SLACK = 2048, 500, 0.005


def values_at_ranks(
    values: DataFrame,
    ranks: Callable[[int], Sequence[int]],
    ranges: int | None = None,
) -> list:
    """Values of the numeric column ``v`` at neighbouring ranks, counted from 0; NULLs do not count, NaN is greatest.

    ``ranks`` names the ranks for a number of values; without ranks the result is empty.
    The first scan makes a mergeable sketch whose rank error fixes a bracket around the ranks. The second one counts
    what is below the bracket and groups equal values in it, which are dealt to ranges, ``ranges`` of them
    or as many as Spark's shuffles have. The number of rows of each range tells where the ranks lie, and
    only those ranges are put in order. A bracket that misses, which the counts show, costs a third scan. Single
    rows come to the driver, and one number for each range.
    """
    number = F.col("v").cast("double")
    values = values.where(F.col("v").isNotNull())
    steps = F.array(*[F.lit(i / STEPS) for i in range(STEPS + 1)])
    real = F.when(~F.isnan(number), number)
    found = values.agg(
        F.count(F.lit(1)).alias("n"),
        F.count(real).alias("numbers"),
        F.min("v").alias("low"),
        F.max("v").alias("high"),
        F.when(F.count(real) > 0, F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(real, SKETCH_K), steps)).alias("at"),
    ).first()
    wanted = list(ranks(found["n"]))
    if not wanted or found["low"] == found["high"]:
        return [found["low"] for _ in wanted]
    low = high = None
    if found["numbers"]:
        first, last = (rank / found["numbers"] for rank in (wanted[0], wanted[-1]))
        low = found["at"][math.floor((first - SLACK) * STEPS)] if SLACK < first < 1 else None
        high = found["at"][math.ceil((last + SLACK) * STEPS)] if last + SLACK < 1 else None
    got = _in_bracket(values, wanted, low, high, ranges)
    return got if got is not None else _in_bracket(values, wanted, None, None, ranges)


def _in_bracket(values: DataFrame, wanted: list[int], low, high, ranges: int | None) -> list | None:
    """The values at the ranks by counting those in the bracket; None if a rank lies outside."""
    spark, number = values.sparkSession, F.col("v").cast("double")
    under = F.lit(False) if low is None else number < F.lit(low)
    rows = values if high is None else values.where(number <= F.lit(high))
    # All values below are one group, which tasks add up before they shuffle.
    counted = rows.groupBy(F.when(~under, F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    dealt = counted.repartitionByRange("v") if ranges is None else counted.repartitionByRange(ranges, "v")
    place = scratch_path(spark, "bracket")
    dealt.select(F.spark_partition_id().alias("range"), "v", "n").write.parquet(place)
    written = spark.read.schema("range int, v " + values.schema["v"].dataType.simpleString() + ", n bigint").parquet(place)
    below, upto, homes = 0, 0, {}
    sums = written.groupBy("range").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("v").isNull(), F.col("n"))).alias("under"))
    for row in sums.orderBy("range").collect():
        below += row["under"] or 0
        for rank in wanted:
            if upto <= rank < upto + row["n"]:
                homes[rank] = (row["range"], upto)
        upto += row["n"]
    if below > wanted[0] or wanted[-1] >= upto:
        return None
    found = []
    for rank in wanted:
        here, before = homes[rank]
        # The group of values below comes first, as NULL does.
        running = F.sum("n").over(Window.orderBy(F.col("v").asc_nulls_first())) + F.lit(before)
        reached = written.where(F.col("range") == here).select("v", running.alias("upto"))
        found.append(reached.agg(F.min(F.when(F.col("upto") > rank, F.col("v")))).first()[0])
    return found


def exact_quantile(
    df: DataFrame, value: Column, q: float, ranges: int | None = None
) -> float | None:
    """Linear-interpolated quantile; NULL for a column without values.

    Spark's ``percentile`` would keep every distinct value in one aggregate.
    """
    shares = []

    def around(n: int) -> Sequence[int]:
        if not n:
            return ()
        rank = (n - 1) * q
        shares.append(rank - math.floor(rank))
        return (math.floor(rank), math.ceil(rank))

    found = values_at_ranks(df.select(value.cast("double").alias("v")), around, ranges)
    if not found:
        return None
    left, right = found
    return left if left == right else left + (right - left) * shares[0]


def at_least_quantile(
    df: DataFrame, value: str, q: float, ranges: int | None = None
) -> DataFrame:
    """Rows whose value reaches the quantile of the whole column."""
    limit = exact_quantile(df, F.col(value), q, ranges)
    return df.where(F.lit(False)) if limit is None else df.where(F.col(value) >= F.lit(limit))
