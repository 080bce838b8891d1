"""The first rows of every class, cut by a threshold per class so that only its rim is ranked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querygavel.functions.text import quoted
from querygavel.operators.ranges import numbered
from querygavel.session import scratch_path

# Size of the KLL sketch of a class, the steps its quantiles are read at, and the share of a class left on either
# side of its cap: four times the sketch's rank error at 99 percent. A cut that misses its cap is noticed and dropped.
SKETCH_K, STEPS, SLACK = 512, 200, 0.02

# Rows that pass whatever the others are, and rows that may pass. A missing cut is beyond the end.
UNDER = "_whole or coalesce(_at < _low, false)"
RIM = f"not ({UNDER}) and (_high is null or coalesce(_at <= _high, false))"

# Rows of the rim that are numbered at once, for each of Spark's shuffle partitions; a larger rim is cut again.
RIM_ROWS = 500_000


def first_rows(
    df: DataFrame, label: str, order: str, ties: Sequence[Column], caps: DataFrame, ranges: int | None = None,
    uniform: bool = False, rim_rows: int = RIM_ROWS,
) -> DataFrame:
    """The first ``cap`` rows of each class of ``caps`` (a column named as ``label``, and ``cap``), by ascending
    ``order``, NULLs last, then by ``ties``.

    Classes without a row in ``caps`` give nothing. A mergeable sketch of the order column per class puts a lower
    cut just under the cap and an upper one just above it; ``uniform`` says that the order is spread evenly over 0
    to 1, so the number of rows is enough. One scan counts what lies below the cuts. Rows under the lower cut pass
    without being ranked, rows over the upper one fall out, and the rim between them is numbered over ranges; only
    the rim is shuffled. A rim of more than ``rim_rows`` a shuffle partition is cut again. Order columns without
    a number (texts) have no cuts: the whole class is its rim.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [F.col(quoted(name)) for name in df.columns]
    none = F.lit(None).cast("double")
    bounds = caps.select(
        F.col(quoted(label)).alias("_class"), F.col("cap").cast("bigint").alias("_cap"), F.lit(False).alias("_whole"),
        none.alias("_low"), none.alias("_high"), F.lit(0).cast("bigint").alias("_below"),
    )
    rows = df.withColumn("_at", _number(df, order))
    of_class = F.col(quoted(label)).eqNullSafe(F.col("_class"))
    last = size = None
    while True:
        closer = _narrowed(rows.join(bounds, of_class).where(RIM), uniform)
        if size is not None:
            settled = bounds.join(closer.select(F.col("_class").alias("_of")), F.col("_class").eqNullSafe(F.col("_of")), "left_anti")
            closer = closer.unionByName(settled.withColumn("_rim", F.lit(0).cast("bigint")))
        bounds = _written(closer, "bounds")
        last, size = size, bounds.agg(F.sum("_rim")).first()[0] or 0
        bounds = bounds.drop("_rim")
        if uniform or size <= rim_rows * parts or (last is not None and size > last / 2):
            break
    placed = rows.join(bounds, of_class)
    rim = placed.where(RIM).where(F.col("_cap") > F.col("_below")).select(*names, "_class", "_cap", "_below")
    ranked = numbered(rim, "_class", [F.col(quoted(order)), *ties], "_place", ranges)
    return placed.where(UNDER).select(*names).unionByName(
        ranked.where(F.col("_place") + F.col("_below") <= F.col("_cap")).select(*names)
    )


def _number(df: DataFrame, order: str) -> Column:
    """The order column as a number in the same order, or NULL."""
    kind, value = df.schema[order].dataType.typeName(), F.col(quoted(order))
    if kind == "date":
        return F.unix_date(value).cast("double")
    if kind in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(value.cast("timestamp")).cast("double") if kind == "timestamp" else F.timestamp_diff(
            "MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), value
        ).cast("double")
    if kind in ("byte", "short", "integer", "long", "float", "double") or kind.startswith("decimal"):
        return value.cast("double")
    return F.lit(None).cast("double")


def _narrowed(rim: DataFrame, uniform: bool) -> DataFrame:
    """Bounds with cuts closer to the caps, and ``_rim``, the rows left between them."""
    bounds = ["_class", "_cap", "_low", "_high", "_below"]
    number = F.when(~F.isnan("_at"), F.col("_at"))
    sketch = F.lit(None) if uniform else F.kll_sketch_agg_double(number, SKETCH_K)
    sizes = rim.groupBy(*bounds).agg(
        F.count(F.lit(1)).alias("_n"), F.count(number).alias("_numbers"), sketch.alias("_sketch")
    )
    left, n = F.col("_cap") - F.col("_below"), F.nullif(F.col("_numbers"), F.lit(0))
    # With an even spread, six deviations of the number of rows under a cut.
    slack = 6 * F.sqrt(left + 1.0) / n if uniform else F.lit(SLACK)
    low, high = left / n - slack, left / n + slack
    if uniform:
        at = lambda share, _: share
    else:
        steps = F.kll_sketch_get_quantile_double("_sketch", F.array(*[F.lit(i / STEPS) for i in range(STEPS + 1)]))
        at = lambda share, near: F.get(steps, near(share * STEPS).cast("int"))
    cut = (F.col("_n") > left) & (left > 0)
    # Written, since sketches draw lots: all that follows must see the same cuts.
    cuts = _written(
        sizes.select(
            F.col("_class").alias("_of"), "_n", (F.col("_n") <= left).alias("_passes"),
            F.when(cut & (low > 0) & (low < 1), at(low, F.floor)).alias("_new_low"),
            F.when(cut & (high > 0) & (high < 1), at(high, F.ceil)).alias("_new_high"),
        ),
        "cuts",
    )
    counts = rim.join(cuts, F.col("_class").eqNullSafe(F.col("_of"))).groupBy(*bounds, *cuts.columns).agg(
        F.count_if(F.col("_at") < F.col("_new_low")).alias("_under"),
        F.count_if(F.col("_at") <= F.col("_new_high")).alias("_upto"),
    )
    # A cut on the wrong side of the cap is dropped.
    low_fits = F.col("_new_low").isNotNull() & (F.col("_under") <= left)
    high_fits = F.col("_new_high").isNotNull() & (F.col("_upto") >= left)
    under = F.when(low_fits, F.col("_under")).otherwise(0)
    return counts.select(
        "_class", "_cap", F.col("_passes").alias("_whole"),
        F.when(low_fits, F.col("_new_low")).otherwise(F.col("_low")).alias("_low"),
        F.when(high_fits, F.col("_new_high")).otherwise(F.col("_high")).alias("_high"),
        (F.col("_below") + under).alias("_below"),
        F.when(F.col("_passes"), 0).otherwise(F.when(high_fits, F.col("_upto")).otherwise(F.col("_n")) - under).alias("_rim"),
    )


def _written(df: DataFrame, purpose: str) -> DataFrame:
    place = scratch_path(df.sparkSession, purpose)
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)
