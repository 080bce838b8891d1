"""Read reward logs: lines ``reward, epoch`` and, at the end, one line of run statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The entries of the statistics line.
TRAILER_ENTRIES = (
    "train_runtime", "train_samples_per_second", "train_steps_per_second", "train_loss", "epoch",
)


def numbered_lines(spark: SparkSession, path: str, whole_folders: bool = False) -> DataFrame:
    """``file, line_no, value`` with line numbers from 1, for files of any size.

    Splits number their own lines; a running count over the few splits of a file
    shifts them, so no file has to pass through one task. With ``whole_folders`` a log is a folder:
    ``file`` names it, and the lines of its files follow each other in the order of the file names.
    """
    part = F.col("_metadata.file_path")
    lines = spark.read.text(path).select(
        (F.regexp_replace(part, "/[^/]*$", "") if whole_folders else part).alias("file"),
        part.alias("part"),
        F.col("_metadata.file_block_start").alias("split_start"),
        F.monotonically_increasing_id().alias("position"),
        "value",
    )
    splits = lines.groupBy("file", "part", "split_start").agg(
        F.min("position").alias("first_position"), F.count(F.lit(1)).alias("n_lines")
    )
    earlier = Window.partitionBy("file").orderBy("part", "split_start").rowsBetween(
        Window.unboundedPreceding, -1
    )
    shifts = splits.select(
        "part",
        "split_start",
        "first_position",
        F.coalesce(F.sum("n_lines").over(earlier), F.lit(0)).alias("lines_before"),
    )
    line_no = F.col("position") - F.col("first_position") + F.col("lines_before") + 1
    return lines.join(shifts, ["part", "split_start"]).select(
        "file", line_no.alias("line_no"), "value"
    )


def _cells(value: Column) -> tuple[Column, Column]:
    cells = F.split(value, r",\s*")
    return F.get(cells, F.lit(0)).try_cast("double"), F.get(cells, F.lit(1)).try_cast("double")


def reward_curve(lines: DataFrame) -> DataFrame:
    """Lines that hold two numbers, as ``file, line_no, reward, epoch``."""
    reward, epoch = _cells(F.col("value"))
    return lines.select("file", "line_no", reward.alias("reward"), epoch.alias("epoch")).where(
        F.col("reward").isNotNull() & F.col("epoch").isNotNull()
    )


def run_statistics(lines: DataFrame) -> DataFrame:
    """Lines of named numbers, one column per known entry."""
    reward, epoch = _cells(F.col("value"))
    entries = [
        F.nullif(
            F.regexp_extract("value", rf"'{name}':\s*([-+0-9.eE]+)", 1), F.lit("")
        ).try_cast("double").alias(name)
        for name in TRAILER_ENTRIES
    ]
    named = F.contains(F.col("value"), F.lit("':"))
    return lines.where((reward.isNull() | epoch.isNull()) & named).select(
        "file", "line_no", *entries
    )
