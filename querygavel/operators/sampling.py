"""Samples of exact size by hash priorities: the same rows whatever the partitions, and in any engine with MD5."""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querygavel.functions.text import quoted
from querygavel.operators.firsts import first_rows


def hash_share(key: Column, seed: int = 0) -> Column:
    """A share between 0 and 1, both excluded, by the first 52 bits of an MD5 of ``seed:key``; a NULL key counts as empty text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint")
    return (bits + F.lit(0.5)) / F.lit(2.0**52)


def uniform_sample(df: DataFrame, key: str, size: int, seed: int = 0) -> DataFrame:
    """``size`` rows, or all if there are fewer: those with the least hash shares of ``key``.

    Samples of parts merge: the sample of a union is the sample of the samples' union. Rows of equal keys have equal
    shares; what of them stays is decided by their other columns.
    """
    return _least(df.withColumn("_stratum", _whole_table(key)), hash_share(F.col(quoted(key)), seed), key, size, True, df.columns)


def stratified_sample(
    df: DataFrame, label: str, key: str, sizes: int | Mapping[str, int], seed: int = 0
) -> DataFrame:
    """``sizes`` rows of every class, or of each named one; all rows of smaller classes. A NULL label is a class too."""
    rows = df.withColumn("_stratum", F.col(quoted(label)).cast("string"))
    return _least(rows, hash_share(F.col(quoted(key)), seed), key, sizes, True, df.columns)


def weighted_sample(
    df: DataFrame, key: str, weight: str, size: int, seed: int = 0, label: str | None = None
) -> DataFrame:
    """``size`` rows without replacement, drawn by weight, of the table or of each class of ``label``.

    Each row waits for an exponential time at the rate of its weight, and the first ones win, as in the published
    one-pass method of weighted reservoirs. Rows without a positive finite weight are never drawn.
    """
    rate = F.col(quoted(weight)).cast("double")
    rows = df.where((rate > 0) & (rate < float("inf"))).withColumn(
        "_stratum", _whole_table(key) if label is None else F.col(quoted(label)).cast("string")
    )
    return _least(rows, -F.log(hash_share(F.col(quoted(key)), seed)) / rate, key, size, False, df.columns)


def _whole_table(key: str) -> Column:
    """An empty text in every row. A literal would turn the join with the cuts into a nested loop."""
    return F.substring(F.coalesce(F.col(quoted(key)).cast("string"), F.lit("")), 1, 0)


def _least(
    rows: DataFrame, priority: Column, key: str, sizes: int | Mapping[str, int], uniform: bool, columns: list[str]
) -> DataFrame:
    if isinstance(sizes, Mapping):
        wanted = [(name, int(size)) for name, size in sizes.items()]
        caps = rows.sparkSession.createDataFrame(wanted, "_stratum string, cap bigint")
    else:
        caps = rows.groupBy("_stratum").agg(F.lit(int(sizes)).cast("bigint").alias("cap"))
    ties = [F.col(quoted(key)), F.xxhash64(*[F.col(quoted(name)) for name in columns])]
    drawn = first_rows(rows.withColumn("_priority", priority), "_stratum", "_priority", ties, caps, uniform=uniform)
    return drawn.select(*[F.col(quoted(name)) for name in columns])
