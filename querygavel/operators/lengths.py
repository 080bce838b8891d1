"""Cut tables by length, and take heads of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from querygavel.session import scratch_path

# The token budget of a chat, the share of prompts kept, the limit of an empty table.
TOKEN_BUDGET = 4096
KEPT_SHARE = 0.9
EMPTY_LIMIT = 128

# Sizes of the small samples.
SMALL_CORPUS, SMALL_PROMPTS = 512, 32
EVAL_ROWS, SMALL_EVAL_ROWS = 32, 8


def head(df: DataFrame, ordinal: str, n: int) -> DataFrame:
    """First rows by an explicit order."""
    return df.orderBy(ordinal).limit(n)


def with_length(df: DataFrame, name: str, length: Column) -> DataFrame:
    """Add a length that costs a pass over the text.

    As the output of a generator it is counted once per row; as a plain column it would be
    counted again in every filter that uses it.
    """
    return df.select("*", F.inline_outer(F.array(F.struct(length.alias(name)))))


def within_budget(
    df: DataFrame, length: str, ordinal: str, budget: int = TOKEN_BUDGET
) -> DataFrame:
    """Rows up to the budget; when there is none, the first row of the table.

    Runs at once, and reads the table once: fitting rows are written to the shared folder while their number
    and the first row of the table are observed. Both stay right when a task runs twice, since only
    "any" and a minimum are asked. Without a fitting row, the first one is read again, alone.
    """
    fits, seen = F.col(length) <= budget, Observation()
    place = scratch_path(df.sparkSession, "fitting")
    observed = df.observe(seen, F.count_if(fits).alias("fitting"), F.min(ordinal).alias("first"))
    observed.where(fits).write.parquet(place)
    if seen.get["fitting"] or seen.get["first"] is None:
        return df.sparkSession.read.schema(df.schema).parquet(place)
    return df.where(F.col(ordinal) == F.lit(seen.get["first"]))


def length_limit(df: DataFrame, length: str, share: float = KEPT_SHARE) -> DataFrame:
    """One row ``length_limit``: the exact quantile, rounded down.

    Equal lengths are counted first, so the quantile sees one row per distinct length.
    """
    distinct = df.groupBy(length).agg(F.count(F.lit(1)).alias("n_rows"))
    exact = F.percentile(length, share, F.col("n_rows"))
    return distinct.agg(
        F.coalesce(F.floor(exact).cast("bigint"), F.lit(EMPTY_LIMIT)).alias("length_limit")
    )


def cut_long(df: DataFrame, length: str, share: float = KEPT_SHARE) -> DataFrame:
    """Rows whose length does not exceed the quantile of all lengths."""
    return df.where(F.col(length) <= length_limit(df, length, share).scalar())


def eval_sample(
    df: DataFrame, ordinal: str, n: int = EVAL_ROWS, mode: str = "head", parts: int = 10
) -> tuple[DataFrame, DataFrame]:
    """Training rows and evaluation rows.

    ``head`` evaluates on the first rows of the training table itself; ``hash`` keeps the
    two apart, sending every parts-th row by hash to evaluation.
    """
    if mode == "head":
        return df, head(df, ordinal, n)
    if mode != "hash":
        raise ValueError(f"unknown mode: {mode}")
    held_out = _held_out(F.col(ordinal), parts)
    return df.where(~held_out), df.where(held_out)


def _held_out(key: Column, parts: int) -> Column:
    """By the first 32 bits of an MD5, which other engines have too; a NULL key counts as empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % parts == 0
