"""Scoring prompts: typed rows, percentile cut, evaluation sample."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querygavel.functions.chat import filled, render, rendered_tokens, scoring_prompt
from querygavel.operators.lengths import (
    EVAL_ROWS,
    SMALL_EVAL_ROWS,
    SMALL_PROMPTS,
    cut_long,
    eval_sample,
    head,
    with_length,
)
from querygavel.sources.candidates import PROMPT_COLUMNS, require_columns


def whole_number(value: Column, what: str) -> Column:
    """Count of a prompt row; text with commas and missing counts stop the run."""
    number = value.cast("double").cast("bigint")
    return F.when(value.isNotNull(), number).otherwise(
        F.raise_error(F.lit(f"{what} is missing")).cast("bigint")
    )


def prompt_rows(rows: DataFrame) -> DataFrame:
    """``prompt, column, value, target_score, total_rows`` plus columns not used here."""
    require_columns(rows, PROMPT_COLUMNS, "prompt table")
    others = [name for name in rows.columns if name not in PROMPT_COLUMNS]
    return rows.select(
        *others,
        scoring_prompt(
            F.col("`Question Context`"), F.col("Question"), F.col("`SQL Context`")
        ).alias("prompt"),
        filled(F.col("`Answer Field`")).alias("column"),
        filled(F.col("`Attack Type`")).alias("value"),
        whole_number(F.col("Answer"), "Answer").alias("target_score"),
        whole_number(F.col("`Total Rows`"), "Total Rows").alias("total_rows"),
    )


def build_prompts(
    rows: DataFrame,
    ordinal: str,
    small: bool = False,
    mode: str = "head",
    counter: Callable[[Column], Column] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Prompts for training and for evaluation, without the longest tenth."""
    if small:
        rows = head(rows, ordinal, SMALL_PROMPTS)
    prompt = F.col("prompt")
    n_tokens = counter(render(prompt)) if counter else rendered_tokens(prompt, size=2)
    prompts = with_length(prompt_rows(rows), "n_tokens", n_tokens)
    kept = cut_long(prompts, "n_tokens")
    return eval_sample(kept, ordinal, SMALL_EVAL_ROWS if small else EVAL_ROWS, mode)
