"""Read candidate and scoring-prompt tables from CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querygavel.functions.text import quoted

# Cell texts that count as missing.
MISSING_CELLS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# The columns of the two kinds of files.
CANDIDATE_COLUMNS = ("Output", "Column", "Attack Type", "Expected Rows", "Total Rows")
PROMPT_COLUMNS = (
    "SQL Context", "Question", "Answer Field", "Answer", "Total Rows", "Attack Type",
    "Question Context",
)


def read_table_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; quoted cells may span lines; missing cells become NULL.

    A file with cells over several lines cannot be split, so many candidates belong
    in many files or in parquet. All files must have the same header: one with other
    columns, or the same in another order, fails.
    """
    raw = (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("enforceSchema", False)
        .csv(path)
    )
    cells = [
        F.when(~F.col(quoted(name)).isin(*MISSING_CELLS), F.col(quoted(name))).alias(name)
        for name in raw.columns
    ]
    return raw.select(*cells)


def require_columns(df: DataFrame, required, what: str) -> DataFrame:
    """Fail before any job, naming the absent columns."""
    absent = [name for name in required if name not in df.columns]
    if absent:
        raise ValueError(f"{what} is missing required columns: {absent}")
    return df


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    return require_columns(read_table_csv(spark, path), CANDIDATE_COLUMNS, path)


def read_prompt_rows(spark: SparkSession, path: str) -> DataFrame:
    return require_columns(read_table_csv(spark, path), PROMPT_COLUMNS, path)
