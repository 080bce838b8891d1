"""Open labelled tables and text corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from querygavel.sources.candidates import require_columns

CORPUS_COLUMNS = ("category", "prompt", "query", "schema")


def open_table(spark: SparkSession, location: str, view: str | None = None) -> DataFrame:
    """A catalog table by name or a parquet path; optionally registered as a view."""
    df = spark.read.parquet(location) if "/" in location else spark.table(location)
    if view:
        df.createOrReplaceTempView(view)
    return df


def read_corpus(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """Prompt/query pairs from local parquet or JSON files."""
    df = spark.read.json(path) if form == "json" else spark.read.parquet(path)
    return require_columns(df, CORPUS_COLUMNS, path)
