"""Write scored tables and summaries."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scored_name(path: str) -> str:
    """``<input>_scored<ext>``, the default place of a scored table."""
    stem, extension = os.path.splitext(path)
    return f"{stem}_scored{extension}"


def write_scored(df: DataFrame, path: str, form: str = "csv") -> str:
    """A folder of part files; text cells keep their newlines and the white space at their ends."""
    writer = df.write.mode("overwrite")
    if form == "csv":
        (
            writer.option("header", True)
            .option("quote", '"')
            .option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
            .csv(path)
        )
    else:
        writer.parquet(path)
    return path


def write_json(df: DataFrame, path: str) -> str:
    """JSON lines; an infinite number, which JSON lacks, becomes NULL plus a flag."""
    columns = []
    for field in df.schema.fields:
        column = F.col(field.name)
        if field.dataType.typeName() in ("double", "float"):
            infinite = column.isin(float("inf"), float("-inf"))
            columns.append(F.when(~infinite, column).alias(field.name))
            columns.append(F.coalesce(infinite, F.lit(False)).alias(f"{field.name}_infinite"))
        else:
            columns.append(column)
    df.select(*columns).write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return path
