"""Tables and SQL fragments shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querygavel.functions.text import PYTHON_WHITESPACE

BAND = "CASE WHEN o_totalprice >= 450000 THEN 'HIGH' ELSE 'LOW' END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("band", F.expr(BAND))


def with_targets(candidates: DataFrame, orders: DataFrame, positive: str = "HIGH") -> DataFrame:
    """Add the known truth to candidates, written with thousands separators."""
    truth = orders.agg(
        F.struct(
            F.format_number(F.count_if(F.col("band") == positive), 0).alias("target"),
            F.format_number(F.count(F.lit(1)), 0).alias("total"),
        )
    ).scalar()
    return candidates.withColumns(
        {
            "label_col": F.lit("band"),
            "positive_value": F.lit(positive),
            "target_rows": truth["target"],
            "total_rows": truth["total"],
        }
    )


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({name: F.round(F.col(name), digits) for name in names})


def number_text(number: Column) -> Column:
    return number.cast("bigint").cast("string")


def quote(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def strip_sql(expression: str) -> str:
    return f"trim({expression}, {quote(PYTHON_WHITESPACE)})"


ORDERS_SQL = f"SELECT *, {BAND} AS band FROM orders"

TRUTH_SQL = f"""
SELECT count(*) FILTER (WHERE band = 'HIGH') AS target, count(*) AS total FROM ({ORDERS_SQL})
"""


def measures_sql(source: str) -> str:
    """All measures over a relation that has tp, fp, target and total."""
    share = "CASE WHEN {w} > 0 THEN CAST({p} AS DOUBLE) / CAST({w} AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"
    return f"""
SELECT *, CASE WHEN "precision" > 0.95 AND "recall" > 0.95 THEN weighted_f + 1 + 2
               WHEN "precision" > 0.8 AND "recall" > 0.8 THEN weighted_f + 1
               ELSE weighted_f END AS score
FROM (
  SELECT *,
    CASE WHEN "precision" + "recall" > 0
         THEN CAST(2 AS DOUBLE) * "precision" * "recall" / ("precision" + "recall")
         ELSE CAST(0 AS DOUBLE) END AS f1,
    CASE WHEN "precision" + "recall" > 0
         THEN CAST(3.25 AS DOUBLE) * "precision" * "recall"
              / (CAST(1.5 AS DOUBLE) * "precision" + "recall")
         ELSE CAST(0 AS DOUBLE) END / CAST(1.3 AS DOUBLE) AS weighted_f
  FROM (
    SELECT *,
      {share.format(p="tp", w="(tp + fp)")} AS "precision",
      {share.format(p="tp", w="(tp + fn)")} AS "recall"
    FROM (
      SELECT *, target - tp AS fn, total - tp - fp - (target - tp) AS tn FROM ({source})
    )
  )
)
"""
