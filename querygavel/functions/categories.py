"""Corpus categories that are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The categories of SQL features that a corpus row may have.
KEPT_CATEGORIES = """
guides/sql_features/asof_join
guides/sql_features/full_text_search
sql/aggregates
sql/case_sensitivity
sql/configuration
sql/constraints
sql/data_types/bitstring
sql/data_types/blob
sql/data_types/boolean
sql/data_types/date
sql/data_types/enum
sql/data_types/interval
sql/data_types/list
sql/data_types/map
sql/data_types/nulls
sql/data_types/numeric
sql/data_types/overview
sql/data_types/struct
sql/data_types/text
sql/data_types/time
sql/data_types/timestamp
sql/data_types/timezones
sql/data_types/union
sql/duckdb_table_functions
sql/expressions/case
sql/expressions/cast
sql/expressions/collations
sql/expressions/comparison_operators
sql/expressions/in
sql/expressions/logical_operators
sql/expressions/overview
sql/expressions/star
sql/expressions/subqueries
sql/functions/bitstring
sql/functions/blob
sql/functions/char
sql/functions/date
sql/functions/dateformat
sql/functions/datepart
sql/functions/enum
sql/functions/interval
sql/functions/nested
sql/functions/numeric
sql/functions/overview
sql/functions/patternmatching
sql/functions/time
sql/functions/timestamp
sql/functions/timestamptz
sql/functions/utility
sql/indexes
sql/information_schema
sql/introduction
sql/query_syntax/filter
sql/query_syntax/from
sql/query_syntax/groupby
sql/query_syntax/grouping_sets
sql/query_syntax/having
sql/query_syntax/limit
sql/query_syntax/orderby
sql/query_syntax/qualify
sql/query_syntax/sample
sql/query_syntax/select
sql/query_syntax/setops
sql/query_syntax/unnest
sql/query_syntax/values
sql/query_syntax/where
sql/query_syntax/window
sql/query_syntax/with
sql/samples
sql/statements/create_macro
sql/statements/create_schema
sql/statements/create_sequence
sql/statements/pivot
sql/statements/select
sql/statements/unpivot
sql/window_functions
""".split()


def keep_categories(df: DataFrame, column: str = "category", kept=KEPT_CATEGORIES) -> DataFrame:
    """Rows whose category is listed; a missing category is dropped."""
    return df.where(in_categories(F.col(column), kept))


def in_categories(column: Column, kept=KEPT_CATEGORIES) -> Column:
    return column.isin(list(kept))
