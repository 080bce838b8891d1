"""Leak guard: a candidate must not name the class it is meant to find."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The penalties.
LEAK_BOTH = -5.0
LEAK_VALUE = -2.0
FAILED = -20.0


def leak_status(sql: Column, label_col: Column, value: Column) -> Column:
    """``leak_both``, ``leak_value`` or NULL; a case-blind substring test.

    Naming the label column alone is allowed.
    """
    text = F.lower(sql)
    names_value = F.contains(text, F.lower(value))
    names_column = F.contains(text, F.lower(label_col))
    return F.when(names_value & names_column, F.lit("leak_both")).when(
        names_value, F.lit("leak_value")
    )


def leak_penalty(sql: Column, label_col: Column, value: Column) -> Column:
    """Score of a leaking candidate, NULL for a clean one."""
    status = leak_status(sql, label_col, value)
    return F.when(status == "leak_both", F.lit(LEAK_BOTH)).when(
        status == "leak_value", F.lit(LEAK_VALUE)
    )
