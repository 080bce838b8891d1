"""Column functions on text: trimming, fences, counts, token numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes.
PYTHON_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Fixed value: the stand-in for a model vocabulary, a word or one punctuation mark.
TOKEN_PATTERN = r"[A-Za-z0-9]+|[^A-Za-z0-9 \n\t\r]"
WORD_PATTERN = "[A-Za-z0-9]+"
SPACES = (" ", "\n", "\t", "\r")

# The mark of a code fence, and its opening with an optional language name.
FENCE = "```"
FENCE_OPENING = "^```(?:sql)?"


def py_strip(text: Column) -> Column:
    """Trim as Python does; SQL ``trim`` alone only removes spaces."""
    return F.btrim(text, F.lit(PYTHON_WHITESPACE))


def is_blank(text: Column) -> Column:
    """True for missing text and for text of whitespace only."""
    return F.coalesce(py_strip(text) == "", F.lit(True))


def strip_fence(text: Column) -> Column:
    """Take the body out of a code fence, when the text starts with one."""
    trimmed = py_strip(text)
    opened = py_strip(F.regexp_replace(trimmed, f"(?iu){FENCE_OPENING}", ""))
    closed = py_strip(F.left(opened, F.length(opened) - 3))
    body = F.when(F.endswith(opened, F.lit(FENCE)), closed).otherwise(opened)
    return F.when(F.startswith(trimmed, F.lit(FENCE)), body).otherwise(trimmed)


def parse_count(value: Column) -> Column:
    """Whole number from text with commas or decimals; NULL when blank or junk."""
    digits = F.replace(py_strip(value.cast("string")), F.lit(","), F.lit(""))
    numeric = digits.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    return F.when(numeric, digits).try_cast("double").try_cast("bigint")


def is_bad_count(value: Column) -> Column:
    """True where a count was given but is not a number."""
    return ~is_blank(value.cast("string")) & parse_count(value).isNull()


def token_count(text: Column) -> Column:
    """Number of matches of TOKEN_PATTERN in a text; 0 for missing text.

    Words shrink to one letter and spaces go, so the length is the number of tokens.
    ``regexp_count`` would build every match as a string first and takes twice as long.
    """
    marks = F.regexp_replace(text, WORD_PATTERN, "w")
    for space in SPACES:
        marks = F.replace(marks, F.lit(space), F.lit(""))
    return F.coalesce(F.length(marks), F.lit(0)).cast("bigint")


def quoted(name: str) -> str:
    """A column name that Spark resolves literally."""
    return "`" + name.replace("`", "``") + "`"
