"""Token numbers by a tokenizer the caller brings."""

from __future__ import annotations

from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import functions as F


def tokenizer_count(load: Callable[[], Callable[[str], list]]):
    """A column function like ``token_count`` that uses an external tokenizer.

    ``load`` returns the encode function; it runs once per Python worker, and texts arrive
    in Arrow batches.
    """

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for texts in batches:
            yield texts.map(lambda text: 0 if text is None else len(encode(text))).astype("int64")

    return count
