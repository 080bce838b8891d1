"""Text-to-SQL corpus: category, chat, length budget, rendered text."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querygavel.functions.categories import KEPT_CATEGORIES, keep_categories
from querygavel.functions.chat import render, rendered_tokens, text_to_sql_chat
from querygavel.operators.lengths import SMALL_CORPUS, TOKEN_BUDGET, head, with_length, within_budget


def build_corpus(
    rows: DataFrame,
    ordinal: str,
    kept=KEPT_CATEGORIES,
    budget: int = TOKEN_BUDGET,
    small: bool = False,
    counter: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """``ordinal, prompt, query, schema, messages, n_tokens, text`` from prompt/query pairs.

    Texts are read and their tokens counted once, without a shuffle but for the small run's head; chats
    within the budget are written to the shared folder and rendered from there. ``counter`` counts the
    tokens of the rendered text in place of the built-in stand-in.
    """
    pairs = keep_categories(rows, "category", kept).select(ordinal, "prompt", "query", "schema")
    if small:
        pairs = head(pairs, ordinal, SMALL_CORPUS)
    chats = pairs.withColumn(
        "messages", text_to_sql_chat(F.col("prompt"), F.col("query"), F.col("schema"))
    )
    messages = F.col("messages")
    n_tokens = counter(render(messages)) if counter else rendered_tokens(messages, size=3)
    sized = with_length(chats, "n_tokens", n_tokens)
    fitting = within_budget(sized, "n_tokens", ordinal, budget)
    return fitting.withColumn("text", render(F.col("messages")))
