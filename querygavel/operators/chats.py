"""Chats kept as turns: ``conv_id, turn, role, text``, one row per turn."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querygavel.functions.chat import END_OF_MESSAGE, RENDERED_ROLES, SYSTEM_TEXT
from querygavel.functions.text import token_count

# Turns that are joined in one task; a longer chat is joined from such segments.
SEGMENT_TURNS = 64


def chat_lengths(
    turns: DataFrame,
    system_text: str = SYSTEM_TEXT,
    counter: Callable[[Column], Column] = token_count,
) -> DataFrame:
    """``conv_id, n_tokens`` of the rendered chat, every end mark being one token.

    A sum and two minima per chat, combined before the shuffle: no chat is gathered.
    """
    tokens = counter(F.col("text")) + 1
    kept = F.col("role").isin(*RENDERED_ROLES)
    # The first turn counts as opening if it is a system turn, else the default text opens.
    opening = F.struct(
        "turn", (F.col("role") == "system").alias("is_system"), tokens.alias("tokens")
    )
    per_chat = turns.groupBy("conv_id").agg(
        F.sum(F.when(kept, tokens).otherwise(0)).alias("body"), F.min(opening).alias("first")
    )
    default = counter(F.lit(system_text)) + 1
    return per_chat.select(
        "conv_id",
        (
            F.col("body") + F.when(F.col("first.is_system"), F.col("first.tokens")).otherwise(default)
        ).alias("n_tokens"),
    )


def chat_segments(turns: DataFrame, end: str = END_OF_MESSAGE) -> DataFrame:
    """``conv_id, segment, opening, body``: rendered pieces of at most SEGMENT_TURNS turns.

    ``opening`` is the text of a system turn that leads its segment; it only counts in the
    first segment of a chat. Turn numbers are unique within a chat.
    """
    row = F.struct("turn", "role", "text")
    gathered = turns.groupBy(
        "conv_id", F.floor(F.col("turn") / SEGMENT_TURNS).alias("segment")
    ).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    first = F.get("rows", F.lit(0))
    kept = F.filter("rows", lambda r: r["role"].isin(*RENDERED_ROLES))
    body = F.array_join(F.transform(kept, lambda r: F.concat(r["text"], F.lit(end))), "")
    return gathered.select(
        "conv_id",
        "segment",
        F.when(first["role"] == "system", first["text"]).alias("opening"),
        body.alias("body"),
    )


def render_chats(
    turns: DataFrame,
    end: str = END_OF_MESSAGE,
    system_text: str = SYSTEM_TEXT,
    max_tokens: int | None = None,
) -> DataFrame:
    """``conv_id, text``: each chat as one string.

    With ``max_tokens``, lengths are counted first and longer chats are left out before
    anything is gathered, which bounds the size of every group.
    """
    if max_tokens is not None:
        fitting = chat_lengths(turns, system_text).where(F.col("n_tokens") <= max_tokens)
        turns = turns.join(fitting.select("conv_id"), "conv_id", "left_semi")
    pieces = chat_segments(turns, end).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("segment", "opening", "body"))).alias("pieces")
    )
    opening = F.coalesce(F.get("pieces", F.lit(0))["opening"], F.lit(system_text))
    return pieces.select(
        "conv_id",
        F.concat(opening, F.lit(end), F.array_join(F.col("pieces.body"), "")).alias("text"),
    )
