"""Chat messages as array<struct<role,content>> columns."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from querygavel.functions.text import py_strip, token_count

# Fixed value: the text of the system message.
SYSTEM_TEXT = (
    "You are an expert DuckDB SQL assistant.\n"
    "Take the user request, problem background, and SQL context and return a DuckDB-compatible SQL query.\n"
    "Use any DuckDB clauses, functions, aggregations, or joins needed to make the best query possible\n"
)

# The end mark of a message and the roles that are rendered after the first message.
END_OF_MESSAGE = "<|im_end|>"
RENDERED_ROLES = ("user", "assistant")

# The user messages, with the names of the texts they hold in braces.
REQUEST_WITH_SCHEMA = (
    "Write a DuckDB SQL query that solves the request\n"
    "SQL Context:\n{schema}\n\n"
    "Request:\n{prompt}"
)
REQUEST_ALONE = "Write a DuckDB SQL query that solves the request\n\nRequest:\n{prompt}"
SCORING_REQUEST = "{question_context}\nRequest:\n{question}\n\nSQL Context:\n\n{sql_context}\n\n"


def fill(template: str, **texts: Column) -> Column:
    """A template with columns in place of the names in braces."""
    pieces = [
        (F.lit(literal), texts[name] if name else F.lit(""))
        for literal, name, _, _ in Formatter().parse(template)
    ]
    return F.concat(*[column for pair in pieces for column in pair])


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def text_to_sql_chat(prompt: Column, query: Column, schema: Column) -> Column:
    """System, user and assistant message of one prompt/query pair.

    The query is trimmed, the prompt is not; a missing schema counts as empty.
    """
    context = F.coalesce(schema, F.lit(""))
    with_context = fill(REQUEST_WITH_SCHEMA, schema=context, prompt=prompt)
    bare = fill(REQUEST_ALONE, prompt=prompt)
    return F.array(
        message("system", F.lit(SYSTEM_TEXT)),
        message("user", F.when(context != "", with_context).otherwise(bare)),
        message("assistant", py_strip(query)),
    )


def filled(text: Column) -> Column:
    """Trimmed text; missing text becomes ``nan``, as in the scoring prompts."""
    return F.coalesce(py_strip(text.cast("string")), F.lit("nan"))


def scoring_prompt(question_context: Column, question: Column, sql_context: Column) -> Column:
    """System and user message that ask for a query."""
    user = fill(
        SCORING_REQUEST,
        question_context=filled(question_context),
        question=filled(question),
        sql_context=filled(sql_context),
    )
    return F.array(message("system", F.lit(SYSTEM_TEXT)), message("user", user))


def render(messages: Column, end: str = END_OF_MESSAGE, system_text: str = SYSTEM_TEXT) -> Column:
    """One string per chat: the opening system text, then user and assistant messages.

    Other roles, and system messages after the first message, are left out.
    """
    first = F.get(messages, F.lit(0))
    opening = F.when(first["role"] == "system", first["content"]).otherwise(F.lit(system_text))
    kept = F.filter(messages, lambda m: m["role"].isin(*RENDERED_ROLES))
    tail = F.array_join(F.transform(kept, lambda m: F.concat(m["content"], F.lit(end))), "")
    return F.concat(opening, F.lit(end), tail)


def rendered_tokens(
    messages: Column, system_text: str = SYSTEM_TEXT, size: int | None = None
) -> Column:
    """Token number of the rendered chat; every end mark is one token.

    With a known ``size`` the messages are counted one by one, which stays in generated
    code; otherwise by a function over the array.
    """
    one = F.lit(1).cast("bigint")
    first = F.get(messages, F.lit(0))
    opening = F.when(first["role"] == "system", token_count(first["content"])).otherwise(
        token_count(F.lit(system_text))
    )

    def counted(m: Column) -> Column:
        return F.when(m["role"].isin(*RENDERED_ROLES), token_count(m["content"]) + one).otherwise(
            F.lit(0).cast("bigint")
        )

    if size is None:
        body = F.aggregate(messages, F.lit(0).cast("bigint"), lambda total, m: total + counted(m))
    else:
        body = sum((counted(F.get(messages, F.lit(i))) for i in range(1, size)), counted(first))
    return opening + one + body


def completion_text(completion: Column) -> Column:
    """Text of the first message of a completion, trimmed."""
    return py_strip(F.get(completion, F.lit(0))["content"])
