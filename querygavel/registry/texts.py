"""Registered queries: preparation of text, and search in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querygavel.functions.categories import in_categories
from querygavel.functions.chat import END_OF_MESSAGE, SYSTEM_TEXT, rendered_tokens, text_to_sql_chat
from querygavel.functions.text import TOKEN_PATTERN, is_bad_count, parse_count, strip_fence, token_count
from querygavel.operators.chats import chat_lengths, render_chats
from querygavel.operators.lengths import cut_long, eval_sample, head, with_length, within_budget
from querygavel.operators.search import B, K1, bm25_search
from querygavel.plans.corpus import build_corpus
from querygavel.plans.prompts import build_prompts, prompt_rows
from querygavel.registry.common import quote, rounded, strip_sql, table
from querygavel.session import scratch_path
from querygavel.sources.candidates import read_prompt_rows
from querygavel.sources.sinks import write_scored
from querygavel.sources.tables import read_corpus

KEPT_SOURCES = [f"src{i}" for i in range(0, 20, 3)]
KEPT_SQL = ", ".join(quote(s) for s in KEPT_SOURCES)
SYSTEM_SQL = quote(SYSTEM_TEXT)
END_SQL = quote(END_OF_MESSAGE)
TOKENS_SQL = f"len(regexp_extract_all({{}}, {quote(TOKEN_PATTERN)}))"
SYSTEM_TOKENS_SQL = TOKENS_SQL.format(SYSTEM_SQL)


def category_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.where(in_categories(F.col("source"), KEPT_SOURCES)).select(
        "doc_id", "source", "text", "lang"
    )


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as prompt/query pairs; a third without a schema."""
    part = F.col("doc_id") % 3
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("source").alias("category"),
        F.col("text").alias("prompt"),
        F.concat(F.lit(" \n select "), F.col("doc_id").cast("string"), F.lit("\t\n")).alias("query"),
        F.when(part == 1, F.col("lang")).when(part == 2, F.lit("")).alias("schema"),
    )


PAIRS_SQL = """
SELECT doc_id, source AS category, text AS prompt, 'select ' || doc_id AS query,
       CASE WHEN doc_id % 3 = 1 THEN lang ELSE '' END AS schema FROM documents
"""

USER_SQL = r"""
CASE WHEN schema <> '' THEN concat('Write a DuckDB SQL query that solves the request', chr(10),
    'SQL Context:', chr(10), schema, chr(10), chr(10), 'Request:', chr(10), prompt)
  ELSE concat('Write a DuckDB SQL query that solves the request', chr(10), chr(10), 'Request:', chr(10), prompt) END
"""


def sft_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = _pairs(spark, sf_dir).select(
        "doc_id", text_to_sql_chat(F.col("prompt"), F.col("query"), F.col("schema")).alias("m")
    )
    return chats.select(
        "doc_id",
        F.array_join(F.col("m.role"), ",").alias("roles"),
        F.col("m")[0]["content"].alias("system_content"),
        F.col("m")[1]["content"].alias("user_content"),
        F.col("m")[2]["content"].alias("assistant_content"),
    )


SFT_SQL = f"""
SELECT doc_id, 'system,user,assistant' AS roles, {SYSTEM_SQL} AS system_content,
       {USER_SQL} AS user_content, query AS assistant_content FROM ({PAIRS_SQL})
"""


def corpus_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category, chat, budget and rendered text in one plan."""
    built = build_corpus(_pairs(spark, sf_dir), "doc_id", KEPT_SOURCES, budget=600)
    return built.select("doc_id", "n_tokens", "text")


CORPUS_SQL = f"""
SELECT doc_id, n_tokens, text FROM (
  SELECT doc_id, CAST({SYSTEM_TOKENS_SQL} + 1 + {TOKENS_SQL.format('u')} + 1 + {TOKENS_SQL.format('query')} + 1 AS BIGINT) AS n_tokens,
         concat({SYSTEM_SQL}, {END_SQL}, u, {END_SQL}, query, {END_SQL}) AS text
  FROM (SELECT doc_id, query, {USER_SQL} AS u FROM ({PAIRS_SQL}) WHERE category IN ({KEPT_SQL})))
WHERE n_tokens <= 600
"""


def chat_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render_chats(table(spark, sf_dir, "conversations"))


CHAT_SQL = f"""
WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations)
SELECT conv_id, concat(
    coalesce(max(CASE WHEN place = 1 AND role = 'system' THEN text END), {SYSTEM_SQL}), {END_SQL},
    coalesce(string_agg(CASE WHEN role IN ('user', 'assistant') THEN text || {END_SQL} END, '' ORDER BY turn), '')
  ) AS text
FROM t GROUP BY conv_id
"""

LENGTHS_SQL = f"""
WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place,
                  {TOKENS_SQL.format('text')} + 1 AS tokens FROM conversations)
SELECT conv_id, CAST(coalesce(max(CASE WHEN place = 1 AND role = 'system' THEN tokens END), {SYSTEM_TOKENS_SQL} + 1)
    + coalesce(sum(CASE WHEN role IN ('user', 'assistant') THEN tokens END), 0) AS BIGINT) AS n_tokens
FROM t GROUP BY conv_id
"""


def chat_render_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render_chats(table(spark, sf_dir, "conversations"), max_tokens=500)


def token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", token_count(F.col("text")).alias("n_tokens")
    )


def chat_length_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_lengths(table(spark, sf_dir, "conversations"))


def length_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = chat_lengths(table(spark, sf_dir, "conversations"))
    return within_budget(lengths, "n_tokens", "conv_id", 600)


def length_budget_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = chat_lengths(table(spark, sf_dir, "conversations"))
    return within_budget(lengths, "n_tokens", "conv_id", 1)


def _prompt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as rows of a scoring-prompt table."""
    key = F.col("doc_id").cast("string")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit(" table "), F.col("source"), F.lit("\n")).alias("SQL Context"),
        F.concat(F.lit("\t"), F.col("text"), F.lit(" \n")).alias("Question"),
        F.lit(" label ").alias("Answer Field"),
        F.concat(key, F.when(F.col("doc_id") % 2 == 0, ".0").otherwise("")).alias("Answer"),
        F.col("n_chars").cast("string").alias("Total Rows"),
        F.col("lang").alias("Attack Type"),
        F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("in "), F.col("lang"))).alias("Question Context"),
    )


PROMPT_SQL = f"""
SELECT doc_id, {SYSTEM_SQL} AS system_content, concat(
    CASE WHEN doc_id % 4 <> 0 THEN 'in ' || lang ELSE 'nan' END, chr(10), 'Request:', chr(10),
    {strip_sql('text')}, chr(10), chr(10), 'SQL Context:', chr(10), chr(10), 'table ', source, chr(10), chr(10)
  ) AS user_content, 'label' AS "column", lang AS "value", doc_id AS target_score, n_chars AS total_rows
FROM documents
"""

PROMPT_LENGTH_SQL = f"""
SELECT *, CAST({SYSTEM_TOKENS_SQL} + 1 + {TOKENS_SQL.format('user_content')} + 1 AS BIGINT) AS n_tokens
FROM ({PROMPT_SQL})
"""

CUT_SQL = f"""
WITH p AS ({PROMPT_LENGTH_SQL})
SELECT doc_id, n_tokens FROM p
WHERE n_tokens <= floor((SELECT quantile_cont(n_tokens, 0.9) FROM p))
"""


def prompt_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompt_rows(_prompt_rows(spark, sf_dir)).select(
        "doc_id",
        F.col("prompt")[0]["content"].alias("system_content"),
        F.col("prompt")[1]["content"].alias("user_content"),
        "column", "value", "target_score", "total_rows",
    )


def prompt_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same prompts from a scoring-prompt CSV, in which an absent context is an empty cell."""
    place = write_scored(_prompt_rows(spark, sf_dir), scratch_path(spark, "prompts") + ".csv")
    return prompt_rows(read_prompt_rows(spark, place)).select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("prompt")[0]["content"].alias("system_content"),
        F.col("prompt")[1]["content"].alias("user_content"),
        "column", "value", "target_score", "total_rows",
    )


def corpus_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same corpus from JSON files."""
    place = scratch_path(spark, "corpus")
    _pairs(spark, sf_dir).write.json(place)
    rows = read_corpus(spark, place, "json").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return build_corpus(rows, "doc_id", KEPT_SOURCES, budget=600).select("doc_id", "n_tokens", "text")


def prompt_p90_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = with_length(
        prompt_rows(_prompt_rows(spark, sf_dir)), "n_tokens", rendered_tokens(F.col("prompt"), size=2)
    )
    return cut_long(prompts, "n_tokens").select("doc_id", "n_tokens")


def eval_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, sample = build_prompts(_prompt_rows(spark, sf_dir), "doc_id")
    return sample.select("doc_id", "n_tokens")


def eval_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both parts of the disjoint split, each row with its part; together they are the table."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    training, held_out = eval_sample(docs, "doc_id", mode="hash")
    return training.withColumn("held_out", F.lit(False)).unionByName(held_out.withColumn("held_out", F.lit(True)))


def small_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return head(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", 512)


def strip_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, text = F.col("doc_id") % 5, F.col("text")
    fenced = (
        F.when(part == 0, F.concat(F.lit("```sql\n"), text, F.lit("\n```\n")))
        .when(part == 1, F.concat(F.lit("\t```SQL"), text, F.lit("```")))
        .when(part == 2, F.concat(F.lit("``` "), text))
        .when(part == 3, F.concat(text, F.lit("\n```sql\nx\n```")))
        .otherwise(text)
    )
    return table(spark, sf_dir, "documents").select("doc_id", strip_fence(fenced).alias("body"))


STRIP_SQL = f"""
SELECT doc_id, CASE WHEN doc_id % 5 IN (0, 1, 2, 4) THEN {strip_sql('text')}
    ELSE {strip_sql("concat(text, chr(10), '```sql', chr(10), 'x', chr(10), '```')")} END AS body
FROM documents
"""


def parse_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, key = F.col("o_orderkey") % 7, F.col("o_orderkey")
    text = (
        F.when(part == 0, F.format_number(key * 1000, 0))
        .when(part == 1, F.concat(F.lit(" "), key.cast("string"), F.lit(".9\n")))
        .when(part == 2, F.concat(F.lit("-"), key.cast("string"), F.lit(".5")))
        .when(part == 3, F.lit(" \t"))
        .when(part == 4, F.concat(key.cast("string"), F.lit("e2")))
        .when(part == 5, F.concat(F.lit("about "), key.cast("string")))
    )
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", parse_count(text).alias("n"), is_bad_count(text).alias("bad")
    )


PARSE_SQL = """
SELECT o_orderkey, CAST(CASE o_orderkey % 7 WHEN 0 THEN o_orderkey * 1000 WHEN 1 THEN o_orderkey
    WHEN 2 THEN -o_orderkey WHEN 4 THEN o_orderkey * 100 END AS BIGINT) AS n, o_orderkey % 7 = 5 AS bad
FROM orders
"""


def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return bm25_search(docs, asked, k=10)


BM25_SQL = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS words FROM documents),
c AS (SELECT count(*) AS n, avg(len(words)) AS mean_length FROM w),
q AS (SELECT DISTINCT item_id AS query_id,
             unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM benchmark),
p AS (SELECT doc_id, dl, term, count(*) AS tf
      FROM (SELECT doc_id, len(words) AS dl, unnest(words) AS term FROM w) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * ({K1}::DOUBLE + 1)
        / (tf + {K1}::DOUBLE * (1 - {B}::DOUBLE + {B}::DOUBLE * dl / mean_length))), 6) AS score
      FROM q JOIN f USING (term) JOIN p USING (term) CROSS JOIN c GROUP BY ALL)
SELECT * FROM (SELECT query_id, doc_id, score, CAST(row_number() OVER (
    PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS place FROM s) WHERE place <= 10
"""

QUERIES = {
    "category_keep": (
        category_keep, f"SELECT doc_id, source, text, lang FROM documents WHERE source IN ({KEPT_SQL})"
    ),
    "sft_format": (sft_format, SFT_SQL),
    "corpus_build": (corpus_build, CORPUS_SQL),
    "chat_render": (chat_render, CHAT_SQL),
    "chat_render_budget": (
        chat_render_budget,
        f"SELECT conv_id, text FROM ({CHAT_SQL}) JOIN ({LENGTHS_SQL}) USING (conv_id) WHERE n_tokens <= 500",
    ),
    "token_lengths": (
        token_lengths,
        f"SELECT conv_id, turn, CAST({TOKENS_SQL.format('text')} AS BIGINT) AS n_tokens FROM conversations",
    ),
    "chat_lengths": (chat_length_table, LENGTHS_SQL),
    "length_budget": (length_budget, f"SELECT * FROM ({LENGTHS_SQL}) WHERE n_tokens <= 600"),
    "length_budget_fallback": (
        length_budget_fallback, f"SELECT * FROM ({LENGTHS_SQL}) ORDER BY conv_id LIMIT 1"
    ),
    "prompt_build": (prompt_build, PROMPT_SQL),
    "prompt_file": (prompt_file, PROMPT_SQL),
    "corpus_file": (corpus_file, CORPUS_SQL),
    "prompt_p90_cut": (prompt_p90_cut, CUT_SQL),
    "eval_head": (eval_head, f"{CUT_SQL} ORDER BY doc_id LIMIT 32"),
    "eval_hash": (
        eval_hash,
        "SELECT doc_id, lang, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 10 = 0 AS held_out FROM documents",
    ),
    "small_head": (small_head, "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 512"),
    "strip_fence": (strip_fences, STRIP_SQL),
    "parse_count": (parse_counts, PARSE_SQL),
    "bm25_search": (bm25, BM25_SQL),
}
