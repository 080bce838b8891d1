import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from querygavel.functions import chat, leak, measures
from querygavel.functions.text import is_bad_count, parse_count, py_strip, strip_fence, token_count


@pytest.mark.parametrize(
    "tp, fp, target, expected",
    [
        (10, 0, 10, 4.0),
        (9, 1, 10, 1.9),
        (19, 1, 20, 1.95),
        (5, 0, 10, 0.625),
        (10, 10, 10, 0.5 * 3.25 / 1.75 / 1.3),
        (20, 0, 10, 3.25 * 2 / 3.5 / 1.3 + 3),
        (0, 0, 10, 0.0),
        (0, 5, 0, 0.0),
        (5897, 3117165 - 5897, 5897, 0.004716),
    ],
)
def test_score_anchors(spark, tp, fp, target, expected):
    counts = spark.createDataFrame([(tp, fp, target, 3117165)], "tp long, fp long, target long, total long")
    row = measures.with_measures(counts).first()
    assert row.score == pytest.approx(expected, abs=1e-6)
    assert row.tp + row.fp + row.fn + row.tn == row.total


def test_negative_counts_are_kept(spark):
    row = measures.with_measures(
        spark.createDataFrame([(4, 0, 2, 10)], "tp long, fp long, target long, total long")
    ).first()
    assert (row.fn, row.recall) == (-2, 2.0)


FENCES = {
    "```sql\nx\n```": "x",
    "```SQLx```": "x",
    "\t```Sql\n\n x \n```\n": "x",
    "``` y": "y",
    "a\n```sql\nb\n```": "a\n```sql\nb\n```",
    "```": "",
    "``````": "",
    " \n```\n\n```\t": "",
    "```x``` tail": "x``` tail",
    "```sql\nselect 1\n```\n```": "select 1\n```",
    "": "",
    " x ": "x",
}


def test_fences(spark):
    rows = spark.createDataFrame([(t,) for t in FENCES], "t string").select(
        "t", strip_fence(F.col("t")).alias("s")
    )
    assert {r.t: r.s for r in rows.collect()} == FENCES


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab SQL\n\t\x1c\xa0\u3000x\u00e9", max_size=14), min_size=1, max_size=30))
def test_strip_like_python_and_fences_come_off(spark, texts):
    text = F.col("t")
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t",
        py_strip(text).alias("bare"),
        strip_fence(text).alias("unfenced"),
        strip_fence(F.concat(F.lit(" ```sql\n"), text, F.lit("\n```\n"))).alias("fenced"),
    )
    for row in rows.collect():
        assert row.bare == row.unfenced == row.fenced == row.t.strip()


def test_counts(spark):
    given_texts = {
        "1,234": (1234, False), "1e3": (1000, False), "12.9": (12, False), "-3.7": (-3, False),
        " ": (None, False), "": (None, False), "about 3": (None, True), "5d": (None, True),
        "nan": (None, True), "1e40": (None, True), "+7": (7, False), ".5": (0, False),
        "\t8\n": (8, False), "12.": (12, False),
    }
    rows = spark.createDataFrame([(t,) for t in given_texts], "t string")
    got = {r.t: (r.n, r.bad) for r in rows.select(
        "t", parse_count(F.col("t")).alias("n"), is_bad_count(F.col("t")).alias("bad")).collect()}
    assert got == given_texts
    assert spark.range(1).select(parse_count(F.lit(None).cast("string")).alias("n")).first().n is None


def test_token_count(spark):
    row = spark.createDataFrame([("select a1, b\n from t;",)], "t string").select(token_count(F.col("t")).alias("n"))
    assert row.first().n == 7


LEAKS = [
    ("select * from t where BAND = 'high'", -5.0),
    ("select *, 'high' as x from t", -2.0),
    ("selec 'band high'", -5.0),
    ("select * from t where band <> 'LOW'", None),
    ("select 1", None),
]


@pytest.mark.parametrize("sql, penalty", LEAKS)
def test_leaks_in_any_case(spark, sql, penalty):
    for text in (sql, sql.upper(), sql.lower()):
        row = spark.createDataFrame([(text,)], "s string").select(
            leak.leak_penalty(F.col("s"), F.lit("band"), F.lit("HIGH")).alias("p")
        )
        assert row.first().p == penalty


def chats(spark, rows):
    return spark.createDataFrame(rows, "id long, m array<struct<role:string,content:string>>")


def test_render_template(spark):
    rows = [
        (1, [("user", "u"), ("assistant", "a")]),
        (2, [("system", "s"), ("user", "u"), ("system", "later"), ("tool", "x"), ("assistant", "a")]),
        (3, [("tool", "x"), ("user", "u")]),
    ]
    got = {r.id: r.t for r in chats(spark, rows).select("id", chat.render(F.col("m"), "|", "D").alias("t")).collect()}
    assert got == {1: "D|u|a|", 2: "s|u|a|", 3: "D|u|"}


def test_text_to_sql_chat(spark):
    rows = spark.createDataFrame(
        [(" p ", "\n q ;\n", None), ("p", "q", ""), ("p", "q", "t(a)")], "p string, q string, s string"
    )
    got = [
        [(m.role, m.content) for m in r.m]
        for r in rows.select(chat.text_to_sql_chat(F.col("p"), F.col("q"), F.col("s")).alias("m")).collect()
    ]
    opening = "Write a DuckDB SQL query that solves the request\n"
    assert got[0][1] == ("user", opening + "\nRequest:\n p ")
    assert got[0][2] == ("assistant", "q ;")
    assert got[1][1] == ("user", opening + "\nRequest:\np")
    assert got[2][1] == ("user", opening + "SQL Context:\nt(a)\n\nRequest:\np")
    assert [role for role, _ in got[2]] == ["system", "user", "assistant"]
