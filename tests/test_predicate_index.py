"""The index of predicates against Spark's own filters."""

import random

import pytest
from pyspark.sql import functions as F

from querygavel.operators import class_counts, predicate_index
from querygavel.operators.class_counts import Limits, count_classes, run_conditions, run_queries
from querygavel.plans.safety import TextGuard, candidate_settings



@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(3)
    maybe = lambda value: None if rng.random() < 0.15 else value
    odd = [float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 2.5, 3.0]
    rows = [
        (
            maybe(rng.randrange(-5, 30)),
            maybe(rng.choice([-(1 << 62), 7, 1 << 53, (1 << 53) + 1])),
            maybe(rng.choice([0.1, 2.5, float("nan")])),
            maybe(rng.choice(odd)),
            maybe(rng.choice(["", "a", "b", "ä", "\U0001f600", "Z", "it''s"])),
            maybe(rng.random() < 0.5),
            maybe(f"20{rng.randrange(10, 13)}-0{rng.randrange(1, 9)}-11"),
            maybe(f"2011-01-0{rng.randrange(1, 9)} 0{rng.randrange(9)}:00:00.5"),
            maybe(f"{rng.randrange(-3, 9)}.{rng.randrange(99):02}"),
            maybe(rng.choice(["x", "y", "z"])),
        )
        for _ in range(600)
    ]
    text = "id int, big bigint, f float, v double, s string, b boolean, d string, ts string, m string, label string"
    df = spark.createDataFrame(rows, text).repartition(3)
    return df.withColumns({"d": F.col("d").cast("date"), "ts": F.col("ts").cast("timestamp"), "n": F.col("ts").cast("timestamp_ntz"), "m": F.col("m").cast("decimal(9,2)")})


INDEXED = [
    "id > 3", "3 >= id", "id = 4", "id <> 4", "id != -5", "not id < 10", "id between 3 and 9", "id not between 3 and 9",
    "id in (1, 5, null)", "id not in (1, 5)", "id not in (1, null)", "id is null", "id is not null and v > 0", "id <=> null",
    "id <=> 4", "id > 2.5", "id >= 2.5", "id > 9999999999", "big > 9007199254740992", "big = 9007199254740993", "v > 2.5",
    "v = double('nan')", "v > double('infinity')", "v <= -0.0", "v = 0", "f > 2", "f = float(0.1)", "f > 0.1D", "s = 'a'", "s > 'Z'",
    "s <= 'ä'", "s in ('a', '')", "b", "not b", "b = false", "b or id > 5", "d > '2011-02-01'", "d = date'2010-03-11'",
    "d between '2010-05-01' and '2011-05-01'", "ts < '2011-01-03'", "ts >= timestamp'2011-01-02 05:00:00.5'", "m > 3", "m = 2.5", "n > '2011-01-03'", "n <> date'2011-01-03'",
    "m in (1.25, 3)", "id > 3 and s = 'a' or v is null", "not (id > 3 and (s = 'a' or v < 3))", "true", "false", "id > 3 and null",
    "id > null", "(id > 1) and ((id < 20))", "id > 1 + 2 * 3", "d > date_add(date'2010-01-01', 500)", "id > 3 and id > 5 and v > 1 and m < 3",
]
OTHERS = ["s like 'a%'", "id + 1 > 3", "id > big", "length(s) = 1", "upper(s) = 'A'", "cast(s as int) > 3"]
WRONG = ["nothing > 3", "id >", "id > 3) or (id < 2", "s + 1", "id > 3 as x", "id > 3 -- c", "(select 1) = id", "id > 1; drop"]


def by_filter(df, condition):
    counted = count_classes(df.where(F.expr(condition)), "label", "k")
    return sorted([(r["class"], r.is_text, r.n) for r in counted.collect()], key=repr)


def table_of(spark, texts, label="label"):
    rows = [(f"k{i}", text, label) for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, "query_key string, text string, label_col string")


def by_key(counts):
    got = {}
    for r in counts.collect():
        got.setdefault(r.query_key, {}).setdefault((r["class"], r.is_text), 0)
        got[r.query_key][r["class"], r.is_text] += r.n
    return {k: sorted([(c, t, n) for (c, t), n in v.items()], key=repr) for k, v in got.items()}


def trees(df, texts):
    zone = df.sparkSession.conf.get("spark.sql.session.timeZone")
    with candidate_settings(df.sparkSession):
        found = list(zip(texts, predicate_index.analysed(df, texts), strict=True))
        return [read(text, nodes, zone) for text, nodes in found]


def read(text, nodes, zone):
    try:
        return predicate_index.condition_tree(nodes, zone)
    except predicate_index.NotIndexable:
        pytest.fail(f"{text}: {nodes}")


def test_indexed_conditions_equal_filters(spark, mixed):
    parts, refused = predicate_index.chunks(list(zip(INDEXED, trees(mixed, INDEXED), strict=True)))
    assert not refused and len(parts) > 10
    got = by_key(predicate_index.count_indexed(mixed, parts, "label"))
    with candidate_settings(spark):
        for text in INDEXED:
            assert got.get(text, []) == by_filter(mixed, text), text


def test_others_are_not_indexed(spark, mixed):
    with candidate_settings(spark):
        for text in OTHERS:
            with pytest.raises(predicate_index.NotIndexable):
                predicate_index.condition_tree(predicate_index.analysed(mixed, [text])[0], "UTC")
        assert predicate_index.analysed(mixed, ["id > 1", "nothing > 1", "id <"])[1:] == [None, None]


def test_all_ways_together(spark, mixed):
    texts = [*INDEXED, *OTHERS[:-1], *WRONG]
    counts, failures = run_conditions(table_of(spark, texts), mixed)
    got, failed = by_key(counts), {r.query_key: r.status for r in failures.collect()}
    with candidate_settings(spark):
        for i, text in enumerate([*INDEXED, *OTHERS[:-1]]):
            assert got.get(f"k{i}", []) == by_filter(mixed, text), text
    statuses = [failed.get(f"k{i}") for i in range(len(texts) - len(WRONG), len(texts))]
    assert statuses[:5] == ["analysis_error", "parse_error", "parse_error", statuses[3], statuses[4]]
    assert statuses[3] in ("analysis_error", "runtime_error") and statuses[5:] == [None, None, "parse_error"]


@pytest.mark.parametrize("kind", ["id", "v", "b", "cast(id as decimal(5,1))", "d"])
def test_labels_of_other_types(spark, mixed, kind):
    df = mixed.drop("label").withColumn("label", F.expr(kind))
    counts, _ = run_conditions(table_of(spark, ["big is not null", "v < 3"]), df)
    got = by_key(counts)
    for i, text in enumerate(["big is not null", "v < 3"]):
        assert got[f"k{i}"] == by_filter(df, text)


@pytest.fixture
def scans(monkeypatch):
    """Jobs that wrote counts."""
    seen, own = [], class_counts._Runner._write_counts
    monkeypatch.setattr(class_counts._Runner, "_write_counts", lambda self, counts: (seen.append(1), own(self, counts))[1])
    return seen


@pytest.mark.parametrize("n", [100, 10_000])
def test_one_scan_for_any_number_of_conditions(spark, mixed, scans, n):
    texts = spark.range(n).selectExpr("concat('k', id) AS query_key", "concat('id * 1 > 0 or id > ', id) AS text", "'label' AS label_col")
    texts = texts.withColumn("text", F.expr("concat('v < ', substring(query_key, 2), '.5 and id > ', pmod(cast(substring(query_key, 2) as int), 9))"))
    counts, failures = run_conditions(texts, mixed)
    assert len(scans) == 1 and failures.count() == 0
    want = mixed.where("v < 5.5 and id > 5").count()
    assert counts.where("query_key = 'k5'").agg(F.sum("n")).first()[0] == want


def test_cells_of_many_columns_are_cut_into_chunks(spark, mixed, monkeypatch):
    monkeypatch.setattr(predicate_index, "CELLS", 60)
    texts = [f"id > {i} and v < {i % 4}" for i in range(12)] + ["id in (1,2,3,4,5,6,7) and v in (1,2,3,4,5,6) and m > 1"]
    parts, refused = predicate_index.chunks(list(zip(texts, trees(mixed, texts), strict=True)))
    assert len(parts) > 2 and refused == [texts[-1]]
    got = by_key(predicate_index.count_indexed(mixed, parts, "label"))
    for text in texts[:-1]:
        assert got.get(text, []) == by_filter(mixed, text)
    counts, failures = run_conditions(table_of(spark, texts), mixed)
    assert by_key(counts).get("k12", []) == by_filter(mixed, texts[-1]) and not failures.count()


FILTERS = [
    "select * from t where id > 3 and v < 3", "select label from t", "select * from (select * from t where v is not null) x where x.id < 9",
    "SELECT T.* FROM T WHERE T.d > '2011-01-01'",
]
NOT_FILTERS = [
    "select distinct label from t", "select * from t where id > 3 limit 5", "select label, count(*) from t group by label",
    "select upper(label) as label from t", "select * from (select id + 1 as id, label from t) where id > 3",
    "select * from t where id in (select id from t)", "select * from t union all select * from t", "select label as id, s as label from t",
    "select id, label from t order by id limit 3", "with a as (select * from t where b) select label, id from a where id is not null",
]


def test_texts_that_filter_share_a_scan(spark, mixed, scans):
    with candidate_settings(spark):
        expected = {}
        mixed.createOrReplaceTempView("t")
        for i, text in enumerate([*FILTERS, *NOT_FILTERS]):
            result = count_classes(spark.sql(text), "label", "k").collect()
            expected[f"k{i}"] = sorted([(r["class"], r.is_text, r.n) for r in result], key=repr)
        spark.catalog.dropTempView("t")
    counts, failures = run_queries(table_of(spark, FILTERS), {"t": mixed})
    assert len(scans) == 1 and not failures.count()
    assert by_key(counts) == {k: v for k, v in expected.items() if int(k[1:]) < len(FILTERS)}
    counts, failures = run_queries(table_of(spark, [*FILTERS, *NOT_FILTERS]), {"t": mixed}, Limits(queries_per_job=100, parallel_jobs=1))
    assert len(scans) == 3 and not failures.count()
    got = by_key(counts)
    some_row = {f"k{len(FILTERS) + i}" for i in (1, 8)}
    assert all(got.get(k, []) == v for k, v in expected.items() if k not in some_row)


def test_plain_conditions(spark):
    guard = TextGuard(spark, ())
    plain = ["id > 3", "s in ('a', 'b)')", "(a > 1) and (b < 2)", "x between 1 and 2"]
    not_plain = ["id > 3) or (id < 2", "a > 1 -- x", "a /* */ > 1", "`a` > 1", 'a > "b"', "a = 'x\\'", "(select 1) > 0", "a > 1;", "((a > 1)"]
    assert all(map(guard.is_plain, plain)) and not any(map(guard.is_plain, not_plain))


def test_nothing_to_count(spark, mixed):
    counts, failures = run_conditions(table_of(spark, []), mixed)
    assert counts.count() == failures.count() == 0
    counts, _ = run_conditions(table_of(spark, ["id > 3"]), mixed.where("false"))
    assert counts.count() == 0
