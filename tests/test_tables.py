import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from querygavel.functions import chat
from querygavel.operators.asof import asof_join
from querygavel.operators.census import class_mix, label_census, threshold_sweep
from querygavel.operators.chats import chat_lengths, render_chats
from querygavel.operators.curves import curve_summary, moving_mean
from querygavel.operators.firsts import first_rows
from querygavel.operators.lengths import cut_long, eval_sample, length_limit, within_budget
from querygavel.operators.quantile import at_least_quantile, exact_quantile, values_at_ranks
from querygavel.operators.ranges import numbered
from querygavel.operators.sampling import hash_share, stratified_sample, uniform_sample, weighted_sample
from querygavel.operators.search import B, K1, bm25_search
from querygavel.sources.reward_log import numbered_lines
from querygavel.operators.summary import group_advantage, score_change, score_summary


@pytest.mark.parametrize("ranges", [None, 1, 30])
@pytest.mark.parametrize("kind", ["spread", "copies", "heavy"])
def test_quantile_like_numpy(spark, kind, ranges):
    draw = np.random.default_rng(1)
    values = {
        "spread": draw.normal(size=1200).round(3),
        "copies": np.where(draw.random(1200) < 0.4, 7.0, draw.integers(0, 40, 1200)),
        "heavy": np.exp(draw.normal(scale=8, size=1200)),
    }[kind]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(5)
    for q in (0.0, 0.5, 0.9, 0.99, 1.0):
        assert exact_quantile(df, F.col("v"), q, ranges) == pytest.approx(np.quantile(values, q), rel=1e-12)


def test_ranks_and_filter(spark):
    df = spark.range(1000).withColumn("v", F.col("id") * 3)
    assert values_at_ranks(df.select("v"), lambda n: (0, n - 1), ranges=10) == [0, 2997]
    assert at_least_quantile(df, "v", 0.99).count() == 10
    assert at_least_quantile(df.where("id < 0"), "v", 0.99).count() == 0
    assert exact_quantile(df.where("id < 0"), F.col("v"), 0.5) is None


def test_class_mix(spark):
    # One class holds most rows, and its ids are far from evenly spread.
    rows = [(int(1.01**i * 10) + i, "hot") for i in range(900)] + [(10**7 + i, "a") for i in range(5)]
    rows += [(10**8 + i, "b") for i in range(20)]
    df = spark.createDataFrame(rows, "id long, kind string").repartition(4)
    caps = {"hot": 123, "a": 10, "b": 0, "missing": 3}
    got = sorted(r.id for r in class_mix(df, "kind", "id", caps).collect())
    want = sorted(i for i, k in rows if k == "hot")[:123] + [i for i, k in rows if k == "a"]
    assert got == sorted(want)
    plain = df.withColumn("id", F.col("id") % 7)
    assert class_mix(plain.distinct(), "kind", "id", {"hot": 99}, distinct=True).count() == 7


def test_class_mix_never_exceeds_a_cap(spark):
    rows = [(None if i % 5 == 0 else i % 3, f"c{i % 200}", i) for i in range(3000)]
    df = spark.createDataFrame(rows, "o int, kind string, id int").repartition(6)
    got = class_mix(df, "kind", "o", {f"c{k}": k % 4 for k in range(200)}).collect()
    by = Counter(r.kind for r in got)
    assert all(by[f"c{k}"] == k % 4 for k in range(200))
    assert sum(r.o is None for r in class_mix(df, "kind", "o", {"c1": 99, "c0": 99}).collect()) == 15
    assert class_mix(df, "kind", "o", {"c0": 0}).count() == 0


def test_two_ended_column(spark):
    values = [0.0] * 500 + [1000.0] * 500 + [float(i) for i in range(300, 500)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(4)
    for q in (0.2, 0.45, 0.5, 0.6):
        assert exact_quantile(df, F.col("v"), q, 9) == pytest.approx(np.quantile(values, q))


def test_moving_mean_over_gaps(spark):
    lines = [i for i in range(1, 100) if not 25 <= i <= 40]
    rows = [("r", i, float(i)) for i in lines]
    df = spark.createDataFrame(rows, "run string, line_no bigint, reward double").repartition(3)
    got = {r.line_no: r.moving_reward for r in moving_mean(df, lines=20, ranges=7).collect()}
    assert got == {n: pytest.approx(np.mean(lines[max(0, i - 19) : i + 1])) for i, n in enumerate(lines)}


def test_asof_without_zone_and_with_a_stray_time(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        times = ["1970-01-01 00:00:00", "2024-03-10 00:00:00", "2024-03-10 02:30:00"]
        times += [f"2024-03-11 00:{i // 60:02d}:{i % 60:02d}.5" for i in range(600)]
        right = spark.createDataFrame([(1, t, i) for i, t in enumerate(times)], "k int, t string, p int")
        left = spark.createDataFrame([(1, "2024-03-10 03:15:00"), (1, "2024-03-11 00:05:00.25"), (1, "1969-01-01 00:00:00")], "k int, t string")
        cast = lambda df: df.withColumn("t", F.col("t").cast("timestamp_ntz"))
        for buckets in (7, 1000):
            got = {str(r.t): r.p for r in asof_join(cast(left), cast(right), "k", "t", ["p"], buckets).collect()}
            assert got == {"2024-03-10 03:15:00": 2, "2024-03-11 00:05:00.250000": 302, "1969-01-01 00:00:00": None}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


@pytest.mark.parametrize("buckets", [None, 1, 60])
def test_asof_hands_rows_over_many_ranges(spark, buckets):
    draw = random.Random(8)
    # One key has nearly all rows, its few right rows lie far apart, one time is far off, and many rows share a time.
    left = [(i, "hot", draw.choice([500, draw.randrange(1000)]), None) for i in range(3000)]
    left += [(5000 + i, draw.choice(["a", "b", None]), draw.choice([None, draw.randrange(1000)]), 1) for i in range(60)] + [(9000, "hot", None, 0)]
    right = [("hot", 100, None, 5), ("hot", 100, 7, 1), ("hot", 640, 8, None), ("hot", 10**9, 9, 9), ("b", 300, 3, 3), ("c", 1, 1, 1), (None, 0, 2, 2)]
    ldf = spark.createDataFrame(left, "id long, k string, at long, row long").repartition(5)
    rdf = spark.createDataFrame(right, "k string, at long, p long, found long")
    got = asof_join(ldf, rdf, "k", "at", ["p", "found"], buckets)
    assert got.columns == ["id", "k", "at", "row", "p", "found"]
    want = []
    for row in left:
        fit = [r for r in right if None not in (r[0], row[1], row[2]) and r[0] == row[1] and r[1] <= row[2]]
        best = max(fit, key=lambda r: (r[1], *((x is not None, x or 0) for x in r[2:])), default=(None,) * 4)
        want.append((*row, *best[2:]))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_asof_of_nothing(spark):
    none = spark.createDataFrame([], "k double, at long, p long")
    some = spark.createDataFrame([(float("nan"), 1, 5), (float("nan"), 0, 6), (0.0, 2, 7)], "k double, at long, p long")
    assert asof_join(none, some, "k", "at", ["p"]).count() == 0
    empty = asof_join(some.drop("p"), none, "k", "at", ["p"]).collect()
    assert len(empty) == 3 and all(r.p is None for r in empty)
    assert sorted(r.p for r in asof_join(some.drop("p"), some, "k", "at", ["p"]).collect()) == [5, 6, 7]


def test_sweep_edges(spark):
    values = [1.0, 2.0, 2.0, -0.0, 0.0, float("nan"), None, float("inf"), -5.0]
    rows = [(v, "x" if i % 2 else "y") for i, v in enumerate(values)] + [(3.0, None)]
    df = spark.createDataFrame(rows, "v double, kind string")
    ks = [0.0, 2.0, 1e9, -0.0]
    for some in (ks, [2.0]):
        got = {r.k: (r.tp, r.fp, r.fn, r.tn) for r in threshold_sweep(df, "v", "kind", "x", some).collect()}
        df.createOrReplaceTempView("sweep_rows")
        for k in set(some):
            tp, fp = spark.sql(
                f"select count_if(kind <=> 'x'), count_if(not kind <=> 'x') from sweep_rows where v >= double('{k}')"
            ).first()
            target = sum(k == "x" for _, k in rows)
            assert got[k] == (tp, fp, target - tp, len(rows) - tp - fp - (target - tp))


def test_sweep_scans_once(spark, orders):
    from querygavel.registry.common import table
    from tests.conftest import SMALL

    raw = table(spark, SMALL, "orders").withColumn("band", F.expr("o_orderstatus"))
    plan = threshold_sweep(raw, "o_totalprice", "band", "F", range(1000))._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("FileScan") == 1


def test_census_case(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "Label string")
    assert {r.label: r.n for r in label_census(df, "label").collect()} == {"a": 2, None: 1}


def test_asof_like_brute_force(spark):
    draw = random.Random(3)

    def row(i):
        # Half of all rows share one key, and many share a time.
        key = draw.choice([1, 1, 1, 2, 3, None])
        at = draw.choice([1000, draw.randrange(2000), None] if i % 9 == 0 else [1000, draw.randrange(2000)])
        return (i, key, at)

    left, right = [row(i) for i in range(150)], [row(i) for i in range(150)]
    schema = "id long, k long, s long"
    to_time = F.timestamp_seconds("s").cast("timestamp_ntz")
    ldf = spark.createDataFrame(left, schema).select("id", "k", to_time.alias("ts")).repartition(4)
    rdf = spark.createDataFrame(right, schema).select("k", to_time.alias("ts"), F.col("id").alias("rid"))
    want = {}
    for i, k, s in left:
        fits = [(rs, ri) for ri, rk, rs in right if None not in (k, s, rk, rs) and rk == k and rs <= s]
        want[i] = max(fits)[1] if fits else None
    for buckets in (1, 3, 1000):
        got = asof_join(ldf, rdf, "k", "ts", ["rid"], buckets=buckets)
        assert got.columns == ["id", "k", "ts", "rid"]
        rows = got.collect()
        assert len(rows) == len(left) and {r.id: r.rid for r in rows} == want
    assert asof_join(ldf, rdf.where("rid < 0"), "k", "ts", ["rid"]).where("rid is null").count() == len(left)


def test_bm25_skips_blocks(spark, monkeypatch):
    from querygavel.operators import search

    draw = random.Random(6)
    topics = [[f"t{n}w{i}" for i in range(6)] for n in range(20)]
    rows = [(i, " ".join(draw.choices(topics[i // 32] + ["the"], k=12 + i % 7))) for i in range(640)] + [(1000, None), (1001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    asked = spark.createDataFrame([(0, "the t3w1 t3w2"), (1, "t7w0 the"), (2, "nothing")], "query_id long, text string")
    whole = {tuple(r) for r in bm25_search(docs, asked, 5).collect()}
    monkeypatch.setattr(search, "_blocks", small_blocks)
    for only in (None, asked.select(F.explode(search.words(F.col("text"))).alias("term"))):
        index = search.build_index(docs, only=only)
        assert index.rows.where("term = ''").count() == 21
        found = search.search_index(index, asked, 5, "query_id", "text", 6)
        assert {tuple(r) for r in found.hits.select("query", "id", "score", "place").collect()} == whole and len(whole) == 10
        flags = {(r["query"], r.scored): r["count"] for r in found.bounds.groupBy("query", "scored").count().collect()}
        # "the" is everywhere, so every block has a bound; only those of the topic are opened.
        assert flags[0, False] >= 15 and flags[1, False] >= 15 and flags[0, True] <= 5


def small_blocks(batches, kept):
    from querygavel.operators import search as own

    for number, batch in enumerate(b.slice(i, 32) for b in batches for i in range(0, b.num_rows, 32)):
        yield own._block(number, batch, kept)


def test_bm25_like_brute_force(spark):
    draw = random.Random(5)
    vocabulary = ["alpha", "beta", "gamma", "Été", "x1", "zeta"]
    docs = {i: " ".join(draw.choices(vocabulary, k=draw.randrange(1, 30))) for i in range(60)}
    docs[60] = ""
    asked = {0: "alpha ALPHA, zeta", 1: "été?", 2: "unknown", 3: "beta x1"}
    got = bm25_search(
        spark.createDataFrame(list(docs.items()), "doc_id long, text string"),
        spark.createDataFrame(list(asked.items()), "query_id long, text string"),
        k=7,
    ).collect()
    split = {i: t.lower().split() for i, t in docs.items()}
    mean = sum(map(len, split.values())) / len(split)
    terms = {0: ["alpha", "zeta"], 1: ["été"], 2: [], 3: ["beta", "x1"]}
    for q, wanted in terms.items():
        scores = {}
        for i, words in split.items():
            for term in wanted:
                tf, df = words.count(term), sum(term in w for w in split.values())
                if tf:
                    idf = math.log(1 + (len(split) - df + 0.5) / (df + 0.5))
                    scores[i] = scores.get(i, 0) + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean))
        best = sorted(((-round(s, 6), i) for i, s in scores.items()))[:7]
        mine = sorted((r.place, r.doc_id, r.score) for r in got if r.query_id == q)
        assert [d for _, d, _ in mine] == [i for _, i in best]
        assert [s for *_, s in mine] == pytest.approx([-s for s, _ in best], abs=1e-6)


def chat_rows(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)


def test_chats(spark):
    rows = [
        (1, 5, "user", "a b"), (1, 7, "assistant", "c"),
        (2, 0, "system", "sys"), (2, 1, "user", "u"), (2, 2, "system", "late"), (2, 3, "tool", "x"),
        (3, 0, "tool", "x"), (3, 1, "user", "u"), (4, 2, "tool", "only"),
    ]
    # A long chat with a system turn that leads a later segment.
    rows += [(5, i, "system" if i == 128 else "user", f"t{i}") for i in range(3, 300)]
    df = chat_rows(spark, rows)
    got = {r.conv_id: r.text for r in render_chats(df, "|", "D d").collect()}
    assert got[1] == "D d|a b|c|" and got[2] == "sys|u|" and got[3] == "D d|u|" and got[4] == "D d|"
    assert got[5] == "D d|" + "".join(f"t{i}|" for i in range(3, 300) if i != 128)
    lengths = {r.conv_id: r.n_tokens for r in chat_lengths(df, "D d").collect()}
    assert lengths == {1: 8, 2: 2 + 2, 3: 3 + 2, 4: 3, 5: 3 + 2 * 296}
    short = {r.conv_id for r in render_chats(df, "|", "D d", max_tokens=5).collect()}
    assert short == {2, 3, 4}
    # The array form of a chat renders the same.
    arrays = df.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    arrays = arrays.select("conv_id", F.expr("transform(t, x -> struct(x.role as role, x.text as content))").alias("m"))
    same = arrays.select(
        "conv_id", chat.render(F.col("m"), "|", "D d").alias("text"), chat.rendered_tokens(F.col("m"), "D d").alias("n")
    )
    rows = same.collect()
    assert {r.conv_id: r.text for r in rows} == got and {r.conv_id: r.n for r in rows} == lengths


def test_budget_and_cut(spark):
    df = spark.createDataFrame([(3, 10), (1, 20), (2, 30)], "o long, n long")
    assert [r.o for r in within_budget(df, "n", "o", 20).orderBy("o").collect()] == [1, 3]
    assert [r.o for r in within_budget(df, "n", "o", 5).collect()] == [1]
    assert within_budget(df.where("o > 9"), "n", "o", 5).count() == 0
    lengths = [int(x) for x in np.random.default_rng(2).integers(1, 90, 500)]
    many = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "o long, n long")
    limit = int(np.quantile(lengths, 0.9))
    assert length_limit(many, "n").first().length_limit == limit
    assert cut_long(many, "n").count() == sum(n <= limit for n in lengths)
    assert length_limit(many.where("o < 0"), "n").first().length_limit == 128


def test_eval_samples(spark):
    df = spark.range(1000).withColumnRenamed("id", "o").repartition(7)
    training, sample = eval_sample(df, "o")
    assert training.count() == 1000 and [r.o for r in sample.orderBy("o").collect()] == list(range(32))
    training, sample = eval_sample(df, "o", mode="hash")
    assert training.intersect(sample).count() == 0 and training.count() + sample.count() == 1000


def test_moving_mean_in_ranges(spark):
    draw = np.random.default_rng(4)
    curve = pd.DataFrame({"run": ["long"] * 250 + ["short"] * 5, "line_no": [*range(1, 251), *range(1, 6)]})
    curve["reward"] = draw.normal(size=len(curve))
    want = curve.groupby("run").reward.transform(lambda s: s.rolling(20, min_periods=1).mean())
    for ranges in (None, 3, 40, 200):
        got = moving_mean(spark.createDataFrame(curve), ranges=ranges).orderBy("run", "line_no").toPandas()
        assert len(got) == len(curve)
        np.testing.assert_allclose(got.moving_reward, want)
    row = curve_summary(spark.createDataFrame([("r", 1, -1.0), ("r", 2, 0.5), ("r", 3, 0.5)], "run string, line_no long, reward double")).first()
    assert (row.n_lines, row.first_positive_line, row.best_line, row.best_reward) == (3, 2, 2, 0.5)


def test_summaries(spark):
    scores = spark.createDataFrame([(4.0,), (-20.0,), (None,)], "score double")
    assert score_summary(scores).first() == (3, -16.0 / 3)
    assert score_summary(scores.where("false")).count() == 0
    rows = [("initial", "a", -2.0), ("final", "a", 1.0), ("initial", "b", 0.0), ("final", "b", 3.0),
            ("initial", "c", 0.0), ("final", "c", 0.0), ("final", "d", 1.0)]
    got = {r.positive_value: r.percent_change for r in score_change(
        spark.createDataFrame(rows, "phase string, positive_value string, score double")).collect()}
    assert got == {"a": 150.0, "b": math.inf, "c": 0.0, "d": None, None: pytest.approx((1.25 + 2 / 3) / (2 / 3) * 100)}


def test_group_advantage(spark):
    rows = [("p", 1.0), ("p", 3.0), ("q", 5.0), (None, 2.0), (None, 4.0)]
    got = group_advantage(spark.createDataFrame(rows, "prompt_id string, score double"), eps=0.0)
    by = {(r.prompt_id, r.score): r.advantage for r in got.where("prompt_id is null or prompt_id = 'p'").collect()}
    assert by[("p", 3.0)] == pytest.approx(1 / math.sqrt(2)) and by[(None, 2.0)] == pytest.approx(-1 / math.sqrt(2))


@pytest.mark.parametrize("kind", ["long", "double", "date", "timestamp", "timestamp_ntz", "string", "decimal(9,2)"])
def test_first_rows_of_any_type(spark, kind):
    base = spark.range(400).select(
        "id", F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("c"), (F.col("id") * 7919 % 400).alias("v")
    )
    v = F.when(F.col("v") % 50 != 0, F.col("v"))
    day = F.date_add(F.lit("1960-01-01"), v.cast("int"))
    order = {"date": day, "string": F.lpad(v.cast("string"), 4, "0")}.get(kind, day if "time" in kind else v).cast(kind)
    df = base.withColumn("o", order).repartition(5).cache()
    caps = spark.createDataFrame([("a", 60), (None, 7), ("b", 10_000), ("no", 3)], "c string, cap int")
    got = first_rows(df, "c", "o", [F.col("id")], caps).select("c", "o", "id").collect()
    rows = df.select("c", "o", "id").collect()
    want = []
    for c, cap in (("a", 60), (None, 7), ("b", 10_000)):
        of = [r for r in rows if r.c == c]
        want += sorted(of, key=lambda r: (r.o is None, r.o if r.o is not None else 0, r.id))[:cap]
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)


def test_caps_rank_only_the_rim(spark, monkeypatch):
    from querygavel.operators import firsts

    ranked = []
    real = firsts.numbered
    monkeypatch.setattr(firsts, "numbered", lambda rim, *a: ranked.append(rim) or real(rim, *a))
    df = spark.range(0, 1_200_000, numPartitions=64).select(
        F.when(F.col("id") % 12 == 0, "small").otherwise("hot").alias("kind"), (F.col("id") * 7919 % 1_200_007).alias("o")
    )
    got = class_mix(df, "kind", "o", {"hot": 100_000, "small": 10})
    counts = got.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.max("o").alias("last"), F.count_distinct("o").alias("d"))
    assert {r.kind: (r.n, r.d) for r in counts.collect()} == {"hot": (100_000, 100_000), "small": (10, 10)}
    last = counts.where("kind = 'hot'").first().last
    assert df.where(f"kind = 'hot' and o <= {last}").count() == 100_000
    # The rim is at most 2 * (SLACK + 1 / STEPS) of the rows, and another round makes it far smaller.
    assert ranked[0].count() < 0.06 * 1_200_000
    monkeypatch.setattr(firsts, "RIM_ROWS", 0)
    again = firsts.first_rows(df, "kind", "o", [], spark.createDataFrame([("hot", 100_000), ("small", 10)], "kind string, cap int"), rim_rows=100)
    assert again.groupBy("kind").count().where("kind = 'hot'").first()["count"] == 100_000
    assert ranked[1].count() < 5000


def test_first_rows_with_one_value_and_nan(spark):
    values = [5.0] * 300 + [float("nan")] * 20 + [None] * 20 + [1.0] * 10
    df = spark.createDataFrame([("c", v, i) for i, v in enumerate(values)], "k string, v double, i int").repartition(6)
    for cap, sevens in ((10, 0), (50, 40), (310, 300)):
        got = first_rows(df, "k", "v", [F.col("i")], spark.createDataFrame([("c", cap)], "k string, cap int"), ranges=9)
        assert [(r.v, r.n) for r in got.groupBy("v").agg(F.count(F.lit(1)).alias("n")).orderBy("v").collect()] == [
            x for x in [(1.0, 10), (5.0, sevens)] if x[1]
        ]
    got = first_rows(df, "k", "v", [F.col("i")], spark.createDataFrame([("c", 335)], "k string, cap int"))
    assert got.where("isnan(v)").count() == 20 and got.where("v is null").count() == 5


@pytest.mark.parametrize("ranges", [None, 1, 50])
def test_numbers_over_ranges(spark, ranges):
    rows = [("hot", i % 40, i) for i in range(500)] + [(None, i, i) for i in range(9)] + [(f"k{i}", None, i) for i in range(30)]
    df = spark.createDataFrame(rows, "k string, o int, place0 int").repartition(6)
    got = numbered(df, "k", [F.col("o"), F.col("place0")], "n", ranges)
    assert got.columns == ["k", "o", "place0", "n"]
    want = []
    for key in {r[0] for r in rows}:
        run = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is None, r[1] or 0, r[2]))
        want += [(*r, n + 1) for n, r in enumerate(run)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert numbered(df.where("false"), "k", [F.col("o")], "n", ranges).count() == 0


def test_moving_means_skip_nulls(spark):
    draw = random.Random(4)
    values = [draw.choice([None, draw.random()]) for _ in range(200)]
    df = spark.createDataFrame([("r", i, v) for i, v in enumerate(values)], "run string, line_no int, reward double").repartition(4)
    got = {r.line_no: r.moving_reward for r in moving_mean(df, lines=5, ranges=70).collect()}
    for i in range(200):
        seen = [v for v in values[max(0, i - 4) : i + 1] if v is not None]
        assert got[i] == (pytest.approx(sum(seen) / len(seen)) if seen else None)


def test_samples(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 10 == 0, "rare").when(F.col("id") % 10 < 8, "hot").alias("c"),
                                  F.when(F.col("id") % 5 != 0, F.col("id") % 100 + 1.0).alias("w")).repartition(7)
    share = {r.id: r.s for r in df.select("id", hash_share(F.col("id"), 3).alias("s")).collect()}
    least = lambda ids, n: sorted(ids, key=share.get)[:n]
    assert sorted(r.id for r in uniform_sample(df, "id", 100, 3).collect()) == sorted(least(share, 100))
    classes = {"rare": lambda i: i % 10 == 0, "hot": lambda i: 0 < i % 10 < 8, None: lambda i: i % 10 >= 8}
    want = [i for own in classes.values() for i in least(filter(own, range(5000)), 150)]
    got = stratified_sample(df, "c", "id", 150, 3)
    assert got.columns == ["id", "c", "w"] and sorted(r.id for r in got.collect()) == sorted(want)
    some = stratified_sample(df, "c", "id", {"rare": 9999, "hot": 5, "no": 4}, 3)
    assert {r.c: r["count"] for r in some.groupBy("c").count().collect()} == {"rare": 500, "hot": 5}
    waits = {i: -math.log(share[i]) / (i % 100 + 1.0) for i in range(5000) if i % 5}
    drawn = {r.id for r in weighted_sample(df, "id", "w", 400, 3).collect()}
    assert drawn == set(sorted(waits, key=waits.get)[:400])
    # Heavy rows are drawn more often than light ones.
    assert sum(i % 100 >= 50 for i in drawn) > 260
    assert uniform_sample(df.where("false"), "id", 5).count() == 0 and weighted_sample(df, "id", "w", 0).count() == 0


def test_quantile_scans_twice(spark, monkeypatch):
    from querygavel.operators import quantile

    brackets = []
    real = quantile._in_bracket
    monkeypatch.setattr(quantile, "_in_bracket", lambda values, wanted, low, high, ranges: brackets.append(
        values.where(F.col("v").between(F.lit(low or -math.inf), F.lit(math.inf if high is None else high))).count()
    ) or real(values, wanted, low, high, ranges))
    n = 300_000
    columns = {
        "spread": F.col("id").cast("double"), "two_ended": F.when(F.col("id") % 2 == 0, 0.0).otherwise(1000.0),
        "constant": F.lit(7.0), "skewed": F.exp(F.col("id") / 1000),
    }
    for name, column in columns.items():
        df = spark.range(n).select(column.alias("v")).repartition(8)
        values = np.sort(df.toPandas().v.to_numpy())
        for q in (0.0, 0.3, 0.99):
            del brackets[:]
            assert exact_quantile(df, F.col("v"), q) == pytest.approx(np.quantile(values, q), rel=1e-12)
            # One scan for the sketch, at most one more, which keeps few values unless they are equal.
            assert len(brackets) == (name != "constant")
            assert name in ("two_ended", "constant") or brackets[0] < 0.03 * n
    # A bracket that misses is noticed.
    values = spark.range(100).select(F.col("id").cast("double").alias("v"))
    assert quantile._in_bracket(values, [50], 60.0, 90.0, None) is None and quantile._in_bracket(values, [50], 10.0, 40.0, None) is None
    nan = spark.createDataFrame([(float("nan"),), (1.0,), (None,), (float("-inf"),)], "v double")
    assert values_at_ranks(nan, lambda n: (0, 1)) == [-math.inf, 1.0] and math.isnan(values_at_ranks(nan, lambda n: (2,))[0])


def test_budget_reads_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = spark.range(500).select(F.col("id").alias("o"), (F.col("id") % 90 + 10).alias("n")).repartition(5)
    df = df.mapInArrow(counted, df.schema)
    assert within_budget(df, "n", "o", 20).count() == sum(i % 90 + 10 <= 20 for i in range(500)) and read.value == 500
    # Without a fitting row, the first one is looked for once more.
    assert [r.o for r in within_budget(df, "n", "o", 5).collect()] == [0]


def test_log_in_folders(spark, tmp_path):
    for run, parts in (("a", [["1, 1", "2, 2"], ["3, 3"]]), ("b", [["9, 9"]])):
        (tmp_path / f"run={run}").mkdir()
        for i, lines in enumerate(parts):
            (tmp_path / f"run={run}" / f"part-{i}.txt").write_text("\n".join(lines) + "\n")
    got = numbered_lines(spark, str(tmp_path), whole_folders=True).collect()
    assert sorted((r.file[-1], r.line_no, r.value) for r in got) == [("a", 1, "1, 1"), ("a", 2, "2, 2"), ("a", 3, "3, 3"), ("b", 1, "9, 9")]


def test_bm25_postings_travel_once_a_page(spark, monkeypatch):
    from querygavel.operators import search

    draw = random.Random(9)
    vocabulary = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join(draw.choices(vocabulary, k=25))) for i in range(300)], "doc_id long, text string")
    asked = spark.createDataFrame([(i, " ".join(draw.choices(vocabulary, k=12))) for i in range(60)], "query_id long, text string")
    one = {tuple(r) for r in bm25_search(docs, asked, 7).collect()}
    sizes = []
    whole = type(docs).groupBy

    def counted(self, *by):
        if len(by) == 2 and "docs" in self.columns:
            sizes.append(self.select(F.sum(F.size("docs"))).collect()[0][0])
        return whole(self, *by)

    monkeypatch.setattr(type(docs), "groupBy", counted)
    assert {tuple(r) for r in bm25_search(docs, asked, 7).collect()} == one and len(one) == 420
    # No more than the index itself in each of the two rounds, though sixty queries ask for it.
    assert len(sizes) == 2 and max(sizes) <= 300 * 25
    monkeypatch.setattr(search, "PAGE_QUERIES", 7)
    monkeypatch.setattr(search, "PART_BITS", 0)
    assert {tuple(r) for r in bm25_search(docs, asked, 7).collect()} == one


def test_bm25_terms_in_slices(monkeypatch):
    import pyarrow as pa

    from querygavel.operators import search

    postings = pa.table({"block": [1, 1, 2], "term": ["a", "b", "a"], "docs": [[5, 6], [6], [9]], "tfs": [[1, 2], [1], [3]], "lengths": [[4, 5], [5], [6]]})
    needed = pa.table(
        {"query": [0, 0, 1, 0, 1, 0], "term": ["a", "b", "b", None, None, None], "idf": [1.0, 2.0, 2.0, None, None, None],
         "mean_length": [5.0] * 3 + [None] * 3, "block": pa.array([None, None, None, 1, 1, 2], pa.int64())}
    )
    whole = search._totals(postings, needed, 10, 6)
    monkeypatch.setattr(search, "MATRIX_TERMS", 1)
    assert search._totals(postings, needed, 10, 6).equals(whole)
    assert list(zip(whole["query"].to_pylist(), whole["id"].to_pylist(), strict=True)) == [(0, 5), (0, 6), (1, 6), (0, 9)]
