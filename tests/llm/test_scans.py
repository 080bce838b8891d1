import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from querygavel.llm import kd_topk, licenses, resharding, toxicity
from querygavel.llm.common import Scratch
from querygavel.llm.license_rules import rules
from tests.conftest import SMALL
from tests.llm.common import BASE, ROWS, empty, prose, save_documents, table

ALL = [f"op{n}_" for n in range(1, 14)]


def test_registered():
    names = list(queries())
    assert all(sum(n.startswith(p) for n in names) == 1 for p in ALL) and "pipeline" in names
    assert {"op2_kd_topk", "op5_grace_dedup"} <= set(oracle_sql())


# --- resharding ---


def test_flow_moves_the_fewest_bytes():
    rng = np.random.default_rng(0)
    for _ in range(40):
        n, m = int(rng.integers(1, 20)), int(rng.integers(1, 20))
        supply = rng.integers(0, 500, n).tolist()
        capacity = [sum(supply) // m + (j < sum(supply) % m) for j in range(m)]
        flow = resharding.min_cost_flow(supply, capacity, resharding.moving_cost(n, m))
        stays = sum(int(flow[i, i]) for i in range(min(n, m)))
        assert flow.sum(axis=1).tolist() == supply and (flow.sum(axis=0) <= capacity).all()
        assert stays == sum(min(supply[i], capacity[i]) for i in range(min(n, m)))


def test_flow_with_other_costs():
    cost = np.array([[1.0, 4.0], [2.0, 9.0]])
    assert resharding.min_cost_flow([5, 5], [5, 5], cost).tolist() == [[0, 5], [5, 0]]
    with pytest.raises(ValueError):
        resharding.min_cost_flow([5], [4], np.ones((1, 1)))


@pytest.mark.parametrize("old", ["0", "cast(pmod(doc_id, 3) as int)"])
def test_reshard(spark, monkeypatch, old):
    monkeypatch.setattr(resharding, "BLOCK_BYTES", (2000, 1 << 20))
    rows = ROWS + [(100 + i, prose(i, 20)) for i in range(300)] + [(500, prose(9, 20))] * 30
    docs = table(spark, rows).drop("shard", "size")
    kept = {"doc_id": F.col("doc_id"), "text": F.col("text")}
    placed, files = resharding.reshard(docs, F.expr(old), 3, 4, Scratch(spark), kept)
    got = placed.collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted([(r.doc_id, r.text) for r in got], key=key) == sorted(rows, key=key)
    for shard in range(4):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    size = [sum(r.size for r in got if r.shard == s) for s in range(4)]
    largest = max(len((t or "").encode()) for _, t in rows) + 16
    assert max(size) - min(size) <= 2 * largest
    moved = [r for r in got if r.moved]
    assert files.count() == len(moved) and set(files.columns) == {*docs.columns, "shard"}


def test_reshard_nothing(spark):
    docs = empty(spark).drop("shard", "size")
    placed, files = resharding.reshard(docs, F.lit(0), 2, 3, Scratch(spark), {"doc_id": F.col("doc_id")})
    assert placed.count() == files.count() == 0


def test_reshard_keeps_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(resharding, "BLOCK_BYTES", (2000, 1 << 20))
    docs = table(spark, ROWS + [(100 + i, prose(i, 20)) for i in range(60)])
    docs = docs.selectExpr("*", "concat('m', doc_id) AS moved", "'o' AS __own", "'n' AS __row", "'t' AS `a.b`", "doc_id AS slot")
    kept = {"doc_id": F.col("doc_id"), "shard": F.col("shard"), "moved": F.col("moved")}
    placed, files = resharding.reshard(docs, F.expr("pmod(doc_id, 3)"), 3, 4, Scratch(spark), kept)
    assert placed.columns == ["doc_id", "shard", "moved", "size", "_shard", "slot", "_moved"]
    assert files.columns == ["_shard", *docs.columns]
    got, rows = placed.collect(), docs.collect()
    assert sorted(map(repr, [(r.doc_id, r.shard, r.moved) for r in got])) == sorted(map(repr, [(r.doc_id, r.shard, r.moved) for r in rows]))
    assert {r["_shard"] for r in got} == {0, 1, 2, 3} and any(r["_moved"] for r in got)
    written = [tuple(r)[1:] for r in files.collect()]
    assert len(written) == sum(r["_moved"] for r in got) and set(written) <= {tuple(r) for r in rows}


# --- top k ---


def brute_top(vectors, k):
    out = []
    for q, a in vectors:
        if q % 50 == 0:
            scores = sorted(((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in vectors if i != q and len(a) == len(b)))
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows, leaf", [(4096, 32), (90, 4)])
def test_top_k(spark, monkeypatch, shard_rows, leaf):
    monkeypatch.setattr(kd_topk, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(kd_topk, "LEAF_ROWS", leaf)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=6), 1)]) for i in range(500)]
    rows += [(600 + i, [0.5] * 6) for i in range(200)] + [(2000, [1.0, 2.0]), (2050, [1.0, 0.0]), (3000, [1.0])]
    bad = [(1050, None), (1100, [1.0, None]), (1150, [float("nan")] * 6), (1200, [float("inf")] * 6), (None, [0.1] * 6)]
    df = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<double>").selectExpr("*", "1 AS shard", "'x' AS dim")
    vectors = kd_topk.integer_vectors(df, "vec_id", "embedding")
    got = kd_topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), Scratch(spark), 5).collect()
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_top(whole, 5)


def test_top_k_of_repeated_ids(spark):
    rows = [(i, [float(i % 7), 1.0]) for i in range(1, 30)]
    twice = [*rows, *rows[:5], (3, [99.0, 99.0]), (50, [1.0, 1.0]), (50, [1.0, 1.0])]
    vectors = kd_topk.integer_vectors(spark.createDataFrame(twice, "vec_id bigint, embedding array<double>"), "vec_id", "embedding")
    got = kd_topk.top_k(vectors, vectors.where("vec_id = 50"), Scratch(spark), 5).collect()
    whole = [(i, [int(256 * x) for x in v]) for i, v in [*rows, (50, [1.0, 1.0])]]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_top(whole, 5)


def test_top_k_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    vectors = kd_topk.integer_vectors(df, "vec_id", "embedding")
    assert kd_topk.top_k(vectors, vectors, Scratch(spark)).count() == 0


def test_top_k_hands_small_rows_to_python(spark, monkeypatch):
    """Arrow batches are cut by rows alone, so a row with a whole tree in it makes batches beyond what a process can hold."""
    monkeypatch.setattr(kd_topk, "SHARD_ROWS", 400)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(4000)]
    vectors = kd_topk.integer_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), "vec_id", "embedding")
    total, over = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    handed = type(vectors).mapInArrow

    def counted(df, run, *rest):
        def watched(batches):
            def seen():
                for batch in batches:
                    total.add(batch.nbytes)
                    over.add(sum(batch.slice(i, 1).nbytes > 2 * 4096 for i in range(len(batch))))
                    yield batch

            yield from run(seen())

        return handed(df, watched, *rest)

    monkeypatch.setattr(type(vectors), "mapInArrow", counted)
    got = kd_topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), Scratch(spark), 5).collect()
    whole = np.floor(256 * np.array([v for _, v in rows])).astype(int)
    for q in range(0, 4000, 50):
        scores = whole @ whole[q]
        scores[q] = scores.min() - 1
        best = sorted(range(4000), key=lambda i: (-scores[i], i))[:5]
        assert sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q) == [(n, i, scores[i]) for n, i in enumerate(best, 1)]
    # Before, each of the 90 pairs of shards had a tree of its own: 0.3 MB each.
    assert over.value == 0 and total.value < 6_000_000


def test_nearest_of_odd_vectors_like_sql(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(300)]
    rows += [(400 + i, [0.25, -0.5]) for i in range(120)] + [(600 + 25 * i, []) for i in range(9)]
    rows += [(1000, [float("nan"), 1.0]), (1050, [float("-inf"), 1.0]), (1100, None), (1150, [None, 1.0]), (1200, [0.5]), (-50, [3e5, 1.0])]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    key = lambda r: (r[0], r[1])
    got = sorted((tuple(r) for r in kd_topk.nearest(spark, str(tmp_path)).collect()), key=key)
    assert got == sorted(con.sql(kd_topk.NEAREST_SQL).fetchall(), key=key)


def test_trees_give_the_best_in_any_numbers():
    rng = np.random.default_rng(7)
    for trial in range(25):
        n, dim, most = int(rng.integers(1, 500)), int(rng.integers(1, 8)), [2, 100, 2**14, 2**20, 2**29][trial % 5]
        vectors = rng.integers(-most, most + 1, (n, dim))
        if trial % 3 == 0:
            vectors[rng.random(n) < 0.5] = vectors[0]
        ids, shards = rng.permutation(10 * n)[:n], 3
        trees = [kd_topk.Tree.build(ids[ids % shards == s], vectors[ids % shards == s], s) for s in range(shards) if (ids % shards == s).any()]
        asked = np.arange(0, n, 3)
        block = kd_topk.Block(
            5, ids[asked], np.full(len(asked), kd_topk.NONE), np.full(len(asked), kd_topk.NOBODY), ids[asked] % shards, vectors[asked]
        )
        block.search([kd_topk.Tree.load(tree.dump()) for tree in trees])
        hits = list(zip(*(x.tolist() for x in block.hits()[:3]), strict=True))
        for q in asked.tolist():
            scores = (vectors @ vectors[q]).tolist()
            best = sorted((-s, i) for s, i in zip(scores, ids.tolist(), strict=True) if i != ids[q])[:5]
            assert sorted((-s, i) for asker, i, s in hits if asker == ids[q]) == best


def test_products_are_exact_beyond_doubles():
    a = np.array([[2**40 + 1, 3]])
    assert kd_topk._products(a, np.array([[2**20 + 1, 1]])).tolist() == [[(2**40 + 1) * (2**20 + 1) + 3]]


# --- toxicity ---


def labelled(spark, path, n=600):
    rng, rows, labels = random.Random(4), [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = prose(i, 80).split()
        for _ in range(5 if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(["grolbish", "snarvous", "fleckwit"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    sf = save_documents(spark, path, [*rows, (n, None), (n + 1, "")])
    spark.createDataFrame(labels, "doc_id bigint, toxic int").selectExpr("*", "0 AS quality").write.parquet(f"{sf}/labels.parquet")
    return sf, dict(labels)


def test_toxicity_on_held_out_rows(spark, tmp_path):
    sf, labels = labelled(spark, tmp_path)
    got = toxicity.toxicity_scores(spark, sf).collect()
    assert len(got) == 602
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in labels]
    right = sum(r.predicted == labels[r.doc_id] for r in held)
    assert len(held) > 80 and right >= 0.95 * len(held)


def test_scores_do_not_see_held_out_labels(spark, tmp_path):
    sf, _ = labelled(spark, tmp_path, 300)
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    turned = labels.withColumn("toxic", F.when(held_out, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.train(docs, labels) == toxicity.train(docs, turned)


def test_sample_is_of_documents_that_can_be_sampled(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_DOCS", 20)
    monkeypatch.setattr(toxicity, "fit", lambda sample, totals: sample)
    sf, _ = labelled(spark, tmp_path, 300)
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    more = spark.range(1000, 9000).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS toxic")
    odd = spark.range(1000, 5000).selectExpr("id AS doc_id", "if(id % 3 = 0, repeat('x', 40000), null) AS text")
    sample = toxicity.train(docs.select("doc_id", "text").unionByName(odd), labels.select("doc_id", "toxic").unionByName(more))
    assert [k for _, k in sample] == [0] * 20 + [1] * 20


def test_toxicity_without_examples(spark):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = toxicity.train(table(spark), none)
    got = toxicity.score(table(spark), model).collect()
    assert len(got) == len(ROWS) and all(r.predicted == 0 for r in got)
    assert {r.held_out for r in got if r.doc_id is None} == {None}
    assert toxicity.score(empty(spark), model).count() == 0
    assert toxicity.with_score(table(spark), model).columns == [*table(spark).columns, "toxicity"]


def test_windows_hold_the_whole_text():
    for text in (prose(3, 500), "x" * 1000, "", "é " * 99):
        parts = toxicity.words(text)
        joined = b"".join(toxicity.windows(parts))
        assert joined == (b" " + b" ".join(parts) if parts else b"")


# --- licences ---

LICENSED = [
    (201, "Licensed under the Apache License, Version 2.0."),
    (202, "This work is licensed under the GNU General Public License, version 3."),
    (203, "CC-BY-NC cc by nc 4.0; under the MIT License under the MIT license"),
    (204, "SPDX-License-Identifier: MIT"),
    (205, "Permission is hereby granted, free of charge, to any person obtaining a copy"),
    (206, "the mitten of the license"),
    (207, "under the mit" + " " + "licensé"),
    (208, "x " * 5000 + "released under the BSD 3-Clause License"),
    (209, "under the MİT license"),
    (210, "All rights reserved. Copyright 2020"),
]


def brute_licenses(text):
    """Every rule at every place of its keyword, then every pair of detections."""
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    base = [
        (i, label)
        for phrase, label in licenses.BASE.items()
        for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    ]
    found = []
    for i, word in enumerate(words):
        for r in rules():
            if r.keyword == word:
                first = max(0, i - 14)
                around = " " + " ".join([*words[first:i], "<" + word, *words[i + 1 : i + 15]]) + " "
                m = re.search(r.regex, around)
                if m:
                    ahead = m.group(0).split("<")[0].count(" ") - 1
                    found.append((i - ahead, i - ahead + m.group(0).count(" "), r))
    left = [
        (s, e, r)
        for s, e, r in found
        if not any(
            a <= s and b >= e and (q.priority > r.priority or q.priority == r.priority and (b - a > e - s or b - a == e - s and q.order < r.order))
            for a, b, q in found
        )
    ]
    places = [i for i, _ in base]
    labels = {label for _, label in base}
    return (
        len(words),
        len(base),
        min(places, default=None),
        max(places, default=None),
        ",".join(sorted(labels)),
        ",".join(sorted(labels | {r.label for _, _, r in left})),
        max([r.weight for _, _, r in left] + [licenses.BASE_WEIGHT] * bool(base), default=0.0),
    )


def test_licenses_equal_brute_force(spark):
    rows = ROWS + LICENSED + [(50, "cc by nc " * 40), (51, " ".join(t for _, t in LICENSED))]
    got = licenses.scan(table(spark, rows)).collect()
    assert len(got) == len(rows)
    mine = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in got]
    expected = [(d, *brute_licenses(t)) for d, t in rows]
    assert sorted(map(repr, mine)) == sorted(map(repr, expected))
    by = {r.doc_id: r.labels for r in got}
    assert [by[200 + i] for i in (1, 2, 4, 5, 6, 8)] == ["apache-2", "gpl-3", "mit", "mit", "", "bsd-3"]
    assert licenses.scan(empty(spark)).count() == 0


def test_license_plan_is_native(spark):
    plan = licenses.license_scan(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert len(rules()) > 200 and len({(r.label, r.regex) for r in rules()}) == len(rules())


# --- pipeline ---


def test_pipeline_stages(spark, tmp_path):
    sf, labels = labelled(spark, tmp_path, 240)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    passage = prose(77, 90)
    extra = [
        (1000, prose(1001, 60)), (1001, prose(1001, 60).replace(" ", " \n", 3)), (1002, prose(1001, 59)),
        (1003, prose(5, 30) + passage), (1004, passage + prose(6, 30)), (1004, passage + prose(6, 30)), (None, "no name"), (None, None),
    ]
    more = spark.createDataFrame(extra, "doc_id bigint, text string").selectExpr(
        "*", "'en' AS lang", "'src' AS source", "CAST(length(text) AS int) AS n_chars", "1 AS hash"
    )
    docs = docs.withColumn("hash", F.lit(0)).unionByName(more)
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        rows = docs.collect()
        ids = [r.doc_id for r in rows]
        if name != "packing":
            assert docs.columns == columns
            assert {1000, 1003, 1004} <= set(ids) and None in ids
        if name == "toxicity":
            gone = {i for i in labels if i not in ids}
            assert sum(labels[i] for i in gone) >= 0.9 * len(gone) > 40
        if name == "exact_dedup":
            assert 1001 not in ids and 1002 in ids and ids.count(1004) == 1
        if name == "near_dedup":
            assert 1002 not in ids
        if name == "suffix_dedup":
            left = {r.doc_id: r for r in rows}
            assert all(len(left[i].text) < 400 and left[i].n_chars == len(left[i].text) for i in (1003, 1004))
    assert {"doc_id", "piece", "start", "length", "sequence_id", "offset"} <= set(docs.columns)


def test_pipeline_on_nothing(spark, tmp_path):
    sf, _ = labelled(spark, tmp_path, 40)
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_stages_keep_clashing_columns(spark, tmp_path):
    sf, _ = labelled(spark, tmp_path, 40)
    docs = table(spark, [*ROWS, (93, BASE + "é" + BASE)]).selectExpr("*", "'own' AS toxicity", "'a' AS span_doc", "'b' AS span_text")
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.cut_passages):
        got = stage(spark, docs, sf)
        assert got.columns == docs.columns
        rows = got.collect()
        assert len(rows) == len(ROWS) + 1
        assert {(r.toxicity, r.spans, r.span_doc, r.span_text, r.shard) for r in rows} == {("own", "odd", "a", "b", "odd")}
    assert "é" in {r.text for r in rows if r.doc_id == 93}.pop()[:4]
