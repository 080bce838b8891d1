import hashlib
import random
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from querygavel.llm import exact_dedup, suffix_dedup, super_minhash
from querygavel.llm.common import Scratch
from querygavel.llm.components import connected_components
from querygavel.llm.suffix_sort import Suffixes, repeated
from tests.llm.common import ROWS, empty, prose, save_documents, table


def brute_exact(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(d)
    out = []
    for ids in groups.values():
        known = [i for i in ids if i is not None]
        out += [(i, min(known, default=None), len(ids)) for i in ids]
    return out


@pytest.mark.parametrize("table_bytes", [1 << 20, 300])
def test_exact_groups(spark, table_bytes):
    rows = exact_dedup.exact_groups(table(spark), Scratch(spark), table_bytes).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted([(r.doc_id, r.keep_id, r.group_size) for r in rows], key=key) == sorted(brute_exact(ROWS), key=key)
    kept = [r for r in rows if r.kept]
    assert len(kept) == len({r.text_sha256 for r in rows}) and all(r.doc_id == r.keep_id for r in kept)
    assert exact_dedup.exact_groups(empty(spark), Scratch(spark)).count() == 0


def test_table_compares_contents():
    own = exact_dedup.OpenTable()
    assert own.find(7, b"a") != own.find(7, b"b") and own.find(7, b"a")[1] is False


def brute_components(rows, k, percent):
    sets = {}
    for d, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        grams = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} - {()}
        sets[d] = grams
    name = {d: d for d in sets}

    def find(d):
        while name[d] != d:
            d = name[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                name[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def varied(n_groups, per_group, seed=0):
    rng, rows, d = random.Random(seed), [], 0
    for g in range(n_groups):
        words = prose(100 + g, 60).split()
        for _ in range(per_group):
            own = list(words)
            for _ in range(rng.randint(0, 6)):
                own[rng.randrange(len(own))] = prose(rng.randrange(10**6), 1)
            rows.append((d, " ".join(own)))
            d += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("k, block", [(2, 400), (5, 400), (2, 7)])
def test_near_groups_equal_brute_force(spark, monkeypatch, k, block):
    monkeypatch.setattr(super_minhash, "BLOCK_DOCS", block)
    monkeypatch.setattr(super_minhash, "PIVOTS", 48 if block > 10 else 3)
    rows = [r for r in ROWS if r[0] is not None] + [(100 + d, t) for d, t in varied(4, 25)]
    expected = brute_components(rows, k, 80)
    got = super_minhash.near_groups(table(spark, rows), Scratch(spark), k).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_groups_of_nothing(spark):
    assert super_minhash.near_groups(empty(spark), Scratch(spark)).count() == 0
    rows = super_minhash.near_groups(table(spark, [(None, "a b"), (1, None), (2, ""), (3, "a b")]), Scratch(spark)).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in rows} == {(None, None, True), (1, 1, True), (2, 2, True), (3, 3, True)}


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    off = []
    for _ in range(60):
        a = rng.integers(0, 1 << 62, 300, dtype=np.uint64)
        b = np.concatenate([a[:200], rng.integers(0, 1 << 62, 100, dtype=np.uint64)])
        h = super_minhash.signatures([np.unique(a), np.unique(b)])
        assert np.isfinite(h).all()
        off.append((h[0] == h[1]).mean() - 0.5)
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.05
    one = super_minhash.signatures([np.array([5], np.uint64)])
    assert sorted(np.floor(one[0]).astype(int)) == list(range(super_minhash.SLOTS))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 103), (103, 101), (101, 101), (200, 150)]
    got = connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark)).collect()
    name = {r.node: r.component for r in got}
    assert len(name) == len(got)
    assert all(name[i] == 0 for i in range(41)) and name[103] == name[101] == 100 and name[200] == 150


def brute_spans(rows):
    seen, texts = {}, [(t or "").encode() for _, t in rows]
    for b in texts:
        for p in range(len(b) - 399):
            seen[b[p : p + 400]] = seen.get(b[p : p + 400], 0) + 1
    out = []
    for (d, t), b in zip(rows, texts, strict=True):
        hit = np.zeros(len(b) + 2, bool)
        for p in range(len(b) - 399):
            if seen[b[p : p + 400]] > 1:
                hit[p + 1 : p + 401] = True
        edge = np.flatnonzero(hit[1:] != hit[:-1])
        out.append((d, t, list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))))
    return out


def passages(seed=5):
    rng, shared = random.Random(seed), [prose(50 + i, n) for i, n in enumerate((70, 75, 90, 200))]
    rows = [(20 + i, prose(300 + i, rng.randint(5, 150)) + rng.choice(shared) + prose(600 + i, rng.randint(0, 90))) for i in range(60)]
    return [*rows, (90, "é" * 500), (91, "xé" + "é" * 500), (92, "ab" * 350), (93, shared[0] + "é" + shared[0])]


@pytest.mark.parametrize("hot, parts", [(1500, 3), (3, 3), (3, 17), (1, 5), (1500, 1)])
def test_spans_equal_brute_force(spark, monkeypatch, hot, parts):
    rows = ROWS + passages()
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    if hot < 10:
        # Counted in the workers: the answer is made by a function that takes the bound along.
        monkeypatch.setattr(suffix_dedup, "_answered", bounded(hot))
    got = suffix_dedup.with_spans(table(spark, rows).repartition(parts).drop("spans"), Scratch(spark)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[2])
    mine = sorted([(r.doc_id, r.text, [tuple(s) for s in r.spans or []]) for r in got], key=key)
    assert mine == sorted(brute_spans(rows), key=key)
    cut = suffix_dedup.cut_texts(table(spark, rows).drop("spans"), Scratch(spark)).collect()
    assert len(cut) == len(rows) and all((r.text is None) == (r.doc_id == 4) for r in cut)


def bounded(hot):
    original = suffix_dedup._answered

    def run(group):
        before, suffix_dedup.HOT = suffix_dedup.HOT, hot
        try:
            return original(group)
        finally:
            suffix_dedup.HOT = before

    return run


def test_spans_of_nothing(spark):
    assert suffix_dedup.repeated_spans(empty(spark), Scratch(spark)).count() == 0


def test_cut_text_keeps_whole_characters():
    assert suffix_dedup.cut_text("aéb", [(2, 3)]) == "aéb"
    assert suffix_dedup.cut_text("aéb", [(1, 3)]) == "ab"
    assert suffix_dedup.cut_text("aéb", [(0, 2), (2, 4)]) == "é"


def test_suffix_sort_order():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    data[1000:1400] = data[200:600]
    starts = rng.permutation(2500)[:700]
    segment = np.sort(rng.integers(0, 5, 700))
    own = Suffixes(data, 300)
    order = own.sort(starts, segment)
    for s in range(5):
        texts = [data[i : i + 300].tobytes() for i in order[segment == s]]
        assert texts == sorted(texts)
        assert sorted(order[segment == s]) == sorted(starts[segment == s])
    hit = repeated(data, starts, segment, 60)
    for s in range(5):
        texts = [data[i : i + 60].tobytes() for i in starts[segment == s]]
        assert hit[segment == s].tolist() == [texts.count(t) > 1 for t in texts]


def test_registered_query(spark, tmp_path):
    rows = [(i, t) for i, (_, t) in enumerate(ROWS + passages())]
    found = suffix_dedup.passages_removed(spark, save_documents(spark, tmp_path, rows)).collect()
    expected = {}
    for d, t, spans in brute_spans(rows):
        data, at, kept = (t or "").encode(), 0, b""
        for a, b in spans:
            kept, at = kept + data[at:a], b
        removed = sum(b - a for a, b in spans)
        expected[d] = (len(data), removed, len(spans), removed > 0, hashlib.sha256(kept + data[at:]).hexdigest())
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.changed, r.kept_sha256) for r in found} == expected


class Kept(Scratch):
    """Scratch that remembers its tables by their purpose."""

    def table(self, df, purpose, *args, **kwargs):
        self.held = {**getattr(self, "held", {}), purpose: super().table(df, purpose, *args, **kwargs)}
        return self.held[purpose]


def bounded_there(hot):
    """As ``bounded``, with the module of the worker: a function that is patched here travels with its own globals."""

    def run(group):
        from querygavel.llm import suffix_dedup as own

        before, own.HOT = own.HOT, hot
        try:
            return own._answered(group)
        finally:
            own.HOT = before

    return run


@pytest.mark.parametrize("hot, parts", [(1, 5), (3, 3)])
def test_spans_with_hot_cores_equal_brute_force(spark, monkeypatch, hot, parts):
    monkeypatch.setattr(suffix_dedup, "_answered", bounded_there(hot))
    rows = [(d, t) for d, t in ROWS + passages() if d is not None]
    got = suffix_dedup.with_spans(table(spark, rows, clash=False).repartition(parts), Scratch(spark)).collect()
    mine = sorted((r.doc_id, r.text or "", [tuple(s) for s in r.spans or []]) for r in got)
    assert mine == sorted((d, t or "", s) for d, t, s in brute_spans(rows))


@pytest.mark.parametrize("parts", [1, 4])
def test_no_group_of_slices_is_above_the_bound(spark, monkeypatch, parts):
    monkeypatch.setattr(suffix_dedup, "_answered", bounded_there(20))
    shared = prose(50, 90)
    rows = [(i, prose(300 + i, 20 + i) + shared + prose(600 + i, i)) for i in range(80)]
    docs, scratch = table(spark, rows, clash=False).repartition(parts), Kept(spark)
    found = {r.doc_id: [tuple(s) for s in r.spans] for r in suffix_dedup.repeated_spans(docs, scratch).collect()}
    assert found == {d: spans for d, _, spans in brute_spans(rows) if spans}
    slices = scratch.held["slices"]
    assert slices.where("kind = 2").count()
    assert max((r["count"] for r in slices.where("kind = 1").groupBy("key").count().collect()), default=0) <= 20


@pytest.mark.parametrize("buckets", [64, 1600])
def test_what_chunks_know_is_dealt_evenly(monkeypatch, buckets):
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text_hash": [1, 1], "text": [prose(50, 90)] * 2})
    seen = []
    for task in range(64):
        monkeypatch.setattr(suffix_dedup, "TaskContext", SimpleNamespace(get=lambda t=task: SimpleNamespace(partitionId=lambda: t)))
        rows = [r for b in suffix_dedup._asked(iter([batch]), buckets) for r in b.to_pylist()]
        seen += [r["bucket"] for r in rows if r["known"]]
    assert len(seen) == 64 and all(0 <= b < buckets for b in seen)
    assert len(set(seen)) > 30 and max(map(seen.count, seen)) < 8


def test_signatures_in_slices(monkeypatch):
    rng = np.random.default_rng(2)
    sets = [rng.integers(0, 1 << 62, n, dtype=np.uint64) for n in (1, 700, 3, 90, 1501)]
    whole = super_minhash.signatures(sets)
    monkeypatch.setattr(super_minhash, "SLICE_ELEMENTS", 100)
    assert (super_minhash.set_signatures(sets) == whole).all()
    assert super_minhash.set_signatures([]).shape == (0, super_minhash.SLOTS)


def test_short_spans_equal_brute_force(spark):
    rows = [(d, t) for d, t in ROWS + passages() if d is not None]
    got = suffix_dedup.with_spans(table(spark, rows, clash=False).repartition(3), Scratch(spark), length=150).collect()
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(b[p : p + 150] for b in texts for p in range(len(b) - 149))
    expected = []
    for (d, t), b in zip(rows, texts, strict=True):
        covered = {i for p in range(len(b) - 149) if seen[b[p : p + 150]] > 1 for i in range(p, p + 150)}
        expected.append((d, t or "", covered))
    mine = [(r.doc_id, r.text or "", {i for s in r.spans or [] for i in range(*s)}) for r in got]
    assert sorted(mine, key=lambda r: r[:2]) == sorted(expected, key=lambda r: r[:2])


def test_pipeline_cuts_passages_of_over_50_words(spark):
    import corpus_pipeline

    letters = random.Random(4)
    some = lambda n: " ".join("".join(letters.choices("abcdefgh", k=4)) for _ in range(n))
    long, short = some(55), some(48)
    assert len(long) < 400
    rows = [(i, f"{some(30)} {(long, short, some(55))[i % 3]} {some(20)}") for i in range(9)]
    left = {r.doc_id: r.text for r in corpus_pipeline.cut_passages(spark, table(spark, rows, clash=False), "").collect()}
    assert all(long not in left[i] and 48 <= len(left[i].split()) <= 50 for i in (0, 3, 6))
    assert all(left[i] == t for i, t in rows if i % 3)


def brute_passages(text, others):
    """Bytes of runs of 200-byte strings that start twice, if a run has 400 bytes or over 50 whole words."""
    data, all_ = text.encode(), [o.encode() for o in others]
    hit = np.zeros(len(data) + 2, bool)
    for p in range(len(data) - 199):
        part = data[p : p + 200]
        if sum(len(re.findall(b"(?=" + re.escape(part) + b")", o)) for o in all_) > 1:
            hit[p + 1 : p + 201] = True
    edge = np.flatnonzero(hit[1:] != hit[:-1]).tolist()
    marks = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
    whole = lambda a, b: sum(a <= x and y <= b for x, y in marks)
    return [b - a for a, b in zip(edge[::2], edge[1::2], strict=True) if b - a >= 400 or whole(a, b) > 50]


def test_query_tells_of_passages_under_400_bytes(spark, tmp_path):
    short, few = " ".join("abcde"[: 2 + i % 4] + str(i % 7) for i in range(60)), "longword" * 30 + " of few words here"
    long, alone = prose(70, 120), prose(71, 40)
    assert len(short) < 400 and len(few) < 400 < len(long)
    rows = [(1, f"one {short} end"), (2, f"two {short}"), (3, f"{few} x"), (4, f"y {few}"), (5, f"{long} {alone}"), (6, f"z {long}")]
    rows += [(7, f"{short} between {long}"), (8, alone), (9, None), (None, short), (8, alone), (10, "x" * 150)]
    got = suffix_dedup.passages_removed(spark, save_documents(spark, tmp_path, rows)).collect()
    texts = [t or "" for _, t in rows]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    expected = [(d, len(brute_passages(t, texts)), sum(brute_passages(t, texts))) for t, (d, _) in zip(texts, rows, strict=True)]
    assert sorted([(r.doc_id, r.n_passages, r.n_passage_bytes) for r in got], key=key) == sorted(expected, key=key)
    assert all(r.has_passage == (r.n_passages > 0) for r in got)
    assert {r.doc_id for r in got if r.has_passage and not r.changed} == {1, 2, None}
    removed = {(d, b"".join(t.encode()[a:b] for a, b in spans)) for d, t, spans in brute_spans([(d, t or "") for d, t in rows])}
    assert {(r.doc_id, r.n_removed) for r in got} == {(d, len(x)) for d, x in removed}


def test_equal_slices_meet_others_in_the_sort(spark):
    """Copies are settled without the sort; a text that shares only a part of them still finds it."""
    one, two = prose(80, 300), prose(81, 300)
    rows = [(i, one) for i in range(5)] + [(10, one[100:900] + two), (11, two[200:800] + "!")]
    got = suffix_dedup.with_spans(table(spark, rows, clash=False).repartition(5), Scratch(spark)).collect()
    mine = sorted((r.doc_id, r.text, [tuple(s) for s in r.spans or []]) for r in got)
    assert mine == sorted(brute_spans(rows))
