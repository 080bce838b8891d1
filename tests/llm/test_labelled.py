"""Chat masks, Merkle manifest and hard negatives, each against a plain version."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import AddedToken, Tokenizer

from querygavel.llm import hard_negatives, merkle
from querygavel.llm.chat_masks import ChatEncoder, Template, chat_digests, format_chats, formatted_conversations, loss_mask, read_turns
from querygavel.llm.common import Scratch
from querygavel.llm.kd_topk import integer_vectors
from tests.llm.common import prose, save_documents

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def sha(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


# --- chats ---

ODD = [
    r"\### Assistant: </turn> ok",
    "<turn>user<text>no</turn>",
    "<\\turn> \\\\ <\\/turn> <<turn>> \\",
    "<|endoftext|> <\\|endoftext|>",
    "",
    " lead and trail ",
    "é\U0001f600\n\n  x",
    "<",
    "turn>",
    "\\",
]


def turns():
    rows = [(1, i, ("user", "assistant")[i % 2], text) for i, text in enumerate(ODD)]
    rows += [(2, None, "assistant", "first"), (2, 0, None, None), (2, 0, "assistant", "b"), (2, 0, "assistant", "a"), (2, 0, "assistant", "a")]
    rows += [(None, 3, "assistant", "nobody"), (None, 1, "user", None), (3, 0, "user", "only asks"), (4, 9, "assistant", None)]
    rows += [(5, i, random.Random(i).choice(["user", "assistant", "<turn>", "a:\nb"]), prose(i, i % 9)) for i in range(400)]
    rows += [(6, 0, "assistant", "the same words")] * 60 + [(7, 0, "assistant", prose(1, 4000))]
    rows += [(100 + i, j, ("user", "assistant")[j % 2], prose(i + j, 5)) for i in range(80) for j in range(3)]
    return rows


def expected_chats(rows):
    chats = {}
    for conv, turn, role, text in rows:
        chats.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    encoder, out = ChatEncoder(BYTES, Template()), {}
    for conv, said in chats.items():
        said = [(role, text) for _, _, role, text in sorted(said)]
        loss = "".join(t for r, t in said if r == "assistant")
        text = "".join(f"<turn>{encoder.escape(r)}<text>{encoder.escape(t)}</turn>" for r, t in said)
        out[conv] = (len(said), sha(*[f"{r}\n{t}\n" for r, t in said]), len(loss), sha(loss), len(text))
    return out


@pytest.mark.parametrize("segment_bytes", [256 << 10, 500])
def test_chats_come_back(spark, segment_bytes):
    rows = turns()
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(4)
    table = table.selectExpr("*", "1 AS row", "'x' AS part", "true AS whole", "2 AS segment")
    formatted = format_chats(table, Scratch(spark), BYTES, segment_bytes=segment_bytes)
    got = chat_digests(formatted, BYTES).collect()
    assert {r.conv_id: tuple(r)[1:6] for r in got} == expected_chats(rows) and len(got) == len({r[0] for r in rows})
    if segment_bytes == 500:
        assert formatted.where("conv_id = 5").count() > 20
    plain = [(r.conv_id, r.role, r.text) for r in read_turns(formatted, BYTES).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(plain, key=key) == sorted([(c, r or "", t or "") for c, _, r, t in rows], key=key)


def test_ids_are_those_of_the_library_and_masks_are_aligned(spark):
    whole = Tokenizer.from_file(BYTES)
    whole.add_special_tokens([AddedToken(mark, special=True, normalized=False) for mark in Template().marks])
    rows = turns()
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    one = format_chats(table, Scratch(spark), BYTES).collect()
    many = format_chats(table, Scratch(spark), BYTES, segment_bytes=300).collect()
    joined = lambda rows, field: {
        conv: [x for r in sorted((r for r in rows if r.conv_id == conv), key=lambda r: (r.part, r.segment)) for x in r[field]]
        for conv in {r.conv_id for r in rows}
    }
    assert joined(one, "ids") == joined(many, "ids") and joined(one, "loss") == joined(many, "loss")
    for row in one:
        assert row.ids == whole.encode(row.text, add_special_tokens=False).ids
        data, ends = row.text.encode(), [*row.starts[1:], len(row.text.encode())]
        assert all(s < e for s, e in zip(row.starts, ends, strict=True))
        assert all(whole.id_to_token(i) not in Template().marks for i, m in zip(row.ids, row.loss, strict=True) if m)
        learnt = b"".join(data[s:e] for s, e, m in zip(row.starts, ends, row.loss, strict=True) if m)
        assert row.loss.count(True) > 0 or not learnt


def test_mask_by_binary_search():
    starts = np.array([0, 3, 5, 9, 9 + 4, 20])
    mask = lambda *spans: loss_mask(starts, np.array(spans).reshape(-1, 2)).tolist()
    assert mask((3, 9)) == [False, True, True, False, False]
    assert mask((0, 0), (20, 20), (5, 5)) == [False] * 5
    assert mask((1, 4), (13, 20)) == [True, True, False, False, True]
    assert loss_mask(np.array([0]), np.empty((0, 2), int)).tolist() == []


def test_chats_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    formatted = format_chats(empty, Scratch(spark), BYTES)
    assert chat_digests(formatted, BYTES).count() == read_turns(formatted, BYTES).count() == 0


def test_templates_that_cannot_be_undone_are_refused():
    for marks in (("<", "b:", "c:"), ("a\\b", "b:", "c:"), ("ab", "bc", "d:")):
        with pytest.raises(ValueError):
            ChatEncoder(BYTES, Template(*marks))
    with pytest.raises(ValueError):
        ChatEncoder(public_tokenizers.path("word_bpe_49k.json"), Template())


def test_formatted_conversations(spark, tmp_path):
    rows = turns()
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    odd = [(-7, i, role, ODD[0]) for i, role in enumerate(("user", "assistant"))]
    got = formatted_conversations(spark, str(tmp_path)).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == expected_chats(rows + odd)


# --- manifest ---


def plain_manifest(rows):
    """doc_id, leaf, subroot, root, proof, folded root and verified of (doc_id, text, lang, source, n_chars)."""

    def field(value):
        return "-" if value is None else f"{len(str(value).encode())}:{value}"

    def leaf(doc_id, text, lang, source, n_chars):
        return sha(*map(field, (doc_id, source, lang, n_chars, text)))

    def build(hashes):
        found = [hashes]
        while len(found[-1]) > 1:
            found.append([sha(*found[-1][i : i + 3]) for i in range(0, len(found[-1]), 3)])
        return found

    def climb(tree, i):
        out = []
        for level in tree[:-1]:
            first = i // 3 * 3
            out.append((level[first:i], level[i + 1 : first + 3]))
            i //= 3
        return out

    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    groups = [sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r))) for s in sources]
    trees = [build([leaf(*r) for r in group]) for group in groups]
    top = build([tree[-1][0] for tree in trees])
    out = []
    for g, (group, tree) in enumerate(zip(groups, trees, strict=True)):
        for i, row in enumerate(group):
            path = climb(tree, i) + climb(top, g)
            text = row[1]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            acc = leaf(row[0], text, *row[2:])
            for left, right in path:
                acc = sha(*left, acc, *right)
            proof = sha(*[h for left, right in path for h in left + right])
            out.append((row[0], leaf(*row), tree[-1][0], top[-1][0], proof, acc, acc == top[-1][0]))
    return sorted(out, key=repr)


def manifest_rows(counts):
    rows = []
    for source, n in counts.items():
        for i in range(n):
            rows.append((len(rows) * 7 % 1009, prose(i, 6) + "\n" * (i % 3), ("en", None)[i % 2], source, (i, None)[i % 5 == 0]))
    return rows


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
COUNTS = [
    {"a": 1},
    {"a": 27, None: 1, "": 3, "é": 28, "z": 82, "B": 2},
    {"hot": 800, **{f"s{i}": 1 + i % 4 for i in range(30)}},
]


@pytest.mark.parametrize("counts", COUNTS)
def test_manifest(spark, tmp_path, counts):
    rows = manifest_rows(counts)
    rows += [(None, None, None, "a", None), (None, "x\n", "en", "a", 1), (5, "", "", "a", 0)] + [(40 + i // 2, "again\n", "en", "a", 6) for i in range(12)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5).selectExpr("*", "1 AS tree", "2 AS hash", "3 AS rank", "4 AS n", "5 AS leaf")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.checked_manifest(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    found = sorted(map(tuple, got.collect()), key=repr)
    assert found == plain_manifest(rows)
    assert any(r[-1] for r in found) and not all(r[-1] for r in found)


def test_manifest_of_nothing_and_of_plain_documents(spark, tmp_path):
    assert merkle.manifest(spark.createDataFrame([], DOCS), Scratch(spark)).count() == 0
    rows = [(i, prose(i, 4)) for i in range(50)]
    sf = save_documents(spark, tmp_path, rows)
    found = merkle.manifest(spark.read.parquet(f"{sf}/documents.parquet"), Scratch(spark))
    folded = found.select(merkle.folded(F.col("leaf"), F.col("path")).alias("f"), "root", F.size("path").alias("n")).collect()
    assert len(folded) == 50 and all(r.f == r.root and r.n == 4 for r in folded)


# --- hard negatives ---


def plain_negatives(rows, anchor, positives=5, negatives=10):
    out = []
    for a, la, va in rows:
        if not anchor(a):
            continue
        scored = [(sum(x * y for x, y in zip(va, v, strict=True)), i, lab) for i, lab, v in rows if i != a and len(v) == len(va)]
        scored.sort(key=lambda s: (-s[0], s[1]))
        for p, pid, _ in [s for s in scored if s[2] == la][:positives]:
            inside = [s for s in scored if s[2] != la and 30 * p <= 100 * s[0] <= 90 * p][:negatives]
            out += [(a, pid, r, n, p, s) for r, (s, n, _) in enumerate(inside, 1)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows, dim", [(4096, 6), (70, 6), (70, 64), (150, 1)])
def test_hard_negatives(spark, monkeypatch, shard_rows, dim):
    monkeypatch.setattr(hard_negatives, "SHARD_ROWS", shard_rows)
    rng = np.random.default_rng(dim)
    centres = rng.normal(size=(4, dim))
    rows = [(i, int(i % 4), [float(x) for x in np.round(centres[i % 4] + rng.normal(size=dim), 1)]) for i in range(400)]
    rows += [(500 + i, int(rng.integers(4)), [0.5] * dim) for i in range(150)] + [(1000, 9, [1.0] * dim), (1100, 1, [0.0] * dim)]
    rows += [(2000, 1, [1.0, 2.0]), (2001, 1, [2.0, 2.0]), (2002, 2, [0.5, 0.75])]
    bad = [(1200, 1, None), (1300, 1, [1.0, None]), (1400, 2, [float("nan")]), (1500, None, [1.0] * dim), (None, 1, [1.0] * dim), (1600, 1, [])]
    df = spark.createDataFrame(rows + bad + rows[100:102], "vec_id bigint, label int, embedding array<double>").repartition(3)
    df = df.selectExpr("*", "1 AS shard", "'x' AS kind", "2 AS key", "3 AS ranges", "4 AS dim")
    vectors = hard_negatives.labelled_vectors(df, F.col("label"))
    got = hard_negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0, Scratch(spark)).collect()
    whole = [(i, lab, [int(np.floor(256 * x)) for x in v]) for i, lab, v in rows]
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert sorted(tuple(r[n] for n in names) for r in got) == plain_negatives(whole, lambda i: i % 100 == 0)


def test_bounds_hold_and_leave_out():
    rng = np.random.default_rng(1)
    base = np.repeat(rng.normal(0, 300, (900, 8)), 8, axis=1) + rng.normal(0, 20, (900, 64))
    vectors = np.floor(base).astype(np.int64)
    labels = np.arange(900) % 2
    shard = hard_negatives.Shard(np.arange(900), labels, vectors, *hard_negatives.summaries(vectors))
    scores = vectors @ vectors[0]
    top = np.array([scores[labels == 1].max() // 2])
    low, cap = np.array([0]), top
    ((ids, found),) = shard.search(0, 0, False, vectors[0], *(s[0] for s in hard_negatives.summaries(vectors)), low, cap, 10)
    inside = sorted([(-int(s), i) for i, s in enumerate(scores) if labels[i] == 1 and 0 <= s <= cap[0]])[:10]
    assert [(-int(s), int(i)) for i, s in zip(ids, found, strict=True)] == inside
    assert shard.scored < 100


def test_hard_negatives_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id bigint, label int, embedding array<float>")
    vectors = hard_negatives.labelled_vectors(df, F.col("label"))
    assert hard_negatives.hard_negatives(vectors, F.lit(True), Scratch(spark)).count() == 0
    assert integer_vectors(df, "vec_id", "embedding").columns == ["vec_id", "dim", "vec"]
