import base64
import sys
import weakref
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from querygavel.llm import byte_bpe, packing, rans
from querygavel.llm.common import Scratch, frugal
from querygavel.llm.library_tokens import library_encoder
from querygavel.llm.packing import _best_fit, pack, places, solve
from querygavel.llm.perfect_hash import PerfectHash
from querygavel.llm.pretokens import Memo
from tests.llm.common import ROWS, empty, prose, table

TEXTS = [t or "" for _, t in ROWS] + ["  lead", "trail  ", "a  b", "don't I'll", "x\n\n y", "tab\tx \t y", "9 99 a1b2", "ǅ ŉ ﬁ"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_stretches_encode_as_whole_texts(name):
    whole = Tokenizer.from_file(public_tokenizers.path(name))
    own = library_encoder(public_tokenizers.path(name))
    special = ["x <|endoftext|> y", "<|endoftext|><|startoftext|>", " <|endoftext|>don't <|startoftext|>\n\n A", "<|endoftext|", "a <|endoftext|>  "]
    for text in [*TEXTS, *special]:
        ids = whole.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own(text), "<u4").tolist() == ids, text


def test_other_tokenizers_are_refused(tmp_path):
    path = tmp_path / "t.json"
    Tokenizer(__import__("tokenizers").models.BPE()).save(str(path))
    with pytest.raises((ValueError, TypeError, AttributeError)):
        library_encoder(str(path))


def test_memo_is_bounded():
    size = sys.getsizeof("a") + sys.getsizeof(b"a") + Memo.ENTRY_BYTES
    kept, cleared = Memo(str.encode, 2 * size, keep=True), Memo(str.encode, 2 * size, keep=False)
    for memo in (kept, cleared):
        assert [memo[k] for k in "abcab"] == [b"a", b"b", b"c", b"a", b"b"]
        assert len(memo) <= 2 and memo.bytes <= 2 * size
        assert memo["long" * 99] == b"long" * 99 and memo.bytes <= 2 * size


def test_other_patterns_are_refused():
    with pytest.raises(ValueError):
        byte_bpe.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), r"[a-z]|\s+|.")


def test_the_program_runs_for_few_pieces_too(monkeypatch):
    runs = []
    monkeypatch.setattr(packing, "configuration_lp", lambda *a, own=packing.configuration_lp: runs.append(own(*a)) or runs[-1])
    counts = np.bincount(np.random.default_rng(0).integers(1, 2048, 200), minlength=2049)
    assert sum(solve(counts).used.values()) == 200
    covered = sum(int(x) * sum(many for _, many in f) for f, x in runs[0].items())
    assert covered > 100


def test_perfect_hash():
    entries = {b"%d" % i: i for i in range(5000)}
    own = PerfectHash(entries)
    assert all(own.get(k) == v for k, v in entries.items())
    assert own.n == 5000 and None not in own.keys
    assert own.get(b"absent") == -1 and PerfectHash({}).get(b"") == -1


def test_bpe_equals_tiktoken():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own, codec = byte_bpe.encoder(path, public_tokenizers.PATTERN), byte_bpe.codec(path)
    for text in [*TEXTS, "thththth" * 40, "ééé" * 50]:
        ids = np.frombuffer(own(text), "<u4").tolist()
        assert ids == known.encode_ordinary(text), text
        assert codec.decode(ids) == text.encode()


def test_bpe_tables(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = byte_bpe.encode(table(spark), path)
    back = byte_bpe.decode(ids, path).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted([(r.doc_id, bytes(r.data)) for r in back], key=key) == sorted(
        [(d, (t or "").encode()) for d, t in ROWS], key=key
    )
    assert byte_bpe.encode(empty(spark), path).count() == 0


def test_rans_blocks():
    rng = np.random.default_rng(0)
    for n, vocabulary in ((0, 3), (1, 1), (5000, 1), (100_000, 30_000), (200_001, 40)):
        ids = (rng.zipf(1.3, n) % vocabulary).astype(np.int64)
        seen, counts = np.unique(np.concatenate([ids, [0]]), return_counts=True)
        own = rans.Table(seen.tolist(), counts.tolist())
        assert int(own.freq.sum()) == 1 << own.bits and own.freq.min() >= 1
        data = own.encode(ids)
        assert own.decode(data).tolist() == ids.tolist()
        if n > 1000:
            broken = bytearray(data)
            broken[len(data) // 2] ^= 1
            assert zlib.crc32(bytes(broken)) != zlib.crc32(data)


def test_token_files(spark, monkeypatch):
    monkeypatch.setattr(rans, "BLOCK_TOKENS", 1 << 18)
    path = public_tokenizers.path("word_bpe_49k.json")
    back = rans.read_tokens(*rans.write_tokens(table(spark), Scratch(spark), path, 1)).collect()
    own = library_encoder(path)
    assert len(back) == len(ROWS)
    at = 0
    for r in sorted(back, key=lambda r: r.start):
        ids = np.frombuffer(r.ids, "<u4")
        assert r.start == at and ids[-1] == 1
        at += len(ids)
    by_start = [r.doc_id for r in sorted(back, key=lambda r: r.start)]
    assert by_start == sorted([d for d, _ in ROWS if d is not None]) + [None, None]
    assert {(r.doc_id, bytes(r.ids)) for r in back} == {(d, own(t or "") + b"\1\0\0\0") for d, t in ROWS}
    assert rans.read_tokens(*rans.write_tokens(empty(spark), Scratch(spark), path, 1)).count() == 0


def test_damaged_block_is_refused(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    blocks, table_ = rans.write_tokens(table(spark), Scratch(spark), path, 1)
    with pytest.raises(Exception, match="damaged"):
        rans.read_tokens(blocks.withColumn("crc32", F.col("crc32") + 1), table_).collect()


@pytest.mark.parametrize("n", [0, 1, 300, 30_000])
def test_layout_holds_every_piece_once(n):
    rng = np.random.default_rng(n)
    lengths = np.clip(rng.lognormal(6, 1, n), 1, 2048).astype(int)
    counts = np.bincount(lengths, minlength=2049)
    layout = solve(counts)
    plain = sum(_best_fit({}, counts.copy(), 2048).values())
    assert layout.sequences <= plain
    assert -(-int(lengths.sum()) // 2048) <= layout.sequences
    number = np.zeros(n, np.int64)
    for length in np.unique(lengths):
        here = lengths == length
        number[here] = np.arange(here.sum())
    sequence, offset = places(layout.frozen(), lengths, number)
    order = np.lexsort((offset, sequence))
    s, o, end = sequence[order], offset[order], (offset + lengths)[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])[:n]
    assert (o[new] == 0).all() and (o[~new] == end[:-1][~new[1:]]).all() and end.max(initial=0) <= 2048


def test_pack(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = pack(table(spark), Scratch(spark), path, 0).collect()
    own = library_encoder(path)
    whole = sorted(own(t or "") + bytes(4) for _, t in ROWS)
    long = [r for r in rows if r.doc_id == 8]
    assert len(long) > 1 and all(r.length == 2048 for r in long if r.piece)
    joined = b"".join(bytes(r.ids) for r in sorted(long, key=lambda r: r.piece))
    assert joined == own(dict(ROWS)[8]) + bytes(4)
    assert sorted([bytes(r.ids) for r in rows if r.doc_id != 8] + [joined]) == whole
    taken = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    for (s, o, n), (t, p, _) in zip(taken, taken[1:]):
        assert (t, p) == (s, o + n) or (t != s and p == 0)
    assert pack(empty(spark), Scratch(spark), path, 0).count() == 0
    assert prose(1, 3) == prose(1, 3)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_a_column_is_encoded_like_its_texts(monkeypatch, name):
    import pyarrow as pa

    from querygavel.llm import library_tokens

    path = public_tokenizers.path(name)
    encoder, library = library_encoder(path), Tokenizer.from_file(path)
    texts = [t for _, t in ROWS] + ["", " ", "a", " a", "a  b", "a\nb c", "x <|endoftext|> y", "İ Σας", "one two", "one two ", prose(3, 4000), "a\n\n b \nc.\nD", "\n", "x\n\u0301y \u0301z", "it\n's 'S\ns", "Ες\nΣ Σ\n", "a\t\nb"]
    expected = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    for size in (1, 500, 1 << 22):
        monkeypatch.setattr(library_tokens, "BATCH_BYTES", size)
        for column in (pa.array(texts, pa.string()), pa.array(["skipped", *texts], pa.string()).slice(1)):
            assert [np.frombuffer(b, "<u4").tolist() for b in encoder.many(column)] == expected
    assert list(encoder.many(pa.array([], pa.string()))) == []
    # Each stretch of a batch is looked up once, however often it occurs.
    asked = []
    monkeypatch.setattr(encoder.between, "get", type("Seen", (dict,), {"__missing__": lambda self, k: asked.append(k) or encoder.between._stretch(k)})().__getitem__)
    assert list(encoder.many(pa.array(["first" + " again" * 50] * 3))) == [encoder("first") + 50 * encoder.between._stretch("again")] * 3
    assert asked == ["again"]


def test_workers_forget_what_other_operators_remember():
    path, idle = public_tokenizers.path("byte_bpe_50k.json"), lambda it: it
    encoder = library_encoder(path)
    encoder("some words to remember")
    list(frugal(idle, keeps="library_encoder")(iter([])))
    assert library_encoder(path) is encoder
    gone = weakref.ref(encoder)
    del encoder
    list(frugal(idle)(iter([])))
    assert gone() is None


def test_little_memory_changes_no_ids():
    path, text = public_tokenizers.path("byte_bpe_50k.json"), prose(5, 400)
    small = library_encoder(path, most_bytes=2000)
    assert small(text) == library_encoder(path)(text)
    assert max(small.between.memo.bytes, small.between.piece_memo.bytes) <= 2000
