"""Token ids in files by a static range asymmetric numeral system.

One frequency table serves all files. Ids are cut into blocks of whole documents; a block is encoded by itself, over
interleaved lanes, so any block can be decoded without its neighbours. The table of blocks is the index: each row holds
where its block stands (file, block), its documents and their lengths, its checksum, and the coded bytes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querygavel.llm.common import Scratch, documents, slices
from querygavel.llm.library_tokens import library_encoder

BLOCK_TOKENS = 1 << 18
LANES = 1024
_LOW = 31  # states stay in [2^31, 2^63), words have 32 bits
_HEAD = struct.Struct("<4sIQI")


def normalised(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """Frequencies of at least 1 that sum to a power of two, and its exponent; the power leaves 16 slots an id."""
    bits = max(12, (16 * max(1, len(ids)) - 1).bit_length())
    total = 1 << bits
    freq = np.maximum(1, (counts.astype(np.float64) * (total / max(1, counts.sum()))).astype(np.int64))
    order = np.argsort(-freq, kind="stable")
    gap = total - int(freq.sum())
    if gap >= 0:
        freq[order[:1]] += gap
    else:
        can = (freq - 1)[order]
        taken = np.minimum(can, np.maximum(0, -gap - (np.cumsum(can) - can)))
        freq[order] -= taken
    return freq, bits


class Table:
    """Ids with their frequencies; turns blocks of ids into bytes and back."""

    def __init__(self, ids: list[int], counts: list[int]):
        order = np.argsort(ids, kind="stable")
        self.ids = np.array(ids, np.int64)[order]
        freq, self.bits = normalised(self.ids, np.array(counts, np.int64)[order])
        self.freq = freq.astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.by_slot = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.rank = np.zeros(int(self.ids[-1]) + 1 if len(self.ids) else 0, np.int64)
        self.rank[self.ids] = np.arange(len(self.ids))
        self.common = int(np.argmax(freq)) if len(freq) else 0

    def encode(self, ids: np.ndarray) -> bytes:
        """Lanes take ids in turn; the last one goes first, so that decoding runs forward."""
        n = len(ids)
        lanes = max(1, min(LANES, -(-n // 64)))
        steps = -(-n // lanes)
        padded = np.full(steps * lanes, self.common, np.int64)
        padded[:n] = self.rank[ids]
        rows = padded.reshape(steps, lanes)
        bits, word, low = np.uint64(self.bits), np.uint64(32), np.uint64(0xFFFFFFFF)
        most = np.uint64(_LOW + 32 - self.bits)
        x = np.full(lanes, 1 << _LOW, np.uint64)
        words: list[np.ndarray] = []
        for row in rows[::-1]:
            f = self.freq[row]
            full = x >= (f << most)
            words.append((x[full] & low).astype("<u4"))
            x = np.where(full, x >> word, x)
            q = x // f
            x = (q << bits) + (x - q * f) + self.cum[row]
        coded = b"".join(w.tobytes() for w in reversed(words))
        return _HEAD.pack(b"RANS", lanes, n, self.bits) + x.astype("<u8").tobytes() + coded

    def decode(self, data: bytes) -> np.ndarray:
        magic, lanes, n, bits_used = _HEAD.unpack_from(data)
        if magic != b"RANS" or bits_used != self.bits:
            raise ValueError("not a block of this table")
        x = np.frombuffer(data, "<u8", lanes, _HEAD.size).astype(np.uint64)
        words = np.frombuffer(data, "<u4", offset=_HEAD.size + 8 * lanes).astype(np.uint64)
        steps, at = -(-n // lanes), 0
        out = np.empty((steps, lanes), np.uint32)
        bits, mask, word = np.uint64(self.bits), np.uint64((1 << self.bits) - 1), np.uint64(32)
        low = np.uint64(1 << _LOW)
        for step in range(steps):
            slot = x & mask
            rank = self.by_slot[slot]
            out[step] = rank
            x = self.freq[rank] * (x >> bits) + slot - self.cum[rank]
            short = np.flatnonzero(x < low)
            x[short] = (x[short] << word) | words[at : at + len(short)]
            at += len(short)
        if at != len(words) or (x != low).any():
            raise ValueError("a block does not end where it began")
        return self.ids[out.ravel()[:n]]


_TOKENS = pa.schema(
    [
        ("file", pa.int32()),
        ("block", pa.int64()),
        ("at", pa.int64()),  # ids of the file before the block
        ("n_tokens", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int64())),
        ("ids", pa.binary()),
    ]
)
_TOKENS_DDL = (
    "file int, block bigint, at bigint, n_tokens bigint, doc_ids array<bigint>, lengths array<bigint>, ids binary"
)
_BLOCKS_DDL = _TOKENS_DDL.replace("ids binary", "crc32 bigint, coded binary")
_BLOCKS = pa.schema([*list(_TOKENS)[:-1], ("crc32", pa.int64()), ("coded", pa.binary())])


def _narrow(ids: np.ndarray) -> np.ndarray:
    """In 16 bits where all ids of the block fit, else in 32; the number of ids tells which."""
    return ids.astype("<u2") if ids.max(initial=0) < 1 << 16 else ids.astype("<u4")


def _wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4")


def _token_blocks(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    encoder, end = library_encoder(path), np.array([end_id], "<u4").tobytes()

    def blocks():
        file = TaskContext.get().partitionId()
        number, at, total, doc_ids, held = 0, 0, 0, [], []

        def block():
            return {
                "file": file,
                "block": number,
                "at": at,
                "n_tokens": total,
                "doc_ids": doc_ids,
                "lengths": [len(h) // 4 for h in held],
                "ids": _narrow(np.frombuffer(b"".join(held), "<u4")).tobytes(),
            }

        for batch in batches:
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), encoder.many(batch.column("text")), strict=True):
                data += end
                doc_ids.append(doc_id)
                held.append(data)
                total += len(data) // 4
                if total >= BLOCK_TOKENS:
                    yield block()
                    number, at, total, doc_ids, held = number + 1, at + total, 0, [], []
        if held:
            yield block()

    yield from slices(blocks(), _TOKENS, size=lambda row: len(row["ids"]))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(0, np.int64)
    for batch in batches:
        for data, n in zip(batch.column("ids").to_pylist(), batch.column("n_tokens").to_pylist(), strict=True):
            more = np.bincount(_wide(data, n))
            if len(more) > len(counts):
                counts, more = more, counts
            counts[: len(more)] += more
    seen = np.flatnonzero(counts)
    yield pa.RecordBatch.from_pydict({"id": pa.array(seen, pa.int64()), "n": pa.array(counts[seen], pa.int64())})


def write_tokens(docs: DataFrame, scratch: Scratch, path: str, end_id: int) -> tuple[DataFrame, DataFrame]:
    """Write the ids of all texts in ascending doc_id order; returns the tables of blocks and of frequencies.

    A null or empty text has the end id alone. Documents of a null doc_id come last; repeated rows are repeated. A
    document is never cut: one longer than a block makes its block longer. Other columns are left out. An empty table
    gives no block. The frequency table has a row for each id that occurs, so its size is that of the vocabulary at most.
    """
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange(F.col("doc_id").asc_nulls_last())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_last())
    )
    tokens = scratch.table(ordered.mapInArrow(lambda it: _token_blocks(it, path, end_id), _TOKENS_DDL), "tokens")
    counts = tokens.select("n_tokens", "ids").mapInArrow(_counted, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    frequencies = scratch.table(counts.coalesce(1), "frequencies")
    table = {r.id: r.n for r in frequencies.collect()}

    def run(batches):
        own = Table(list(table), list(table.values()))

        def blocks():
            for batch in batches:
                for row in batch.to_pylist():
                    coded = own.encode(_wide(row.pop("ids"), row["n_tokens"]))
                    yield row | {"crc32": zlib.crc32(coded), "coded": coded}

        yield from slices(blocks(), _BLOCKS, size=lambda row: len(row["coded"]))

    blocks = scratch.table(tokens.mapInArrow(run, _BLOCKS_DDL), "blocks")
    scratch.drop(tokens)
    return blocks, frequencies


def read_tokens(blocks: DataFrame, frequencies: DataFrame) -> DataFrame:
    """doc_id, ``start`` (ids of all documents before it) and ``ids`` (little-endian unsigned 32-bit) from the files.

    Every block is checked against its checksum, and its lanes must end in the state they began in.
    """
    table = {r.id: r.n for r in frequencies.collect()}
    # One number for each file: as many as the writing job had tasks.
    totals = sorted(blocks.groupBy("file").agg(F.sum("n_tokens").alias("n")).collect())
    ends = np.cumsum([t.n for t in totals]).tolist()
    starts = {t.file: end - t.n for t, end in zip(totals, ends, strict=True)}
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        own = Table(list(table), list(table.values()))

        def rows():
            for batch in batches:
                for row in batch.to_pylist():
                    if zlib.crc32(row["coded"]) != row["crc32"]:
                        raise ValueError(f"block {row['block']} of file {row['file']} is damaged")
                    data, at = own.decode(row["coded"]).astype("<u4").tobytes(), 0
                    first = starts[row["file"]] + row["at"]
                    for doc_id, length in zip(row["doc_ids"], row["lengths"], strict=True):
                        yield {"doc_id": doc_id, "start": first + at, "ids": data[4 * at : 4 * (at + length)]}
                        at += length

        yield from slices(rows(), schema, size=lambda row: len(row["ids"]))

    return blocks.mapInArrow(run, "doc_id bigint, start bigint, ids binary")


def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents as ids, read the files back and give a digest of each document's ids."""
    path = public_tokenizers.path("word_bpe_49k.json")
    back = read_tokens(*write_tokens(documents(spark, sf_dir), Scratch(spark), path, end_id=1))
    return back.select(
        "doc_id",
        "start",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )
