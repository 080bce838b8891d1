"""Byte-level BPE by two tiers: a perfect hash for whole pre-tokens, a heap over linked bytes for the rest."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querygavel.llm.common import documents, slices, strings
from querygavel.llm.perfect_hash import PerfectHash
from querygavel.llm.pretokens import StretchEncoder, le_ids


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a rank file; a token's id is its rank."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class Codec:
    """Encodes pre-tokens and decodes ids by one rank file."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.whole = PerfectHash(ranks)
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def pretoken(self, data: bytes) -> list[int]:
        found = self.whole.get(data)
        return [found] if found >= 0 else self.merged(data)

    def merged(self, data: bytes) -> list[int]:
        """Join neighbours of the least rank, leftmost first, until none is in the vocabulary.

        A part is known by its first byte; ``end`` tells where it ends, and so where the next one begins. An entry
        of the heap is stale unless its two parts still reach from its start to its end.
        """
        n, rank = len(data), self.ranks.get
        end = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(data[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            middle = end[i]
            if not alive[i] or middle >= n or end[middle] != stop:
                continue
            alive[middle] = False
            end[i] = stop
            if stop < n:
                before[stop] = i
                if (r := rank(data[i : end[stop]])) is not None:
                    heappush(heap, (r, i, end[stop]))
            left = before[i]
            if left >= 0 and (r := rank(data[left:stop])) is not None:
                heappush(heap, (r, left, stop))
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[data[i : end[i]]])
            i = end[i]
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(read_ranks(path))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> StretchEncoder:
    if pattern != public_tokenizers.PATTERN:
        raise ValueError("texts are cut into stretches that only the public pattern keeps apart; other patterns are not taken")
    own = codec(path)
    return StretchEncoder(
        lambda piece: le_ids(own.pretoken(piece.encode("utf-8"))), regex.compile(pattern).findall
    )


_ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])


def encoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    encode = encoder(path, pattern)
    for batch in batches:
        rows = zip(batch.column("doc_id").to_pylist(), strings(batch, "text"), strict=True)
        yield from slices(
            ({"doc_id": d, "ids": encode(t or "")} for d, t in rows), _ENCODED, size=lambda row: len(row["ids"])
        )


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id and ``ids``, the ids of the whole text as little-endian unsigned 32-bit integers.

    Each match of the pattern is encoded by itself, without special tokens. A null or empty text has no ids. Rows stay
    as they are: repeated rows give repeated results, null doc_ids stay null, other columns are left out.
    """
    return docs.select("doc_id", "text").mapInArrow(lambda it: encoded(it, path, pattern), "doc_id bigint, ids binary")


def decode(ids: DataFrame, path: str) -> DataFrame:
    """doc_id and ``data``, the bytes that the ids stand for; null ids give no bytes."""

    def run(batches):
        own = codec(path)
        schema = pa.schema([("doc_id", pa.int64()), ("data", pa.binary())])
        for batch in batches:
            rows = zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True)
            yield from slices(
                ({"doc_id": d, "data": own.decode(np.frombuffer(i or b"", "<u4").tolist())} for d, i in rows),
                schema,
                size=lambda row: len(row["data"]),
            )

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, data binary")


_DIGESTS = pa.schema(
    [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
)


def round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every text of documents and decode the ids; digests of both, worked out where the ids are."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN

    def run(batches):
        own = codec(path)
        shown = [b"%d" % i for i in range(len(own.tokens))]
        for batch in encoded(batches, path, pattern):
            out = []
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                ids = np.frombuffer(data, "<u4").tolist()
                out.append(
                    {
                        "doc_id": doc_id,
                        "n_tokens": len(ids),
                        "ids_sha256": hashlib.sha256(b" ".join(map(shown.__getitem__, ids))).hexdigest(),
                        "decoded_sha256": hashlib.sha256(own.decode(ids)).hexdigest(),
                    }
                )
            yield pa.RecordBatch.from_pylist(out, schema=_DIGESTS)

    return (
        documents(spark, sf_dir)
        .select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    )
