"""Exact deduplication by Grace hashing: records dealt to files by their hash, then one open-addressing table a file."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querygavel.llm.common import Scratch, documents, frugal, slices, strings

#: Bytes of different contents that one table may hold.
TABLE_BYTES = 32 << 20
_TO_SPACE = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
_RUN = re.compile(rb"  +")


def normal_bytes(text: str | None) -> bytes:
    """UTF-8 of the text with each run of [\\x20\\x09-\\x0D] as one space; null counts as empty."""
    data = (text or "").encode("utf-8").translate(_TO_SPACE)
    return _RUN.sub(b" ", data) if b"  " in data else data


class OpenTable:
    """Contents by linear probing; equal means equal in every byte, whatever the hashes say."""

    def __init__(self):
        self.slots = [-1] * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def find(self, hashed: int, content: bytes) -> tuple[int, bool]:
        """The number of the content, and whether it is new."""
        mask = len(self.slots) - 1
        at = hashed & mask
        while (number := self.slots[at]) >= 0:
            if self.hashes[number] == hashed and self.contents[number] == content:
                return number, False
            at = (at + 1) & mask
        number = self.slots[at] = len(self.contents)
        self.hashes.append(hashed)
        self.contents.append(content)
        self.bytes += len(content)
        if 2 * len(self.contents) > len(self.slots):
            self._grow()
        return number, True

    def _grow(self) -> None:
        mask = 4 * len(self.slots) - 1
        self.slots = [-1] * (mask + 1)
        for number, hashed in enumerate(self.hashes):
            at = hashed & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = number


_LOCAL = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("row", pa.int64()),
        ("rep", pa.int64()),
        ("hash", pa.int64()),
        ("n_bytes", pa.int64()),
        ("content", pa.binary()),
    ]
)
_LOCAL_DDL = "doc_id bigint, row bigint, rep bigint, hash bigint, n_bytes bigint, content binary"


def _collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of a task; only the first row of each content in a bounded table carries the content on."""

    def rows():
        row = TaskContext.get().partitionId() << 40
        table, reps = OpenTable(), []
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), strings(batch, "text"), strict=True):
                if table.bytes > TABLE_BYTES:
                    table, reps = OpenTable(), []
                content = normal_bytes(text)
                hashed = xxhash.xxh3_64_intdigest(content)
                number, new = table.find(hashed, content)
                if new:
                    reps.append(row)
                yield {
                    "doc_id": doc_id,
                    "row": row,
                    "rep": reps[number],
                    "hash": hashed - (1 << 63),
                    "n_bytes": len(content),
                    "content": content if new else None,
                }
                row += 1

    yield from slices(rows(), _LOCAL, size=lambda r: len(r["content"] or b"") + 48)


def _leaf(reps: DataFrame, table_bytes: int) -> Column:
    """The file of a record: the shortest prefix of its hash whose contents fit one table.

    Starts with enough prefixes for the whole input; those that hold too much are cut by four more bits, again and
    again. A single hash cannot be cut further, and needs no cut: it is one content, or a few that collide.
    """
    sizes = reps.groupBy("hash").agg(F.max("n_bytes").alias("n_bytes"))
    total = sizes.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    tasks = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = max(1, (2 * total // table_bytes).bit_length(), (2 * tasks).bit_length())
    prefix = lambda b: F.shiftrightunsigned("hash", 64 - b)
    leaf = F.concat_ws("/", F.lit(bits), prefix(bits))
    full = sizes
    while bits < 60:
        full = full.withColumn("p", prefix(bits))
        over = full.groupBy("p").agg(F.sum("n_bytes").alias("n")).where(F.col("n") > table_bytes)
        held = [r.p for r in over.select("p").collect()]
        if not held:
            break
        inside = prefix(bits).isin(held)
        full = full.where(inside)
        bits += 4
        leaf = F.when(inside, F.concat_ws("/", F.lit(bits), prefix(bits))).otherwise(leaf)
    return leaf


_FOUND = pa.schema([("rep", pa.int64()), ("group", pa.int64()), ("text_sha256", pa.string())])


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One table for each file, one file after the other; a group is known by the first record met."""

    def rows():
        leaf, table, firsts, digests = None, OpenTable(), [], []
        for batch in batches:
            for r in batch.to_pylist():
                if r["leaf"] != leaf:
                    leaf, table, firsts, digests = r["leaf"], OpenTable(), [], []
                number, new = table.find(r["hash"] + (1 << 63), r["content"])
                if new:
                    firsts.append(r["rep"])
                    digests.append(hashlib.sha256(r["content"]).hexdigest())
                yield {"rep": r["rep"], "group": firsts[number], "text_sha256": digests[number]}

    yield from slices(rows(), _FOUND, size=lambda r: 96)


def exact_groups(docs: DataFrame, scratch: Scratch, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are after each run of white space has become one space; null counts as empty, and
    all empty texts are one group. The row of the smallest doc_id stays (null is the largest); of rows with the same
    doc_id, one does. keep_id is null when a group has null doc_ids only. An empty table gives no rows; other columns
    are left out.

    Contents travel once for each task that holds them, so a group of any size costs its file one record a task, and no
    file is read by a task whole: records are compared as they come.
    """
    local = scratch.table(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(frugal(_collapsed), _LOCAL_DDL), "collapsed"
    )
    reps = local.where("content IS NOT NULL").select("rep", "hash", "n_bytes", "content")
    found = scratch.table(
        reps.select("rep", "hash", "content", _leaf(reps.drop("content"), table_bytes).alias("leaf"))
        .repartition("leaf")
        .sortWithinPartitions("leaf")
        .mapInArrow(frugal(_grouped), "rep bigint, group bigint, text_sha256 string"),
        "groups",
    )
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    by_rep = local.groupBy("rep").agg(first, F.count(F.lit(1)).alias("n")).join(found, "rep")
    groups = by_rep.groupBy("group").agg(F.min("first").alias("first"), F.sum("n").alias("group_size"))
    resolved = by_rep.select("rep", "group", "text_sha256").join(groups, "group")
    return (
        local.select("doc_id", "row", "rep")
        .join(resolved, "rep")
        .select(
            "doc_id",
            F.col("first.doc_id").alias("keep_id"),
            "group_size",
            (F.col("row") == F.col("first.row")).alias("kept"),
            "text_sha256",
            "row",
        )
    )


def exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir), Scratch(spark)).drop("row")


EXACT_SQL = r"""
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
WINDOW same AS (PARTITION BY t)
"""
