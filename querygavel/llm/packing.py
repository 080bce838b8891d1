"""Packing documents into sequences by a configuration linear program over the histogram of lengths.

Only the histogram reaches the driver: as many numbers as a sequence has tokens. There, multiplicative weights choose
fillings (configurations) of a sequence, each found by a knapsack dynamic program over the current weights; the
fractional numbers of fillings are rounded down, and what is left over is packed by best fit. Documents then learn their
place from their length and their number among the pieces of that length.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querygavel.llm.common import Scratch, documents, frugal, slices
from querygavel.llm.library_tokens import library_encoder
from querygavel.llm.pretokens import MEMO_BYTES

CAPACITY = 2048
#: Dynamic programs for each linear program, the share of a length that one may cover, the fall of a covered length's
#: weight, and how often the rest is solved anew.
ROUNDS, STEP, RATE, PASSES = 80, 0.125, 2.0, 3


class Layout:
    """Sequences as runs of equal fillings; knows where the k-th piece of a length goes."""

    def __init__(self, capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.used: dict[int, int] = defaultdict(int)
        self.runs: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)

    def add(self, filling: list[tuple[int, int]], times: int) -> None:
        """``times`` sequences of (length, how many) each."""
        at = 0
        for length, many in filling:
            self.runs[length].append((self.used[length], self.sequences, many, at))
            self.used[length] += times * many
            at += length * many
        if at > self.capacity:
            raise ValueError("a filling is too long")
        self.sequences += times

    def frozen(self) -> dict[int, tuple[np.ndarray, ...]]:
        return {length: tuple(np.array(runs, np.int64).T) for length, runs in self.runs.items()}


def places(frozen: dict[int, tuple[np.ndarray, ...]], length: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of the k-th piece of each length."""
    sequence, offset = np.empty(len(k), np.int64), np.empty(len(k), np.int64)
    for one in np.unique(length):
        first, base, many, at = frozen[int(one)]
        here = np.flatnonzero(length == one)
        run = np.searchsorted(first, k[here], "right") - 1
        within = k[here] - first[run]
        sequence[here] = base[run] + within // many[run]
        offset[here] = at[run] + within % many[run] * one
    return sequence, offset


def _knapsack(value: np.ndarray, capacity: int) -> np.ndarray:
    """best[c]: the largest value of pieces of total length c at most, of any number of each."""
    best = np.zeros(capacity + 1)
    for c in range(1, capacity + 1):
        found = best[c - 1 :: -1] + value[1 : c + 1] if c > 1 else best[:1] + value[1:2]
        best[c] = max(found.max(), best[c - 1])
    return best


def _filling(best: np.ndarray, value: np.ndarray, left: np.ndarray, first: int, capacity: int) -> tuple[tuple[int, int], ...]:
    """The heaviest filling with a piece of length ``first``, of pieces that are there: at most left[l] of length l.

    Follows the program, but where a length is used up, the best of the others takes its place.
    """
    counts, room, worth = {first: 1}, capacity - first, value.copy()
    if left[first] <= 1:
        worth[first] = -np.inf
    while room > 0:
        found = worth[1 : room + 1] + best[room - 1 :: -1] if room > 1 else worth[1:2] + best[:1]
        i = int(found.argmax())
        if found[i] == -np.inf:
            break
        counts[i + 1] = counts.get(i + 1, 0) + 1
        if counts[i + 1] >= left[i + 1]:
            worth[i + 1] = -np.inf
        room -= i + 1
    return tuple(sorted(counts.items(), reverse=True))


def configuration_lp(counts: np.ndarray, capacity: int) -> dict[tuple, float]:
    """Fractional numbers of fillings that cover the counts approximately.

    The weight of a length falls exponentially with the share of its pieces that is covered. A dynamic program gives, for
    each length, the heaviest filling with a piece of that length; the heaviest of these are each taken a little.
    """
    present = np.flatnonzero(counts)
    want = counts[present].astype(np.float64)
    covered = np.zeros(len(present))
    at = {int(length): i for i, length in enumerate(present)}
    amounts: dict[tuple, float] = defaultdict(float)
    for _ in range(ROUNDS):
        share = covered / want
        if share.min() > 0.999:
            break
        # Nothing is covered twice, and no length by more than a small share before weights are set anew.
        room = np.minimum(np.maximum(1.0, STEP * want), want - covered)
        rest = np.zeros(capacity + 1)
        rest[present] = np.ceil(want - covered)
        weight = np.where(room > 0, np.exp(-RATE * (share - share.min())) * present, -np.inf)
        value = np.full(capacity + 1, -np.inf)
        value[present] = weight
        best = _knapsack(value, capacity)
        total = weight + best[capacity - present]
        for i in np.argsort(-total, kind="stable"):
            if total[i] < 0.8 * total.max():
                break
            if room[i] <= 0:
                continue
            filling = _filling(best, value, rest, int(present[i]), capacity)
            take = int(min(room[at[length]] / many for length, many in filling))
            if take < 1:
                continue
            amounts[filling] += take
            for length, many in filling:
                covered[at[length]] += take * many
                room[at[length]] -= take * many
    return amounts


def solve(counts: np.ndarray, capacity: int = CAPACITY) -> Layout:
    """A layout of all pieces; ``counts[l]`` is how many pieces have length l, up to the capacity.

    The linear program runs at every size, and anew for what rounding down left. What is left after that goes, length by
    length, where it leaves least room, the room in the program's own fillings included.
    """
    left = counts.astype(np.int64).copy()
    fillings: dict[tuple[tuple[int, int], ...], int] = defaultdict(int)
    if left[capacity]:
        fillings[((capacity, 1),)] = int(left[capacity])
        left[capacity] = 0
    for _ in range(PASSES):
        before = int(left.sum())
        if not before:
            break
        for filling, x in sorted(configuration_lp(left, capacity).items(), key=lambda item: (-item[1], item[0])):
            times = min(int(x), min(int(left[length]) // many for length, many in filling))
            if times:
                fillings[filling] += times
                for length, many in filling:
                    left[length] -= times * many
        if left.sum() > 0.5 * before:
            break
    layout = Layout(capacity)
    for filling, times in _best_fit(fillings, left, capacity).items():
        layout.add(list(filling), times)
    return layout


def _best_fit(fillings: dict[tuple, int], left: np.ndarray, capacity: int) -> dict[tuple, int]:
    """Fillings with all that is left: from the longest piece down, each into the sequence that it leaves least room in.

    Sequences of equal content are one entry and take equal pieces together, so the steps grow with the lengths and
    fillings there are and not with the pieces.
    """
    by_room: dict[int, dict[tuple, int]] = defaultdict(dict)
    rooms = 0  # bit r: some sequence has room r
    room_of = lambda filling: capacity - sum(length * many for length, many in filling)
    for filling, times in fillings.items():
        by_room[room_of(filling)][filling] = times
        rooms |= 1 << room_of(filling)
    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            fitting = rooms >> length
            room = length + (fitting & -fitting).bit_length() - 1 if fitting else capacity
            filling, times = by_room[room].popitem() if fitting else ((), n)
            # A sequence that fits best is the best for the next equal piece too, until it is full.
            many = min(n, room // length)
            taking = min(times, n // many)
            if fitting and times > taking:
                by_room[room][filling] = times - taking
            if not by_room[room]:
                rooms &= ~(1 << room)
            counts = dict(filling)
            counts[length] = counts.get(length, 0) + many
            filled = tuple(sorted(counts.items(), reverse=True))
            n -= taking * many
            by_room[room - many * length][filled] = by_room[room - many * length].get(filled, 0) + taking
            rooms |= 1 << (room - many * length)
    return {filling: times for same in by_room.values() for filling, times in same.items()}


_PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids", pa.binary()),
        ("task", pa.int32()),
        ("number", pa.int64()),
    ]
)
_PIECES_DDL = "doc_id bigint, piece int, start bigint, length bigint, ids binary, task int, number bigint"


def _cut(
    batches: Iterator[pa.RecordBatch], path: str, end_id: int, capacity: int, memo_bytes: int = MEMO_BYTES
) -> Iterator[pa.RecordBatch]:
    """Pieces of documents, numbered within their task among those of the same length."""
    encoder, end = library_encoder(path, most_bytes=memo_bytes), np.array([end_id], "<u4").tobytes()

    def rows():
        task, seen = TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.many(batch.column("text")), strict=True):
                ids += end
                n = len(ids) // 4
                stop = (n - 1) % capacity + 1
                start = piece = 0
                while start < n:
                    length = stop - start
                    data = ids[4 * start : 4 * stop]
                    number = seen[length]
                    yield dict(zip(_PIECES.names, (doc_id, piece, start, length, data, task, number), strict=True))
                    seen[length] += 1
                    start, stop, piece = stop, stop + capacity, piece + 1

    yield from slices(rows(), _PIECES, size=lambda row: len(row["ids"]))


def pack(
    docs: DataFrame,
    scratch: Scratch,
    path: str,
    end_id: int,
    keep: dict[str, Column] | None = None,
    capacity: int = CAPACITY,
    memo_bytes: int = MEMO_BYTES,
) -> DataFrame:
    """doc_id, piece, start, length, what ``keep`` makes of the ids, sequence_id and offset, one row for each piece.

    A document is its ids and the end id; a null or empty text is the end id alone. Only documents longer than a sequence
    are cut, into full pieces after a first one that may be shorter. ``keep`` is evaluated where the ids stand (by default
    it is the ids, little-endian unsigned 32-bit). Repeated rows are packed each; null doc_ids stay null; other columns
    are left out; an empty table gives no rows.

    Pieces are numbered by task and length, and a table of counts for each task and length tells how many came before:
    no length, however common, is gathered anywhere. ``memo_bytes`` bounds each of the two memories of a worker's encoder;
    it changes time and memory, never the rows.
    """
    keep = keep or {"ids": F.col("ids")}
    pieces = scratch.table(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
            frugal(lambda it: _cut(it, path, end_id, capacity, memo_bytes), keeps="library_encoder"), _PIECES_DDL
        ),
        "pieces",
        codec="zstd",
    )
    by_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r.length] = r.n
    frozen = solve(counts, capacity).frozen()
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    known = ["doc_id", "piece", "start", "length", *keep]
    numbered = (
        pieces.select("doc_id", "piece", "start", "length", "task", "number", *[c.alias(n) for n, c in keep.items()])
        .join(firsts, ["length", "task"])
        .select(*known, (F.col("first") + F.col("number")).alias("k"))
    )

    def placed(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            sequence, offset = places(frozen, batch.column("length").to_numpy(), batch.column("k").to_numpy())
            table = table.drop_columns(["k"]).append_column("sequence_id", pa.array(sequence))
            yield from table.append_column("offset", pa.array(offset)).to_batches()

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema if f.name != "k")
    return numbered.mapInArrow(placed, f"{kinds}, sequence_id bigint, offset bigint")


def packed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents; a digest of each piece's ids."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return pack(documents(spark, sf_dir), Scratch(spark), path, 0, {"ids_crc32": F.crc32("ids")})
