"""Rows dealt to ranges of (key, order): numbers and moving means of runs of any length, without a window per run."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querygavel.functions.text import quoted
from querygavel.session import scratch_path

#: What a row of a range is: solved, one whose run may have begun in a range before, and the range's edges.
DONE, OPEN, START, END = 0, 1, 2, 3


def numbered(df: DataFrame, by: str, order: Sequence[Column], place: str, ranges: int | None = None) -> DataFrame:
    """Add ``place``, the number from 1 of a row in its run, by ascending ``order``, NULLs last.

    Rows are dealt once to ranges of (``by``, ``order``), ``ranges`` of them or as many as Spark's
    shuffles have, and numbered there. Only the first run of a range can have begun before
    it, so one offset a range is added afterwards. Neither a long run nor many equal rows gather in one
    task; rows that are equal in all of ``order`` keep the order of the input.
    """
    points, sort = _points(df, by, order)
    written = _write(points, sort, ("key", "row"), _numbers, T.StructField("at", T.LongType()), ranges)
    before = Window.partitionBy("key").orderBy("range", "kind")
    offsets = (
        written.where(F.col("kind") >= START)
        .withColumn("before", F.sum(F.when(F.col("kind") == END, F.col("at"))).over(before))
        .where((F.col("kind") == START) & F.col("before").isNotNull())
        .select(F.col("range").alias("from_range"), "before")
    )
    joined = _with_edges(written, offsets)
    return joined.select(
        *[F.col("row")[name].alias(name) for name in df.columns],
        (F.col("at") + F.coalesce("before", F.lit(0))).alias(place),
    )


def moving_means(
    df: DataFrame, by: str, order: Sequence[Column], value: str, lines: int, name: str, ranges: int | None = None
) -> DataFrame:
    """Add ``name``, the mean of ``value`` over this and the ``lines - 1`` preceding rows of the run; NULLs do not count.

    As with numbers, rows are dealt once; the last rows of a range are handed on, ``lines - 1``
    values at most, since nothing further back counts.
    """
    points, sort = _points(df, by, order)
    points = points.withColumn("value", F.col("row")[value].cast("double"))
    parts = T.StructType().add("total", "double").add("n", "long").add("lacks", "integer").add("tail", T.ArrayType(T.DoubleType()))
    written = _write(points, sort, ("key", "row", "value"), partial(_sums, lines), T.StructField("at", parts), ranges)
    # Every range before holds at least one line of the run, so this frame reaches back far enough.
    before = Window.partitionBy("key").orderBy("range", "kind").rowsBetween(-2 * lines, -1)
    tails = (
        written.where(F.col("kind") >= START)
        .withColumn("tails", F.flatten(F.collect_list("at.tail").over(before)))
        .where((F.col("kind") == START) & (F.size("tails") > 0))
        .select(F.col("range").alias("from_range"), "tails")
    )
    joined = _with_edges(written, tails)
    used = F.least(F.col("at.lacks"), F.size("tails"))
    reach = F.when(used > 0, F.filter(F.slice("tails", -used, used), lambda x: x.isNotNull()))
    total = F.col("at.total") + F.coalesce(F.aggregate(reach, F.lit(0.0), lambda a, x: a + x), F.lit(0.0))
    n = F.col("at.n") + F.coalesce(F.size(reach), F.lit(0))
    return joined.select(
        *[F.col("row")[column].alias(column) for column in df.columns], F.when(n > 0, total / n).alias(name)
    )


def _points(df: DataFrame, by: str, order: Sequence[Column]) -> tuple[DataFrame, list[Column]]:
    points = df.select(
        F.col(quoted(by)).alias("key"),
        F.struct(*[F.col(quoted(name)) for name in df.columns]).alias("row"),
        *[one.alias(f"o{i}") for i, one in enumerate(order)],
        F.monotonically_increasing_id().alias("number"),
    )
    return points, [F.col("key"), *[F.col(f"o{i}").asc_nulls_last() for i in range(len(order))], F.col("number")]


def _write(points: DataFrame, sort: list[Column], columns, solve, found: T.StructField, ranges: int | None) -> DataFrame:
    dealt = points.repartitionByRange(*sort) if ranges is None else points.repartitionByRange(ranges, *sort)
    # Edges have no row, so rows may be NULL here whatever they were.
    kinds = {name: points.schema[name].dataType for name in ("key", "row")}
    schema = T.StructType().add("range", "integer").add("kind", "integer").add("key", kinds["key"]).add("row", kinds["row"]).add(found)
    place = scratch_path(points.sparkSession, "ranges")
    dealt.sortWithinPartitions(*sort).select(*columns).mapInArrow(solve, schema).write.parquet(place)
    return points.sparkSession.read.schema(schema).parquet(place)


def _with_edges(written: DataFrame, handed: DataFrame) -> DataFrame:
    """Solved rows, and open ones with what was handed to their range: one row a range."""
    rows = written.where(F.col("kind") <= OPEN).withColumn("open", F.when(F.col("kind") == OPEN, F.col("range")))
    return rows.join(handed, F.col("open") == F.col("from_range"), "left")


class _Runs:
    """Places of rows in their runs, batch by batch of one range."""

    def __init__(self):
        self.key, self.last, self.in_first = None, -1, True

    def places(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Places from 0 since the run began in this range, and whether it is the first run."""
        codes = keys.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        place = np.arange(len(codes))
        begins = np.concatenate([[True], codes[1:] != codes[:-1]])
        start = np.maximum.accumulate(np.where(begins, place, 0))
        goes_on = True
        if self.key is not None:
            both = pa.concat_arrays([self.key, keys.slice(0, 1)]).dictionary_encode().indices.fill_null(-1)
            goes_on = both[0] == both[1]
        if not goes_on:
            self.last, self.in_first = -1, False
        places = place - start + np.where(start == 0, self.last + 1, 0)
        first = (start == 0) & self.in_first
        self.key, self.last, self.in_first = keys.slice(len(keys) - 1, 1), int(places[-1]), bool(first[-1])
        return places, first


def _batch(kind: np.ndarray, keys: pa.Array, rows: pa.Array, found: pa.Array) -> pa.RecordBatch:
    here = pa.array(np.full(len(kind), TaskContext.get().partitionId(), np.int32))
    kinds = pa.array(kind.astype(np.int32))
    return pa.RecordBatch.from_arrays([here, kinds, keys, rows, found], names=["range", "kind", "key", "row", "at"])


def _edge(kind: int, key: pa.Array, rows: pa.DataType, found: pa.Array) -> pa.RecordBatch:
    return _batch(np.array([kind]), key, pa.nulls(1, rows), found)


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs = _Runs()
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, rows = batch.column("key"), batch.column("row")
        if runs.key is None:
            yield _edge(START, keys.slice(0, 1), rows.type, pa.nulls(1, pa.int64()))
        places, first = runs.places(keys)
        yield _batch(np.where(first, OPEN, DONE), keys, rows, pa.array(places + 1))
    if runs.key is not None:
        yield _edge(END, runs.key, rows.type, pa.array([runs.last + 1], pa.int64()))


def _sums(lines: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs, reach = _Runs(), lines - 1
    tail, known = np.zeros(reach), np.zeros(reach, bool)
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, rows, values = batch.column("key"), batch.column("row"), batch.column("value")
        if runs.key is None:
            yield _edge(START, keys.slice(0, 1), rows.type, _parts([0.0], [0], [0], None))
        places, first = runs.places(keys)
        tail = np.concatenate([tail, values.fill_null(0).to_numpy(zero_copy_only=False)])
        known = np.concatenate([known, values.is_valid().to_numpy(zero_copy_only=False)])
        # Of the lines up to a row, those that are of its run.
        own = np.arange(lines) >= reach - places[:, None]
        seen = own & np.lib.stride_tricks.sliding_window_view(known, lines)
        totals = np.where(seen, np.lib.stride_tricks.sliding_window_view(tail, lines), 0.0).sum(axis=1)
        lacks = np.maximum(reach - places, 0)
        kind = np.where(first & (lacks > 0), OPEN, DONE)
        yield _batch(kind, keys, rows, _parts(totals, seen.sum(axis=1), lacks, None))
        tail, known = tail[len(tail) - reach :], known[len(known) - reach :]
    if runs.key is not None:
        n = min(runs.last + 1, reach)
        last = [float(v) if k else None for v, k in zip(tail[reach - n :], known[reach - n :])]
        yield _edge(END, runs.key, rows.type, _parts([0.0], [0], [0], [last]))


def _parts(total, n, lacks, tail) -> pa.Array:
    lists = pa.list_(pa.float64())
    tails = pa.nulls(len(total), lists) if tail is None else pa.array(tail, lists)
    columns = [pa.array(total, pa.float64()), pa.array(n, pa.int64()), pa.array(lacks, pa.int32()), tails]
    return pa.StructArray.from_arrays(columns, names=["total", "n", "lacks", "tail"])
