"""As-of join: to each left row the latest right row of the same key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querygavel.functions.text import quoted
from querygavel.session import scratch_path

LEFT, RIGHT = 1, 0
#: What a row of a merged range is: a left row, one that may find its match in a range before, and the range's edges.
DONE, OPEN, START, END = 0, 1, 2, 3


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: str,
    ts: str,
    payload: list[str],
    buckets: int | None = None,
) -> DataFrame:
    """Left rows plus the payload of the last right row with the same ``by`` and ``ts`` at
    or before the left one; NULL where there is none.

    Among right rows of one key and time the greatest payload wins. Both sides are read once
    and dealt to ranges of (key, time), ``buckets`` of them or as many as Spark's shuffles
    have. Each range is merged in order. What a range ends with is handed to the next ones:
    only the first key of a range can have begun before it, so that is one row a range.
    Neither a key with many rows nor many rows at one time gather in one task. The merged
    rows are written to the shared folder.
    """
    spark = left.sparkSession
    found = F.struct(*[F.col(quoted(name)) for name in payload])
    row = F.struct(*[F.col(quoted(name)) for name in left.columns])
    rights = right.where(F.col(by).isNotNull() & F.col(ts).isNotNull()).select(
        F.col(by).alias("key"), F.col(ts).alias("at"), F.lit(RIGHT).alias("side"), found.alias("found")
    )
    lefts = left.select(F.col(by).alias("key"), F.col(ts).alias("at"), F.lit(LEFT).alias("side"), row.alias("row"))
    points = lefts.unionByName(rights, allowMissingColumns=True).withColumn("number", F.monotonically_increasing_id())
    order = ["key", "at", "side", "found", "number"]
    dealt = points.repartitionByRange(*order) if buckets is None else points.repartitionByRange(buckets, *order)
    merged = T.StructType(
        [
            T.StructField("range", T.IntegerType()),
            T.StructField("kind", T.IntegerType()),
            points.schema["key"],
            points.schema["row"],
            T.StructField("matched", T.BooleanType()),
            points.schema["found"],
        ]
    )
    place = scratch_path(spark, "asof")
    dealt.sortWithinPartitions(*order).select("key", "side", "row", "found").mapInArrow(_merged, merged).write.parquet(place)
    written = spark.read.schema(merged).parquet(place)

    before = Window.partitionBy("key").orderBy("range", "kind")
    handed = (
        written.where(F.col("kind") >= START)
        .withColumn("last", F.last(F.when(F.col("matched"), F.struct("found")), ignorenulls=True).over(before))
        .where((F.col("kind") == START) & F.col("last").isNotNull())
        .select(F.col("range").alias("from_range"), F.col("last.found").alias("handed"))
    )
    rows = written.where(F.col("kind") <= OPEN).withColumn("open", F.when(F.col("kind") == OPEN, F.col("range")))
    solved = rows.join(handed, F.col("open") == F.col("from_range"), "left")
    match = F.when(F.col("matched"), F.col("found")).otherwise(F.col("handed"))
    return solved.select(
        *[F.col("row")[name].alias(name) for name in left.columns], *[match[name].alias(name) for name in payload]
    )


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Left rows of one range with the last right row of their key in it, and the edges of the range.

    Rows come by (key, time), right ones first.
    """
    here, key, carried, in_first = TaskContext.get().partitionId(), None, None, True
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys, side, found = batch.column("key"), batch.column("side").to_numpy(), batch.column("found")
        codes = keys.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        place = np.arange(n)
        begins = np.concatenate([[True], codes[1:] != codes[:-1]])
        run = np.maximum.accumulate(np.where(begins, place, 0))
        if key is None:
            yield _edge(here, START, batch, keys.slice(0, 1), None)
            goes_on = True
        else:
            both = pa.concat_arrays([key, keys.slice(0, 1)]).dictionary_encode().indices.fill_null(-1)
            goes_on = both[0] == both[1]
            if not goes_on:
                carried, in_first = None, False
        last = np.maximum.accumulate(np.where(side == RIGHT, place, -1))
        known = last >= run
        if carried is not None:
            found = pa.concat_arrays([found, carried])
            last = np.where(~known & (run == 0), n, last)
            known = known | (run == 0)
        is_left = side == LEFT
        mask = pa.array(is_left)
        kind = np.where(~known & (run == 0) & in_first, OPEN, DONE).astype(np.int32)[is_left]
        at = pa.array(np.where(known, last, 0)[is_left], mask=~known[is_left])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(kind), here, np.int32)),
                pa.array(kind),
                keys.filter(mask),
                batch.column("row").filter(mask),
                pa.array(known[is_left]),
                found.take(at),
            ],
            names=_NAMES,
        )
        key, end = keys.slice(n - 1, 1), int(last[-1])
        carried = found.slice(end, 1) if known[-1] else None
        in_first = in_first and run[-1] == 0
    if key is not None:
        yield _edge(here, END, batch, key, carried)


_NAMES = ["range", "kind", "key", "row", "matched", "found"]


def _edge(here: int, kind: int, batch: pa.RecordBatch, key: pa.Array, found: pa.Array | None) -> pa.RecordBatch:
    known = found is not None
    columns = [
        pa.array([here], pa.int32()),
        pa.array([kind], pa.int32()),
        key,
        pa.nulls(1, batch.schema.field("row").type),
        pa.array([known]),
        found if known else pa.nulls(1, batch.schema.field("found").type),
    ]
    return pa.RecordBatch.from_arrays(columns, names=_NAMES)
