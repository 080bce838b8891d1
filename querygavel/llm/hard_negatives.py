"""Hard negatives by segment summaries: means and deviations of stretches of a vector bound its inner products.

For a stretch of L components, a·b = L (mean a · mean b) + the product of what remains, which is at most
L (deviation a · deviation b) in size. Summed over the stretches of a vector this gives a lower and an upper bound of
the whole product. Stretches are halved level by level; candidates whose bounds miss the wanted range fall out, and only
the rest are scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querygavel.llm.common import Scratch
from querygavel.llm.kd_topk import _matrix, _products, integer_vectors

#: Vectors that are held at once, and components of the shortest segment.
SHARD_ROWS = 4096
LEAST_SEGMENT = 4

LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def levels(dim: int) -> list[np.ndarray]:
    """The edges of the segments on each level: one segment, then twice as many each time."""
    out, parts = [np.array([0, dim])], 2
    while dim // parts >= LEAST_SEGMENT:
        out.append(np.arange(parts + 1) * dim // parts)
        parts *= 2
    return out


def summaries(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of every segment of every level, side by side, for rows of vectors."""
    means, deviations = [], []
    whole = vectors.astype(np.float64)
    for edges in levels(vectors.shape[1]):
        size = np.diff(edges)
        mean = np.add.reduceat(whole, edges[:-1], axis=1) / size
        rest = whole - np.repeat(mean, size, axis=1)
        means.append(mean)
        deviations.append(np.sqrt(np.add.reduceat(rest * rest, edges[:-1], axis=1) / size))
    return np.hstack(means), np.hstack(deviations)


class Shard:
    """Vectors of one length with their summaries, searched for one asking vector at a time."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, means: np.ndarray, deviations: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.sizes, self.means, self.deviations, at = [], [], [], 0
        for edges in levels(vectors.shape[1]):
            n = len(edges) - 1
            self.sizes.append(np.diff(edges))
            self.means.append(means[:, at : at + n])
            self.deviations.append(deviations[:, at : at + n])
            at += n
        self.norms = np.sqrt(vectors.shape[1] * (means[:, 0] ** 2 + deviations[:, 0] ** 2))
        self._chosen: dict[tuple[int, bool], np.ndarray] = {}
        self.scored = 0

    def _candidates(self, label: int, same: bool) -> np.ndarray:
        found = self._chosen.get((label, same))
        if found is None:
            found = self._chosen[label, same] = np.flatnonzero((self.labels == label) == same)
        return found

    def search(self, own_id: int, label: int, same: bool, vector, means, deviations, floors: np.ndarray, caps: np.ndarray, k: int):
        """For each range [floor, cap] the k best (score, -vec_id) of the rows of the same, or of other labels.

        On each level, k lower bounds of rows that surely lie in a range raise its floor: fewer cannot be among the best.
        Bounds are widened by more than doubles can be off.
        """
        left = self._candidates(label, same)
        left = left[self.ids[left] != own_id]
        lowest, highest = floors.astype(np.float64), caps.astype(np.float64)
        norm, at = np.sqrt(len(vector) * (means[0] ** 2 + deviations[0] ** 2)), 0
        for size, mean, deviation in zip(self.sizes, self.means, self.deviations, strict=True):
            if not len(left):
                break
            own = slice(at, at + len(size))
            at += len(size)
            middle = mean[left] @ (size * means[own])
            reach = deviation[left] @ (size * deviations[own]) + 1e-9 * norm * self.norms[left] + 1e-3
            low, high = (middle - reach)[:, None], (middle + reach)[:, None]
            if len(left) > k:
                for r in range(len(lowest)):
                    sure = low[(low[:, 0] >= lowest[r]) & (high[:, 0] <= highest[r]), 0]
                    if len(sure) >= k:
                        lowest[r] = np.partition(sure, len(sure) - k)[len(sure) - k]
            left = left[((high >= lowest) & (low <= highest)).any(axis=1)]
        self.scored += len(left)
        scores, ids = _products(self.vectors[left], vector[None, :])[:, 0], self.ids[left]
        out = []
        for floor, cap in zip(floors.tolist(), caps.tolist(), strict=True):
            inside = np.flatnonzero((scores >= floor) & (scores <= cap))
            best = inside[np.lexsort((ids[inside], -scores[inside]))[:k]]
            out.append((ids[best], scores[best]))
        return out


def summarised(vectors: DataFrame) -> DataFrame:
    """``vectors`` (vec_id, label, dim, vec) with the means and deviations of their segments, one row for each vec_id.

    Of rows that share a vec_id, the one with the smallest (label, vec) counts.
    """
    single = vectors.groupBy("vec_id").agg(F.min(F.struct("label", "dim", "vec")).alias("row")).select("vec_id", "row.*")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                means, deviations = summaries(_matrix(part.column("vec")))
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), m.shape[1]) for m in (means, deviations)]
                lists = [one.cast(pa.list_(pa.float64())) for one in lists]
                yield pa.RecordBatch.from_arrays([*part.columns, *lists], [*part.schema.names, "means", "deviations"])

    shape = "vec_id bigint, label bigint, dim int, vec array<bigint>, means array<double>, deviations array<double>"
    return single.mapInArrow(add, shape)


def search(table: DataFrame, asked: DataFrame, scratch: Scratch, shards: int, same: bool, k: int) -> DataFrame:
    """vec_id, key, rank, found_id, score: for each range of each asking row the k best rows of the same, or another label.

    ``asked`` are rows of ``table`` with ``ranges``, an array of ``key, floor, cap``. Ties go to the smaller id. A row
    first asks its own shard; the kth scores found there go along to the others as floors. A shard's vectors are read by
    one task once, and rows that ask stream past them, so no more than a shard is held.
    """
    fields = ["dim", "shard", "kind", "vec_id", "label", "vec", "means", "deviations", "ranges"]
    shard_of = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    held = table.withColumns(
        {"shard": shard_of, "kind": F.lit(0), "ranges": F.lit(None).cast("array<struct<key:bigint,floor:bigint,cap:bigint>>")}
    )

    def scan(asks: DataFrame) -> DataFrame:
        needed = held.join(asks.select("dim", "shard").distinct(), ["dim", "shard"], "left_semi")
        together = needed.select(*fields).unionByName(asks.withColumn("kind", F.lit(1)).select(*fields))
        dealt = together.repartition("dim", "shard").sortWithinPartitions("dim", "shard", "kind", "vec_id")
        return dealt.mapInArrow(lambda batches: _answers(batches, same, k), "vec_id bigint, key bigint, found_id bigint, score bigint")

    home = scratch.table(scan(asked.withColumn("shard", shard_of)), "home-hits")
    if shards > 1:
        kth = home.groupBy("vec_id", "key").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k)
        known = kth.groupBy("vec_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "kth"))).alias("kths"))
        raised = F.transform(
            "ranges",
            lambda r: F.struct(r["key"], F.greatest(r["floor"], F.try_element_at("kths", r["key"])).alias("floor"), r["cap"]),
        )
        others = F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != shard_of)
        away = asked.join(known, "vec_id", "left").withColumns({"ranges": raised, "shard": F.explode(others)})
        home = home.unionByName(scan(away))
    best = Window.partitionBy("vec_id", "key").orderBy(F.desc("score"), "found_id")
    return home.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _answers(batches: Iterator[pa.RecordBatch], same: bool, k: int) -> Iterator[pa.RecordBatch]:
    """Rows come by (dim, shard), first those that are held, then those that ask."""
    parts, here, shard = [], None, None
    for batch in batches:
        kinds = batch.column("kind").to_numpy()
        places = np.stack([batch.column("dim").to_numpy(), batch.column("shard").to_numpy(), kinds], axis=1)
        cuts = np.flatnonzero((places[1:] != places[:-1]).any(axis=1)) + 1
        for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(places)], strict=True):
            if start == end:
                continue
            run, place = batch.slice(start, end - start), tuple(places[start, :2].tolist())
            if place != here:
                here, parts, shard = place, [], None
            columns = [run.column(n).to_numpy() for n in ("vec_id", "label")] + [
                _matrix(run.column(n)) for n in ("vec", "means", "deviations")
            ]
            if kinds[start] == 0:
                parts.append(columns)
                continue
            if shard is None and not parts:
                continue  # no row of this length is in this shard
            if shard is None:
                shard = Shard(*map(np.concatenate, zip(*parts, strict=True)))
                parts = []
            yield _answer(shard, columns, run.column("ranges"), same, k)


def _answer(shard: Shard, columns: list[np.ndarray], ranges: pa.ListArray, same: bool, k: int) -> pa.RecordBatch:
    asking, keys, found, scores = [], [], [], []
    bounds, flat = ranges.offsets.to_numpy(), ranges.values
    key, floor, cap = (flat.field(n).to_numpy() for n in ("key", "floor", "cap"))
    for i, row in enumerate(zip(*columns, strict=True)):
        own = slice(bounds[i], bounds[i + 1])
        own_id, label, vector, means, deviations = row
        for one, (ids, values) in zip(
            key[own], shard.search(own_id, label, same, vector, means, deviations, floor[own], cap[own], k), strict=True
        ):
            asking.append(np.full(len(ids), own_id))
            keys.append(np.full(len(ids), one))
            found.append(ids)
            scores.append(values)
    columns = [pa.array(np.concatenate(c), pa.int64()) if c else pa.array([], pa.int64()) for c in (asking, keys, found, scores)]
    return pa.RecordBatch.from_arrays(columns, ["vec_id", "key", "found_id", "score"])


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    scratch: Scratch,
    positives: int = 5,
    negatives: int = 10,
    percent: tuple[int, int] = (30, 90),
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, label, dim and vec of whole numbers (see ``labelled_vectors``); the rows that ``anchors``
    holds for are the anchors. An anchor's positives are its best other rows of the same label; for each, the negatives
    are the best rows of other labels whose score is between the two percentages of the positive score, both included.
    Ties go to the smaller id; where there are fewer, all are returned, and an anchor or positive without any has no
    row. Only vectors of the same length are compared. Scores must fit 64-bit integers.
    """
    table = scratch.table(summarised(vectors), "summaries")
    shards = max(1, -(-table.count() // SHARD_ROWS))
    asking = table.where(anchors)
    all_scores = F.array(F.struct(F.lit(0).cast("long").alias("key"), F.lit(LOWEST).alias("floor"), F.lit(HIGHEST).alias("cap")))
    best = search(table, asking.withColumn("ranges", all_scores), scratch, shards, True, positives)
    best = scratch.table(best.select("vec_id", F.col("found_id").alias("key"), F.col("score").alias("positive_score")), "positives")
    least, most = (F.lit(p).cast("decimal(3,0)") for p in percent)
    score, hundred = F.col("positive_score").cast("decimal(20,0)"), F.lit(100).cast("decimal(3,0)")
    window = F.struct(
        "key", F.ceil(score * least / hundred).cast("long").alias("floor"), F.floor(score * most / hundred).cast("long").alias("cap")
    )
    wanted = best.select("vec_id", window.alias("range")).where("range.floor <= range.cap")
    ranges = wanted.groupBy("vec_id").agg(F.collect_list("range").alias("ranges"))
    found = search(table, asking.join(ranges, "vec_id"), scratch, shards, False, negatives)
    return found.join(best, ["vec_id", "key"]).select(
        F.col("vec_id").alias("anchor_id"),
        F.col("key").alias("positive_id"),
        "rank",
        F.col("found_id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )


def labelled_vectors(table: DataFrame, label: Column) -> DataFrame:
    """vec_id, label, dim, vec: components x as floor(256 x). Rows without id, label or a whole vector are left out."""
    kept = table.select("vec_id", "embedding", label.cast("long").alias("label")).where("label IS NOT NULL")
    return integer_vectors(kept, "vec_id", "embedding", "label").where("dim > 0")


def mined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every vector whose id is divisible by 100, with the labels of some rows moved on."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = labelled_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), moved)
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0, Scratch(spark))


MINED_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec
  FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, o.vec_id AS other_id, a.label = o.label AS same,
         CAST(list_sum(list_transform(range(1, len(a.vec) + 1), lambda i: a.vec[i] * o.vec[i])) AS BIGINT) AS score
  FROM v a, v o WHERE a.vec_id % 100 = 0 AND a.vec_id <> o.vec_id AND len(a.vec) = len(o.vec)
), positives AS (
  SELECT * FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.other_id AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id) AS INTEGER) AS rank,
       n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY rank <= 10
"""
