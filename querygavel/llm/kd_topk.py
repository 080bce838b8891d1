"""Exact search for the largest inner products: a KD-tree for each shard, blocks of queries searched best-first."""

from __future__ import annotations

import io
import math
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querygavel.llm.common import Scratch, frugal

SHARD_ROWS = 4096
BLOCK_QUERIES = 1024
LEAF_ROWS = 32
#: Vectors whose products with a block are taken at once.
CHUNK_ROWS = 512
#: A worker holds the trees of one group: so many bytes of vectors at most, fewer while there are not so many groups.
GROUP_BYTES, GROUPS = 64 << 20, 48
#: Trees and queries travel in rows of about so many bytes, since Spark hands rows to Python by their number alone.
PIECE_BYTES = 4096
#: Queries that tell how far down to ask for bounds, and what opening a node costs, in products of two vectors.
SAMPLED, OPENING = 32, 20_000
#: No score yet, and no id.
NONE, NOBODY = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class Tree:
    """Median splits of the widest side down to small leaves; each node has the tight box of its vectors and their least id."""

    PARTS = ("ids", "vectors", "start", "end", "left", "lo", "hi", "least", "shard")

    def __init__(self, ids, vectors, start, end, left, lo, hi, least, shard=0):
        self.ids, self.vectors, self.start, self.end, self.left = ids, vectors, start, end, left
        self.lo, self.hi, self.least, self.shard = lo, hi, least, int(shard)

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray, shard: int = 0) -> Tree:
        order = np.argsort(ids, kind="stable")
        start, end, left, lo, hi = [0], [len(ids)], [-1], [], []
        node = 0
        while node < len(start):
            part = order[start[node] : end[node]]
            own = vectors[part]
            lo.append(own.min(axis=0))
            hi.append(own.max(axis=0))
            width = hi[-1].astype(np.float64) - lo[-1]
            if len(part) > LEAF_ROWS and len(width) and width.max() > 0:
                side = own[:, int(np.argmax(width))]
                half = len(part) // 2
                order[start[node] : end[node]] = part[np.argpartition(side, half)]
                left[node] = len(start)
                start += [start[node], start[node] + half]
                end += [start[node] + half, end[node]]
                left += [-1, -1]
            node += 1
        ids = ids[order]
        least = [ids[a:b].min() for a, b in zip(start, end, strict=True)]
        return cls(
            ids, vectors[order], np.array(start), np.array(end), np.array(left), np.array(lo), np.array(hi), np.array(least), shard
        )

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{name: getattr(self, name) for name in self.PARTS})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Tree:
        with np.load(io.BytesIO(data), allow_pickle=False) as parts:
            return cls(**{name: parts[name] for name in parts.files})

    @cached_property
    def levels(self) -> list[np.ndarray]:
        """For each depth, the nodes there and the leaves above: together they hold every vector once."""
        found = [np.zeros(1, np.int64)]
        while (inner := self.left[found[-1]] >= 0).any():
            nodes, below = found[-1], self.left[found[-1][inner]]
            found.append(np.concatenate([nodes[~inner], below, below + 1]))
        return found

    def front(self, queries: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """The nodes that are worth a bound each: of the depths, the one that a few of the queries show as the cheapest."""
        some = np.unique(np.linspace(0, len(queries) - 1, SAMPLED).astype(np.int64))
        is_open = (bounds(queries[some], self.lo, self.hi) >= kth[some, None]).mean(axis=0)
        rows = self.end - self.start
        costs = [
            (OPENING * (is_open[nodes] > 0) + len(queries) * (2 + is_open[nodes] * rows[nodes])).sum() for nodes in self.levels
        ]
        return self.levels[int(np.argmin(costs))]

    def search(self, block: Block, rows: np.ndarray, limits: np.ndarray | None) -> None:
        """Let the ``rows`` of the block take up what is better than their kth; ``limits`` are their bounds for the root.

        Nodes are opened by their best bound, each for the queries that it can reach. An equal bound still counts where the
        node has a smaller id than the kth.
        """
        if limits is not None and len(rows):
            rows = rows[block.reached(rows, limits, self.least[0])]
        if not len(rows):
            return
        kind = _kind(block.reach * self.reach)
        queries, vectors = block.vectors[rows].astype(kind), self.vectors.astype(kind)
        room = block.room(kind)
        nodes = np.zeros(1, np.int64)
        if limits is not None and len(self.start) > 1:
            nodes = self.front(queries, block.scores[rows, -1])
        if len(nodes) > 1:
            limits = bounds(queries, self.lo[nodes], self.hi[nodes])
            by_best = np.argsort(-limits.max(axis=0), kind="stable")
        for n in by_best if len(nodes) > 1 else [0]:
            node, now, asked = nodes[n], rows, queries
            if len(nodes) > 1:
                reached = block.reached(rows, limits[:, n], self.least[node])
                if not reached.any():
                    continue
                if reached.mean() < 0.75:
                    now, asked = rows[reached], queries[reached]
            for first in range(self.start[node], self.end[node], CHUNK_ROWS):
                last = min(first + CHUNK_ROWS, self.end[node])
                scores = room[: len(now) * (last - first)].reshape(len(now), -1)
                np.matmul(asked, vectors[first:last].T, out=scores)
                block.take(now, scores, self.ids[first:last])

    @cached_property
    def reach(self) -> float:
        """No vector or corner of a box is longer."""
        return _longest(np.maximum(np.abs(self.lo[:1].astype(np.float64)), np.abs(self.hi[:1].astype(np.float64))))


class Block:
    """Queries of one length, their k best scores so far, and the ids that have them; ties go to the smaller id.

    At first all k are ``floors``, the kth that is known from elsewhere: only what is better can matter.
    """

    def __init__(self, k: int, ids, floors, floor_ids, homes, vectors):
        self.ids, self.floors, self.floor_ids, self.homes, self.vectors = ids, floors, floor_ids, homes, vectors
        self.scores, self.found = np.repeat(floors[:, None], k, axis=1), np.repeat(floor_ids[:, None], k, axis=1)
        self.reach, self._rooms = _longest(vectors), {}

    def room(self, kind: type) -> np.ndarray:
        """A place for the scores of a chunk."""
        if kind not in self._rooms:
            self._rooms[kind] = np.empty(len(self.ids) * CHUNK_ROWS, kind)
        return self._rooms[kind]

    def reached(self, rows: np.ndarray, limits: np.ndarray, least: int) -> np.ndarray:
        """Which of the rows may find something better where their scores are at most ``limits`` and ids at least ``least``."""
        kth = self.scores[rows, -1]
        return (limits > kth) | ((limits == kth) & (least < self.found[rows, -1]))

    def take(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Take up the scores (a line for each of the rows) of the vectors with these ids where they are better."""
        k = self.scores.shape[1]
        kth = self.scores[rows, -1].astype(scores.dtype)
        some = np.flatnonzero(scores.max(axis=1) >= kth)
        if not len(some):
            return
        rows, scores, kth = rows[some], scores[some], kth[some]
        new = self.scores[rows, -1] == NONE
        if scores.shape[1] > k + 1 and new.any():
            # One of the k + 1 largest may be the query's own.
            kth[new] = np.partition(scores[new], -k - 1, axis=1)[:, -k - 1]
        line, column = np.nonzero((scores > kth[:, None]) | ((scores == kth[:, None]) & (ids < self.found[rows, -1, None])))
        asks, found = rows[line], ids[column]
        other = found != self.ids[asks]
        asks, found, score = asks[other], found[other], scores[line, column][other].astype(np.int64)
        if not len(asks):
            return
        rows, line = np.unique(asks, return_inverse=True)
        line = np.concatenate([np.repeat(np.arange(len(rows)), k), line])
        score, found = np.concatenate([self.scores[rows].ravel(), score]), np.concatenate([self.found[rows].ravel(), found])
        order = np.lexsort((found, ~score, line))
        begin = np.searchsorted(line[order], np.arange(len(rows)))
        best = order[begin[:, None] + np.arange(k)]
        self.scores[rows], self.found[rows] = score[best], found[best]

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """query_id, vec_id and score of all that is better than the floors, and how many each query has."""
        floors, floor_ids = self.floors[:, None], self.floor_ids[:, None]
        better = (self.scores > floors) | ((self.scores == floors) & (self.found < floor_ids))
        counts = better.sum(axis=1)
        return np.repeat(self.ids, counts), self.found[better], self.scores[better], counts

    def search(self, trees: list[Tree]) -> None:
        """Search the trees: each query that of its own shard if it is there, then all others, the best bounds first."""
        limits, most = None, self.reach * max((t.reach for t in trees), default=0)
        if trees and most < 2**62:
            limits = bounds(self.vectors.astype(_kind(most)), np.array([t.lo[0] for t in trees]), np.array([t.hi[0] for t in trees]))
        order = range(len(trees)) if limits is None else np.argsort(-limits.max(axis=0), kind="stable")
        for at_home in (True, False):
            for n in order:
                rows = np.flatnonzero((self.homes == trees[n].shard) == at_home)
                trees[n].search(self, rows, None if limits is None else limits[rows, n])


def _longest(vectors: np.ndarray) -> float:
    """A little over the length of the longest of the vectors."""
    return math.sqrt(np.square(vectors.astype(np.float64)).sum(axis=1).max(initial=0)) * (1 + 1e-9)


def _kind(most: float) -> type:
    """The numbers in which inner products, and all sums on the way to them, are exact if none is larger than ``most``.

    Those of two vectors are never larger than the product of their lengths.
    """
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


def bounds(queries: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For each query and box, the largest inner product that the box allows, in the numbers of the queries (see _kind)."""
    return np.maximum(queries, 0) @ hi.astype(queries.dtype).T + np.minimum(queries, 0) @ lo.astype(queries.dtype).T


def _fits_doubles(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether no inner product, nor any sum on the way to it, passes 2^53."""
    return float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1]) < 2**53


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: in doubles where no sum can pass 2^53, else in 64-bit integers."""
    if _fits_doubles(a, b):
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // len(column)) if len(column) else flat.reshape(0, 0)


def integer_vectors(table: DataFrame, id_col: str, vector_col: str, *kept: str) -> DataFrame:
    """vec_id, the columns ``kept``, dim, vec: each component x as floor(256 x). Rows that cannot be compared are left out."""
    vector = F.col(vector_col).cast("array<double>")
    # Where one is null and none equal, array_contains is null; NaN equals NaN.
    usable = F.col(id_col).isNotNull()
    for odd in (math.nan, math.inf, -math.inf):
        usable &= ~F.array_contains(vector, F.lit(odd))
    return table.where(usable).select(
        F.col(id_col).cast("long").alias("vec_id"),
        *kept,
        F.size(vector).alias("dim"),
        F.transform(vector, lambda x: F.floor(x * 256)).alias("vec"),
    )


_PIECES_DDL = "shard int, dim int, piece int, data binary"
_HOME_DDL = "home int, dim int, data binary, query_ids array<bigint>, vec_ids array<bigint>, scores array<bigint>"
_HITS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_HITS_DDL = "query_id bigint, vec_id bigint, score bigint"


def _single(vectors: DataFrame, kind: str) -> DataFrame:
    """One row for each vec_id, its components as ``kind``."""
    narrow = vectors.select("vec_id", "dim", F.col("vec").cast(f"array<{kind}>").alias("vec"))
    return narrow.groupBy("vec_id").agg(F.min(F.struct("dim", "vec")).alias("row")).select("vec_id", "row.*")


def _narrowest(least: int | None, most: int | None) -> str:
    """The smallest type for components from ``least`` to ``most``."""
    for kind, bits in (("smallint", 16), ("int", 32)):
        if least is None or (-(2 ** (bits - 1)) <= least and most < 2 ** (bits - 1)):
            return kind
    return "bigint"


def top_k(vectors: DataFrame, queries: DataFrame, scratch: Scratch, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query with all other vectors.

    ``vectors`` and ``queries`` have vec_id, dim and vec (see integer_vectors). Of rows that share a vec_id, the one with
    the smallest (dim, vec) counts. Only vectors of the query's length are compared with it. Ties go to the smaller vec_id; with fewer than k candidates all
    are returned; a query without any has no row. Scores must fit 64-bit integers; those of vectors without components are null.

    Vectors are dealt to shards of about 4,096 by their id. A query is first searched in the shard of its own id; its
    kth score then goes along to all other shards, where boxes that cannot reach it are not opened. A task holds the trees
    of a group of shards, and blocks of queries pass by, first those at home in the group, then all others with the kth
    scores from their own: trees travel twice, queries once for each group.
    """
    of = vectors.agg(
        F.approx_count_distinct("vec_id").alias("n"),
        F.avg("dim").alias("dim"),
        F.min(F.array_min("vec")).alias("least"),
        F.max(F.array_max("vec")).alias("most"),
    ).first()
    kind = _narrowest(of["least"], of["most"])
    shards = max(1, -(-of["n"] // SHARD_ROWS))
    shard_bytes = SHARD_ROWS * max(1.0, of["dim"] or 0) * {"smallint": 2, "int": 4, "bigint": 8}[kind]
    members = max(1, min(shards // GROUPS, int(GROUP_BYTES / shard_bytes)))
    groups = -(-shards // members)
    shard_of = lambda column: F.pmod(F.xxhash64(column), F.lit(shards)).cast("int")
    group_of = lambda column: F.floor(F.col(column) / members).cast("int")

    trees = scratch.table(
        _single(vectors, kind)
        .withColumn("shard", shard_of("vec_id"))
        .groupBy("dim", "shard")
        .applyInArrow(_plant, _PIECES_DDL),
        "trees",
    )
    planted = trees.select(group_of("shard").alias("group"), F.lit(0).alias("side"), *trees.columns)
    asked = (
        _single(queries, "bigint")
        .withColumn("shard", shard_of("vec_id"))
        .mapInArrow(_ask, _PIECES_DDL)
        .select(group_of("shard").alias("group"), F.lit(1).alias("side"), "*")
    )

    def meet(asked: DataFrame, run, ddl: str) -> DataFrame:
        return (
            planted.unionByName(asked)
            .repartitionById(groups, "group")
            .sortWithinPartitions("group", "side", "dim", "shard", "piece")
            .mapInArrow(frugal(run), ddl)
        )

    home = scratch.table(meet(asked, _search_home(k), _HOME_DDL), "home-hits")
    away = home.select("home", "dim", "data", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group")).where(
        "group != home"
    )
    away = away.select("group", F.lit(1).alias("side"), F.lit(0).alias("shard"), "dim", F.lit(0).alias("piece"), "data")
    at_home = home.select(F.explode(F.arrays_zip("query_ids", "vec_ids", "scores")).alias("hit")).select(
        F.col("hit.query_ids").alias("query_id"), F.col("hit.vec_ids").alias("vec_id"), F.col("hit.scores").alias("score")
    )
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        at_home.unionByName(meet(away, _search_away(k), _HITS_DDL))
        .withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _plant(key, group):
    """The tree of one shard and length, in pieces."""
    dim, shard = (x.as_py() for x in key)
    data = Tree.build(group.column("vec_id").to_numpy(), _matrix(group.column("vec").combine_chunks()), shard).dump()
    pieces = [data[i : i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)]
    n = len(pieces)
    return pa.table(
        {
            "shard": pa.array([shard] * n, pa.int32()),
            "dim": pa.array([dim] * n, pa.int32()),
            "piece": pa.array(range(n), pa.int32()),
            "data": pa.array(pieces, pa.binary()),
        }
    )


def _pack(ids, floors, floor_ids, homes, vectors) -> bytes:
    """Queries as bytes."""
    head = np.array([len(ids), vectors.itemsize], np.int64)
    return b"".join([*(np.asarray(part, np.int64).tobytes() for part in (head, ids, floors, floor_ids, homes)), vectors.tobytes()])


def _unpack(data: bytes, dim: int) -> tuple[np.ndarray, ...]:
    n, width = np.frombuffer(data, np.int64, 2).tolist()
    numbers = np.frombuffer(data, np.int64, 4 * n, 16).reshape(4, n)
    return *numbers, np.frombuffer(data, f"<i{width}", n * dim, 16 + 32 * n).reshape(n, dim)


def _ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each query as a piece of its own, without a floor."""
    for batch in batches:
        vectors, data = batch.column("vec"), []
        whole = vectors.flatten().to_numpy(zero_copy_only=False)
        kind = _narrowest(whole.min(initial=0), whole.max(initial=0))
        whole = whole.astype({"smallint": np.int16, "int": np.int32, "bigint": np.int64}[kind])
        ends = np.cumsum(batch.column("dim").to_numpy())
        for i, (own, home, dim, end) in enumerate(
            zip(batch.column("vec_id").to_pylist(), batch.column("shard").to_pylist(), batch.column("dim").to_pylist(), ends, strict=True)
        ):
            data.append(_pack([own], [NONE], [NOBODY], [home], whole[end - dim : end]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("shard"), batch.column("dim"), pa.array([0] * len(batch), pa.int32()), pa.array(data, pa.binary())],
            names=["shard", "dim", "piece", "data"],
        )


def _meetings(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[tuple[int, int, Block]]:
    """The group and length of each block, and the block, searched; of every group the trees come first."""

    def rows():
        for batch in batches:
            keys = (batch.column(name).to_pylist() for name in ("group", "side", "dim", "shard"))
            yield from zip(*keys, batch.column("data"), strict=True)

    here, grove = None, {}
    for (group, side, dim), pieces in groupby(rows(), itemgetter(0, 1, 2)):
        if group != here:
            here, grove = group, {}
        if side == 0:
            grove[dim] = [Tree.load(b"".join(data.as_py() for *_, data in own)) for _, own in groupby(pieces, itemgetter(3))]
            continue
        for block in _blocks(pieces, dim, k):
            block.search(grove.get(dim, []))
            yield group, dim, block


def _blocks(pieces: Iterable[tuple], dim: int, k: int) -> Iterator[Block]:
    held, n = [], 0
    for *_, data in pieces:
        held.append(_unpack(data.as_py(), dim))
        n += len(held[-1][0])
        if n >= BLOCK_QUERIES:
            yield Block(k, *map(np.concatenate, zip(*held, strict=True)))
            held, n = [], 0
    if held:
        yield Block(k, *map(np.concatenate, zip(*held, strict=True)))


def _hit_arrays(dim: int, block: Block) -> tuple[list[pa.Array], np.ndarray]:
    ids, found, scores, counts = block.hits()
    return [pa.array(ids), pa.array(found), pa.array(scores, mask=np.full(len(scores), dim == 0))], counts


def _search_home(k: int):
    """The hits of queries in their own groups, with the queries as they go on: in larger pieces, with their floors."""

    def run(batches):
        for group, dim, block in _meetings(batches, k):
            arrays, counts = _hit_arrays(dim, block)
            size = max(1, PIECE_BYTES // (32 + dim * block.vectors.itemsize))
            cuts = list(range(0, len(block.ids), size))
            at = np.concatenate([[0], np.cumsum(counts)])[[*cuts, len(block.ids)]]
            data = [
                _pack(block.ids[c], block.scores[c, -1], block.found[c, -1], block.homes[c], block.vectors[c])
                for c in (slice(i, i + size) for i in cuts)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([group] * len(cuts), pa.int32()),
                    pa.array([dim] * len(cuts), pa.int32()),
                    pa.array(data, pa.binary()),
                    *(pa.ListArray.from_arrays(pa.array(at, pa.int32()), array) for array in arrays),
                ],
                names=["home", "dim", "data", "query_ids", "vec_ids", "scores"],
            )

    return run


def _search_away(k: int):
    """The hits in all other groups."""

    def run(batches):
        for _, dim, block in _meetings(batches, k):
            arrays, _ = _hit_arrays(dim, block)
            yield pa.RecordBatch.from_arrays(arrays, schema=_HITS)

    return run


def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest inner products of every vector whose id is divisible by 50."""
    vectors = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), Scratch(spark))


NEAREST_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.vec) + 1), lambda i: q.vec[i] * c.vec[i])) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.vec) = len(c.vec)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs
) WHERE rank <= 5
"""
