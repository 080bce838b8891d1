"""Near-duplicates by SuperMinHash signatures, bands, exact confirmation and components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querygavel.llm.common import Scratch, documents, frugal, frugal_group, mixed, strings
from querygavel.llm.components import connected_components
from querygavel.llm.shingles import shingle_sets

#: 32 bands of 5 values: two sets of similarity 0.8 share none with probability 0.000003.
BANDS, ROWS = 32, 5
SLOTS = BANDS * ROWS
#: Documents that one task compares with one another; and documents that all of a larger cluster are compared with.
BLOCK_DOCS, PIVOTS = 400, 48
#: Elements whose permutations (a byte for each slot) are held at once.
SLICE_ELEMENTS = 100_000
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """SuperMinHash: one row of SLOTS values for each set that is not empty.

    Each element walks through a random permutation of the slots, drawn step by step from its hash. Its value at step j
    lies in [j, j + 1), so its ranks in all slots are tied to each other, which lowers the variance. Once every slot of a
    set is filled, later steps cannot lower any: the set is done.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    h = np.full((len(sets), SLOTS), np.inf)
    flat = h.reshape(-1)
    element = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.broadcast_to(np.arange(SLOTS, dtype=np.uint8), (len(element), SLOTS)).copy()
    for j in range(SLOTS):
        if not len(element):
            break
        with np.errstate(over="ignore"):
            draw = mixed(element + np.uint64(j + 1) * _GOLDEN)
        k = j + (((draw & np.uint64(0xFFFFFF)) * np.uint64(SLOTS - j)) >> np.uint64(24)).astype(np.int64)
        value = (draw >> np.uint64(24)).astype(np.float64) * 2.0**-40 + j
        here = np.arange(len(element))
        slot = order[here, k]
        order[here, k] = order[:, j]
        np.minimum.at(flat, owner * SLOTS + slot, value)
        if j < 4 or j % 4 == 0:
            still = np.isinf(h).any(axis=1)[owner]
            if not still.all():
                element, owner, order = element[still], owner[still], order[still]
    return h


def set_signatures(sets: list[np.ndarray]) -> np.ndarray:
    """``signatures`` with permutations for SLICE_ELEMENTS elements at once, however large a set is.

    The values of a set are the least of those of its slices, slot by slot.
    """
    pieces, owner, out, held = [], [], np.full((len(sets), SLOTS), np.inf), 0

    def lower() -> None:
        np.minimum.at(out, np.array(owner), signatures(pieces))

    for i, shingles in enumerate(sets):
        for start in range(0, len(shingles), SLICE_ELEMENTS):
            piece = shingles[start : start + SLICE_ELEMENTS]
            if held and held + len(piece) > SLICE_ELEMENTS:
                lower()
                pieces, owner, held = [], [], 0
            pieces.append(piece)
            owner.append(i)
            held += len(piece)
    if pieces:
        lower()
    return out


def band_keys(h: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each band of each signature; the band is part of it."""
    bits = h.view(np.uint64).reshape(len(h), BANDS, ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(h), BANDS))
    with np.errstate(over="ignore"):
        for r in range(ROWS):
            keys = mixed(keys * _GOLDEN + bits[:, :, r])
    return keys.view(np.int64)


_SIGNED = pa.schema(
    [("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("bands", pa.list_(pa.int64()))]
)
_SIGNED_DDL = "doc_id bigint, n bigint, d1 bigint, d2 bigint, bands array<bigint>"


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        sums = mixed(shingles).sum(dtype=np.uint64), mixed(shingles ^ _GOLDEN).sum(dtype=np.uint64)
    return int(sums[0].view(np.int64)), int(sums[1].view(np.int64))


def _signed(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    def out(ids, sets):
        keys = iter(band_keys(set_signatures([s for s in sets if len(s)])).tolist())
        rows = [(i, len(s), *_digest(s), next(keys) if len(s) else []) for i, s in zip(ids, sets, strict=True)]
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SIGNED, strict=True)], schema=_SIGNED)

    for batch in batches:
        ids, held, total = [], [], 0
        for doc_id, shingles in zip(batch.column("doc_id").to_pylist(), shingle_sets(strings(batch, "text"), k), strict=True):
            ids.append(doc_id)
            held.append(shingles)
            total += len(shingles)
            if total > SLICE_ELEMENTS:
                yield out(ids, held)
                ids, held, total = [], [], 0
        if ids:
            yield out(ids, held)


class Sets:
    """Sets side by side; tells how much one of them shares with each of the others."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = np.array([len(s) for s in sets])
        self.starts = np.concatenate([[0], np.cumsum(self.n)])[:-1]
        values, self.index = np.unique(np.concatenate(sets), return_inverse=True)
        self.values, self.mark = values, np.zeros(len(values) + 1, np.int64)

    def linked(self, shingles: np.ndarray, percent: int) -> np.ndarray:
        """Which sets have 100 |A n B| >= percent |A u B| with the given one."""
        at = np.searchsorted(self.values, shingles)
        at = at[(at < len(self.values)) & (self.values[np.minimum(at, len(self.values) - 1)] == shingles)]
        self.mark[at] = 1
        shared = np.add.reduceat(self.mark[self.index], self.starts)
        self.mark[at] = 0
        return 100 * shared >= percent * (self.n + len(shingles) - shared)


def _find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _unite(parent: list[int], i: int, j: int) -> bool:
    i, j = _find(parent, i), _find(parent, j)
    parent[max(i, j)] = min(i, j)
    return i != j


def _texts(group: pa.Table, k: int) -> tuple[list[int], list[np.ndarray]]:
    """Different nodes of a group and their sets; a repeated row counts once."""
    text = dict(zip(group.column("node").to_pylist(), group.column("text").to_pylist(), strict=True))
    return list(text), list(shingle_sets(list(text.values()), k))


def _edges(pairs: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})


def _link_small(k: int, percent: int):
    def run(group):
        nodes, sets = _texts(group, k)
        own, parent, pairs = Sets(sets), list(range(len(nodes))), []
        for i in range(len(nodes)):
            for j in np.flatnonzero(own.linked(sets[i], percent)).tolist():
                if j > i and _unite(parent, i, j):
                    pairs.append((nodes[i], nodes[j]))
        return _edges(pairs)

    return run


def _link_pivots(k: int, percent: int):
    """For each member of a block, a bit for each pivot that it is linked with."""

    def run(group):
        pivots = group.filter(pc.is_valid(group.column("pivot")))
        members = group.filter(pc.is_null(group.column("pivot")))
        nodes, sets = _texts(members, k)
        masks = np.zeros(len(nodes), np.int64)
        if len(nodes):
            own = Sets(sets)
            for number, shingles in zip(pivots.column("pivot").to_pylist(), shingle_sets(pivots.column("text").to_pylist(), k), strict=True):
                masks |= own.linked(shingles, percent).astype(np.int64) << number
        cluster = group.column("cluster")[0].as_py() if len(group) else 0
        return pa.table({"cluster": pa.array([cluster] * len(nodes), pa.int64()), "node": pa.array(nodes, pa.int64()), "mask": masks})

    return run


def _main_pivots(group):
    """The pivots of the largest part of a cluster: pivots that a document is linked with belong together."""
    masks, counts = group.column("mask").to_pylist(), group.column("n").to_pylist()
    parts: list[int] = []
    for mask in masks:
        inside = [p for p in parts if p & mask]
        for p in inside:
            parts.remove(p)
            mask |= p
        if mask:
            parts.append(mask)
    weight = {p: sum(n for m, n in zip(masks, counts, strict=True) if m & p) for p in parts}
    main = max(parts, key=lambda p: (weight[p], p), default=0)
    return pa.table({"cluster": group.column("cluster")[:1], "main": pa.array([main], pa.int64())})


def _link_rest(k: int, percent: int):
    """Documents outside the largest part against one block of the cluster; a forest of their links."""

    def run(group):
        asked = group.filter(group.column("asked"))
        nodes, sets = _texts(group.filter(pc.invert(group.column("asked"))), k)
        queries, query_sets = _texts(asked, k)
        if not nodes or not queries:
            return _edges([])
        own, names = Sets(sets), nodes + queries
        parent, pairs = list(range(len(names))), []
        for q, shingles in enumerate(query_sets):
            for j in np.flatnonzero(own.linked(shingles, percent)).tolist():
                if nodes[j] != queries[q] and _unite(parent, len(nodes) + q, j):
                    pairs.append((queries[q], nodes[j]))
        return _edges(pairs)

    return run


def _candidates(reps: DataFrame) -> DataFrame:
    """Edges from every document to the least one it shares a band with."""
    keyed = reps.select("node", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return keyed.join(shared, "key").where("node != least").select(F.col("node").alias("a"), F.col("least").alias("b"))


def near_groups(docs: DataFrame, scratch: Scratch, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, one row for each document.

    Documents are linked when 100 |A n B| >= percent |A u B| for their sets of k-word shingles (64-bit hashes of them);
    a component is what links reach, named by its smallest doc_id, whose row is kept. Documents without words are linked
    with nothing. Rows of a null doc_id are linked with nothing either and have a null component, all kept. Rows of one
    doc_id and one text are copies: all of them are in the component, and ``kept`` is true for each that has its name.
    Different texts must have different doc_ids. Other columns are left out.

    Equal sets are one node from the start. Nodes that share a band with a third are in one cluster; only there are texts
    compared, in full. A cluster of up to BLOCK_DOCS is compared by one task. A larger one is cut into blocks: all its
    documents are compared with PIVOTS of them, and those that do not belong to the largest part found so, with the whole
    cluster, block by block. So no link between different parts is lost, and no group is gathered in one place.
    """
    signed = scratch.table(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(frugal(lambda it: _signed(it, k)), _SIGNED_DDL),
        "signatures",
    )
    classes = scratch.table(
        signed.where("n > 0 AND doc_id IS NOT NULL")
        .groupBy("d1", "d2")
        .agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands")),
        "classes",
    )
    clusters = connected_components(_candidates(classes), scratch).withColumnRenamed("component", "cluster")
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    # The members grow with the documents, so their join never goes by broadcast, whatever the size of a run.
    members = scratch.table(
        clusters.join(sizes, "cluster")
        .hint("merge")
        .join(docs.select(F.col("doc_id").cast("long").alias("node"), "text"), "node")
        .select(
            "cluster",
            "size",
            "node",
            F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / BLOCK_DOCS)).cast("int").alias("block"),
            "text",
        ),
        "members",
    )
    small = members.where(F.col("size") <= BLOCK_DOCS)
    edges = scratch.table(
        small.select("cluster", "node", "text").groupBy("cluster").applyInArrow(frugal_group(_link_small(k, percent)), "a bigint, b bigint"),
        "links",
    )
    large = members.where(F.col("size") > BLOCK_DOCS)
    if not large.limit(1).isEmpty():
        edges = edges.unionByName(_large_links(large, scratch, k, percent))
    components = connected_components(edges, scratch)
    named = (
        classes.select("d1", "d2", "node")
        .join(components, "node", "left")
        .select("d1", "d2", F.coalesce("component", "node").alias("component"))
    )
    linked = signed.drop("bands").withColumn("known", (F.col("n") > 0) & F.col("doc_id").isNotNull())
    return (
        linked.where("known").join(named, ["d1", "d2"])
        .unionByName(linked.where("NOT known").withColumn("component", F.col("doc_id")).select(*linked.columns, "component"))
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.col("component").alias("component_id"),
            F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"),
        )
    )


def _large_links(large: DataFrame, scratch: Scratch, k: int, percent: int) -> DataFrame:
    """Links within clusters of several blocks."""
    order = F.struct(F.xxhash64("node", F.lit(3)).alias("h"), F.col("node"))
    # A bounded number of ids for each large cluster, by partial top lists.
    picked = (
        large.select("cluster", order.alias("o"))
        .groupBy("cluster", F.spark_partition_id().alias("p"))
        .agg(F.slice(F.sort_array(F.collect_set("o")), 1, PIVOTS).alias("o"))
        .select("cluster", F.explode("o").alias("o"))
        .groupBy("cluster")
        .agg(F.slice(F.sort_array(F.collect_set("o")), 1, PIVOTS).alias("o"))
        .select("cluster", F.posexplode("o").alias("pivot", "o"))
        .select("cluster", "pivot", F.col("o.node").alias("node"))
    )
    pivots = scratch.table(large.join(picked, ["cluster", "node"]), "pivots")
    every_block = F.explode(F.sequence(F.lit(0), (F.ceil(F.col("size") / BLOCK_DOCS) - 1).cast("int")))
    asked = pivots.withColumn("block", every_block).select("cluster", "block", "node", "text", "pivot")
    rows = large.select("cluster", "block", "node", "text", F.lit(None).cast("int").alias("pivot"))
    masks = scratch.table(
        rows.unionByName(asked)
        .groupBy("cluster", "block")
        .applyInArrow(frugal_group(_link_pivots(k, percent)), "cluster bigint, node bigint, mask bigint"),
        "masks",
    )
    main = (
        masks.groupBy("cluster", "mask")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("cluster")
        .applyInArrow(_main_pivots, "cluster bigint, main bigint")
    )
    bits = F.filter(F.sequence(F.lit(0), F.lit(PIVOTS - 1)), lambda i: F.getbit("mask", i) == 1)
    to_pivots = (
        masks.select("cluster", "node", F.explode(bits).alias("pivot"))
        .join(pivots.select("cluster", "pivot", F.col("node").alias("b")), ["cluster", "pivot"])
        .select(F.col("node").alias("a"), "b")
    )
    rest = masks.join(main, "cluster").where("(mask & main) = 0").select("cluster", "node")
    queries = (
        large.join(rest, ["cluster", "node"])
        .withColumns({"part": F.col("block"), "block": every_block})
        .select("cluster", "block", "part", "node", "text", F.lit(True).alias("asked"))
    )
    parts = queries.select("cluster", "block", "part").distinct()
    against = large.join(parts, ["cluster", "block"]).select(
        "cluster", "block", "part", "node", "text", F.lit(False).alias("asked")
    )
    found = (
        queries.unionByName(against)
        .groupBy("cluster", "block", "part")
        .applyInArrow(frugal_group(_link_rest(k, percent)), "a bigint, b bigint")
    )
    return to_pivots.unionByName(found)


def near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents by two-word shingles."""
    return near_groups(documents(spark, sf_dir), Scratch(spark), k=2)
