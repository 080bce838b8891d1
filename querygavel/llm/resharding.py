"""Resharding by minimum-cost flow: from old shard sizes and new capacities to the fewest bytes moved.

The flow is solved over shards alone. Its amounts become cuts: the documents of an old shard stand in a fixed order, and
stretches of that order go to the shards that the flow names, first of all to the shard itself. Only blocks that a cut
or a move touches are written anew.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querygavel.llm.common import Scratch, documents, free_name

#: Bytes that a document counts beside its text; bounds of a block.
OVERHEAD = 16
BLOCK_BYTES = (64 << 10, 64 << 20)


def min_cost_flow(supply: list[int], capacity: list[int], cost: np.ndarray) -> np.ndarray:
    """Flow from rows to columns of least cost, by shortest augmenting paths.

    Distances are relaxed over the residual network until they settle; the path to the nearest column with room left is
    then filled. Whole bytes in, whole bytes out. The capacities must hold the supply.
    """
    n, m = cost.shape
    left, room = np.array(supply, np.int64), np.array(capacity, np.int64)
    if left.sum() > room.sum():
        raise ValueError("the new shards are too small")
    flow = np.zeros((n, m), np.int64)
    while left.any():
        row, column = np.where(left > 0, 0.0, np.inf), np.full(m, np.inf)
        back, came = np.full(n, -1), np.full(m, -1)  # where each row and column was reached from, when last bettered
        while True:
            via = row[:, None] + cost
            nearer = via.min(axis=0) < column - 1e-9
            column[nearer], came[nearer] = via.min(axis=0)[nearer], via.argmin(axis=0)[nearer]
            undo = np.where(flow > 0, column[None, :] - cost, np.inf)
            better = undo.min(axis=1) < row - 1e-9
            row[better], back[better] = undo.min(axis=1)[better], undo.argmin(axis=1)[better]
            if not better.any():
                break
        open_ = np.where(room > 0, column, np.inf)
        j = end = int(open_.argmin())
        path = []
        while True:
            i = int(came[j])
            path.append((i, j))
            if back[i] < 0:
                break
            j = int(back[i])
            path.append((i, j))
        amount = min(int(left[i]), int(room[end]), *[int(flow[p]) for p in path[1::2]])
        for k, p in enumerate(path):
            flow[p] += amount if k % 2 == 0 else -amount
        left[i] -= amount
        room[end] -= amount
    return flow


def moving_cost(old: int, new: int) -> np.ndarray:
    """A byte costs 1 to move and nothing where it is; shard i of the old layout is shard i of the new one."""
    cost = np.ones((old, new))
    np.fill_diagonal(cost, 0)
    return cost


def transfers(flow: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """For each old shard (new shard, bytes), what stays first."""
    return {
        i: [(j, int(flow[i, j])) for j in sorted(np.flatnonzero(flow[i]).tolist(), key=lambda j: (j != i, j))]
        for i in range(len(flow))
    }


def _looked_up(key: Column, table: dict[int, object], default: Column) -> Column:
    if not table:
        return default
    pairs = [x for k, v in table.items() for x in (F.lit(k), v if isinstance(v, Column) else F.lit(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), default)


def text_bytes() -> Column:
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + OVERHEAD


def reshard(
    docs: DataFrame,
    old_shard: Column,
    old: int,
    new: int,
    scratch: Scratch,
    kept: dict[str, Column],
    cost: np.ndarray | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The new layout: (all rows with shard and slot, the files written anew).

    ``old_shard`` gives each row's shard from 0 to ``old`` - 1 (null: 0). New shards have equal capacities; every shard ends
    within one document's size, for each transfer it takes part in, of its share. The first table has the columns of
    ``kept`` (expressions over a row; where the row was moved, they are evaluated on what the new files hold), size,
    shard, slot (from 0 without gaps) and moved; the second has shard and the rewritten rows with all their columns, in a
    folder for each shard. Where ``kept`` or the rows have a column of such a name, it stays, and the added one has
    underscores before its name (``_shard``). Null texts have no bytes of their own; repeated rows are rows like any other; an empty table gives none.

    The driver sees one number for each old shard. Positions come from sums over blocks: a block has at most 64 MB, so a
    hot shard is many blocks, and no shard is sorted or counted in one task.
    """
    # The row is packed before any column is added, and unpacked beside one struct of a name that it does not have.
    names, own = docs.columns, free_name("__own", docs.columns)
    row = F.struct(*[F.col(f"`{n}`") for n in names])
    rows = docs.select(
        F.coalesce(old_shard.cast("int"), F.lit(0)).alias("__old"),
        text_bytes().alias("__size"),
        F.xxhash64("doc_id", "text").alias("__tie"),
        F.col("doc_id").alias("__id"),
        row.alias("__row"),
    )
    totals = {r["__old"]: r.n for r in rows.groupBy("__old").agg(F.sum("__size").alias("n")).collect()}
    supply = [totals.get(i, 0) for i in range(old)]
    total = sum(supply)
    capacity = [total // new + (j < total % new) for j in range(new)]
    flow = min_cost_flow(supply, capacity, moving_cost(old, new) if cost is None else cost)
    pieces = transfers(flow)
    block_bytes = min(max(total // (16 * new), BLOCK_BYTES[0]), BLOCK_BYTES[1])
    blocks = {i: max(1, -(-n // block_bytes)) for i, n in totals.items()}
    stays = {i: sum(b for j, b in p if j == i) for i, p in pieces.items() if p}
    cuts = {i: F.array(*[F.lit(int(c)) for c in np.cumsum([b for _, b in p])]) for i, p in pieces.items() if p}
    targets = {i: F.array(*[F.lit(j) for j, _ in p]) for i, p in pieces.items() if p}
    rows = rows.withColumn(
        "__block", F.pmod("__tie", _looked_up(F.col("__old"), blocks, F.lit(1)).cast("long")).cast("int")
    )
    sums = scratch.table(rows.groupBy("__old", "__block").agg(F.sum("__size").alias("n")), "blocks")
    before = Window.partitionBy("__old").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("__old", "__block", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start")).select(
        "__old",
        "__block",
        "__start",
        (F.col("__start") + F.col("n") <= _looked_up(F.col("__old"), stays, F.lit(0)).cast("long")).alias("__stays"),
    )
    within = Window.partitionBy("__old", "__block").orderBy("__tie", "__id").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("__start") + F.sum("__size").over(within) - F.ceil(F.col("__size") / 2)
    none = F.array().cast("array<bigint>")
    placed = (
        rows.join(starts, ["__old", "__block"])
        .withColumn("__at", middle)
        .withColumn("__cuts", _looked_up(F.col("__old"), cuts, none))
        .withColumn("__piece", F.size(F.filter("__cuts", lambda c: c <= F.col("__at"))))
        .withColumn("__piece", F.least("__piece", F.size("__cuts") - 1))
        .withColumn("shard", F.get(_looked_up(F.col("__old"), targets, F.array().cast("array<int>")), F.col("__piece")))
        .withColumn(
            "__number",
            F.row_number().over(Window.partitionBy("__old", "__block", "shard").orderBy("__at", "__tie")),
        )
    )
    # A row that stays leaves its columns where they are, but for what is asked of it.
    asked = F.struct(*[c.alias(n) for n, c in kept.items()])
    own_names = ["shard", "__old", "__block", "__number", "size", "moved"]
    stays_ = F.col(f"{own}.moved") == F.lit(False)
    layout = scratch.table(
        placed.withColumns({"size": F.col("__size"), "moved": ~F.col("__stays")})
        .select(F.struct(*own_names).alias(own), "__row.*")
        .select(f"{own}.*", F.when(stays_, asked).alias("__stayed"), F.when(~stays_, row).alias("__row")),
        "layout",
        "shard",
    )
    counts = layout.groupBy("shard", "__old", "__block").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("shard").orderBy("__old", "__block").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("shard", "__old", "__block", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("__first"))
    written = layout.where("moved").select(F.struct(*own_names).alias(own), "__row.*")
    stayed = layout.where("NOT moved").select(*own_names, F.col("__stayed").alias("__kept"))
    slot = (F.col("__first") + F.col("__number") - 1).cast("long")
    added = {"size": F.col("size"), "shard": F.col("shard"), "slot": slot, "moved": F.col("moved")}
    placed_rows = (
        written.select(f"{own}.*", asked.alias("__kept"))
        .unionByName(stayed)
        .join(firsts, ["shard", "__old", "__block"])
        .select("__kept.*", *[c.alias(free_name(n, list(kept))) for n, c in added.items()])
    )
    files = layout.where("moved").select(F.col("shard").alias(free_name("shard", names)), "__row.*")
    return placed_rows, files


def shards_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents from 32 shards by source into 40 of equal size."""
    rows, _ = reshard(
        documents(spark, sf_dir),
        F.pmod(F.xxhash64("source"), F.lit(32)),
        32,
        40,
        Scratch(spark),
        {
            "doc_id": F.col("doc_id"),
            "text_crc32": F.crc32(F.encode(F.coalesce("text", F.lit("")), "utf-8")),
        },
    )
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "moved",
    )
