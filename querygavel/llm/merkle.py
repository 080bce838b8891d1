"""Merkle manifest of a table: hash trees over sources and over all, as nodes labelled with the leaf ranks they cover.

A node of level l covers the ranks [k * 3^l, (k + 1) * 3^l), cut at the end of its tree: the intervals nest. So

* the ancestors of a node are the nodes whose intervals contain its own; on each level only the node of one bucket,
  rank // 3^l, can, which makes containment an equality join;
* its siblings are what its parent's interval holds on its level besides its own interval.

Three levels are kept together in one row, a *block* of at most 27 nodes and what lies above them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querygavel.llm.common import Scratch, documents

#: Children of a node, and levels of a block.
WIDTH, STRIDE = 3, 3
#: Nodes of the lowest level of a block.
BLOCK = WIDTH**STRIDE


def digest(*texts: Column) -> Column:
    """Lowercase hex sha256 of texts put together."""
    return F.sha2(F.encode(F.concat(*texts), "UTF-8"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def ranked(table: DataFrame, tree: str, *order: str, scratch: Scratch) -> DataFrame:
    """``table`` with ``rank``, from 0 in each tree, by ``order``, and ``n``, the tree's size. Written to the shared folder.

    Rows are sorted by ranges of (tree, order), so a tree of any size is spread over tasks; the rank is the place in the
    range plus the tree's rows in the ranges before it.
    """
    dealt = table.withColumn("__row", F.monotonically_increasing_id())
    keys = [tree, *order, "__row"]
    placed = dealt.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__place", F.monotonically_increasing_id())
    placed = scratch.table(placed.withColumn("__part", F.shiftright("__place", 33)).drop("__row"), "ranked")
    before = Window.partitionBy(tree).orderBy("__part")
    runs = placed.groupBy(tree, "__part").agg(F.min("__place").alias("__from"), F.count(F.lit(1)).alias("__rows"))
    runs = runs.select(
        tree,
        "__part",
        (F.sum("__rows").over(before) - F.col("__rows") - F.col("__from")).alias("__shift"),
        F.sum("__rows").over(Window.partitionBy(tree)).alias("n"),
    )
    return placed.join(runs, [tree, "__part"]).withColumn("rank", F.col("__place") + F.col("__shift")).drop("__place", "__part", "__shift")


def _node(lo: Column, hi: Column, hash_: Column) -> Column:
    return F.struct(lo.alias("lo"), hi.alias("hi"), hash_.alias("hash"))


def _above(nodes: Column, level: int) -> Column:
    """The nodes of the next level over sorted nodes of a block: every three become one, the last run may be shorter."""
    numbers = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / WIDTH).cast("int"))

    def parent(i: Column) -> Column:
        run = F.slice(nodes, i * WIDTH + 1, F.lit(WIDTH))
        return _node(F.get(run, F.lit(0))["lo"], F.element_at(run, -1)["hi"], digest(F.array_join(run["hash"], "")))

    return F.transform(numbers, parent)


def _height(n: Column) -> Column:
    """Levels until one node remains: how many of 1, 3, 9, ... are smaller than n."""
    return reduce(lambda a, b: a + b, [(n > F.lit(WIDTH**i)).cast("int") for i in range(39)])


class Forest:
    """Trees over ranked leaves, block by block.

    ``blocks[j]`` has ``tree, block, levels, height``: levels 3j up to 3j + 3 of the nodes whose ranks lie in
    [block * 27^(j+1), (block + 1) * 27^(j+1)), fewer where the tree ends; ``height`` counts the levels above 3j.
    """

    def __init__(self, leaves: DataFrame, scratch: Scratch):
        """``leaves``: tree, rank (gapless from 0), n, hash."""
        self.scratch, self.blocks = scratch, []
        nodes = leaves.select("tree", "rank", (F.col("rank") + 1).alias("hi"), "hash", _height(F.col("n")).alias("height"))
        while True:
            members = F.array_sort(F.collect_list(_node(F.col("rank"), F.col("hi"), F.col("hash"))))
            span = WIDTH ** (STRIDE * (len(self.blocks) + 1))
            block = F.floor(F.col("rank") / span) if span < 1 << 50 else F.lit(0).cast("long")
            grouped = nodes.groupBy("tree", "height", block.alias("block")).agg(members.alias("level0"))
            for level in range(STRIDE):
                below = F.col(f"level{level}")
                higher = F.when(F.col("height") > level, _above(below, level))
                grouped = grouped.withColumn(f"level{level + 1}", higher)
            names = [f"level{i}" for i in range(STRIDE + 1)]
            self.blocks.append(scratch.table(grouped.select("tree", "block", "height", *names), "blocks"))
            top = F.get(F.col(f"level{STRIDE}"), F.lit(0))
            above = self.blocks[-1].where(F.col("height") > STRIDE)
            nodes = above.select("tree", (F.col("height") - STRIDE).alias("height"), top.alias("top")).select(
                "tree", F.col("top.lo").alias("rank"), F.col("top.hi").alias("hi"), F.col("top.hash").alias("hash"), "height"
            )
            if nodes.isEmpty():
                break

    def roots(self) -> DataFrame:
        """tree, root."""
        found = []
        for blocks in self.blocks:
            last = [F.when(F.col("height") == i, F.get(F.col(f"level{i}"), F.lit(0))["hash"]) for i in range(STRIDE + 1)]
            found.append(blocks.where(F.col("height") <= STRIDE).select("tree", F.coalesce(*last).alias("root")))
        return reduce(DataFrame.unionByName, found)

    def paths(self, above: DataFrame) -> DataFrame:
        """The lowest blocks with ``root`` and ``path``, an array of ``left, right``: siblings of each ancestor, put together.

        ``above`` has tree, root and the path that goes on over the tree's root. From the highest blocks down, each block
        finds the block that contains its interval and gets that one's path behind its own steps.
        """
        over = None
        for j in reversed(range(len(self.blocks))):
            blocks = self.blocks[j]
            topmost = blocks.where(F.col("height") <= STRIDE).join(above, "tree")
            if over is not None:
                span = WIDTH ** (STRIDE * (j + 1))
                lower = blocks.where(F.col("height") > STRIDE).withColumns(
                    {
                        "over": F.floor(F.col("block") / BLOCK),
                        "lo": F.col("block") * span,
                        "hi": F.element_at(f"level{STRIDE}", 1)["hi"],
                    }
                )
                container = over.select(
                    "tree",
                    F.col("block").alias("over"),
                    "root",
                    "path",
                    *[F.col(f"level{i}").alias(f"over{i}") for i in range(STRIDE + 1)],
                    F.col("height").alias("over_height"),
                )
                joined = lower.join(container, ["tree", "over"]).withColumn(
                    "path", F.concat(steps("over", F.col("over_height"), F.col("lo"), F.col("hi")), "path")
                )
                topmost = topmost.unionByName(joined.select(*topmost.columns))
            over = self.scratch.table(topmost, "paths") if j else topmost
        return over


def _within(node: Column, lo: Column, hi: Column) -> Column:
    return (node["lo"] >= lo) & (node["hi"] <= hi)


def steps(prefix: str, height: Column, lo: Column, hi: Column) -> Column:
    """left and right siblings, level by level inside a block, of the ancestors of [lo, hi), itself the first.

    On each level the ancestor is the node that contains the interval, its parent the one above that does, and the
    siblings are what the parent's interval holds besides the ancestor's own.
    """
    out = []
    for level in range(STRIDE):
        parents = F.col(f"{prefix}{level + 1}")
        parent = F.get(F.filter(parents, lambda p: (p["lo"] <= lo) & (hi <= p["hi"])), F.lit(0))
        inside = _children(F.col(f"{prefix}{level}"), parent)
        left, right = F.filter(inside, lambda c: c["hi"] <= lo), F.filter(inside, lambda c: c["lo"] >= hi)
        side = F.struct(F.array_join(left["hash"], "").alias("left"), F.array_join(right["hash"], "").alias("right"))
        out.append(F.when(height > level, side))
    return F.filter(F.array(*out), lambda s: s.isNotNull())


def _children(nodes: Column, parent: Column) -> Column:
    return F.filter(nodes, lambda c: _within(c, parent["lo"], parent["hi"]))


def _tree_key(source: Column) -> Column:
    """A name for every source, null too, that sorts as sources do: null first, then by UTF-8 bytes."""
    text = source.cast("string")
    return F.when(text.isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), text))


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def manifest(docs: DataFrame, scratch: Scratch, other_text: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, path, other_leaf: each row of ``docs`` with its way up to the root.

    ``path`` has the siblings on the left and on the right, level by level from the leaf over its source's tree to the
    root. ``other_leaf`` is the leaf that the row would have with ``other_text`` for its text.

    Leaves of a source ascend by doc_id (null first), then by their digest; repeated rows are leaves of their own. Null
    and empty fields differ. Rows without source are a source of their own, which comes first. No rows, no result.
    Columns other than the five fields are not read.
    """
    other = F.col("text") if other_text is None else other_text
    hashed = docs.select(
        F.col("doc_id"),
        _tree_key(F.col("source")).alias("tree"),
        digest(*[field(F.col(name)) for name in FIELDS]).alias("hash"),
        digest(*[field(other if name == "text" else F.col(name)) for name in FIELDS]).alias("other_leaf"),
    )
    leaves = ranked(scratch.table(hashed, "leaves"), "tree", "doc_id", "hash", scratch=scratch)
    leaves = scratch.table(leaves, "leaves")
    trees = Forest(leaves, scratch)
    subroots = scratch.table(trees.roots().withColumnRenamed("root", "subroot"), "subroots")
    sources = ranked(subroots.select(F.lit("").alias("tree"), "subroot", F.col("tree").alias("source")), "tree", "source", scratch=scratch)
    sources = scratch.table(sources.withColumnRenamed("subroot", "hash"), "sources")
    top = Forest(sources, scratch)
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    over_sources = attached(sources, top.paths(top.roots().withColumn("path", nothing)))
    above = over_sources.select(F.col("source").alias("tree"), F.struct("root", F.col("hash").alias("subroot")).alias("root"), "path")
    found = attached(leaves, trees.paths(scratch.table(above, "above")))
    return found.select("doc_id", F.col("hash").alias("leaf"), "root.subroot", "root.root", "path", "other_leaf")


def attached(leaves: DataFrame, blocks: DataFrame) -> DataFrame:
    """Leaves with the root and the path of the block that contains their interval, behind their own steps in it."""
    found = leaves.withColumn("block", F.floor(F.col("rank") / BLOCK)).join(blocks, ["tree", "block"])
    own = steps("level", F.col("height"), F.col("rank"), F.col("rank") + 1)
    return found.withColumn("path", F.concat(own, "path")).drop("block", "height", *[f"level{i}" for i in range(STRIDE + 1)])


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda below, step: digest(step["left"], below, step["right"]))


def checked_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with proofs, checked against texts that lost their line ends where 2 divides the id's checksum."""
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    text = F.when(tampered, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = manifest(documents(spark, sf_dir), Scratch(spark), text)
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    proved = found.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        digest(siblings).alias("proof_sha256"),
        folded(F.col("other_leaf"), F.col("path")).alias("folded_root"),
    )
    return proved.withColumn("verified", F.col("folded_root") == F.col("root"))


#: Trees, paths and folds by recursion; crc32 bit by bit (polynomial 0xEDB88320).
MANIFEST_SQL = """
WITH RECURSIVE fields AS (
  SELECT doc_id, coalesce('s' || source, '') AS tree,
    list_reduce([CAST(ord(c) AS UBIGINT) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')],
      lambda crc, byte: list_reduce(range(8), lambda x, i: xor(x >> 1, CAST(3988292384 AS UBIGINT) * (x & 1)), xor(crc, byte)),
      CAST(4294967295 AS UBIGINT)) & 1 AS inverted_bit,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
    text, replace(text, chr(10), '') AS cut
  FROM documents
), hashed AS (
  SELECT doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS hash,
    CASE WHEN inverted_bit = 1 THEN sha256(head || coalesce(strlen(cut) || ':' || cut, '-'))
         ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS other
  FROM fields
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, hash) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n
  FROM hashed
), nodes AS (
  SELECT tree, 0 AS level, idx, n, hash FROM leaves
  UNION ALL
  SELECT tree, level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(hash, '' ORDER BY idx))
  FROM nodes WHERE n > 1 GROUP BY tree, level, idx // 3, n
), subroots AS (SELECT tree, level, hash, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, idx, n, hash FROM subroots
  UNION ALL
  SELECT level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(hash, '' ORDER BY idx)) FROM tops WHERE n > 1 GROUP BY level, idx // 3, n
), all_nodes AS (
  SELECT tree, level, idx, n, hash FROM nodes
  UNION ALL
  SELECT s.tree, s.level + t.level, t.idx, t.n, t.hash FROM tops t, subroots s WHERE t.n > 1
), steps AS (
  SELECT n.tree, n.level, n.idx,
    coalesce(string_agg(o.hash, '' ORDER BY o.idx) FILTER (WHERE o.idx < n.idx), '') AS lefts,
    coalesce(string_agg(o.hash, '' ORDER BY o.idx) FILTER (WHERE o.idx > n.idx), '') AS rights
  FROM all_nodes n JOIN all_nodes o ON n.tree = o.tree AND n.level = o.level AND n.idx // 3 = o.idx // 3 AND n.n = o.n
  WHERE n.n > 1 GROUP BY ALL
), folds AS (
  SELECT l.tree, l.idx AS leaf_idx, 0 AS level, l.idx, l.other AS folded, '' AS proof FROM leaves l
  UNION ALL
  SELECT f.tree, f.leaf_idx, f.level + 1, CASE WHEN f.level + 1 = s.level THEN s.idx ELSE f.idx // 3 END,
    sha256(p.lefts || f.folded || p.rights), f.proof || p.lefts || p.rights
  FROM folds f JOIN steps p ON p.tree = f.tree AND p.level = f.level AND p.idx = f.idx JOIN subroots s ON s.tree = f.tree
), last AS (SELECT * FROM folds QUALIFY row_number() OVER (PARTITION BY tree, leaf_idx ORDER BY level DESC) = 1)
SELECT l.doc_id, l.hash AS leaf, s.hash AS subroot, (SELECT hash FROM tops WHERE n = 1) AS root,
  sha256(f.proof) AS proof_sha256, f.folded AS folded_root, f.folded = (SELECT hash FROM tops WHERE n = 1) AS verified
FROM leaves l JOIN subroots s ON s.tree = l.tree JOIN last f ON f.tree = l.tree AND f.leaf_idx = l.idx
"""
