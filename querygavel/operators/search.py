"""Full-text search by BM25 over an inverted index in blocks, with bounds that let blocks be skipped."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querygavel.session import scratch_path

# The usual constants of the formula.
K1 = 1.2
B = 0.75

WORD_PATTERN = r"[\p{L}\p{N}]+"

#: Documents of a block. Small blocks have tight bounds, large ones fewer rows in the index.
BLOCK_DOCS = 128
#: Blocks of the highest bounds that give a query its first floor.
FIRST_BLOCKS = 2
#: Blocks that are scored at once, as a power of two, the queries they are scored for, and the terms of a matrix.
PART_BITS = 5
PAGE_QUERIES = 256
MATRIX_TERMS = 4096
#: Terms that are sent to all tasks at most.
SENT_TERMS = 100_000

# No word is empty, so this term is free to stand for the whole block.
CORPUS_TERM = ""


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(0))


@dataclass(frozen=True)
class SearchIndex:
    """``rows`` has one row per block and term: ``block, term, n, words, max_tf, min_length, docs, tfs, lengths``.

    ``docs, tfs, lengths`` are the postings side by side. The empty term stands for the block: ``n`` documents and
    ``words`` words.
    """

    rows: DataFrame
    id_type: T.DataType


def build_index(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", only: DataFrame | None = None
) -> SearchIndex:
    """Index whole texts in one pass, without a shuffle, and write the index to the shared folder.

    For given queries, ``only`` may have the ``term``s that are asked for; up to SENT_TERMS of them are sent along and
    the index has no others. With more, all terms are indexed. Lengths always count all words.

    A block is some documents of one task; its postings are counted where its texts are read. Documents without text
    count as empty ones. Ids are unique; documents without id are left out.
    """
    docs = docs.where(F.col(doc_id).isNotNull())
    spark, id_type = docs.sparkSession, docs.schema[doc_id].dataType
    own = docs.select(F.col(doc_id).alias("id"), F.coalesce(words(F.col(text)), F.array().cast("array<string>")).alias("words"))
    shape = T.StructType(
        [
            T.StructField("block", T.LongType()),
            T.StructField("term", T.StringType()),
            T.StructField("n", T.LongType()),
            T.StructField("words", T.LongType()),
            T.StructField("max_tf", T.IntegerType()),
            T.StructField("min_length", T.IntegerType()),
            T.StructField("docs", T.ArrayType(id_type)),
            T.StructField("tfs", T.ArrayType(T.IntegerType())),
            T.StructField("lengths", T.ArrayType(T.IntegerType())),
        ]
    )
    place = scratch_path(spark, "bm25-index")
    kept = None
    if only is not None:
        terms = [row.term for row in only.select("term").distinct().limit(SENT_TERMS + 1).collect()]
        kept = pa.array(sorted(terms), pa.string()) if len(terms) <= SENT_TERMS else None
    own.mapInArrow(lambda batches: _blocks(batches, kept), shape).write.parquet(place)
    return SearchIndex(spark.read.schema(shape).parquet(place), id_type)


def _blocks(batches: Iterator[pa.RecordBatch], kept: pa.Array | None) -> Iterator[pa.RecordBatch]:
    block = TaskContext.get().partitionId() << 40
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK_DOCS):
            yield _block(block, batch.slice(start, BLOCK_DOCS), kept)
            block += 1


def _block(block: int, docs: pa.RecordBatch, kept: pa.Array | None) -> pa.RecordBatch:
    """The postings of a few documents, by term; with ``kept``, those of these terms."""
    texts = docs.column("words")
    lengths = np.diff(texts.offsets.to_numpy()).astype(np.int32)
    encoded = texts.flatten().dictionary_encode()
    terms, code = encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n = max(1, len(lengths))
    posted = code * n + np.repeat(np.arange(len(lengths)), lengths)
    if kept is not None:
        inside = pc.is_in(terms, value_set=kept)
        number = np.cumsum(inside.to_numpy(zero_copy_only=False)) - 1
        posted = posted[inside.to_numpy(zero_copy_only=False)[code]]
        posted = number[posted // n] * n + posted % n
        terms = terms.filter(inside)
    pairs, tf = np.unique(posted, return_counts=True)
    of_term, doc = np.divmod(pairs, n)
    first = np.concatenate([np.flatnonzero(np.diff(of_term, prepend=-1)), [len(pairs)]]).astype(np.int32)
    starts, tf, length = first[:-1], tf.astype(np.int32), lengths[doc]
    many = np.diff(first).astype(np.int64)
    most = np.maximum.reduceat(tf, starts) if len(starts) else tf
    least = np.minimum.reduceat(length, starts) if len(starts) else length
    # The last row is the block itself, without postings.
    ends = pa.array(np.append(first, first[-1]).astype(np.int32))
    lists = [
        pa.ListArray.from_arrays(ends, values) for values in (docs.column("id").take(pa.array(doc)), pa.array(tf), pa.array(length))
    ]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(many) + 1, block)),
            pa.concat_arrays([terms, pa.array([CORPUS_TERM], terms.type)]),
            pa.array(np.append(many, len(lengths))),
            pa.array(np.append(np.zeros_like(many), lengths.sum(dtype=np.int64))),
            pa.array(np.append(most, 0).astype(np.int32)),
            pa.array(np.append(least, 0).astype(np.int32)),
            *lists,
        ],
        names=["block", "term", "n", "words", "max_tf", "min_length", "docs", "tfs", "lengths"],
    )


def _gain(tf: Column, length: Column, mean_length: Column) -> Column:
    """The part of a term's score that depends on the document; grows with tf and falls with the length."""
    tf = tf.cast("double")
    return tf * F.lit(K1 + 1.0) / (tf + F.lit(K1) * (F.lit(1.0 - B) + F.lit(B) * length / mean_length))


def _totals(postings: pa.Table, needed: pa.Table, k: int, digits: int) -> pa.Table:
    """Scores of a page of queries in a part of the index, without those that are surely under a query's k best.

    ``needed`` has the terms of the queries with their weights and, with a block in place of a term, the blocks that each
    query opens. A block's gains are a matrix of terms and documents, times that of queries and terms, some terms at a time.
    """
    weight_rows, pairs = needed.filter(pc.is_valid(needed["term"])), needed.filter(pc.is_valid(needed["block"]))
    codes = lambda values, among: pc.index_in(values, value_set=among).to_numpy()
    queries, terms = pc.unique(weight_rows["query"]), pc.unique(weight_rows["term"])
    of_query, of_term, idf = codes(weight_rows["query"], queries), codes(weight_rows["term"], terms), weight_rows["idf"].to_numpy()
    postings = postings.filter(pc.is_in(postings["term"], value_set=terms)).sort_by("block").combine_chunks()
    if not postings.num_rows or not pairs.num_rows:
        return pa.table({"query": queries.slice(0, 0), "id": pc.list_flatten(postings["docs"]).slice(0, 0), "score": pa.array([], pa.float64())})
    mean = weight_rows["mean_length"][0].as_py()
    opened_block, opened_query = pairs["block"].to_numpy(), codes(pairs["query"], queries)

    block, row_term = postings["block"].to_numpy(), codes(postings["term"], terms)
    first = np.concatenate([[0], np.cumsum(pc.list_value_length(postings["docs"]).to_numpy())])
    tf, length = (pc.list_flatten(postings[n]).to_numpy() for n in ("tfs", "lengths"))
    gain = tf * (K1 + 1.0) / (tf + K1 * (1.0 - B + B * length / mean))
    ids = pc.list_flatten(postings["docs"]).combine_chunks()
    edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]]))
    found: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
    by_block = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        own = ids.slice(first[a], first[b] - first[a]).dictionary_encode()
        rows = np.sort(opened_query[opened_block == block[a]])
        by_block.append((a, b, own.indices.to_numpy(), rows, np.zeros((len(rows), len(own.dictionary))), own.dictionary))
    for low in range(0, len(terms), MATRIX_TERMS):
        inside = (of_term >= low) & (of_term < low + MATRIX_TERMS)
        weight = np.zeros((len(queries), min(MATRIX_TERMS, len(terms) - low)))
        weight[of_query[inside], of_term[inside] - low] = idf[inside]
        for a, b, doc, rows, sums, _ in by_block:
            at = np.repeat(row_term[a:b], np.diff(first[a : b + 1])) - low
            here = (at >= 0) & (at < weight.shape[1])
            used, at = np.unique(at[here], return_inverse=True)
            gains = np.zeros((len(used), sums.shape[1]))
            gains[at, doc[here]] = gain[first[a] : first[b]][here]
            sums += weight[np.ix_(rows, used)] @ gains
    for _, _, _, rows, sums, own in by_block:
        keep = sums > 0
        if sums.shape[1] > k:
            # Equal after rounding is equal: what lies a digit under the kth stays.
            keep &= sums >= np.partition(sums, -k, axis=1)[:, -k, None] - 10.0**-digits
        row, doc = np.nonzero(keep)
        found.append((rows[row], sums[row, doc], own.take(pa.array(doc))))
    return pa.table(
        {
            "query": queries.take(pa.array(np.concatenate([f[0] for f in found]))),
            "id": pa.concat_arrays([f[2] for f in found]),
            "score": np.concatenate([f[1] for f in found]),
        }
    )


@dataclass(frozen=True)
class Found:
    """``hits``: query, id, score, place. ``bounds``: query, block, bound, ``scored``, whether the block was opened."""

    hits: DataFrame
    bounds: DataFrame


def search_index(index: SearchIndex, queries: DataFrame, k: int, query_id: str, text: str, digits: int) -> Found:
    """The k best documents of each query.

    A block's bound for a query adds up what each of its terms could give at most there, from the largest tf and the
    shortest length. The blocks of the highest bounds are scored first; of the others only those are opened whose bound
    reaches the kth score found so far. Bounds are worked out from narrow columns, so postings of other blocks are not
    even read into the join.
    """
    spark = queries.sparkSession
    place = scratch_path(spark, "bm25")
    read = lambda name: spark.read.parquet(f"{place}/{name}")
    asked = queries.select(F.col(query_id).alias("query"), F.explode(F.array_distinct(words(F.col(text)))).alias("term"))
    asked.write.parquet(f"{place}/asked")
    asked = read("asked")
    corpus = index.rows.where(F.col("term") == CORPUS_TERM).agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    n_docs = corpus.select(F.col("n").cast("double")).scalar()
    mean_length = corpus.select(F.col("words").cast("double") / F.col("n").cast("double")).scalar()
    frequency = (
        index.rows.select("term", "n").join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    )
    idf = F.log(F.lit(1.0) + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked.join(frequency, "term").select("query", "term", idf.alias("idf"), mean_length.alias("mean_length")).write.parquet(f"{place}/weights")
    weights = read("weights")

    most = F.col("idf") * _gain(F.col("max_tf"), F.col("min_length"), F.col("mean_length"))
    bounds = index.rows.select("block", "term", "max_tf", "min_length").join(weights, "term")
    bounds.groupBy("query", "block").agg(F.sum(most).alias("bound")).write.parquet(f"{place}/bounds")
    bounds = read("bounds")

    pages = weights.select(F.ceil(F.count_distinct("query") / F.lit(PAGE_QUERIES)).alias("n")).scalar()

    def scored(blocks: DataFrame, name: str) -> DataFrame:
        """Each part of the index meets each page of the queries once: postings travel once a page, not once a query."""
        part, page = F.shiftright("block", PART_BITS).alias("part"), F.pmod(F.xxhash64("query"), pages).alias("page")
        pairs = blocks.select(part, page, "query", "block")
        asked_rows = pairs.select("part", "page", "query").distinct().join(weights, "query")
        rows = (
            index.rows.select("block", "term", "docs", "tfs", "lengths")
            .join(asked.select("term").distinct(), "term", "left_semi")
            .join(pairs.select("part", "page", "block").distinct(), "block")
        )
        needed = asked_rows.unionByName(pairs, allowMissingColumns=True)
        rows = rows.withColumnsRenamed({"part": "of_part", "page": "of_page"})
        sums = rows.groupBy("of_part", "of_page").cogroup(needed.groupBy("part", "page")).applyInArrow(total, total_shape)
        best(sums.select("query", "id", F.round("score", digits).alias("score"))).write.parquet(f"{place}/{name}")
        return read(name)

    total_shape = T.StructType([weights.schema["query"], T.StructField("id", index.id_type), T.StructField("score", T.DoubleType())])

    def total(postings: pa.Table, needed: pa.Table) -> pa.Table:
        return _totals(postings, needed, k, digits)

    def best(totals: DataFrame) -> DataFrame:
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("id"))
        return totals.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)

    highest = Window.partitionBy("query").orderBy(F.desc("bound"), "block")
    ranked = bounds.withColumn("rank", F.row_number().over(highest)).where(F.col("rank") <= FIRST_BLOCKS)
    first = scored(ranked, "first")
    # Scores are rounded, so a bound may lie under its own best score by half of the last digit.
    floors = first.where(F.col("place") == k).select("query", (F.col("score") - 10.0**-digits).alias("floor"))
    opened = bounds.join(ranked.select("query", "block"), ["query", "block"], "left_anti").join(floors, "query", "left")
    opened = opened.where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor")))
    opened.select("query", "block").write.parquet(f"{place}/opened")
    rest = scored(read("opened"), "rest")
    hits = best(first.drop("place").unionByName(rest.drop("place")))
    seen = ranked.select("query", "block").unionByName(read("opened")).withColumn("opened", F.lit(True))
    flagged = bounds.join(seen, ["query", "block"], "left").withColumn("scored", F.coalesce("opened", F.lit(False))).drop("opened")
    return Found(hits, flagged)


def bm25_search(
    docs: DataFrame,
    queries: DataFrame,
    k: int,
    doc_id: str = "doc_id",
    query_id: str = "query_id",
    text: str = "text",
    digits: int = 6,
) -> DataFrame:
    """``query_id, doc_id, score, place``: the k best documents of each query.

    Scores are rounded, ties go to the smaller document id. Texts are read and cut into words once, for the index.
    """
    only = queries.select(F.explode(words(F.col(text))).alias("term"))
    found = search_index(build_index(docs, doc_id, text, only), queries, k, query_id, text, digits)
    return found.hits.select(F.col("query").alias(query_id), F.col("id").alias(doc_id), "score", "place")
