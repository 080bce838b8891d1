"""A corpus made ready for training: toxic documents and copies go, repeated passages are cut, the rest is packed."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querygavel.llm import toxicity as tox
from querygavel.llm.common import Scratch, documents, free_name
from querygavel.llm.exact_dedup import exact_groups
from querygavel.llm.packing import pack
from querygavel.llm.suffix_dedup import cut_texts
from querygavel.llm.super_minhash import near_groups

#: Bytes of each memory of the packing encoder: its workers live in executors that the stages before have filled.
MEMO_BYTES = 32 << 20
_scratch: list[Scratch] = []


def _new_scratch(spark: SparkSession) -> Scratch:
    """Scratch for one stage. That of the stage before goes: its result has been written by then."""
    for old in _scratch:
        if old.spark is spark:
            old.drop()
    _scratch[:] = [Scratch(spark)]
    return _scratch[0]


def _only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The documents whose doc_id is in ``kept``, each once.

    Rows that repeat a doc_id and its text are one document. Documents without a doc_id cannot be named in ``kept``: they
    stay, once for each text.
    """
    keyed = docs.withColumns(
        {"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "__text": F.xxhash64(F.coalesce("text", F.lit("")))}
    )
    ids = kept.select(F.col("doc_id").alias("__id")).where("__id IS NOT NULL").distinct()
    none = docs.sparkSession.createDataFrame([(-(1 << 63),)], "__id bigint")
    copy = F.row_number().over(Window.partitionBy("__id", "__text").orderBy("__text"))
    found = keyed.join(ids.unionByName(none).hint("merge"), "__id", "left_semi").withColumn("__copy", copy).where("__copy = 1")
    return found.select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is 0.5 or more go. Null and empty texts stay, as all others do."""
    _new_scratch(spark)
    model = tox.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = free_name("toxicity", docs.columns)
    return tox.with_score(docs, model, score).where(f"{score} < 0.5").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same text but for white space, the one of the smallest doc_id stays."""
    return _only(docs, exact_groups(docs, _new_scratch(spark)).where("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 80 % of their five-word shingles, the one of the smallest doc_id stays."""
    return _only(docs, near_groups(docs, _new_scratch(spark), k=5, percent=80).where("kept"))


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur twice or more go from all texts; characters that are cut in part stay.

    A passage is a run of bytes of repeated 200-byte strings, if it has 400 bytes or over 50 whole words. So all bytes of
    repeated 400-byte strings go.
    All documents stay, also those without any text left; n_chars is that of the new text. Texts without repeated bytes
    stay as they are, null included.
    """
    return cut_texts(docs, _new_scratch(spark), length=200, over_words=50).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset: documents in sequences of 2,048 tokens."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return pack(docs, _new_scratch(spark), path, 0, {"ids_crc32": F.crc32("ids")}, memo_bytes=MEMO_BYTES)


#: Each stage's result is to be written before the next stage is called.
STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", cut_passages),
    ("packing", pack_sequences),
]

#: SQL expresses neither the trained classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    kept, docs = Scratch(spark), documents(spark, sf_dir)
    for name, stage in STAGES:
        following = kept.table(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if docs is not None and len(kept.paths) > 1:
            kept.drop(docs)
        docs = following
    return docs
