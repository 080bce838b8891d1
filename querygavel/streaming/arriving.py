"""Score candidate files as they arrive."""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from querygavel.operators.class_counts import Limits
from querygavel.operators.scoring import score_candidates
from querygavel.session import scratch_path

CANDIDATES = (
    T.StructType()
    .add("candidate_id", "long")
    .add("sql", "string")
    .add("label_col", "string")
    .add("positive_value", "string")
    .add("target_rows", "string")
    .add("total_rows", "string")
)


def score_arrivals(
    spark: SparkSession,
    incoming: str,
    views: Mapping[str, DataFrame],
    output: str,
    checkpoint: str,
    files_per_batch: int = 100,
    limits: Limits = Limits(),
) -> StreamingQuery:
    """Score all parquet files in ``incoming`` that were not scored before, then stop.

    Each micro-batch owns the folder ``batch_id=…`` below ``output`` and overwrites it, so
    a batch that is repeated after a failure leaves one copy. No state is kept between
    batches.
    """

    def score_batch(batch: DataFrame, batch_id: int) -> None:
        # The batch lives in a session of its own; the written copy is read in ours.
        path = scratch_path(spark, "arrivals")
        batch.write.parquet(path)
        candidates = spark.read.schema(CANDIDATES).parquet(path)
        scored = score_candidates(
            candidates, views, blank="error", on_error="penalty", limits=limits
        )
        scored.records.drop("query_key").write.mode("overwrite").parquet(
            f"{output}/batch_id={batch_id}"
        )

    arrivals = (
        spark.readStream.schema(CANDIDATES)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(incoming)
    )
    return (
        arrivals.writeStream.foreachBatch(score_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
