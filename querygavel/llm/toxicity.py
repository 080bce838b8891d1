"""Toxicity by compression distance: zstandard with a dictionary of ordinary text against one of toxic text.

Text is cut into short windows. A window that the toxic dictionary compresses into fewer bytes than the ordinary one
speaks for toxicity; four sums of these differences are turned into a probability, calibrated on documents that neither
dictionary was trained on.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querygavel.llm.common import documents, frugal, strings

#: Bounds of the training sample: documents of each class, and bytes of one document. They bound what the driver holds.
SAMPLE_DOCS = 1500
SAMPLE_BYTES = 32_768
WINDOW = 64
LEVEL = 3
TOXIC_BYTES = 4096
ORDINARY_BYTES = 32_768
GRAM = 5
#: Every third sampled document calibrates; the others train the dictionaries.
CALIBRATE = 3


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8").split()


def windows(parts: list[bytes]) -> list[bytes]:
    """The words in stretches of at least WINDOW bytes, each word whole unless it is longer than a window."""
    data = b" " + b" ".join(parts) if parts else b""
    out, at, n = [], 0, len(data)
    while at < n:
        end = at + WINDOW
        if end < n:
            space = data.find(b" ", end, end + WINDOW)
            end = space if space >= 0 else end + WINDOW
        out.append(data[at:end])
        at = end
    return out


def _grams(word: bytes) -> set[bytes]:
    word = b" " + word
    return {word[k : k + GRAM] for k in range(max(1, len(word) - GRAM + 1))}


def _document_counts(docs: list[list[bytes]]) -> Counter:
    counts: Counter = Counter()
    for parts in docs:
        counts.update(set().union(*map(_grams, set(parts))))
    return counts


def marked_grams(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> set[bytes]:
    """Parts of words that are much more common in toxic documents: by a test of proportions and their ratio."""
    a, b, na, nb = _document_counts(toxic), _document_counts(ordinary), max(1, len(toxic)), max(1, len(ordinary))
    found = set()
    for gram, k in a.items():
        pa_, pb = k / na, b[gram] / nb
        both = (k + b[gram]) / (na + nb)
        spread = (both * (1 - both) * (1 / na + 1 / nb)) ** 0.5
        if k >= 3 and pa_ > 20 * pb and pa_ - pb > min(4, 1 + na / 100) * spread:
            found.add(gram)
    return found


def distilled(parts: list[bytes], marked: set[bytes]) -> bytes:
    """What of a toxic document sets it apart: of each word, the stretch of marked parts."""
    out = []
    for word in parts:
        data = b" " + word
        here = [k for k in range(max(1, len(data) - GRAM + 1)) if data[k : k + GRAM] in marked]
        if here:
            first, last = here[0], here[0]
            while last + 1 in here:
                last += 1
            out.append(data[0 if first <= 1 else first : last + GRAM])
    return b"".join(out)


def trained(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary of the samples; where they are too few to train on, their last bytes."""
    samples = [s for s in samples if len(s) >= 8]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(
        level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False
    )


class Model(NamedTuple):
    """The two dictionaries and the calibration; ``scale`` and ``weights`` are for the four sums, the last is constant."""

    toxic: bytes
    ordinary: bytes
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]

    def distances(self):
        """A function from words to sums of the differences of their windows.

        Both compressors end with the ordinary dictionary, so windows without toxic stretches come out alike; in
        place of the toxic one, the ordinary compressor has as many empty bytes before it.
        """
        ordinary = _compressor(bytes(len(self.toxic)) + self.ordinary)
        toxic = _compressor(self.toxic + self.ordinary)

        def sums(parts: list[bytes]) -> list[float]:
            d = sorted((len(ordinary.compress(w)) - len(toxic.compress(w)) for w in windows(parts)), reverse=True)
            if not d:
                return [0.0, 0.0, 0.0, 0.0]
            gains = sum(x for x in d if x > 0)
            return [float(gains / len(d)) ** 0.5, float(min(d[0], 16)), float(min(d[min(1, len(d) - 1)], 16)), sum(d) / len(d)]

        return sums

    def score(self, sums: np.ndarray) -> np.ndarray:
        z = (sums - np.array(self.mean)) / np.array(self.scale) @ np.array(self.weights[:-1]) + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _calibrated(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton steps with a small ridge."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    data = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(data.shape[1])
    ridge = np.diag([0.05 * weight.sum() / 100] * (len(w) - 1) + [1e-6])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(data @ w, -30, 30)))
        gradient = data.T @ (weight * (y - p)) - ridge @ w
        w = w + np.linalg.solve(data.T @ (data * (weight * p * (1 - p))[:, None]) + ridge + 1e-9 * np.eye(len(w)), gradient)
    return mean, scale, w


def fit(sample: list[tuple[str, int]], totals: dict[int, int]) -> Model:
    """A model from sampled (text, label) rows, weighted to the ``totals`` of the classes."""
    by = {k: [words(t) for t, label in sample if label == k] for k in (0, 1)}
    train = {k: [d for i, d in enumerate(v) if i % CALIBRATE] for k, v in by.items()}
    rest = {k: [d for i, d in enumerate(v) if i % CALIBRATE == 0] for k, v in by.items()}
    marked = marked_grams(train[1], train[0])
    model = Model(
        trained([distilled(d, marked) for d in train[1]], TOXIC_BYTES),
        trained([b" ".join(d) for d in train[0]], ORDINARY_BYTES),
        (0.0,) * 4,
        (1.0,) * 4,
        (0.0,) * 4 + (-4.0,),
    )
    if not rest[1] or not rest[0]:
        return model
    sums = model.distances()
    x = np.array([sums(d) for k in (0, 1) for d in rest[k]])
    y = np.repeat([0.0, 1.0], [len(rest[0]), len(rest[1])])
    weight = np.repeat([totals.get(k, 1) / len(rest[k]) for k in (0, 1)], [len(rest[0]), len(rest[1])])
    mean, scale, w = _calibrated(x, y, weight * len(x) / weight.sum())
    return model._replace(mean=tuple(mean), scale=tuple(scale), weights=tuple(w))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on a bounded sample of labelled documents whose crc32(doc_id) mod 5 is not 0.

    Of each class, SAMPLE_DOCS documents of at most SAMPLE_BYTES in the order of a hash of their id; a document with
    several labels counts as toxic if one says so. Labels or doc_ids that are null are passed over. Without both
    classes, every text gets the same low score.
    """
    held_in = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    totals = {r.toxic: r["count"] for r in held_in.groupBy("toxic").count().collect()}
    short = docs.select("doc_id", "text").where(F.octet_length("text") <= SAMPLE_BYTES)
    # Only ids of documents that can be sampled; 3,000 at most, so the driver and a broadcast can hold them.
    there = held_in.join(short.select("doc_id"), "doc_id", "left_semi")
    ids = [there.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS) for k in (0, 1)]
    chosen = F.broadcast(ids[0].unionByName(ids[1]))
    found = (
        short.join(chosen, "doc_id")
        .select(F.xxhash64("doc_id").alias("h"), "doc_id", "text", "toxic")
    )
    sample = [
        (r.text, r.toxic)
        for k in (0, 1)
        for r in found.where(F.col("toxic") == k).orderBy("h", "doc_id").limit(SAMPLE_DOCS).collect()
    ]
    return fit(sample, totals)


def _scored(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = model.distances()
    for batch in batches:
        x = np.array([sums(words(t)) for t in strings(batch, "text")]).reshape(-1, 4)
        ids = batch.column("doc_id")
        held = [None if i is None else zlib.crc32(str(i).encode()) % 5 == 0 for i in ids.to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [ids.cast(pa.int64()), pa.array(held, pa.bool_()), pa.array(model.score(x), pa.float64())],
            ["doc_id", "held_out", "score"],
        )


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row, from its whole text alone.

    A null or empty text has no windows and gets the score of no differences. Repeated rows get equal scores; a null
    doc_id has a null held_out. Other columns are left out.
    """
    return (
        docs.select("doc_id", "text")
        .mapInArrow(frugal(lambda it: _scored(model, it)), "doc_id bigint, held_out boolean, score double")
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    )


def with_score(docs: DataFrame, model: Model, name: str = "toxicity") -> DataFrame:
    """The rows of docs, all columns kept, with ``toxicity``, or ``name``, added (replacing a column of that name)."""
    docs = docs.drop(name)

    def run(batches):
        sums = model.distances()
        for batch in batches:
            x = np.array([sums(words(t)) for t in strings(batch, "text")]).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x))], [*batch.schema.names, name])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    return docs.mapInArrow(frugal(run), ", ".join([*kinds, f"`{name}` double"]))


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
