"""Helpers shared by the operators: tables, scratch tables, Arrow batches, byte hashes."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from querygavel.session import scratch_path

#: Bytes that separate words in every operator that speaks of words: [\x20\x09-\x0D].
SPACES = b" \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


class Scratch:
    """Tables below the shared folder that live as long as a result needs them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def table(self, df: DataFrame, purpose: str, *partition_by: str, codec: str = "snappy") -> DataFrame:
        """Write ``df`` and read it back: its lineage ends in files that outlive any executor."""
        path = scratch_path(self.spark, purpose)
        self.paths.append(path)
        df.write.partitionBy(*partition_by).parquet(path, compression=codec)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, table: DataFrame | None = None) -> None:
        """Delete the given table, or all of them."""
        gone = self.paths if table is None else [p for p in self.paths if any(p in f for f in table.inputFiles()[:1])]
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in list(gone):
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)
            self.paths.remove(path)


def give_back() -> None:
    """Hand unused memory of this process back to the system; workers live on after a task and share their machine."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # only where the C library can


#: What workers keep from task to task, by the name of the function that makes it.
_remembered: dict[str, Callable] = {}


def remembered(maxsize: int) -> Callable[[Callable], Callable]:
    """Like ``lru_cache``, but workers forget the results when they turn to the task of an operator without them."""

    def wrap(make: Callable) -> Callable:
        cached = lru_cache(maxsize=maxsize)(make)
        _remembered[make.__name__] = cached
        return cached

    return wrap


def forget(keeps: str | None = None) -> None:
    """Drop what this process remembers, but for the results of the function named ``keeps``."""
    gone = [cached for name, cached in _remembered.items() if name != keeps and cached.cache_info().currsize]
    for cached in gone:
        cached.cache_clear()
    if gone:
        # Encoders and what they remember refer to each other.
        gc.collect()
        give_back()


def frugal(run: Callable[..., Iterator[pa.RecordBatch]], keeps: str | None = None) -> Callable[..., Iterator[pa.RecordBatch]]:
    """A function over batches that gives memory back when its task ends, and before it what other operators remember;
    ``keeps`` names the function whose ``remembered`` results it uses."""

    @wraps(run)
    def wrapped(*args, **kwargs):
        forget(keeps)
        try:
            yield from run(*args, **kwargs)
        finally:
            give_back()

    return wrapped


#: Groups of at least this size give memory back when they are done.
LARGE_GROUP = 8 << 20


def frugal_group(run: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """The same for a function over the table of one group."""

    def wrapped(group):
        try:
            return run(group)
        finally:
            if group.nbytes >= LARGE_GROUP:
                give_back()

    return wrapped


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores before it until it differs from all names taken; case does not matter."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name


def strings(batch: pa.RecordBatch, name: str) -> list[str | None]:
    return batch.column(name).to_pylist()


def record_batch(schema: pa.Schema, columns: dict[str, object]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def slices(rows: Iterator[dict], schema: pa.Schema, most_bytes: int = 8 << 20, size=len) -> Iterator[pa.RecordBatch]:
    """Pack rows into batches of bounded size; ``size`` measures a row."""
    held: list[dict] = []
    total = 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total >= most_bytes or len(held) >= 10_000:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


# --- polynomial prefix hashes over bytes, modulo 2^64 ---

_BASE = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=4)
def byte_values(seed: int) -> np.ndarray:
    """A fixed random 64-bit value for each byte."""
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64)


_powers: dict[int, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """base^0 .. base^(n-1); the base is odd, so it has an inverse modulo 2^64."""
    have = _powers.get(inverse)
    if have is None or len(have) < n:
        base = np.uint64(pow(int(_BASE), -1, 1 << 64)) if inverse else _BASE
        size = 1 << max(16, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            have = np.cumprod(factors, dtype=np.uint64)
        _powers[inverse] = have
    return have[:n]


def prefix_hashes(data: np.ndarray, seed: int = 7) -> np.ndarray:
    """H with H[i] = sum of value(byte k) * base^k over k < i, so equal stretches have equal scaled differences."""
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(byte_values(seed)[data] * powers(len(data)), out=out[1:])
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
