"""Run candidates and count the classes in their results.

Three ways lead to the same table ``query_key, class, is_text, n``:

* conditions that compare columns with constants share one scan, by an index of their constants; so do SELECT texts
  that only filter a given table;
* other conditions over one table share scans, some dozens in one aggregate;
* other SELECT texts are planned one by one and run as one union per chunk.

Counts are written by the executors into the shared folder, never brought to the driver.
A chunk that fails is halved until the failing candidate stands alone.
"""

from __future__ import annotations

import math
import threading
import uuid
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from typing import Callable, Iterable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException, ParseException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querygavel.functions.text import quoted
from querygavel.operators import predicate_index as index
from querygavel.plans.safety import PARSE_ERROR, TextGuard, candidate_settings
from querygavel.session import scratch_path

ANALYSIS_ERROR = "analysis_error"
RUNTIME_ERROR = "runtime_error"
TIMEOUT = "timeout"

COUNTS = T.StructType(
    [
        T.StructField("query_key", T.StringType()),
        T.StructField("class", T.StringType()),
        T.StructField("is_text", T.BooleanType()),
        T.StructField("n", T.LongType()),
    ]
)
FAILURES = T.StructType(
    [T.StructField("query_key", T.StringType()), T.StructField("status", T.StringType())]
)


IS_TEXT = "typeof(class) LIKE 'string%' AS is_text"


@dataclass(frozen=True)
class Limits:
    """Sizes of the work. Only ``seconds_per_job`` can change a result: what takes longer scores as ``timeout``.

    Conditions that share a scan also share generated code. Beyond some fifty comparisons
    the JVM no longer compiles it and each row costs several times as much, hence the bound
    on their text.
    """

    queries_per_job: int = 25
    conditions_per_job: int = 48
    condition_chars_per_job: int = 800
    parallel_jobs: int = 8
    texts_per_page: int = 2000
    indexed_per_scan: int = 20_000
    seconds_per_job: float | None = None


@dataclass(frozen=True)
class Candidate:
    key: str
    text: str
    label_col: str


def count_classes(df: DataFrame, label_col: str, key: str) -> DataFrame:
    """``query_key, class, is_text, n`` of one result.

    ``is_text`` tells whether the label can equal a text value at all: the number 1 is
    not the text '1'.
    """
    counted = df.groupBy(F.col(quoted(label_col)).alias("class")).agg(F.expr("count(1) AS n"))
    return counted.selectExpr(
        f"'{key}' AS query_key", "CAST(class AS STRING) AS class", IS_TEXT, "n"
    )


def count_conditions(
    table: DataFrame, conditions: Sequence[tuple[str, str]], label_col: str
) -> DataFrame:
    """Class counts of several conditions over one table, in a single scan.

    Conditions have been parsed alone before, so in parentheses each remains one expression.
    """
    counters = ", ".join(f"count_if((\n{text}\n))" for _, text in conditions)
    keys = ", ".join(f"'{key}'" for key, _ in conditions)
    wide = table.groupBy(F.col(quoted(label_col)).alias("class")).agg(
        F.expr(f"array({counters}) AS ns")
    )
    long = wide.selectExpr("class", "posexplode(ns) AS (i, n)").where("n > 0")
    return long.selectExpr(
        f"array({keys})[i] AS query_key", "CAST(class AS STRING) AS class", IS_TEXT, "n"
    )


@contextmanager
def _deadline(spark: SparkSession, seconds: float | None) -> Iterator[threading.Event]:
    """Cancel this thread's jobs when the time is over."""
    over = threading.Event()
    if seconds is None:
        yield over
        return
    context = spark.sparkContext
    tag = f"querygavel-{uuid.uuid4().hex}"

    def cancel():
        over.set()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, cancel)
    context.addJobTag(tag)
    timer.start()
    try:
        yield over
    finally:
        timer.cancel()
        context.removeJobTag(tag)


class _Runner:
    """Writes counts below one folder and keeps book of what failed."""

    def __init__(self, spark: SparkSession, limits: Limits):
        self.spark = spark
        self.limits = limits
        self.folder = scratch_path(spark, "counts")
        self.count_paths: list[str] = []
        self.failure_paths: list[str] = []
        self._failures: list[tuple[str, str]] = []
        self._late: list[tuple] = []
        self._lock = threading.Lock()

    def fail(self, key: str, status: str) -> None:
        with self._lock:
            self._failures.append((key, status))

    def write(self, chunk: Sequence, build: Callable[[Sequence], DataFrame], alone=None) -> None:
        """Run one chunk. When it fails, those that cannot even be planned are set apart,
        and the rest runs again in halves.

        ``alone`` is another way to run a single candidate, tried before it counts as failed.
        """
        if len(chunk) == 1:
            self._write_single(chunk, build, alone)
            return
        try:
            with _deadline(self.spark, self.limits.seconds_per_job):
                self._write_counts(build(chunk).hint("rebalance"))
            return
        except AnalysisException:
            plannable = [one for one in chunk if _can_plan(build, one)]
        except Exception:  # any failure counts against some candidate of the chunk
            plannable = chunk
        if len(plannable) < len(chunk):
            for one in chunk:
                if one not in plannable:
                    self._write_single([one], build, alone)
            if plannable:
                self.write(plannable, build, alone)
        else:
            middle = len(chunk) // 2
            self.write(chunk[:middle], build, alone)
            self.write(chunk[middle:], build, alone)

    def _write_single(self, chunk: Sequence, build, alone, last: bool = False) -> None:
        """Up to two tries, since the first may have died with an executor.

        A candidate that runs out of time next to others gets its full time once more when
        the cluster is free.
        """
        way, status = alone or build, None
        for final in (False, True):
            with _deadline(self.spark, self.limits.seconds_per_job) as over:
                try:
                    self._write_counts(way(chunk))
                    return
                except Exception as error:  # a failing candidate scores, it does not stop the run
                    status = TIMEOUT if over.is_set() else _status_of(error)
                    final = final or over.is_set() or _is_data_error(error)
            if final:
                break
        if status == TIMEOUT and not last:
            with self._lock:
                self._late.append((chunk, build, alone))
        else:
            self.fail(chunk[0][0], status)

    def finish(self) -> None:
        """Give late candidates their second chance, one by one, and write down failures."""
        late, self._late = self._late, []
        for chunk, build, alone in late:
            self._write_single(chunk, build, alone, last=True)
        self.flush_failures()

    def _write_counts(self, counts: DataFrame) -> None:
        path = f"{self.folder}/counts/{uuid.uuid4().hex}"
        counts.write.parquet(path)
        with self._lock:
            self.count_paths.append(path)

    def flush_failures(self) -> None:
        if not self._failures:
            return
        path = f"{self.folder}/failures/{uuid.uuid4().hex}"
        keys, statuses = zip(*self._failures)
        failed = pa.table({"query_key": pa.array(keys), "status": pa.array(statuses)})
        self.spark.createDataFrame(failed, FAILURES).coalesce(1).write.parquet(path)
        self.failure_paths.append(path)
        self._failures = []

    def results(self) -> tuple[DataFrame, DataFrame]:
        return (
            _read_written(self.spark, self.count_paths, COUNTS),
            _read_written(self.spark, self.failure_paths, FAILURES),
        )


class _Indexed:
    """Conditions that wait for a scan by the index, by table and label."""

    def __init__(self, runner: _Runner, tables: Mapping[str, DataFrame]):
        self.runner, self.tables, self.zone = runner, tables, runner.spark.conf.get("spark.sql.session.timeZone")
        self._waiting: dict[tuple[str, str], list[tuple]] = {}
        self._labels: dict[tuple[str, str], bool] = {}
        self._lock = threading.Lock()
        self.scans = 0

    def takes(self, name: str, label_col: str) -> bool:
        with self._lock:
            if (name, label_col) not in self._labels:
                self._labels[name, label_col] = index.indexable_label(self.tables[name], label_col)
            return self._labels[name, label_col]

    def add(self, name: str, label_col: str, key: str, tree, otherwise) -> None:
        """``otherwise`` is what the other way needs, should the scan fail."""
        with self._lock:
            self._waiting.setdefault((name, label_col), []).append((key, tree, otherwise))

    def flush(self, other_way: Callable[[str, list], None], least: int = 0) -> None:
        """Count where at least ``least`` conditions wait; those that cannot be counted go the other way."""
        for (name, label_col), waiting in list(self._waiting.items()):
            if len(waiting) < least:
                continue
            del self._waiting[name, label_col]
            parts, refused = index.chunks([(key, tree) for key, tree, _ in waiting])
            left = set(refused)
            if parts:
                self.scans += 1
                try:
                    with _deadline(self.runner.spark, self.runner.limits.seconds_per_job):
                        self.runner._write_counts(index.count_indexed(self.tables[name], parts, label_col))
                except Exception:  # whatever fails together is tried in smaller parts
                    left = {key for key, _, _ in waiting}
            if left:
                other_way(label_col, [otherwise for key, _, otherwise in waiting if key in left])


def _read_written(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*paths)


def _status_of(error: Exception) -> str:
    if isinstance(error, ParseException):
        return PARSE_ERROR
    if isinstance(error, AnalysisException):
        return ANALYSIS_ERROR
    return RUNTIME_ERROR


def _is_data_error(error: Exception) -> bool:
    """True when Spark names a reason that lies in the query, not in the cluster."""
    if isinstance(error, AnalysisException):
        return True
    state = error.getSqlState() if isinstance(error, PySparkException) else None
    return bool(state) and state[:2] in ("21", "22", "42")


def _pages(rows: Iterable, size: int) -> Iterator[list]:
    page = []
    for row in rows:
        page.append(row)
        if len(page) == size:
            yield page
            page = []
    if page:
        yield page


def _can_plan(build: Callable[[Sequence], DataFrame], one) -> bool:
    try:
        build([one])
        return True
    except AnalysisException:
        return False


def _united(frames: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    return reduce(DataFrame.union, [counts for _, counts in frames])


def _share(n_texts: int, limits: Limits) -> int:
    """Texts per job: enough jobs to run side by side, none larger than allowed."""
    return max(1, min(limits.queries_per_job, math.ceil(n_texts / limits.parallel_jobs)))


def _chunks(items: Sequence, size: int) -> list[Sequence]:
    return [items[i : i + size] for i in range(0, len(items), size)]


def _candidates(distinct: DataFrame) -> Iterator[Candidate]:
    """Texts reach the driver, where Spark plans them, partition by partition."""
    for row in distinct.select("query_key", "text", "label_col").toLocalIterator():
        yield Candidate(row["query_key"], row["text"], row["label_col"])


def run_queries(
    distinct: DataFrame, views: Mapping[str, DataFrame], limits: Limits = Limits()
) -> tuple[DataFrame, DataFrame]:
    """Counts and failures of SELECT texts (``query_key, text, label_col``)."""
    spark = distinct.sparkSession
    runner = _Runner(spark, limits)
    guard = TextGuard(spark, views)
    indexed = _Indexed(runner, {name.lower(): df for name, df in views.items()})
    other_way = lambda _, plans: runner.write([(key, plan()) for key, plan in plans], _united)
    with _ONE_RUN, _own_views(spark, views):
        for page in _pages(_candidates(distinct), limits.texts_per_page):
            harmless = []
            with candidate_settings(spark):
                for candidate in _not_filters(indexed, guard, page):
                    refusal = guard.check(candidate.text)
                    if refusal:
                        runner.fail(candidate.key, refusal)
                    else:
                        harmless.append(candidate)
                jobs = [
                    lambda chunk=chunk: _count_texts(runner, indexed, chunk)
                    for chunk in _chunks(harmless, _share(len(harmless), limits))
                ]
                _run_chunks(spark, limits, jobs)
                indexed.flush(other_way, limits.indexed_per_scan)
                runner.finish()
        with candidate_settings(spark):
            indexed.flush(other_way)
            runner.finish()
    return runner.results()


def _not_filters(
    indexed: _Indexed, guard: TextGuard, page: Sequence[Candidate]
) -> list[Candidate]:
    """Hand texts that are ``select * from table where condition`` to the index; the others come back.

    Their conditions are analysed together, and no plan of their own is made.
    """
    spark, filters, taken = indexed.runner.spark, {}, set()
    for candidate in page:
        found = guard.filtered(candidate.text)
        if found and indexed.takes(found[0], candidate.label_col):
            filters.setdefault(found[0], []).append((candidate, found[1]))
    for name, group in filters.items():
        view = spark.table(quoted(name))
        column = lambda condition: F.lit(True) if condition is None else index.column_of(view, condition)
        for some in _chunks(group, index.ANALYSED_TOGETHER):
            nodes = index.analysed(view, [column(condition) for _, condition in some])
            for (candidate, condition), own in zip(some, nodes):
                try:
                    tree = index.condition_tree(own, indexed.zone) if own else None
                except index.NotIndexable:
                    continue
                if tree:
                    way = lambda c=candidate: count_classes(spark.sql(c.text), c.label_col, c.key)
                    indexed.add(name, candidate.label_col, candidate.key, tree, (candidate.key, way))
                    taken.add(candidate.key)
    return [c for c in page if c.key not in taken]


# Views and settings belong to the session, so runs in one session take turns.
_ONE_RUN = threading.RLock()


@contextmanager
def _own_views(spark: SparkSession, views: Mapping[str, DataFrame]) -> Iterator[None]:
    """The given tables by name; views of the caller with the same names come back afterwards."""
    lower = {name.lower() for name in views}
    theirs = {
        t.name: spark.table(t.name)
        for t in spark.catalog.listTables()
        if t.isTemporary and t.name.lower() in lower and not t.namespace
    }
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    try:
        yield
    finally:
        for name in views:
            spark.catalog.dropTempView(name)
        for name, df in theirs.items():
            df.createOrReplaceTempView(name)


def _count_texts(runner: _Runner, indexed: _Indexed, chunk: Sequence[Candidate]) -> None:
    """Plan the texts of a chunk; those that only filter a table wait for the index, the others run."""
    planned = []
    for candidate in chunk:
        try:
            result = runner.spark.sql(candidate.text)
            counts = count_classes(result, candidate.label_col, candidate.key)
            name, tree = index.filtered_table(result, candidate.label_col, indexed.zone)
            if name in indexed.tables and indexed.takes(name, candidate.label_col):
                indexed.add(name, candidate.label_col, candidate.key, tree, (candidate.key, lambda c=counts: c))
            else:
                planned.append((candidate.key, counts))
        except Exception as error:  # wrong text scores, it does not stop the run
            runner.fail(candidate.key, _status_of(error))
    if planned:
        runner.write(planned, _united)


def run_conditions(
    distinct: DataFrame, table: DataFrame, limits: Limits = Limits()
) -> tuple[DataFrame, DataFrame]:
    """Counts and failures of conditions (``query_key, text, label_col``) over one table."""
    spark = distinct.sparkSession
    runner = _Runner(spark, limits)
    guard = TextGuard(spark, ())
    indexed = _Indexed(runner, {"": table})
    other_way = lambda label, conditions: _run_scans(runner, table, {label: conditions})
    for page in _pages(_candidates(distinct), limits.texts_per_page):
        by_label: dict[str, list[tuple[str, str]]] = {}
        with _ONE_RUN, candidate_settings(spark):
            for candidate in _not_indexed(indexed, table, guard, page):
                refusal = guard.check_predicate(candidate.text)
                if refusal:
                    runner.fail(candidate.key, refusal)
                else:
                    by_label.setdefault(candidate.label_col, []).append(
                        (candidate.key, candidate.text)
                    )
            _run_scans(runner, table, by_label)
            indexed.flush(other_way, limits.indexed_per_scan)
            runner.finish()
    with _ONE_RUN, candidate_settings(spark):
        indexed.flush(other_way)
        runner.finish()
    return runner.results()


def _not_indexed(
    indexed: _Indexed, table: DataFrame, guard: TextGuard, page: Sequence[Candidate]
) -> list[Candidate]:
    """Hand conditions that the index takes to it; the others come back."""
    fit = [c for c in page if indexed.takes("", c.label_col)]
    fit = [c for c in fit if guard.is_plain(c.text) or not guard.check_predicate(c.text)]
    taken = set()
    for some in _chunks(fit, index.ANALYSED_TOGETHER):
        for candidate, nodes in zip(some, index.analysed(table, [c.text for c in some])):
            try:
                tree = index.condition_tree(nodes, indexed.zone) if nodes else None
            except index.NotIndexable:
                continue
            if tree:
                indexed.add("", candidate.label_col, candidate.key, tree, (candidate.key, candidate.text))
                taken.add(candidate.key)
    return [c for c in page if c.key not in taken]


def _run_scans(runner: _Runner, table: DataFrame, by_label: Mapping[str, list]) -> None:
    """Conditions ``(key, text)`` of each label in scans of some dozens."""
    jobs = []
    for label, conditions in by_label.items():
        shared = lambda chunk, label=label: count_conditions(table, chunk, label)
        # A condition that does not fit into an aggregate may still work as a filter.
        single = lambda chunk, label=label: count_classes(
            table.where(F.expr(chunk[0][1])), label, chunk[0][0]
        )
        jobs += [
            lambda chunk=chunk, shared=shared, single=single: runner.write(chunk, shared, single)
            for chunk in _scan_chunks(conditions, runner.limits)
        ]
    _run_chunks(runner.spark, runner.limits, jobs)


def _scan_chunks(conditions: Sequence[tuple[str, str]], limits: Limits) -> Iterator[list]:
    """Conditions that share a scan: bounded in number and in length together."""
    chunk, chars = [], 0
    for key, text in conditions:
        full = len(chunk) == limits.conditions_per_job
        if chunk and (full or chars + len(text) > limits.condition_chars_per_job):
            yield chunk
            chunk, chars = [], 0
        chunk.append((key, text))
        chars += len(text)
    if chunk:
        yield chunk


def _run_chunks(spark: SparkSession, limits: Limits, jobs: Sequence[Callable[[], None]]) -> None:
    """Several chunks at once, so that small jobs do not leave the cluster idle."""
    if len(jobs) <= 1 or limits.parallel_jobs <= 1:
        for job in jobs:
            job()
        return
    with ThreadPoolExecutor(max_workers=limits.parallel_jobs) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
        for future in running:
            future.result()
