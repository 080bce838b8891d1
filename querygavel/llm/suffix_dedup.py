"""Repeated passages by a suffix sort: every byte of a 400-byte string that starts anywhere else is found; callers may
ask for another length, and the numbers below scale with it.

Strings are brought together by what any two equal ones share. Each string has an anchor, its 32-byte gram of the least
hash; strings with the same anchor and nearly the same distance to it form a slice, and all strings of a slice hold one
core of 273 bytes. Only cores that occur twice matter; their slices are gathered by core, and the strings in them sorted
as suffixes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querygavel.llm.common import SPACES, Scratch, documents, free_name, frugal, mixed, powers, prefix_hashes, record_batch, slices, strings
from querygavel.llm.suffix_sort import repeated

LENGTH, GRAM = 400, 32
#: Passages are sought by strings of this length; shorter ones than LENGTH count if they have more whole words than this.
PASSAGE, OVER_WORDS = 200, 50
#: A core with more occurrences than this has its strings dealt one by one, by their own hashes.
HOT = 1500
_CHUNK_BYTES = 2 << 20
#: Strings of hot cores that are compared at once before they go on.
_HOT_STRINGS = 1 << 20


def slice_size(length: int) -> int:
    """Most strings of a slice, 128 for 400 bytes; their core is as much shorter than they are, less one byte."""
    return length * 8 // 25


def cut_slices(data: np.ndarray, sums: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """first and last start of the strings of each slice, the start of its core, and the hash of the core."""
    n, most = len(data), slice_size(length)
    held = length - most + 1
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    inverse = powers(n, inverse=True)
    with np.errstate(over="ignore"):
        grams = mixed((sums[GRAM:] - sums[:-GRAM]) * inverse[: n - GRAM + 1])
    bits = np.uint64(max(24, n.bit_length()))
    low = np.uint64((1 << int(bits)) - 1)
    ranked = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    span, width = length - GRAM + 1, 1
    while 2 * width <= span:
        ranked = np.minimum(ranked[:-width], ranked[width:])
        width *= 2
    ranked = np.minimum(ranked[: n - length + 1], ranked[span - width : span - width + n - length + 1])
    anchor = (ranked & low).astype(np.int64)
    part = (anchor - np.arange(len(anchor))) // most
    change = np.flatnonzero((anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])) + 1
    first = np.concatenate([[0], change])
    last = np.concatenate([change, [len(anchor)]]) - 1
    core = anchor[first] - part[first] * most
    with np.errstate(over="ignore"):
        key = mixed((sums[core + held] - sums[core]) * inverse[core] + part[first].astype(np.uint64))
    return first, last, core, key


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8"), np.uint8)


_ASKED = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("known", pa.bool_()), ("entries", pa.binary())])
#: ``n`` counts the core's occurrences in the chunk: where it is 1, the entry has an owner.
_ENTRY = np.dtype([("key", "<u8"), ("doc", "<i8"), ("text", "<i8"), ("n", "<i8")])


def _asked(batches: Iterator[pa.RecordBatch], buckets: int, length: int = LENGTH) -> Iterator[pa.RecordBatch]:
    """Cores of a chunk of documents, dealt by their hash. What repeats within the chunk is known to repeat: of such a
    core one entry without an owner goes on, with their number; its owners travel with the number of the chunk."""
    task = TaskContext.get().partitionId() << 24

    def packed(held: list[np.ndarray], number: int):
        all_ = np.concatenate(held)
        all_ = all_[np.argsort(all_["key"], kind="stable")]
        new = np.concatenate([[True], all_["key"][1:] != all_["key"][:-1]])
        alone = new & np.concatenate([new[1:], [True]])
        known = all_[~alone]
        if len(known):
            # Numbers of chunks differ by multiples of 2^24, so a plain remainder would bring many of them together.
            bucket = int(mixed(np.array([number], np.uint64))[0] % np.uint64(buckets))
            yield {"bucket": bucket, "chunk": number, "known": True, "entries": known.tobytes()}
        asked = all_[new].copy()
        asked["n"] = np.diff(np.append(np.flatnonzero(new), len(all_)))
        bucket = asked["key"] % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        asked, bucket = asked[order], bucket[order]
        edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            yield {"bucket": int(bucket[a]), "chunk": number, "known": False, "entries": asked[a:b].tobytes()}

    def rows():
        held, total, number = [], 0, task
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "text")]
            for doc_id, text_hash, text in zip(*columns, strict=True):
                data = _bytes(text)
                if len(data) >= length:
                    key = cut_slices(data, prefix_hashes(data), length)[3]
                    entries = np.zeros(len(key), _ENTRY)
                    entries["key"], entries["doc"], entries["text"], entries["n"] = key, doc_id, text_hash, 1
                    held.append(entries)
                    total += len(data)
                if total > _CHUNK_BYTES:
                    yield from packed(held, number)
                    held, total, number = [], 0, number + 1
        if held:
            yield from packed(held, number)

    yield from slices(rows(), _ASKED, size=lambda r: len(r["entries"]))


#: kind 0: an owner with its repeated cores, those that are hot apart; 1: the owners a chunk knows of; 2: the hot cores
#: among those that a chunk knows of. What belongs together has the same number.
_ANSWER = {"number": pa.int64(), "kind": pa.int32(), "doc_id": pa.int64(), "text_hash": pa.int64(), "keys": pa.binary(), "hot": pa.binary()}
_ANSWER_DDL = "number bigint, kind int, doc_id bigint, text_hash bigint, keys binary, hot binary"


def _answer_table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(_ANSWER)
    return pa.table({n: pa.array(c, t) for (n, t), c in zip(_ANSWER.items(), columns, strict=True)})


def _by_owner(hits: np.ndarray, hot: np.ndarray) -> list[tuple]:
    order = np.lexsort((hits["text"], hits["doc"]))
    hits, hot = hits[order], hot[order]
    new = (hits["doc"][1:] != hits["doc"][:-1]) | (hits["text"][1:] != hits["text"][:-1])
    edge = np.flatnonzero(np.concatenate([[True], new, [True]])) if len(hits) else np.zeros(0, np.int64)
    rows = []
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        keys, doc = hits["key"][a:b], int(hits["doc"][a])
        # Answers are spread by their owner, below the numbers of chunks.
        rows.append((-1 - hash((doc, 1)) % 65536, 0, doc, int(hits["text"][a]), keys.tobytes(), keys[hot[a:b]].tobytes()))
    return rows


def _answered(group):
    """Owners of cores that occur in two chunks at least; to each chunk, which of the cores it knows of are hot. A core is
    hot by its occurrences in all chunks together."""
    rows, asked, chunks = [], [], []
    columns = [group.column(c).to_pylist() for c in ("known", "chunk", "entries")]
    for known, chunk, data in zip(*columns, strict=True):
        if known:
            rows.append((chunk, 1, None, None, data, None))
        else:
            asked.append(np.frombuffer(data, _ENTRY))
            chunks.append(np.full(len(asked[-1]), chunk))
    if asked:
        all_, chunk = np.concatenate(asked), np.concatenate(chunks)
        order = np.argsort(all_["key"], kind="stable")
        all_, chunk = all_[order], chunk[order]
        edge = np.flatnonzero(np.concatenate([[True], all_["key"][1:] != all_["key"][:-1], [True]]))
        count = np.repeat(np.add.reduceat(all_["n"], edge[:-1]), np.diff(edge))
        found = (count > 1) & (all_["n"] == 1)
        rows += _by_owner(all_[found], count[found] > HOT)
        told = np.flatnonzero((count > HOT) & (all_["n"] > 1))
        told = told[np.argsort(chunk[told], kind="stable")]
        for part in np.split(told, np.flatnonzero(np.diff(chunk[told])) + 1):
            if len(part):
                rows.append((int(chunk[part[0]]), 2, None, None, all_["key"][part].tobytes(), None))
    return _answer_table(rows)


def _resolved(group):
    """Owners that their chunks know of, with what the chunk was told about its cores; other answers as they are."""
    rows = [tuple(r[n] for n in _ANSWER) for r in group.to_pylist()]
    hot = np.frombuffer(b"".join(r[4] for r in rows if r[1] == 2), "<u8")
    out = [r for r in rows if r[1] == 0]
    for r in rows:
        if r[1] == 1:
            known = np.frombuffer(r[4], _ENTRY)
            out += _by_owner(known, np.isin(known["key"], hot))
    return _answer_table(out)


def _columns(rows: Iterator[tuple], schema: pa.Schema, size, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Pack tuples in the schema's order into batches of bounded size."""
    held, total = [], 0

    def batch():
        return record_batch(schema, dict(zip(schema.names, zip(*held, strict=True), strict=True)))

    for row in rows:
        held.append(row)
        total += size(row)
        if total >= most_bytes or len(held) >= 10_000:
            yield batch()
            held, total = [], 0
    if held:
        yield batch()


#: kind 0: bytes known to repeat; 1: a slice with its bytes; 2: one string of a hot core, by two hashes.
_FOUND = pa.schema(
    [
        ("kind", pa.int32()),
        ("doc_id", pa.int64()),
        ("text_hash", pa.int64()),
        ("start", pa.int64()),
        ("stop", pa.int64()),
        ("key", pa.int64()),
        ("other", pa.int64()),
        ("data", pa.binary()),
    ]
)
_FOUND_DDL = (
    "kind int, doc_id bigint, text_hash bigint, start bigint, stop bigint, key bigint, other bigint, data binary"
)


def _gathered(batches: Iterator[pa.RecordBatch], length: int = LENGTH) -> Iterator[pa.RecordBatch]:
    """The slices of repeated cores with their bytes. Slices that are the same within a batch are known to repeat; one of
    them goes on without an owner, so that others can still be compared with it. So do the strings of hot cores."""

    def row(kind, doc_id, text_hash, start, stop, key=0, other=0, data=None):
        return kind, doc_id, text_hash, start, stop, key, other, data

    def single(held: list[tuple], settled_spans: dict[tuple, list[tuple]]):
        """Strings of hot cores: slices as (doc_id, text_hash, start, hashes); doc_id null where settled."""
        many = [len(h[3]) for h in held]
        pairs = np.concatenate([h[3] for h in held])
        owner = np.repeat(np.arange(len(held)), many)
        settled = np.array([h[0] is None for h in held])[owner]
        order = np.lexsort((pairs[:, 1], pairs[:, 0]))
        edge = np.flatnonzero(np.concatenate([[True], (np.diff(pairs[order], axis=0) != 0).any(axis=1), [True]]))
        twice = np.zeros(len(pairs), bool)
        twice[order] = np.repeat(np.diff(edge) > 1, np.diff(edge))
        at = np.concatenate([[0], np.cumsum(many)]).tolist()
        for i, (doc_id, text_hash, start, _) in enumerate(held):
            if doc_id is not None:
                settled_spans.setdefault((doc_id, text_hash), []).extend(_spans(twice[at[i] : at[i + 1]], start, length))
        for i in order[edge[:-1]].tolist():
            doc_id, text_hash, start, _ = held[owner[i]]
            start += i - at[owner[i]]
            one, two = pairs[i].tolist()
            yield row(2, None if twice[i] or settled[i] else doc_id, text_hash, start, start + length, one, two)

    def rows():
        for batch in batches:
            held, total = [], 0
            same: dict[tuple, list[tuple]] = {}
            settled_spans: dict[tuple, list[tuple]] = {}
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "text", "keys", "hot")]
            for doc_id, text_hash, text, keys, hot in zip(*columns, strict=True):
                data = _bytes(text)
                sums = prefix_hashes(data)
                first, last, core, key = cut_slices(data, sums, length)
                wanted = np.isin(key, np.frombuffer(b"".join(keys), "<u8"))
                hot_keys = set(np.frombuffer(b"".join(hot), "<u8").tolist())
                raw = data.tobytes()
                for a, b, c, k in zip(*[x[wanted].tolist() for x in (first, last, core, key)], strict=True):
                    same.setdefault((k, a - c, raw[a : b + length]), []).append((doc_id, text_hash, a, b, k in hot_keys))
            for (k, shift, content), owners in same.items():
                signed, many = k - (1 << 63), len(owners) > 1
                if many:
                    for doc_id, text_hash, a, b, _ in owners:
                        settled_spans.setdefault((doc_id, text_hash), []).append((a, b + length))
                doc_id, text_hash, a, b, is_hot = owners[0]
                if not is_hot:
                    # ``stop`` is the first string's place against the core; the owner is left out when settled.
                    yield row(1, None if many else doc_id, text_hash, a, shift, signed, 0, content)
                    continue
                held.append((None if many else doc_id, text_hash, a, np.column_stack(_string_hashes(content, length))))
                total += b - a + 1
                if total > _HOT_STRINGS:
                    yield from single(held, settled_spans)
                    held, total = [], 0
            if held:
                yield from single(held, settled_spans)
            for owner, spans in settled_spans.items():
                for a, b in _runs(spans):
                    yield row(0, *owner, a, b)

    yield from _columns(rows(), _FOUND, size=lambda r: 64 + len(r[-1] or b""))


def _runs(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that touch as one; in order."""
    runs: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if runs and a <= runs[-1][1]:
            runs[-1] = runs[-1][0], max(b, runs[-1][1])
        else:
            runs.append((a, b))
    return runs


def _string_hashes(content: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each string in the bytes."""
    data = np.frombuffer(content, np.uint8)
    out = []
    for seed in (7, 23):
        sums = prefix_hashes(data, seed)
        with np.errstate(over="ignore"):
            out.append(mixed((sums[length:] - sums[:-length]) * powers(len(data), inverse=True)[: len(data) - length + 1]))
    return out[0].view(np.int64), out[1].view(np.int64)


def _spans(hit: np.ndarray, start: int, length: int) -> list[tuple[int, int]]:
    """Bytes covered by the strings that are hit."""
    at = np.flatnonzero(hit)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > length)
    return [(start + int(a), start + int(b) + length) for a, b in zip(at[np.r_[0, cut + 1]], at[np.r_[cut, len(at) - 1]], strict=True)]


_SPAN = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])


def _sorted(batches: Iterator[pa.RecordBatch], length: int = LENGTH) -> Iterator[pa.RecordBatch]:
    """Sort the strings of slices that share a core, some cores at a time, and tell which are repeated. Of equal slices,
    whose strings all are, one goes into the sort, if its core has others."""
    most = slice_size(length)

    def solved(held: dict[tuple, list[tuple]]):
        cores = Counter(key for key, _, _ in held)
        left = []
        for (key, shift, content), owners in held.items():
            if len(owners) > 1:
                for doc_id, text_hash, start in owners:
                    if doc_id is not None:
                        yield doc_id, text_hash, start, start + len(content)
            if cores[key] > 1:
                left.append((key, shift, content, owners[0] if len(owners) == 1 else (None, None, None)))
        if not left:
            return
        sizes = np.array([len(content) for _, _, content, _ in left])
        at = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        data = np.frombuffer(b"".join([content for _, _, content, _ in left]), np.uint8)
        many = sizes - length + 1
        owner = np.repeat(np.arange(len(left)), many)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        shift = np.array([shift for _, shift, _, _ in left])[owner] + within + most
        number = np.unique(np.array([key for key, _, _, _ in left]), return_inverse=True)[1]
        segment = number[owner].astype(np.int64) * (2 * most) + shift
        order = np.argsort(segment, kind="stable")
        segment = segment[order]
        twice = np.zeros(len(segment), bool)
        twice[1:] = segment[1:] == segment[:-1]
        twice[:-1] |= twice[1:]
        order, segment = order[twice], segment[twice]
        hit = np.zeros(len(owner), bool)
        hit[order] = repeated(data, (at[owner] + within)[order], segment, length)
        edge = np.cumsum(many)
        for i, (_, _, _, (doc_id, text_hash, start)) in enumerate(left):
            if doc_id is not None:
                for a, b in _spans(hit[edge[i] - many[i] : edge[i]], start, length):
                    yield doc_id, text_hash, a, b

    def rows():
        held: dict[tuple, list[tuple]] = {}
        total, last = 0, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "stop", "data", "doc_id", "text_hash", "start")]
            for key, shift, content, *owner in zip(*columns, strict=True):
                if total > _CHUNK_BYTES and key != last:
                    yield from solved(held)
                    held, total = {}, 0
                last = key
                owners = held.get((key, shift, content))
                if owners is None:
                    owners = held[key, shift, content] = []
                    total += len(content)
                owners.append(tuple(owner))
                total += 16
        if held:
            yield from solved(held)

    yield from _columns(rows(), _SPAN, size=lambda r: 64)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id (the least number for null), text (null as empty) and a hash of the text: together they name a row."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"),
        text.alias("text"),
        F.xxhash64(text).alias("text_hash"),
    )


def repeated_spans(docs: DataFrame, scratch: Scratch, length: int = LENGTH) -> DataFrame:
    """doc_id, text_hash, spans: for each row with repeated bytes, its maximal runs of them as (start, stop).

    A byte is repeated if it lies in a 400-byte string that also starts anywhere else in the table, in the same text or
    another; texts are UTF-8, null is empty, and texts under 400 bytes have none. Rows with equal doc_id and text share
    one result, and repeat each other. doc_id null shows as the least 64-bit number. All this holds for another ``length``
    from 100 on too.
    """
    if length < 100:
        raise ValueError("length must be 100 or more")
    keyed = _keyed(docs)
    buckets = 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    long = keyed.where(F.octet_length("text") >= length)
    answers = scratch.table(
        long.mapInArrow(frugal(lambda it: _asked(it, buckets, length)), "bucket int, chunk bigint, known boolean, entries binary")
        .groupBy("bucket")
        .applyInArrow(_answered, _ANSWER_DDL)
        .groupBy("number")
        .applyInArrow(_resolved, _ANSWER_DDL)
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_list("keys").alias("keys"), F.collect_list("hot").alias("hot")),
        "repeated-cores",
    )
    found = scratch.table(
        long.join(answers.hint("merge"), ["doc_id", "text_hash"])
        .select("doc_id", "text_hash", "text", "keys", "hot")
        .mapInArrow(frugal(lambda it: _gathered(it, length)), _FOUND_DDL),
        "slices",
        "kind",
    )
    by_sort = (
        found.where("kind = 1")
        .select("doc_id", "text_hash", "start", "stop", "key", "data")
        .repartition("key")
        .sortWithinPartitions("key")
        .mapInArrow(frugal(lambda it: _sorted(it, length)), "doc_id bigint, text_hash bigint, start bigint, stop bigint")
    )
    strings = found.where("kind = 2")
    # A string without an owner stands for two at least.
    counts = (
        strings.groupBy("key", "other")
        .agg(F.sum(F.when(F.col("doc_id").isNull(), 2).otherwise(1)).alias("n"))
        .where("n > 1")
    )
    by_hash = strings.where("doc_id IS NOT NULL").join(counts, ["key", "other"])
    columns = ["doc_id", "text_hash", "start", "stop"]
    spans = found.where("kind = 0").select(columns).unionByName(by_sort).unionByName(by_hash.select(columns))
    return spans.groupBy("doc_id", "text_hash").agg(_merged(F.sort_array(F.collect_list(F.struct("start", "stop")))).alias("spans"))


def _merged(ordered: Column) -> Column:
    """Runs of touching spans as one: the list holds the runs in reverse while it grows."""
    kind = "array<struct<start:bigint,stop:bigint>>"

    def step(runs: Column, span: Column) -> Column:
        top = F.get(runs, F.lit(0))
        longer = F.struct(top["start"].alias("start"), F.greatest(top["stop"], span["stop"]).alias("stop"))
        return F.when(
            (F.size(runs) > 0) & (span["start"] <= top["stop"]),
            F.concat(F.array(longer), F.slice(runs, F.lit(2), F.greatest(F.size(runs) - 1, F.lit(0)))),
        ).otherwise(F.concat(F.array(span), runs))

    return F.reverse(F.aggregate(ordered, F.array().cast(kind), step))


def kept_bytes(data: Column, spans: Column) -> Column:
    """The bytes outside the spans, joined."""
    n = F.octet_length(data).cast("long")
    state = F.struct(F.lit(0).cast("long").alias("at"), F.lit(b"").alias("out"))
    piece = lambda a, b: F.substring(data, (a + 1).cast("int"), (b - a).cast("int"))
    done = F.aggregate(
        spans,
        state,
        lambda s, x: F.struct(x["stop"].alias("at"), F.concat(s["out"], piece(s["at"], x["start"])).alias("out")),
        lambda s: F.concat(s["out"], piece(s["at"], n)),
    )
    return F.when(spans.isNull(), data).otherwise(done)


def with_spans(docs: DataFrame, scratch: Scratch, name: str = "spans", length: int = LENGTH) -> DataFrame:
    """The rows of docs with ``spans`` (null where nothing repeats), or ``name``, added; it replaces a column of that name,
    other columns stay."""
    keys = [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), F.xxhash64(F.coalesce("text", F.lit("")))]
    spans = scratch.table(repeated_spans(docs, scratch, length), "spans").select(
        F.col("doc_id").alias("span_doc"), F.col("text_hash").alias("span_text"), "spans"
    )
    row = F.struct(*[F.col(f"`{n}`") for n in docs.columns if n.lower() != name.lower()])
    named = docs.select(keys[0].alias("span_doc"), keys[1].alias("span_text"), row.alias("row"))
    # Spans grow with the documents: the join goes by merging at every size.
    return named.join(spans.hint("merge"), ["span_doc", "span_text"], "left").select("row.*", F.col("spans").alias(name))


_TOLD_DDL = "doc_id bigint, n_bytes bigint, kept_sha256 string, n_passages bigint, n_passage_bytes bigint, text string"


def passages(docs: DataFrame, scratch: Scratch, length: int = PASSAGE, over_words: int = OVER_WORDS) -> DataFrame:
    """doc_id, n_bytes, kept_sha256, n_passages, n_passage_bytes, text, one row for each document.

    A passage is a maximal run of bytes of repeated ``length``-byte strings that has LENGTH bytes or more than
    ``over_words`` whole words. ``text`` is there only if a run has LENGTH bytes: no other text can hold a repeated string
    of that length, since all shorter strings in it repeat too. The others have the digest of their whole text.
    """
    own, text = Scratch(docs.sparkSession), F.coalesce("text", F.lit(""))
    wide = F.coalesce(F.exists("runs", lambda s: s["stop"] - s["start"] >= LENGTH), F.lit(False))
    rows = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), own, "runs", length).select(
        "doc_id",
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.when(~wide, F.sha2(F.encode(text, "utf-8"), 256)).alias("kept_sha256"),
        F.when(F.col("runs").isNotNull(), text).alias("text"),
        "runs",
    )

    def counted(batches):
        for batch in batches:
            texts, found = strings(batch, "text"), []
            for i, (text, spans) in enumerate(zip(texts, batch.column("runs").to_pylist(), strict=True)):
                runs = [(s["start"], s["stop"]) for s in spans or []]
                found.append([b - a for a, b in passages_of(text, runs, over_words)] if runs else [])
                if not any(b - a >= LENGTH for a, b in runs):
                    texts[i] = None
            numbers = [pa.array([f(x) for x in found], pa.int64()) for f in (len, sum)]
            columns = [*[batch.column(c) for c in ("doc_id", "n_bytes", "kept_sha256")], *numbers, pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _TOLD_DDL.split(", ")])

    told = scratch.table(rows.mapInArrow(frugal(counted), _TOLD_DDL), "passages")
    own.drop()
    return told


def passages_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What removing repeated 400-byte strings leaves of each document; ``changed`` where any byte went.

    ``n_passages`` and ``n_passage_bytes`` tell of the repeated passages that have 400 bytes or over 50 whole words,
    shorter ones than are removed included; ``has_passage`` where there is any.
    """
    scratch = Scratch(spark)
    told = passages(documents(spark, sf_dir).select("doc_id", "text"), scratch)
    data, none = F.encode("text", "utf-8"), F.lit(0).cast("long")
    cut = with_spans(told.where("text IS NOT NULL"), scratch).withColumns(
        {
            "n_removed": F.coalesce(F.aggregate("spans", none, lambda t, s: t + s["stop"] - s["start"]), none),
            "n_spans": F.coalesce(F.size("spans"), F.lit(0)).cast("long"),
            "kept_sha256": F.sha2(kept_bytes(data, F.col("spans")), 256),
        }
    )
    whole = told.where("text IS NULL").withColumns({"n_removed": none, "n_spans": none})
    return cut.drop("spans").unionByName(whole).select(
        "doc_id",
        "n_bytes",
        "n_removed",
        "n_spans",
        (F.col("n_spans") > 0).alias("changed"),
        "kept_sha256",
        "n_passages",
        "n_passage_bytes",
        (F.col("n_passages") > 0).alias("has_passage"),
    )


def cut_text(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the bytes of the spans; a character that a span covers in part stays."""
    data, at, out = text.encode("utf-8"), 0, []
    inside = lambda i: i < len(data) and data[i] & 0xC0 == 0x80
    for start, stop in spans:
        while inside(start):
            start += 1
        while inside(stop):
            stop -= 1
        if start < stop:
            out.append(data[at:start])
            at = stop
    return b"".join([*out, data[at:]]).decode("utf-8")


def whole_words(data: bytes, start: int, stop: int) -> int:
    """Words of which no byte lies outside the span."""
    words = data[start:stop].split()
    inside = lambda i: 0 < i < len(data) and data[i - 1] not in SPACES and data[i] not in SPACES
    return max(0, len(words) - inside(start) - inside(stop)) if stop > start else 0


def passages_of(text: str, spans: list[tuple[int, int]], over_words: int | None) -> list[tuple[int, int]]:
    """The spans of LENGTH bytes or of more than ``over_words`` whole words; None: all of them."""
    if over_words is None:
        return spans
    data = text.encode("utf-8")
    return [(a, b) for a, b in spans if b - a >= LENGTH or whole_words(data, a, b) > over_words]


def cut_texts(docs: DataFrame, scratch: Scratch, length: int = LENGTH, over_words: int | None = None) -> DataFrame:
    """docs with repeated bytes cut from ``text`` and, where there is such a column, ``n_chars`` counted anew.

    With ``over_words``, runs of repeated bytes that are under LENGTH are cut only if they hold more whole words.
    """
    names, own = docs.columns, free_name("spans", docs.columns)
    found = with_spans(docs, scratch, own, length)

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [
                cut_text(t, passages_of(t, [(s["start"], s["stop"]) for s in spans], over_words)) if t and spans else t
                for t, spans in zip(strings(batch, "text"), batch.column(own).to_pylist(), strict=True)
            ]
            yield batch.set_column(at, "text", pa.array(texts, pa.string())).drop_columns([own])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema if f.name != own)
    cut = found.mapInArrow(frugal(run), kinds)
    if "n_chars" in names:
        number = cut.schema["n_chars"].dataType
        changed = F.when(F.col("text").isNotNull(), F.length("text").cast(number)).otherwise(F.col("n_chars"))
        cut = cut.withColumn("n_chars", changed)
    return cut
