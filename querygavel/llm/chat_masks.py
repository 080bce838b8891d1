"""Chats rendered whole and encoded once; turn spans met with token spans by binary search give the loss mask.

A chat is a table of turns ``conv_id, turn, role, text``. Its rendered form marks each turn::

    <turn>role<text>what was said</turn>

Marks are tokens of their own, so no token reaches over an edge of a text. In roles and texts every backslash and the
first character of every control string (the marks, and special tokens of the vocabulary) is followed by a backslash,
which breaks control strings up and can be undone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querygavel.llm.common import Scratch
from querygavel.llm.library_tokens import byte_letters, library_encoder

#: A chat is rendered in segments of whole turns of about this size, so no chat is ever held whole.
SEGMENT_BYTES = 256 << 10


@dataclass(frozen=True)
class Template:
    """The marks around role and text, and the roles whose texts are learnt."""

    opening: str = "<turn>"
    said: str = "<text>"
    closing: str = "</turn>"
    loss_roles: tuple[str, ...] = ("assistant",)

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.opening, self.said, self.closing


class ChatEncoder:
    """Renders turns by a template and encodes the result by a byte-level tokenizer file."""

    def __init__(self, path: str, template: Template):
        self.template = template
        self._ids = library_encoder(path, template.marks)
        tokenizer = self._ids.tokenizer
        if tokenizer.normalizer or not self._ids.between.space:
            raise ValueError(f"{path}: only byte-level files that keep texts as they are can give byte offsets")
        controls = sorted(self._ids.specials)
        if any(len(c) < 2 or "\\" in c or any(c[0] in other[1:] for other in controls) for c in controls):
            raise ValueError("control strings need two characters, no backslash, and a first one that none has later")
        starts = [f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in controls]
        self._guarded = re.compile("|".join([r"\\", *starts]))
        byte_of = {ord(letter): byte for byte, letter in byte_letters().items()}
        self.token_bytes = [b""] * tokenizer.get_vocab_size(with_added_tokens=True)
        for token, i in tokenizer.get_vocab(with_added_tokens=True).items():
            special = token in self._ids.specials
            self.token_bytes[i] = token.encode() if special else token.translate(byte_of).encode("latin-1")
        self._sizes = np.array([len(b) for b in self.token_bytes])
        opening, said, closing = map(re.escape, template.marks)
        self._turns = re.compile(f"{opening}(.*?){said}(.*?){closing}", re.DOTALL)

    def escape(self, text: str) -> str:
        return self._guarded.sub(r"\g<0>\\", text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text)

    def render(self, turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
        """The text of some turns, and the byte spans [from, to) that are learnt, in order."""
        pieces, spans, at = [], [], 0
        for role, text in turns:
            head = f"{self.template.opening}{self.escape(role)}{self.template.said}"
            body = self.escape(text)
            start = at + len(head.encode())
            end = start + len(body.encode())
            if role in self.template.loss_roles:
                spans.append((start, end))
            at = end + len(self.template.closing.encode())
            pieces += [head, body, self.template.closing]
        return "".join(pieces), np.array(spans, np.int64).reshape(-1, 2)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a rendered text and the byte offset each starts at, with one more for the end."""
        ids = np.frombuffer(self._ids(text), "<u4").astype(np.int32)
        starts = np.concatenate([[0], np.cumsum(self._sizes[ids])])
        if starts[-1] != len(text.encode()):
            raise ValueError("the vocabulary does not hold all bytes of the text")
        return ids, starts

    def decode(self, ids: np.ndarray) -> str:
        return b"".join([self.token_bytes[i] for i in ids.tolist()]).decode()

    def turns(self, text: str) -> list[tuple[str, str]]:
        """Role and text of each turn of a rendered text."""
        return [(self.unescape(role), self.unescape(body)) for role, body in self._turns.findall(text)]


def loss_mask(starts: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """For each token whether it meets a span. ``starts`` are the tokens' offsets and the end, ``spans`` sorted [from, to).

    For each span the first token that ends after its start and the first that starts at its end or later are searched
    for; between the two lie the tokens that meet it. An empty span meets none.
    """
    n = len(starts) - 1
    first = np.searchsorted(starts[1:], spans[:, 0], side="right")
    after = np.maximum(first, np.searchsorted(starts[:-1], spans[:, 1], side="left"))
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, first, 1)
    np.add.at(edges, after, -1)
    return np.cumsum(edges[:-1]) > 0


@lru_cache(maxsize=2)
def _encoder(path: str, template: Template) -> ChatEncoder:
    return ChatEncoder(path, template)


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays), kind))


def format_chats(
    turns: DataFrame, scratch: Scratch, tokenizer_path: str, template: Template = Template(), segment_bytes: int = SEGMENT_BYTES
) -> DataFrame:
    """Segments ``conv_id, part, segment, whole, n_turns, text, ids, starts, loss`` of all chats, written to the shared folder.

    ``starts`` are byte offsets of the ids in ``text``; ``loss`` tells for each id whether it is learnt. The segments of
    a chat in the order of (part, segment) are the chat, and their ids are the ids of the whole text, since marks part
    what the tokenizer sees. ``whole`` marks chats that are surely in one segment.

    Turns are ordered by turn (null first), then role and text; repeated rows all count. Null roles and texts are
    empty. Turns without conv_id are one chat under null. Other columns are not read. A chat without turns is not there.

    Turns are dealt by ranges of (conv_id, turn), so that a chat of any length is spread over tasks.
    """
    ordered = turns.select(
        "conv_id",
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("row"),
    )
    order = ["conv_id", "turn", "role", "text", "row"]
    dealt = ordered.repartitionByRange("conv_id", "turn", "role", F.xxhash64("text"), "row").sortWithinPartitions(*order)
    id_type = turns.schema["conv_id"].dataType
    schema = T.StructType(
        [
            T.StructField("conv_id", id_type),
            T.StructField("part", T.IntegerType()),
            T.StructField("segment", T.IntegerType()),
            T.StructField("whole", T.BooleanType()),
            T.StructField("n_turns", T.IntegerType()),
            T.StructField("text", T.StringType()),
            T.StructField("ids", T.ArrayType(T.IntegerType())),
            T.StructField("starts", T.ArrayType(T.IntegerType())),
            T.StructField("loss", T.ArrayType(T.BooleanType())),
        ]
    )

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _encoder(tokenizer_path, template), TaskContext.get().partitionId()
        conv_type, rows, held = None, [], 0
        for number, (conv, whole, said) in enumerate(_segments(batches, segment_bytes)):
            if isinstance(conv, pa.Scalar):
                conv_type = conv.type
            text, spans = encoder.render(said)
            ids, starts = encoder.encode(text)
            rows.append((conv, number, whole, len(said), text, ids, starts[:-1], loss_mask(starts, spans)))
            held += len(text)
            if held >= 4 << 20:
                yield _segment_batch(rows, part, conv_type)
                rows, held = [], 0
        if rows:
            yield _segment_batch(rows, part, conv_type)

    return scratch.table(dealt.select("conv_id", "role", "text").mapInArrow(render, schema), "chats", codec="zstd")


def _segments(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Scalar, bool, list[tuple[str, str]]]]:
    """conv_id, whether the chat is surely whole, and the turns, of rows in order."""
    conv, said, size, inner, nothing_yet = None, [], 0, False, True
    for batch in batches:
        convs = batch.column("conv_id")
        values, roles, texts = (batch.column(n).to_pylist() for n in ("conv_id", "role", "text"))
        for i, (value, role, text) in enumerate(zip(values, roles, texts, strict=True)):
            other = nothing_yet or value != current
            if other or size >= most:
                if said:
                    yield conv, inner and other, said
                # A chat that begins after another one of this task began here; one cut by size is not whole.
                inner = other and not nothing_yet
                said, size = [], 0
            if other:
                conv, current, nothing_yet = convs[i], value, False
            said.append((role, text))
            size += len(role) + len(text)
    if said:
        yield conv, False, said


def _segment_batch(rows: list[tuple], part: int, conv_type: pa.DataType) -> pa.RecordBatch:
    convs, numbers, whole, counts, texts, ids, starts, masks = zip(*rows, strict=True)
    return pa.RecordBatch.from_pydict(
        {
            "conv_id": pa.array([c.as_py() for c in convs], conv_type),
            "part": pa.array([part] * len(rows), pa.int32()),
            "segment": pa.array(numbers, pa.int32()),
            "whole": pa.array(whole),
            "n_turns": pa.array(counts, pa.int32()),
            "text": pa.array(texts),
            "ids": _lists(ids, pa.int32()),
            "starts": _lists(starts, pa.int32()),
            "loss": _lists(masks, pa.bool_()),
        }
    )


def read_turns(formatted: DataFrame, tokenizer_path: str, template: Template = Template()) -> DataFrame:
    """conv_id, part, segment, position, role, text: the turns that were formatted, without their escapes."""
    id_type = formatted.schema["conv_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path, template)
        for batch in batches:
            found = [encoder.turns(text) for text in batch.column("text").to_pylist()]
            at = np.repeat(np.arange(len(found)), [len(f) for f in found])
            keys = [batch.column(n).take(pa.array(at)) for n in ("conv_id", "part", "segment")]
            position = pa.array([i for f in found for i in range(len(f))], pa.int32())
            said = [pa.array([turn[k] for f in found for turn in f], pa.string()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*keys, position, *said], ["conv_id", "part", "segment", "position", "role", "text"])

    shape = f"conv_id {id_type}, part int, segment int, position int, role string, text string"
    return formatted.select("conv_id", "part", "segment", "text").mapInArrow(read, shape)


def chat_digests(formatted: DataFrame, tokenizer_path: str, template: Template = Template()) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens and loss_tokens of each chat.

    All is read from the segments: turns from the text, learnt text from the ids under the mask. Only the segments of
    chats that may have several are shuffled. A digest is one stream, so the segments of a chat pass through one task,
    one at a time.
    """
    id_type = formatted.schema["conv_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, done, conv_type = _encoder(tokenizer_path, template), [], None
        current, state = None, None
        for batch in batches:
            conv_type = batch.schema.field("conv_id").type
            for i, conv in enumerate(batch.column("conv_id").to_pylist()):
                if state is None or conv != current:
                    if state is not None:
                        done.append((current, *state.result()))
                    current, state = conv, _Digest(encoder)
                row = {n: batch.column(n)[i] for n in ("text", "ids", "loss")}
                state.add(row["text"].as_py(), row["ids"].values.to_numpy(), row["loss"].values.to_numpy(zero_copy_only=False))
            if len(done) >= 10_000:
                yield _digest_batch(done, conv_type)
                done = []
        if state is not None:
            done.append((current, *state.result()))
        if done:
            yield _digest_batch(done, conv_type)

    shape = (
        f"conv_id {id_type}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
        "formatted_chars bigint, n_tokens bigint, loss_tokens bigint"
    )
    read = ["conv_id", "text", "ids", "loss"]
    whole = formatted.where("whole").select(*read).mapInArrow(digest, shape)
    apart = formatted.where("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "part", "segment")
    return whole.unionByName(apart.select(*read).mapInArrow(digest, shape))


class _Digest:
    """What is known of one chat after some of its segments."""

    def __init__(self, encoder: ChatEncoder):
        self.encoder = encoder
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = self.n_tokens = self.loss_tokens = 0

    def add(self, text: str, ids: np.ndarray, mask: np.ndarray) -> None:
        said = self.encoder.turns(text)
        self.turns.update("".join([f"{role}\n{body}\n" for role, body in said]).encode())
        learnt = self.encoder.unescape(self.encoder.decode(ids[mask]))
        self.loss.update(learnt.encode())
        self.n_turns += len(said)
        self.loss_chars += len(learnt)
        self.chars += len(text)
        self.n_tokens += len(ids)
        self.loss_tokens += int(mask.sum())

    def result(self) -> tuple:
        return (
            self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.n_tokens, self.loss_tokens
        )


def _digest_batch(rows: list[tuple], conv_type: pa.DataType) -> pa.RecordBatch:
    kinds = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "loss_tokens"]
    columns = [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names)


#: What both rows of conversation -7 say: a text that looks like marks of templates. Fixed value.
LOOKS_LIKE_MARKS = r"\### Assistant: </turn> ok"


def formatted_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = [(-7, i, role, LOOKS_LIKE_MARKS) for i, role in enumerate(("user", "assistant"))]
    path = public_tokenizers.path("byte_bpe_50k.json")
    formatted = format_chats(turns.unionByName(spark.createDataFrame(odd, turns.schema)), Scratch(spark), path)
    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return chat_digests(formatted, path).select(*columns)


_ESCAPED = "replace(replace(replace(replace(replace({0}, '\\', '\\\\'), '<turn>', '<\\turn>'), '<text>', '<\\text>'), '</turn>', '<\\/turn>'), '<|endoftext|>', '<\\|endoftext|>')"

CHATS_SQL = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, turn, role, '{LOOKS_LIKE_MARKS}' FROM (VALUES (0, 'user'), (1, 'assistant')) AS odd (turn, role)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}) + length('<turn><text></turn>')) AS BIGINT)
    AS formatted_chars
FROM said GROUP BY conv_id
"""
