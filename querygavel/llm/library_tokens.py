"""Ids by the tokenizers library: its model encodes each pre-token that a worker meets for the first time."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import AddedToken, Tokenizer

from querygavel.llm.common import remembered
from querygavel.llm.pretokens import MEMO_BYTES, StretchEncoder, le_ids

#: Bytes of text that are encoded at once.
BATCH_BYTES = 8 << 20
#: Pre-token pattern that the library applies for byte-level files without a pattern of their own. Fixed value.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=1)
def byte_letters() -> dict[int, str]:
    """The visible letter of each byte in byte-level vocabularies: itself where printable, else 256 and up in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in printable else next(others)) for b in range(256)}


class LibraryEncoder:
    """Whole texts as little-endian unsigned 32-bit ids, equal to the library's ``encode(text, add_special_tokens=False)``.

    As there, special strings of the vocabulary inside a text are special tokens. They part the text, and what lies
    between two of them is encoded by itself. ``marks`` are further special strings, with ids after the vocabulary.
    Takes byte-level files with the usual pattern, or with a split pattern of their own after a normalizer.
    ``most_bytes`` bounds each of the two memories of what pieces of text encode to.
    """

    def __init__(self, path: str, marks: tuple[str, ...] = (), most_bytes: int = MEMO_BYTES):
        self.tokenizer = tokenizer = Tokenizer.from_file(path)
        tokenizer.add_special_tokens([AddedToken(mark, special=True, normalized=False) for mark in marks])
        added = tokenizer.get_added_tokens_decoder()
        if any(t.single_word or t.lstrip or t.rstrip or t.normalized or not t.special for t in added.values()):
            raise ValueError(f"{path}: only special tokens that stand for themselves are taken")
        self.specials = {t.content: i for i, t in added.items()}
        self._special_ids = {text: le_ids([i]) for text, i in self.specials.items()}
        longest_first = sorted(self.specials, key=len, reverse=True)
        self._parts = re.compile(f"({'|'.join(map(re.escape, longest_first))})") if longest_first else None
        self.between = self._stretch_encoder(path, most_bytes)

    def _stretch_encoder(self, path: str, most_bytes: int) -> StretchEncoder:
        with open(path, encoding="utf-8") as file:
            before = json.load(file)["pre_tokenizer"]
        parts = before.get("pretokenizers", [before])
        split = next((p for p in parts if p["type"] == "Split"), None)
        if parts[-1]["type"] != "ByteLevel" or len(parts) > 2 or parts[-1].get("add_prefix_space"):
            raise ValueError(f"{path}: only byte-level vocabularies are taken")
        if split and not (split["behavior"] == "Removed" and split["invert"]):
            raise ValueError(f"{path}: only a split that keeps its matches is taken")
        letters, model, normalizer = byte_letters(), self.tokenizer.model, self.tokenizer.normalizer

        def encode(piece: str) -> bytes:
            # Of printable ASCII only the space has another letter.
            plain = piece.isascii() and piece.isprintable()
            shown = piece.replace(" ", letters[32]) if plain else piece.encode("utf-8").decode("latin-1").translate(letters)
            return le_ids([t.id for t in model.tokenize(shown)])

        def prepare(body: str) -> str:
            # Below U+0250 nothing composes and each letter has one lower case.
            plain = body.isalpha() or body.split() == [body]
            return body.lower() if plain and (body.isascii() or max(body) < "\u0250") else normalizer.normalize_str(body)

        return StretchEncoder(
            encode,
            regex.compile(split["pattern"]["Regex"] if split else BYTE_LEVEL).findall,
            prepare if normalizer else None,
            spaced=split is None,
            most_bytes=most_bytes,
        )

    def __call__(self, text: str) -> bytes:
        parts = self._parts.split(text) if self._parts else [text]
        if len(parts) == 1:
            return self.between(text)
        known, between = self._special_ids, self.between
        return b"".join([known[part] if i % 2 else between(part) for i, part in enumerate(parts) if part])

    def many(self, texts: pa.Array) -> Iterator[bytes]:
        """The same for each text of a column, null as empty; some of them at a time."""
        texts = pc.fill_null(texts, "")
        size = pc.binary_length(texts).to_numpy().astype(np.int64)
        if not len(texts):
            return
        number = np.cumsum(size) // BATCH_BYTES
        edge = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(texts)]
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            some = texts.slice(a, b - a)
            apart = pa.array(np.zeros(len(some), bool))
            for special in self.specials:
                apart = pc.or_(apart, pc.match_substring(some, special))
            yield from self.between.many(some, apart, self)


@remembered(maxsize=4)
def library_encoder(path: str, marks: tuple[str, ...] = (), most_bytes: int = MEMO_BYTES) -> LibraryEncoder:
    return LibraryEncoder(path, marks, most_bytes)
