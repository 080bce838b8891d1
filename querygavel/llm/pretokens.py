"""Cutting text where no pre-token of the public tokenizers can cross, and remembering what the pieces encode to.

A single space between two characters that are not white space always begins a pre-token, so the
stretches between such spaces can be encoded apart. Most stretches repeat; each worker remembers a
bounded part of them, which changes the time and never the ids.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Callable
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: Marks that stand alone as one pre-token after letters.
MARKS = frozenset(",.;:!?")
#: Bytes that an encoder remembers of pre-tokens, and as many of stretches.
MEMO_BYTES = 96 << 20


def stretches(text: str) -> list[str]:
    """The text cut before each lone space; every stretch but the first keeps its space out."""
    parts = text.split(" ")
    if "" in parts or list(map(str.strip, parts)) != parts:
        return _LONE_SPACE.split(text)
    return parts


def le_ids(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Memo(dict):
    """Remembers ``make(key)`` for keys and values of at most ``most_bytes`` in memory.

    When full, it keeps what it has or starts anew.
    """

    #: A place in the dictionary and what the allocator adds to two small objects.
    ENTRY_BYTES = 130

    def __init__(self, make: Callable[[str], bytes], most_bytes: int, keep: bool):
        super().__init__()
        self.make, self.most_bytes, self.keep, self.bytes = make, most_bytes, keep, 0
        #: Above this not even the smallest entry has room.
        self.no_more = most_bytes - sys.getsizeof("") - sys.getsizeof(b"") - self.ENTRY_BYTES

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if self.keep and self.bytes > self.no_more:
            return value
        size = sys.getsizeof(key) + sys.getsizeof(value) + self.ENTRY_BYTES
        if self.bytes + size > self.most_bytes:
            if self.keep or size > self.most_bytes:
                return value
            self.clear()
            self.bytes = 0
        self[key] = value
        self.bytes += size
        return value


class StretchEncoder:
    """Encodes whole texts as little-endian unsigned 32-bit ids.

    ``pieces`` cuts a stretch into pre-tokens by the tokenizer's pattern, ``encode`` gives the ids of one pre-token.
    ``prepare`` is applied to a stretch first. ``spaced``: a space belongs to the pre-token after it.
    """

    def __init__(
        self,
        encode: Callable[[str], bytes],
        pieces: Callable[[str], list[str]],
        prepare: Callable[[str], str] | None = None,
        spaced: bool = True,
        most_bytes: int = MEMO_BYTES,
    ):
        self.pieces, self.prepare, self.space = pieces, prepare, " " if spaced else ""
        self.piece_memo = Memo(encode, most_bytes, keep=False)
        self.memo = Memo(self._stretch, most_bytes, keep=True)
        self.get = self.memo.__getitem__

    def _encoded(self, body: str, space: str) -> bytes:
        if self.prepare:
            body = self.prepare(body)
        if body.isalpha():
            return self.piece_memo[space + body]
        if body[-1:] in MARKS and body[:-1].isalpha():
            return self.piece_memo[space + body[:-1]] + self.piece_memo[body[-1]]
        return b"".join([self.piece_memo[p] for p in self.pieces(space + body)])

    def _stretch(self, body: str) -> bytes:
        return self._encoded(body, self.space)

    def __call__(self, text: str) -> bytes:
        first, *rest = stretches(text)
        return self._encoded(first, "") + b"".join(map(self.get, rest))

    def many(self, texts: pa.Array, apart: pa.Array, other: Callable[[str], bytes]) -> list[bytes]:
        """The same for some texts, one at least and none null, where each stretch is looked up once; ``other`` encodes those that are ``apart``."""
        # Where no pre-token has a space, line ends part texts as spaces do, and nothing stands between two of them.
        parts = pc.split_pattern(texts if self.space else pc.replace_substring(texts, "\n", " "), " ")
        coded = parts.flatten().dictionary_encode()
        # No part holds a space, so one string of all parts is cut into them, which is faster than one by one.
        whole = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
        joined = pc.binary_join(whole, " ")[0].as_py()
        code, known = coded.indices.to_numpy(), joined.split(" ")
        edge = parts.offsets.to_numpy().astype(np.int64) - parts.offsets[0].as_py()
        # As in ``stretches``: with white space beside a space, the text is cut by the pattern.
        odd = np.zeros(len(known), bool)
        if joined.split() != known:
            odd[:] = [(self.space and not p) or p.strip() != p for p in known]
        plain = ~(np.logical_or.reduceat(odd[code], edge[:-1]) | apart.to_numpy(zero_copy_only=False))
        wanted = np.repeat(plain, np.diff(edge))
        wanted[edge[:-1]] = False
        code = code[wanted]
        used = np.zeros(len(known), bool)
        used[code] = True
        at = np.cumsum(used) - 1
        values = list(map(self.get, compress(known, used.tolist())))
        size = np.fromiter(map(len, values), np.int64, len(values)) // 4
        first = np.cumsum(size) - size
        code = at[code]
        many = size[code]
        before = np.concatenate([[0], np.cumsum(many)])
        kind = np.int32 if before[-1] < 1 << 31 else np.int64
        place = np.repeat((first[code] - before[:-1]).astype(kind), many) + np.arange(before[-1], dtype=kind)
        ids = np.frombuffer(b"".join(values), "<u4")[place].tobytes()
        words = np.concatenate([[0], np.cumsum(np.where(plain, np.diff(edge) - 1, 0))])
        bound = (4 * before[words]).tolist()
        out = []
        for i, (text, good, start) in enumerate(zip(texts, plain.tolist(), edge[:-1].tolist(), strict=True)):
            if good:
                out.append(self._encoded(known[coded.indices[start].as_py()], "") + ids[bound[i] : bound[i + 1]])
            else:
                out.append(other(text.as_py()))
        return out
