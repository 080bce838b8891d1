"""Sets of word shingles as 64-bit hashes, for many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from querygavel.llm.common import SPACES, mixed, powers, prefix_hashes

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_ODD = np.uint64(0xD6E8FEB86659FD93)


def _joined(hashes: np.ndarray, more: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(hashes * _ODD + more)


def shingle_sets(texts: list[str | None], k: int, most_bytes: int = 1 << 20) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its distinct k-word shingles.

    A-Z count as a-z; words are separated by [\\x20\\x09-\\x0D]. A text of fewer words than k has them all as its one
    shingle; one without words, or null, has none.
    """
    held, size = [], 0
    for text in texts:
        data = (text or "").encode("utf-8").lower()
        held.append(data)
        size += len(data)
        if size >= most_bytes:
            yield from _sets(held, k)
            held, size = [], 0
    yield from _sets(held, k)


def _sets(held: list[bytes], k: int) -> Iterator[np.ndarray]:
    if not held:
        return
    data = np.frombuffer(b" " + b" ".join(held) + b" ", np.uint8)
    first = np.cumsum([1] + [len(h) + 1 for h in held])
    space = _IS_SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    sums = prefix_hashes(data)
    with np.errstate(over="ignore"):
        words = mixed((sums[ends] - sums[starts]) * powers(len(data), inverse=True)[starts] + (ends - starts).astype(np.uint64))
    grams = words
    for i in range(1, k):
        grams = _joined(grams[: len(words) - i], words[i:]) if len(words) > i else grams[:0]
    bounds = np.searchsorted(starts, first)
    for at, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if end - at >= k:
            yield np.unique(grams[at : end - k + 1])
        elif end > at:
            short = words[at : at + 1]
            for i in range(at + 1, end):
                short = _joined(short, words[i : i + 1])
            yield short
        else:
            yield grams[:0]
