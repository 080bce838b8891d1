"""Suffixes sorted by mergesort, compared by prefix hashes: a common prefix is found by binary search over its length."""

from __future__ import annotations

import numpy as np

from querygavel.llm.common import powers, prefix_hashes


class Suffixes:
    """Suffixes of one buffer, compared up to ``length`` bytes; every one is that long at least."""

    def __init__(self, data: np.ndarray, length: int):
        self.data, self.length = data, length
        self.sums, self.powers = prefix_hashes(data, seed=11), powers(len(data) + 1)

    def alike(self, x: np.ndarray, y: np.ndarray, m: np.ndarray | int) -> np.ndarray:
        """Whether the hashes of the first m bytes agree: differences of prefix sums, each scaled by the other's place."""
        with np.errstate(over="ignore"):
            return (self.sums[x + m] - self.sums[x]) * self.powers[y] == (self.sums[y + m] - self.sums[y]) * self.powers[x]

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Lengths of common prefixes, by binary search: as many steps as the length has bits."""
        low = np.where(self.alike(x, y, self.length), self.length, 0)
        open_ = np.flatnonzero(low < self.length)
        a, b = x[open_], y[open_]
        lo, hi = np.zeros(len(open_), np.int64), np.full(len(open_), self.length - 1)
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            same = self.alike(a, b, mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        low[open_] = lo
        return low

    def compare(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 for each pair."""
        at = self.common(x, y)
        differ = at < self.length
        out = np.zeros(len(x), np.int8)
        a, b = self.data[x[differ] + at[differ]], self.data[y[differ] + at[differ]]
        out[differ] = np.where(a < b, -1, 1)
        return out

    def sort(self, starts: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """Starts in the order of their suffixes within each segment; segments are contiguous.

        Bottom-up merges, all segments at a time: an element's place in a merged run is its place in its own half and its
        rank in the other, found by binary search.
        """
        first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
        size = np.diff(np.concatenate([first, [len(segment)]]))
        base, length = np.repeat(first, size), np.repeat(size, size)
        order = starts.copy()
        width = 1
        while width < size.max(initial=0):
            here = np.flatnonzero(length > width)
            local = here - base[here]
            block = local // width
            other = (block ^ 1) * width
            stop = np.minimum(other + width, length[here])
            lo, hi = np.minimum(other, stop), stop.copy()
            right = (block & 1).astype(bool)
            while True:
                going = np.flatnonzero(lo < hi)
                if not len(going):
                    break
                mid = (lo[going] + hi[going]) // 2
                side = self.compare(order[base[here[going]] + mid], order[here[going]])
                before = (side < 0) | ((side == 0) & right[going])
                lo[going] = np.where(before, mid + 1, lo[going])
                hi[going] = np.where(before, hi[going], mid)
            rank = np.where(other < length[here], lo - np.minimum(other, stop), 0)
            target = base[here] + (block & ~1) * width + (local - block * width) + rank
            merged = order.copy()
            merged[target] = order[here]
            order = merged
            width *= 2
        return order

    def same_bytes(self, x: np.ndarray, y: np.ndarray, rows: int = 1 << 14) -> np.ndarray:
        """Whether pairs agree byte for byte."""
        windows = np.lib.stride_tricks.sliding_window_view(self.data, self.length)
        parts = [
            (windows[x[i : i + rows]] == windows[y[i : i + rows]]).all(axis=1) for i in range(0, len(x), rows)
        ]
        return np.concatenate(parts) if parts else np.zeros(0, bool)


def repeated(data: np.ndarray, starts: np.ndarray, segment: np.ndarray, length: int) -> np.ndarray:
    """For each start, whether another of its segment begins the same ``length`` bytes; equal hashes are verified."""
    suffixes = Suffixes(data, length)
    ranked = np.arange(len(starts))
    order = suffixes.sort(starts, segment)
    # Starts differ from each other, so they lead back to where they came from.
    ranked = np.argsort(starts, kind="stable")[np.searchsorted(np.sort(starts), order)]
    near = np.flatnonzero(segment[1:] == segment[:-1])
    equal = suffixes.alike(order[near], order[near + 1], length)
    near = near[equal]
    true = suffixes.same_bytes(order[near], order[near + 1])
    out = np.zeros(len(starts), bool)
    out[ranked[near[true]]] = True
    out[ranked[near[true] + 1]] = True
    for bad in np.unique(segment[near[~true]]):
        # A hash collided: this segment is settled by its bytes.
        own = np.flatnonzero(segment == bad)
        texts = [data[s : s + length].tobytes() for s in starts[own]]
        out[own] = [texts.count(t) > 1 for t in texts]
    return out
