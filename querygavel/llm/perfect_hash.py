"""A minimal perfect hash: n keys, n slots, one probe and one comparison for each look-up."""

from __future__ import annotations

import xxhash


class PerfectHash:
    """Buckets are placed from the largest down, each by the first seed that sends its keys to free slots.

    Buckets of one key hold their slot itself, as a negative number. Every slot is used; a key that is not in the
    table is found out by comparing it with the key in its slot.
    """

    def __init__(self, entries: dict[bytes, int]):
        n = max(1, len(entries))
        buckets: list[list[bytes]] = [[] for _ in range(n)]
        for key in entries:
            buckets[xxhash.xxh3_64_intdigest(key) % n].append(key)
        self.n, self.seeds = n, [0] * n
        self.keys: list[bytes | None] = [None] * n
        self.values = [-1] * n
        order = sorted(range(n), key=lambda b: -len(buckets[b]))
        for b in order:
            keys = buckets[b]
            if len(keys) < 2:
                break
            seed = 1
            while len(slots := {xxhash.xxh3_64_intdigest(k, seed) % n for k in keys}) < len(keys) or any(
                self.keys[s] is not None for s in slots
            ):
                seed += 1
            self.seeds[b] = seed
            for k in keys:
                self._put(xxhash.xxh3_64_intdigest(k, seed) % n, k, entries[k])
        free = (s for s in range(n) if self.keys[s] is None)
        for b in order:
            if len(buckets[b]) == 1:
                slot = next(free)
                self.seeds[b] = -slot - 1
                self._put(slot, buckets[b][0], entries[buckets[b][0]])

    def _put(self, slot: int, key: bytes, value: int) -> None:
        self.keys[slot], self.values[slot] = key, value

    def get(self, key: bytes) -> int:
        """The value of the key, or -1."""
        seed = self.seeds[xxhash.xxh3_64_intdigest(key) % self.n]
        slot = -seed - 1 if seed < 0 else xxhash.xxh3_64_intdigest(key, seed) % self.n
        return self.values[slot] if self.keys[slot] == key else -1
