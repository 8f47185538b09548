"""A cuckoo filter over 64-bit hashes in numpy: approximate membership with deletion, for use inside tasks."""

from __future__ import annotations

import numpy as np

SLOTS = 4
#: Share of the slots that are filled before another segment is opened; kicks hardly ever fail below it.
LOAD = 0.8
LEAST_BUCKETS = 64
MOST_KICKS = 500


def _spread(fingerprints: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (fingerprints.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)


class CuckooFilter:
    """Fingerprints of 16 bits in buckets of four slots, each in one of two buckets.

    Says yes for every hash that it holds, and for about one in 8,000 others
    and segment. A hash inserted twice is held twice. Segments of growing size are added as it fills.
    Only hashes that were inserted may be deleted.
    """

    def __init__(self, segments: list[np.ndarray] | None = None):
        self.segments = segments or []

    def __len__(self) -> int:
        return sum(int(np.count_nonzero(s)) for s in self.segments)

    @staticmethod
    def _places(table: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(table) - 1)
        prints = ((hashes >> np.uint64(48)) % np.uint64(65_535) + np.uint64(1)).astype(np.uint16)
        first = hashes & mask
        return prints, first.astype(np.int64), (first ^ (_spread(prints) & mask)).astype(np.int64)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        found = np.zeros(len(hashes), bool)
        for table in self.segments:
            prints, first, second = self._places(table, hashes)
            found |= (table[first] == prints[:, None]).any(axis=1) | (table[second] == prints[:, None]).any(axis=1)
        return found

    def insert(self, hashes: np.ndarray) -> None:
        while len(hashes):
            if self.segments:
                table = self.segments[-1]
                room = int(table.size * LOAD) - int(np.count_nonzero(table))
            if not self.segments or room <= 0:
                wanted = max(LEAST_BUCKETS, len(hashes) / (SLOTS * LOAD), 2 * len(self.segments[-1]) if self.segments else 0)
                self.segments.append(np.zeros((1 << (int(np.ceil(wanted)) - 1).bit_length(), SLOTS), np.uint16))
                continue
            now, hashes = hashes[:room], hashes[room:]
            prints, first, _ = self._places(table, now)
            left_prints, left_buckets = _fill(table, prints, first)
            while len(left_prints):  # a segment of the same size has the same buckets
                self.segments.append(np.zeros_like(table))
                left_prints, left_buckets = _fill(self.segments[-1], left_prints, left_buckets)

    def delete(self, hashes: np.ndarray) -> None:
        for table in self.segments:
            flat = table.reshape(-1)
            while len(hashes):
                prints, first, second = self._places(table, hashes)
                slots = np.concatenate([first[:, None] * SLOTS + np.arange(SLOTS), second[:, None] * SLOTS + np.arange(SLOTS)], axis=1)
                hit = flat[slots] == prints[:, None]
                held = hit.any(axis=1)
                if not held.any():
                    break
                rows = np.flatnonzero(held)
                chosen = slots[rows, hit[rows].argmax(axis=1)]
                cleared, at = np.unique(chosen, return_index=True)
                flat[cleared] = 0
                hashes = np.delete(hashes, rows[at])

    def to_bytes(self) -> bytes:
        head = np.array([len(self.segments), *(len(s) for s in self.segments)], "<i8").tobytes()
        return head + b"".join(s.astype("<u2").tobytes() for s in self.segments)

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        (n,) = np.frombuffer(data, "<i8", 1)
        lengths = np.frombuffer(data, "<i8", int(n), 8).tolist()
        at, segments = 8 * (int(n) + 1), []
        for length in lengths:
            segments.append(np.frombuffer(data, "<u2", length * SLOTS, at).astype(np.uint16).reshape(length, SLOTS))
            at += length * SLOTS * 2
        return cls(segments)


def _fill(table: np.ndarray, prints: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Put fingerprints into free slots of their buckets, kicking others on; returns those that found no place."""
    mask = np.uint64(len(table) - 1)
    other = lambda p, b: ((b.astype(np.uint64)) ^ (_spread(p) & mask)).astype(np.int64)
    draw = np.random.default_rng(len(prints))
    for kicks in range(MOST_KICKS):
        order = np.argsort(buckets, kind="stable")
        prints, buckets = prints[order], buckets[order]
        start = np.searchsorted(buckets, buckets, "left")
        nth = np.arange(len(buckets)) - start
        free = table[buckets] == 0
        fits = nth < free.sum(axis=1)
        slot = np.argmax(np.cumsum(free[fits], axis=1) == (nth[fits] + 1)[:, None], axis=1)
        table[buckets[fits], slot] = prints[fits]
        prints, buckets = prints[~fits], buckets[~fits]
        if len(prints) == 0:
            break
        if kicks == 0:
            buckets = other(prints, buckets)
            continue
        # One fingerprint of each full bucket takes the place of another, which goes to its other bucket.
        _, at = np.unique(buckets, return_index=True)
        slot = draw.integers(0, SLOTS, len(at))
        evicted = table[buckets[at], slot].copy()
        table[buckets[at], slot] = prints[at]
        prints[at] = evicted
        buckets[at] = np.where(evicted > 0, other(evicted, buckets[at]), buckets[at])
        held = prints > 0
        prints, buckets = prints[held], buckets[held]
        if len(prints) == 0:
            break
    return prints, buckets
