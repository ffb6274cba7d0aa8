"""Minimal perfect hash of 64-bit keys, by levels of bit arrays, with fingerprints.

Each level hashes the keys that are left into a bit array about twice their number;
keys alone in their place stay there, the others go on to the next level. A key's
slot is the number of set bits before its own, so n keys fill slots 0 to n-1.
"""

from __future__ import annotations

import numpy as np

_MAGIC = np.uint64(0x9E3779B97F4A7C15)


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of the key."""
    with np.errstate(over="ignore"):
        x = (keys.astype(np.uint64) + np.uint64(seed + 1) * _MAGIC).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Slots of distinct keys; a key that was not among them is told by its fingerprint."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, prints: np.ndarray):
        self.sizes, self.words, self.prints = sizes, words, prints
        #: Set bits before each word, over all levels: one addition and one count find a slot.
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left = keys.view(np.uint64) if keys.dtype == np.int64 else keys.astype(np.uint64)
        if len(np.unique(left)) != len(left):
            raise ValueError("keys repeat")
        every, sizes, words = left, [], []
        while len(left):
            size = -(-max(64, 2 * len(left)) // 64) * 64
            at = (mix(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = left[~alone[at]]
        out = cls(np.array(sizes, np.int64), np.concatenate(words) if words else np.empty(0, np.uint64), np.zeros(len(every), np.uint32))
        out.prints[out._slots(every)] = mix(every, 977).astype(np.uint32)
        return out

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        slots, open_, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            if not len(open_):
                break
            at = (mix(keys[open_], level) % np.uint64(size)).astype(np.int64) + base
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            before = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            slots[open_[hit]] = (self.ranks[at >> 6] + before)[hit]
            open_ = open_[~hit]
            base += size
        return slots

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 for a key that the fingerprints show to be foreign."""
        keys = keys.view(np.uint64) if keys.dtype == np.int64 else keys.astype(np.uint64)
        slots = self._slots(keys)
        if len(self.prints):
            slots[(slots >= 0) & (self.prints[slots] != mix(keys, 977).astype(np.uint32))] = -1
        return slots

    def to_bytes(self, records: np.ndarray) -> bytes:
        """A file for lookups in place: header, then each word with the set bits before it, then a record for each slot.

        records: structured array in slot order, of one width. Fingerprints stand before it.
        """
        words = np.empty((len(self.words), 2), np.uint64)
        words[:, 0], words[:, 1] = self.words, self.ranks[:-1]
        slots = np.empty(len(records), np.dtype([("print", "<u4"), ("record", records.dtype)]))
        slots["print"], slots["record"] = self.prints, records
        head = np.array([len(self.sizes), len(records), *self.sizes], np.uint64)
        return head.tobytes() + words.tobytes() + slots.tobytes()


class HashFile:
    """A perfect hash in a file: a lookup reads a word for each level it passes, and one slot."""

    def __init__(self, file, record: np.dtype):
        self._file, self._slot = file, np.dtype([("print", "<u4"), ("record", record)])
        levels, self.n = np.frombuffer(self._read(0, 16), np.uint64).tolist()
        self._sizes = np.frombuffer(self._read(16, 8 * levels), np.uint64).tolist()
        self._words = 16 + 8 * levels
        self._slots = self._words + 16 * (sum(self._sizes) // 64)
        self.reads = 0

    def _read(self, at: int, n: int) -> bytes:
        self._file.seek(at)
        return self._file.read(n)

    def find(self, key: int) -> np.void | None:
        """The key's record; None for a key that the fingerprint shows to be foreign."""
        as_array, base = np.array([key], np.int64).view(np.uint64), 0
        for level, size in enumerate(self._sizes):
            bit = base + int(mix(as_array, level)[0]) % size
            word, rank = np.frombuffer(self._read(self._words + 16 * (bit >> 6), 16), np.uint64).tolist()
            self.reads += 1
            if word >> (bit & 63) & 1:
                slot = rank + (word & ((1 << (bit & 63)) - 1)).bit_count()
                found = np.frombuffer(self._read(self._slots + self._slot.itemsize * slot, self._slot.itemsize), self._slot)[0]
                self.reads += 1
                return found["record"] if int(found["print"]) == int(mix(as_array, 977)[0]) & 0xFFFFFFFF else None
            base += size
        return None
