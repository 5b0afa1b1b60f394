"""Texts of a batch as arrays of code points, and look-up of all their pieces at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: The code behind each text of a batch: no character has it.
END_CODE = 0x110000
MIX = np.uint64(0x9E3779B97F4A7C15)
BASE = 0xD1342543DE82EF95


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, ends): the code points of the texts, END_CODE behind each, and where these stand."""
    codes = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    codes[ends] = END_CODE
    return codes, ends


def spread(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begins[0], begins[0] + 1, ... (sizes[0] of them), then those of begins[1], and so on."""
    ends = np.cumsum(sizes)
    return np.repeat(begins - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def by_size(texts: Iterable[str | None], chars: int) -> Iterator[list[str]]:
    """The texts in runs of about so many characters (longer ones by themselves); nulls as empty texts."""
    some: list[str] = []
    room = chars
    for t in texts:
        some.append(t or "")
        room -= len(some[-1]) + 1
        if room <= 0:
            yield some
            some, room = [], chars
    if some:
        yield some


class Table:
    """64-bit keys to 32-bit values of 0 or more; open addressing in arrays, looked up all at once."""

    def __init__(self, keys: np.ndarray | None = None, values: np.ndarray | None = None) -> None:
        self.n, self.bits = 0, 10
        self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        if keys is not None:
            self.add(keys, values)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The keys' values, -1 for those not there."""
        slots = self._slots(keys)
        out = self.values[slots]
        left = np.flatnonzero((self.keys[slots] != keys) & (out >= 0))
        while len(left):
            at = slots[left] = (slots[left] + 1) & ((1 << self.bits) - 1)
            out[left] = self.values[at]
            left = left[(self.keys[at] != keys[left]) & (out[left] >= 0)]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds different keys that aren't there."""
        self.n += len(keys)
        if 2 * self.n > 1 << self.bits:
            own = self.values >= 0
            keys, values = np.concatenate((self.keys[own], keys)), np.concatenate((self.values[own], values))
            self.bits = max(10, int(3 * self.n).bit_length())
            self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        slots, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            free = left[self.values[slots[left]] < 0]
            self.keys[slots[free]], self.values[slots[free]] = keys[free], values[free]
            left = left[self.keys[slots[left]] != keys[left]]
            slots[left] = (slots[left] + 1) & ((1 << self.bits) - 1)


class Growing:
    """An array with room at its end."""

    def __init__(self, dtype: np.dtype | type) -> None:
        self.all, self.n = np.zeros(1024, dtype), 0

    def extend(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.all):
            self.all = np.concatenate((self.all[: self.n], np.zeros(self.n + 2 * len(more), self.all.dtype)))
        self.all[self.n : self.n + len(more)] = more
        self.n += len(more)


class Store:
    """Numbers of strings that were met (their ids, say), in the order of learning; the same strings are found
    again by a 64-bit hash and compared character by character, so a hash shared by two does no harm."""

    def __init__(self, dtype: np.dtype | type, limit: int, chars: int) -> None:
        self.dtype, self.limit, self.chars = dtype, limit, chars
        self.powers = self.inverses = np.ones(1, np.uint64)
        self.clear()

    def clear(self) -> None:
        self.table, self.codes, self.out = Table(), Growing(np.uint32), Growing(self.dtype)
        #: Where each entry's characters and numbers begin, and how many they are.
        self.at, self.size, self.out_at, self.out_size = Growing(np.int64), Growing(np.int64), Growing(np.int64), Growing(np.int64)

    def _keys(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Hashes of substrings: differences of one running sum of codes times powers, brought to power 0."""
        while len(self.powers) <= len(codes):
            k, inverse = len(self.powers), pow(BASE, -1, 1 << 64)
            self.powers = np.concatenate((self.powers, self.powers * np.uint64(pow(BASE, k, 1 << 64))))
            self.inverses = np.concatenate((self.inverses, self.inverses * np.uint64(pow(inverse, k, 1 << 64))))
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(0x5851F42D)) * MIX * self.powers[: len(codes)], out=sums[1:])
        keys = (sums[starts + sizes] - sums[starts]) * self.inverses[starts]
        keys ^= keys >> np.uint64(32)
        keys = (keys + sizes.astype(np.uint64)) * MIX
        return keys ^ (keys >> np.uint64(29))

    def entries(self, codes: np.ndarray, starts: np.ndarray, learn) -> np.ndarray:
        """The entry of each of the strings that begin at starts and make up codes. learn gives the numbers
        (joined, and how many for each) of those not known, told as (starts, sizes)."""
        if self.at.n > self.limit or self.codes.n > self.chars:
            self.clear()
        sizes = np.diff(np.append(starts, len(codes)))
        keys = self._keys(codes, starts, sizes)
        found = self.table.find(keys)
        if len(new := np.flatnonzero(found < 0)):
            own, first, inverse = np.unique(keys[new], return_index=True, return_inverse=True)
            found[new] = self._learn(codes, starts[new[first]], sizes[new[first]], learn)[inverse]
            self.table.add(own, found[new[first]])
        other = np.flatnonzero(self.size.all[found] != sizes)
        if len(other):  # a shared hash; the loop below compares strings of one size
            found[other] = self._learn(codes, starts[other], sizes[other], learn)
        differ = np.flatnonzero(self.codes.all[spread(self.at.all[found], sizes)] != codes)
        if len(differ):
            other = np.unique(np.searchsorted(starts, differ, "right") - 1)
            found[other] = self._learn(codes, starts[other], sizes[other], learn)
        return found

    def _learn(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, learn) -> np.ndarray:
        numbers, counts = learn(starts, sizes)
        first = self.at.n
        self.at.extend(self.codes.n + np.cumsum(sizes) - sizes)
        self.size.extend(sizes)
        self.codes.extend(codes[spread(starts, sizes)])
        self.out_at.extend(self.out.n + np.cumsum(counts) - counts)
        self.out_size.extend(counts)
        self.out.extend(numbers)
        return np.arange(first, self.at.n, dtype=np.int32)

    def numbers(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, counts): those of the entries, joined, and how many each has."""
        counts = self.out_size.all[entries]
        return self.out.all[spread(self.out_at.all[entries], counts)], counts
