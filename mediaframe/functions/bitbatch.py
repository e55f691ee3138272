"""A cursor over the bits of many byte strings at once: each read takes one field of every string that is read at that point, by numpy."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np


class BitBatch:
    """Reads of strings laid end to end. `on` tells which strings a read concerns; the others keep their
    place and give 0. A string that ends before a field is no longer `ok`, and gives 0 from then on."""

    def __init__(self, units: Sequence[bytes | None], skip: np.ndarray | None = None):
        sizes = np.array([len(u) if u is not None else 0 for u in units], np.int64)
        self.data = np.frombuffer(b"".join(u for u in units if u is not None) + bytes(16), np.uint8).astype(np.uint64)
        first = np.cumsum(sizes) - sizes
        self.end = 8 * (first + sizes)
        self.at = 8 * first + (0 if skip is None else 8 * skip)
        self.ok = np.array([u is not None for u in units], bool)

    def _on(self, on) -> np.ndarray:
        return self.ok if on is None else self.ok & on

    def left(self) -> np.ndarray:
        return self.end - self.at

    def _word(self, who: np.ndarray) -> np.ndarray:
        """At least 57 bits from the place of each string, highest first."""
        byte = self.at[who] >> 3
        word = np.zeros(len(byte), np.uint64)
        for k in range(8):
            word |= self.data[np.minimum(byte + k, len(self.data) - 1)] << np.uint64(56 - 8 * k)
        return word << (self.at[who] & 7).astype(np.uint64)

    def _take(self, n, on) -> tuple[np.ndarray, np.ndarray]:
        """The strings of `on` that have n more bits, and how many; those that don't have fail."""
        on = self._on(on)
        n = np.broadcast_to(np.asarray(n, np.int64), on.shape)
        self.ok = self.ok & ~(on & (self.at + n > self.end))
        who = np.flatnonzero(on & self.ok)
        return who, n[who]

    def skip(self, n, on=None) -> None:
        who, n = self._take(n, on)
        self.at[who] += n

    def align(self, on=None) -> None:
        """To the next whole byte; strings begin at one."""
        self.skip(-self.at % 8, on)

    def u(self, n, on=None) -> np.ndarray:
        """n bits, 56 at most, as a number."""
        out = np.zeros(len(self.ok), np.int64)
        who, n = self._take(n, on)
        some = n > 0
        who, n = who[some], n[some]
        out[who] = (self._word(who) >> (64 - n).astype(np.uint64)).astype(np.int64)
        self.at[who] += n
        return out

    def flag(self, on=None) -> np.ndarray:
        return self.u(1, on) == 1

    def ue(self, on=None) -> np.ndarray:
        """An unsigned Exp-Golomb number; more than 31 zeros fail."""
        on = self._on(on)
        who = np.flatnonzero(on)
        head = (self._word(who) >> np.uint64(32)).astype(np.float64)
        zeros = 32 - np.frexp(head)[1]  # frexp gives the bit length of whole numbers
        self.ok = self.ok.copy()
        self.ok[who[zeros > 31]] = False
        every = np.zeros(len(self.ok), np.int64)
        every[who] = np.minimum(zeros, 31)
        self.skip(every, on)
        return np.where(self._on(on), self.u(every + 1, on) - 1, 0)

    def se(self, on=None) -> np.ndarray:
        k = self.ue(on)
        return np.where(k % 2 == 1, (k + 1) // 2, -(k // 2))

    def times(self, count, on=None) -> Iterator[tuple[int, np.ndarray]]:
        """k and the strings that have a k-th of count fields, while there is one."""
        k = 0
        while (more := self._on(on) & (k < count)).any():
            yield k, more
            k += 1
