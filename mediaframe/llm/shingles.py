"""Sets of word shingles as sorted 64-bit hashes, computed for a batch of texts at once."""

from __future__ import annotations

import numpy as np

from mediaframe.llm.common import kept_by

SHINGLE = 5
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: The modulus of word hashes, a prime: modulo a power of two, words such as that of Thue and Morse and its complement would be equal.
PRIME = (1 << 31) - 1
_P, _BITS = np.uint64(PRIME), np.uint64(31)
_MORE = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.Generator(np.random.PCG64(20240229))
#: Values of bytes and bases of the two hashes of a word.
_BYTES = _RNG.integers(1, PRIME, (2, 256), dtype=np.uint64)
_BASES = [int(b) for b in _RNG.integers(1 << 20, PRIME, 2)]


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, or the prime more; x is below 2^62."""
    return (x & _P) + (x >> _BITS)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """Powers of a base modulo the prime, n of them at least; they take 31 bits, and are kept as far as were needed."""
    made = kept_by("shingles")
    out = made.get(base, np.ones(1, np.uint32))
    while len(out) < n:
        out = np.concatenate([out, (out * np.uint64(pow(base, len(out), PRIME)) % _P).astype(np.uint32)])
    made[base] = out
    return out


def _words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 62-bit hash of each word: two polynomials modulo the prime, from sums over all bytes before."""
    out = (ends - starts).astype(np.uint64) * _MORE
    for values, base in zip(_BYTES, _BASES, strict=True):
        up, down = _powers(base, len(data)), _powers(pow(base, -1, PRIME), len(data))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_reduced(values[data] * up[: len(data)]), dtype=np.uint64)])
        out = mix(out + (total[ends] - total[starts]) % _P * down[starts] % _P)
    return out


def sets(texts: list[str | None], size: int = SHINGLE) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles: A-Z lower-cased, words between
    ASCII white space, `size` words each; with fewer words the whole sequence is one shingle,
    and a text without words has none. A null text is an empty one."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(r) + 1 for r in raw], np.int64)
    data = _LOWER[np.frombuffer(b" ".join(raw) + b" ", np.uint8)] if raw else np.zeros(0, np.uint8)
    if not len(data):
        return []
    word = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(word.astype(np.int8), prepend=0, append=0))
    starts, ends = edge[::2], edge[1::2]
    words = _words(data, starts, ends)
    bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
    n = len(words)
    whole = np.zeros(max(0, n - size + 1), np.uint64)
    for k in range(size if n >= size else 0):
        whole += mix(words[k : n - size + 1 + k] + np.uint64((k + 1) * int(_MORE) % 2**64))
    whole = mix(whole)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(whole[a : b - size + 1]))
        elif b > a:
            few = words[a:b]
            few = mix(few + np.arange(1, b - a + 1, dtype=np.uint64) * _MORE).sum(dtype=np.uint64, keepdims=True)
            out.append(mix(few ^ np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
