"""Polynomial hashes of byte strings with NumPy, modulo 2^64."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Odd, so that powers have inverses modulo 2^64. Fixed value.
BASE = 0x9E3779B97F4A7C15
#: Primes below 2^31 and a base for each. Fixed values.
PRIMES = ((2147483647, 1103515245), (2147483629, 1664525101))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


#: A worker outlives its tasks, so longer lists of powers are not kept.
MOST_KEPT = (1 << 21) + (1 << 18)
_known: dict[int | tuple[int, int], np.ndarray] = {}


def powers(n: int, base: int) -> np.ndarray:
    """base^0 .. base^n modulo 2^64; the longest list of each base is kept, up to MOST_KEPT."""
    if len(found := _known.get(base, ())) <= n:
        steps = np.full((n // (1 << 18) + 1 << 18) + 1, base, np.uint64)
        steps[0] = 1
        found = np.cumprod(steps)
        if n < MOST_KEPT:
            _known[base] = found
    return found[: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that every bit depends on every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; sorting is faster here than the hash table of np.unique()."""
    x = np.sort(x)
    keep = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=keep[1:])
    return x[keep]


class PrefixHashes:
    """Prefix hashes of a byte string; the hash of any substring follows from two of them."""

    def __init__(self, data: np.ndarray, base: int = BASE):
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data + np.uint64(1)) * powers(len(data), base)[:-1], out=self.prefix[1:])
        self.inverse = powers(len(data), pow(base, -1, 1 << 64))

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Hashes of substrings, the same wherever the substring stands."""
        return (self.prefix[start + length] - self.prefix[start]) * self.inverse[start]


def prime_powers(n: int, base: int, prime: int) -> np.ndarray:
    """base^0 .. base^n modulo a prime below 2^31, by doubling; kept like powers()."""
    key = (base, prime)
    if len(out := _known.get(key, ())) <= n:
        out = np.ones(1, np.uint64)
        while len(out) <= n:
            out = np.concatenate([out, out[: n + 1 - len(out)] * np.uint64(pow(base, len(out), prime)) % np.uint64(prime)])
        out = out.astype(np.uint32)
        if n < MOST_KEPT:
            _known[key] = out
    return out[: n + 1]


class PrimeHashes:
    """Prefix hashes modulo two primes, 62 bits together. Texts of up to 2^32 bytes."""

    def __init__(self, data: np.ndarray):
        self.parts = []
        for prime, base in PRIMES:
            prefix = np.zeros(len(data) + 1, np.uint64)
            np.cumsum((data + np.uint64(1)) * prime_powers(len(data), base, prime)[:-1] % np.uint64(prime), out=prefix[1:])
            self.parts.append((np.uint64(prime), prefix % np.uint64(prime), prime_powers(len(data), pow(base, -1, prime), prime)))

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Hashes of substrings, the same wherever the substring stands."""
        one, two = ((prefix[start + length] + prime - prefix[start]) % prime * inverse[start] % prime for prime, prefix, inverse in self.parts)
        return one << np.uint64(31) | two


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts, A-Z lowered: bytes of all texts, start and end of each word, and its text."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = LOWER[np.frombuffer(b"\n".join([*raw, b""]), np.uint8)]
    word = ~SPACE[data]
    edges = np.flatnonzero(np.diff(word, prepend=False, append=False))
    start, end = edges[::2], edges[1::2]
    bounds = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    return data, start, end, np.searchsorted(bounds, start, "right") - 1


def token_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix(PrefixHashes(data).of(start, end - start) + (end - start).astype(np.uint64))


def runs_of(sizes: np.ndarray, most: int) -> list[np.ndarray]:
    """Row numbers in groups whose sizes sum to about ``most``; a larger row is a group of its own."""
    if not len(sizes):
        return []
    group = np.cumsum(sizes) // most
    return np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(group)) + 1)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that a Python worker holds few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
