"""Words and hashes of whole Arrow batches of texts, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words are runs of bytes other than space and the controls \x09-\x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Maps A-Z to a-z and leaves every other byte, so UTF-8 stays whole.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

BLOCK = 1 << 19

_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER = _powers(_BASE, BLOCK + 1)
_INVERSE = _powers(pow(_BASE, -1, 1 << 64), BLOCK + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the public splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """Words of some texts, in order. ``first[d]:first[d + 1]`` are those of text d.

    ``data`` has the bytes of all words with one space between two; word w is
    ``data[start[w]:end[w]]``, so words a to b - 1 joined by spaces are ``data[start[a]:end[b - 1]]``.
    """

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def slices(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text each; a longer text is alone."""
    length = np.asarray(pc.fill_null(pc.binary_length(column), 0))
    total, begin = 0, 0
    for row, n in enumerate(length.tolist()):
        if row > begin and total + n > limit:
            yield begin, row
            begin, total = row, 0
        total += n
    if begin < len(length):
        yield begin, len(length)


def words(column: pa.Array, lower: bool = False, hashed: bool = True) -> Words:
    """All words of the texts with a 64-bit hash that depends on the word's bytes only. Null is empty."""
    texts = [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    at = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    black = ~SPACE[data]
    before = np.empty_like(black)
    before[:1] = False
    before[1:] = black[:-1]
    first = np.searchsorted(np.flatnonzero(black & ~before), at)
    if lower:
        data = LOWER[data]
    # The first white byte behind each word stays, as its one space.
    data = np.where(black, data, np.uint8(32))[black | before]
    end = np.flatnonzero(data == 32)
    start = np.empty_like(end)
    start[:1] = 0
    start[1:] = end[:-1] + 1
    return Words(data, start, end, _hashes(data, start, end) if hashed else end[:0].astype(np.uint64), first)


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of bytes times powers, taken as differences of running sums, block by block."""
    value = np.empty(len(start), dtype=np.uint64)
    done = 0
    while done < len(start):
        base = int(start[done])
        upto = max(int(np.searchsorted(end, base + BLOCK, side="right")), done + 1)
        stop = int(end[upto - 1])
        powers = _POWER if stop - base <= BLOCK else _powers(_BASE, stop - base + 1)
        sums = np.zeros(stop - base + 1, dtype=np.uint64)
        np.cumsum((data[base:stop].astype(np.uint64) + np.uint64(1)) * powers[: stop - base], out=sums[1:])
        s, e = start[done:upto] - base, end[done:upto] - base
        value[done:upto] = sums[e] - sums[s]
        if stop - base <= BLOCK:
            value[done:upto] *= _INVERSE[s]
        done = upto
    return mix(value + (end - start).astype(np.uint64))


def runs(value: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive hashes; position i covers i to i + width - 1."""
    n = len(value) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out = out * np.uint64(0xD6E8FEB86659FD93) + value[k : k + n]
    return mix(out)
