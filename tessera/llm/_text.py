"""Words of many texts at once, on the bytes of an Arrow column.

A batch is cut into blocks of about BLOCK bytes, so memory stays bounded however many rows a batch holds. Words are maximal runs
of word bytes; both word classes used here treat every byte above 0x7F as part of a word, so bytes and code points agree.
A word's hash is a polynomial over random values of its bytes, mixed to 64 bits; two different words share one with a
probability of about 2^-58.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 2_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words between ASCII white space (0x20, 0x09-0x0D).
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Words of digits, letters a-z (after lower-casing) and everything above 0x7F.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_libc = ctypes.CDLL(None)


def give_back() -> None:
    """Returns freed memory to the machine at the end of a task: a worker lives on, and the next stage's tasks run beside it."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


_BASE = 0x9E3779B97F4A7C13 | 3
_INVERSE = pow(_BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_OF_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, BLOCK + 4096), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps)
    return have[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[starts[i]:ends[i]]; spans are in order and disjoint."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, side="right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        sums = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(_OF_BYTE[data[lo:hi]] * _power(_BASE, hi - lo), out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mixed((sums[e] - sums[s]) * _power(_INVERSE, hi - lo)[s] + (e - s).astype(np.uint64))
        i = j
    return out


class Block:
    """Some rows' words. ``first[r]:first[r + 1]`` are the words of row r; ``starts`` and ``ends`` point into ``data``."""

    def __init__(self, offset: int, data: np.ndarray, rows: np.ndarray, kind: np.ndarray):
        self.offset, self.data, self.row_starts = offset, data, rows
        word = kind[data]
        edges = np.flatnonzero(word[1:] != word[:-1]) + 1
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.first = np.searchsorted(self.starts, rows)

    def __len__(self) -> int:
        return len(self.row_starts) - 1

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.first))


def _raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return at, np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)


def blocks(column: pa.Array, kind: np.ndarray, lower: bool = True, limit: int = BLOCK) -> Iterator[Block]:
    """The rows of a string column (null: empty) in blocks of about ``limit`` bytes; a longer text is a block of its own."""
    at, data = _raw(column)
    a, n = 0, len(column)
    while a < n:
        b = max(a + 1, int(np.searchsorted(at, at[a] + limit, side="right")) - 1)
        lengths = np.diff(at[a : b + 1])
        rows = np.concatenate(([1], 1 + np.cumsum(lengths + 1)))
        own = np.full(int(rows[-1]) + 1, 32, dtype=np.uint8)
        for k in range(b - a):
            own[rows[k] : rows[k] + lengths[k]] = data[at[a + k] : at[a + k + 1]]
        yield Block(a, _LOWER[own] if lower else own, rows, kind)
        a = b


def runs(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n words from each place on (those that run past the end are left out)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(m, n, dtype=np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[k : k + m]
    return mixed(out)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased texts as one array of code points, each text between line feeds, and where each begins and the last ends."""
    lowered = [t.lower() for t in texts]
    starts = np.zeros(len(lowered) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in lowered], out=starts[1:])
    joined = "\n" + "\n".join(lowered) + "\n"
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4"), starts


def text_groups(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, list[str]]]:
    """The rows of a string column (null: empty), about ``limit`` characters at a time, each group with its first row's number."""
    first, size, texts = 0, 0, []
    for k, t in enumerate(column):
        t = t.as_py() or ""
        if texts and size + len(t) > limit:
            yield first, texts
            first, size, texts = k, 0, []
        texts.append(t)
        size += len(t)
    if texts:
        yield first, texts
