"""Vectorised words, word hashes and n-gram hashes over Arrow string buffers.

A column's texts are handled as one run of UTF-8 bytes with offsets, in chunks
of about a quarter of a megabyte, so the memory a task needs does not depend on how many
rows an Arrow batch has. Hashes are polynomials modulo 2**64 over bytes (words)
or over word hashes (n-grams), each passed through a bijective mixer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18
BLOCK_WORDS = 1 << 18
#: White space of the word pattern ``[^\x20\x09-\x0D]+``.
SEPARATORS = bytes([0x20, *range(0x09, 0x0E)])

_U = np.uint64
_IS_SEP = np.zeros(256, dtype=bool)
_IS_SEP[list(SEPARATORS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse, self.size = _U(base), _U(pow(base, -1, 1 << 64)), 0
        self.grow(1 << 12)

    def grow(self, n: int) -> None:
        if n > self.size:
            self.size = max(n, 2 * self.size)
            for name, base in (("up", self.base), ("down", self.inverse)):
                x = np.full(self.size, base, dtype=_U)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))


BYTE_POWERS = Powers(0x9E3779B97F4A7C15 | 1)
GRAM_POWERS = Powers(0xD1342543DE82EF95)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(32))
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    return h


@dataclass
class Chunk:
    """Rows ``lo..hi`` of a column: their bytes, and where each row's bytes begin."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray


def chunks(column: pa.Array, limit: int = CHUNK_BYTES, rows: int = 1 << 30) -> Iterator[Chunk]:
    """Runs of at most ``rows`` whole rows of about ``limit`` bytes (one row may be longer); a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return
    wide = pa.types.is_large_string(column.type)
    _, at, raw = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, len(column), lo + rows)
        yield Chunk(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


@dataclass
class Words:
    """Byte ranges of a chunk's words; words of row ``i`` are ``row[i]..row[i + 1]``."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray


def words(chunk: Chunk, separators: np.ndarray = _IS_SEP) -> Words:
    n = len(chunk.data)
    inside = ~separators[chunk.data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[chunk.offsets] = True
    first, last = inside.copy(), inside
    if n:
        outside = ~inside
        first[1:] &= outside[:-1] | edge[1:n]
        last = inside.copy()
        last[:-1] &= outside[1:] | edge[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(start, end, np.searchsorted(start, chunk.offsets))


class Joined:
    """A chunk's words with one space after each, for cryptographic digests of runs of words."""

    def __init__(self, chunk: Chunk, w: Words):
        n = len(chunk.data)
        keep = ~_IS_SEP[chunk.data]
        keep[w.end[w.end < n]] = True  # a separator, or the first word of the next text
        at = np.concatenate([[0], np.cumsum(keep)])
        self.first, self.last = at[w.start], at[w.end]
        self.data = np.where(_IS_SEP[chunk.data], np.uint8(32), chunk.data)[keep].tobytes()

    def digests(self, first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit halves of the BLAKE2b digest of words ``first..stop - 1`` of each run, joined by a space."""
        data = self.data
        raw = b"".join([blake2b(data[a:b], digest_size=16).digest() for a, b in zip(self.first[first].tolist(), self.last[stop - 1].tolist(), strict=True)])
        both = np.frombuffer(raw, dtype="<i8").reshape(-1, 2)
        return both[:, 0], both[:, 1]


def digest_of(words: list[str]) -> int:
    """The first half of ``Joined.digests``."""
    return int.from_bytes(blake2b(" ".join(words).encode(), digest_size=16).digest()[:8], "little", signed=True)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes as they are."""
    return _LOWER[data]


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, in blocks so that long texts need little memory."""
    out = np.empty(len(start), dtype=_U)
    for a in range(0, len(start), BLOCK_WORDS):
        b = min(a + BLOCK_WORDS, len(start))
        base, stop = int(start[a]), int(end[b - 1])
        n = stop - base
        BYTE_POWERS.grow(n + 1)
        total = np.zeros(n + 1, dtype=_U)
        np.cumsum((data[base:stop].astype(_U) + _U(1)) * BYTE_POWERS.up[:n], out=total[1:])
        s, e = start[a:b] - base, end[a:b] - base
        out[a:b] = (total[e] - total[s]) * BYTE_POWERS.down[s] + (e - s).astype(_U) * _U(0x9FB21C651E98DF25)
    return mix(out)


class Ranges:
    """Hashes of any runs of consecutive word hashes."""

    def __init__(self, hashes: np.ndarray, powers: Powers = GRAM_POWERS):
        powers.grow(len(hashes) + 1)
        self.powers = powers
        self.total = np.zeros(len(hashes) + 1, dtype=_U)
        np.cumsum(hashes * powers.up[: len(hashes)], out=self.total[1:])

    def __call__(self, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
        h = (self.total[stop] - self.total[first]) * self.powers.down[first]
        return mix(h + (stop - first).astype(_U) * _U(0xA0761D6478BD642F))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    if len(x) < width:
        return x[:0]
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
