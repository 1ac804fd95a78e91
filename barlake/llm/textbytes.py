"""Vectorised text work on Arrow string columns.

Everything here acts on the UTF-8 bytes of many texts at once: no Python string per word is made. Texts are
taken in pieces of about a megabyte, so that memory is bounded by the longest single text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20
#: Bytes from which a range is hashed by a digest.
LONG = 256

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)

#: Bytes of the words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text: digits, a-z and all beyond ASCII.
WORD = np.zeros(256, bool)
WORD[list(range(0x30, 0x3A)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = True
#: Bytes of the words `[^\x20\x09-\x0D]+`.
NONSPACE = np.ones(256, bool)
NONSPACE[[0x20, *range(0x09, 0x0E)]] = False
#: A-Z to a-z, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: Bytes that begin a code point.
LEADS = (np.arange(256) & 0xC0) != 0x80


@dataclass
class Piece:
    """Rows lo to hi of a batch: their bytes one after another, and where each row's bytes begin."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return self.hi - self.lo

    def raw(self, row: int) -> bytes:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes()


def pieces(column: pa.Array, size: int = PIECE_BYTES) -> Iterator[Piece]:
    """Consecutive rows of about `size` bytes together; null is an empty text."""
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    column = pc.fill_null(column, "")
    if len(column) == 0:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1
        hi = min(max(hi, lo + 1), len(column))
        yield Piece(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, PIECE_BYTES + 1)
        if size > 4 * PIECE_BYTES:  # a very long text: not kept
            grow = np.full(size, _BASE), np.full(size, _BASE_INVERSE)
            for table in grow:
                table[0] = 1
            return np.cumprod(grow[0]), np.cumprod(grow[1])
        _powers, _inverses = np.full(size, _BASE), np.full(size, _BASE_INVERSE)
        _powers[0] = _inverses[0] = 1
        _powers, _inverses = np.cumprod(_powers), np.cumprod(_inverses)
    return _powers, _inverses


@dataclass
class Words:
    """The words of a piece: byte ranges, 64-bit hashes, and the first word of each row."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of True that don't cross a row's bounds."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    filled = np.flatnonzero(np.diff(offsets))
    begins = np.empty(n, bool)
    begins[0] = inside[0]
    np.logical_and(inside[1:], ~inside[:-1], out=begins[1:])
    heads = offsets[filled]
    begins[heads] = inside[heads]
    closes = np.empty(n, bool)
    closes[-1] = inside[-1]
    np.logical_and(inside[:-1], ~inside[1:], out=closes[:-1])
    tails = offsets[filled + 1] - 1
    closes[tails] = inside[tails]
    return np.flatnonzero(begins), np.flatnonzero(closes) + 1


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, independent of where it lies. Polynomials modulo 2 ** 64 are alike for known pairs of texts
    of 1,024 bytes and more, so ranges of LONG bytes and more take a digest."""
    powers, inverses = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=sums[1:])
    out = mix((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    for i in np.flatnonzero(ends - starts >= LONG):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def words(piece: Piece, alphabet: np.ndarray = WORD, hashed: bool = True) -> Words:
    """The words of a piece whose bytes the caller has lower-cased where it wants that."""
    starts, ends = runs(alphabet[piece.data], piece.offsets)
    first = np.searchsorted(starts, piece.offsets)
    return Words(starts, ends, first, range_hashes(piece.data, starts, ends) if hashed else np.zeros(0, np.uint64))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive hashes; rows are not looked at."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= np.uint64(0x9FB21C651E98DF25)
        out += hashes[j : j + n]
    return mix(out)


def lowered(piece: Piece) -> Piece:
    return Piece(piece.lo, piece.hi, LOWER[piece.data], piece.offsets)


def text_of(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
