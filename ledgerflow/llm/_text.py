"""Vectorised work on the UTF-8 bytes of many texts at once (numpy, inside tasks).

A Chunk holds the bytes of consecutive rows of an Arrow column, at most about CHUNK bytes and ROWS rows unless one
text alone is longer. Words and lines are found with byte tables, and any byte range gets a 64-bit
hash in constant time from prefix sums: a polynomial modulo 2**64 and one modulo a 31-bit prime. The sums are taken over at
most PIECE bytes at once, so a very long text costs a few bytes of memory a byte, besides what its words take.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

CHUNK, ROWS, PIECE = 1 << 18, 1_024, 1 << 18
PRIME = np.uint64((1 << 31) - 1)
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 bits (a bijection)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def byte_table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


#: White space that ends words, and upper case to lower case for A-Z.
SPACE = byte_table(b" \t\n\v\f\r")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

BASE, BASE31 = 0x9E3779B97F4A7C15 | 1, 1_103_515_245
VALUE = mix(np.arange(1, 257, dtype=U))
VALUE31 = mix(np.arange(1001, 1257, dtype=U)) % (PRIME - U(1)) + U(1)


def _powers(base: int, n: int, modulus: int) -> np.ndarray:
    out = np.ones(n, U)
    k = 1
    while k < n:
        step = U(pow(base, k, modulus))
        more = out[: min(k, n - k)] * step
        out[k : k + len(more)] = more % U(modulus) if modulus < 1 << 62 else more
        k *= 2
    return out


_tables: list[np.ndarray] = []


def tables(n: int) -> list[np.ndarray]:
    """Powers of both bases and of their inverses, at least n of each."""
    if not _tables or len(_tables[0]) < n:
        size = max(n, 1 << 16, PIECE + 2)
        two, p = 1 << 64, int(PRIME)
        _tables[:] = [_powers(BASE, size, two), _powers(pow(BASE, -1, two), size, two), _powers(BASE31, size, p), _powers(pow(BASE31, -1, p), size, p)]
    return _tables


class Prefix:
    """Prefix sums over a sequence of byte values, for hashes of its ranges."""

    def __init__(self, data: np.ndarray):
        up, _, up31, _ = tables(len(data) + 1)
        self.a = np.zeros(len(data) + 1, U)
        np.cumsum(VALUE[data] * up[: len(data)], out=self.a[1:])
        self.b = np.zeros(len(data) + 1, U)
        np.cumsum(VALUE31[data] * up31[: len(data)] % PRIME, out=self.b[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        _, down, _, down31 = tables(len(self.a))
        a = (self.a[end] - self.a[start]) * down[start]
        b = (self.b[end] - self.b[start]) % PRIME * down31[start] % PRIME
        return mix(a + b * U(0xD6E8FEB86659FD93) + (end - start).astype(U))


def _by_piece(start: np.ndarray, end: np.ndarray) -> Iterator[tuple[slice, int, int, bool]]:
    """(ranges, first place, last place, whether it is one long range) of stretches of ascending ranges, each of at most PIECE places."""
    lo = 0
    while lo < len(start):
        base = int(start[lo])
        hi = int(np.searchsorted(end[lo:], base + PIECE, "right")) + lo
        long_ = hi == lo
        hi = max(hi, lo + 1)
        yield slice(lo, hi), base, int(end[hi - 1]), long_
        lo = hi


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of ascending byte ranges that do not overlap; ranges of more than PIECE bytes are hashed whole."""
    out = np.empty(len(start), U)
    for at, lo, hi, long_ in _by_piece(start, end):
        if long_:
            out[at] = xxhash.xxh3_64_intdigest(np.ascontiguousarray(data[lo:hi]))
        else:
            out[at] = Prefix(data[lo:hi]).hash(start[at] - lo, end[at] - lo)
    return out


def sequence_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of ascending ranges of a sequence of 64-bit values, such as the words of a line; ranges of more than PIECE values are hashed whole."""
    out = np.empty(len(start), U)
    for at, lo, hi, long_ in _by_piece(start, end):
        part = mix(values[lo:hi])
        if long_:
            out[at] = xxhash.xxh3_64_intdigest(part)
            continue
        up, down, *_ = tables(len(part) + 1)
        total = np.zeros(len(part) + 1, U)
        np.cumsum(part * up[: len(part)], out=total[1:])
        s, e = start[at] - lo, end[at] - lo
        out[at] = mix((total[e] - total[s]) * down[s] + (e - s).astype(U))
    return out


def windows(values: np.ndarray, group: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of size consecutive values of one group, index of its first value)."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    h = values[:n].copy()
    for k in range(1, size):
        h = mix(h) * U(0xD6E8FEB86659FD93) + values[k : k + n]
    at = np.flatnonzero(group[:n] == group[size - 1 :])
    return mix(h[at]), at


class Chunk:
    def __init__(self, first: int, data: np.ndarray, off: np.ndarray):
        self.first, self.data, self.off = first, data, off
        self.n = len(off) - 1

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.off, at, "right") - 1

    def words(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, start, end) of the maximal runs of bytes where inside holds; a run ends with its text."""
        edge = np.zeros(len(inside) + 1, bool)
        edge[self.off] = True
        start = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1]))))
        end = np.flatnonzero(inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))) + 1
        return self.doc_of(start), start, end

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, start, end) of the parts between newlines; a text of n newlines has n + 1 lines."""
        cut = np.flatnonzero(self.data == 10)
        row = np.concatenate((np.arange(self.n), self.doc_of(cut)))
        order = np.argsort(row, kind="stable")
        row = row[order]
        start = np.concatenate((self.off[:-1], cut + 1))[order]
        end = np.empty_like(start)
        end[:-1] = start[1:] - 1
        last = np.append(row[1:] != row[:-1], True)
        end[last] = self.off[1:]
        return row, start, end

    def per_row(self, mask: np.ndarray) -> np.ndarray:
        """Number of marked bytes in each row."""
        total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return total[self.off[1:]] - total[self.off[:-1]]


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[Chunk]:
    """The rows of a string column in order (null: empty), cut between rows into chunks of about limit bytes and at most ROWS rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = min(max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1), lo + ROWS)
        yield Chunk(lo, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        lo = hi


def lists(row: np.ndarray, n: int, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Values with ascending row numbers as one list for each of n rows."""
    offsets = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
