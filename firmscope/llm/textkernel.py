"""Whole-batch text work on the raw UTF-8 buffers of Arrow string columns.

Word splitting, lower-casing and hashing are done on one ``uint8`` array per
chunk of documents, so the cost is a few array passes per byte instead of a
Python object per word. ASCII separators never occur inside a multi-byte UTF-8
sequence, so byte-level splitting equals code-point-level splitting.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer document forms a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Bytes whose words are hashed at once.
HASH_BYTES = 1 << 17

try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # another C library keeps its own ways
    _libc = None

_SPACES = (0x20, *range(0x09, 0x0E))
_GOLDEN = 0x9E3779B97F4A7C15
_STEP = 0xD1342543DE82EF95  # odd base of the positional word hash
_GRAM = 0xDA942042E4DD58B5  # odd base of the n-gram hash


def _lower(table: np.ndarray) -> np.ndarray:
    table[0x41:0x5B] = np.arange(0x61, 0x7B, dtype=np.uint8)
    return table


def _space_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[list(_SPACES)] = 0
    # NUL is a word character; byte 0xFF never occurs in UTF-8 and stands in for it.
    table[0] = 0xFF
    return table


#: Byte maps; 0 marks a separator.
AS_IS = _space_table()
LOWER = _lower(_space_table())


def _alnum_table() -> np.ndarray:
    table = np.zeros(256, dtype=np.uint8)
    table[0x30:0x3A] = np.arange(0x30, 0x3A)
    table[0x61:0x7B] = np.arange(0x61, 0x7B)
    table[0x80:] = np.arange(0x80, 0x100)
    return _lower(table)


ALNUM = _alnum_table()


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_GOLDEN))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES)
        for k, base in enumerate((_STEP, pow(_STEP, -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Words:
    """The words of a chunk of documents.

    ``first`` has one entry a document plus one: the words of document ``i``
    are ``first[i]:first[i + 1]``; ``starts``/``ends`` are byte positions.
    """

    data: np.ndarray
    mapped: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """Document index of every word."""
        return np.repeat(np.arange(len(self.first) - 1), self.n_words)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word, equal for equal mapped bytes."""
        out, at = np.empty(len(self.starts), np.uint64), 0
        while at < len(out):
            # Pieces keep what is held beside a long text small; a long word is a piece.
            low = self.starts[at]
            to = max(int(np.searchsorted(self.ends, low + HASH_BYTES, "right")), at + 1)
            starts, ends = self.starts[at:to] - low, self.ends[at:to] - low
            power, inverse = _power_tables(int(ends[-1]) + 1)
            total = np.zeros(len(power), np.uint64)
            np.cumsum(_VALUES[self.mapped[low : low + ends[-1]]] * power[:-1], out=total[1:])
            out[at:to] = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
            at = to
        return out


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = AS_IS) -> Words:
    mapped = table[data]
    inside = mapped != 0
    before = np.zeros(len(inside) + 1, bool)
    before[1:] = inside
    before[offsets] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(len(inside) + 1, bool)
    after[:-1] = inside
    after[offsets] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return Words(data, mapped, offsets, starts, ends, np.searchsorted(starts, offsets))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on (length ``len(h) - k + 1``)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = h[:n].copy()
    for j in range(1, k):
        g *= np.uint64(_GRAM)
        g += h[j : j + n]
    return mix(g + np.uint64(k))


def gram_starts(first: np.ndarray, k: int) -> np.ndarray:
    """Word positions where a window of k words stays inside its document."""
    counts = np.maximum(np.diff(first) - k + 1, 0)
    return ranges(first[:-1], counts)


def ranges(begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of ``begin[i] .. begin[i] + counts[i] - 1``."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    at = np.cumsum(counts) - counts
    return np.arange(total) + np.repeat(begin - at, counts)


def spans_to_mask(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Boolean mask of length n that is true inside any [start, end)."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, ends, -1)
    return np.cumsum(delta[:-1]) > 0


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return d, o - o[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of pieces of about ``limit`` bytes."""
    data, offsets = buffers(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
    if len(data) > limit:
        _give_back()


def _give_back() -> None:
    """Hand free memory back to the system: a worker lives on beside the next stages."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def bucket(h: np.ndarray, n: int) -> np.ndarray:
    """Map hashes evenly to 0 .. n - 1 (by their high bits)."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
