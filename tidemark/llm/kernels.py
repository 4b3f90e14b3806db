"""Vectorised text kernels over Arrow string buffers (UTF-8 bytes and offsets).

A column is handled as one byte array with row offsets, so words of a whole batch are found and hashed with a
few NumPy passes instead of a Python loop per row.  Batches are cut into pieces of bounded bytes first; a single
longer text is a piece of its own, and is never cut.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 2 << 20
_RATIO = np.uint64(0x9E3779B97F4A7C15 & ~7 | 5)  # odd, 5 modulo 8: powers stay far apart modulo 2**64
_INVERSE = np.uint64(pow(int(_RATIO), -1, 1 << 64))


try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim
except (OSError, AttributeError):
    _LIBC = None


def trim() -> None:
    """Gives freed memory back to the system, as workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def _lower() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = _lower()
#: Word bytes of [^\x20\x09-\x0D]+ and of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (after A-Z are lower-cased).
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x41:0x5B] = ALNUM[0x80:] = True


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (shift-multiply rounds) over an array of uint64."""
    x = (x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))).astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(256, dtype=np.uint64), 7)[LOWER] | np.uint64(1)
_pow: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow["up"]) < n:
        for name, r in (("up", _RATIO), ("down", _INVERSE)):
            x = np.full(n, r, np.uint64)
            x[0] = 1
            _pow[name] = np.multiply.accumulate(x)
    return _pow["up"][:n], _pow["down"][:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null is the empty text."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def pieces(batches: Iterable[pa.RecordBatch], column: str, most: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows of at most `most` bytes of text (one row at least), with their bytes and offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, off = buffers(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            yield batch.slice(at, to - at), data[off[at] : off[to]], off[at : to + 1] - off[at]
            at = to


def words(data: np.ndarray, off: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the first word of each row (rows + 1 entries)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    inside = kind[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = off[(off > 0) & (off < n)]
    begins[edge] |= inside[edge]
    ends[edge - 1] |= inside[edge - 1]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, off)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word with A-Z lower-cased, by prefix polynomials modulo 2**64."""
    up, down = _powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=prefix[1:])
    return mix((prefix[end] - prefix[start]) * down[start], 1)


def shingle_hashes(h: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `size` words of each row, or of the whole row if it has fewer, but any; with row starts."""
    count = np.diff(first)
    if len(h) >= size:
        run = h[: len(h) - size + 1].copy()
        for k in range(1, size):
            run = mix(run + h[k : len(h) - size + 1 + k] * np.uint64(2 * k + 0x51ED27), k)
        row = np.repeat(np.arange(len(count)), count)[: len(run)]
        keep = np.arange(len(run)) <= (first[1:] - size)[row]
        run = run[keep]
    else:
        run, keep = np.zeros(0, np.uint64), None
    n = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    out_first = np.concatenate([[0], np.cumsum(n)])
    short = np.flatnonzero((count > 0) & (count < size))
    if not len(short):
        return run, out_first
    out = np.zeros(out_first[-1], np.uint64)
    long = np.ones(len(out), bool)
    long[out_first[short]] = False
    out[long] = run
    for i in short:
        x = h[first[i] : first[i] + 1]
        for k in range(first[i] + 1, first[i + 1]):
            x = mix(x + h[k : k + 1] * np.uint64(0x51ED29), 3)
        out[out_first[i]] = mix(x, 1000 + int(count[i]))[0]
    return out, out_first
