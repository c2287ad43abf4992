"""Vectorised text primitives over Arrow string columns.

The bytes of a whole batch are handled at once in numpy: no Python loop runs
per word.  A word's hash is a difference of prefix sums of a polynomial modulo
2**64, finished by a 64-bit mixer.
"""

from __future__ import annotations

import ctypes
import inspect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
CHUNK_BYTES = 1 << 20
_POWERS_OF_STEP = np.multiply.accumulate(np.full(64, _BASE))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, 0 to n."""
    if len(_POWERS.get("up", ())) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, U)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def give_back() -> None:
    """Return to the system what was freed; else a worker holds on to the most that it ever used, also while it is idle."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def lean(work: Callable) -> Callable:
    """``work`` on batches, or on one or two tables, giving back at its end what it freed."""

    def batches(rows):
        yield from work(rows)
        give_back()

    def table(rows):
        try:
            return work(rows)
        finally:
            give_back()

    def tables(left, right):
        try:
            return work(left, right)
        finally:
            give_back()

    return batches if inspect.isgeneratorfunction(work) else tables if len(inspect.signature(work).parameters) == 2 else table


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def to_unit(x: np.ndarray) -> np.ndarray:
    """Hashes as doubles in (0, 1)."""
    return ((x >> U(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


def lower_lut() -> np.ndarray:
    """Byte table that lower-cases A-Z and leaves the rest."""
    lut = np.arange(256, dtype=np.uint8)
    lut[65:91] += 32
    return lut


LOWER = lower_lut()


def fold(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z and the Latin-1 capitals (C3 80 to C3 9E, but not the multiplication sign) lower-cased."""
    low = LOWER[data]
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    upper = second[(data[second] >= 0x80) & (data[second] <= 0x9E) & (data[second] != 0x97)]
    low[upper] += 0x20
    return low


def word_mask() -> np.ndarray:
    """ASCII letters and digits and every byte of a non-ASCII character."""
    mask = np.zeros(256, bool)
    for a, b in ((48, 58), (65, 91), (97, 123), (128, 256)):
        mask[a:b] = True
    return mask


def blank_mask() -> np.ndarray:
    """Everything but space and the controls 09-0D: the inside of a blank-separated word."""
    mask = np.ones(256, bool)
    mask[[32, 9, 10, 11, 12, 13]] = False
    return mask


WORD, NONBLANK = word_mask(), blank_mask()


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1 + column.offset)[column.offset :] if offsets else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets): runs of whole rows of about ``limit`` bytes."""
    data, at = string_buffers(column)
    low, n = 0, len(at) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(at, at[low] + limit, "right")) - 1)
        yield low, high, data[at[low] : at[high]], at[low : high + 1] - at[low]
        low = high


def runs(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte (starts, ends) of the maximal runs of ``inside`` that don't cross a row's edge."""
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = at[1:-1][(at[1:-1] < len(inside)) & (at[1:-1] > 0)]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def code_points(data: np.ndarray) -> np.ndarray:
    """Code points before each byte position, 0 to len(data)."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


class Words:
    """Words of a chunk: hash, byte start and end of each, and where each row's words begin.

    Case is folded for A-Z and, unless ``ascii_only``, for the Latin-1 letters.
    """

    def __init__(self, data: np.ndarray, at: np.ndarray, mask: np.ndarray = WORD, ascii_only: bool = False):
        n = len(data)
        self.start, self.end = runs(mask[data], at)
        up, down = _powers(n)
        sums = np.zeros(n + 1, U)
        np.cumsum(((LOWER[data] if ascii_only else fold(data)).astype(U) + U(1)) * up[:n], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start])
        self.at = np.searchsorted(self.start, at)

    def rows(self) -> np.ndarray:
        """Row of each word."""
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of k words; a row of 1 to k-1 words has one shingle of all its words."""
    h, at = words.hash, words.at
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    made = np.zeros(len(h), U)
    position = np.arange(len(h)) - at[row]
    left = at[row + 1] - np.arange(len(h))
    for j in range(k):
        step = mix(h + _POWERS_OF_STEP[j])
        shifted = np.zeros(len(h), U)
        shifted[: len(h) - j] = step[j:]
        made += np.where(left > j, shifted, U(0))
    good = (left >= k) | (position == 0)
    return row[good], mix(made[good])


def sequence_digests(words: Words) -> np.ndarray:
    """128-bit digests of each row's word sequence, as an (n, 2) array."""
    h, at = words.hash, words.at
    n = len(at) - 1
    out = np.zeros((n, 2), U)
    place = (np.arange(len(h)) - at[words.rows()]).astype(U)
    full = np.flatnonzero(np.diff(at))
    for c, salt in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
        terms = mix(h ^ mix(place * _BASE + U(salt)))
        if len(full):
            out[full, c] = mix(np.add.reduceat(terms, at[full]) + U(salt))
    return out


def binary_column(rows: np.ndarray) -> pa.Array:
    """Rows of a C-contiguous array as a binary column."""
    flat = np.ascontiguousarray(rows)
    width = flat.dtype.itemsize * (flat.shape[1] if flat.ndim > 1 else 1)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(flat), [None, pa.py_buffer(flat)]).cast(pa.binary())
