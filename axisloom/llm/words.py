"""Words, hashes and windows of whole Arrow text columns as numpy arrays.

A text column is one long byte buffer.  ``Words`` finds the words of all its
documents at once and gives each a 64-bit hash, so that per-word work stays
inside numpy.  ``slices`` cuts a batch so that work arrays stay a few megabytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: bytes of text handled at once inside a task; a longer document is a slice of its own
SLICE_BYTES = 1 << 19

_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)

_powers = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept between calls."""
    kept = _powers.get(int(base))
    if kept is None or len(kept) < n:
        size = max(n, 1 << 16)
        kept = np.full(size, base, dtype=np.uint64)
        kept[0] = 1
        kept = np.cumprod(kept, dtype=np.uint64)
        _powers[int(base)] = kept
    return kept[:n]


_STEP = np.uint64(0xD1B54A32D192ED03)
_SIZE = np.uint64(0xD6E8FEB86659FD93)
#: windows longer than this would need another sum than ``window_hashes`` makes
MAX_WINDOW = 64


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of ``values[start:end]`` for ascending ranges that do not overlap.

    Every value is mixed with its place in the range before the sum, so no pattern of
    values, of any length, can cancel out.
    """
    n = len(values)
    first = np.zeros(n, dtype=np.int64)
    some = starts[starts < n]
    first[some] = some
    np.maximum.accumulate(first, out=first)
    place = (np.arange(n) - first).astype(np.uint64)
    total = np.empty(n + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(mix(values + place * _STEP), out=total[1:])
    size = (ends - starts).astype(np.uint64)
    return mix(total[ends] - total[starts] + size * _SIZE)


def _window_sums(values: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Hash of ``values[start:start + size]`` for overlapping windows, from one running sum.

    A polynomial modulo 2^64: patterns of up to 64 values can cancel no more than
    26 of the 64 bits, longer ones could cancel all.
    """
    n = len(values)
    total = np.empty(n + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(values * powers(_ODD, n), out=total[1:])
    back = powers(_ODD_INVERSE, n + 1)
    salt = np.uint64(size * int(_SIZE) & 0xFFFFFFFFFFFFFFFF)
    return mix((total[starts + size] - total[starts]) * back[starts] + salt)


def window_hashes(hashes: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` words that lie in one document, and their starts."""
    if size > MAX_WINDOW:
        raise ValueError(f"windows of more than {MAX_WINDOW} words")
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    starts = np.flatnonzero(doc[:n] == doc[size - 1 :])
    return _window_sums(hashes, starts, size), starts


# --- byte classes -------------------------------------------------------------

#: separators of ``[^\x20\x09-\x0D]+``
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: separators of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (texts are lower-cased before)
NON_ALNUM = np.zeros(256, dtype=bool)
NON_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
#: A-Z to a-z
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 document offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(column, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, bytes, offsets) of runs of documents of about ``limit`` bytes."""
    data, offsets = text_bytes(column)
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


class Words:
    """The words of a run of documents, in order.

    ``start``/``end`` are byte positions, ``doc`` the document number of each
    word, ``hash`` its 64-bit hash, ``count`` the words per document and
    ``first`` the number of each document's first word.  ``separators`` has a flag per
    byte value, or is a function that tells which bytes belong to words.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators=SPACE, lower: bool = False):
        self.data = LOWER[data] if lower else data
        n = len(data)
        inside = separators(self.data) if callable(separators) else ~separators[self.data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        borders = offsets[1:-1]
        borders = borders[borders < n]
        begins[borders] = inside[borders]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        last = borders[borders > 0] - 1
        ends[last] = inside[last]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets[:-1])
        self.count = np.diff(np.append(self.first, len(self.start)))
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.count)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def hash(self) -> np.ndarray:
        kept = self.__dict__.get("_hash")
        if kept is None:
            kept = self._hash = range_hashes(_BYTE_VALUE[self.data], self.start, self.end)
        return kept


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in any of the ranges."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1]) > 0


def distinct_per_doc(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, hash), sorted by document and hash."""
    order = np.lexsort((hashes, doc))
    d, h = doc[order], hashes[order]
    new = np.ones(len(d), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    return d[new], h[new]


def doc_digest(doc: np.ndarray, hashes: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums over each document's (distinct) hashes."""
    bounds = np.searchsorted(doc, np.arange(n_docs + 1))
    out = []
    for salt in (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)):
        total = np.zeros(len(hashes) + 1, dtype=np.uint64)
        np.cumsum(mix(hashes ^ salt), out=total[1:])
        out.append(total[bounds[1:]] - total[bounds[:-1]])
    return out[0], out[1]
