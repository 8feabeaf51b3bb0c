"""Words of many texts at once, in numpy: positions, 64-bit hashes and 5-word shingles.

A word is ``[^\\x20\\x09-\\x0D]+``.  The hash of a word depends on its bytes alone, whichever batch it is in.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; one longer text makes one larger chunk.
CHUNK = 1 << 18

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_NO_LETTER = ~_LETTER
_NO_LETTER[128:] = False
_MARK = np.zeros(256, dtype=bool)
_MARK[list(b".,;:!?*#%$&|()[]{}<>\"'/+=-_@~^`\\")] = True
_RANDOM = np.random.Generator(np.random.PCG64(20240607))
_OF_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for at least ``n`` places."""
    if not _tables or len(_tables["up"]) < n:
        size = max(CHUNK + (CHUNK >> 2), n)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _tables[name] = np.multiply.accumulate(steps)
    return _tables["up"], _tables["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values under which every bit depends on every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def chunks(batches: Iterator[pa.RecordBatch], text: str, size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about ``size`` bytes of text each."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            done = int(sizes[start - 1]) if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, done + size, side="right")))
            yield batch.slice(start, end - start)
            start = end
    release()


def release() -> None:
    """Gives memory that is no longer used back to the system, so that idle workers stay small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not on this platform
        pass


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes and the n + 1 places where they start and end; null counts as empty."""
    texts = pa.concat_arrays([pc.fill_null(texts.cast(pa.large_string()), "")])
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or texts.buffers()[2] is None:
        return np.zeros(0, dtype=np.uint8), offsets - offsets[0] if len(offsets) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def words(data: np.ndarray, bounds: np.ndarray, lower: bool, marks_apart: bool = False, letters_only: bool = False, longest: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word, and the n + 1 places in these where the texts' words start and end.

    ``marks_apart``: an ASCII mark that follows an ASCII letter begins a word of its own.  ``letters_only``: all ASCII
    characters but letters count as white space.  ``longest``: words of more bytes are cut, at character bounds, into pieces
    that cover them, each a word of its own.
    """
    n = len(data)
    if not n:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, np.zeros(0, dtype=np.uint64), np.zeros(len(bounds), dtype=np.int64)
    inside = np.concatenate(([False], ~(_NO_LETTER if letters_only else _SPACE)[data], [False]))
    begins = inside[1:-1] & ~inside[:-2]
    stops = inside[1:-1] & ~inside[2:]
    edges = bounds[1:-1]  # a text may end in a word and the next begin with one
    cut = edges[(edges > 0) & (edges < n)]
    begins[cut] = inside[1:-1][cut]
    stops[cut - 1] = inside[1:-1][cut - 1]
    if marks_apart:
        cut = np.flatnonzero(_LETTER[data[:-1]] & _MARK[data[1:]]) + 1
        begins[cut] = stops[cut - 1] = True
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    if longest:
        starts, ends = _cut(data, starts, ends, longest)
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_OF_BYTE[_LOWER[data] if lower else data] * up[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return starts, ends, hashes, np.searchsorted(starts, bounds)


def _cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """The words, with those of more than ``longest`` bytes in pieces of at most that; each round cuts one piece off every long word."""
    long = ends - starts > longest
    if not long.any():
        return starts, ends
    at, stop, breaks = starts[long], ends[long], []
    while len(at):
        at = at + longest
        for _ in range(3):  # a character has at most three bytes behind its first
            at = at - ((data[at] & 0xC0) == 0x80)
        breaks.append(at)
        more = stop - at > longest
        at, stop = at[more], stop[more]
    cuts = np.concatenate(breaks)
    return np.sort(np.concatenate((starts, cuts))), np.sort(np.concatenate((ends, cuts)))


class Known:
    """A bounded map from 64-bit hashes to small values, as two sorted arrays."""

    def __init__(self, kind: type, most: int) -> None:
        self.kind, self.most = kind, most
        self.clear()

    def clear(self) -> None:
        self.keys, self.values = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=self.kind)

    def missing(self, hashes: np.ndarray) -> np.ndarray:
        """Which of these distinct hashes are not known; all, if they would not fit: then the map begins anew."""
        new = ~np.isin(hashes, self.keys, assume_unique=True)
        if len(self.keys) + int(new.sum()) > self.most:
            self.clear()
            new[:] = True
        return new

    def add(self, hashes: np.ndarray, values: np.ndarray) -> None:
        at = np.searchsorted(self.keys, hashes)
        self.keys, self.values = np.insert(self.keys, at, hashes), np.insert(self.values, at, values)

    def get(self, hashes: np.ndarray) -> np.ndarray:
        return self.values[np.searchsorted(self.keys, hashes)]


def shingles(hashes: np.ndarray, at: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of ``width`` words of each text, and the text of each; a shorter text is one window."""
    counts = np.diff(at)
    n_windows = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(counts)), n_windows)
    if not len(doc):
        return np.zeros(0, dtype=np.uint64), doc
    first = at[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    lengths = np.minimum(counts, width)[doc]
    out = np.zeros(len(doc), dtype=np.uint64)
    padded = np.concatenate((hashes, np.zeros(width, dtype=np.uint64)))
    for k in range(width):
        has = lengths > k
        out = np.where(has, out * np.uint64(_BASE) + padded[first + k], out)
    return mix(out + lengths.astype(np.uint64)), doc


def distinct(values: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct values in order, and the n + 1 places where the texts' values start and end."""
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    if len(values):
        new = np.concatenate(([True], (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])))
        values, doc = values[new], doc[new]
    return values, np.searchsorted(doc, np.arange(n_docs + 1))
