"""Vectorised text helpers over Arrow arrays, used inside ``mapInArrow`` functions.

All of them take whole texts and keep memory near a few times ``SLICE_BYTES``: incoming record
batches are cut into runs of rows of about that much text (one longer text is a run of its own).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes handled at once by the numpy code.
SLICE_BYTES = 4 << 20


def texts(column) -> pa.Array:
    """The column as a plain string array without nulls (null: empty text)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    return pc.fill_null(column, "") if column.null_count else column


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows, starting at 0) of a large string or binary array."""
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    data = array.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, name: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Runs of rows of ``batch`` with their texts, about ``most`` bytes of text each."""
    if not batch.num_rows:
        return
    array = texts(batch.column(name))
    _, offsets = utf8(array)
    start = 0
    while start < len(array):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield batch.slice(start, end - start), array.slice(start, end - start)
        start = end
    tidy()


def tidy() -> None:
    """Gives freed memory back, so that a worker that waits for its next task doesn't keep what the last one took."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


_LIBC = ctypes.CDLL(None)


def words(array: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all texts in one array, and the offsets of each text's words."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(array) if lower else array)
    offsets = np.asarray(parts.offsets, np.int64)
    flat = parts.values.slice(offsets[0], offsets[-1] - offsets[0])
    full = np.asarray(pc.binary_length(flat)) > 0
    before = np.concatenate(([0], np.cumsum(full)))
    return (flat if full.all() else flat.filter(pa.array(full))), before[offsets - offsets[0]]


def coded(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes of the strings, and the distinct strings they stand for."""
    d = flat.dictionary_encode()
    return np.asarray(d.indices, np.int64), d.dictionary


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal inputs stay equal, all bits of the input reach all of the output."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hashes(array: pa.Array, seed: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """64-bit hashes of the strings of a large string array: byte i of a string weighs M to the i, mod 2**64, mixed."""
    data, offsets = utf8(array.cast(pa.large_string()) if not pa.types.is_large_string(array.type) else array)
    lengths = np.diff(offsets)
    out = mix(lengths.astype(np.uint64) + np.uint64(seed))
    if len(data):
        place = np.arange(len(data), dtype=np.int64) - np.repeat(offsets[:-1], lengths)
        weights = np.multiply.accumulate(np.full(int(lengths.max()) + 1, 0x5851F42D4C957F2D, np.uint64))
        terms = mix(data.astype(np.uint64) + np.uint64(1 + (seed & 0xFFFF))) * weights[place]
        full = lengths > 0
        out[full] += np.add.reduceat(terms, offsets[:-1][full])
    return mix(out)


def within(offsets: np.ndarray) -> np.ndarray:
    """The text number of every item, from the offsets of each text's items."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def until(data: np.ndarray, at: int, stop: int, ends: np.ndarray) -> int:
    """The first place from ``at`` on whose byte is marked in ``ends`` (a table of 256), or ``stop``."""
    while at < stop:
        hit = np.flatnonzero(ends[data[at : min(stop, at + 65536)]])
        if len(hit):
            return at + int(hit[0])
        at = min(stop, at + 65536)
    return stop


def pieces(data: np.ndarray, offsets: np.ndarray, most: int, ends: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first text, last text + 1, from, to): runs of texts of about ``most`` bytes; a longer text is cut where a byte is marked in ``ends``."""
    text = 0
    while text < len(offsets) - 1:
        last = max(text + 1, int(np.searchsorted(offsets, offsets[text] + most, "right")) - 1)
        start, stop = int(offsets[text]), int(offsets[last])
        while stop - start > most:  # one long text
            at = until(data, start + most, stop, ends)
            yield text, last, start, at
            start = at
        yield text, last, start, stop
        text = last
