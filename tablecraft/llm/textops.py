"""Vectorised helpers over Arrow text columns, used inside ``mapInArrow`` tasks.

A column is viewed as one byte buffer plus row offsets; words, lines and hashes
are found for all rows of a slice at once.  Slices are cut by bytes, so memory
follows the slice size (or one longest text), not the Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20

# word separators: blank, \t \n \v \f \r
IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, 9, 10, 11, 12, 13]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_CHAR = (np.arange(256) & 0xC0) != 0x80  # first byte of a code point

_R = np.uint64(0x9E3779B97F4A7C55)  # odd, so it has an inverse modulo 2**64
_RINV = np.uint64(pow(int(_R), -1, 1 << 64))
_BYTE = (np.random.default_rng(20240501).integers(0, 1 << 63, 256, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def quoted(name: str):
    """A column by its literal name."""
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows with columns named by position (``in_0``, ...), and that name of each column.

    Beside such columns an operator's own names meet no column of the caller.
    """
    place = {c: f"in_{k}" for k, c in enumerate(docs.columns)}
    return docs.select(*[quoted(c).alias(n) for c, n in place.items()]), place


def named_back(rows: DataFrame, place: dict[str, str]) -> DataFrame:
    """The caller's columns under their names again; all others go."""
    return rows.select(*[F.col(n).alias(c) for c, n in place.items()])


def flat(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    col = col.cast(pa.large_string()).cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
    n = len(col)
    _, offs, data = col.buffers()
    if n == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offs, np.int64, n + 1, col.offset * 8)
    base = int(offs[0])
    data = np.frombuffer(data, np.uint8, int(offs[-1]) - base, base) if data is not None and offs[-1] > base else np.zeros(0, np.uint8)
    return data, offs - base


def slices(offs: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text is a range of its own."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def text_slices(batches, column: str = "text", limit: int = SLICE_BYTES):
    """(rows, bytes, offsets) for bounded slices of every record batch."""
    for b in batches:
        data, offs = flat(b.column(b.schema.get_field_index(column)))
        for i, j in slices(offs, limit):
            yield b.slice(i, j - i), data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def edges(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the words of all rows; no word crosses a row."""
    w = IS_WORD[data]
    n = len(w)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    first = np.zeros(n + 1, bool)
    first[offs] = True
    start = w.copy()
    start[1:] &= ~w[:-1] | first[1:n]
    end = w.copy()
    end[:-1] &= ~w[1:] | first[1:n]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(offs, s, "right") - 1


def span_hash(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [s, e)."""
    n = len(data)
    pw = np.full(n + 1, _R, np.uint64)
    pw[0] = 1
    np.cumprod(pw, out=pw)
    acc = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * pw[:n], out=acc[1:])
    inv = np.full(n + 1, _RINV, np.uint64)
    inv[0] = 1
    np.cumprod(inv, out=inv)
    return mix((acc[e] - acc[s]) * inv[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def per_row(mask_or_count: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of a per-byte quantity by row."""
    acc = np.zeros(len(mask_or_count) + 1, np.int64)
    np.cumsum(mask_or_count, out=acc[1:])
    return acc[offs[1:]] - acc[offs[:-1]]


def run_starts(sorted_values: np.ndarray) -> np.ndarray:
    """Index of the first element of each run of equal values."""
    if len(sorted_values) == 0:
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))


def ranges(lengths: np.ndarray) -> np.ndarray:
    """0..l-1 for each length l, one after another."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    out = np.arange(total, dtype=np.int64)
    return out - np.repeat(np.cumsum(lengths) - lengths, lengths)


def mask_runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the maximal runs of marked bytes; no run crosses a row."""
    n = len(inside)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    first = np.zeros(n + 1, bool)
    first[offs] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | first[1:n]
    end[:-1] &= ~inside[1:] | first[1:n]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(offs, s, "right") - 1


def string_array(data: np.ndarray, offs: np.ndarray) -> pa.Array:
    """Arrow strings over contiguous bytes."""
    return pa.Array.from_buffers(pa.large_string(), len(offs) - 1, [None, pa.py_buffer(np.ascontiguousarray(offs, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
