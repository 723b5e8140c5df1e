"""Vectorised word hashing over Arrow string columns.

A word is a maximal run of ASCII letters/digits and non-ASCII characters; the Unicode
blocks U+00A0-U+00BF, U+2000-U+207F and U+3000-U+303F separate words, and every
character with a UTF-8 lead byte E4..E9 (CJK ideographs, Hangul) is a word of its own.
Text is lower-cased first.  All arithmetic is modulo 2**64, so a word has the same hash
in every document, process and Python version.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)


def _byte_values() -> np.ndarray:
    x = np.arange(1, 257, dtype=U64) * U64(0xD1B54A32D192ED03)
    return mix(x)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_VALUE = _byte_values()
_WORD = np.zeros(256, dtype=bool)
for _r in (range(48, 58), range(97, 123), range(65, 91), range(128, 256)):
    _WORD[_r.start : _r.stop] = True
_power: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_power[0]) < n:
        size = max(n, CHUNK_BYTES + (1 << 16))
        for k, b in enumerate((_BASE, _INV)):
            table = np.full(size, b, dtype=U64)
            table[0] = 1
            _power[k] = np.multiply.accumulate(table)
    return _power[0], _power[1]


class Words(NamedTuple):
    """doc: row of each word; hash: its hash; start, end: byte range in data; data: the lower-cased bytes; offsets: row starts."""

    doc: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray
    offsets: np.ndarray


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0 or buffers[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(buffers[2], dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(column: pa.Array) -> Words:
    """Every word of every row, in order."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    data, offsets = utf8(pc.utf8_lower(column.cast(pa.large_string())))
    n = len(data)
    if n == 0:
        e = np.zeros(0, np.int64)
        return Words(e, np.zeros(0, U64), e, e, data, offsets)
    word = _WORD[data]
    high = np.flatnonzero(data >= 0xC2)
    cut = np.zeros(n + 1, dtype=bool)  # a word can't go on across these
    if len(high):
        lead = data[high]
        follow = data[np.minimum(high + 1, n - 1)]
        two = high[(lead == 0xC2) & (follow <= 0xBF)]
        three = high[((lead == 0xE2) & (follow <= 0x81)) | ((lead == 0xE3) & (follow == 0x80))]
        for at, width in ((two, 2), (three, 3)):
            for k in range(width):
                word[np.minimum(at + k, n - 1)] = False
        single = high[(lead >= 0xE4) & (lead <= 0xE9)]
        cut[single] = True
        cut[np.minimum(single + 3, n)] = True
    cut[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = word[:-1]
    start = np.flatnonzero(word & (cut[:n] | ~before))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = word[1:]
    end = np.flatnonzero(word & (cut[1:] | ~after)) + 1
    up, down = _powers(n + 1)
    with np.errstate(over="ignore"):
        sums = np.empty(n + 1, dtype=U64)
        sums[0] = 0
        np.cumsum(_VALUE[data] * up[:n], out=sums[1:])
        hashed = mix((sums[end] - sums[start]) * down[start])
    doc = np.searchsorted(offsets, start, side="right") - 1
    return Words(doc, hashed, start, end, data, offsets)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of k words; a row of 1 to k-1 words gives one shingle of them all."""
    with np.errstate(over="ignore"):
        n = len(w.hash)
        rows, out = [], []
        if n >= k:
            h = np.zeros(n - k + 1, dtype=U64)
            for j in range(k):
                h = (h + w.hash[j : n - k + 1 + j]) * U64(_BASE)
            ok = w.doc[: n - k + 1] == w.doc[k - 1 :]
            rows.append(w.doc[: n - k + 1][ok])
            out.append(mix(h[ok]))
        per_row = np.bincount(w.doc, minlength=len(w.offsets) - 1) if n else np.zeros(len(w.offsets) - 1, np.int64)
        first = np.concatenate([[0], np.cumsum(per_row)])
        for r in np.flatnonzero((per_row > 0) & (per_row < k)):
            h = U64(0)
            for x in w.hash[first[r] : first[r + 1]]:
                h = (h + x) * U64(_BASE)
            rows.append(np.array([r]))
            out.append(mix(np.array([h ^ U64(per_row[r])], dtype=U64)))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    return np.concatenate(rows), np.concatenate(out)


@cache
def _trim():
    """The C library's way to give freed memory back, where it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return lambda _: 0


def chunks(batch: pa.RecordBatch, column: str, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch's rows in slices of about `size` bytes of text, so that work arrays stay small; after the last one freed memory goes back to the system."""
    if batch.num_rows == 0:
        return
    length = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    piece = np.cumsum(length.astype(np.int64)) // size
    edges = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()
    _trim()(0)


def lists(values: np.ndarray, rows: np.ndarray, n_rows: int, kind: pa.DataType) -> pa.Array:
    """A list column: values of each row, given sorted by row."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n_rows))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, the same wherever it lies."""
    n = len(data)
    up, down = _powers(n + 1)
    with np.errstate(over="ignore"):
        sums = np.empty(n + 1, dtype=U64)
        sums[0] = 0
        np.cumsum(_VALUE[data] * up[:n], out=sums[1:])
        return mix((sums[end] - sums[start]) * down[start])


def row_sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each row's bytes."""
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
