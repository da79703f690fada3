"""Vectorised helpers for Arrow batches: byte views of string columns and rolling window codes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: Odd 64-bit multipliers of the mixing step (public constants of the splitmix64 generator).
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit integers, so that their low bits can be used as buckets."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def string_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n+1 offsets of its rows; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary()) if col.null_count == 0 else col.fill_null("").cast(pa.large_binary())
    n = len(col)
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, dtype=np.int64, count=n + 1 + col.offset)[col.offset :] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[off[0] : off[-1]]
    return raw, off - off[0]


def row_of(offsets: np.ndarray) -> np.ndarray:
    """Row number of each byte."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def window_ok(offsets: np.ndarray, width: int) -> np.ndarray:
    """For each byte position: does a window of `width` that begins here end within its row?"""
    total = int(offsets[-1])
    ok = np.zeros(total, bool)
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(total)
    ok[:] = left >= width
    return ok


def window_codes(symbols: np.ndarray, width: int, bits: int) -> np.ndarray:
    """Codes of all windows of `width` symbols, each symbol in `bits` bits; exact while width * bits <= 64.

    Entry i belongs to the window that begins at i; the last width-1 entries are undefined (zero)."""
    total = len(symbols)
    out = np.zeros(total, np.uint64)
    if total < width:
        return out
    # doubling: codes of windows of length 1, 2, 4, ... are combined to the wanted width
    have, span = symbols.astype(np.uint64), 1
    acc, done = None, 0
    w = width
    while w:
        if w & 1:
            if acc is None:
                acc, done = have.copy(), span
            else:  # acc covers `done` symbols; append `span` symbols that begin after them
                nxt = np.zeros(total, np.uint64)
                nxt[: total - done] = have[done:]
                acc = (acc << np.uint64(bits * span)) | nxt
                done += span
        w >>= 1
        if w:
            nxt = np.zeros(total, np.uint64)
            nxt[: total - span] = have[span:]
            have = (have << np.uint64(bits * span)) | nxt
            span *= 2
    out[: total - width + 1] = acc[: total - width + 1]
    return out


def row_chunks(batch: pa.RecordBatch, text: int, limit: int = 1 << 20):
    """Slices of a batch whose text column (by number) holds about `limit` bytes at most; a longer single row is its own slice.

    Bounds the working memory of a task by the longest text, not by the batch size."""
    col = batch.column(text)
    if batch.num_rows == 0:
        return
    size = np.asarray(pa.compute.binary_length(col).fill_null(0)).astype(np.int64)
    group = (np.cumsum(size) - size) // limit
    cut = np.flatnonzero(np.diff(group)) + 1
    for a, z in zip(np.concatenate([[0], cut]), np.concatenate([cut, [batch.num_rows]])):
        yield batch.slice(int(a), int(z - a))
