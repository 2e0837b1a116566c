"""Array helpers over Arrow string batches: words, rolling hashes and sliding minima without a loop over rows.

Everything works on the concatenated UTF-8 bytes of a block of documents plus the documents' offsets, so a block costs
a fixed number of numpy calls. Blocks hold about ``BLOCK`` bytes (one longer document makes a block of its own), which
bounds the memory of a Python worker whatever the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text in a block, at most (one document may be longer).
BLOCK = 1_000_000

_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C55
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, BLOCK + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


class Rolling:
    """Hashes of any ranges of a sequence of uint64 values; equal ranges have equal hashes wherever they stand."""

    def __init__(self, values: np.ndarray) -> None:
        n = len(values)
        up, self._down = _powers(n + 1)
        self._sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * up[:n], out=self._sums[1:])

    @classmethod
    def of_bytes(cls, buf: np.ndarray) -> Rolling:
        return cls(_BYTE[buf])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[start]) * self._down[start])

    def of_all(self, length: int) -> np.ndarray:
        """For every start with ``length`` values after it."""
        n = len(self._sums) - length
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        return mix((self._sums[length:] - self._sums[:n]) * self._down[:n])


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings of a column, null as empty, and the n + 1 offsets."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, at, data = col.buffers()
    offs = np.frombuffer(at, dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if at else np.zeros(len(col) + 1, np.int64)
    buf = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None and len(col) else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches of about BLOCK bytes of ``text``: (slice, bytes, offsets)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        buf, offs = column_bytes(batch.column(text))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(offs, offs[first] + BLOCK, side="right")) - 1)
            last = min(last, batch.num_rows)
            yield batch.slice(first, last - first), buf[offs[first] : offs[last]], offs[first : last + 1] - offs[first]
            first = last


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words ``[^\\x20\\x09-\\x0D]+``, and the n + 1 offsets of each document's words."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = ~_SEP[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offs[1:] > offs[:-1]
    heads, tails = offs[:-1][full], offs[1:][full] - 1
    first[heads] = inside[heads]
    last[tails] = inside[tails]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` consecutive values, by doubling."""
    if len(values) < width:
        return values[:0]
    out, span = values, 1
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    if span < width:
        rest = width - span
        out = np.minimum(out[:-rest], out[rest:])
    return out


def expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start as often as its count says."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(np.asarray(starts, np.int64) - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return np.arange(total, dtype=np.int64) + shift


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 as the int64 with the same bits, which is what a LongType column holds."""
    return np.ascontiguousarray(x).view(np.int64)


def tune(spark) -> None:
    """Small Arrow batches: a batch of long documents must fit in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
