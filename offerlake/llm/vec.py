"""Vectorised text kernels on Arrow string columns: word bounds, word hashes, window hashes.

A word is a run of bytes other than ``\\x20`` and ``\\x09``-``\\x0D``. UTF-8 continuation bytes are
never among those, so byte offsets cut words exactly where code points would.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_BASE_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WINDOW = U64(0xD6E8FEB86659FD93)
_WINDOW_INV = U64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_SEGMENT = 1 << 20
_powers: dict[int, np.ndarray] = {}

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: All but ASCII letters and the bytes of other code points.
NOT_LETTER = np.ones(256, dtype=bool)
NOT_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def powers(base: np.uint64, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2**64, kept between calls."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 1 << 12, 0 if have is None else 2 * len(have))
        have = np.full(size, base, dtype=U64)
        have[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(have, out=have)
        _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and len + 1 offsets into them. Nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = offsets[0] if len(offsets) else 0
    return raw[first : offsets[-1]], offsets - first


def groups(batches: Iterator[pa.RecordBatch], text: str, group_bytes: int, rows: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about ``group_bytes`` of text and at most ``rows`` rows each, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_buffer(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + group_bytes, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows, at + rows)
            yield batch.slice(at, to - at)
            at = to


class Words:
    """The words of a group of texts: byte bounds ``start``/``end``, and ``first`` word of each text.

    ``space`` marks the bytes that part words.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE):
        self.raw, self.offsets = raw, offsets
        solid = ~space[raw]
        edge = np.zeros(len(raw) + 1, dtype=bool)
        edge[offsets] = True
        before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
        before[1:] = solid[:-1]
        after[:-1] = solid[1:]
        self.start = np.flatnonzero(solid & (~before | edge[:-1]))
        self.end = np.flatnonzero(solid & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)

    @classmethod
    def of(cls, column: pa.Array) -> Words:
        return cls(*text_buffer(column))

    @classmethod
    def letters(cls, column: pa.Array) -> Words:
        """Runs of letters, ASCII ones in lower case."""
        raw, offsets = text_buffer(column)
        return cls(LOWER[raw], offsets, NOT_LETTER)

    def hashes(self) -> np.ndarray:
        return range_hashes(self.raw, self.start, self.end)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)


def range_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, by differences of polynomial prefix sums.

    The ranges ascend by their start. Runs over segments to bound memory.
    """
    out = np.empty(len(start), dtype=U64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(start):
            base = start[at]
            to = max(int(np.searchsorted(start, base + _SEGMENT)), at + 1)
            stop = int(end[at:to].max())
            part = raw[base:stop]
            sums = np.zeros(len(part) + 1, dtype=U64)
            np.cumsum((part.astype(U64) + U64(1)) * powers(_BASE, len(part)), out=sums[1:])
            s, e = start[at:to] - base, end[at:to] - base
            out[at:to] = (sums[e] - sums[s]) * powers(_BASE_INV, len(part) + 1)[s]
            at = to
        return mix(out)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp hashes of every ``size`` consecutive items of ``words``; windows may span texts."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    out = np.empty(n, dtype=U64)
    step = 1 << 17
    with np.errstate(over="ignore"):
        for at in range(0, n, step):
            to = min(at + step, n)
            part = words[at : to + size - 1]
            sums = np.zeros(len(part) + 1, dtype=U64)
            np.cumsum(part * powers(_WINDOW, len(part)), out=sums[1:])
            out[at:to] = (sums[size:] - sums[: to - at]) * powers(_WINDOW_INV, to - at)
        return mix(out)


def window_index(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts (as word numbers) of the windows that lie within one text, and their texts' numbers."""
    count = np.maximum(np.diff(first) - size + 1, 0)
    doc = np.repeat(np.arange(len(count)), count)
    skip = np.cumsum(count) - count
    return np.arange(len(doc)) - skip[doc] + first[:-1][doc], doc
