"""Byte spans of Arrow text columns as numpy arrays: words, hashes, blocks.

The functions work on what one task has in its hands (an Arrow batch). Words are
the runs of bytes outside ``\\x20\\x09-\\x0D``; UTF-8 keeps those bytes out of
longer characters, so byte spans and character spans name the same words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

BLOCK_BYTES = 2 << 20
"""Bytes that are hashed at a time; bounds the arrays that stand beside a batch."""

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C55
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_LETTERS = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column: row i is ``bytes[offsets[i]:offsets[i + 1]]``; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    whole = np.frombuffer(data, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes each; a longer row is a range of its own."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, last
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of every word, in order; ``outside`` marks the byte values between words."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~outside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(offsets, starts, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS[0], _POWERS[1]


_LONG = 128
_TAILS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number."""
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 8, np.uint64, padded, strides=(1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: equal bytes have equal hashes wherever they stand.

    Eight bytes at a time go through ``mix``, longer spans through XXH3. No two spans of
    one length up to eight bytes share a hash; for longer ones chance decides.
    """
    lanes, size = _lanes(data), ends - starts
    found = mix(size.astype(np.uint64) ^ np.uint64(_BASE))
    live, done = np.flatnonzero((size > 0) & (size <= _LONG)), 0
    while len(live):
        rest = size[live] - done
        found[live] = mix(found[live] ^ lanes[starts[live] + done] & _TAILS[np.minimum(rest, 8)])
        live, done = live[rest > 8], done + 8
    for k in np.flatnonzero(size > _LONG).tolist():
        found[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes(), 7)
    return found


def _same(data: np.ndarray, starts: np.ndarray, others: np.ndarray, size: np.ndarray) -> bool:
    """Whether the ``size`` bytes from each of ``starts`` and of ``others`` are equal throughout."""
    lanes = _lanes(data)
    live, done = np.flatnonzero((size <= _LONG) & (starts != others)), 0
    while len(live):
        rest = size[live] - done
        if ((lanes[starts[live] + done] ^ lanes[others[live] + done]) & _TAILS[np.minimum(rest, 8)]).any():
            return False
        live, done = live[rest > 8], done + 8
    long = np.flatnonzero((size > _LONG) & (starts != others)).tolist()
    return all(np.array_equal(data[starts[k] : starts[k] + size[k]], data[others[k] : others[k] + size[k]]) for k in long)


def named(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a number for each span, the place of a first span of each number): equal numbers exactly for equal bytes.

    Hashes group the spans, a comparison of the bytes proves the groups, and should two
    spans share a hash by chance, the bytes themselves are the names.
    """
    _, first, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    size = ends - starts
    if (size == size[first][which]).all() and _same(data, starts, starts[first][which], size):
        return which, first
    text, names = data.tobytes(), {}
    which = np.fromiter((names.setdefault(text[a:b], len(names)) for a, b in zip(starts.tolist(), ends.tolist())), np.int64, len(starts))
    return which, np.unique(which, return_index=True)[1]


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def id_bytes(column: pa.Array) -> tuple[bytes, bytes]:
    """Integer ids as bytes, and which of them are null (pandas would turn both into floats)."""
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes(), column.is_null().to_numpy(zero_copy_only=False).tobytes()


def ids_of(values: bytes, nulls: bytes) -> list[int | None]:
    return [None if n else x for x, n in zip(np.frombuffer(values, np.int64).tolist(), np.frombuffer(nulls, bool).tolist())]
