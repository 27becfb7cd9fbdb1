"""Word kernels over Arrow text buffers, shared by the training-data operators.

All functions work on the raw UTF-8 bytes of a whole batch with numpy: no
Python object is made for a word. Texts are processed in slices of bounded
size, whole texts at a time, so memory does not follow the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from quern.functions.batches import release  # noqa: F401 (the operators take it from here)

SLICE_BYTES = 1 << 20

#: Bytes that belong to a word when words are split at ASCII white space.
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: Bytes that belong to a word of lower-case letters, digits and non-ASCII.
ALPHANUMERIC = np.zeros(256, dtype=bool)
ALPHANUMERIC[0x30:0x3A] = True
ALPHANUMERIC[0x61:0x7B] = True
ALPHANUMERIC[0x80:] = True

#: Lower-cases A-Z and nothing else; UTF-8 continuation bytes are unaffected.
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[0x41:0x5B] += 0x20

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_LONG_WORD = 256


def as_text(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one string array in which a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    return column.fill_null("") if column.null_count else column


def byte_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array without nulls; offsets[0] is 0."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, or one row where it is longer."""
    row, n = 0, len(offsets) - 1
    while row < n:
        last = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        last = min(max(last, row + 1), n)
        yield row, last
        row = last


@dataclass
class Words:
    """Words of some texts: byte ranges in `data`, and where each text's words begin."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # first[i]:first[i + 1] are the words of text i

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def find_words(data: np.ndarray, offsets: np.ndarray, members: np.ndarray) -> Words:
    """Maximal runs of member bytes that do not cross a text's end."""
    n = len(data)
    inside = np.zeros(n + 1, dtype=bool)
    inside[:n] = members[data]
    opens = inside[:n].copy()
    opens[1:] &= ~inside[: n - 1]
    closes = inside[:n] & ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    opens[edges] = inside[edges]
    closes[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(opens)
    return Words(data, starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte ranges, eight bytes at a time over all ranges at once."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
    lengths = ends - starts
    keep = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=np.uint64)
    start_value = np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    h = mix((lanes[starts] & keep[np.minimum(lengths, 8)]) ^ mix(lengths.astype(np.uint64) + start_value))
    more = np.flatnonzero(lengths > 8)
    at = 8
    while len(more) and at < _LONG_WORD:
        left = lengths[more] - at
        h[more] = mix((h[more] * _M2) ^ (lanes[starts[more] + at] & keep[np.minimum(left, 8)]))
        at += 8
        more = more[left > 8]
    if len(more):
        import xxhash

        raw = data.tobytes()
        h[more] = np.array([xxhash.xxh64_intdigest(raw[starts[i] : ends[i]], seed) for i in more], dtype=np.uint64)
    return h


def rolling(h: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial hashes modulo 2**64 of all windows of `width` values, by doubling.

    out[i] = sum(h[i + j] * base ** (width - 1 - j)); len(h) - width + 1 values.
    """
    if len(h) < width:
        return np.zeros(0, np.uint64)
    out, done, power, size = None, 0, h, 1
    rest = width
    while True:
        if rest & 1:
            if out is None:
                out, done = power, size
            else:  # the window of `size` comes after that of `done`
                n = min(len(out), len(power) - done)
                out = out[:n] * np.uint64(pow(base, size, 1 << 64)) + power[done : done + n]
                done += size
        rest >>= 1
        if not rest:
            return out[: len(h) - width + 1]
        power = power[: len(power) - size] * np.uint64(pow(base, size, 1 << 64)) + power[size:]
        size *= 2


def same_text(first: np.ndarray, width: int) -> np.ndarray:
    """Start positions of the windows of `width` words that lie within one text."""
    counts = np.maximum(np.diff(first) - width + 1, 0)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    skip = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return np.arange(total) + skip


def covered(n: int, starts: np.ndarray, width: int | np.ndarray) -> np.ndarray:
    """A mask of the positions below n that some range start:start + width covers."""
    steps = np.bincount(starts, minlength=n + 1)[: n + 1].astype(np.int64)
    steps -= np.bincount(np.minimum(starts + width, n), minlength=n + 1)[: n + 1]
    return np.cumsum(steps)[:n] > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edges = np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
