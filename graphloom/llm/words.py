"""Words of a block of texts as arrays: offsets and digests, without a Python object for each word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes whose digests are summed at once; they fit into the cache.
SEGMENT = 1 << 17

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BASE = 0xD6E8FEB86659FD93
_POWERS = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _byte_values(fold: bool) -> np.ndarray:
    out = mix(np.arange(1, 257, dtype=np.uint64) * A)
    out[_WHITE] = 0
    if fold:
        out[65:91] = out[97:123]
    return out


_VALUES = {fold: _byte_values(fold) for fold in (False, True)}


def _powers(n: int) -> list[np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2^64."""
    if len(_POWERS[0]) < n:
        for k, factor in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, factor, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS


def buffers_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


class Words:
    """Words [^\\x20\\x09-\\x0D]+ of a column of texts.

    first, last: byte offsets of each word in ``data``; sizes, begin: words of each text and the index of its first one.
    """

    def __init__(self, column: pa.Array):
        self.data, offsets = buffers_of(column)
        n = len(self.data)
        inside = ~_WHITE[self.data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        gap = ~inside
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= gap[:-1] | edge[1:-1]
        ends[:-1] &= gap[1:] | edge[1:-1]
        self.first, self.last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        at = np.searchsorted(self.first, offsets)
        self.begin, self.sizes = at[:-1], np.diff(at)
        self.inside = inside

    def __len__(self) -> int:
        return len(self.first)

    @property
    def doc(self) -> np.ndarray:
        """The text each word is in."""
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    def digests(self, fold: bool = False) -> np.ndarray:
        """64 bits for each word; with ``fold`` A-Z count as a-z."""
        values, out, at = _VALUES[fold], np.empty(len(self.first), np.uint64), 0
        while at < len(self.first):
            base = int(self.first[at])
            end = max(at + 1, int(np.searchsorted(self.last, base + SEGMENT, side="right")))
            first, last = self.first[at:end] - base, self.last[at:end] - base
            power, inverse = _powers(max(SEGMENT, int(last[-1])))
            total = np.empty(int(last[-1]) + 1, np.uint64)
            total[0] = 0
            np.cumsum(values[self.data[base : base + int(last[-1])]] * power[: int(last[-1])], out=total[1:])
            out[at:end] = (total[last] - total[first]) * inverse[first]
            at = end
        return mix(out)

    def distinct(self) -> tuple[pa.Array, np.ndarray]:
        """(distinct words, which of them each word is)."""
        ends = np.r_[0, np.cumsum(self.last - self.first)].astype(np.int32)
        compact = pa.Array.from_buffers(pa.binary(), len(self.first), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(self.data[self.inside].tobytes())])
        found = compact.dictionary_encode()
        return found.dictionary, found.indices.to_numpy()


def within_one_deletion(words: pa.Array, held: np.ndarray) -> np.ndarray:
    """Whether the digest of a word, or of what any one deletion leaves of it, is among the sorted digests ``held``.

    Bytes count as signs. Digests are those of ``string_digests``.
    """
    data, offsets = buffers_of(words)
    out, marks = np.zeros(len(words), bool), np.zeros(1 << 16, bool)
    marks[held >> np.uint64(48)] = True
    at = 0
    while at < len(words):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SEGMENT, side="right")) - 1)
        own = offsets[at : end + 1] - offsets[at]
        n = int(own[-1])
        power, inverse = _powers(max(SEGMENT, n + 1))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUES[False][data[offsets[at] : offsets[end]]] * power[:n], out=total[1:])
        of = np.repeat(np.arange(end - at), np.diff(own))
        first, last = own[:-1][of], own[1:][of]
        k = np.arange(n)
        shorter = (total[k] - total[first]) * inverse[first] + (total[last] - total[k + 1]) * inverse[first + 1]
        whole = (total[own[1:]] - total[own[:-1]]) * inverse[own[:-1]]
        for digests, row in ((shorter, of), (whole, np.arange(end - at))):
            some = np.flatnonzero(marks[digests >> np.uint64(48)])
            if len(some) and len(held):
                x = digests[some]
                hit = held[np.minimum(np.searchsorted(held, x), len(held) - 1)] == x
                out[at + row[some[hit]]] = True
        at = end
    return out


def string_digests(strings: list[bytes]) -> np.ndarray:
    """Sorted distinct digests of short strings, for ``within_one_deletion``."""
    out = np.zeros(len(strings), np.uint64)
    for k, x in enumerate(strings):
        out[k] = (_VALUES[False][np.frombuffer(x, np.uint8)] * _powers(max(SEGMENT, len(x)))[0][: len(x)]).sum(dtype=np.uint64)
    return np.unique(out)


def rolling(h: np.ndarray, n: int, factor: np.uint64) -> np.ndarray:
    """A digest of each n consecutive words."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        out *= factor
        out += h[k : k + len(out)]
    return mix(out)


def slices(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.Array:
    """A binary column of byte ranges of ``data``."""
    sizes = last - first
    ends = np.r_[0, np.cumsum(sizes)]
    pick = np.arange(int(ends[-1])) + np.repeat(first - ends[:-1], sizes)
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data[pick].tobytes())])
