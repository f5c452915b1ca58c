"""What several operators share: Arrow text buffers, and vectorised word and window hashing.

All text work is done on flat byte buffers, a few hundred kilobytes at a time, so a Python worker needs memory
for one slice (or one document, if that is longer) and not for a whole Arrow batch.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

#: Bytes of text that a worker handles at once.
SLICE_BYTES = 1 << 18

_U = np.uint64


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`work`, with what its task has freed given back to the system at the end: workers live on, several to an executor, and would
    hold it."""

    @wraps(work)
    def worked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return worked


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges (a, b) of documents of about `most` bytes, one document at least."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = b


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, one after the last, their bytes, their offsets from 0)."""
    data, offsets = text_buffers(column)
    for a, b in slices(offsets, most):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


#: The separators of `[^\x20\x09-\x0D]+`.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MASK = (1 << 64) - 1
_FOLD = _U(0x9E3779B97F4A7C15)
#: Of a little-endian word of eight bytes, the first n.
_FIRST = np.array([(1 << (8 * n)) - 1 for n in range(9)], _U)
#: Spans of more bytes are hashed one by one.
LONG_SPAN = 1024


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads all bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; zeros follow the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of the bytes of each span: eight at a time, each step mixed before the next, so that no family of texts
    collides by its structure as with sums of powers. It depends on the span's bytes and the seed alone."""
    size = ends - starts
    out = mix(size.astype(_U) + _U((seed * 0x2545F4914F6CDD1D + 1) & _MASK))
    view, left, at = eights(data), size, starts
    todo = np.arange(len(starts))
    long = size > LONG_SPAN
    if long.any():
        raw, key = data.tobytes(), seed.to_bytes(8, "little")
        for i in np.flatnonzero(long).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]], digest_size=8, key=key).digest(), "little")
        todo, at, left = todo[~long], at[~long], left[~long]
    while True:
        more = left > 0
        if not more.all():
            todo, at, left = todo[more], at[more], left[more]
        if not len(todo):
            return out
        out[todo] = mix((out[todo] ^ (view[at] & _FIRST[np.minimum(left, 8)])) + _FOLD)
        at, left = at + 8, left - 8


def fold(values: np.ndarray, places: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A hash of the k values from each place on."""
    h = np.full(len(places), (seed * 0x2545F4914F6CDD1D + k) & _MASK, _U)
    for i in range(k):
        h = mix((h ^ values[places + i]) + _FOLD)
    return h


def gram_hash(values: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k values."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    h = np.full(n, k, _U)
    for i in range(k):
        h = mix((h ^ values[i : i + n]) + _FOLD)
    return h


def byte_gram_hash(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k bytes, eight at a time."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    view, h = eights(data), np.full(n, k, _U)
    for i in range(0, k, 8):
        x = view[i : i + n]
        h = mix((h ^ (x if k - i >= 8 else x & _FIRST[k - i])) + _FOLD)
    return h


def spans_array(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans' bytes as a binary column."""
    size = ends - starts
    return binary_array(data[ragged(starts, size)], size)


def codes_of(spans: pa.Array) -> tuple[np.ndarray, int]:
    """(a number for each value, equal exactly where values are; how many there are)."""
    found = spans.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False), len(found.dictionary)


def pairs_coded(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair of small numbers, equal exactly where the pairs are, below the number of pairs."""
    _, out = np.unique(a.astype(np.int64) * (int(b.max()) + 1 if len(b) else 1) + b, return_inverse=True)
    return out


class Words:
    """The words of a slice of documents: starts, ends, and first word of each document (`bounds`, one more at the end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = IS_SPACE):
        word = ~separator[data]
        first = word.copy()
        first[1:] &= ~word[:-1]
        last = word.copy()
        last[:-1] &= ~word[1:]
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < len(data))]
        first[cut] = word[cut]
        last[cut - 1] = word[cut - 1]
        self.data, self.offsets = data, offsets
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, offsets)

    def hashes(self, seed: int = 0) -> np.ndarray:
        return span_hash(self.data, self.starts, self.ends, seed)

    def codes(self) -> np.ndarray:
        """A number for each word, equal exactly where words are."""
        return codes_of(spans_array(self.data, self.starts, self.ends))[0]

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def joined(self, keep: np.ndarray) -> list[bytes]:
        """Each document's kept words, joined by one space."""
        out, data, starts, ends = [], self.data.tobytes(), self.starts, self.ends
        kept = np.add.reduceat(np.r_[keep, False].astype(np.int64), self.bounds[:-1]) * (np.diff(self.bounds) > 0) if len(self.bounds) > 1 else []
        for d in range(len(self.bounds) - 1):
            a, b = self.bounds[d], self.bounds[d + 1]
            if kept[d] == b - a:
                out.append(b" ".join(data[self.offsets[d] : self.offsets[d + 1]].split()))
            else:
                w = np.flatnonzero(keep[a:b]) + a
                out.append(b" ".join([data[s:e] for s, e in zip(starts[w].tolist(), ends[w].tolist())]))
        return out


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours, by doubling."""
    if len(x) < w:
        return x[:0]
    done, out = 1, x
    while done < w:
        step = min(done, w - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out


_POS_BITS = 24


def minimizers(keys: np.ndarray, bounds: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all windows of `length` values that lie within one document: runs of neighbouring windows with the same least
    k-gram, as (position of that k-gram, first window, number of windows). `keys` are hashes of the k-grams. Which
    k-gram a window takes depends on its values alone, so equal windows take the same one at the same place."""
    n, w = bounds[-1], length - k + 1
    if n < length:
        return (np.zeros(0, np.int64),) * 3
    if n >= 1 << _POS_BITS:
        return _minimizers_long(keys, bounds, length, k)
    low = _U((1 << _POS_BITS) - 1)
    at = sliding_min((keys & ~low) | np.arange(len(keys), dtype=_U), w)
    starts = np.arange(len(at))
    size = np.diff(bounds)
    inside = np.repeat(bounds[1:], size)[: len(at)] - starts >= length
    return _runs((at & low).astype(np.int64)[inside], starts[inside])


def _runs(anchor: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(anchor):
        return (np.zeros(0, np.int64),) * 3
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)])
    return anchor[new], window[new], np.diff(np.r_[new, len(anchor)])


def _minimizers_long(keys, bounds, length, k):
    """As above for a slice that is one document too long for positions of 24 bits: in overlapping parts."""
    found, step = [], 1 << (_POS_BITS - 1)
    for d in range(len(bounds) - 1):
        for a in range(int(bounds[d]), max(int(bounds[d]) + 1, int(bounds[d + 1]) - length + 1), step):
            b = min(a + step + length - 1, int(bounds[d + 1]))
            x, y, z = minimizers(keys[a : b - k + 1], np.array([0, b - a]), length, k)
            found.append((x + a, y + a, z))
    anchor, first, n = (np.concatenate(c) for c in zip(*found))
    return anchor, first, n


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (lengths[0] of them), starts[1], ..."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in any of the spans."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change[:-1]) > 0


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def binary_array(data: bytes | np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary column from one buffer."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data) if isinstance(data, np.ndarray) else data)])
