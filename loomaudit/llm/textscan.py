"""Vectorised text primitives over Arrow string buffers (numpy, no Python strings)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_C1, _C2, _GOLD = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)
_P = U(0xD1342543DE82EF95)

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of the class ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing.
NON_WORD = np.zeros(256, bool)
NON_WORD[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser; a bijection on 64 bits."""
    with np.errstate(over="ignore"):
        x = x + _GOLD
        x = (x ^ (x >> U(30))) * _C1
        x = (x ^ (x >> U(27))) * _C2
        return x ^ (x >> U(31))


_TAIL = np.array([(1 << 8 * n) - 1 for n in range(9)], U)


def slice_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each slice of bytes: blocks of eight, one bijective mix after another.

    Slices of equal length up to eight bytes never collide, and no sum over places is
    involved, so regular orders of letters are nothing special.
    """
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    u64 = np.ndarray(len(padded) - 7, "<u8", padded, 0, (1,))
    left = end - start
    out = mix(left.astype(U) * _C2 + U(seed))
    out = mix(out ^ (u64[start] & _TAIL[np.minimum(left, 8)]))
    live, at = np.flatnonzero(left > 8), start
    while len(live):
        at = at + 8
        left = left - 8
        out[live] = mix(out[live] ^ (u64[at[live]] & _TAIL[np.minimum(left[live], 8)]))
        live = live[left[live] > 8]
    return out


def same_slices(raw: np.ndarray, start: np.ndarray, size: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether the bytes at ``start`` and at ``other`` agree over ``size``."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    u64 = np.ndarray(len(padded) - 7, "<u8", padded, 0, (1,))
    out = np.ones(len(start), bool)
    live, done = np.flatnonzero(size > 0), 0
    while len(live):
        mask = _TAIL[np.minimum(size[live] - done, 8)]
        same = (u64[start[live] + done] & mask) == (u64[other[live] + done] & mask)
        out[live[~same]] = False
        done += 8
        live = live[same & (size[live] > done)]
    return out


def _doubled(values: np.ndarray, most: int):
    """Hashes of 1, 2, 4, ... consecutive values, up to ``most``, with their widths."""
    width = 1
    while width <= most:
        yield width, values
        if len(values) <= width:
            return
        values = mix(values[:-width] * _P + values[width:])
        width *= 2


def span_hashes(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice of ``values``, put together from slices of 1, 2, 4, ... values."""
    out = mix(size.astype(U) * _C2)
    at = start.copy()
    for width, level in _doubled(values, int(size.max(initial=0))):
        rows = np.flatnonzero(size & width)
        out[rows] = mix(out[rows] * _P + level[at[rows]])
        at[rows] += width
    return out


def text_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(batch: pa.RecordBatch, text: str, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with at most ``most`` text bytes, or one longer row, with bytes and offsets."""
    raw, at = text_of(batch.column(text))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield batch.slice(lo, hi - lo), raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


class Words:
    """Words of a run of texts: byte spans, and for each text its first word's index."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, separators: np.ndarray = SPACES):
        n = len(raw)
        inside = np.zeros(n + 2, bool)
        np.logical_not(separators[raw], out=inside[1 : n + 1])
        cut = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < n)]
        first = inside[1 : n + 1] & ~inside[:n]
        first[cut] |= inside[cut + 1]
        last = inside[1 : n + 1] & ~inside[2:]
        last[cut - 1] |= inside[cut]
        self.raw, self.at = raw, at
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, at)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, seed: int = 0) -> np.ndarray:
        return slice_hashes(self.raw, self.start, self.end, seed)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), self.counts)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each ``k`` consecutive entries, whichever text they are in; as :func:`span_hashes` has it."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out, at = np.full(n, mix(np.array([k], U) * _C2)[0]), 0
    for width, level in _doubled(words, k):
        if k & width:
            out = mix(out * _P + level[at : at + n])
            at += width
    return out


def inside_mask(counts: np.ndarray, k: int) -> np.ndarray:
    """For each start of ``k`` consecutive words, whether they are of one text."""
    total = int(counts.sum())
    left = np.repeat(np.cumsum(counts), counts) - np.arange(total)
    return (left >= k)[: max(0, total - k + 1)]


# XXH64's five multipliers: fixed values.
_X1, _X2, _X3, _X4, _X5 = (
    U(11400714785074694791),
    U(14029467366897019727),
    U(1609587929392839161),
    U(9650029242287828579),
    U(2870177450012600261),
)


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U(r)) | (x >> U(64 - r))


def _lane(acc: np.ndarray, value: np.ndarray) -> np.ndarray:
    return _rot(acc + value * _X2, 31) * _X1


def xxh64(raw: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many slices of one buffer at once."""
    raw = np.concatenate([raw, np.zeros(8, np.uint8)])
    u64 = np.ndarray(len(raw) - 7, "<u8", raw, 0, (1,))
    u32 = np.ndarray(len(raw) - 3, "<u4", raw, 0, (1,))
    out = np.empty(len(start), U)
    for lo in range(0, len(start), 1 << 15):
        out[lo : lo + (1 << 15)] = _xxh64(raw, u64, u32, start[lo : lo + (1 << 15)], length[lo : lo + (1 << 15)], U(seed))
    return out


def _xxh64(raw: np.ndarray, u64: np.ndarray, u32: np.ndarray, at: np.ndarray, length: np.ndarray, seed: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        at, end = at.copy(), at + length
        h = np.full(len(at), seed + _X5)
        big = np.flatnonzero(length >= 32)
        if len(big):
            lanes = [np.full(len(big), s) for s in (seed + _X1 + _X2, seed + _X2, seed, seed - _X1)]
            live = np.arange(len(big))
            while len(live):
                rows = big[live]
                for k in range(4):
                    lanes[k][live] = _lane(lanes[k][live], u64[at[rows] + 8 * k])
                at[rows] += 32
                live = live[end[rows] - at[rows] >= 32]
            acc = _rot(lanes[0], 1) + _rot(lanes[1], 7) + _rot(lanes[2], 12) + _rot(lanes[3], 18)
            for v in lanes:
                acc = (acc ^ _lane(np.zeros(len(big), U), v)) * _X1 + _X4
            h[big] = acc
        h += length.astype(U)
        live = np.flatnonzero(end - at >= 8)
        while len(live):
            h[live] = _rot(h[live] ^ _lane(np.zeros(len(live), U), u64[at[live]]), 27) * _X1 + _X4
            at[live] += 8
            live = live[end[live] - at[live] >= 8]
        live = np.flatnonzero(end - at >= 4)
        h[live] = _rot(h[live] ^ (u32[at[live]].astype(U) * _X1), 23) * _X2 + _X3
        at[live] += 4
        live = np.flatnonzero(end > at)
        while len(live):
            h[live] = _rot(h[live] ^ (raw[at[live]].astype(U) * _X5), 11) * _X1
            at[live] += 1
            live = live[end[live] > at[live]]
        h = (h ^ (h >> U(33))) * _X2
        h = (h ^ (h >> U(29))) * _X3
        return h ^ (h >> U(32))


def single_spaced(words: Words, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A buffer of all words joined by single spaces, and each word's start and end in it."""
    size = words.end - words.start
    start = np.cumsum(size + 1) - size - 1
    total = int(start[-1] + size[-1] + 1) if len(size) else 0
    out = np.full(total, 0x20, np.uint8)
    keep = np.zeros(len(words.raw) + 1, np.int8)
    keep[words.start] += 1
    keep[words.end] -= 1
    picked = words.raw[np.cumsum(keep[:-1]).astype(bool)] if len(words.raw) else words.raw
    hole = np.ones(total, bool)
    hole[start + size] = False
    out[hole] = LOWER[picked] if lower else picked
    return out, start, start + size
