"""Rabin-Karp hashes of words and of fixed-length word windows, for whole blocks of texts at once.

A polynomial hash modulo 2**64 with an odd base is computed with prefix sums:
``(P[end] - P[start]) * base**-start``; the inverse exists because the base is
odd. Bytes enter as random 64-bit values and words as mixed 64-bit hashes, so the
weakness of that modulus for small symbols does not apply.
"""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 64, 256, dtype=np.uint64, endpoint=False)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PIECE = 1 << 20
_powers = {True: np.ones(1, np.uint64), False: np.ones(1, np.uint64)}


def _pow(n: int, forward: bool) -> np.ndarray:
    if len(_powers[forward]) < n:
        factors = np.full(max(n, 1 << 16), BASE if forward else INVERSE, np.uint64)
        factors[0] = 1
        _powers[forward] = np.cumprod(factors, dtype=np.uint64)
    return _powers[forward][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _piece_words(buf: np.ndarray, starts_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word of ``buf``; a word also ends where a text of ``starts_at`` starts."""
    if not len(buf):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    space = _SPACE[buf]
    fresh = np.empty(len(buf) + 1, bool)
    fresh[0] = fresh[-1] = True
    fresh[1:-1] = space[:-1]
    fresh[starts_at[(starts_at > 0) & (starts_at < len(buf))]] = True
    start = np.flatnonzero(fresh[:-1] & ~space)
    last = space.copy()
    last[:-1] |= fresh[1:-1] | space[1:]
    last[-1] = True
    end = np.flatnonzero(last & ~space) + 1
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * _pow(len(buf), True), out=sums[1:])
    raw = (sums[end] - sums[start]) * _pow(len(buf), False)[start]
    return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), start


def word_hashes(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts ``buf[bounds[i]:bounds[i + 1]]``, and the number of words in each.

    Works through pieces of about a megabyte cut at white space, so a very long text needs
    eight bytes a word and no more.
    """
    hashes, firsts, at = [], [], int(bounds[0])
    stop = int(bounds[-1])
    while at < stop:
        cut = min(at + _PIECE, stop)
        if cut < stop:
            gap = np.flatnonzero(_SPACE[buf[at:cut]])
            edge = np.searchsorted(bounds, cut, "right") - 1
            limit = max(int(gap[-1]) + at + 1 if len(gap) else at, int(bounds[edge]) if edge >= 0 else at)
            while limit <= at and cut < stop:  # one word longer than a piece
                cut = min(cut + _PIECE, stop)
                gap = np.flatnonzero(_SPACE[buf[at:cut]])
                edge = np.searchsorted(bounds, cut, "right") - 1
                limit = max(int(gap[-1]) + at + 1 if len(gap) else at, int(bounds[edge]))
            cut = limit if limit > at else stop
        h, s = _piece_words(buf[at:cut], bounds - at)
        hashes.append(h)
        firsts.append(s + at)
        at = cut
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(len(bounds) - 1, np.int64)
    first = np.concatenate(firsts)
    return np.concatenate(hashes), np.diff(np.searchsorted(first, bounds))


def window_hashes(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of ``width`` words inside one text, and the number of windows of each text."""
    n = len(words) - width + 1
    windows = np.maximum(counts - width + 1, 0)
    if n <= 0:
        return np.empty(0, np.uint64), np.zeros(len(counts), np.int64)
    out = np.empty(n, np.uint64)
    for at in range(0, n, _PIECE):
        part = words[at : min(at + _PIECE, n) + width - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * _pow(len(part), True), out=sums[1:])
        m = len(part) - width + 1
        out[at : at + m] = (sums[width : width + m] - sums[:m]) * _pow(m, False)
    first = np.cumsum(counts) - counts
    keep = np.zeros(n + 1, np.int64)
    some = windows > 0
    np.add.at(keep, first[some], 1)
    np.add.at(keep, (first + windows)[some], -1)
    return mix(out[np.cumsum(keep[:-1]) > 0]), windows


def text_groups(array, most: int = _PIECE):
    """Slices (from, to) of an Arrow string array, of about ``most`` bytes each and one text at least."""
    ends = _offsets(array)
    at = 0
    while at < len(array):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield at, min(to, len(array))
        at = min(to, len(array))


def _offsets(array) -> np.ndarray:
    import pyarrow as pa

    kind = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32
    return np.frombuffer(array.buffers()[1], kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)


def text_buffer(array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes behind a non-null Arrow string array and the bounds of its texts in them."""
    data = array.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), _offsets(array)
