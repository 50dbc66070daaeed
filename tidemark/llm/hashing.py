"""Vectorised hashing of whole texts: words, word runs, byte runs, minimizers.

All functions work on one chunk of documents: the UTF-8 bytes one after another
in `buf` and the places where documents begin and end in `offsets`. Nothing
ever spans two documents.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_CODES = np.random.Generator(np.random.PCG64(20240229)).integers(
    1, 1 << 63, 256, dtype=np.uint64
)
_powers: dict[str, np.ndarray] = {}
#: Symbols looked at in one go, so that the steps on them stay in the processor's cache.
_PIECE = 1 << 14

#: Separators of words: space and the control characters 9 to 13.
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power_table(name: str, base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    table = _powers.get(name)
    if table is None or len(table) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        table = np.full(size, base, np.uint64)
        table[0] = 1
        table = np.multiply.accumulate(table)
        _powers[name] = table
    return table[:n]


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any span of the symbols follows."""
    return _sums(len(codes), lambda a, b: codes[a:b])


def byte_prefix_sums(buf: np.ndarray) -> np.ndarray:
    """`prefix_sums` of the symbols of bytes, which are not made all at once."""
    return _sums(len(buf), lambda a, b: np.take(_BYTE_CODES, buf[a:b]))


def _sums(n: int, codes: Callable[[int, int], np.ndarray]) -> np.ndarray:
    up = _power_table("up", _BASE, n)
    out = np.zeros(n + 1, np.uint64)
    for a in range(0, n, _PIECE):
        b = min(n, a + _PIECE)
        np.cumsum(codes(a, b) * up[a:b], out=out[a + 1 : b + 1])
        out[a + 1 : b + 1] += out[a]
    return out


def spans_of(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of symbols."""
    down = _power_table("down", _INVERSE, len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def grams_of(prefix: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k symbols that begin at each place."""
    if len(prefix) <= k:
        return np.zeros(0, np.uint64)
    n = len(prefix) - k
    down = _power_table("down", _INVERSE, len(prefix))
    out = np.empty(n, np.uint64)
    for a in range(0, n, _PIECE):
        b = min(n, a + _PIECE)
        out[a:b] = mix((prefix[a + k : b + k] - prefix[a:b]) * down[a:b])
    return out


def byte_codes(buf: np.ndarray) -> np.ndarray:
    """A 64-bit symbol for each byte."""
    return np.take(_BYTE_CODES, buf)


def lower(buf: np.ndarray) -> np.ndarray:
    """A to Z in lower case, all other bytes as they are."""
    return _LOWER[buf]


def word_bounds(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word, a run of bytes that aren't separators."""
    solid = ~_IS_SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(buf), bool)
    before[:1] = True
    before[1:] = ~solid[:-1]
    after = np.empty(len(buf), bool)
    after[-1:] = True
    after[:-1] = ~solid[1:]
    starts = np.flatnonzero(solid & (before | edge[:-1]))
    ends = np.flatnonzero(solid & (after | edge[1:])) + 1
    return starts, ends


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span."""
    return spans_of(prefix_sums(byte_codes(buf)), starts, ends)


def symbol_grams(symbols: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k symbols that begin at each place."""
    n = len(symbols) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = symbols[:n].copy()
    for j in range(1, k):
        out = out * U64(_BASE) + symbols[j : j + n]
    return mix(out + U64(k))


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values."""
    low, held = values, 1
    while held * 2 <= width:
        low = np.minimum(low[: len(low) - held], low[held:])
        held *= 2
    rest = width - held
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def owned_windows(
    grams: np.ndarray, bounds: np.ndarray, length: int, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of `length` symbols, grouped by their minimizer.

    The minimizer of a window is the leftmost of its k-grams with the least
    hash, so equal windows have it at the same place. `bounds` are the places
    where documents begin and end. Returns the place of each minimizer and the
    first and last window start that it owns; each window within one document
    belongs to exactly one.
    """
    n = int(bounds[-1])
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none
    bits = max(1, int(n).bit_length())
    low = U64((1 << bits) - 1)
    width = length - k + 1
    total = len(grams) - width + 1
    # Hashes that end in their place differ, so equal minima are one minimizer.
    at, held, before = [], [], None
    for a in range(0, total, _PIECE):
        b = min(total, a + _PIECE)
        tagged = (grams[a : b + width - 1] & ~low) | np.arange(a, b + width - 1, dtype=np.uint64)
        least = sliding_minimum(tagged, width)
        new = np.flatnonzero(least[1:] != least[:-1]) + 1
        if before is None or least[0] != before:
            new = np.r_[0, new]
        before = least[-1]
        at.append(new + a)
        held.append(least[new])
    at, anchor = np.concatenate(at), (np.concatenate(held) & low).astype(np.int64)
    # Windows of a document start from `begin` up to before `end`; a run is cut there.
    begin, end = bounds[:-1], bounds[1:] - length + 1
    begin, end = begin[end > begin], end[end > begin]
    more = np.unique(np.concatenate([begin, end]))
    more = more[more < total]
    place = np.searchsorted(at, more)
    extra = at[np.minimum(place, len(at) - 1)] != more
    more, place = more[extra], place[extra]
    at, anchor = np.insert(at, place, more), np.insert(anchor, place, anchor[place - 1])
    step = np.zeros(len(at) + 1, np.int32)
    np.add.at(step, np.searchsorted(at, begin), 1)
    np.add.at(step, np.searchsorted(at, end), -1)
    inside = np.cumsum(step[:-1]) > 0
    last = np.append(at[1:], total) - 1
    return anchor[inside], at[inside], last[inside]
