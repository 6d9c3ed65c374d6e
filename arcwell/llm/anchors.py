"""Content-chosen anchors that bring equal windows of a corpus together.

Any two equal windows of ``window`` symbols hold the same ``gram``-symbol
minimiser (smallest hash, leftmost on ties) at the same offset.  A document is
therefore cut into *stretches*: maximal runs of windows that share a minimiser.
All copies of a window lie in stretches keyed by the same anchor hash, so
comparing stretches anchor by anchor misses no equal windows, and a corpus of n
symbols gives about 2n / (window - gram + 2) stretches, not n windows.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
#: Odd multiplier of the polynomial hashes, taken modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(BASE, -1, 1 << 64)
#: Low bits of a comparison key that hold a position; a chunk has fewer symbols.
_PLACE_BITS = 24
#: Symbols handled at once; keeps the working arrays in cache and bounded.
CHUNK = 1 << 17


def byte_codes() -> np.ndarray:
    """A fixed pseudo-random 64-bit code for each byte value."""
    return mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser, a bijection of the 64-bit integers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, _U)
    out[:1] = 1
    if n > 1:
        out[1:] = _U(base)
        np.multiply.accumulate(out, out=out)
    return out


_POWERS = {b: _powers(b, 1024) for b in (BASE, _INVERSE)}


def _power(base: int, n: int) -> np.ndarray:
    if len(_POWERS[base]) < n:
        _POWERS[base] = _powers(base, 2 * n)
    return _POWERS[base][:n]


def gram_hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all ``gram`` consecutive codes, by doubling."""
    if len(codes) < gram:
        return np.empty(0, _U)
    have, length, part, done = codes, 1, None, 0
    rest = gram
    while rest:
        if rest & 1:
            if part is None:
                part, done = have, length
            else:
                n = len(codes) - done - length + 1
                part, done = part[:n] * _U(pow(BASE, length, 1 << 64)) + have[done : done + n], done + length
        rest >>= 1
        if rest:
            n = len(have) - length
            have = have[:n] * _U(pow(BASE, length, 1 << 64)) + have[length : length + n]
            length *= 2
    return part


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have, length = x, 1
    while 2 * length <= width:
        have = np.minimum(have[:-length], have[length:])
        length *= 2
    return np.minimum(have[: len(x) - width + 1], have[width - length :]) if width > length else have


class Spans:
    """Hashes of arbitrary ranges of one code array."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.sums = np.zeros(n + 1, _U)
        np.cumsum(codes * _power(BASE, n), out=self.sums[1:])
        self.inverse = _power(_INVERSE, n + 1)

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.inverse[begin] + (end - begin).astype(_U))


def stretches(codes: np.ndarray, bounds: np.ndarray, window: int, gram: int):
    """Cut the documents ``codes[bounds[i]:bounds[i + 1]]`` into stretches.

    Returns arrays (document index, first window's start within the document,
    number of windows, anchor hash, content hash).  Documents shorter than
    ``window`` have none.
    """
    found = []
    sizes = np.diff(bounds)
    i = 0
    while i < len(sizes):
        if sizes[i] < window:
            i += 1
            continue
        if sizes[i] > CHUNK:  # a long document: overlapping pieces, joined at the cuts
            for at in range(0, sizes[i] - window + 1, CHUNK):
                lo = bounds[i] + at
                hi = min(bounds[i + 1], lo + CHUNK + window - 1)
                found.append(_cut(codes[lo:hi], np.array([0, hi - lo]), np.array([i]), np.array([at]), window, gram))
            i += 1
            continue
        j = i + 1
        while j < len(sizes) and bounds[j + 1] - bounds[i] <= CHUNK:
            j += 1
        found.append(_cut(codes[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], np.arange(i, j), np.zeros(j - i, np.int64), window, gram))
        i = j
    if not found:
        z = np.empty(0, np.int64)
        return z, z, z, np.empty(0, _U), np.empty(0, _U)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _cut(codes, bounds, docs, offsets, window, gram):
    n = len(codes)
    if n < window:
        z = np.empty(0, np.int64)
        return z, z, z, np.empty(0, _U), np.empty(0, _U)
    hashes = mix(gram_hashes(codes, gram))
    places = np.arange(len(hashes), dtype=_U)
    keys = (hashes >> _U(_PLACE_BITS) << _U(_PLACE_BITS)) | places
    anchor = (_sliding_min(keys, window - gram + 1) & _U((1 << _PLACE_BITS) - 1)).astype(np.int64)
    owner = np.repeat(np.arange(len(docs)), np.diff(bounds))[: n - window + 1]
    good = np.arange(n - window + 1) + window <= bounds[owner + 1]
    new = np.empty(n - window + 1, bool)
    new[0] = True
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]) | (good[1:] != good[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], n - window + 1)
    keep = good[begin]
    begin, end = begin[keep], end[keep]
    content = Spans(codes)(begin, end + window - 1)
    return docs[owner[begin]], begin - bounds[owner[begin]] + offsets[owner[begin]], end - begin, hashes[anchor[begin]], content
