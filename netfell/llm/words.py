"""Words of whole texts as 64-bit numbers, by numpy over the UTF-8 bytes of an Arrow column.

Words are runs of anything but space and U+0009 to U+000D, with A-Z lower-cased. A word's number is a polynomial in
random per-byte numbers modulo 2**64, mixed; equal words have equal numbers everywhere.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 5
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = _BYTE[_LOWER]
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
#: Bytes handled at a time.
_STEP = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A well-mixed function of 64 bits to 64, one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int) -> np.ndarray:
    out = np.full(_STEP + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER = _powers(_BASE)
_INVERSE = _powers(pow(_BASE, -1, 1 << 64))


def words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each word in all texts, and how many words each text has. ``ends``: where each text begins in
    ``data``, with the end of the last."""
    numbers, starts, _ = placed_words(data, ends)
    return numbers, np.diff(np.searchsorted(starts, ends))


def placed_words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of each word, and where it starts and stops in ``data``."""
    blank = _BLANK[data]
    first = ~blank
    first[1:] &= blank[:-1]
    inner = ends[1:-1][(ends[1:-1] > 0) & (ends[1:-1] < len(data))]
    first[inner] = ~blank[inner]
    last = ~blank
    last[:-1] &= blank[1:]
    last[inner - 1] = ~blank[inner - 1]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    out = np.zeros(len(starts), np.uint64)
    a = 0
    while a < len(starts):  # as many words as begin and end within a step
        at = starts[a]
        b = max(a + 1, int(np.searchsorted(stops, at + _STEP, side="right")))
        out[a:b] = _numbers(data[at : stops[b - 1]], starts[a:b] - at, stops[a:b] - at)
        a = b
    return mix(out), starts, stops


def _numbers(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    if len(data) > _STEP:  # one word longer than a step
        out, power = np.zeros(1, np.uint64), np.ones(1, np.uint64)
        for at in range(0, len(data), _STEP):
            own = _BYTE[data[at : at + _STEP]]
            out += (own * _POWER[: len(own)]).sum(dtype=np.uint64) * power
            power *= _POWER[_STEP]
        return out
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _POWER[: len(data)], out=sums[1:])
    return (sums[stops] - sums[starts]) * _INVERSE[starts]
