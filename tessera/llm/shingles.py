"""Hashes of words and word windows for whole batches of texts, without a Python step per word."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[str, np.ndarray] = {}


def _power(n: int, base: int, name: str) -> np.ndarray:
    got = _powers.get(name)
    if got is None or got.size < n:
        size = max(1 << 16, 1 << (n - 1).bit_length()) if n > 1 else 1 << 16
        got = np.full(size, base, np.uint64)
        got[0] = 1
        got = np.multiply.accumulate(got)
        _powers[name] = got
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans of data (bytes)."""
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(data.size, _BASE, "up"), dtype=np.uint64)))
        h = (total[ends] - total[starts]) * _power(data.size, _INVERSE, "down")[starts]
        return mix(h + (ends - starts).astype(np.uint64))


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts joined by a line end: the words' 64-bit hashes, their starts and ends, and per text the first word's number."""
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    edge = np.diff(_SPACE[joined].view(np.int8), prepend=1)
    starts, ends = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return hashes(joined, starts, ends), starts, ends, np.searchsorted(starts, bounds)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows that start at each word; the last k - 1 are void."""
    out, done, step, have = np.zeros(h.size, np.uint64), 0, h.copy(), 1
    base = np.uint64(0xD6E8FEB86659FD93)
    power = base
    while True:
        if k & have:
            if done:
                out[: h.size - done] = out[: h.size - done] * power + step[done:]
                out[h.size - done :] = 0
            else:
                out = step.copy()
            done += have
            if done == k:
                return mix(out + np.uint64(k))
        nxt = step.copy()
        nxt[: max(0, h.size - have)] = step[: max(0, h.size - have)] * power + step[have:]
        step, have, power = nxt, have * 2, power * power
