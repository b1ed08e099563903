"""Numpy kernels of the suffix-array dedup: anchors of a batch of texts, and windows shared within groups of contexts."""

from __future__ import annotations

import numpy as np

#: Random odd multipliers and byte codes, from a fixed seed.
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_MUL = _RNG.integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)


def rolling(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every window of ``size`` bytes along the last axis, doubled up from powers of two."""
    n = data.shape[-1] - size + 1
    h = _BYTE[data]
    out, done, step, level = None, 0, 1, 0
    with np.errstate(over="ignore"):
        while True:
            if size & step:
                part = h[..., done : done + n]
                out = part.copy() if out is None else out * _MUL[8 + level] + part
                done += step
            if done == size:
                return out ^ (out >> np.uint64(32))
            h = h[..., : h.shape[-1] - step] * _MUL[level] + (h[..., step:] ^ (h[..., step:] >> np.uint64(29)))
            step, level = 2 * step, level + 1


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, text numbers) of the anchors of texts data[starts:ends].

    The anchor of a window of ``length`` bytes is its leftmost gram of least hash: it depends on the window's bytes alone, so equal
    windows have their anchor at the same place.
    """
    width = length - gram + 1
    if len(data) < length:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    key = rolling(data, gram)
    key &= np.uint64(0xFFFFFFFF00000000)
    key |= np.arange(len(key), dtype=np.uint64)
    n = len(key) - width + 1
    pad = -len(key) % width
    blocks = np.concatenate([key, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()[width - 1 : width - 1 + n]
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    least = (np.minimum(ahead, behind) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(n + 1, np.int8)  # windows within one text
    long_ = ends - starts >= length
    np.add.at(inside, starts[long_], 1)
    np.add.at(inside, np.minimum(ends[long_] - length + 1, n), -1)
    least = least[np.cumsum(inside[:n], dtype=np.int8) > 0]
    if not len(least):
        return least, least
    at = least[np.concatenate([[True], least[1:] != least[:-1]])]
    at = np.unique(at)
    return at, np.searchsorted(starts, at, "right") - 1
