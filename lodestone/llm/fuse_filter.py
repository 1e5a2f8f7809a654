"""Static three-wise binary fuse filters over 64-bit keys, built and probed with NumPy."""

from __future__ import annotations

import math
import struct

import numpy as np

_U = np.uint64


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + _U(seed)
        x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
        return x ^ (x >> _U(33))


def _slots(h: np.ndarray, seg: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Three slots in three consecutive segments; span is the number of slots a first one may take."""
    first = ((h >> _U(32)) * _U(span)) >> _U(32)
    mask = _U(seg - 1)
    second = (first + _U(seg)) ^ ((h >> _U(18)) & mask)
    third = (first + _U(2 * seg)) ^ (h & mask)
    return first.astype(np.int64), second.astype(np.int64), third.astype(np.int64)


def _print(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> _U(32))).astype(np.uint8)


def build(keys: np.ndarray, max_tries: int = 100) -> bytes:
    """A filter of about nine bits a key over the distinct keys (uint64); it has no false
    negatives and 1 in 256 false positives. No keys: a filter that holds nothing."""
    keys = np.unique(np.asarray(keys, dtype=np.uint64))
    n = len(keys)
    if not n:
        return struct.pack("<QIII", 0, 0, 0, 0)
    seg = 1 << max(2, min(18, int(math.floor(math.log(n) / math.log(3.33) + 2.25)) if n > 1 else 2))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    segments = max(1, (int(n * factor) + seg - 1) // seg - 2)
    for seed in range(1, max_tries + 1):
        span, size = segments * seg, (segments + 2) * seg
        h = _mix(keys, seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        slots = np.stack(_slots(h, seg, span))
        alive, order = np.arange(n), []
        while len(alive):
            own = slots[:, alive]
            degree = np.bincount(own.ravel(), minlength=size)
            single = degree[own] == 1
            free = single.any(axis=0)
            if not free.any():
                break
            order.append((alive[free], single[:, free].argmax(axis=0)))
            alive = alive[~free]
        if len(alive):
            segments += 1 if seed % 8 == 0 else 0
            continue
        cells, prints = np.zeros(size, dtype=np.uint8), _print(h)
        for which, side in reversed(order):
            own = slots[:, which]
            at = own[side, np.arange(len(which))]
            cells[at] = 0
            cells[at] = prints[which] ^ cells[own[0]] ^ cells[own[1]] ^ cells[own[2]]
        return struct.pack("<QIII", n, seed, seg, segments) + cells.tobytes()
    raise RuntimeError("no seed gives a filter")


def contains(data: bytes, keys: np.ndarray) -> np.ndarray:
    """True for every key that the filter holds, and for 1 in 256 others."""
    n, seed, seg, segments = struct.unpack_from("<QIII", data)
    keys = np.asarray(keys, dtype=np.uint64)
    if not n:
        return np.zeros(len(keys), dtype=bool)
    cells = np.frombuffer(data, dtype=np.uint8, offset=struct.calcsize("<QIII"))
    h = _mix(keys, seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    a, b, c = _slots(h, seg, segments * seg)
    return (cells[a] ^ cells[b] ^ cells[c]) == _print(h)
