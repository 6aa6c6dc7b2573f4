"""Binary fuse filters (three slots a key, 16-bit fingerprints) over unsigned 64-bit keys, built and probed with numpy.

A filter never misses a key that it was built from and passes a foreign key with probability about 2^-16.
"""

from __future__ import annotations

import math

import numpy as np

U = np.uint64


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply) of ``x + seed``."""
    x = x + U(seed)
    for shift, by in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> U(shift))) * U(by)
    return x ^ (x >> U(33))


def shape(n: int) -> tuple[int, int]:
    """Slots per segment and number of segments for ``n`` keys: overlapping windows of three adjoining segments."""
    length = 1 << max(2, int(math.floor(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
    length = min(length, 1 << 18)
    room = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2))) if n > 1 else 4
    segments = max(1, math.ceil(n * room / length))
    return length, segments


def slots(h: np.ndarray, length: int, segments: int) -> np.ndarray:
    """[3, n] slots: the start segment from the upper bits, the places within three adjoining segments from the lower."""
    start = ((h >> U(32)) * U(segments)) >> U(32)
    mask = U(length - 1)
    low = [h & mask, (h >> U(18)) & mask, mix(h, 0x9E3779B97F4A7C15) & mask]
    return np.stack([(start + U(i)) * U(length) + low[i] for i in range(3)]).astype(np.int64)


def stamp(h: np.ndarray) -> np.ndarray:
    return (mix(h, 0x5851F42D4C957F2D) >> U(48)).astype(np.uint16)


def build(keys: np.ndarray, tries: int = 100) -> tuple[int, int, int, np.ndarray]:
    """(seed, length, segments, table) of the distinct ``keys``; seeds are tried in order until peeling empties."""
    keys = np.unique(keys.astype(np.uint64))
    length, segments = shape(len(keys))
    for seed in range(tries):
        if seed and seed % 10 == 0:
            segments += max(1, segments // 20)
        h = mix(keys, seed)
        at = slots(h, length, segments)
        size = (segments + 2) * length
        degree = np.bincount(at.ravel(), minlength=size)
        owner = np.zeros(size, np.int64)  # xor of the keys' numbers in a slot: of one key, its number
        for row in at:
            np.bitwise_xor.at(owner, row, np.arange(len(keys)))
        peeled: list[tuple[np.ndarray, np.ndarray]] = []
        front, left = np.flatnonzero(degree == 1), len(keys)
        while len(front):
            front = front[degree[front] == 1]
            key, one = np.unique(owner[front], return_index=True)
            place = front[one]
            if not len(key):
                break
            peeled.append((key, place))
            left -= len(key)
            for row in at[:, key]:
                np.subtract.at(degree, row, 1)
                np.bitwise_xor.at(owner, row, key)
            front = np.unique(at[:, key])
        if left == 0:
            table, mark = np.zeros(size, np.uint16), stamp(h)
            for key, place in reversed(peeled):
                rest = table[at[0, key]] ^ table[at[1, key]] ^ table[at[2, key]] ^ table[place]
                table[place] = mark[key] ^ rest
            return seed, length, segments, table
    raise RuntimeError(f"no fuse filter of {len(keys)} keys after {tries} seeds")


def contains(keys: np.ndarray, seed: int, length: int, segments: int, table: np.ndarray) -> np.ndarray:
    h = mix(keys.astype(np.uint64), seed)
    at = slots(h, length, segments)
    return (table[at[0]] ^ table[at[1]] ^ table[at[2]]) == stamp(h)
