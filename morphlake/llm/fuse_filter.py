"""Static binary-fuse filters (three-wise, 8-bit fingerprints) over 64-bit keys, built and probed with numpy.

Three slots in neighbouring segments hold bytes whose xor is the key's fingerprint, so a stored key always answers yes
and another key says yes with probability 1/256, at about nine bits a key.
"""

from __future__ import annotations

import math

import numpy as np

_HEAD = np.dtype([("seed", "<u8"), ("segment", "<i8"), ("segments", "<i8"), ("keys", "<i8")])


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser, wrapping."""
    x = keys + np.uint64(seed)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _slots(mixed: np.ndarray, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first = ((mixed >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64) * segment
    mask = np.uint64(segment - 1)
    a = first + (mixed & mask).astype(np.int64)
    b = first + segment + ((mixed >> np.uint64(18)) & mask).astype(np.int64)
    c = first + 2 * segment + ((mixed >> np.uint64(9) ^ mixed >> np.uint64(41)) & mask).astype(np.int64)
    return a, b, c


def _fingerprints(mixed: np.ndarray) -> np.ndarray:
    return ((mixed ^ mixed >> np.uint64(32)) & np.uint64(0xFF)).astype(np.uint8)


def build(keys: np.ndarray) -> bytes:
    """A filter of the distinct keys (int64 or uint64), as bytes. An empty set gives a filter that always says no."""
    keys = np.unique(np.asarray(keys).astype(np.int64, copy=False).view(np.uint64))
    n = len(keys)
    segment = 4 if n < 2 else min(1 << 18, 1 << max(2, int(math.log(n) / math.log(3.33) + 2.25)))
    size = int(n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))) if n > 1 else 8
    segments = max(1, -(-size // segment) - 2)
    for seed in range(1, 1000):
        if (made := _peel(keys, seed * 0x9E3779B97F4A7C15 % (1 << 64), segment, segments)) is not None:
            return made
        if seed % 8 == 0:
            segments += max(1, segments // 16)
    raise RuntimeError("no filter after many seeds")


def _peel(keys: np.ndarray, seed: int, segment: int, segments: int) -> bytes | None:
    n, slots = len(keys), (segments + 2) * segment
    mixed = _mix(keys, seed)
    at = np.stack(_slots(mixed, segment, segments))
    count = np.bincount(at.ravel(), minlength=slots)
    members = np.zeros(slots, np.int64)
    for row in at:
        np.bitwise_xor.at(members, row, np.arange(n))
    rounds, left, single = [], n, np.nonzero(count == 1)[0]
    while left and len(single):
        who, first = np.unique(members[single], return_index=True)
        rounds.append((who, single[first]))
        left -= len(who)
        for row in at:
            np.subtract.at(count, row[who], 1)
            np.bitwise_xor.at(members, row[who], who)
        touched = np.unique(at[:, who].ravel())
        single = touched[count[touched] == 1]
    if left:
        return None
    table, prints = np.zeros(slots, np.uint8), _fingerprints(mixed)
    for who, slot in reversed(rounds):
        table[slot] = 0
        table[slot] = prints[who] ^ table[at[0][who]] ^ table[at[1][who]] ^ table[at[2][who]]
    return np.array([(seed, segment, segments, n)], _HEAD).tobytes() + table.tobytes()


def probe(made: bytes, keys: np.ndarray) -> np.ndarray:
    """For each key, False if it is surely not among the stored ones."""
    keys = np.asarray(keys).astype(np.int64, copy=False).view(np.uint64)
    head, table = np.frombuffer(made, _HEAD, 1)[0], np.frombuffer(made, np.uint8, offset=_HEAD.itemsize)
    if not head["keys"]:
        return np.zeros(len(keys), bool)
    mixed = _mix(keys, int(head["seed"]))
    a, b, c = _slots(mixed, int(head["segment"]), int(head["segments"]))
    return (table[a] ^ table[b] ^ table[c]) == _fingerprints(mixed)
