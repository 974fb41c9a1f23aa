"""Byte ranges of one buffer: their hashes, and which of them are equal.

Hashes go through a range eight bytes at a time and scramble after each step, so they are no sums of powers, for which
equal-sized strings exist that collide under any base modulo 2**64.  `distinct` rests on no hash: ranges of one hash are
compared byte by byte.
"""

from __future__ import annotations

import hashlib

import numpy as np

#: bytes that must follow the last range in a buffer
SPARE = 8
#: ranges beyond this many bytes are hashed one by one
LONG = 512
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_SEED, _STEP = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def scramble(x):
    """A bijection of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def buffer(data: bytes) -> np.ndarray:
    return np.frombuffer(data + bytes(SPARE), np.uint8)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number."""
    return np.ndarray(len(data) - SPARE + 1, "<u8", data, strides=(1,))


def hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start : start + size]; different ranges of one size up to eight bytes never collide."""
    eight = _eights(data)
    out = scramble((size.astype(np.uint64) * _SEED ^ (eight[start] & _MASK[np.minimum(size, 8)])) * _STEP)
    live = np.flatnonzero((size > 8) & (size <= LONG))
    at, left, now = start[live] + 8, size[live] - 8, out[live]
    while len(live):
        now = scramble((now ^ (eight[at] & _MASK[np.minimum(left, 8)])) * _STEP)
        done = left <= 8
        out[live[done]] = now[done]
        live, at, left, now = live[~done], at[~done] + 8, left[~done] - 8, now[~done]
    for k in np.flatnonzero(size > LONG).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[start[k] : start[k] + size[k]], digest_size=8).digest(), "little")
    return out


def differ(data: np.ndarray, a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Whether the ranges at a and b differ."""
    eight = _eights(data)
    out = a_size != b_size
    live = np.flatnonzero(~out & (a != b))
    a, b, left = a[live], b[live], a_size[live]
    big = left > LONG
    for k in np.flatnonzero(big).tolist():
        out[live[k]] = not np.array_equal(data[a[k] : a[k] + left[k]], data[b[k] : b[k] + left[k]])
    live, a, b, left = live[~big], a[~big], b[~big], left[~big]
    while len(live):
        same = (eight[a] ^ eight[b]) & _MASK[np.minimum(left, 8)] == 0
        out[live[~same]] = True
        same &= left > 8
        live, a, b, left = live[same], a[same] + 8, b[same] + 8, left[same] - 8
    return out


def distinct(data: np.ndarray, start: np.ndarray, size: np.ndarray, keys: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places of one range of each content, for each range which of them it equals); keys: hashes to sort by."""
    keys = hashes(data, start, size) if keys is None else keys
    _, index, which = np.unique(keys, return_index=True, return_inverse=True)
    same = index[which]
    odd = np.flatnonzero(differ(data, start, size, start[same], size[same]))
    if len(odd):  # one hash, other content
        known: dict = {}
        more = []
        for k in odd.tolist():
            text = keys[k], data[start[k] : start[k] + size[k]].tobytes()
            if text not in known:
                known[text] = len(index) + len(more)
                more.append(k)
            which[k] = known[text]
        index = np.append(index, more)
    return index, which
