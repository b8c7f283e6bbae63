"""Vectorised 64-bit mixing and word splitting over byte buffers."""

from __future__ import annotations

import numpy as np

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit integers."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A name for the ordered pair of two names."""
    return mix(a * U(0x9E3779B97F4A7C15) + (b ^ (b >> U(32))) * U(0xC2B2AE3D27D4EB4F) + U(1))


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def buffer_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts behind one another, each followed by a line feed; where each starts (and the end)."""
    parts = [t or b"" for t in texts]
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8) if parts else np.zeros(0, np.uint8)
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=starts[1:])
    return data, starts


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than 0x20 and 0x09-0x0D. UTF-8 has those bytes for those characters alone."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], U)


def lanes(data: np.ndarray) -> np.ndarray:
    """For each position, the 8 bytes from there as a little-endian integer (bytes after the end: 0)."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(shape=(len(data),), dtype="<u8", buffer=padded, strides=(1,))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each range: its length and its 8-byte lanes, chained."""
    lengths = ends - starts
    out = mix(lengths.astype(U) + U(0x51ED270B))
    if not len(starts):
        return out
    view, on, k = lanes(data), np.flatnonzero(lengths > 0), 0
    while len(on):
        left = lengths[on] - 8 * k
        out[on] = pair(out[on], view[starts[on] + 8 * k] & MASK[np.minimum(left, 8)])
        on = on[left > 8]
        k += 1
    return out


class Lookup:
    """Values of distinct 64-bit keys; a search costs a few array reads whatever the number of keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.levels, k, v = [], keys, values
        while len(k):
            bits = max(8, int(2 * len(k)).bit_length())
            at = self._at(k, len(self.levels), bits)
            held, val = np.zeros(1 << bits, U), np.zeros(1 << bits, values.dtype)
            full = np.zeros(1 << bits, bool)
            held[at], val[at], full[at] = k, v, True  # the last of those that fall together wins
            self.levels.append((bits, held, val, full))
            lost = held[at] != k
            k, v = k[lost], v[lost]

    @staticmethod
    def _at(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
        return ((keys ^ (keys >> U(29))) * FACTORS[level % len(FACTORS)] >> U(64 - bits)).astype(np.int64)

    def get(self, keys: np.ndarray, default=0) -> np.ndarray:
        out, rest = None, None
        for n, (bits, held, val, full) in enumerate(self.levels):
            k = keys if rest is None else keys[rest]
            at = self._at(k, n, bits)
            hit = (held[at] == k) & full[at]
            if rest is None:
                out = np.where(hit, val[at], np.asarray(default, val.dtype))
                rest = np.flatnonzero(~hit)
            else:
                out[rest[hit]] = val[at[hit]]
                rest = rest[~hit]
            if not len(rest):
                break
        return np.full(len(keys), default) if out is None else out


FACTORS = mix(np.arange(301, 333, dtype=U)) | U(1)
