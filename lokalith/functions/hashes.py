"""The 64-bit string hash that key hashes fall back to: CityHash64 of the public algorithm, version 1.1, over batches of texts.

Texts are taken by the length classes of the algorithm; each step is one NumPy operation on all texts of a class.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

U = np.uint64
#: Fixed values of the algorithm: its three primes and the multiplier of its 128-to-64-bit step.
K0, K1, K2 = U(0xC3A5C85C97CB3127), U(0xB492B66FBE98F273), U(0x9AE16A3B2F90404F)
K_MUL = U(0x9DDFEA08EB382D69)


class _Words:
    """Little-endian words of the texts of one class at a place of each: ``at`` counts from the start, negative from the end."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        self.data, self.starts, self.lengths = data, starts, lengths
        self.n = lengths.astype(U)

    def load(self, at: int, width: int = 8) -> np.ndarray:
        first = self.starts + at + (self.lengths if at < 0 else 0)
        raw = self.data[first[:, None] + np.arange(width)]
        return np.ascontiguousarray(raw).view("<u8" if width == 8 else "<u4").reshape(-1).astype(U)

    def byte(self, places: np.ndarray) -> np.ndarray:
        return self.data[self.starts + places].astype(U)

    def pick(self, kept: np.ndarray) -> _Words:
        return _Words(self.data, self.starts[kept], self.lengths[kept])


def _rotated(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> U(n)) | (x << U(64 - n))


def _mixed(x: np.ndarray) -> np.ndarray:
    return x ^ (x >> U(47))


def _pair(u: np.ndarray, v: np.ndarray, mul: np.ndarray | np.uint64 = K_MUL) -> np.ndarray:
    a = _mixed((u ^ v) * mul)
    return _mixed((v ^ a) * mul) * mul


def _up_to_3(w: _Words) -> np.ndarray:
    first, middle, last = w.byte(np.zeros_like(w.lengths)), w.byte(w.lengths >> 1), w.byte(w.lengths - 1)
    y, z = first + (middle << U(8)), w.n + (last << U(2))
    return _mixed(y * K2 ^ z * K0) * K2


def _up_to_7(w: _Words) -> np.ndarray:
    return _pair(w.n + (w.load(0, 4) << U(3)), w.load(-4, 4), K2 + U(2) * w.n)


def _up_to_16(w: _Words) -> np.ndarray:
    mul = K2 + U(2) * w.n
    a, b = w.load(0) + K2, w.load(-8)
    return _pair(_rotated(b, 37) * mul + a, (_rotated(a, 25) + b) * mul, mul)


def _up_to_32(w: _Words) -> np.ndarray:
    mul = K2 + U(2) * w.n
    a, b, c, d = w.load(0) * K1, w.load(8), w.load(-8) * mul, w.load(-16) * K2
    return _pair(_rotated(a + b, 43) + _rotated(c, 30) + d, a + _rotated(b + K2, 18) + c, mul)


def _up_to_64(w: _Words) -> np.ndarray:
    mul = K2 + U(2) * w.n
    a, b, c, d = w.load(0) * K2, w.load(8), w.load(-24), w.load(-32)
    e, f, g, h = w.load(16) * K2, w.load(24) * U(9), w.load(-8), w.load(-16) * mul
    p = _rotated(a + g, 43) + (_rotated(b, 30) + c) * U(9)
    q = ((a + g) ^ d) + f + U(1)
    r = ((p + q) * mul).byteswap() + h
    s = _rotated(e + f, 42) + c
    t = (((q + r) * mul).byteswap() + g) * mul
    z = e + f + c
    a = ((s + z) * mul + t).byteswap() + b
    return _mixed((z + a) * mul + d + h) * mul + s


def _block(w: _Words, at: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The algorithm's weak hash of 32 bytes with two seeds."""
    a = a + w.load(at)
    last = w.load(at + 24)
    b = _rotated(b + a + last, 21)
    c = a
    a = a + w.load(at + 8) + w.load(at + 16)
    return a + last, b + _rotated(a, 44) + c


def _longer(w: _Words) -> np.ndarray:
    x = w.load(-40)
    y = w.load(-16) + w.load(-56)
    z = _pair(w.load(-48) + w.n, w.load(-24))
    v = _block(w, -64, w.n, z)
    u = _block(w, -32, y + K1, x)
    x = x * K1 + w.load(0)
    state = np.stack([x, y, z, *v, *u])
    rounds = (w.lengths - 1) // 64
    order = np.argsort(-rounds, kind="stable")  # texts with rounds left are in front
    for k in range(int(rounds.max())):
        live = order[: int(np.searchsorted(-rounds[order], -k))]
        own = w.pick(live)
        x, y, z, v0, v1, u0, u1 = state[:, live]
        at = 64 * k
        x = _rotated(x + y + v0 + own.load(at + 8), 37) * K1 ^ u1
        y = _rotated(y + v1 + own.load(at + 48), 42) * K1 + v0 + own.load(at + 40)
        z = _rotated(z + u0, 33) * K1
        v = _block(own, at, v1 * K1, x + u0)
        u = _block(own, at + 32, z + u1, y + own.load(at + 16))
        state[:, live] = np.stack([z, y, x, *v, *u])
    x, y, z, v0, v1, u0, u1 = state
    return _pair(_pair(v0, u0) + _mixed(y) * K1 + z, _pair(v1, u1) + x)


#: Greatest length of each class, and its function.
_CLASSES = [(0, lambda w: np.full(len(w.n), K2)), (3, _up_to_3), (7, _up_to_7), (16, _up_to_16), (32, _up_to_32), (64, _up_to_64), (1 << 62, _longer)]


def city64(texts: Sequence[bytes]) -> np.ndarray:
    """The hash of each text, as unsigned 64-bit numbers."""
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts, out, low = ends - lengths, np.empty(len(texts), U), -1
    for high, hashed in _CLASSES:
        own = np.flatnonzero((lengths > low) & (lengths <= high))
        if len(own):
            out[own] = hashed(_Words(data, starts[own], lengths[own]))
        low = high
    return out
