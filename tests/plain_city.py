"""CityHash64 of one text at a time, for comparison with the batches of lokalith.functions.hashes: the public algorithm, version 1.1."""

from __future__ import annotations

from struct import unpack_from

_MASK = (1 << 64) - 1
#: Fixed values of the algorithm: its three primes and the multiplier of its 128-to-64-bit step.
K0, K1, K2 = 0xC3A5C85C97CB3127, 0xB492B66FBE98F273, 0x9AE16A3B2F90404F
K_MUL = 0x9DDFEA08EB382D69


def _rotated(x: int, n: int) -> int:
    x &= _MASK
    return ((x >> n) | (x << (64 - n))) & _MASK


def _mixed(x: int) -> int:
    x &= _MASK
    return x ^ (x >> 47)


def _swapped(x: int) -> int:
    return int.from_bytes((x & _MASK).to_bytes(8, "little"), "big")


def _pair(u: int, v: int, mul: int = K_MUL) -> int:
    a = _mixed(((u ^ v) & _MASK) * mul)
    return _mixed(((v & _MASK) ^ a) * mul) * mul & _MASK


def city64(data: bytes) -> int:
    n = len(data)
    word = lambda at: unpack_from("<Q", data, at)[0]
    if n <= 16:
        return _short(data, n, word)
    mul = K2 + 2 * n
    if n <= 32:
        a, b, c, d = word(0) * K1, word(8), word(n - 8) * mul, word(n - 16) * K2
        return _pair(_rotated(a + b, 43) + _rotated(c, 30) + d, a + _rotated(b + K2, 18) + c, mul)
    if n <= 64:
        return _middle(n, mul, word)
    return _long(n, word)


def _short(data: bytes, n: int, word) -> int:
    mul = K2 + 2 * n
    if n >= 8:
        a, b = word(0) + K2, word(n - 8)
        return _pair(_rotated(b, 37) * mul + a, (_rotated(a, 25) + b) * mul, mul)
    if n >= 4:
        first, last = unpack_from("<I", data)[0], unpack_from("<I", data, n - 4)[0]
        return _pair(n + (first << 3), last, mul)
    if n:
        y, z = data[0] + (data[n >> 1] << 8), n + (data[n - 1] << 2)
        return _mixed((y * K2 ^ z * K0) & _MASK) * K2 & _MASK
    return K2


def _middle(n: int, mul: int, word) -> int:
    a, b, c, d = word(0) * K2 & _MASK, word(8), word(n - 24), word(n - 32)
    e, f, g, h = word(16) * K2, word(24) * 9, word(n - 8), word(n - 16) * mul
    u = _rotated(a + g, 43) + (_rotated(b, 30) + c) * 9
    v = (((a + g) & _MASK) ^ d) + f + 1
    w = _swapped((u + v) * mul) + h
    x = _rotated(e + f, 42) + c
    y = (_swapped((v + w) * mul) + g) * mul
    z = e + f + c
    a = _swapped((x + z) * mul + y) + b
    return (_mixed((z + a) * mul + d + h) * mul + x) & _MASK


def _weak(word, at: int, a: int, b: int) -> tuple[int, int]:
    w, x, y, z = word(at), word(at + 8), word(at + 16), word(at + 24)
    a += w
    b = _rotated(b + a + z, 21)
    c = a
    a += x + y
    return (a + z) & _MASK, (b + _rotated(a, 44) + c) & _MASK


def _long(n: int, word) -> int:
    x = word(n - 40)
    y = word(n - 16) + word(n - 56)
    z = _pair(word(n - 48) + n, word(n - 24))
    v = _weak(word, n - 64, n, z)
    w = _weak(word, n - 32, y + K1, x)
    x = (x * K1 + word(0)) & _MASK
    for at in range(0, (n - 1) & ~63, 64):
        x = _rotated(x + y + v[0] + word(at + 8), 37) * K1 & _MASK
        y = _rotated(y + v[1] + word(at + 48), 42) * K1 & _MASK
        x ^= w[1]
        y = (y + v[0] + word(at + 40)) & _MASK
        z = _rotated(z + w[0], 33) * K1 & _MASK
        v = _weak(word, at, v[1] * K1, x + w[0])
        w = _weak(word, at + 32, z + w[1], y + word(at + 16))
        z, x = x, z
    return _pair(_pair(v[0], w[0]) + _mixed(y) * K1 + z, _pair(v[1], w[1]) + x)
