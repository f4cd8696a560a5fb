"""Seeded generators by kind, for draws on the driver or in a task.

Draws of rows don't come from here: they hash the row's id (``score.sample``), so that a
lost task draws the same again. The streams are those of the named algorithms as numpy or
the textbook has them, not those of another library of the same names.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np

KINDS = ("STANDARD", "SECURE", "MERSENNE_TWISTER", "RC4")


class _Bytes:
    """A generator of bytes."""

    def bytes(self, n: int) -> bytes:
        raise NotImplementedError

    def random(self, n: int) -> np.ndarray:
        """Doubles in [0, 1), from 53 bits each."""
        words = np.frombuffer(self.bytes(8 * n), ">u8") >> np.uint64(11)
        return words.astype(float) / float(1 << 53)


class Hashed(_Bytes):
    """SHA-256 of a key and a counter."""

    def __init__(self, key: bytes):
        self._key, self._count, self._left = key, 0, b""

    def bytes(self, n: int) -> bytes:
        blocks = [self._left]
        for _ in range(-(-(n - len(self._left)) // 32)):
            blocks.append(hashlib.sha256(self._key + self._count.to_bytes(8, "big")).digest())
            self._count += 1
        out = b"".join(blocks)
        self._left = out[n:]
        return out[:n]


class Rc4(_Bytes):
    """The key stream of RC4."""

    def __init__(self, key: bytes):
        if not 1 <= len(key) <= 256:
            raise ValueError("a key has 1 to 256 bytes")
        state, at = list(range(256)), 0
        for i in range(256):
            at = (at + state[i] + key[i % len(key)]) % 256
            state[i], state[at] = state[at], state[i]
        self._state, self._i, self._j = state, 0, 0

    def bytes(self, n: int) -> bytes:
        out, s = bytearray(n), self._state
        for k in range(n):
            self._i = (self._i + 1) % 256
            self._j = (self._j + s[self._i]) % 256
            s[self._i], s[self._j] = s[self._j], s[self._i]
            out[k] = s[(s[self._i] + s[self._j]) % 256]
        return bytes(out)


def generator(kind: str, seed: int | None = None) -> np.random.Generator | Hashed | Rc4:
    """A generator with ``random(n)``; without a seed, one from the system's entropy."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind}")
    if kind in ("RC4", "SECURE"):
        key = os.urandom(32) if seed is None else seed.to_bytes(8, "big", signed=True)
        return Rc4(key) if kind == "RC4" else Hashed(key)
    bits = {"STANDARD": np.random.PCG64, "MERSENNE_TWISTER": np.random.MT19937}[kind]
    return np.random.Generator(bits(None if seed is None else seed % (1 << 64)))
