"""A keyed bijection of 0..n-1, as a Column and in numpy."""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rounds of the network, and the prime of its mixing function; products of two residues fit 64 bits.
ROUNDS, PRIME = 6, (1 << 31) - 1


class Permutation:
    """An unbalanced Feistel network over a * b places, hardly more than n; a number that it
    sends beyond n goes through it again until it doesn't (cycle walking), so 0..n-1 is permuted.

    Numbers are mixed by squares modulo a prime: integer arithmetic that every engine has.
    """

    def __init__(self, n: int, seed: int = 0):
        if not 0 <= n < 1 << 62:
            raise ValueError("0 to 2**62 places")
        self.n = n
        self.a = max(1, math.isqrt(max(n - 1, 0)) + 1)
        self.b = max(1, -(-n // self.a))
        draw = random.Random(seed)
        self.keys = [(draw.randrange(PRIME), draw.randrange(PRIME), draw.randrange(PRIME)) for _ in range(ROUNDS)]
        # how often any number goes through at most: of those beyond n, fewer than a, the ones that numbers inside lead to are followed
        self.walks, beyond = 1, np.arange(n, self.a * self.b)
        beyond = beyond[self._back(beyond) < n]
        while len(beyond):
            beyond = self._once(beyond)
            beyond = beyond[beyond >= n]
            self.walks += 1

    @staticmethod
    def _mixed(v: np.ndarray, key: tuple[int, int, int]) -> np.ndarray:
        u = (v + key[0]) % PRIME
        u = (u * u + key[1]) % PRIME
        return (u * u + key[2]) % PRIME

    def _once(self, v: np.ndarray) -> np.ndarray:
        left, right = v // self.b, v % self.b
        for j, key in enumerate(self.keys):
            if j % 2:
                right = (right + self._mixed(left, key)) % self.b
            else:
                left = (left + self._mixed(right, key)) % self.a
        return left * self.b + right

    def _back(self, v: np.ndarray) -> np.ndarray:
        """The number that goes to ``v`` in one go."""
        left, right = v // self.b, v % self.b
        for j, key in reversed([*enumerate(self.keys)]):
            if j % 2:
                right = (right - self._mixed(left, key)) % self.b
            else:
                left = (left - self._mixed(right, key)) % self.a
        return left * self.b + right

    def places(self, v: np.ndarray) -> np.ndarray:
        out = self._once(np.asarray(v, np.int64))
        while (far := out >= self.n).any():
            out[far] = self._once(out[far])
        return out

    def column(self, v: Column) -> Column:
        """The place of a number in 0..n-1."""
        long = lambda x: F.lit(x).cast("long")
        prime, a, b = long(PRIME), long(self.a), long(self.b)
        keys = F.array(*[F.struct(*[long(k).alias(f"k{i}") for i, k in enumerate(ks, 1)], F.lit(j % 2 == 1).alias("odd")) for j, ks in enumerate(self.keys)])

        def one(s: Column, k: Column) -> Column:
            u = (F.when(k.odd, s.l).otherwise(s.r) + k.k1) % prime
            u = (u * u + k.k2) % prime
            u = (u * u + k.k3) % prime
            return F.struct(F.when(k.odd, s.l).otherwise((s.l + u) % a).alias("l"), F.when(k.odd, (s.r + u) % b).otherwise(s.r).alias("r"))

        def through(x: Column) -> Column:
            whole = F.call_function("div", x - x % b, b)
            return F.aggregate(keys, F.struct(whole.alias("l"), (x % b).alias("r")), one, lambda s: s.l * b + s.r)

        first = through(v.cast("long"))
        if self.walks == 1:
            return first
        return F.aggregate(F.sequence(F.lit(2), F.lit(self.walks)), first, lambda x, i: F.when(x < self.n, x).otherwise(through(x)))
