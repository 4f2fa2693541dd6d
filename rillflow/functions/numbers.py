"""Small number functions: primes for sizing, byte order, fixed-width integers with carry."""

from __future__ import annotations

import sys


def is_prime(n: int) -> bool:
    """Whether n is prime; n must be positive."""
    if n <= 0:
        raise ValueError("n must be positive")
    if n < 4:
        return n > 1
    if n % 2 == 0:
        return False
    d = 3
    while d * d <= n:
        if n % d == 0:
            return False
        d += 2
    return True


def next_prime(n: int) -> int:
    """The least prime that is at least n; widths of all sketches go through it."""
    while not is_prime(n):
        n += 1
    return n


def net_to_host16(x: int) -> int:
    """A 16-bit number read in network order."""
    return x if sys.byteorder == "big" else int.from_bytes(x.to_bytes(2, "little"), "big")


def net_to_host32(x: int) -> int:
    return x if sys.byteorder == "big" else int.from_bytes(x.to_bytes(4, "little"), "big")


class FixedInt:
    """A counter of ``bits`` bits; ``add`` keeps the low bits and returns the (signed) carry.

    ``word`` is the width of the carrier type: bits must be positive and at most
    word - 2, and a sum beyond the carrier's range is an overflow.
    """

    def __init__(self, bits: int, word: int = 64):
        if not 0 < bits < word - 1:
            raise ValueError("bits out of range")
        self.bits, self.word, self.value = bits, word, 0

    def add(self, x: int) -> int:
        total = self.value + x
        if not -(1 << self.word - 1) <= total < 1 << self.word - 1 or abs(x) >= 1 << self.word - 2:
            raise OverflowError("update out of range")
        self.value = total & (1 << self.bits) - 1
        return total >> self.bits
