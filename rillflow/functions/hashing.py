"""A seeded hash family that is the same in Spark, in SQL and in Python.

position = ((a * (k mod P) + b) mod P) mod width, with P = 2^31 - 1: no product
overflows a BIGINT, so the expression needs no wraparound and Spark evaluates it
inside generated code.  A key of bytes is hashed by its words of three bytes:
position = ((sum of a_j * word_j + b) mod P) mod width, with factors of its own
for each hash and word, so distinct keys collide independently in each hash and
no number stands for a key.  A strategy of one's own only has to provide
``position`` and ``sign`` (columns) and ``place`` (Python).
"""

from __future__ import annotations

import random
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

P = 2147483647
#: Words of a key of bytes (up to 15 bytes; what a shorter key lacks is zero).
WORDS, WORD_BYTES = 5, 3


def fold(*columns: Column, base: int = 1000003) -> Column:
    """One number below P of several non-negative ones: reduced after every step.  Distinct tuples may fold alike, so group by the real columns."""
    return reduce(lambda k, c: (k * base + c % P) % P, columns[1:], columns[0] % P)


def fold_numbers(*xs: int, base: int = 1000003) -> int:
    return reduce(lambda k, c: (k * base + c % P) % P, xs[1:], xs[0] % P)


def key_words(key: bytes) -> list[int]:
    return [int.from_bytes(key[k : k + WORD_BYTES], "little") for k in range(0, WORDS * WORD_BYTES, WORD_BYTES)]


def is_bytes(df: DataFrame, key: str) -> bool:
    return isinstance(df.schema[key].dataType, BinaryType)


def hashed(df: DataFrame, key: str) -> Column | list[Column]:
    """What a family takes for a key column of df: the column itself if it is a number, its words if it is bytes."""
    if not is_bytes(df, key):
        return F.col(key)
    from .flowkey import unsigned

    return [F.coalesce(unsigned(F.col(key), k, WORD_BYTES), F.lit(0).cast("long")) for k in range(0, WORDS * WORD_BYTES, WORD_BYTES)]


@dataclass(frozen=True)
class HashFamily:
    """``size`` independent hashes drawn from a seed."""

    size: int
    seed: int = 1

    @cached_property
    def constants(self) -> list[tuple[int, int, int, int]]:
        r = random.Random(self.seed)
        return [(r.randrange(1, P), r.randrange(P), r.randrange(1, P), r.randrange(P)) for _ in range(self.size)]

    @cached_property
    def factors(self) -> list[tuple[list[int], list[int]]]:
        """By hash: the factors of a key's words for its position, and for its sign."""
        r = random.Random(f"words {self.seed}")
        return [tuple([r.randrange(1, P) for _ in range(WORDS)] for _ in range(2)) for _ in range(self.size)]

    def _mixed(self, i: int, key: Column | list[Column], sign: bool) -> Column:
        a, b = self.constants[i][2:] if sign else self.constants[i][:2]
        if isinstance(key, list):
            return reduce(lambda x, y: x + y, (F.lit(f).cast("long") * w for f, w in zip(self.factors[i][sign], key, strict=True)), F.lit(b).cast("long")) % P
        return (F.lit(a).cast("long") * (key.cast("long") % P) + b) % P

    def position(self, i: int, key: Column | list[Column], width: int) -> Column:
        return self._mixed(i, key, False) % width

    def sign(self, i: int, key: Column | list[Column]) -> Column:
        return self._mixed(i, key, True) % 2 * 2 - 1

    def place(self, i: int, key: int | bytes, width: int) -> int:
        a, b, *_ = self.constants[i]
        if isinstance(key, (bytes, bytearray)):
            return (sum(f * w for f, w in zip(self.factors[i][0], key_words(key), strict=True)) + b) % P % width
        return (a * (key % P) + b) % P % width

    def places(self, key: int | bytes, width: int) -> list[int]:
        if isinstance(key, (bytes, bytearray)):
            words = key_words(key)
            return [(sum(map(int.__mul__, f, words)) + b) % P % width for (f, _), (_, b, *_) in zip(self.factors, self.constants, strict=True)]
        return [(a * (key % P) + b) % P % width for a, b, *_ in self.constants]

    def sql_rows(self) -> str:
        """VALUES of (r, a, b, sa, sb)."""
        return ", ".join(f"({i}, CAST({a} AS BIGINT), CAST({b} AS BIGINT), CAST({c} AS BIGINT), CAST({d} AS BIGINT))" for i, (a, b, c, d) in enumerate(self.constants))


def shard_of(df: DataFrame, key: str, shards: int) -> Column:
    """The shard of a flow among ``shards``; the same in SQL, too."""
    return HashFamily(1, 77).position(0, hashed(df, key), shards).cast("long")
