"""Sketches as relations: Count-Min, Count Sketch, Bloom filters, FlowRadar's tables.

The state of each is a DataFrame of cells.  Their updates commute (or have a
closed form over first-seen order), so building is an aggregate, merging is
another, and a query is an equi-join on positions.  A cell table has at most
depth * width rows, a bound fixed by the sketch's parameters; it is broadcast
while that bound is under ``BROADCAST_CELLS``, else joined by a shuffle.
``family(size, seed)`` makes the hashes; one's own takes HashFamily's place.
Keys are numbers or bytes; flows are told apart by the keys themselves, hashes
give positions only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import WORDS, HashFamily, hashed, is_bytes
from ..functions.numbers import next_prime
from .sketch import Sketch

BROADCAST_CELLS = 2_000_000


def bounded(cells: DataFrame, most: int) -> DataFrame:
    return F.broadcast(cells) if most <= BROADCAST_CELLS else cells


@dataclass(frozen=True)
class CountMin(Sketch):
    """Linear counters; ``signed`` makes it a Count Sketch (median of signed counters, then absolute)."""

    takes = "flows"
    depth: int
    width: int
    seed: int = 1
    signed: bool = False
    family: Callable[[int, int], HashFamily] = HashFamily
    hashes: HashFamily = field(init=False, repr=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "width", next_prime(self.width))
        object.__setattr__(self, "hashes", self.family(self.depth, self.seed))

    @property
    def size(self) -> int:
        """Bytes: 32-bit counters, and 32 for the object and each hash."""
        return self.depth * self.width * 4 + 32 * (self.depth * (2 if self.signed else 1)) + 32

    def entries(self, key: Column | list[Column], value: Column) -> Column:
        v = lambda i: value * self.hashes.sign(i, key) if self.signed else value
        return F.array(*(F.struct(F.lit(i).alias("r"), self.hashes.position(i, key, self.width).alias("c"), v(i).cast("long").alias("v")) for i in range(self.depth)))

    def build(self, flows: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
        """Cells (r, c, v) of flows; updates are linear, so flows may be summed per key before."""
        rows = flows.select(F.explode(self.entries(hashed(flows, key), F.col(value))).alias("e")).select("e.*")
        return rows.groupBy("r", "c").agg(F.sum("v").cast("long").alias("v"))

    def merge(self, *cells: DataFrame) -> DataFrame:
        return reduce(DataFrame.unionByName, cells).groupBy("r", "c").agg(F.sum("v").cast("long").alias("v"))

    def query(self, cells: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
        """keys with est: one broadcast join a row of the sketch, no shuffle of the keys."""
        out = keys
        k = hashed(keys, key)
        for i in range(self.depth):
            row = cells.where(F.col("r") == i).select(F.col("c").alias("_p"), F.col("v").alias(f"_v{i}"))
            out = out.withColumn("_p", self.hashes.position(i, k, self.width)).join(bounded(row, self.width), "_p", "left").drop("_p")
        found = [F.coalesce(F.col(f"_v{i}"), F.lit(0).cast("long")) for i in range(self.depth)]
        if self.signed:
            found = [v * self.hashes.sign(i, k) for i, v in enumerate(found)]
            ordered = F.sort_array(F.array(*found))
            d = self.depth
            # of an even number, the middle two are added and halved toward zero
            est = F.abs(ordered[d // 2] if d % 2 else ((ordered[d // 2 - 1] + ordered[d // 2]) / 2).cast("long"))
        else:
            est = F.least(*found) if self.depth > 1 else found[0]
        return out.withColumn("est", est.cast("long")).drop(*(f"_v{i}" for i in range(self.depth)))


@dataclass(frozen=True)
class Bloom(Sketch):
    """A Bloom filter: the distinct positions that are set."""

    takes = "flows"
    bits: int
    count: int
    seed: int = 2
    family: Callable[[int, int], HashFamily] = HashFamily
    hashes: HashFamily = field(init=False, repr=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "bits", next_prime(self.bits))
        object.__setattr__(self, "hashes", self.family(self.count, self.seed))

    @property
    def size(self) -> int:
        return -(-self.bits // 8) + 32 * self.count + 32

    def places(self, key: Column | list[Column]) -> Column:
        return F.array(*(self.hashes.position(i, key, self.bits) for i in range(self.count)))

    def build(self, keys: DataFrame, key: str = "key") -> DataFrame:
        return keys.select(F.explode(self.places(hashed(keys, key))).alias("pos")).distinct()

    def merge(self, *positions: DataFrame) -> DataFrame:
        return reduce(DataFrame.unionByName, positions).distinct()

    def lookup(self, positions: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
        """Distinct keys with found (no false negatives)."""
        probes = keys.select(key).distinct().select(key, F.explode(self.places(hashed(keys, key))).alias("pos"))
        hits = probes.join(bounded(positions.withColumn("_hit", F.lit(1)), self.bits), "pos", "left")
        return hits.groupBy(key).agg((F.count("_hit") == self.count).alias("found"))

    def gate(self, flows: DataFrame, key: str = "key", seen: str = "first_seen") -> DataFrame:
        """flows with inserted: false where the filter had all the key's positions before its first record.

        The key with the least first-seen at a position was inserted there, so a key
        is suppressed if and only if each of its positions has an earlier one.
        """
        probes = flows.select(key, seen, F.explode(self.places(hashed(flows, key))).alias("pos"))
        least = probes.groupBy("pos").agg(F.min(seen).alias("_m"))
        fate = probes.join(bounded(least, self.bits), "pos").groupBy(key).agg((~F.min(F.col("_m") < F.col(seen))).alias("inserted"))
        return flows.join(fate, key)


@dataclass(frozen=True)
class CountingBloom(Sketch):
    """A counting Bloom filter without removals: a set, since a key whose counters are all over 0 isn't inserted again."""

    takes = "flows"
    counters: int
    count: int
    bits: int = 4
    seed: int = 3
    family: Callable[[int, int], HashFamily] = HashFamily
    filter: Bloom = field(init=False, repr=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "filter", Bloom(self.counters, self.count, self.seed, self.family))

    @property
    def size(self) -> int:
        return -(-self.filter.bits * (self.bits + 1) // 8) + 32 * self.count + 32

    def build(self, flows: DataFrame, key: str = "key", seen: str = "first_seen") -> DataFrame:
        """Counters (pos, n) of inserted keys; more than the counters hold is an error when a row is read."""
        rows = self.filter.gate(flows, key, seen).where("inserted").select(F.explode(self.filter.places(hashed(flows, key))).alias("pos"))
        most = (1 << self.bits) - 1
        n = F.count("*").cast("long")
        return rows.groupBy("pos").agg(n.alias("n")).withColumn("n", F.when(F.col("n") <= most, F.col("n")).otherwise(F.raise_error(F.lit("counter overflow")).cast("long")))

    def lookup(self, counters: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
        return self.filter.lookup(counters.where("n > 0").select("pos"), keys, key)


@dataclass(frozen=True)
class FlowRadar(Sketch):
    """A flow filter and a table of (flow_xor, flow_count, packet_count)."""

    takes = "flows"
    filter_bits: int
    filter_hashes: int
    table: int
    table_hashes: int
    seed: int = 4
    family: Callable[[int, int], HashFamily] = HashFamily
    filter: Bloom = field(init=False, repr=False)
    hashes: HashFamily = field(init=False, repr=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "table", next_prime(self.table))
        object.__setattr__(self, "filter", Bloom(self.filter_bits, self.filter_hashes, self.seed, self.family))
        object.__setattr__(self, "hashes", self.family(self.table_hashes, self.seed + 100))

    @property
    def size(self) -> int:
        return self.filter.size + self.table * 16 + 32 * self.table_hashes + 32

    def build(self, flows: DataFrame, key: str = "key", value: str = "value", seen: str = "first_seen") -> DataFrame:
        """Cells (pos, flow_xor, flow_count, packet_count): flows that the filter took count once, all packets count.

        Of keys of bytes, flow_xor holds the words, and key_bytes says how long they are.
        """
        gated = self.filter.gate(flows, key, seen)
        k = hashed(gated, key)
        places = F.array(*(self.hashes.position(i, k, self.table) for i in range(self.table_hashes)))
        own = F.array(*k) if is_bytes(gated, key) else F.col(key).cast("long")
        rows = gated.select(own.alias("_k"), F.length(key).alias("_n"), value, "inserted", F.explode(places).alias("pos"))
        taken = lambda c: F.coalesce(F.bit_xor(F.when(F.col("inserted"), c)), F.lit(0).cast("long"))
        xor = F.array(*(taken(F.col("_k")[j]) for j in range(WORDS))) if is_bytes(gated, key) else taken(F.col("_k"))
        more = [F.max("_n").cast("long").alias("key_bytes")] if is_bytes(gated, key) else []
        return rows.groupBy("pos").agg(xor.alias("flow_xor"), F.count(F.when(F.col("inserted"), 1)).alias("flow_count"), F.sum(value).cast("long").alias("packet_count"), *more)

    def decode(self, state: DataFrame) -> DataFrame:
        from .ordered import decode

        return decode(state, self)

    def changers(self, state: DataFrame, other: DataFrame, threshold: float) -> DataFrame:
        """(key, est) of decoded flows whose packets differ by the threshold or more."""
        return changed(self.decode(state), self.decode(other), threshold)


def changed(one: DataFrame, two: DataFrame, threshold: float) -> DataFrame:
    """(key, est): |est in one - est in two| over the keys of both, from the threshold on."""
    zero = F.lit(0).cast("long")
    both = one.select("key", F.col("est").alias("_a")).join(two.select("key", F.col("est").alias("_b")), "key", "full")
    return both.select("key", F.abs(F.coalesce("_a", zero) - F.coalesce("_b", zero)).alias("est")).where(F.col("est") >= threshold)
