"""Sketches whose result depends on the order of updates.

Conservative update, HashPipe and the counting Bloom filter with removals are
folds over records in seq order.  A fold streams its rows (it never holds
them), so its memory is the sketch.  ``shards`` splits flows by a hash of the
key into independent sketches that fold in parallel, each with its share of the
width: this is the form for large streams.  One shard is the single sketch over
the whole stream, in one task: 0.2 to 0.8 million records a second, so up to
about a billion records in an hour; beyond, take shards, or
``streaming.windows.stream_fold``, which folds micro-batches into a kept state.
A flow's records are folded in one shard, however many they are: their order
counts.

The counter hierarchy and FlowRadar's decoding work on tables of a size fixed
by the sketch's parameters.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.hashing import WORD_BYTES, HashFamily, P, hashed, is_bytes, shard_of
from ..functions.numbers import next_prime
from .linear import CountMin, FlowRadar, changed
from .sketch import Sketch

Batches = Iterator[pa.RecordBatch]


def fold(records: DataFrame, columns: list[str], shards: int, make: Callable[[], object], schema: str, hashes: HashFamily, width: int, seq: str = "seq", key: str = "key") -> DataFrame:
    """Rows of each shard, in seq order, through ``make()``: an object with ``put(places, *columns)`` and ``rows()``, which gives tuples of the schema without the shard.  Places are a row's positions, hashed before they come to Python."""
    k = hashed(records, key)
    own = [*(hashes.position(i, k, width).alias(f"_p{i}") for i in range(hashes.size)), *(F.col(c).alias(f"_{i}") for i, c in enumerate(columns))]
    dealt = records.select(shard_of(records, key, shards).alias("_shard"), F.col(seq).alias("_seq"), *own)
    dealt = dealt.repartition(shards, "_shard").sortWithinPartitions("_shard", "_seq") if shards > 1 else dealt.repartition(1).sortWithinPartitions("_seq")
    first = 2 + hashes.size

    def kernel(batches: Batches) -> Batches:
        now, state = None, None

        def done() -> Batches:
            rows = [(now, *r) for r in state.rows()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)

        for batch in batches:
            lists = [c.to_pylist() for c in batch.columns]
            for shard, places, *row in zip(lists[0], zip(*lists[2:first], strict=True), *lists[first:], strict=True):
                if shard != now:
                    if state is not None:
                        yield from done()
                    now, state = shard, make()
                state.put(places, *row)
        if state is not None:
            yield from done()

    names = ["shard", *[c.split()[0] for c in schema.split(",")]]
    return dealt.mapInArrow(kernel, f"shard long, {schema}")


@dataclass
class CuState:
    hashes: HashFamily
    width: int
    rows_: list[list[int]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.rows_ = [[0] * self.width for _ in range(self.hashes.size)]

    def step(self, key: int | bytes, value: int) -> None:
        self.put(self.hashes.places(key, self.width), value)

    def put(self, places: Sequence[int], value: int) -> None:
        to = min([row[p] for row, p in zip(self.rows_, places, strict=True)]) + value
        for row, p in zip(self.rows_, places, strict=True):
            if row[p] < to:
                row[p] = to

    def rows(self) -> Iterator[tuple]:
        for r, row in enumerate(self.rows_):
            for c, v in enumerate(row):
                if v:
                    yield r, c, v


@dataclass(frozen=True)
class ConservativeUpdate(Sketch):
    """Count-Min whose counters are raised no further than the least one plus the update needs."""

    depth: int
    width: int
    shards: int = 1
    seed: int = 1
    family: Callable[[int, int], HashFamily] = HashFamily

    @property
    def shard_width(self) -> int:
        return next_prime(-(-self.width // self.shards))

    @property
    def size(self) -> int:
        return self.shards * self.depth * self.shard_width * 4 + 32 * self.depth + 32

    def build(self, records: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
        """Cells (shard, r, c, v)."""
        h, w = self.family(self.depth, self.seed), self.shard_width
        return fold(records, [value], self.shards, lambda: CuState(h, w), "r long, c long, v long", h, w, key=key)

    def query(self, cells: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
        h, k = self.family(self.depth, self.seed), hashed(keys, key)
        out = keys.withColumn("_s", shard_of(keys, key, self.shards))
        for i in range(self.depth):
            row = cells.where(F.col("r") == i).select(F.col("shard").alias("_s"), F.col("c").alias("_p"), F.col("v").alias(f"_v{i}"))
            out = out.withColumn("_p", h.position(i, k, self.shard_width)).join(F.broadcast(row) if self.shards * self.shard_width <= 2_000_000 else row, ["_s", "_p"], "left").drop("_p")
        found = [F.coalesce(F.col(f"_v{i}"), F.lit(0).cast("long")) for i in range(self.depth)]
        return out.withColumn("est", (F.least(*found) if self.depth > 1 else found[0]).cast("long")).drop("_s", *(f"_v{i}" for i in range(self.depth)))


@dataclass
class PipeState:
    """Stages of slots; None marks an empty one (a key of zeros is a key like any other).  A slot keeps its key's places, for when it is driven on."""

    hashes: HashFamily
    width: int
    slots: list[list] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.slots = [[None] * self.width for _ in range(self.hashes.size)]

    def step(self, key: int | bytes, value: int) -> None:
        self.put(tuple(self.hashes.places(key, self.width)), key, value)

    def put(self, places: Sequence[int], key: int | bytes, value: int) -> None:
        moving = (key, value, places)
        for stage, row in enumerate(self.slots):
            p = moving[2][stage]
            held = row[p]
            if held is None:
                row[p] = moving
                return
            if held[0] == moving[0]:
                row[p] = (held[0], held[1] + moving[1], held[2])
                return
            # the first stage always takes the newcomer, later ones keep the larger; what leaves the last is lost
            if stage == 0 or held[1] < moving[1]:
                row[p], moving = moving, held

    def rows(self) -> Iterator[tuple]:
        for stage, row in enumerate(self.slots):
            for p, held in enumerate(row):
                if held is not None:
                    yield stage, p, held[0], held[1]


@dataclass(frozen=True)
class HashPipe(Sketch):
    depth: int
    width: int
    shards: int = 1
    seed: int = 5
    family: Callable[[int, int], HashFamily] = HashFamily

    @property
    def shard_width(self) -> int:
        return next_prime(-(-self.width // self.shards))

    @property
    def size(self) -> int:
        """Bytes: a 13-byte key and a 32-bit counter a slot, hashes, object."""
        return self.shards * self.depth * self.shard_width * 17 + 32 * self.depth + 32

    def build(self, records: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
        """Slots (shard, stage, pos, key, value)."""
        h, w = self.family(self.depth, self.seed), self.shard_width
        return fold(records, [key, value], self.shards, lambda: PipeState(h, w), f"stage long, pos long, key {'binary' if is_bytes(records, key) else 'long'}, value long", h, w, key=key)

    def estimates(self, slots: DataFrame) -> DataFrame:
        """(key, est): the sum over stages."""
        return slots.groupBy("key").agg(F.sum("value").cast("long").alias("est"))

    def query(self, slots: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
        return keys.join(self.estimates(slots).withColumnRenamed("key", key), key, "left").withColumn("est", F.coalesce("est", F.lit(0).cast("long")))

    def heavy_hitters(self, slots: DataFrame, threshold: float) -> DataFrame:
        return self.estimates(slots).where(F.col("est") >= threshold)

    def changers(self, slots: DataFrame, other: DataFrame, threshold: float) -> DataFrame:
        """(key, est) of flows that either pipe holds and whose sums differ by the threshold or more."""
        return changed(self.estimates(slots), self.estimates(other), threshold)


@dataclass
class RemovableState:
    hashes: HashFamily
    width: int
    most: int
    counters: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.counters = [0] * self.width

    def has(self, places: Sequence[int]) -> bool:
        return all([self.counters[p] > 0 for p in places])

    def step(self, key: int | bytes, insert: bool) -> None:
        self.put(self.hashes.places(key, self.width), insert)

    def put(self, places: Sequence[int], insert: bool) -> None:
        """Inserts a key unless all its counters are over 0; removes one only if they are.  A key with a place twice takes 2 from that counter, which may so fall below 0."""
        if self.has(places) == bool(insert):
            return
        for p in places:
            self.counters[p] += 1 if insert else -1
            if self.counters[p] > self.most:
                raise OverflowError("counter overflow")

    def rows(self) -> Iterator[tuple]:
        for p, n in enumerate(self.counters):
            if n > 0:
                yield p, n


def counting_bloom_fold(operations: DataFrame, counters: int, count: int, bits: int = 4, seed: int = 3, shards: int = 1, family: Callable[[int, int], HashFamily] = HashFamily) -> DataFrame:
    """Counters (shard, pos, n) after inserts and removals (columns seq, key, insert), in order; one filter, or one a shard of the keys."""
    h, w = family(count, seed), next_prime(-(-counters // shards))
    return fold(operations, ["insert"], shards, lambda: RemovableState(h, w, (1 << bits) - 1), "pos long, n long", h, w)


def peel(cells: dict[int, tuple[int, int, int]], places: Callable[[int], list[int]]) -> dict[int, int]:
    """FlowRadar's decoding: again and again the pure cell (flow count 1) of least address gives its flow, which leaves all its cells (``places`` of it).  Ends after as many steps as there are cells.  Pure cells wait in a heap, so a step costs a logarithm."""
    table = {p: list(c) for p, c in cells.items()}
    pure = [p for p, c in table.items() if c[1] == 1]
    heapq.heapify(pure)
    out: dict[int, int] = {}
    steps = len(cells)
    while pure and steps:
        at = heapq.heappop(pure)
        key, flows, value = table[at]
        if flows != 1:  # was pure when it was put there
            continue
        steps -= 1
        out[key] = out.get(key, 0) + value
        for p in places(key):
            c = table.get(p)
            if c is not None:
                c[0] ^= key
                c[1] -= 1
                c[2] -= value
                if c[1] == 1:
                    heapq.heappush(pure, p)
    return out


def decode(cells: DataFrame, sketch: FlowRadar) -> DataFrame:
    """(key, est) of the flows that peel off.  One task reads the table, whose size the sketch fixes."""
    words = isinstance(cells.schema["flow_xor"].dataType, ArrayType)

    def kernel(batches: Batches) -> Batches:
        table, size = {}, 0
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            if words:  # one number a cell
                size = max([size, *columns[4]])
                columns[1] = [sum(w << 8 * WORD_BYTES * j for j, w in enumerate(x)) for x in columns[1]]
            table.update(zip(columns[0], zip(*columns[1:4], strict=True), strict=True))
        as_key = (lambda x: x.to_bytes(size, "little")) if words else (lambda x: x)
        whole = (1 << 8 * size if words else 1 << 63) - 1
        found = {k: v for k, v in peel(table, lambda x: sketch.hashes.places(as_key(x & whole), sketch.table)).items() if k <= whole}
        yield pa.RecordBatch.from_arrays([pa.array(map(as_key, found), pa.binary() if words else pa.int64()), pa.array(list(found.values()), pa.int64())], ["key", "est"])

    columns = ["pos", "flow_xor", "flow_count", "packet_count", *(["key_bytes"] if words else [])]
    return cells.select(*columns).repartition(1).mapInArrow(kernel, f"key {'binary' if words else 'long'}, est long")


class CounterHierarchy:
    """Layers of narrow counters; what overflows goes, hashed, to the next layer.

    Updates are kept by index and applied at the next read.  A read decodes from
    the top: each layer's flagged counters are solved for by least squares over
    the layer above (conjugate gradients on index arrays), rounded, and put in
    front of their low bits.  Without any overflow the low bits are the values.
    ``place(layer, i, cell)`` gives the i-th cell above; the default is the seeded family.
    """

    def __init__(self, counts: list[int], widths: list[int], hashes: list[int], place: Callable[[int, int, int], int] | None = None, seed: int = 6):
        layers = len(counts)
        if not layers or len(widths) != layers or len(hashes) != layers - 1:
            raise ValueError("one width a layer, and hashes between layers")
        if min(counts) <= 0 or min(widths) <= 0 or any(h <= 0 for h in hashes):
            raise ValueError("sizes must be positive")
        if any(a < b for a, b in zip(counts, counts[1:], strict=False)):
            raise ValueError("a layer can't be larger than the one below")
        if sum(widths) > 62:
            raise ValueError("counters wider than the type")
        self.counts, self.widths, self.hash_counts = list(counts), list(widths), list(hashes)
        family = [HashFamily(h, seed + k) for k, h in enumerate(hashes)]
        self._place = place or (lambda layer, i, cell: family[layer].place(i, cell, counts[layer + 1]))
        self._families = None if place else family
        self.clear()

    def _places(self, layer: int, cells: np.ndarray) -> np.ndarray:
        """Rows of the cells above, one a cell; its hashes are the columns."""
        n = self.hash_counts[layer]
        if self._families is None or type(self._families[layer]) is not HashFamily:
            return np.array([[self._place(layer, i, c) for i in range(n)] for c in cells.tolist()], np.int64).reshape(len(cells), n)
        k = cells.astype(object) if len(cells) and int(cells.max()) >= P else cells.astype(np.int64)
        return np.stack([((a * (k % P) + b) % P % self.counts[layer + 1]).astype(np.int64) for a, b, *_ in self._families[layer].constants], axis=1)

    def clear(self) -> None:
        self.layers = [np.zeros(n, np.int64) for n in self.counts]
        self.status = [np.zeros(n, bool) for n in self.counts]
        self.original = np.zeros(self.counts[0], np.int64)
        self.pending = np.zeros(self.counts[0], np.int64)
        self.waiting = self.overflowed = False
        self.decoded: np.ndarray | None = None

    def update(self, index: int, value: int) -> None:
        if not 0 <= index < self.counts[0]:
            raise IndexError(index)
        self.update_all(np.array([index]), np.array([value]))

    def update_all(self, indices: np.ndarray, values: np.ndarray) -> None:
        np.add.at(self.pending, indices, values)
        np.add.at(self.original, indices, values)
        self.waiting = True

    def _apply(self) -> None:
        todo, self.pending, self.waiting = self.pending, np.zeros_like(self.pending), False
        for layer, width in enumerate(self.widths):
            total = self.layers[layer] + todo
            self.layers[layer], carry = total & ((1 << width) - 1), total >> width
            full = np.flatnonzero(carry)
            if not len(full):
                break
            if layer == len(self.counts) - 1:
                raise OverflowError("the last layer overflowed")
            self.overflowed = True
            self.status[layer][full] = True
            todo = np.zeros(self.counts[layer + 1], np.int64)
            np.add.at(todo, self._places(layer, full), carry[full][:, None])
        self.decoded = None

    def get(self, index: int) -> int:
        if not 0 <= index < self.counts[0]:
            raise IndexError(index)
        return int(self.get_all()[index])

    def get_all(self) -> np.ndarray:
        if self.waiting:
            self._apply()
        if self.decoded is None:
            self.decoded = self._decode()
        return self.decoded

    def _decode(self) -> np.ndarray:
        values = self.layers[-1]
        for layer in range(len(self.counts) - 2, -1, -1):
            flagged = np.flatnonzero(self.status[layer])
            high = np.zeros(self.counts[layer], np.int64)
            if len(flagged):
                rows = self._places(layer, flagged)
                cols = np.broadcast_to(np.arange(len(flagged))[:, None], rows.shape)
                x = least_squares(rows.ravel(), cols.ravel(), values.astype(float), self.counts[layer + 1], len(flagged))
                high[flagged] = np.floor(x + 0.5).astype(np.int64)
            values = (high << self.widths[layer]) + self.layers[layer]
        return values

    @property
    def size(self) -> int:
        """Bytes of counters and status bits, and of hashes."""
        return sum(-(-n * (w + 1) // 8) for n, w in zip(self.counts, self.widths, strict=True)) + 32 * sum(self.hash_counts)

    @property
    def original_size(self) -> int:
        return 4 * self.counts[0]


def least_squares(rows: np.ndarray, cols: np.ndarray, b: np.ndarray, m: int, n: int) -> np.ndarray:
    """min |A x - b| for A with a one (added up) at each (row, col): conjugate gradients on the normal equations."""
    times = lambda x: np.bincount(rows, x[cols], m)
    back = lambda y: np.bincount(cols, y[rows], n)
    x = np.zeros(n)
    r = b - times(x)
    s = back(r)
    p, g = s.copy(), s @ s
    for _ in range(4 * n + 20):
        if g <= 1e-20 * max(1.0, b @ b):
            break
        q = times(p)
        a = g / (q @ q)
        x += a * p
        r -= a * q
        s = back(r)
        old, g = g, s @ s
        p = s + (g / old) * p
    return x


@dataclass(frozen=True)
class HierarchyCountMin(Sketch):
    """Count-Min whose counters are a hierarchy: cell r * width + position; each layer is the next prime of the last times ratio."""

    takes = "flows"
    depth: int
    width: int
    ratio: float
    widths: tuple[int, ...]
    hashes: tuple[int, ...]
    seed: int = 1
    family: Callable[[int, int], HashFamily] = HashFamily

    def __post_init__(self) -> None:
        if not 0 < self.ratio < 1:
            raise ValueError("ratio lies between 0 and 1")
        object.__setattr__(self, "width", next_prime(self.width))

    @property
    def plain(self) -> CountMin:
        """The Count-Min whose counters the hierarchy holds."""
        return CountMin(self.depth, self.width, self.seed, family=self.family)

    @property
    def size(self) -> int:
        return self.hierarchy().size + 32 * self.depth + 32

    @property
    def counts(self) -> list[int]:
        out = [self.depth * self.width]
        while len(out) < len(self.widths):
            out.append(next_prime(math.ceil(out[-1] * self.ratio)))
        return out

    def hierarchy(self) -> CounterHierarchy:
        return CounterHierarchy(self.counts, list(self.widths), list(self.hashes))

    def build(self, flows: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
        """Cells (r, c, v), decoded."""
        return self.decoded(self.plain.build(flows, key, value))

    def query(self, cells: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
        return self.plain.query(cells, keys, key)

    def low_layer(self, cells: DataFrame) -> DataFrame:
        """(r, c, low, carry) of a Count-Min's cells: what layer 0 keeps, and what goes to the next."""
        bits = self.widths[0]
        return cells.select("r", "c", F.col("v").bitwiseAND((1 << bits) - 1).alias("low"), F.shiftright("v", bits).alias("carry"))

    def decoded(self, cells: DataFrame) -> DataFrame:
        """Cells (r, c, v) of the plain Count-Min through the hierarchy and back.

        Layer 0's updates are sums, so they may be aggregated before; one task holds the hierarchy, whose size the sketch fixes.
        """
        width = self.width

        def kernel(batches: Batches) -> Batches:
            h, seen = self.hierarchy(), []
            for batch in batches:
                r, c, v = (x.to_numpy().astype(np.int64) for x in batch.columns)
                h.update_all(r * width + c, v)
                seen.append(r * width + c)
            if seen:
                at = np.concatenate(seen)
                yield pa.RecordBatch.from_arrays([pa.array((at // width).astype(np.int32)), pa.array(at % width), pa.array(h.get_all()[at])], ["r", "c", "v"])

        return cells.select("r", "c", "v").repartition(1).mapInArrow(kernel, "r int, c long, v long")
