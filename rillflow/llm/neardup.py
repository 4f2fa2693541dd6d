"""Near-duplicate groups by SuperMinHash banding, exact verification and union-find.

A document's set holds its distinct shingles of ``words`` words (A-Z
lower-cased, words without ASCII white space; all words as one shingle if they
are fewer; no words: empty, linked with nothing), as 64-bit hashes.  Documents
are linked if 100 * |A & B| >= threshold * |A | B|.  The result has one row a
document with the least id that links reach.

1. Signatures: one pass over the texts (``superminhash``).  Equal sets are one
   class, which has a number; only classes are compared from here on.
2. Banding: classes with an equal band share a bucket.  At similarity 0.8 the
   24 bands of 4 miss a pair with probability 3e-6.
3. Stars: in each bucket every class is compared with the bucket's leader, on
   the full sets.  Linear in the buckets' sizes; joins most groups.
4. Rest: of buckets that still hold several components, the classes outside
   the heaviest one (the rest) are compared with all others of other
   components, in blocks of bounded weight (documents and shingles): first by
   signature (an estimate ``SLACK`` under the threshold, 4.9 standard errors for
   independent registers, and no earlier bucket in common), then, of those left,
   on the full sets, all pairs of a block at once.  A block gives only the links
   that join components, so no pairs are listed, whatever a group's size, and
   none is left out.  Buckets whose blocks (more than ``MANY``) would take more
   rows than prefix filtering are split by that first: linked sets share one of
   the rarest shingles of either, rarest in the bucket, so documents that agree
   in a frequent passage only don't meet.
5. Union-find over the links (``components``), twice: stars, then rest; and once
   more where an id has several texts, whose classes are then one.

With ``exact`` the buckets are those of prefix filtering over all classes, and
nothing is decided by signature: no link is missed, for a sort of all shingles.

No group meets in one task: groups are aggregated before shuffles, joined by
equi-joins that Spark splits where skewed, or dealt in blocks.

Null ids: such rows come back unlinked, with null component and kept.  A
repeated id is one document with several texts: each of its rows is counted on
its own, and what any of them is linked with is linked with the id.  Null text
counts as empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import few, map_batches, materialize, texts_of
from .components import components
from .superminhash import WordHashes, mix, shingles, signatures

#: Registers, and registers a band.
M, BAND = 96, 4
#: Weight a side of a block, and what a class weighs besides its shingles; how far an estimate may lie under the threshold.
BLOCK, WEIGHT, SLACK = 1 << 18, 512, 0.2
#: Up to so many blocks a bucket is never split before.
MANY = 16


def _sketch_kernel(words: int) -> Callable:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            sets = [shingles(t, words, known) for t in texts_of(batch)]
            reg = signatures(sets, M)
            bands = reg.reshape(len(sets), M // BAND, BAND)
            key = np.broadcast_to(np.arange(M // BAND, dtype=np.uint64) + np.uint64(1), bands.shape[:2])
            for i in range(BAND):
                key = mix(key ^ bands[:, :, i]) + np.uint64(i)
            short = (mix(reg) >> np.uint64(48)).astype("<u2")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(list(map(len, sets)), pa.int64()),
                    set_keys(sets),
                    pa.array(key.view(np.int64).tolist(), pa.list_(pa.int64())),
                    pa.array([x.tobytes() for x in short], pa.binary()),
                ],
                ["id", "n", "set_key", "bands", "sig"],
            )

    return kernel


def set_keys(sets: list[np.ndarray]) -> pa.Array:
    return pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())


def _set_kernel(words: int) -> Callable:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            sets = [shingles(t, words, known) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([set_keys(sets), pa.array([s.tobytes() for s in sets], pa.binary())], ["set_key", "shingles"])

    return kernel


def unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def _shingle_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, band, id, n, g): a row for each shingle g of a set."""
    for batch in batches:
        sets = [unpack(x) for x in batch.column(4).to_pylist()]
        times = np.fromiter(map(len, sets), np.int64, len(sets))
        flat = np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64)
        yield pa.RecordBatch.from_arrays([*(pa.array(np.repeat(batch.column(c).to_numpy(), times)) for c in range(4)), pa.array(flat)], ["key", "band", "id", "n", "g"])


def _prefix(threshold: int) -> F.Column:
    """How many of a set's shingles hold one that any linked set has."""
    return F.col("n") - F.expr(f"(n * {threshold} + 99) div 100") + 1


def prefix_buckets(rows: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Rows (key, band, id, n) of buckets dealt to smaller buckets in which linked sets still meet.

    Ordered by how many of a bucket's classes have them, linked sets share one of
    the first n - ceil(threshold * n / 100) + 1 shingles of either.  Those that
    only one class has come first and make no bucket.
    """
    sized = rows.select("key", "band", "id", "n").join(sets.select("id", "shingles"), "id").select("key", "band", "id", "n", "shingles")
    every = map_batches(sized, _shingle_kernel, "key long, band int, id long, n long, g long")
    shared = every.groupBy("key", "g").agg(F.count("*").alias("df")).where("df > 1")
    own = Window.partitionBy("key", "id")
    met = every.join(shared, ["key", "g"]).withColumn("place", F.row_number().over(own.orderBy("df", "g"))).withColumn("alone", F.col("n") - F.count("*").over(own))
    return met.where(F.col("place") + F.col("alone") <= _prefix(threshold)).select(F.xxhash64("key", "g").alias("key"), "band", "id", "n")


def linked(inter: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int, threshold: int) -> np.ndarray | bool:
    return 100 * inter >= threshold * (a + b - inter)


def _pair_kernel(threshold: int) -> Callable:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            last, cached = None, None
            for k, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if x is not last:
                    last, cached = x, unpack(x)
                other = unpack(y)
                both = np.sort(np.concatenate([cached, other]))
                if linked(int((both[1:] == both[:-1]).sum()), len(cached), len(other), threshold):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in keep], pa.int64()), pa.array([b[k] for k in keep], pa.int64())], ["src", "dst"])

    return kernel


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows of sorted batches, group by group of the first columns."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != key:
                if rows:
                    yield rows
                key, rows = row[:keys], []
            rows.append(row)
    if rows:
        yield rows


def _flag_kernel(threshold: int, exact: bool) -> Callable:
    """Of each block: the rows that some pair of the block still needs, by signature."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, 3):
            rest, other = [r for r in rows if r[4]], [r for r in rows if not r[4]]
            if not rest or not other:
                continue
            sig = [np.frombuffer(b"".join(r[9] for r in x), "<u2").reshape(-1, M) for x in (rest, other)]
            ids, comp, n = ([np.array([r[c] for r in x], np.int64) for x in (rest, other)] for c in (3, 5, 6))
            bands = [[set(r[10]) for r in x] if exact else np.array([r[10] for r in x], np.int64) for x in (rest, other)]
            leader = rows[0][7]
            need_r, need_o = np.zeros(len(rest), bool), np.zeros(len(other), bool)
            for i in range(len(rest)):
                low, high = np.minimum(n[0][i], n[1]), np.maximum(n[0][i], n[1])
                k = np.flatnonzero((comp[1] != comp[0][i]) & (ids[1] != leader) & (100 * low >= threshold * high) & (ids[0][i] != leader))
                # the first bucket in common is this one, else another has the pair
                if len(k) and exact:
                    k = k[[min(bands[0][i] & bands[1][j]) == rows[0][0] for j in k.tolist()]]
                elif len(k):
                    k = k[(sig[1][k] == sig[0][i]).sum(axis=1) >= (threshold / 100 - SLACK) * M]
                    k = k[(bands[1][k] == bands[0][i]).argmax(axis=1) == rest[i][8]]
                need_r[i] |= len(k) > 0
                need_o[k] = True
            out = [r for r, f in zip(rest, need_r, strict=True) if f] + [r for r, f in zip(other, need_o, strict=True) if f]
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[c], t) for c, t in ((0, pa.int64()), (1, pa.int32()), (2, pa.int32()), (3, pa.int64()), (4, pa.bool_()), (5, pa.int64()))], ["key", "rc", "oc", "id", "rest", "comp"])

    return kernel


def intersections(a: list[np.ndarray], b: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all intersections of the sets of a with those of b, by products of 0/1 matrices over the shingles that both sides have."""
    sizes = [np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b)]
    flat = [np.concatenate(x) for x in (a, b)]
    shared = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
    out = np.zeros((len(a), len(b)), np.float64)
    where = []
    for x, s in zip(flat, sizes, strict=True):
        at = np.searchsorted(shared, x)
        hit = (at < len(shared)) & (shared[np.minimum(at, max(len(shared) - 1, 0))] == x) if len(shared) else np.zeros(len(x), bool)
        where.append((np.repeat(np.arange(len(s)), s)[hit], at[hit]))
    for lo in range(0, len(shared), columns):
        m = []
        for (row, col), x in zip(where, (a, b), strict=True):
            own = (col >= lo) & (col < lo + columns)
            z = np.zeros((len(x), min(columns, len(shared) - lo)), np.float32)
            z[row[own], col[own] - lo] = 1
            m.append(z)
        out += m[0] @ m[1].T
    return out.astype(np.int64)


def _block_kernel(threshold: int) -> Callable:
    """Of each block: links on the full sets that join components."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, 3):
            sides = [[r for r in rows if r[4] == f] for f in (True, False)]
            if not all(sides):
                continue
            sets = [[unpack(r[6]) for r in x] for x in sides]
            n = [np.fromiter(map(len, x), np.int64, len(x)) for x in sets]
            ok = linked(intersections(*sets), n[0][:, None], n[1][None, :], threshold)
            up: dict[int, int] = {}

            def root(c: int) -> int:
                while up.get(c, c) != c:  # noqa: B023
                    c = up[c]  # noqa: B023
                return c

            links = []
            for i, j in zip(*map(np.ndarray.tolist, np.nonzero(ok)), strict=True):
                x, y = sides[0][i][5], sides[1][j][5]
                p, q = root(x), root(y)
                if p != q:
                    up[max(p, q)] = min(p, q)
                    links.append((x, y))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], ["src", "dst"])

    return kernel


def _stars(buckets: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """(id, comp) of classes that links with their buckets' leaders join."""
    alike = 100 * F.least("n", "leader_n") >= threshold * F.greatest("n", "leader_n")
    stars = buckets.where(F.col("id") != F.col("leader")).where(alike).select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    own = lambda c: sets.select(F.col("id").alias(c), F.col("shingles").alias(f"set_{c}"))
    pairs = stars.join(own("b"), "b").join(own("a"), "a").select("a", "b", "set_a", "set_b")
    edges = map_batches(pairs, _pair_kernel(threshold), "src long, dst long")
    return materialize(components(edges).select(F.col("node").alias("id"), F.col("component").alias("comp")), "stars")


def _led(rows: DataFrame) -> DataFrame:
    """Buckets of two classes and more, of rows (key, band, id, n), with their leaders."""
    shared = rows.groupBy("key").agg(F.count("*").alias("c"), F.min(F.struct("id", "n")).alias("least")).where("c > 1")
    shared = few(materialize(shared.select("key", F.col("least.id").alias("leader"), F.col("least.n").alias("leader_n")), "shared"))
    return materialize(rows.join(shared, "key").select("key", "band", "id", "n", "leader", "leader_n"), "buckets")


def _mixed(placed: DataFrame, threshold: int) -> DataFrame:
    """Rows of buckets with several components, whether a row is of the rest (outside the heaviest component), how many blocks a side the rest (rcs) and all (ocs) make, and whether a split by prefixes makes fewer rows than they do (wide)."""
    weight = F.col("n") + WEIGHT
    parts = placed.groupBy("key", "comp").agg(F.sum(weight).alias("w"))
    sums = parts.groupBy("key").agg(F.count("*").alias("comps"), F.max(F.struct("w", "comp")).alias("most"), F.sum("w").alias("c")).where("comps > 1")
    sums = few(materialize(sums.select("key", F.col("most.comp").alias("main"), "c"), "mixed"))
    many = placed.join(sums, "key").withColumn("rest", F.col("comp") != F.col("main"))
    many = materialize(many.select("key", "band", "id", "n", "leader", "comp", "c", "rest"), "rest")
    made = many.groupBy("key").agg(F.sum(F.when(F.col("rest"), weight)).alias("r"), F.count(F.when(F.col("rest"), 1)).alias("rests"), F.count("*").alias("rows"), F.sum(_prefix(threshold)).alias("prefixes"))
    sizes = few(materialize(made, "sizes"))
    chunks = lambda c: F.ceil(F.col(c) / F.lit(BLOCK)).cast("int")
    both = many.join(sizes, "key").withColumn("rcs", chunks("r")).withColumn("ocs", chunks("c"))
    dealt = F.col("rests") * F.col("ocs") + F.col("rows") * F.col("rcs")
    return both.withColumn("wide", (F.col("rcs") * F.col("ocs") > MANY) & (dealt > F.col("prefixes"))).drop("rests", "rows", "prefixes")


def _rest_links(both: DataFrame, classes: DataFrame, sets: DataFrame, threshold: int, exact: bool) -> DataFrame:
    """(src, dst): links between components in buckets, block by block."""
    mine = lambda c, seed: F.pmod(F.xxhash64(F.lit(seed), "id"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    cols = ["key", "rc", "oc", "id", "rest", "comp", "n", "leader", "band"]
    as_rest = both.where("rest").withColumn("rc", mine("rcs", 1)).withColumn("oc", every("ocs")).select(*cols)
    as_other = both.withColumn("oc", mine("ocs", 2)).withColumn("rc", every("rcs")).withColumn("rest", F.lit(False)).select(*cols)
    blocks = as_rest.unionByName(as_other).join(classes.select("id", "sig", "bands"), "id")
    dealt = blocks.repartition("key", "rc", "oc").sortWithinPartitions("key", "rc", "oc").select(*cols, "sig", "bands")
    flagged = materialize(map_batches(dealt, _flag_kernel(threshold, exact), "key long, rc int, oc int, id long, rest boolean, comp long"), "flagged")
    full = flagged.join(sets.select("id", "shingles"), "id").repartition("key", "rc", "oc").sortWithinPartitions("key", "rc", "oc")
    return map_batches(full.select("key", "rc", "oc", "id", "rest", "comp", "shingles"), _block_kernel(threshold), "src long, dst long")


def _joined(first: DataFrame, links: DataFrame) -> DataFrame:
    """(id, comp) of classes: components that links join have one label."""
    second = few(materialize(components(links).select(F.col("node").alias("comp"), F.col("component").alias("last")), "joined"))
    lone = second.join(first.select(F.col("id").alias("comp")), "comp", "left_anti").select(F.col("comp").alias("id"), F.col("last").alias("comp"))
    return first.join(second, "comp", "left").select("id", F.coalesce("last", "comp").alias("comp")).unionByName(lone)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: int = 80, exact: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (doc_id = component_id) of every document."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketch = materialize(map_batches(source, _sketch_kernel(words), "id long, n long, set_key binary, bands array<long>, sig binary"), "sketch")
    known = sketch.where("id is not null and n > 0")
    # classes are numbered once and written, so their numbers stay
    classes = known.groupBy("set_key").agg(F.min("id").alias("rep"), F.first(F.struct("n", "bands", "sig")).alias("x"))
    classes = materialize(classes.select("set_key", "rep", F.monotonically_increasing_id().alias("id"), "x.n", "x.bands", "x.sig"), "classes")

    buckets = wanted = None
    if not exact:
        buckets = _led(classes.select("id", "n", F.posexplode("bands").alias("band", "key")))
        ids = few(materialize(buckets.select("id").distinct(), "candidates"))
        wanted = classes.join(ids, "id", "left_semi")
    wanted = few(materialize((classes if exact else wanted).select("id", "set_key", "rep"), "wanted"))
    made = map_batches(source.join(wanted.select(F.col("rep").alias("id")), "id", "left_semi"), _set_kernel(words), "set_key binary, shingles binary")
    sets = materialize(made.groupBy("set_key").agg(F.first("shingles").alias("shingles")).join(wanted.select("set_key", "id"), "set_key").select("id", "shingles"), "sets")
    if exact:
        prefixes = materialize(prefix_buckets(classes.select(F.lit(0).cast("long").alias("key"), F.lit(0).alias("band"), "id", "n"), sets, threshold), "prefixes")
        buckets = _led(prefixes)

    first = _stars(buckets, sets, threshold)
    placed = lambda rows: rows.join(first, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    both = _mixed(placed(buckets.select("key", "band", "id", "n", "leader")), threshold)
    wide = materialize(both.where("wide").select("key", "band", "id", "n"), "wide")
    marked = classes
    if exact:
        marked = classes.drop("bands").join(prefixes.groupBy("id").agg(F.collect_list("key").alias("bands")), "id")
    elif not wide.isEmpty():
        parts = materialize(prefix_buckets(wide, sets, threshold).withColumn("leader", F.lit(-1).cast("long")), "parts")
        both = both.where("not wide").unionByName(_mixed(placed(parts), threshold))
    final = _joined(first, _rest_links(both, marked, sets, threshold, exact))

    several = materialize(known.groupBy("id").agg(F.min("set_key").alias("lo"), F.max("set_key").alias("hi")).where("lo < hi").select("id"), "several")
    if not several.isEmpty():
        texts = known.select("id", "set_key").distinct().join(few(several), "id").join(classes.select("set_key", F.col("id").alias("class")), "set_key")
        texts = texts.join(final.withColumnRenamed("id", "class"), "class", "left").select("id", F.coalesce("comp", "class").alias("comp")).distinct()
        least = few(materialize(texts.groupBy("id").agg(F.min("comp").alias("src")), "least"))
        final = _joined(final, texts.join(least, "id").select("src", F.col("comp").alias("dst")))

    final = materialize(final.join(classes.select("id", "rep"), "id").select("id", "comp", "rep"), "final")
    names = few(materialize(final.groupBy("comp").agg(F.min("rep").alias("component")), "names"))
    by_class = final.join(names, "comp").select("id", "component")
    by_set = classes.select("set_key", "id", "rep").join(by_class, "id", "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    out = sketch.select("id", "n", "set_key").join(by_set, "set_key", "left")
    comp = F.when(F.col("n") > 0, F.when(F.col("id").isNotNull(), F.col("component"))).otherwise(F.col("id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), comp.alias("component_id"), (F.col("id") == comp).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: int = 80) -> DataFrame:
    """The rows of docs but for those of a group whose id isn't the group's least; all columns as they are.  Rows without an id stay."""
    gone = few(materialize(near_duplicates(docs, id_col, text_col, words, threshold).where("not kept").select(F.col("doc_id").alias(id_col)).distinct(), "dropped"))
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
