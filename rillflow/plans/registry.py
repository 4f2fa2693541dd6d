"""Queries over the driver's tables, one or more an operator, and the same in DuckDB SQL.

Widths are small enough for collisions at the test scales; every sum is cast to
BIGINT, every ratio rounded to six places, on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from ..functions import flowkey
from ..functions.hashing import WORD_BYTES, WORDS, HashFamily, P, fold
from ..functions.numbers import next_prime
from ..operators import evaluate as ev
from ..operators import exact
from ..operators.linear import Bloom, CountingBloom, CountMin, FlowRadar, changed
from ..operators.ordered import ConservativeUpdate, HashPipe, HierarchyCountMin, counting_bloom_fold
from ..operators.sketch import Sketch, create, register
from ..sources import formats, pcap
from ..sources.records import events, lineitem
from ..sources.scratch import scratch

CM = CountMin(3, 200, seed=1)
CS = CountMin(3, 200, seed=7, signed=True)
CM_PAIRS = CountMin(5, 5000, seed=9)
BLOOM = Bloom(1000, 3, seed=2)
CBF = CountingBloom(1000, 3, bits=8, seed=3)
RADAR = FlowRadar(200_000, 4, 9000, 3, seed=4)
RADAR_TUPLES = FlowRadar(8_000_000, 4, 200_000, 3, seed=8)
CU = ConservativeUpdate(3, 200, shards=4)
CU_ONE = ConservativeUpdate(3, 100)
PIPE = HashPipe(3, 120, shards=4)
PIPE_ONE = HashPipe(3, 60)
CBF_COUNTERS, CBF_HASHES = 1000, 3
CH = HierarchyCountMin(3, 200, 0.4, (6, 20), (3,), seed=1)
TICKS = [0.0, 0.05, 0.1, 0.25, 0.5, 1.0, 2.0]
SAMPLE, PODF, TOP, SHARE = 0.3, 0.1, 20, 0.001

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


# -- shared pieces of SQL --------------------------------------------------
EV = "ev AS (SELECT event_id AS seq, user_id AS key, event_type, CAST(floor(value) AS BIGINT) + 1 AS length, ts FROM events)"
GT = f"{EV}, gt AS (SELECT key, CAST(count(*) AS BIGINT) AS value, min(seq) AS first_seen FROM ev WHERE key IS NOT NULL GROUP BY key)"
HALF = "half AS (SELECT (max(event_id) + 1) // 2 AS h FROM events WHERE user_id IS NOT NULL)"
DIFF = f"{EV}, {HALF}, diff AS (SELECT key, abs(CAST(sum(CASE WHEN seq < h THEN 1 ELSE -1 END) AS BIGINT)) AS value FROM ev, half WHERE key IS NOT NULL GROUP BY key)"


def _family(name: str, hashes) -> str:
    return f"{name}(r, a, b, sa, sb) AS (VALUES {hashes.sql_rows()})"


def _pos(key: str, width: int) -> str:
    return f"((a * ({key} % {P}) + b) % {P}) % {width}"


def _cm_sql(s: CountMin, rows: str = "gt", key: str = "key") -> str:
    """CTEs h, cells and est (key, value, est) of a table with key and value."""
    sign = f"(((sa * ({key} % {P}) + sb) % {P}) % 2 * 2 - 1)" if s.signed else "1"
    est = f"abs(CAST(median({sign} * v) AS BIGINT))" if s.signed else "min(v)"
    return (
        f"{_family('h', s.hashes)}, cells AS (SELECT r, {_pos(key, s.width)} AS c, CAST(sum(value * {sign}) AS BIGINT) AS v FROM {rows}, h GROUP BY 1, 2), "
        f"est AS (SELECT g.{key}, any_value(g.value) AS value, CAST({est.replace(key, 'g.' + key)} AS BIGINT) AS est FROM {rows} g CROSS JOIN h JOIN cells c ON c.r = h.r AND c.c = {_pos('g.' + key, s.width)} GROUP BY g.{key})"
    )


ERRORS = "round(avg(abs(value - est) / CAST(nullif(value, 0) AS DOUBLE)), 6) AS are, round(avg(abs(value - est)), 6) AS aae, round(avg(CASE WHEN value = est THEN 1.0 ELSE 0.0 END), 6) AS acc"


def _truth(spark: SparkSession, sf_dir: str, by: str = "packets") -> DataFrame:
    return exact.ground_truth(events(spark, sf_dir), ["key"], by)


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return exact.halves(events(spark, sf_dir).where(F.col("key").isNotNull()))


# -- records, keys, weights --------------------------------------------------
@query(f"WITH {EV} SELECT seq, key, length, CASE WHEN length IS NULL THEN false ELSE length NOT BETWEEN 1 AND 1500 END AS spurious FROM ev")
def spurious_lengths(spark, sf_dir):
    return exact.flag_spurious(events(spark, sf_dir)).select("seq", "key", "length", "spurious")


@query(f"WITH {EV} SELECT seq, CAST(key AS INTEGER) AS src_ip, CAST(length AS INTEGER) AS dst_ip, CAST((key & 65535) - CASE WHEN (key & 65535) >= 32768 THEN 65536 ELSE 0 END AS SMALLINT) AS src_port, CAST(6 AS TINYINT) AS protocol FROM ev WHERE key IS NOT NULL AND length IS NOT NULL")
def flowkey_fields(spark, sf_dir):
    e = events(spark, sf_dir).where("key is not null and length is not null")
    key = flowkey.pack(F.col("key"), F.col("length"), F.col("key").bitwiseAND(65535), F.lit(80), F.lit(6))
    e = e.withColumn("k", key)
    return e.select("seq", *(flowkey.accessor(F.col("k"), f, 13).alias(f) for f in ("src_ip", "dst_ip", "src_port", "protocol")))


@query(f"WITH {EV} SELECT CAST(key AS INTEGER) AS ip, CAST(count(*) AS BIGINT) AS packets FROM ev WHERE key IS NOT NULL AND length IS NOT NULL GROUP BY key")
def rekey_pair_to_address(spark, sf_dir):
    e = events(spark, sf_dir).where("key is not null and length is not null").select(flowkey.pack(F.col("key"), F.col("length")).alias("k"))
    short = e.select(flowkey.rekey(F.col("k"), 4).alias("k")).groupBy("k").agg(F.count("*").alias("packets"))
    return short.select(flowkey.accessor(F.col("k"), "ip", 4).alias("ip"), "packets")


@query(f"WITH {EV} SELECT DISTINCT key, CAST((key >> 3) & 1 AS INTEGER) AS bit3, CAST((key >> 9) & 1 AS INTEGER) AS bit9, key | 512 AS set9 FROM ev WHERE key IS NOT NULL")
def bit_extract(spark, sf_dir):
    e = events(spark, sf_dir).where("key is not null").select("key").distinct().withColumn("k", flowkey.pack(F.col("key")))
    k = F.col("k")
    return e.select("key", flowkey.get_bit(k, 4, 3).alias("bit3"), flowkey.get_bit(k, 4, 9).alias("bit9"), flowkey.unsigned(flowkey.set_bit(k, 4, 9, True), 0, 4).alias("set9"))


@query(f"WITH {EV} SELECT DISTINCT key, xor(key, 1234567) AS mixed FROM ev WHERE key IS NOT NULL")
def key_xor(spark, sf_dir):
    e = events(spark, sf_dir).where("key is not null").select("key").distinct()
    return e.select("key", flowkey.unsigned(flowkey.xor(flowkey.pack(F.col("key")), flowkey.pack(F.lit(1234567)), 4), 0, 4).alias("mixed"))


@query(f"WITH {EV} SELECT seq, key, length FROM ev WHERE seq < CAST(floor(CAST({SAMPLE} AS DOUBLE) * (SELECT count(*) FROM ev)) AS BIGINT)")
def prefix_sample(spark, sf_dir):
    return exact.prefix(events(spark, sf_dir).select("seq", "key", "length"), SAMPLE)


@query(f"WITH {EV} SELECT seq, key FROM ev WHERE seq >= 100 AND seq < 700")
def record_slice(spark, sf_dir):
    return exact.between(events(spark, sf_dir).select("seq", "key"), 100, 700)


@query(f"WITH {EV} SELECT seq, key FROM ev ORDER BY seq LIMIT 500")
def packet_cap(spark, sf_dir):
    return exact.packet_cap(events(spark, sf_dir).select("seq", "key"), 500)


@query(f"WITH {EV}, f AS (SELECT key, min(seq) AS s FROM ev GROUP BY key ORDER BY s LIMIT 50) SELECT seq, key FROM ev WHERE (SELECT count(*) FROM f) < 50 OR seq < (SELECT max(s) FROM f)")
def flow_cap(spark, sf_dir):
    return exact.flow_cap(events(spark, sf_dir).select("seq", "key"), ["key"], 50)


# -- exact aggregates -----------------------------------------------------------
@query(f"WITH {GT} SELECT * FROM gt")
def ground_truth_packets(spark, sf_dir):
    return _truth(spark, sf_dir)


@query(f"WITH {EV} SELECT key, CAST(sum(length) AS BIGINT) AS value, min(seq) AS first_seen FROM ev WHERE key IS NOT NULL AND length IS NOT NULL GROUP BY key")
def ground_truth_length(spark, sf_dir):
    return _truth(spark, sf_dir, "length")


@query("SELECT l_partkey AS key, l_suppkey AS supp, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS value FROM lineitem WHERE l_partkey IS NOT NULL AND l_suppkey IS NOT NULL AND l_quantity IS NOT NULL GROUP BY 1, 2")
def ground_truth_pairs(spark, sf_dir):
    return exact.ground_truth(lineitem(spark, sf_dir), ["key", "supp"], "length").select("key", "supp", "value")


@query(f"WITH {GT} SELECT CAST(count(*) AS BIGINT) AS flows, CAST(coalesce(sum(value), 0) AS BIGINT) AS total, min(value) AS least, max(value) AS most FROM gt")
def flow_totals(spark, sf_dir):
    return exact.totals(_truth(spark, sf_dir))


@query(f"WITH {GT} SELECT key, value FROM gt WHERE value = 66")
def equal_range(spark, sf_dir):
    return exact.equal_range(_truth(spark, sf_dir), 66).select("key", "value")


@query(f"WITH {GT}, w AS (SELECT DISTINCT o_custkey AS key FROM orders) SELECT key, value, CASE WHEN value IS NULL THEN 0 ELSE 1 END AS count FROM w LEFT JOIN gt USING (key)")
def point_lookup(spark, sf_dir):
    wanted = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("key")).distinct()
    return exact.lookup(_truth(spark, sf_dir), wanted, ["key"])


@query(f"WITH {GT}, x AS (SELECT key, value AS est FROM gt UNION ALL SELECT o_custkey, 3 FROM orders) SELECT key, CAST(sum(est) AS BIGINT) AS est FROM x GROUP BY key")
def estimate_upsert(spark, sf_dir):
    more = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("key"), F.lit(3).cast("long").alias("est"))
    return exact.upsert(_truth(spark, sf_dir).select("key", F.col("value").alias("est")), more, ["key"])


# -- heavy hitters and changers ---------------------------------------------------
@query(f"WITH {GT} SELECT key, value FROM gt ORDER BY value DESC, first_seen LIMIT {TOP}")
def hh_topk(spark, sf_dir):
    return exact.heavy_hitters(_truth(spark, sf_dir), TOP).select("key", "value")


@query(f"WITH {GT} SELECT key, value FROM gt WHERE value > (SELECT CAST(floor(CAST({SHARE} AS DOUBLE) * sum(value)) AS BIGINT) FROM gt)")
def hh_percentile(spark, sf_dir):
    return exact.heavy_hitters(_truth(spark, sf_dir), SHARE, "percentile").select("key", "value")


@query(f"WITH {EV}, gt AS (SELECT key, event_type, CAST(sum(length) AS BIGINT) AS value, min(seq) AS first_seen FROM ev WHERE key IS NOT NULL AND event_type IS NOT NULL AND length IS NOT NULL GROUP BY 1, 2) SELECT key, event_type, value FROM gt ORDER BY value DESC, first_seen LIMIT {TOP}")
def hh_topk_pairs(spark, sf_dir):
    return exact.heavy_hitters(exact.ground_truth(events(spark, sf_dir), ["key", "event_type"], "length"), TOP).select("key", "event_type", "value")


_FULL = f"{EV}, {HALF}, a AS (SELECT key, count(*) AS v FROM ev, half WHERE seq < h AND key IS NOT NULL GROUP BY key), b AS (SELECT key, count(*) AS v FROM ev, half WHERE seq >= h AND key IS NOT NULL GROUP BY key), diff AS (SELECT key, CAST(abs(coalesce(a.v, 0) - coalesce(b.v, 0)) AS BIGINT) AS value FROM a FULL JOIN b USING (key))"


@query(f"WITH {_FULL} SELECT key, value FROM diff ORDER BY value DESC, key LIMIT {TOP}")
def hc_topk(spark, sf_dir):
    a, b = (exact.ground_truth(x, ["key"]) for x in _halves(spark, sf_dir))
    return exact.heavy_changers(exact.differences(a, b, ["key"]), ["key"], TOP)


@query(f"WITH {_FULL} SELECT key, value FROM diff WHERE value > (SELECT CAST(floor(CAST(0.01 AS DOUBLE) * sum(value)) AS BIGINT) FROM diff)")
def hc_percentile(spark, sf_dir):
    a, b = (exact.ground_truth(x, ["key"]) for x in _halves(spark, sf_dir))
    return exact.heavy_changers(exact.differences(a, b, ["key"]), ["key"], 0.01, "percentile")


@query(f"WITH {DIFF} SELECT key, value FROM diff")
def hc_signed_union(spark, sf_dir):
    return exact.record_differences(*_halves(spark, sf_dir), ["key"])


# -- linear sketches ---------------------------------------------------------------
@query(f"WITH {GT}, {_cm_sql(CM)} SELECT r, c, v FROM cells")
def cm_cells(spark, sf_dir):
    return CM.build(_truth(spark, sf_dir))


@query(f"WITH {GT}, {_cm_sql(CM)} SELECT key, value, est FROM est")
def cm_estimate(spark, sf_dir):
    truth = _truth(spark, sf_dir)
    return CM.query(CM.build(truth), truth.select("key", "value"))


@query(f"WITH {GT}, {_cm_sql(CM)} SELECT {ERRORS}, round(avg(CASE WHEN abs(value - est) / CAST(nullif(value, 0) AS DOUBLE) <= {PODF} THEN 1.0 ELSE 0.0 END), 6) AS podf FROM est")
def cm_metrics(spark, sf_dir):
    truth = _truth(spark, sf_dir)
    return ev.errors(CM.query(CM.build(truth), truth.select("key", "value")), PODF)


@query(f"WITH {GT}, {_cm_sql(CM)} SELECT r, c, v FROM cells")
def cm_merge(spark, sf_dir):
    """Halves of the stream sketched apart and merged: the same cells."""
    return CM.merge(*(CM.build(exact.ground_truth(x, ["key"])) for x in _halves(spark, sf_dir)))


_PAIRS = f"pairs AS (SELECT l_partkey AS kp, l_suppkey AS ks, ((l_partkey % {P}) * 1000003 + l_suppkey % {P}) % {P} AS key, CAST(count(*) AS BIGINT) AS value FROM lineitem WHERE l_partkey IS NOT NULL AND l_suppkey IS NOT NULL GROUP BY 1, 2)"


@query(
    f"WITH {_PAIRS}, {_family('h', CM_PAIRS.hashes)}, cells AS (SELECT r, {_pos('key', CM_PAIRS.width)} AS c, CAST(sum(value) AS BIGINT) AS v FROM pairs, h GROUP BY 1, 2), "
    f"est AS (SELECT kp, ks, any_value(value) AS value, min(v) AS est FROM pairs CROSS JOIN h JOIN cells ON cells.r = h.r AND cells.c = {_pos('key', CM_PAIRS.width)} GROUP BY kp, ks) SELECT {ERRORS} FROM est"
)
def cm_pair_metrics(spark, sf_dir):
    """A 2-tuple key, folded for hashing only."""
    truth = exact.ground_truth(lineitem(spark, sf_dir), ["key", "supp"]).withColumn("k", fold(F.col("key"), F.col("supp")))
    return ev.errors(CM_PAIRS.query(CM_PAIRS.build(truth, "k"), truth.select("k", "value"), "k"))


@query(f"WITH {GT}, {_cm_sql(CS)} SELECT key, value, est FROM est")
def cs_estimate(spark, sf_dir):
    truth = _truth(spark, sf_dir)
    return CS.query(CS.build(truth), truth.select("key", "value"))


@query(f"WITH {GT}, {_cm_sql(CS)} SELECT {ERRORS} FROM est")
def cs_metrics(spark, sf_dir):
    truth = _truth(spark, sf_dir)
    return ev.errors(CS.query(CS.build(truth), truth.select("key", "value")))


_BITS = f"{EV}, {_family('h', BLOOM.hashes)}, sample AS (SELECT DISTINCT key FROM ev WHERE seq < CAST(floor(CAST({SAMPLE} AS DOUBLE) * (SELECT count(*) FROM ev)) AS BIGINT)), bits AS (SELECT DISTINCT {_pos('key', BLOOM.bits)} AS pos FROM sample, h), found AS (SELECT k.key, count(bits.pos) = {BLOOM.count} AS found FROM (SELECT DISTINCT key FROM ev) k CROSS JOIN h LEFT JOIN bits ON bits.pos = {_pos('k.key', BLOOM.bits)} GROUP BY k.key)"


def _bloom(spark, sf_dir):
    e = events(spark, sf_dir).where("key is not null")
    sample = exact.prefix(e, SAMPLE).select("key").distinct()
    return sample, BLOOM.lookup(BLOOM.build(sample), e)


@query(f"WITH {_BITS} SELECT key, found FROM found")
def bloom_lookup(spark, sf_dir):
    return _bloom(spark, sf_dir)[1]


def _shares(found: str) -> str:
    n = lambda f, m: f"count(CASE WHEN {f}found AND {m}member THEN 1 END)"
    tp, fp = n("", ""), n("", "NOT ")
    return f"SELECT round({tp} / CAST(count(*) AS DOUBLE), 6) AS tp, round({fp} / CAST(count(*) AS DOUBLE), 6) AS fp, round({n('NOT ', 'NOT ')} / CAST(count(*) AS DOUBLE), 6) AS tn, round({n('NOT ', '')} / CAST(count(*) AS DOUBLE), 6) AS fn, round({tp} / CAST(nullif({tp} + {fp}, 0) AS DOUBLE), 6) AS prc FROM {found}"


@query(f"WITH {_BITS}, x AS (SELECT found, key IN (SELECT key FROM sample) AS member FROM found) {_shares('x')}")
def bloom_metrics(spark, sf_dir):
    sample, found = _bloom(spark, sf_dir)
    return ev.lookups(found.join(sample.withColumn("m", F.lit(True)), "key", "left").select("found", F.coalesce("m", F.lit(False)).alias("member")))


def _gate_sql(f: Bloom) -> str:
    return f"{GT}, {_family('h', f.hashes)}, probe AS (SELECT key, value, first_seen, {_pos('key', f.bits)} AS pos FROM gt, h), least AS (SELECT pos, min(first_seen) AS m FROM probe GROUP BY pos), gate AS (SELECT key, any_value(value) AS value, NOT bool_and(m < first_seen) AS inserted FROM probe JOIN least USING (pos) GROUP BY key)"


_CBF = f"{_gate_sql(CBF.filter)}, cnt AS (SELECT {_pos('key', CBF.filter.bits)} AS pos, CAST(count(*) AS BIGINT) AS n FROM gate, h WHERE inserted GROUP BY 1)"


@query(f"WITH {_CBF} SELECT pos, n FROM cnt")
def cbf_counters(spark, sf_dir):
    return CBF.build(_truth(spark, sf_dir))


@query(f"WITH {_CBF} SELECT k.key, count(cnt.pos) = {CBF.count} AS found FROM (SELECT DISTINCT o_custkey AS key FROM orders) k CROSS JOIN h LEFT JOIN cnt ON cnt.pos = {_pos('k.key', CBF.filter.bits)} GROUP BY k.key")
def cbf_lookup(spark, sf_dir):
    asked = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("key")).distinct()
    return CBF.lookup(CBF.build(_truth(spark, sf_dir)), asked)


@query(f"WITH {_gate_sql(RADAR.filter)}, {_family('t', RADAR.hashes)}, x AS (SELECT {_pos('key', RADAR.table)} AS pos, key, value, inserted FROM gate, t) SELECT pos, coalesce(bit_xor(CASE WHEN inserted THEN key END), 0) AS flow_xor, CAST(count(CASE WHEN inserted THEN 1 END) AS BIGINT) AS flow_count, CAST(sum(value) AS BIGINT) AS packet_count FROM x GROUP BY pos")
def flowradar_cells(spark, sf_dir):
    return RADAR.build(_truth(spark, sf_dir))


@query(f"WITH {_gate_sql(BLOOM)} SELECT key, inserted FROM gate")
def flow_filter_gate(spark, sf_dir):
    return BLOOM.gate(_truth(spark, sf_dir)).select("key", "inserted")


# -- evaluation -----------------------------------------------------------------------
def _dist_sql() -> str:
    edges = ev.ticks(TICKS)
    rows = []
    for lo, hi in zip([None, *edges], edges, strict=False):
        tick = f"CAST('{'Infinity' if hi == float('inf') else hi}' AS DOUBLE)"
        test = " AND ".join(x for x in (f"e <= {tick}", f"e > {lo}" if lo is not None else "") if x)
        rows.append(f"SELECT {tick} AS tick, round(avg(CASE WHEN {test} THEN 1.0 ELSE 0.0 END), 6) AS share FROM err")
    return " UNION ALL ".join(rows)


@query(f"WITH {GT}, {_cm_sql(CM)}, err AS (SELECT abs(value - est) / CAST(nullif(value, 0) AS DOUBLE) AS e FROM est) {_dist_sql()}")
def dist_histogram(spark, sf_dir):
    truth = _truth(spark, sf_dir)
    return ev.distribution(CM.query(CM.build(truth), truth.select("key", "value")), TICKS)


def _detect_sql(truth: str, found: str) -> str:
    return (
        f"both_ AS (SELECT t.value, f.est FROM {truth} t FULL JOIN {found} f USING (key)) SELECT round(count(CASE WHEN value IS NOT NULL AND est IS NOT NULL THEN 1 END) / CAST(nullif(count(est), 0) AS DOUBLE), 6) AS prc, "
        "round(count(CASE WHEN value IS NOT NULL AND est IS NOT NULL THEN 1 END) / CAST(nullif(count(value), 0) AS DOUBLE), 6) AS rcl, round(2 * count(CASE WHEN value IS NOT NULL AND est IS NOT NULL THEN 1 END) / CAST(nullif(count(est) + count(value), 0) AS DOUBLE), 6) AS f1, "
        "round(avg(abs(value - est) / CAST(nullif(value, 0) AS DOUBLE)), 6) AS are FROM both_"
    )


@query(f"WITH {GT}, {_cm_sql(CM)}, t AS (SELECT key, value FROM gt ORDER BY value DESC, first_seen LIMIT {TOP}), f AS (SELECT key, est FROM est WHERE est >= (SELECT min(value) FROM t)), {_detect_sql('t', 'f')}")
def hh_eval(spark, sf_dir):
    """Flows whose Count-Min estimate reaches the k-th true value, against the true top k."""
    truth = _truth(spark, sf_dir)
    top = exact.heavy_hitters(truth, TOP).select("key", "value")
    est = CM.query(CM.build(truth), truth.select("key", "value")).crossJoin(F.broadcast(top.agg(F.min("value").alias("cut"))))
    return ev.detections(top, est.where("est >= cut"), ["key"])


@query(
    f"WITH {_FULL}, t AS (SELECT key, value FROM diff ORDER BY value DESC, key LIMIT {TOP}), s AS (SELECT key, CAST(sum(CASE WHEN seq < h THEN 1 ELSE -1 END) AS BIGINT) AS value FROM ev, half WHERE key IS NOT NULL GROUP BY key), "
    + _cm_sql(CS, "s")
    + f", f AS (SELECT key, est FROM est WHERE est >= (SELECT min(value) FROM t)), {_detect_sql('t', 'f')}"
)
def hc_eval(spark, sf_dir):
    """The difference of two Count Sketches estimates the changers."""
    a, b = _halves(spark, sf_dir)
    w = lambda df, s: df.select("key", F.lit(s).cast("long").alias("value"))
    change = w(a, 1).unionByName(w(b, -1)).groupBy("key").agg(F.sum("value").cast("long").alias("value"))
    top = exact.heavy_changers(exact.record_differences(a, b, ["key"]), ["key"], TOP)
    est = CS.query(CS.build(change), change.select("key")).crossJoin(F.broadcast(top.agg(F.min("value").alias("cut"))))
    return ev.detections(top, est.where("est >= cut"), ["key"])


# -- order-dependent sketches ------------------------------------------------------------
# In SQL a fold is list_reduce over a shard's packets in order; the state is a list of counters.
def _packets(spark, sf_dir):
    return events(spark, sf_dir).where("key is not null").select("seq", "key", F.lit(1).cast("long").alias("value"))


def _place_sql(hashes: HashFamily, i: int, key: str, width: int) -> str:
    a, b, *_ = hashes.constants[i]
    return f"((CAST({a} AS BIGINT) * ({key} % {P}) + {b}) % {P}) % {width}"


def _fold_sql(shards: int, element: str, step: str, size: int) -> str:
    """CTE folded (shard, s): a list of ``size`` numbers after all elements x; step gives the next list from acc and x."""
    return (
        f"steps AS (SELECT {_place_sql(HashFamily(1, 77), 0, 'key', shards)} AS shard, list({element} ORDER BY seq) AS xs FROM ev WHERE key IS NOT NULL GROUP BY 1), "
        f"folded AS (SELECT shard, list_reduce(xs, lambda acc, x: {step}, list_transform(range({size}), lambda z: CAST(0 AS BIGINT))) AS s FROM steps)"
    )


def _cu_sql(cu: ConservativeUpdate, place: Callable[[int], str] | None = None) -> str:
    h, w, d = HashFamily(cu.depth, cu.seed), cu.shard_width, range(cu.depth)
    place = place or (lambda i: _place_sql(h, i, "key", w))
    at = [f"{place(i)} + {i * w + 1}" for i in d]
    step = f"list_transform(acc, lambda v, i: CASE WHEN list_contains(x, i) THEN greatest(v, 1 + least({', '.join(f'acc[x[{i + 1}]]' for i in d)})) ELSE v END)"
    return f"WITH {GT}, {_fold_sql(cu.shards, f'[{", ".join(at)}]', step, cu.depth * w)} SELECT key, value, least({', '.join(f's[{x}]' for x in at)}) AS est FROM gt JOIN folded ON shard = {_place_sql(HashFamily(1, 77), 0, 'key', cu.shards)}"


def _pipe_sql(pipe: HashPipe, least: int) -> str:
    """The state holds all slots' keys, then their values (0: empty), then the key and value on their way (0: none); a packet is one step a stage."""
    h, w, d = HashFamily(pipe.depth, pipe.seed), pipe.shard_width, pipe.depth
    n = d * w
    moving, weight = f"(CASE WHEN x[1] = 0 THEN x[2] ELSE acc[{2 * n + 1}] END)", f"(CASE WHEN x[1] = 0 THEN 1 ELSE acc[{2 * n + 2}] END)"
    slot = f"(x[1] * {w} + 1 + CASE x[1] " + " ".join(f"WHEN {i} THEN {_place_sql(h, i, moving, w)}" for i in range(d)) + " END)"
    key, value = f"acc[{slot}]", f"acc[{slot} + {n}]"
    same = f"({value} > 0 AND {key} = {moving})"
    swap = f"({value} = 0 OR x[1] = 0 OR {value} < {weight})"
    pick = lambda if_same, if_swap, otherwise: f"[CASE WHEN {same} THEN {if_same} WHEN {swap} THEN {if_swap} ELSE {otherwise} END]"
    step = (
        f"acc[1:{slot} - 1] || {pick(key, moving, key)} || acc[{slot} + 1:{slot} + {n - 1}] || {pick(f'{value} + {weight}', weight, value)} || acc[{slot} + {n + 1}:{2 * n}] "
        f"|| {pick(moving, key, moving)} || {pick('0', value, weight)}"
    )
    steps = f"flatten(list(list_transform(range({d}), lambda z: [z, key]) ORDER BY seq))"
    folded = _fold_sql(pipe.shards, "0", step, 2 * n + 2).replace("list(0 ORDER BY seq)", steps)
    return f"WITH {EV}, {folded}, slots AS (SELECT unnest(s[1:{n}]) AS key, unnest(s[{n + 1}:{2 * n}]) AS value FROM folded) SELECT key, CAST(sum(value) AS BIGINT) AS est FROM slots WHERE value > 0 GROUP BY key HAVING sum(value) >= {least}"


def _removal_sql(counters: int, hashes: int, shards: int) -> str:
    h, w = HashFamily(hashes, 3), next_prime(-(-counters // shards))
    at = ", ".join(f"{_place_sql(h, i, 'key', w)} + 1" for i in range(hashes))
    inserts = "CASE WHEN coalesce(event_type, '') <> 'purchase' THEN 1 ELSE 0 END"
    has = " AND ".join(f"acc[x[{i + 2}]] > 0" for i in range(hashes))
    times = " + ".join(f"CAST(i = x[{i + 2}] AS BIGINT)" for i in range(hashes))
    step = f"list_transform(acc, lambda v, i: v + (CASE WHEN x[1] = 1 AND NOT ({has}) THEN 1 WHEN x[1] = 0 AND {has} THEN -1 ELSE 0 END) * ({times}))"
    return f"WITH {EV}, {_fold_sql(shards, f'[{inserts}, {at}]', step, w)}, u AS (SELECT shard, unnest(range({w})) AS pos, unnest(s) AS n FROM folded) SELECT shard, pos, n FROM u WHERE n > 0"


def _cu(sketch: ConservativeUpdate, spark, sf_dir):
    return sketch.query(sketch.build(_packets(spark, sf_dir)), _truth(spark, sf_dir).select("key", "value"))


@query(_cu_sql(CU))
def cu_estimate(spark, sf_dir):
    return _cu(CU, spark, sf_dir)


@query(_cu_sql(CU_ONE))
def cu_estimate_one(spark, sf_dir):
    """One sketch over the whole stream."""
    return _cu(CU_ONE, spark, sf_dir)


@query(_pipe_sql(PIPE, 40))
def hashpipe_hh(spark, sf_dir):
    return PIPE.heavy_hitters(PIPE.build(_packets(spark, sf_dir)), 40)


@query(_pipe_sql(PIPE_ONE, 20))
def hashpipe_hh_one(spark, sf_dir):
    """One pipe over the whole stream."""
    return PIPE_ONE.heavy_hitters(PIPE_ONE.build(_packets(spark, sf_dir)), 20)


@query(_removal_sql(CBF_COUNTERS, CBF_HASHES, 4))
def cbf_remove(spark, sf_dir):
    """Purchases remove the user from the filter, other events insert it."""
    ops = events(spark, sf_dir).where("key is not null").select("seq", "key", (F.coalesce(F.col("event_type"), F.lit("")) != "purchase").alias("insert"))
    return counting_bloom_fold(ops, CBF_COUNTERS, CBF_HASHES, bits=8, shards=4)


@query(f"WITH {_gate_sql(RADAR.filter)} SELECT key, value AS est FROM gate WHERE (SELECT count(*) FROM gate WHERE NOT inserted) = 0")
def flowradar_decode(spark, sf_dir):
    return RADAR.decode(RADAR.build(_truth(spark, sf_dir)))


@query(
    f"WITH {_gate_sql(RADAR.filter)}, est AS (SELECT key, value AS est FROM gate WHERE (SELECT count(*) FROM gate WHERE NOT inserted) = 0), b AS (SELECT gt.value, est.est FROM gt LEFT JOIN est USING (key)) "
    f"SELECT round(count(est) / CAST(count(*) AS DOUBLE), 6) AS ratio, {ERRORS}, round(avg(CASE WHEN est IS NOT NULL THEN CASE WHEN abs(value - est) / CAST(nullif(value, 0) AS DOUBLE) <= 0.01 THEN 1.0 ELSE 0.0 END END), 6) AS podf FROM b"
)
def decode_metrics(spark, sf_dir):
    truth = _truth(spark, sf_dir)
    return ev.decodings(truth, RADAR.decode(RADAR.build(truth)), ["key"], 0.01)


@query(f"WITH {GT}, {_cm_sql(CM)} SELECT key, value, est FROM est")
def chcm_estimate(spark, sf_dir):
    truth = _truth(spark, sf_dir)
    return CH.query(CH.build(truth), truth.select("key", "value"))


@query(f"WITH {GT}, {_cm_sql(CM)} SELECT r, c, v & {(1 << CH.widths[0]) - 1} AS low, v >> {CH.widths[0]} AS carry FROM cells")
def chcm_low_layer(spark, sf_dir):
    """What the hierarchy's lowest layer keeps of each counter, and what it carries."""
    return CH.low_layer(CH.plain.build(_truth(spark, sf_dir)))


def _timed(e: DataFrame) -> DataFrame:
    """Times without a zone taken as UTC, whatever the session's zone."""
    if not isinstance(e.schema["timestamp"].dataType, TimestampNTZType):
        return e
    return e.withColumn("timestamp", F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', timestamp)")))


# -- keys of bytes: 5-tuples --------------------------------------------------------------
def _tuples(spark, sf_dir):
    e = _timed(events(spark, sf_dir)).where("key is not null and length is not null")
    return e.withColumn("key", flowkey.pack(F.col("key"), F.col("length"), F.col("key").bitwiseAND(65535), F.lit(80), F.lit(6)))


_TUPLE = "(CAST(key AS HUGEINT) + CAST(length AS HUGEINT) * 4294967296 + CAST(key & 65535 AS HUGEINT) * 18446744073709551616 + 80::HUGEINT * 1208925819614629174706176 + 6::HUGEINT * 79228162514264337593543950336)"
_WORDS = ", ".join(f"CAST((k // {1 << 8 * WORD_BYTES * j}::HUGEINT) % {1 << 8 * WORD_BYTES} AS BIGINT) AS w{j}" for j in range(WORDS))
TUPLES = f"{EV}, tk AS (SELECT *, {_TUPLE} AS k FROM ev WHERE key IS NOT NULL AND length IS NOT NULL), tuples AS (SELECT k, key, length, CAST(count(*) AS BIGINT) AS value, min(seq) AS first_seen, {_WORDS} FROM tk GROUP BY k, key, length)"


def _tuple_family(name: str, hashes: HashFamily) -> str:
    rows = ", ".join(f"({i}, {b}, " + ", ".join(f"CAST({f} AS BIGINT)" for f in factors) + ")" for i, ((_, b, *_), (factors, _)) in enumerate(zip(hashes.constants, hashes.factors, strict=True)))
    return f"{name}(r, b, {', '.join(f'f{j}' for j in range(WORDS))}) AS (VALUES {rows})"


def _tuple_pos(width: int) -> str:
    return f"(({' + '.join(f'f{j} * w{j}' for j in range(WORDS))} + b) % {P}) % {width}"


@query(
    f"WITH {TUPLES}, {_tuple_family('h', CM_PAIRS.hashes)}, cells AS (SELECT r, {_tuple_pos(CM_PAIRS.width)} AS c, CAST(sum(value) AS BIGINT) AS v FROM tuples, h GROUP BY 1, 2), "
    f"est AS (SELECT k, any_value(value) AS value, min(v) AS est FROM tuples CROSS JOIN h JOIN cells ON cells.r = h.r AND cells.c = {_tuple_pos(CM_PAIRS.width)} GROUP BY k) SELECT {ERRORS} FROM est"
)
def cm_tuple_metrics(spark, sf_dir):
    truth = exact.ground_truth(_tuples(spark, sf_dir), ["key"])
    return ev.errors(CM_PAIRS.query(CM_PAIRS.build(truth), truth.select("key", "value")))


_TUPLE_GATE = (
    f"{TUPLES}, {_tuple_family('h', RADAR_TUPLES.filter.hashes)}, probe AS (SELECT k, first_seen, {_tuple_pos(RADAR_TUPLES.filter.bits)} AS pos FROM tuples, h), least AS (SELECT pos, min(first_seen) AS m FROM probe GROUP BY pos), "
    "gate AS (SELECT k, NOT bool_and(m < first_seen) AS inserted FROM probe JOIN least USING (pos) GROUP BY k)"
)


@query(f"WITH {_TUPLE_GATE} SELECT CAST(key AS INTEGER) AS src_ip, CAST(length AS INTEGER) AS dst_ip, CAST(80 AS SMALLINT) AS dst_port, CAST(6 AS TINYINT) AS protocol, value AS est FROM tuples WHERE (SELECT count(*) FROM gate WHERE NOT inserted) = 0")
def flowradar_decode_5tuple(spark, sf_dir):
    """5-tuples back from XORed cells."""
    found = RADAR_TUPLES.decode(RADAR_TUPLES.build(exact.ground_truth(_tuples(spark, sf_dir), ["key"])))
    return found.select(*(flowkey.accessor(F.col("key"), f, 13).alias(f) for f in ("src_ip", "dst_ip", "dst_port", "protocol")), "est")


@query(
    f"WITH {_TUPLE_GATE}, {_tuple_family('t', RADAR_TUPLES.hashes)}, x AS (SELECT {_tuple_pos(RADAR_TUPLES.table)} AS pos, value, inserted, w0 FROM tuples JOIN gate USING (k), t) "
    "SELECT pos, coalesce(bit_xor(CASE WHEN inserted THEN w0 END), 0) AS xor0, CAST(count(CASE WHEN inserted THEN 1 END) AS BIGINT) AS flow_count, CAST(sum(value) AS BIGINT) AS packet_count FROM x GROUP BY pos"
)
def flowradar_cells_5tuple(spark, sf_dir):
    cells = RADAR_TUPLES.build(exact.ground_truth(_tuples(spark, sf_dir), ["key"]))
    return cells.select("pos", F.col("flow_xor")[0].alias("xor0"), "flow_count", "packet_count")


@query(f"WITH {TUPLES} SELECT CAST(key AS INTEGER) AS src_ip, value FROM tuples ORDER BY value DESC, first_seen LIMIT {TOP}")
def hh_topk_5tuple(spark, sf_dir):
    return exact.heavy_hitters(exact.ground_truth(_tuples(spark, sf_dir), ["key"]), TOP).select(flowkey.accessor(F.col("key"), "src_ip", 13).alias("src_ip"), "value")


_SIGNED = "list_transform([key & 255, (key >> 8) & 255, (key >> 16) & 255, (key >> 24) & 255], lambda b: CASE WHEN b >= 128 THEN b - 256 ELSE b END)"


@query(f"WITH {EV} SELECT DISTINCT key, {_SIGNED} < [5, -100, 0, 0] AS before FROM ev WHERE key IS NOT NULL")
def signed_key_order(spark, sf_dir):
    e = events(spark, sf_dir).where("key is not null").select("key").distinct()
    return e.select("key", flowkey.less(flowkey.pack(F.col("key")), F.lit(bytes([5, 156, 0, 0])), 4).alias("before"))


@query(f"WITH {EV}, z AS (SELECT count(*) AS zeros FROM ev WHERE key = 0) SELECT CAST(zeros AS BIGINT) AS zeros FROM z")
def zero_keys(spark, sf_dir):
    """Records with a key of zeros, which is a key like any other."""
    packed = events(spark, sf_dir).where("key is not null").select(flowkey.pack(F.col("key")).alias("k"))
    return packed.agg(F.count(F.when(F.col("k") == flowkey.zero(4), 1)).alias("zeros"))


@query(f"WITH {EV} SELECT DISTINCT key, ((key & 255) << 24) + (((key >> 8) & 255) << 16) + (((key >> 16) & 255) << 8) + ((key >> 24) & 255) AS turned FROM ev WHERE key IS NOT NULL")
def network_order(spark, sf_dir):
    e = events(spark, sf_dir).where("key is not null").select("key").distinct()
    return e.select("key", flowkey.network(flowkey.pack(F.col("key")), 0, 4).alias("turned"))


@query(f"WITH {EV}, gt AS (SELECT key, CAST(sum(length) AS BIGINT) AS value FROM ev WHERE key IS NOT NULL AND length IS NOT NULL GROUP BY key) SELECT key, value, value > 8191 AS overflow FROM gt")
def counter_overflow(spark, sf_dir):
    """Totals that a signed counter of 14 bits couldn't hold."""
    return exact.flag_overflow(_truth(spark, sf_dir, "length"), 14).select("key", "value", "overflow")


# -- sources and sinks ------------------------------------------------------------------------
def _folder(spark) -> str:
    return f"{scratch(spark)}/files-{uuid.uuid4().hex}"


_NUMBERED = f"{EV}, numbered AS (SELECT row_number() OVER (ORDER BY seq) - 1 AS seq, key, length, ts FROM ev WHERE key IS NOT NULL AND length IS NOT NULL)"
FORMAT = [["flowkey", "padding", "timestamp", "length", "padding"], [13, 3, 8, 2, 6]]


@query(f"WITH {_NUMBERED} SELECT CAST(seq AS BIGINT) AS seq, CAST(key AS INTEGER) AS src_ip, CAST(length AS INTEGER) AS dst_ip, epoch_us(ts) AS micros, length & 65535 AS length FROM numbered")
def record_files_round_trip(spark, sf_dir):
    """Records to binary files of the default format, and back in order."""
    fmt, folder = formats.RecordFormat.parse(FORMAT), _folder(spark)
    formats.write_record_files(_tuples(spark, sf_dir).withColumnRenamed("key", "flowkey"), folder, fmt)
    back = formats.read_records(spark, folder, fmt)
    return back.select("seq", *(flowkey.accessor(F.col("flowkey"), f, 13).alias(f) for f in ("src_ip", "dst_ip")), F.unix_micros("timestamp").alias("micros"), "length")


@query(f"WITH {EV} SELECT seq, lpad(lower(hex(key)), 8, '0') AS address, length FROM ev WHERE key IS NOT NULL AND length IS NOT NULL")
def text_round_trip(spark, sf_dir):
    """Records to CSV, and back."""
    folder = _folder(spark)
    e = events(spark, sf_dir).where("key is not null and length is not null")
    formats.write(e.select("seq", flowkey.pack(F.col("key")).alias("flowkey"), "length"), folder, "txt")
    return spark.read.schema("seq long, flowkey string, length long").csv(folder, header=True).select("seq", F.lower(F.lpad(F.hex(flowkey.unsigned(F.unhex("flowkey"), 0, 4)), 8, "0")).alias("address"), "length")


_PACKETS = f"{_NUMBERED}, packet AS (SELECT seq, key, length, ts, CASE WHEN key % 3 = 0 THEN 6 WHEN key % 3 = 1 THEN 17 ELSE 1 END AS protocol, 20 + length % 1000 AS size FROM numbered)"


@query(f"WITH {_PACKETS} SELECT key AS src_ip, length AS dst_ip, CAST(key % 60000 AS INTEGER) AS src_port, CAST(protocol AS INTEGER) AS protocol, epoch_us(ts) AS micros, size AS length FROM packet WHERE protocol <> 1 AND (protocol = 17 OR size > 100)")
def capture_round_trip(spark, sf_dir):
    """Packets to capture files, and back through a filter; what is neither TCP nor UDP has no 5-tuple."""
    folder = _folder(spark)
    e = events(spark, sf_dir).where("key is not null and length is not null")
    e = _timed(e)
    protocol = F.when(F.col("key") % 3 == 0, 6).when(F.col("key") % 3 == 1, 17).otherwise(1)
    rows = e.select("seq", "timestamp", F.col("key").alias("src_ip"), F.col("length").alias("dst_ip"), (F.col("key") % 60000).cast("int").alias("src_port"), F.lit(53).alias("dst_port"), protocol.alias("protocol"), (F.col("length") % 1000 + 20).alias("length"))
    pcap.write_captures(rows, folder)
    back = pcap.read_capture(spark, folder).where(pcap.packet_filter("ip && (udp || (tcp && greater 101))"))
    return back.select("src_ip", "dst_ip", "src_port", "protocol", F.unix_micros("timestamp").alias("micros"), "length")


@query("SELECT 'pcap' AS format, CAST(101 AS INTEGER) AS link_type, true AS filled")
def capture_summary(spark, sf_dir):
    """Format and link type of captures, by file."""
    folder = _folder(spark)
    e = _timed(events(spark, sf_dir)).where("key is not null").select("seq", "timestamp", F.col("key").alias("src_ip"), F.lit(1).cast("long").alias("dst_ip"), F.lit(1).alias("src_port"), F.lit(2).alias("dst_port"), F.lit(6).alias("protocol"), F.lit(40).cast("long").alias("length"))
    pcap.write_captures(e, folder)
    return pcap.capture_summaries(spark, folder).groupBy("format", "link_type").agg((F.sum("size") > 24).alias("filled"))


# -- more of the contract: one's own hash and sketch, sizes, reports -----------------------------
class Modulo(HashFamily):
    """A hash of one's own: the key plus the hash's number."""

    def position(self, i, key, width):
        return (key + i) % width

    def place(self, i, key, width):
        return (key + i) % width


CM_OWN, CU_OWN = CountMin(2, 90, family=Modulo), ConservativeUpdate(2, 90, family=Modulo)


@query(f"WITH {GT}, h(r) AS (VALUES (0), (1)), cells AS (SELECT r, (key + r) % {CM_OWN.width} AS c, CAST(sum(value) AS BIGINT) AS v FROM gt, h GROUP BY 1, 2) SELECT key, any_value(value) AS value, min(v) AS est FROM gt CROSS JOIN h JOIN cells ON cells.r = h.r AND cells.c = (key + h.r) % {CM_OWN.width} GROUP BY key")
def cm_own_hash(spark, sf_dir):
    truth = _truth(spark, sf_dir)
    return CM_OWN.query(CM_OWN.build(truth), truth.select("key", "value"))


@query(_cu_sql(CU_OWN, lambda i: f"(key + {i}) % {CU_OWN.shard_width}"))
def cu_own_hash(spark, sf_dir):
    return _cu(CU_OWN, spark, sf_dir)


class LastSeen(Sketch):
    """A sketch of one's own: remembers each flow's last length."""

    size = 0

    def build(self, records):
        return records.groupBy("key").agg(F.max(F.struct("seq", "value")).alias("m")).select("key", F.col("m.value").alias("last"))

    def query(self, state, keys, key="key"):
        return keys.join(state.withColumnRenamed("last", "est"), key, "left")

    def heavy_hitters(self, state, threshold):
        return state.where(F.col("last") >= threshold).select("key", F.col("last").alias("est"))

    def changers(self, state, other, threshold):
        return changed(state.select("key", F.col("last").alias("est")), other.select("key", F.col("last").alias("est")), threshold)


register("last_seen")(LastSeen)
_LAST = "(SELECT key, max_by(length, seq) AS est FROM ev WHERE key IS NOT NULL AND length IS NOT NULL {} GROUP BY key)"


@query(f"WITH {EV} SELECT key, CAST(est AS BIGINT) AS est FROM {_LAST.format('')} WHERE est >= 100")
def own_sketch_hitters(spark, sf_dir):
    """A registered sketch of one's own, made by name."""
    own = create("last_seen")
    rows = events(spark, sf_dir).where("key is not null and length is not null").withColumn("value", F.col("length"))
    return own.heavy_hitters(own.build(rows), 100)


@query(f"WITH {EV}, {HALF}, a AS {_LAST.format('AND seq < (SELECT h FROM half)')}, b AS {_LAST.format('AND seq >= (SELECT h FROM half)')} SELECT key, CAST(abs(coalesce(a.est, 0) - coalesce(b.est, 0)) AS BIGINT) AS est FROM a FULL JOIN b USING (key) WHERE abs(coalesce(a.est, 0) - coalesce(b.est, 0)) >= 50")
def own_sketch_changers(spark, sf_dir):
    own = create("last_seen")
    states = [own.build(x.where("length is not null").withColumn("value", F.col("length"))) for x in _halves(spark, sf_dir)]
    return own.changers(*states, 50)


@query(f"WITH {GT}, t AS (SELECT key, value FROM gt ORDER BY value DESC, first_seen LIMIT {TOP}), p AS ({_pipe_sql(PIPE_ONE, 1)}), f AS (SELECT key, est FROM p WHERE est >= (SELECT min(value) FROM t)), {_detect_sql('t', 'f')}")
def hashpipe_eval(spark, sf_dir):
    """What the pipe reports from the k-th true value on, against the true top k."""
    top = exact.heavy_hitters(_truth(spark, sf_dir), TOP).select("key", "value")
    held = PIPE_ONE.estimates(PIPE_ONE.build(_packets(spark, sf_dir))).crossJoin(F.broadcast(top.agg(F.min("value").alias("cut"))))
    return ev.detections(top, held.where("est >= cut"), ["key"])


@query(f"WITH {_gate_sql(RADAR.filter)}, n AS (SELECT count(*) AS all_, count(CASE WHEN inserted THEN 1 END) AS taken FROM gate) SELECT unnest([0.0::DOUBLE, 0.1::DOUBLE, 'Infinity'::DOUBLE]) AS tick, unnest([1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE]) AS share FROM n WHERE all_ = taken")
def decode_dist(spark, sf_dir):
    """Shares of the decoded flows by relative error."""
    truth = _truth(spark, sf_dir)
    return ev.decoded_distribution(truth, RADAR.decode(RADAR.build(truth)), ["key"], [0.0, 0.1])


@query(
    "SELECT * FROM (VALUES ('bloom', CAST(ceil(2577611 / 8.0) + 32 * 5 + 32 AS BIGINT)), ('count_min', CAST(5 * 80021 * 4 + 32 * 5 + 32 AS BIGINT)), ('count_sketch', CAST(5 * 80021 * 4 + 32 * 10 + 32 AS BIGINT)), ('hashpipe', CAST(5 * 1009 * 17 + 32 * 5 + 32 AS BIGINT)), "
    "('hierarchy_count_min', CAST(ceil(400105 * 11 / 8.0) + ceil(120041 * 8 / 8.0) + 32 * 3 + 32 * 5 + 32 AS BIGINT))) AS t(sketch, bytes)"
)
def sketch_sizes(spark, sf_dir):
    """Bytes of sketches of the default parameters."""
    made = {
        "bloom": create("bloom", num_bits=2577607, num_hash=5), "count_min": create("count_min", depth=5, width=80001), "count_sketch": create("count_sketch", depth=5, width=80001),
        "hashpipe": create("hashpipe", depth=5, width=1001), "hierarchy_count_min": create("hierarchy_count_min", depth=5, width=80001, cnt_no_ratio=0.3, width_cnt=(10, 7), no_hash=(3,)),
    }
    return spark.createDataFrame([(k, s.size) for k, s in made.items()], "sketch string, bytes long")


@query(f"WITH {GT}, {_cm_sql(CM)}, m AS (SELECT {ERRORS} FROM est) SELECT 'query' AS routine, unnest(['ARE', 'AAE', 'ACC']) AS metric, unnest([are, aae, acc]) AS value FROM m")
def metric_report(spark, sf_dir):
    """One row a metric."""
    truth = _truth(spark, sf_dir)
    return ev.as_rows("query", ev.errors(CM.query(CM.build(truth), truth.select("key", "value"))))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
