"""Sketches against sequential references and properties."""

import random
import time

import pytest
from pyspark.sql import functions as F
from rillflow.functions.hashing import HashFamily
from rillflow.operators import evaluate as ev
from rillflow.operators import exact, sketch
from rillflow.operators.linear import Bloom, CountingBloom, CountMin, FlowRadar
from rillflow.operators.ordered import ConservativeUpdate, CounterHierarchy, CuState, HashPipe, HierarchyCountMin, counting_bloom_fold, decode, peel
from test_core import STREAM, records, values


def stream(seed, n=400, flows=60):
    r = random.Random(seed)
    return [int(r.paretovariate(0.7)) % flows for _ in range(n)]


@pytest.fixture(scope="module")
def flows(spark):
    keys = stream(1)
    r = records(spark, keys).withColumn("value", F.lit(1).cast("long")).cache()
    return keys, r, exact.ground_truth(r, ["key"]).cache()


def test_count_min(flows):
    keys, _, truth = flows
    s = CountMin(3, 20)
    cells = s.build(truth)
    est = values(s.query(cells, truth.select("key")), "est")
    rows = [dict() for _ in range(3)]
    for k in keys:
        for row, p in zip(rows, s.hashes.places(k, s.width), strict=True):
            row[p] = row.get(p, 0) + 1
    assert est == {k: min(row[p] for row, p in zip(rows, s.hashes.places(k, s.width), strict=True)) for k in set(keys)}
    assert all(est[k] >= keys.count(k) for k in est)
    unseen = s.query(cells.where("false"), truth.select("key")).agg(F.max("est")).first()[0]
    assert unseen == 0


class Modulo(HashFamily):
    """A hash of one's own."""

    def position(self, i, key, width):
        return (key + i) % width

    def place(self, i, key, width):
        return (key + i) % width


def test_own_hash(flows):
    keys, _, truth = flows
    s = CountMin(1, 7, family=Modulo)
    assert values(s.query(s.build(truth), truth.select("key")), "est") == {k: sum(x % 7 == k % 7 for x in keys) for k in set(keys)}
    b = Bloom(7, 1, family=Modulo)
    assert {x[0] for x in b.build(truth).collect()} == {k % 7 for k in keys}


@pytest.mark.parametrize("depth", [3, 4])
def test_count_sketch(flows, depth):
    keys, _, truth = flows
    s = CountMin(depth, 30, seed=4, signed=True)
    est = values(s.query(s.build(truth), truth.select("key")), "est")
    sign = lambda i, k: ((s.hashes.constants[i][2] * k + s.hashes.constants[i][3]) % (2**31 - 1)) % 2 * 2 - 1
    rows = [dict() for _ in range(depth)]
    for k in keys:
        for i, p in enumerate(s.hashes.places(k, s.width)):
            rows[i][p] = rows[i].get(p, 0) + sign(i, k)
    for k in set(keys):
        v = sorted(rows[i][p] * sign(i, k) for i, p in enumerate(s.hashes.places(k, s.width)))
        want = v[depth // 2] if depth % 2 else int((v[depth // 2 - 1] + v[depth // 2]) / 2)
        assert est[k] == abs(want)


def test_conservative_update(flows):
    keys, r, truth = flows
    for shards in (1, 3):
        s = ConservativeUpdate(3, 20, shards)
        est = values(s.query(s.build(r), truth.select("key")), "est")
        assert all(est[k] >= keys.count(k) for k in est)
    s, h = ConservativeUpdate(3, 20), HashFamily(3, 1)
    rows = [[0] * s.shard_width for _ in range(3)]
    for k in keys:
        p = h.places(k, s.shard_width)
        to = min(rows[i][p[i]] for i in range(3)) + 1
        for i in range(3):
            rows[i][p[i]] = max(rows[i][p[i]], to)
    cells = {(c["r"], c["c"]): c["v"] for c in s.build(r).collect()}
    assert cells == {(i, c): v for i, row in enumerate(rows) for c, v in enumerate(row) if v}
    plain = CountMin(3, 20)
    cm = {(c["r"], c["c"]): c["v"] for c in plain.build(truth).collect()}
    assert all(cells[k] <= cm[k] for k in cells)


def test_bloom(flows, spark):
    keys, r, truth = flows
    b = Bloom(150, 3)
    some = truth.where("key % 2 = 0")
    found = values(b.lookup(b.build(some), truth), "found")
    bits = {p for k in set(keys) if k % 2 == 0 for p in b.hashes.places(k, b.bits)}
    assert found == {k: set(b.hashes.places(k, b.bits)) <= bits for k in set(keys)}
    parts = [b.build(truth.where(f"key % 2 = {i}")) for i in (0, 1)]
    assert {x[0] for x in b.merge(*parts).collect()} == {x[0] for x in b.build(truth).collect()}


@pytest.mark.parametrize("seed", range(4))
def test_gate_and_counting_bloom(spark, seed):
    keys = stream(seed + 10, 120, 50)
    r = records(spark, keys)
    truth = exact.ground_truth(r, ["key"])
    c = CountingBloom(60, 3, bits=8)
    counters, inserted = [0] * c.filter.bits, {}
    for k in keys:
        p = c.filter.hashes.places(k, c.filter.bits)
        if not all(counters[x] for x in p):
            for x in p:
                counters[x] += 1
            inserted[k] = True
        inserted.setdefault(k, False)
    assert values(c.filter.gate(truth), "inserted") == inserted
    assert {x["pos"]: x["n"] for x in c.build(truth).collect()} == {p: n for p, n in enumerate(counters) if n}
    folded = counting_bloom_fold(r.withColumn("insert", F.lit(True)), 60, 3, 8)
    assert {x["pos"]: x["n"] for x in folded.collect()} == {p: n for p, n in enumerate(counters) if n}


def test_counting_bloom_overflow_and_removal(spark):
    ops = [(0, 1, True), (1, 1, True), (2, 2, True), (3, 1, False), (4, 9, False)]
    df = spark.createDataFrame(ops, "seq long, key long, insert boolean")
    left = {x["pos"] for x in counting_bloom_fold(df, 1000, 3).collect()}
    assert left == set(HashFamily(3, 3).places(2, 1009))


def test_removals_below_zero_are_absent(spark, duck):
    """In so small a filter keys have a place twice; what falls below 0 isn't there, in the fold and its SQL."""
    from rillflow.plans import registry

    sql = registry._removal_sql(20, 3, 1).replace("FROM events", "FROM crowded")
    operations = [(i, random.Random(i).randrange(60), random.Random(~i).random() < 0.5) for i in range(600)]
    duck.execute("create temp table crowded (event_id bigint, user_id bigint, event_type varchar, value double, ts timestamp)")
    duck.executemany("insert into crowded values (?, ?, ?, 1, null)", [(i, k, "view" if x else "purchase") for i, k, x in operations])
    got = counting_bloom_fold(spark.createDataFrame(operations, "seq long, key long, insert boolean"), 20, 3, 8)
    assert sorted(map(tuple, got.collect())) == sorted(duck.execute(sql).fetchall())
    tight = CountingBloom(2, 3, bits=1)
    with pytest.raises(Exception, match="counter overflow"):
        tight.build(exact.ground_truth(records(spark, [1, 2, 3]), ["key"])).collect()


def test_hashpipe(flows):
    keys, r, _ = flows
    s = HashPipe(3, 11)
    h = HashFamily(3, 5)
    slots = [dict() for _ in range(3)]
    for k in keys:
        moving = (k, 1)
        for i in range(3):
            p = h.place(i, moving[0], s.shard_width)
            held = slots[i].get(p)
            if held is None:
                slots[i][p] = moving
                break
            if held[0] == moving[0]:
                slots[i][p] = (held[0], held[1] + moving[1])
                break
            if i == 0 or held[1] < moving[1]:
                slots[i][p], moving = moving, held
    got = {(x["stage"], x["pos"]): (x["key"], x["value"]) for x in s.build(r).collect()}
    assert got == {(i, p): v for i in range(3) for p, v in slots[i].items()}
    assert sum(v for _, v in got.values()) <= len(keys)
    est = values(s.estimates(s.build(r)), "est")
    assert values(s.heavy_hitters(s.build(r), 20), "est") == {k: v for k, v in est.items() if v >= 20}
    zero = s.build(r.withColumn("key", F.lit(0).cast("long")))  # a key of zero is a key
    assert values(s.estimates(zero), "est") == {0: len(keys)}


def test_flowradar(spark):
    keys = stream(5, 300, 40)
    truth = exact.ground_truth(records(spark, keys), ["key"])
    good = FlowRadar(20_000, 4, 300, 3)
    assert values(decode(good.build(truth), good), "est") == {k: keys.count(k) for k in set(keys)}
    stalled = FlowRadar(20_000, 4, 5, 3)
    assert decode(stalled.build(truth), stalled).count() < len(set(keys))
    m = ev.decodings(truth, decode(good.build(truth), good), ["key"], 0.01).first()
    assert (m["ratio"], m["are"], m["acc"], m["podf"]) == (1.0, 0.0, 1.0, 1.0)


def test_nothing_decoded_has_no_distribution(spark):
    """A table in which no flow peels gives no shares, which the report can print."""
    truth = exact.ground_truth(records(spark, range(40)), ["key"])
    crowded = FlowRadar(20_000, 4, 2, 3)
    found = decode(crowded.build(truth), crowded)
    assert found.count() == 0
    dist = [tuple(x) for x in ev.decoded_distribution(truth, found, ["key"], [0.0, 0.1]).collect()]
    assert dist == []
    assert "DIST" in ev.report({"decode": {"DIST": dist}})


def naive_peel(cells, places):
    """One pure cell of least address at a time, by looking at all of them."""
    table, out = {p: list(c) for p, c in cells.items()}, {}
    while any(c[1] == 1 for c in table.values()):
        at = min(p for p, c in table.items() if c[1] == 1)
        key, _, value = table[at]
        out[key] = out.get(key, 0) + value
        for p in places(key):
            if p in table:
                table[p][0] ^= key
                table[p][1] -= 1
                table[p][2] -= value
    return out


def radar_table(sketch, flows):
    cells = {}
    for key, value, counted in flows:
        for p in sketch.hashes.places(key, sketch.table):
            x, n, v = cells.get(p, (0, 0, 0))
            cells[p] = (x ^ key, n + 1, v + value) if counted else (x, n, v + value)
    return cells


@pytest.mark.parametrize("flows_", [20, 45, 70, 100])
def test_peeling(flows_):
    """Tables that decode, that stall, and whose packets hold flows that the filter missed."""
    r = random.Random(flows_)
    sketch_ = FlowRadar(100, 2, 60, 3)
    for share in (0.0, 0.1):
        cells = radar_table(sketch_, [(r.randrange(1, 1 << 30), r.randrange(1, 9), r.random() >= share) for _ in range(flows_)])
        places = lambda k: sketch_.hashes.places(k, sketch_.table)
        assert peel(cells, places) == naive_peel(cells, places)


def test_peeling_is_fast():
    r = random.Random(1)
    sketch_ = FlowRadar(1_000_000, 5, 500_000, 5)
    flows_ = {r.randrange(1, 1 << 62): r.randrange(1, 100) for _ in range(100_000)}
    cells = radar_table(sketch_, [(k, v, True) for k, v in flows_.items()])
    began = time.perf_counter()
    assert peel(cells, lambda k: sketch_.hashes.places(k, sketch_.table)) == flows_
    assert time.perf_counter() - began < 10


@pytest.fixture(scope="module")
def tuples(spark):
    """Records of 13-byte keys, many of which a fold to 31 bits would merge."""
    r = random.Random(7)
    keys = [r.randbytes(13) for _ in range(80)]
    keys.append(bytes(13))
    rows = [(i, bytearray(keys[min(int(r.paretovariate(0.6)) - 1, 80)]), 1) for i in range(1500)]
    df = spark.createDataFrame(rows, "seq long, key binary, value long").cache()
    count = {}
    for _, k, _ in rows:
        count[bytes(k)] = count.get(bytes(k), 0) + 1
    return df, exact.ground_truth(df, ["key"]).cache(), count, rows


def test_sketches_of_byte_keys(tuples):
    records_, truth, count, rows = tuples
    by_key = lambda df, c: {bytes(x["key"]): x[c] for x in df.collect()}
    s = CountMin(3, 40)
    table = [dict() for _ in range(3)]
    for k, n in count.items():
        for row, p in zip(table, s.hashes.places(k, s.width), strict=True):
            row[p] = row.get(p, 0) + n
    want = {k: min(row[p] for row, p in zip(table, s.hashes.places(k, s.width), strict=True)) for k in count}
    assert by_key(s.query(s.build(truth), truth.select("key")), "est") == want
    signed = CountMin(3, 4000, signed=True)
    assert by_key(signed.query(signed.build(truth), truth.select("key")), "est") == count
    bloom = Bloom(200, 3)
    assert all(by_key(bloom.lookup(bloom.build(truth), truth), "found").values())
    cu = ConservativeUpdate(2, 30)
    state = CuState(HashFamily(2, 1), cu.shard_width)
    for _, k, v in rows:
        state.step(bytes(k), v)
    assert by_key(cu.query(cu.build(records_), truth.select("key")), "est") == {k: min(state.rows_[i][HashFamily(2, 1).place(i, k, cu.shard_width)] for i in range(2)) for k in count}
    pipe = HashPipe(4, 400)
    slots = pipe.build(records_)
    assert by_key(pipe.estimates(slots), "est") == count
    assert pipe.changers(slots, slots, 1).count() == 0 and by_key(pipe.changers(slots, slots.where("false"), 5), "est") == {k: n for k, n in count.items() if n >= 5}
    radar = FlowRadar(20_000, 4, 400, 3)
    assert by_key(radar.decode(radar.build(truth)), "est") == count
    small = FlowRadar(20_000, 4, 50, 3)
    cells = small.build(truth)
    got = by_key(small.decode(cells), "est")
    as_int = lambda k: int.from_bytes(k, "little")
    table = {}
    for k, n in count.items():
        for p in small.hashes.places(k, small.table):
            x, m, v = table.get(p, (0, 0, 0))
            table[p] = (x ^ as_int(k), m + 1, v + n)
    assert {as_int(k): n for k, n in got.items()} == naive_peel(table, lambda x: small.hashes.places(x.to_bytes(13, "little"), small.table))
    assert exact.value_of(truth, {"key": bytes(rows[0][1])}) == count[bytes(rows[0][1])]


def test_hierarchy():
    values_ = [3309568, 356352001, 163842, 10243, 1028, 5, 6]
    h = CounterHierarchy([7, 5, 3], [10, 10, 10], [2, 2], seed=8)
    for round_ in range(3):
        for i, v in enumerate([1000, 2000, 5, 30000, 1, 0, 77]):
            h.update(i, v * (round_ + 1))
    assert all(h.original[i] == v * 6 for i, v in enumerate([1000, 2000, 5, 30000, 1, 0, 77]))
    plain = CounterHierarchy([7, 5, 3], [40, 10, 10], [2, 2])
    for i, v in enumerate(values_):
        plain.update(i, v)
        plain.update(i, -1)
    assert [plain.get(i) for i in range(7)] == [v - 1 for v in values_]
    one = CounterHierarchy([50, 40], [4, 30], [3], seed=8)
    for i in range(0, 50, 5):
        one.update(i, 100 + i)
    assert [one.get(i) for i in range(50)] == [100 + i if i % 5 == 0 else 0 for i in range(50)]
    one.clear()
    one.update(3, 1 << 33)
    with pytest.raises(OverflowError):
        CounterHierarchy([2], [4], []).update(0, 99) or _read([2], [4], 99)
    for bad in (([], [], []), ([5, 9], [4, 4], [1]), ([5, 3], [4], [1]), ([5, 3], [4, 0], [1]), ([5, 3], [4, 4], [0]), ([5, 3], [4, 4], []), ([5, 3], [40, 40], [1]), ([0], [4], [])):
        with pytest.raises(ValueError):
            CounterHierarchy(*bad)


def _read(counts, widths, value):
    h = CounterHierarchy(counts, widths, [])
    h.update(0, value)
    return h.get(0)


def test_hierarchy_with_given_hashes():
    """Three layers, cells n, n + 1 above: decoded exactly at every step."""
    h = CounterHierarchy([7, 5, 3], [10, 10, 10], [2, 2], place=lambda layer, i, cell: (cell + i) % (5, 3)[layer])
    want = [0] * 7
    for i, v in ((0, 3000), (2, 5000), (5, 6), (0, 20000)):
        h.update(i, v)
        want[i] += v
        assert [h.get(k) for k in range(7)] == want


def test_hierarchy_count_min(flows):
    _, _, truth = flows
    plain = CountMin(3, 20)
    cells = plain.build(truth)
    wide = HierarchyCountMin(3, 20, 0.5, (30, 10), (3,))
    assert {tuple(r) for r in wide.decoded(cells).collect()} == {tuple(r) for r in cells.collect()}
    with pytest.raises(ValueError):
        HierarchyCountMin(3, 20, 1.0, (8, 8), (2,))


def test_registry(spark, flows):
    assert {"bloom", "count_min", "count_sketch", "hashpipe", "flowradar"} <= set(sketch.names())
    assert sketch.create("count_min", depth=5, width=80001).size == 1_600_612
    with pytest.raises(KeyError):
        sketch.create("nothing")
    s = sketch.Sketch()
    assert s.query(flows[2], flows[2].select("key")).agg(F.max("est")).first()[0] == 0
    assert s.decode(flows[2]).count() == s.heavy_hitters(flows[2], 1).count() == s.changers(flows[2], flows[2], 1).count() == 0
    assert s.lookup(flows[2], flows[2]).where("found").count() == 0


def test_metric_goldens(spark):
    truth = exact.ground_truth(records(spark, STREAM), ["key"]).cache()
    ones = truth.withColumn("est", F.lit(1).cast("long"))
    m = ev.errors(ones, 0.6667).first()
    assert (m["are"], m["aae"], m["acc"], m["podf"]) == (0.61, 2.2, 0.1, 0.6)
    dist = [r["share"] for r in ev.distribution(ones, [i / 10 for i in range(1, 10)]).orderBy("tick").collect()]
    assert dist == [0.1, 0, 0, 0, 0.2, 0, 0.3, 0.4, 0, 0]
    hh = spark.createDataFrame([(1, 5), (7, 4), (3, 1)], "key long, est long")
    top = exact.heavy_hitters(truth, 4.9 / 32, "percentile")
    r = ev.detections(top, hh, ["key"]).first()
    assert (r["are"], r["prc"], r["rcl"], r["f1"]) == (0.1, 0.666667, 1.0, 0.8)
    r = ev.detections(top, spark.createDataFrame([(1, 4), (3, 1)], "key long, est long"), ["key"]).first()
    assert (r["are"], r["prc"], r["rcl"], r["f1"]) == (0.2, 0.5, 0.5, 0.5)
    r = ev.decodings(truth, spark.createDataFrame([(1, 5), (7, 3), (3, 5)], "key long, est long"), ["key"], 0.2).first()
    assert (r["ratio"], r["are"], r["aae"], r["acc"], r["podf"]) == (0.3, 0.216667, 1.0, 0.333333, 0.333333)
    none = ev.detections(top, hh.where("false"), ["key"]).first()
    assert none["prc"] is None and none["rcl"] == 0.0
    looked = spark.createDataFrame([(True, True)] * 5 + [(True, False)] * 2 + [(False, False)], "found boolean, member boolean")
    r = ev.lookups(looked).first()
    assert (r["tp"], r["fp"], r["prc"]) == (0.625, 0.25, 0.714286)


def test_report():
    text = ev.report({"size": {"SIZE": 1_600_612}, "query": {"ARE": 0.161831, "RATE": 2e6, "DIST": [(0.1, 0.5), (float("inf"), 0.5)]}, "heavyhitter": {"TIME": 1500.0, "PRC": None}})
    assert "1.52646 MB" in text and "2 Mpac/s" in text and "1.5 ms" in text and "<=inf: 50%" in text
