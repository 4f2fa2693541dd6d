"""Numbers, hashing, flow keys, exact operators on small fixed streams."""

import random

import pytest
from pyspark.sql import functions as F
from rillflow.functions import flowkey
from rillflow.functions.hashing import HashFamily, fold, fold_numbers
from rillflow.functions.numbers import FixedInt, is_prime, net_to_host16, net_to_host32, next_prime
from rillflow.operators import exact

KEYS = [0x1F1F1, 0x2F2F2, 0x1F1F1, 0x3F3F3, 0x4F4F4, 0x1F1F1, 0x2F2F2, 0x3F3F3, 0x5F5F5, 0x1F1F1]
STREAM = [int(c, 16) for c in "138a8a1552591446812a67133344777 7".replace(" ", "")]


def records(spark, keys, lengths=None):
    return spark.createDataFrame([(i, k, (lengths or [1] * len(keys))[i]) for i, k in enumerate(keys)], "seq long, key long, length long")


def values(df, value="value"):
    return {r["key"]: r[value] for r in df.collect()}


def test_numbers():
    assert is_prime(12340033) and is_prime(98473769)
    assert not any(map(is_prime, (98473768, 178431937, 3808279, 1)))
    assert [next_prime(n) for n in (1, 4, 1326728, 1328238, 84857149)] == [2, 5, 1326739, 1328269, 84857177]
    with pytest.raises(ValueError):
        is_prime(0)
    assert net_to_host32(0x12345678) == 0x78563412 and net_to_host16(0x2022) == 0x2220


def test_fixed_int():
    x = FixedInt(4, 32)
    assert [x.add(v) for v in (0x7F, 0x235, -0x136)] == [7, 0x24, -0x14] and x.value == 0xE
    assert x.add(-0x10D) == -0x10 and x.value == 1
    m = (2**31 - 1) >> 1
    y = FixedInt(30, 32)
    assert [y.add(v) for v in (m, m, 2, -m)] == [0, 1, 1, -1] and y.value == 1
    for bits in (0, -1, 31):
        with pytest.raises(ValueError):
            FixedInt(bits, 32)
    with pytest.raises(OverflowError):
        FixedInt(30, 32).add(1 << 30)


def test_hash_family_agrees(spark):
    h, keys = HashFamily(3, 5), [0, 1, 7, 2**31 - 1, 2**40 + 3]
    df = spark.createDataFrame([(k, 5) for k in keys], "k long, j long")
    got = df.select("k", *(h.position(i, F.col("k"), 101).alias(f"p{i}") for i in range(3)), fold(F.col("k"), F.col("j")).alias("f")).collect()
    for r in got:
        assert [r[f"p{i}"] for i in range(3)] == h.places(r["k"], 101)
        assert r["f"] == fold_numbers(r["k"], 5)


def test_flow_keys(spark):
    raw = bytes.fromhex("112233445566770809" "0a0b0c0d")
    df = spark.createDataFrame([(bytearray(raw),)], "k binary")
    k = F.col("k")
    fields = ("src_ip", "dst_ip", "src_port", "dst_port", "protocol")
    r = df.select(*(flowkey.accessor(k, f, 13).alias(f) for f in fields), flowkey.dotted(k).alias("d"), flowkey.pack(*(flowkey.accessor(k, f, 13) for f in fields)).alias("again"), flowkey.rekey(k, 8).alias("short")).first()
    assert [r[f] for f in fields] == [int.from_bytes(raw[a : a + n], "little", signed=True) for a, n in (flowkey.FIELDS[f] for f in fields)]
    assert bytes(r["again"]) == raw and bytes(r["short"]) == raw[:8] and r["d"] == "68.51.34.17"
    bits = df.select(*(flowkey.get_bit(k, 13, i).alias(f"b{i}") for i in range(104))).first()
    assert list(bits) == [raw[i >> 3] >> (i & 7) & 1 for i in range(104)]
    on, off = df.select(flowkey.set_bit(k, 13, 0, False).alias("a"), flowkey.set_bit(k, 13, 103, True).alias("b")).first()
    assert on[0] == 0x10 and off[12] == 0x8D
    x = df.select(flowkey.xor(k, k, 13).alias("x"), flowkey.less(k, F.lit(b"\x80" + raw[1:]), 13).alias("l"), flowkey.copy(k, 13, 2, F.lit(b"abcd"), 4, 1, 3).alias("c")).first()
    assert bytes(x["x"]) == bytes(13) and x["l"] is False and bytes(x["c"]) == raw[:2] + b"bcd" + raw[5:]
    for bad in (lambda: flowkey.accessor(k, "ip", 13), lambda: flowkey.accessor(k, "src_port", 8), lambda: flowkey.pack(k, k, k), lambda: flowkey.get_bit(k, 4, 32), lambda: flowkey.copy(k, 4, 2, k, 4, 0, 3), lambda: flowkey.zero(5)):
        with pytest.raises(ValueError):
            bad()


def test_ground_truth(spark):
    lengths = [1, 2, 4, 8, 0x10, 0x20, 0x40, 0x80, 0x100, 0x200]
    r = records(spark, KEYS, lengths)
    assert values(exact.ground_truth(r, ["key"], "length")) == {0x1F1F1: 549, 0x5F5F5: 256, 0x3F3F3: 136, 0x2F2F2: 66, 0x4F4F4: 16}
    truth = exact.ground_truth(r, ["key"])
    assert values(truth) == {0x1F1F1: 4, 0x2F2F2: 2, 0x3F3F3: 2, 0x4F4F4: 1, 0x5F5F5: 1}
    assert tuple(exact.totals(truth).first()) == (5, 10, 1, 4)
    assert tuple(exact.totals(truth.where("false")).first()) == (0, 0, None, None)
    assert set(values(exact.equal_range(truth, 2))) == {0x2F2F2, 0x3F3F3} and exact.equal_range(truth, 9).count() == 0
    assert exact.value_of(truth, {"key": 0x1F1F1}) == 4
    with pytest.raises(KeyError):
        exact.value_of(truth, {"key": 7})
    with pytest.raises(ValueError):
        exact.ground_truth(r, ["key"], "bytes")
    looked = exact.lookup(truth, spark.createDataFrame([(0x1F1F1,), (7,)], "key long"), ["key"])
    assert {(x["key"], x["value"], x["count"]) for x in looked.collect()} == {(0x1F1F1, 4, 1), (7, None, 0)}


def test_percentile_sweep(spark):
    keys = [int(c, 16) for c in "a38888155259144581256 7".replace(" ", "")]
    keys = [0xA, 3, 8, 8, 8, 8, 1, 5, 5, 2, 5, 9, 1, 4, 4, 5, 8, 1, 2, 5, 6, 7]
    lengths = [1, 8, 4, 1, 3, 2, 9, 6, 6, 1, 6, 2, 2, 3, 2, 6, 10, 9, 9, 6, 2, 2]
    truth = exact.ground_truth(records(spark, keys, lengths), ["key"], "length").cache()
    real = values(truth)
    assert real[5] == 30 and sum(real.values()) == 100
    for t in range(0, 101, 7):
        cut = int(t / 100 * 100)
        assert values(exact.heavy_hitters(truth, t / 100, "percentile")) == {k: v for k, v in real.items() if v > cut}
    for bad in (-0.1, 1.1):
        with pytest.raises(ValueError):
            exact.heavy_hitters(truth, bad, "percentile")
    with pytest.raises(ValueError):
        exact.heavy_hitters(truth, 0.5)


def test_top_k_and_changers(spark):
    r = records(spark, STREAM)
    truth = exact.ground_truth(r, ["key"])
    for k, want in ((2, {1, 7}), (4.9, {1, 7, 3, 4}), (7, {1, 7, 3, 4, 5, 8, 10}), (99, set(STREAM))):
        assert set(values(exact.heavy_hitters(truth, k))) == want
    a, b = exact.between(r, 0, 16), exact.between(r, 16, 32)
    want = {1: 1, 2: 0, 3: 2, 4: 0, 5: 3, 6: 0, 7: 5, 8: 1, 9: 1, 10: 1}
    joined = exact.differences(exact.ground_truth(a, ["key"]), exact.ground_truth(b, ["key"]), ["key"])
    assert values(joined) == values(exact.record_differences(a, b, ["key"])) == want
    assert values(exact.heavy_changers(joined, ["key"], 3)) == {3: 2, 5: 3, 7: 5}
    assert set(values(exact.heavy_changers(joined, ["key"], 7))) == {1, 3, 5, 7, 8, 9, 10}
    for t in range(15):
        assert exact.heavy_changers(joined, ["key"], t / 14, "percentile").count() == sum(v > int(t / 14 * 14) for v in want.values())


def test_caps_and_samples(spark):
    r = records(spark, STREAM)
    seen = [x["key"] for x in exact.flow_cap(r, ["key"], 4).orderBy("seq").collect()]
    assert seen == STREAM[:3] and len(set(seen)) == 3
    assert exact.flow_cap(r, ["key"], -1).count() == exact.flow_cap(r, ["key"], 11).count() == 32
    assert exact.packet_cap(r, 5).count() == 5 and exact.packet_cap(r, -1).count() == 32
    assert exact.prefix(r, 0.3).count() == 9
    for bad in (0, -1, 1.5):
        with pytest.raises(ValueError):
            exact.prefix(r, bad)


def test_upsert_and_spurious(spark):
    one = spark.createDataFrame([(1, 100), (2, 0)], "key long, est long")
    two = spark.createDataFrame([(2, 3), (3, 2022)], "key long, est long")
    assert values(exact.upsert(one, two, ["key"]), "est") == {1: 100, 2: 3, 3: 2022}
    flags = exact.flag_spurious(spark.createDataFrame([(0, 1, 0), (1, 1, 1500), (2, 1, 1501), (3, 1, None)], "seq long, key long, length long"))
    assert [x["spurious"] for x in flags.orderBy("seq").collect()] == [True, False, True, False]


def test_random_streams_by_counting(spark):
    r = random.Random(3)
    keys = [r.randrange(40) for _ in range(500)]
    truth = values(exact.ground_truth(records(spark, keys), ["key"]))
    assert truth == {k: keys.count(k) for k in set(keys)}


def test_odd_values(spark):
    """Keys with quotes and of bytes; null keys and weights; unknown methods; overflow."""
    t = spark.createDataFrame([("it's", b"\x01\x02", 5), ("x", b"\x00", 300)], "name string, raw binary, value long")
    assert exact.value_of(t, {"name": "it's"}) == 5 and exact.value_of(t, {"raw": b"\x00", "name": "x"}) == 300
    with pytest.raises(KeyError):
        exact.value_of(t, {"name": "' or 1=1 --"})
    assert [r["overflow"] for r in exact.flag_overflow(t, 9).orderBy("value").collect()] == [False, True]
    a = spark.createDataFrame([(0, 1, 5), (1, None, 7), (2, 2, None), (3, 3, None), (4, 3, 2)], "seq long, key long, length long")
    b = a.where("key = 1 or key is null")
    both = exact.differences(exact.ground_truth(a, ["key"], "length"), exact.ground_truth(b, ["key"], "length"), ["key"])
    assert values(exact.record_differences(a, b, ["key"], "length")) == values(both) == {1: 0, 3: 2}
    truth = exact.ground_truth(records(spark, STREAM), ["key"])
    assert values(exact.heavy_hitters(truth, 2, "Nonsense")) == values(exact.heavy_hitters(truth, 2)) and values(exact.heavy_hitters(truth, 0.1, "Percentile")) == values(exact.heavy_hitters(truth, 0.1, "percentile"))
    one, two = exact.halves(records(spark, STREAM))
    assert one.count() == two.count() == 16 and exact.prefix(one.where("false"), 0.5).count() == 0
