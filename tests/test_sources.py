"""Configuration, binary records, captures, streaming, command line, queries."""

import random
import struct

import pytest
from conftest import SF, same_rows
from pyspark.sql import functions as F
from rillflow.operators import exact
from rillflow.operators.linear import CountMin
from rillflow.operators.ordered import CuState
from rillflow.plans import registry
from rillflow.plans.evaluation import evaluate
from rillflow.sources import formats, pcap
from rillflow.sources.config import Config
from rillflow.sources.formats import RecordFormat
from test_core import records, values


def test_config(tmp_path):
    good = tmp_path / "good.toml"
    good.write_text('a = 1\nf = 2.5\ns = "x"\nb = true\nl = [1, 2]\n[Section.Sub]\nn = 7\nd = [1, 2.5]\nw = ["p", "q"]\n')
    c = Config(str(good))
    assert c.succeed and c.get("a", int) == 1 and c.get("a", float) == 1.0 and c.get("f", int) is None and c.get("b", bool) is True and c.get("b", int) is None
    sub = c.at(".Section..Sub.")
    assert sub.get("n", int) == 7 and sub.get("d", list[float]) == [1.0, 2.5] and sub.get("d", list[int]) is None and sub.get("w", list[str]) == ["p", "q"]
    assert c.at("Section.None").get("n", int, False) is None and sub.at("").get("s", str) == "x" and c.get("l", list) == [1, 2]
    bad = tmp_path / "bad.toml"
    bad.write_text("dangle = abcd\n")
    assert not Config(str(bad)).succeed and not Config(str(tmp_path / "none.toml")).succeed


def test_formats():
    f = RecordFormat.parse([["flowkey", "length", "padding", "timestamp", "padding"], [8, 4, 1, 2, 1]])
    assert f.width == 16
    raw = f.encode([b"abcdefgh", b"ABCDEFGH"], [65535, 1], [2**32 - 1, 3])
    got = f.decode(raw)
    assert got["flowkey"] == [b"abcdefgh", b"ABCDEFGH"] and list(got["timestamp"]) == [65535, 1] and list(got["length"]) == [2**32 - 1, 3]
    assert raw[12] == raw[15] == 0
    for names, sizes in ((["length", "padding"], [2, 2]), (["length", "flowkey"], [2, 2]), (["length", "flowkey", "padding"], [1, 4, 0]), (["length", "flowkey", "flowkey"], [2, 4, 4]), (["flowkey", "length"], [4, 3]), (["flowkey", "colour"], [4, 1]), (["flowkey"], [4, 1])):
        with pytest.raises(ValueError):
            RecordFormat.parse([names, sizes])
    with pytest.raises(ValueError):
        f.decode(raw[:-1])
    with pytest.raises(ValueError):
        f.encode([b"short"])


def test_binary_round_trip(spark, tmp_path):
    f = RecordFormat.parse([["flowkey", "padding", "timestamp", "length", "padding"], [13, 3, 8, 2, 6]])
    rows = [(i, bytearray(bytes([i]) * 13), i * 7, i + 1) for i in range(50)]
    df = spark.createDataFrame(rows, "seq long, flowkey binary, us long, length long").withColumn("timestamp", F.timestamp_micros("us"))
    path = str(tmp_path / "records.bin")
    assert formats.write_records(df, path, f) == 50
    back = formats.read_records(spark, path, f, 13).orderBy("seq").collect()
    assert [(bytes(r["flowkey"]), r["length"]) for r in back] == [(bytes(k), n) for _, k, _, n in rows]
    assert [r["seq"] for r in back] == list(range(50))
    with pytest.raises(ValueError):
        formats.read_records(spark, path, f, 8)
    (tmp_path / "cut.bin").write_bytes(b"x" * 33)
    with pytest.raises(Exception, match="multiple"):
        formats.read_records(spark, str(tmp_path / "cut.bin"), f).count()
    short = RecordFormat.parse([["flowkey", "padding"], [4, 1]])
    (tmp_path / "short.bin").write_bytes(b"abcd\0" * 3)
    assert formats.read_records(spark, str(tmp_path / "short.bin"), short).where("length is null and timestamp is null").count() == 3
    formats.write(df.drop("us"), str(tmp_path / "txt"), "txt")
    assert spark.read.csv(str(tmp_path / "txt"), header=True).count() == 50
    formats.write(df, "", "null")


def frame(protocol, src, dst, sport=1, dport=2, total=60, kind=b"\x08\x00"):
    ip = struct.pack(">BBHHHBBHII", 0x45, 0, total, 0, 0, 64, protocol, 0, src, dst)
    return bytes(12) + kind + ip + (struct.pack(">HH", sport, dport) + bytes(16) if protocol in (6, 17) else bytes(20))


FRAMES = [frame(6, 0x0A000001, 0x0A000002, 80, 1234, 100), frame(17, 0x0A000003, 0x0A000001, 53, 53, 70), frame(1, 0x0A000001, 0x0A000009), frame(6, 1, 2, kind=b"\x86\xdd")]


def classic(order, nano=False):
    magic = 0xA1B23C4D if nano else 0xA1B2C3D4
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, 1)
    for i, f in enumerate(FRAMES):
        out += struct.pack(order + "IIII", 10 + i, 5000 if nano else 5, len(f), len(f)) + f
    return out


def pcapng():
    def block(kind, body):
        body += bytes(-len(body) % 4)
        return struct.pack("<II", kind, 12 + len(body)) + body + struct.pack("<I", 12 + len(body))

    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1) + struct.pack("<HH", 3, 5) + b"linux\0\0\0" + struct.pack("<HH", 0, 0))
    out += block(1, struct.pack("<HHI", 1, 0, 65535))
    for i, f in enumerate(FRAMES):
        t = (10 + i) * 1_000_000 + 5
        out += block(6, struct.pack("<IIIII", 0, t >> 32, t & 0xFFFFFFFF, len(f), len(f)) + f)
    return out


def snoop():
    out = b"snoop\0\0\0" + struct.pack(">II", 2, 4)
    for i, f in enumerate(FRAMES):
        pad = -len(f) % 4
        out += struct.pack(">IIIIII", len(f), len(f), 24 + len(f) + pad, 0, 10 + i, 5) + f + bytes(pad)
    return out


@pytest.mark.parametrize("data", [classic("<"), classic(">"), classic("<", True), pcapng(), snoop()], ids=["little", "big", "nano", "pcapng", "snoop"])
def test_captures(spark, tmp_path, data):
    path = tmp_path / "a.cap"
    path.write_bytes(data)
    rows = pcap.read_capture(spark, str(path)).orderBy("seq").collect()
    assert [(r["src_ip"], r["dst_ip"], r["src_port"], r["dst_port"], r["protocol"], r["length"]) for r in rows] == [(0x0A000001, 0x0A000002, 80, 1234, 6, 100), (0x0A000003, 0x0A000001, 53, 53, 17, 70)]
    assert rows[0]["timestamp"].timestamp() == pytest.approx(10.000005) and [r["seq"] for r in rows] == [0, 1]
    pairs = pcap.read_capture(spark, str(path), 8)
    assert pairs.count() == 3 and pairs.where("protocol = 1 and src_port = 0").count() == 1
    for text, n in (("ip && (tcp || udp)", 2), ("udp port 53", 1), ("not tcp", 2), ("src host 10.0.0.1", 2), ("net 10.0.0.0/30 and tcp", 1), ("icmp or dst port 1234", 2), ("greater 71", 1), ("proto 17", 1)):
        assert pairs.where(pcap.packet_filter(text)).count() == n, text
    s = pcap.capture_summaries(spark, str(path)).first()
    assert s["size"] == len(data) and s["link_type"] == 1 and (s["format"] != "pcapng" or s["os"] == "linux")
    for bad in ("tcp and", "port x", "(tcp", "vlan 7"):
        with pytest.raises(ValueError):
            pcap.packet_filter(bad)


def test_capture_rejects_others():
    with pytest.raises(ValueError):
        list(pcap.packets(b"nothing of the kind"))
    assert len(list(pcap.packets(classic("<")[:-3]))) == 3


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got.count() > 0
    else:
        assert same_rows(got.toPandas(), duck.execute(sql).df())


def test_evaluation(spark, tmp_path):
    f = RecordFormat.parse([["flowkey", "length"], [4, 2]])
    keys = [(i * i % 23).to_bytes(4, "little") for i in range(200)]
    (tmp_path / "r.bin").write_bytes(f.encode(keys, None, [10] * 200))
    conf = tmp_path / "c.toml"
    sections = {"CM": "depth = 3\nwidth = 50", "HP": "depth = 3\nwidth = 50", "BF": "bits = 500\ncount = 3", "FR": "filter_bits = 9000\nfilter_hashes = 3\ntable = 100\ntable_hashes = 3"}
    text = ""
    for s, p in sections.items():
        text += f'[{s}.para]\n{p}\n[{s}.data]\ndata = "{tmp_path}/r.bin"\ncnt_method = "InPacket"\nthreshold_heavy_hitter = 5\nformat = [["flowkey", "length"], [4, 2]]\n'
        text += f'[{s}.test]\nquery = ["ARE", "AAE", "PODF", "DIST", "ODD"]\nquery_dist = [0.1]\nupdate = ["RATE"]\nheavyhitter = ["TIME", "PRC", "RCL"]\nlookup = ["TP", "FN"]\ndecode = ["RATIO", "ACC"]\n'
    conf.write_text(text)
    cm = evaluate(spark, str(conf), "CM", "count_min")
    assert set(cm["query"]) == {"ARE", "AAE", "DIST"} and sum(s for _, s in cm["query"]["DIST"]) == pytest.approx(1)
    hp = evaluate(spark, str(conf), "HP", "hashpipe")
    assert hp["heavyhitter"]["RCL"] == 1.0 and hp["heavyhitter"]["TIME"] > 0 and cm["update"]["RATE"] > 0
    assert evaluate(spark, str(conf), "BF", "bloom")["lookup"]["FN"] == 0
    assert evaluate(spark, str(conf), "FR", "flowradar")["decode"] == {"RATIO": 1.0, "ACC": 1.0}
    with pytest.raises(ValueError):
        evaluate(spark, str(conf), "XX", "count_min")


#: The sections, parameters and metrics that the format's users have (fixed names), at a smaller size.
CONFIG = """
[BF.para]
num_bits = 2577
num_hash = 5
[BF.test]
sample = 0.3
insert = ["RATE"]
lookup = ["RATE", "PRC"]
[CM.para]
depth = 5
width = 801
[CM.test]
update = ["RATE"]
query = ["RATE", "ARE", "AAE"]
[CM.ch]
cnt_no_ratio = 0.3
width_cnt = [10, 7]
no_hash = [3]
[HP.para]
depth = 5
width = 101
[HP.test]
update = ["RATE"]
heavyhitter = ["TIME", "ARE", "PRC", "RCL"]
heavychanger = ["PRC", "RCL", "F1"]
[FlowRadar.para]
flow_filter_bit = 10000
flow_filter_hash = 10
count_table_num = 500
count_table_hash = 5
[FlowRadar.test]
update = ["RATE"]
decode = ["TIME", "ARE", "AAE", "RATIO", "ACC", "PODF", "DIST"]
decode_podf = 0.01
decode_dist = [0.0, 0.5]
[CBF.para]
num_cnt = 2000
num_hash = 3
cnt_length = 4
[CBF.test]
sample = 0.3
insert = ["RATE"]
lookup = ["RATE", "PRC"]
"""


def test_whole_configuration(spark, tmp_path):
    """Every section over 13-byte keys, the hierarchy, a sketch of one's own, and the two ways to choose hitters."""
    from rillflow.operators import sketch

    r = random.Random(3)
    keys = [r.randbytes(13) for _ in range(90)]
    fmt = RecordFormat.parse([["flowkey", "padding", "timestamp", "length", "padding"], [13, 3, 8, 2, 6]])
    order = [min(int(r.paretovariate(0.5)) - 1, 89) for _ in range(2000)]
    (tmp_path / "records.bin").write_bytes(fmt.encode([keys[i] for i in order], list(range(2000)), [40 + i for i in order]))
    data = f'data = "{tmp_path}/records.bin"\nformat = [["flowkey", "padding", "timestamp", "length", "padding"], [13, 3, 8, 2, 6]]\n'
    text = CONFIG + "".join(f"[{s}.data]\n{data}" for s in ("BF", "FlowRadar", "CBF")) + f'[CM.data]\n{data}cnt_method = "InPacket"\n'
    conf = tmp_path / "c.toml"

    def run(section, name, hitters='hx_method = "TopK"\nthreshold_heavy_hitter = 10\nthreshold_heavy_changer = 5\ncnt_method = "InPacket"\n'):
        conf.write_text(f"{text}[HP.data]\n{data}{hitters}")
        return evaluate(spark, str(conf), section, name)

    flows = len(set(order))
    for section, name in (("BF", "bloom"), ("CBF", "counting_bloom")):
        got = run(section, name)
        assert set(got["lookup"]) == {"RATE", "PRC"} and got["insert"]["RATE"] > 0 and got["lookup"]["PRC"] > 0.5
    plain, ch = run("CM", "count_min"), run("CM", "hierarchy_count_min")
    assert set(plain["query"]) == {"RATE", "ARE", "AAE"} == set(ch["query"])
    assert {k: plain["query"][k] for k in ("ARE", "AAE")} == {k: ch["query"][k] for k in ("ARE", "AAE")} and ch["size"]["SIZE"] < plain["size"]["SIZE"]
    for name in ("conservative_update", "count_sketch"):
        assert set(run("CM", name)["query"]) == {"RATE", "ARE", "AAE"}
    top = run("HP", "hashpipe")
    assert top["heavyhitter"]["RCL"] == top["heavyhitter"]["PRC"] == 1.0 and top["heavyhitter"]["ARE"] == 0.0 and top["heavychanger"]["RCL"] == 1.0
    share = run("HP", "hashpipe", 'hx_method = "Percentile"\nthreshold_heavy_hitter = 0.01\nthreshold_heavy_changer = 0.05\ncnt_method = "InLength"\n')
    assert share["heavyhitter"]["RCL"] == share["heavyhitter"]["PRC"] == 1.0 == share["heavychanger"]["F1"]
    with pytest.raises(ValueError, match="threshold_heavy_hitter"):
        run("HP", "hashpipe", "")
    radar = run("FlowRadar", "flowradar")["decode"]
    assert radar["RATIO"] == radar["ACC"] == radar["PODF"] == 1.0 and radar["ARE"] == 0.0 and radar["DIST"] == [(0.0, 1.0), (0.5, 0.0), (float("inf"), 0.0)]

    @sketch.register("exact_counts", {"width": "most"})
    class Counts(sketch.Sketch):
        """A sketch of one's own that forgets nothing."""

        takes = "flows"

        def __init__(self, depth, most):
            self.size = most

        def build(self, flows):
            return flows.select("key", "value")

        def query(self, state, keys, key="key"):
            return keys.join(state.withColumnRenamed("value", "est"), "key")

        def changers(self, state, other, threshold):
            return exact.differences(state, other, ["key"]).withColumnRenamed("value", "est").where(F.col("est") >= threshold)

    own = run("CM", "exact_counts")
    assert own["size"] == {"SIZE": 801} and own["query"]["ARE"] == own["query"]["AAE"] == 0.0
    changes = run("HP", "exact_counts")
    assert changes["heavychanger"]["RCL"] == 1.0 and changes["heavyhitter"]["RCL"] == 0.0 and flows > 20


def test_record_files(spark, tmp_path, monkeypatch):
    """Files of several partitions, read in ranges of few records, or whole where workers can't open them."""
    fmt = RecordFormat.parse([["flowkey", "length"], [4, 2]])
    rows = [(i, bytearray(i.to_bytes(4, "little")), i % 500) for i in range(1000)]
    df = spark.createDataFrame(rows, "seq long, flowkey binary, length long").repartition(3)
    folder = str(tmp_path / "files")
    assert formats.write_record_files(df, folder, fmt) == 1000
    monkeypatch.setattr(formats, "RANGE", 60)
    for reach in (True, False):
        monkeypatch.setattr(formats, "reachable", lambda path, reach=reach: reach)
        back = formats.read_records(spark, folder, fmt).orderBy("seq").collect()
        assert [(r["seq"], bytes(r["flowkey"]), r["length"]) for r in back] == [(s, bytes(k), n) for s, k, n in rows]
    assert formats.write_record_files(df.where("false"), str(tmp_path / "none"), fmt) == 0


def test_streaming_equals_batch(spark, tmp_path):
    from rillflow.streaming.windows import stream_fold, windowed_cells, windowed_truth

    rows = [(i, i % 7, 1 + i % 3, i * 60_000_000) for i in range(240)]
    df = spark.createDataFrame(rows, "seq long, key long, length long, us long").select("seq", "key", "length", F.timestamp_micros("us").alias("timestamp"))
    path = str(tmp_path / "in")
    df.repartition(1).write.parquet(path)
    src = spark.readStream.schema(df.schema).parquet(path)
    s = CountMin(2, 10)

    def drained(stream, name, mode="complete"):
        q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    truth = drained(windowed_truth(src, ["key"], "1 hour", "10 minutes", "length"), "w_truth")
    batch = df.groupBy(F.window("timestamp", "1 hour").start.alias("start"), "key").agg(F.sum("length").alias("value"))
    assert same_rows(truth.toPandas(), batch.toPandas())
    cells = drained(windowed_cells(src, s, "1 hour", "10 minutes"), "w_cells")
    total = cells.groupBy("r", "c").agg(F.sum("v").alias("v"))
    assert same_rows(total.toPandas(), s.build(exact.ground_truth(df, ["key"])).toPandas())
    from rillflow.streaming.windows import windowed_changers

    signed = CountMin(3, 50, signed=True)
    parts = drained(windowed_cells(src, signed, "1 hour", "10 minutes"), "w_signed")
    changes = windowed_changers(parts, signed, df.select("key").distinct(), "1970-01-01 00:00:00", "1970-01-01 01:00:00")
    halves = [exact.ground_truth(exact.between(df, 60 * i, 60 * i + 60), ["key"]) for i in (0, 1)]
    assert values(changes, "est") == values(exact.differences(*halves, ["key"]))
    h = s.hashes
    folded = drained(stream_fold(src.withColumn("value", F.lit(1).cast("long")), ["key", "value"], 1, lambda: CuState(h, 11), "r long, c long, v long"), "w_cu", "update")
    alone = CuState(h, 11)
    for r in rows:
        alone.step(r[1], 1)
    assert {(x["r"], x["c"], x["v"]) for x in folded.collect()} == set(alone.rows())


def test_cli(spark, capsys, tmp_path):
    from rillflow.cli import main

    fmt = RecordFormat.parse([["flowkey", "length"], [4, 2]])
    (tmp_path / "r.bin").write_bytes(fmt.encode([(i % 9).to_bytes(4, "little") for i in range(90)], None, [10] * 90))
    (tmp_path / "c.toml").write_text(f'[CM.para]\ndepth = 2\nwidth = 500\n[CM.data]\ndata = "{tmp_path}/r.bin"\ncnt_method = "InPacket"\nformat = [["flowkey", "length"], [4, 2]]\n[CM.test]\nquery = ["ARE", "ACC"]\n')
    assert main(["-c", str(tmp_path / "c.toml"), "-s", "CM", "count_min"]) == 0
    out = capsys.readouterr().out
    assert "size" in out and "ARE: 0" in out and "ACC: 1" in out
    assert main(["-q", "flow_totals", "-d", SF]) == 0 and "flows" in capsys.readouterr().out
    assert main(["--list"]) == 0 and "count_min" in capsys.readouterr().out


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_values_helper(spark):
    assert values(exact.ground_truth(records(spark, [1, 1]), ["key"])) == {1: 2}
