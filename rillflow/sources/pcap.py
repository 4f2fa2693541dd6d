"""Packet captures: pcap, pcapng and snoop files to records; filters and caps.

A record is an IPv4 packet: source and destination address, ports of TCP or
UDP, protocol by its assigned number (6, 17, ...), time in microseconds, length
from the IPv4 header.  Packets of other protocols keep zero ports, and are left
out where 5-tuples are asked for.  What isn't IPv4 is left out.
"""

from __future__ import annotations

import ipaddress
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .formats import opened

ETHERNET, RAW, LOOPBACK, LINUX_SLL = 1, (12, 14, 101, 228), (0, 108), 113
_SNOOP_LINKS = {4: 1}
TCP, UDP = 6, 17


def packets(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(link type, microseconds, packet) of a capture of any of the three formats; a truncated last packet is left out."""
    magic = data[:4]
    if magic in (b"\xa1\xb2\xc3\xd4", b"\xd4\xc3\xb2\xa1", b"\xa1\xb2\x3c\x4d", b"\x4d\x3c\xb2\xa1"):
        e = ">" if magic[0] == 0xA1 else "<"
        nano = b"\x3c" in magic
        link = struct.unpack_from(e + "I", data, 20)[0] & 0xFFFF
        at = 24
        while at + 16 <= len(data):
            sec, sub, have, _ = struct.unpack_from(e + "IIII", data, at)
            at += 16
            if at + have > len(data):
                return
            yield link, sec * 1_000_000 + (sub // 1000 if nano else sub), data[at : at + have]
            at += have
    elif data[:8] == b"snoop\0\0\0":
        link = _SNOOP_LINKS.get(struct.unpack_from(">I", data, 12)[0], 1)
        at = 16
        while at + 24 <= len(data):
            _, have, size, _, sec, micro = struct.unpack_from(">IIIIII", data, at)
            if at + 24 + have > len(data) or size < 24:
                return
            yield link, sec * 1_000_000 + micro, data[at + 24 : at + 24 + have]
            at += size
    elif magic == b"\x0a\x0d\x0d\x0a":
        e, links, units, at = "<", [], [], 0
        while at + 12 <= len(data):
            kind = struct.unpack_from(e + "I", data, at)[0]
            if kind == 0x0A0D0D0A:
                e = "<" if data[at + 8 : at + 12] == b"\x4d\x3c\x2b\x1a" else ">"
                links, units = [], []
            size = struct.unpack_from(e + "I", data, at + 4)[0]
            if size < 12 or at + size > len(data):
                return
            body = data[at + 8 : at + size - 4]
            if kind == 1:
                links.append(struct.unpack_from(e + "H", body)[0])
                units.append(_resolution(body[8:], e))
            elif kind == 6:
                i, high, low, have, _ = struct.unpack_from(e + "IIIII", body)
                yield links[i], (high << 32 | low) * 1_000_000 // units[i], body[20 : 20 + have]
            elif kind == 3:
                yield links[0], 0, body[4 : 4 + struct.unpack_from(e + "I", body)[0]]
            at += size
    else:
        raise ValueError("no capture file")


def _options(body: bytes, e: str) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + 4 <= len(body):
        code, size = struct.unpack_from(e + "HH", body, at)
        if not code:
            return
        yield code, body[at + 4 : at + 4 + size]
        at += 4 + -(-size // 4) * 4


def _resolution(options: bytes, e: str) -> int:
    for code, v in _options(options, e):
        if code == 9 and v:
            return 1 << (v[0] & 0x7F) if v[0] & 0x80 else 10 ** v[0]
    return 1_000_000


def summary(data: bytes) -> dict[str, str | int | None]:
    """Format, link type and size of a capture; of pcapng also hardware, system, application and comment."""
    out: dict[str, str | int | None] = dict.fromkeys(("format", "link_type", "size", "hardware", "os", "application", "comment"))
    out["size"] = len(data)
    first = next(packets(data), None)
    out["link_type"] = first[0] if first else None
    out["format"] = "snoop" if data[:5] == b"snoop" else "pcapng" if data[:4] == b"\x0a\x0d\x0d\x0a" else "pcap"
    if out["format"] == "pcapng":
        e = "<" if data[8:12] == b"\x4d\x3c\x2b\x1a" else ">"
        size = struct.unpack_from(e + "I", data, 4)[0]
        names = {1: "comment", 2: "hardware", 3: "os", 4: "application"}
        out |= {names[c]: v.decode("utf-8", "replace") for c, v in _options(data[24 : size - 4], e) if c in names}
    return out


def ipv4(link: int, raw: bytes) -> bytes | None:
    """The IPv4 packet inside a frame."""
    if link == ETHERNET:
        at = 12
        kind = raw[at : at + 2]
        while kind in (b"\x81\x00", b"\x88\xa8"):
            at += 4
            kind = raw[at : at + 2]
        raw = raw[at + 2 :] if kind == b"\x08\x00" else b""
    elif link == LINUX_SLL:
        raw = raw[16:] if raw[14:16] == b"\x08\x00" else b""
    elif link in LOOPBACK:
        raw = raw[4:] if raw[:4] in (b"\2\0\0\0", b"\0\0\0\2") else b""
    elif link not in RAW:
        return None
    return raw if len(raw) >= 20 and raw[0] >> 4 == 4 else None


def fields(packet: bytes) -> tuple[int, int, int, int, int, int]:
    """Source, destination, ports, protocol, total length; numbers as they read, most significant byte first."""
    size, protocol = struct.unpack_from(">H", packet, 2)[0], packet[9]
    src, dst = struct.unpack_from(">II", packet, 12)
    head = (packet[0] & 15) * 4
    fragment = struct.unpack_from(">H", packet, 6)[0] & 0x1FFF
    ports = struct.unpack_from(">HH", packet, head) if protocol in (TCP, UDP) and not fragment and len(packet) >= head + 4 else (0, 0)
    return src, dst, *ports, protocol, size


SCHEMA = "seq long, timestamp timestamp, src_ip long, dst_ip long, src_port int, dst_port int, protocol int, length long"


def read_capture(spark: SparkSession, path: str, key_length: int = 13) -> DataFrame:
    """Records of captures, seq in order of path and place; one task a file (up to 2 GB; longer captures are rotated by the capturing tool)."""
    files = spark.read.format("binaryFile").load(path)
    ranks = {r[0]: k for k, r in enumerate(files.select("path").orderBy("path").collect())}

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.timestamp("us", "UTC"), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        as_batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, seq = [], ranks[name] << 40
                for link, micros, raw in packets(content):
                    p = ipv4(link, raw)
                    if p is None:
                        continue
                    *own, protocol, size = fields(p)
                    if key_length == 13 and protocol not in (TCP, UDP):
                        continue
                    rows.append((seq, micros, *own, protocol, size))
                    seq += 1
                    if len(rows) == 1 << 16:
                        yield as_batch(rows)
                        rows = []
                if rows:
                    yield as_batch(rows)

    return files.select("path", "content").mapInArrow(kernel, SCHEMA)


def capture_summaries(spark: SparkSession, path: str) -> DataFrame:
    """One row a file."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"path": p} | summary(c) for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            names = [("path", pa.string()), ("format", pa.string()), ("link_type", pa.int32()), ("size", pa.int64()), ("hardware", pa.string()), ("os", pa.string()), ("application", pa.string()), ("comment", pa.string())]
            yield pa.RecordBatch.from_pylist(rows, pa.schema(names))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(kernel, "path string, format string, link_type int, size long, hardware string, os string, application string, comment string")


def write_captures(records: DataFrame, folder: str) -> int:
    """Records (columns of SCHEMA) as classic captures of headers only, one file a partition in seq order, written by the tasks.  Returns the number of packets."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, parts = 0, [struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, RAW[2])]
        task = TaskContext.get()
        system, place = opened(folder)
        system.create_dir(place, recursive=True)
        name, draft = f"{place}/part-{task.partitionId():06d}.pcap", f"{place}/_part-{task.partitionId():06d}-{task.taskAttemptId()}"
        with system.open_output_stream(draft) as f:
            for batch in batches:
                for micros, src, dst, sport, dport, protocol, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    ports = struct.pack(">HH", sport, dport) if protocol in (TCP, UDP) else b""
                    packet = struct.pack(">BBHHHBBHII", 0x45, 0, length, 0, 0, 64, protocol, 0, src, dst) + ports
                    parts.append(struct.pack("<IIII", *divmod(micros, 1_000_000), len(packet), length) + packet)
                    n += 1
                f.write(b"".join(parts))
                parts = []
            f.write(b"".join(parts))
        system.move(draft, name)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    rows = records.repartitionByRange("seq").sortWithinPartitions("seq").select(F.unix_micros("timestamp").alias("us"), "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "length")
    return rows.mapInArrow(kernel, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


_TOKEN = re.compile(r"\s*(\(|\)|&&|\|\||!|[^\s()!&|]+)")


def packet_filter(text: str) -> Column:
    """A condition from a filter: ip, tcp, udp, icmp, proto N, [src|dst] host A, [src|dst] net A/N, [src|dst] port N, less N, greater N, with and, or, not, &&, ||, ! and parentheses.

    ``or`` and ``and`` have equal precedence and associate to the left, as in capture filters.  Anything else raises ValueError.
    """
    tokens, at = _TOKEN.findall(text), 0
    if "".join(tokens) != re.sub(r"\s+", "", text):
        raise ValueError(f"can't read the filter {text!r}")
    names = {"tcp": TCP, "udp": UDP, "icmp": 1, "igmp": 2}

    def take(what: str | None = None) -> str:
        nonlocal at
        if at >= len(tokens) or what not in (None, tokens[at]):
            raise ValueError(f"can't read the filter {text!r}")
        at += 1
        return tokens[at - 1]

    def ends(side: str, one: str, test) -> Column:
        cols = [F.col(f"{d}_{one}") for d in ("src", "dst") if side in ("", d)]
        return test(cols[0]) if len(cols) == 1 else test(cols[0]) | test(cols[1])

    def number(limit: int) -> int:
        t = take()
        if not t.isdigit() or int(t) > limit:
            raise ValueError(f"no number in the filter {text!r}")
        return int(t)

    def primary() -> Column:
        t = take()
        if t in ("not", "!"):
            return ~primary()
        if t == "(":
            c = expression()
            take(")")
            return c
        if t == "ip":
            return F.lit(True)
        if t in names:
            c = F.col("protocol") == names[t]
            return c & primary() if t in ("tcp", "udp") and at < len(tokens) and tokens[at] in ("port", "src", "dst") else c
        if t == "proto":
            return F.col("protocol") == (names[take()] if tokens[at : at + 1] and tokens[at] in names else number(255))
        side = t if t in ("src", "dst") else ""
        t = take() if side else t
        if t == "host":
            a = int(ipaddress.IPv4Address(take()))
            return ends(side, "ip", lambda c: c == a)
        if t == "net":
            n = ipaddress.IPv4Network(take(), strict=False)
            return ends(side, "ip", lambda c: c.between(int(n.network_address), int(n.broadcast_address)))
        if t == "port":
            p = number(65535)
            return F.col("protocol").isin(TCP, UDP) & ends(side, "port", lambda c: c == p)
        if t in ("less", "greater") and not side:
            n = number(1 << 31)
            return F.col("length") <= n if t == "less" else F.col("length") >= n
        raise ValueError(f"can't read {t!r} in the filter {text!r}")

    def expression() -> Column:
        c = primary()
        while at < len(tokens) and tokens[at] in ("and", "or", "&&", "||"):
            c = c & primary() if take() in ("and", "&&") else c | primary()
        return c

    out = expression()
    if at != len(tokens):
        raise ValueError(f"can't read the filter {text!r}")
    return out
