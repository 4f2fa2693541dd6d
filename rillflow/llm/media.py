"""Media columns: the Ogg container.

``mux`` writes packets of logical streams into pages (lacing values, granule
positions, page checksums); ``demux`` verifies every page's checksum,
reassembles packets from lacing values across pages, separates the logical
streams and derives timestamps from granule positions.  ``ogg_info`` applies
``demux`` to a binary column; ``store_texts`` stores texts as 8-bit audio and
reads them back.

Defined results: a null medium gives a null row of figures; bytes that are no
Ogg give status 'no pages'; a page with a wrong checksum is skipped, counted,
and the packet that it cut is dropped and counted.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts_of

#: Fixed values of the container: capture pattern, header flags, fixed header length.
CAPTURE, CONTINUED, FIRST, LAST, HEADER = b"OggS", 1, 2, 4, 27
#: Sample rate, samples a packet, and bytes of one channel in a block of 192 payload bytes.
RATE, PACKET, HALF = 8000, 960, 96
#: Header packet of our 8-bit mono mapping: magic, version, bits, channels, rate.
MAGIC = b"\x80pcm8\0"

_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_checksum(page: bytes) -> int:
    """CRC with polynomial 0x04c11db7, most significant bit first, no inversion.

    zlib's CRC is the same polynomial with bits reversed, so reversing the bits
    of the input and of the result gives it at C speed.
    """
    crc = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(serial: int, sequence: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = CAPTURE + struct.pack("<BBqIII", 0, flags, granule, serial, sequence, 0) + bytes([len(lacing)]) + lacing
    crc = page_checksum(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def mux(streams: dict[int, list[tuple[bytes, int]]]) -> bytes:
    """Pages of the streams (serial -> packets with their end granules), interleaved; the first packet of each is alone on its first page."""
    queues: dict[int, list[bytes]] = {}
    for serial, packets in streams.items():
        pages: list[bytes] = []
        lacing, body, granule, continued, first = bytearray(), bytearray(), -1, 0, True

        def flush(last: bool) -> None:
            nonlocal lacing, body, granule, continued, first
            flags = continued | (FIRST if first else 0) | (LAST if last else 0)
            pages.append(_page(serial, len(pages), flags, granule, bytes(lacing), bytes(body)))  # noqa: B023
            continued = CONTINUED if lacing and lacing[-1] == 255 else 0
            lacing, body, granule, first = bytearray(), bytearray(), -1, False

        for k, (packet, end) in enumerate(packets):
            left, at = len(packet), 0
            while True:
                if len(lacing) == 255:
                    flush(False)
                n = min(255, left)
                lacing.append(n)
                body += packet[at : at + n]
                at += n
                left -= n
                if n < 255:
                    break
            granule = end
            last = k == len(packets) - 1
            if k == 0 or last:
                flush(last)
        queues[serial] = pages
    out, depth = [], max(map(len, queues.values()), default=0)
    for i in range(depth):
        out += [pages[i] for pages in queues.values() if i < len(pages)]
    return b"".join(out)


@dataclass
class Stream:
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    dropped: int = 0
    _open: list[bytes] | None = None
    _next: int = 0

    def seconds(self, rate: int) -> float:
        """Time of the last finished packet."""
        return (self.granules[-1] / rate) if self.granules else 0.0


@dataclass
class Container:
    streams: dict[int, Stream] = field(default_factory=dict)
    bad_pages: int = 0
    skipped_bytes: int = 0

    @property
    def status(self) -> str:
        if not self.streams:
            return "no pages"
        return "damaged" if self.bad_pages or self.skipped_bytes or any(s.dropped for s in self.streams.values()) else "ok"


def demux(data: bytes) -> Container:
    """All logical streams of a medium; see the module for what happens to damage."""
    out, at, end = Container(), 0, len(data)
    while at < end:
        if data[at : at + 4] != CAPTURE:
            nxt = data.find(CAPTURE, at + 1)
            nxt = end if nxt < 0 else nxt
            out.skipped_bytes += nxt - at
            at = nxt
            continue
        if at + HEADER > end:
            out.bad_pages += 1
            break
        flags, granule, serial, sequence, crc, n = struct.unpack_from("<BqIIIB", data, at + 5)
        lacing = data[at + HEADER : at + HEADER + n]
        start = at + HEADER + n
        stop = start + sum(lacing)
        page = data[at:stop]
        if stop > end or len(lacing) < n or page_checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            out.bad_pages += 1
            at += 4
            nxt = data.find(CAPTURE, at)
            at = end if nxt < 0 else nxt
            continue
        s = out.streams.setdefault(serial, Stream())
        lost = sequence != s._next
        if (lost or not flags & CONTINUED) and s._open is not None:
            s._open, s.dropped = None, s.dropped + 1
        skip = bool(flags & CONTINUED) and s._open is None
        s.pages, s._next, pos = s.pages + 1, sequence + 1, start
        finished, run = 0, 0
        for k, x in enumerate(lacing):
            run += x
            if x < 255:
                piece = data[pos : pos + run]
                pos, run = pos + run, 0
                if skip:
                    skip, s.dropped = False, s.dropped + 1
                    continue
                if s._open is not None:
                    piece, s._open = b"".join([*s._open, piece]), None
                s.packets.append(piece)
                finished += 1
            elif k == n - 1 and not skip:
                s._open = [*(s._open or []), data[pos : pos + run]]
        if finished and granule >= 0:
            s.granules.append(granule)
        s.ended |= bool(flags & LAST)
        at = stop
    for s in out.streams.values():
        if s._open is not None:
            s._open, s.dropped = None, s.dropped + 1
    return out


def store(payload: bytes) -> bytes:
    """A payload (length a multiple of 192) as 8-bit audio: two mono streams, each with one half of every block."""
    block = np.frombuffer(payload, np.uint8).reshape(-1, 2, HALF)
    streams = {}
    for channel in (0, 1):
        data = block[:, channel].tobytes()
        head = MAGIC + struct.pack("<BBBI", 1, 8, 1, RATE)
        streams[channel + 1] = [(head, 0)] + [(data[i : i + PACKET], min(i + PACKET, len(data))) for i in range(0, len(data), PACKET)]
    return mux(streams)


def load(medium: bytes) -> tuple[bytes, Container]:
    """What ``store`` stored, from the stored bytes alone."""
    c = demux(medium)
    halves = []
    for serial in (1, 2):
        head, *packets = c.streams[serial].packets
        if not head.startswith(MAGIC):
            raise ValueError("not a stream of this mapping")
        halves.append(np.frombuffer(b"".join(packets), np.uint8).reshape(-1, 1, HALF))
    return np.concatenate(halves, axis=1).tobytes(), c


def features(payload: bytes, c: Container) -> str:
    """Figures of the samples (centred at 128) and of the container, all exact integers."""
    x = np.frombuffer(payload, np.uint8).astype(np.int16) - 128
    power = int((x.astype(np.int64) ** 2).sum())
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    micros = max(s.granules[-1] * 1_000_000 // RATE for s in c.streams.values())
    return (
        f"streams={len(c.streams)};pages={sum(s.pages for s in c.streams.values())};packets={sum(len(s.packets) - 1 for s in c.streams.values())};"
        f"micros={micros};sum={int(x.sum())};power={power};peak={int(np.abs(x).max())};crossings={crossings};status={c.status}"
    )


STORED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _store_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for batch in batches:
        cols: list[list] = [[] for _ in range(7)]
        for text in texts_of(batch):
            raw = text.encode()
            size = max(192, -(-len(raw) // 192) * 192)
            medium = store(raw.ljust(size, b" "))
            back, c = load(medium)
            row = (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(medium), hashlib.sha256(medium).hexdigest(), features(back, c))
            for col, v in zip(cols, row, strict=True):
                col.append(v)
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each whole text stored as Ogg, read back and described; null text counts as empty (192 spaces)."""
    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), _store_kernel, STORED)


INFO = "id long, status string, streams int, pages long, packets long, dropped long, bad_pages long, granules array<long>"


def _info_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if m is None:
                rows.append(dict.fromkeys(("status", "streams", "pages", "packets", "dropped", "bad_pages", "granules")) | {"id": i})
                continue
            c = demux(m)
            s = list(c.streams.values())
            rows.append({"id": i, "status": c.status, "streams": len(s), "pages": sum(x.pages for x in s), "packets": sum(len(x.packets) for x in s), "dropped": sum(x.dropped for x in s), "bad_pages": c.bad_pages, "granules": [x.granules[-1] if x.granules else 0 for x in s]})
        schema = pa.schema([("id", pa.int64()), ("status", pa.string()), ("streams", pa.int32()), ("pages", pa.int64()), ("packets", pa.int64()), ("dropped", pa.int64()), ("bad_pages", pa.int64()), ("granules", pa.list_(pa.int64()))])
        yield pa.RecordBatch.from_pylist(rows, schema)


def ogg_info(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """Figures of a column of Ogg media, one row each."""
    return map_batches(media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("medium")), _info_kernel, INFO)
