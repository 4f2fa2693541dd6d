"""Packing documents' tokens into windows: bounded-space online best fit.

Each partition is read once, in order, with a fixed number of open windows
(``OPEN``).  A document (its ids, then the id 1) is cut into whole windows as
long as it exceeds one; the rest goes to the open window with the least room
that holds it.  If none does and ``OPEN`` are open, the fullest is topped up
with the head of the rest, which fills it exactly, and emitted; the remainder
is placed likewise.  So only windows that are open at a partition's end are
short.  These leftovers, with their ids, are merged for ``GROUP`` partitions at
a time: whole windows by best fit, largest first; then the smallest windows are
taken apart to fill the others.  One short window a group stays, at most.

The pieces of a document lie end to end from 0 to its length; each id is in
exactly one piece.  Null text counts as empty: a document of one id.
Memory: ``OPEN`` windows and a batch in a scan task, ``GROUP * OPEN`` windows
of 8 kB in a merge, whatever the corpus.  Windows' numbers are unique, not dense.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import library_coder
from .common import map_batches, materialize, texts_of

#: Ids a window, the id that ends a document, open windows a partition, partitions whose leftovers are merged together.
WINDOW, STOP, OPEN, GROUP = 2048, 1, 16, 64

Piece = tuple[int, int, bytes, int]  # document, start, its ids, ids of the document


@dataclass
class Open:
    pieces: list[Piece] = field(default_factory=list)
    fill: int = 0


class Packer:
    """Online packing of one partition; ``put`` gives the windows that closed."""

    def __init__(self, window: int = WINDOW, most: int = OPEN):
        self.window, self.most = window, most
        self.open: list[Open] = []

    def _add(self, w: Open, piece: Piece) -> None:
        w.pieces.append(piece)
        w.fill += len(piece[2]) // 4

    def put(self, doc: int, ids: bytes) -> Iterator[Open]:
        total, at = len(ids) // 4, 0
        while total - at > self.window:
            yield Open([(doc, at, ids[4 * at : 4 * (at + self.window)], total)], self.window)
            at += self.window
        while at < total:
            rest = total - at
            fits = [w for w in self.open if self.window - w.fill >= rest]
            if fits:
                w = max(fits, key=lambda w: w.fill)
                take = rest
            elif len(self.open) < self.most:
                w = Open()
                self.open.append(w)
                take = rest
            else:
                w = max(self.open, key=lambda w: w.fill)
                take = self.window - w.fill
            self._add(w, (doc, at, ids[4 * at : 4 * (at + take)], total))
            at += take
            if w.fill == self.window:
                self.open = [x for x in self.open if x is not w]
                yield w


def merge_leftovers(windows: list[Open], size: int = WINDOW) -> list[Open]:
    """Short windows merged: best fit by size first, then the smallest are taken apart to fill the largest."""
    packed: list[Open] = []
    rooms: list[tuple[int, int]] = []  # (room, index into packed), ascending
    for w in sorted(windows, key=lambda w: -w.fill):
        k = bisect.bisect_left(rooms, (w.fill, -1))
        if k < len(rooms):
            room, i = rooms.pop(k)
            packed[i].pieces += w.pieces
            packed[i].fill += w.fill
        else:
            i, room = len(packed), size
            packed.append(Open(list(w.pieces), w.fill))
        if size - packed[i].fill:
            bisect.insort(rooms, (size - packed[i].fill, i))
    full = [w for w in packed if w.fill == size]
    short = sorted((w for w in packed if w.fill < size), key=lambda w: -w.fill)
    lo, hi = 0, len(short) - 1
    while lo < hi:
        into, out = short[lo], short[hi]
        doc, start, ids, total = out.pieces.pop()
        n = len(ids) // 4
        take = min(n, size - into.fill)
        into.pieces.append((doc, start, ids[: 4 * take], total))
        into.fill += take
        out.fill -= take
        if take < n:
            out.pieces.append((doc, start + take, ids[4 * take :], total))
        lo += into.fill == size
        hi -= not out.pieces
    return full + [w for w in short if w.pieces]


_ROW = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [n for n, _ in _ROW]


def _rows(windows: list[tuple[int, Open]]) -> list[tuple]:
    out = []
    for number, w in windows:
        at = 0
        for doc, start, ids, total in w.pieces:
            n = len(ids) // 4
            out.append((doc, start, n, zlib.crc32(ids), total, number, at))
            at += n
    return out


def pack_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: its document, place there, checksum of its ids, window and place there."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, packer, part, n = library_coder(path), Packer(), TaskContext.get().partitionId(), 0
        stop = STOP.to_bytes(4, "little")

        def batch_of(rows: list[tuple], left: list[bytes | None], is_open: bool) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in _ROW]
            arrays = [pa.array(c, t) for c, (_, t) in zip(cols, _ROW, strict=True)]
            k = len(rows)
            return pa.RecordBatch.from_arrays([*arrays, pa.array([is_open] * k, pa.bool_()), pa.array([part] * k, pa.int64()), pa.array(left, pa.binary())], [*_NAMES, "short", "part", "ids"])

        for batch in batches:
            closed: list[tuple[int, Open]] = []
            for doc, ids in zip(batch.column(0).to_pylist(), code.encode_batch(texts_of(batch)), strict=True):
                for w in packer.put(doc, ids + stop):
                    closed.append((part << 32 | n, w))
                    n += 1
            rows = _rows(closed)
            yield batch_of(rows, [None] * len(rows), False)
        left = [(part << 32 | n + k, w) for k, w in enumerate(packer.open)]
        yield batch_of(_rows(left), [p[2] for _, w in left for p in w.pieces], True)

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["sequence_id", "offset"])
        windows: dict[int, Open] = {}
        for doc, start, total, number, ids in zip(pdf["doc_id"], pdf["start"], pdf["doc_tokens"], pdf["sequence_id"], pdf["ids"], strict=True):
            w = windows.setdefault(number, Open())
            w.pieces.append((None if pd.isna(doc) else int(doc), int(start), ids, int(total)))
            w.fill += len(ids) // 4
        numbered = [(1 << 62 | int(key[0]) << 32 | k, w) for k, w in enumerate(merge_leftovers(list(windows.values())))]
        return pd.DataFrame({n: pd.array(c, "Int64") for n, c in zip(_NAMES, zip(*_rows(numbered), strict=True), strict=True)})

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = materialize(map_batches(source, kernel, PACKED + ", short boolean, part long, ids binary"), "packed")
    merged = pieces.where("short").groupBy(F.expr(f"part div {GROUP}").alias("g")).applyInPandas(merge, PACKED)
    return pieces.where("not short").select(*_NAMES).unionByName(merged)
