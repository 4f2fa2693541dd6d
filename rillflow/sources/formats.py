"""Fixed-width binary records: format, reader and writer.

A format is [[names], [lengths]]: ``flowkey`` once (4, 8 or 13 bytes),
``timestamp`` and ``length`` at most once (1, 2, 4 or 8), ``padding`` any number
over 0.  Fields of 1, 2 and 4 bytes are unsigned, of 8 signed, little-endian;
padding is written as zeros.  A field that the format lacks is null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes that a task reads of a file, and records it decodes at once.
RANGE, CHUNK = 64 << 20, 1 << 16
SCHEMA = "seq long, flowkey binary, timestamp timestamp, length long"


@dataclass(frozen=True)
class RecordFormat:
    names: tuple[str, ...]
    lengths: tuple[int, ...]

    @classmethod
    def parse(cls, spec: list) -> RecordFormat:
        bad = ValueError("unknown format")
        if len(spec) != 2 or not all(isinstance(x, list) for x in spec) or len(spec[0]) != len(spec[1]):
            raise bad
        names, lengths = spec
        allowed = {"flowkey": (4, 8, 13), "timestamp": (1, 2, 4, 8), "length": (1, 2, 4, 8)}
        for n, size in zip(names, lengths, strict=True):
            if isinstance(size, bool) or not isinstance(size, int) or (n == "padding" and size <= 0) or (n != "padding" and size not in allowed.get(n, ())):
                raise bad
        if names.count("flowkey") != 1 or names.count("timestamp") > 1 or names.count("length") > 1:
            raise bad
        return cls(tuple(names), tuple(lengths))

    @property
    def width(self) -> int:
        return sum(self.lengths)

    @property
    def key_length(self) -> int:
        return self.lengths[self.names.index("flowkey")]

    @property
    def dtype(self) -> np.dtype:
        """One numpy record; padding is left out by offsets."""
        at, fields = 0, []
        for n, size in zip(self.names, self.lengths, strict=True):
            if n != "padding":
                fields.append((n, f"V{size}" if n == "flowkey" else "<i8" if size == 8 else f"<u{size}", at))
            at += size
        names, formats, offsets = zip(*fields, strict=True)
        return np.dtype({"names": list(names), "formats": list(formats), "offsets": list(offsets), "itemsize": at})

    def decode(self, data: bytes) -> dict[str, np.ndarray | list | None]:
        if len(data) % self.width:
            raise ValueError("size is no multiple of the record length")
        rows = np.frombuffer(data, self.dtype)
        keys = [x.tobytes() for x in rows["flowkey"]]
        return {"flowkey": keys} | {n: rows[n].astype(np.int64) if n in self.names else None for n in ("timestamp", "length")}

    def encode(self, keys: list[bytes], timestamps: list[int] | None = None, lengths: list[int] | None = None) -> bytes:
        if any(len(k) != self.key_length for k in keys):
            raise ValueError("keys of another length than the format's")
        out = np.zeros((len(keys), self.width), np.uint8)
        at = 0
        for n, size in zip(self.names, self.lengths, strict=True):
            if n == "flowkey":
                out[:, at : at + size] = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, size)
            elif n != "padding":
                column = timestamps if n == "timestamp" else lengths
                v = np.array([x or 0 for x in column] if column is not None else [0] * len(keys), np.int64)
                out[:, at : at + size] = v.view(np.uint8).reshape(-1, 8)[:, :size]
            at += size
        return out.tobytes()


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path of Spark's, and the place there."""
    return fs.FileSystem.from_uri(path) if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path) else (fs.LocalFileSystem(), path)


def reachable(path: str) -> bool:
    """Whether Python workers can open a path of Spark's themselves."""
    try:
        opened(path)
    except (pa.ArrowInvalid, OSError):
        return False
    return True


def read_records(spark: SparkSession, path: str, fmt: RecordFormat, key_length: int | None = None) -> DataFrame:
    """Records of a file or folder of files, with seq counting from 0 in order of path and place.

    Spark lists the files with their sizes; each is cut into ranges of whole
    records of about ``RANGE`` bytes, which tasks read on their own.  Where
    workers can't open the store, Spark reads whole files (up to 2 GB), one a
    row.  A file whose size is no multiple of the record length fails.
    """
    if key_length is not None and key_length != fmt.key_length:
        raise ValueError("keys of another length than the format's")
    width = fmt.width
    files = spark.read.format("binaryFile").load(path)
    whole = F.when(F.col("length") % width == 0, F.expr(f"length div {width}")).otherwise(F.raise_error(F.concat(F.lit("size is no multiple of the record length: "), "path")).cast("long"))
    listed = files.select("path", "length").withColumn("rows", whole)
    # one row a file, ordered in one task: names and sizes only
    placed = listed.withColumn("first", F.sum("rows").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)))
    placed = placed.select("path", "rows", F.coalesce("first", F.lit(0)).alias("first"))

    def batch(data: bytes, first: int) -> pa.RecordBatch:
        got = fmt.decode(data)
        n = len(got["flowkey"])
        ts = pa.array(got["timestamp"], pa.timestamp("us", "UTC")) if got["timestamp"] is not None else pa.nulls(n, pa.timestamp("us", "UTC"))
        length = pa.array(got["length"], pa.int64()) if got["length"] is not None else pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int64) + first), pa.array(got["flowkey"], pa.binary()), ts, length], ["seq", "flowkey", "timestamp", "length"])

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for name, first, at, n in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                system, place = opened(name)
                with system.open_input_file(place) as f:
                    for k in range(at, at + n, CHUNK):
                        f.seek(k * width)
                        yield batch(f.read(min(CHUNK, at + n - k) * width), first + k)

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for first, content in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                for k in range(0, len(content), CHUNK * width):
                    yield batch(content[k : k + CHUNK * width], first + k // width)

    known = files.select("path").first()
    if known is None or reachable(known[0]):
        each = max(1, RANGE // width)
        cut = placed.where("rows > 0").select("path", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(each).cast("long"))).alias("at"), "rows")
        cut = cut.select("path", "first", "at", F.least(F.lit(each), F.col("rows") - F.col("at")).alias("n"))
        return cut.repartition("path", "at").mapInArrow(ranges, SCHEMA)
    return files.select("path", "content").join(placed.select("path", "first"), "path").select("first", "content").mapInArrow(contents, SCHEMA)


def encoded(records: DataFrame, fmt: RecordFormat) -> DataFrame:
    """(part, data): the records' bytes by partition, in seq order across partitions."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seq, key, ts, length = (c.to_pylist() for c in batch.columns)
            if seq:
                yield pa.RecordBatch.from_arrays([pa.array([seq[0]], pa.int64()), pa.array([fmt.encode(key, ts, length)], pa.binary())], ["part", "data"])

    micros = F.unix_micros("timestamp") if "timestamp" in records.columns else F.lit(None).cast("long")
    length = F.col("length") if "length" in records.columns else F.lit(None).cast("long")
    if "length" in fmt.names and "length" not in records.columns:
        raise ValueError("the format has lengths, the records don't")
    rows = records.select("seq", "flowkey", micros.alias("ts"), length.cast("long").alias("len"))
    return rows.repartitionByRange("seq").sortWithinPartitions("seq").mapInArrow(kernel, "part long, data binary")


def write_record_files(records: DataFrame, folder: str, fmt: RecordFormat) -> int:
    """One file a partition, written by the tasks to a folder that all of them reach, in seq order across the files' names.  A file appears whole, under its name, whatever attempt of the task makes it.  Returns the number of records."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        system, place = opened(folder)
        system.create_dir(place, recursive=True)
        name, draft = f"{place}/part-{task.partitionId():06d}.bin", f"{place}/_part-{task.partitionId():06d}-{task.taskAttemptId()}"
        size = 0
        with system.open_output_stream(draft) as f:
            for batch in batches:
                for data in batch.column(1).to_pylist():
                    size += f.write(data)
        system.move(draft, name)
        yield pa.RecordBatch.from_arrays([pa.array([size // fmt.width], pa.int64())], ["n"])

    return encoded(records, fmt).mapInArrow(kernel, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_records(records: DataFrame, path: str, fmt: RecordFormat) -> int:
    """One local file of records in seq order (small results and exchange with other tools; ``write_record_files`` is the sink for large ones).  Chunks come to the driver one at a time.  Returns the number of records."""
    size = 0
    with open(path, "wb") as f:
        for row in encoded(records, fmt).orderBy("part").toLocalIterator():
            size += f.write(row["data"])
    return size // fmt.width


def write(records: DataFrame, path: str, mode: str = "parquet") -> None:
    """Sinks by mode: parquet, txt (CSV with a header), or null (everything is computed, nothing written)."""
    if mode == "parquet":
        records.write.parquet(path)
    elif mode == "txt":
        records.withColumn("flowkey", F.hex("flowkey")).write.csv(path, header=True)
    elif mode == "null":
        records.write.format("noop").mode("overwrite").save()
    else:
        raise ValueError("mode is parquet, txt or null")
