"""What the operators of this package share: sources, scratch tables, Arrow kernels.

Conventions of every operator here:

* it takes a DataFrame and column names, selects only those columns (so other
  columns, whatever they are called, are neither read nor in the way), and
  returns a new DataFrame;
* a kernel is a function of an iterator of Arrow batches, run by mapInArrow; it
  sees slices bounded in rows and bytes (a single longer text is a slice of its
  own), plus caches bounded in bytes; Spark's settings stay as they are;
* intermediate results that are used twice are written once, as Parquet, to the
  shared folder (``materialize``) and so outlive the executors that made them.
  All of an application's lie in one folder there, which goes when the
  application ends; ``sources.scratch.clean_up`` removes it earlier, once no
  result that was made from it is still to be computed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.scratch import scratch

#: Tables of up to so many ids (up to 40 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 300_000
#: Rows and bytes of a slice that a kernel sees.
SLICE_ROWS, SLICE_BYTES = 256, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table of the corpus."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    written = f"{scratch(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(written)
    return spark.read.schema(df.schema).parquet(written)


def few(written: DataFrame) -> DataFrame:
    """A written table of ids, to be broadcast if its counted rows are within the bound."""
    return F.broadcast(written) if written.count() <= BROADCAST_IDS else written


Kernel = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches' rows in slices of at most SLICE_ROWS rows, and at most about SLICE_BYTES bytes or one row; a batch without rows stays."""
    for batch in batches:
        rows = batch.num_rows
        at = 0
        while at < rows:
            n = min(SLICE_ROWS, rows - at)
            while n > 1 and batch.slice(at, n).nbytes > SLICE_BYTES:
                n = n + 1 >> 1
            yield batch.slice(at, n)
            at += n
        if not rows:
            yield batch


def map_batches(df: DataFrame, kernel: Kernel, schema: str | StructType) -> DataFrame:
    """mapInArrow whose kernel sees slices; whole texts stay whole."""
    return df.mapInArrow(lambda batches: kernel(slices(batches)), schema)


class Cache(dict):
    """A dict of strings (or what holds strings) that starts anew when it holds as many entries or characters as it may.

    ``room(size)`` is asked before something of that size goes in; things over a
    hundredth of the bound aren't worth keeping and get no room.
    """

    def __init__(self, entries: int, characters: int = 32 << 20):
        self.entries, self.characters, self.held = entries, characters, 0

    def room(self, size: int) -> bool:
        if size * 100 > self.characters:
            return False
        if len(self) >= self.entries or self.held + size > self.characters:
            self.clear()
            self.held = 0
        self.held += size
        return True


def texts_of(batch: pa.RecordBatch, column: int = 1) -> list[str]:
    """A text column as str; null counts as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def crc_mod(id_column: str, mod: int) -> F.Column:
    """crc32 of an id written as text, modulo mod; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def keep_rows(df: DataFrame, text_col: str, keep: Callable[[], Callable[[list[str]], list[bool]]]) -> DataFrame:
    """The rows of df, all columns as they are, for whose whole texts a predicate holds; ``keep`` makes the predicate once a task."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds = keep()
        for batch in batches:
            yield batch.filter(pa.array(holds(texts_of(batch, batch.schema.get_field_index(text_col))), pa.bool_()))

    return map_batches(df, kernel, df.schema)
