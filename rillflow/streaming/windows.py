"""Flow analytics over event-time windows (an extension: the batch operators know no time).

Exact totals and linear sketches are aggregates by window, so Structured
Streaming keeps their state; late rows beyond the watermark are dropped by it.
Order-dependent sketches keep one state a shard and fold each micro-batch in
seq order.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.hashing import hashed, shard_of
from ..operators.exact import weight
from ..operators.linear import CountMin


def windowed_truth(records: DataFrame, keys: list[str], window: str, delay: str, by: str = "packets") -> DataFrame:
    """(start, keys, value) of each window; records have timestamp."""
    w = F.window("timestamp", window)
    return records.withWatermark("timestamp", delay).groupBy(w.alias("w"), *keys).agg(F.sum(weight(by)).cast("long").alias("value")).select(F.col("w.start").alias("start"), *keys, "value")


def windowed_cells(records: DataFrame, sketch: CountMin, window: str, delay: str, key: str = "key", by: str = "packets") -> DataFrame:
    """(start, r, c, v): the cells of each window's sketch.  Sketches of windows may be merged, or subtracted for changers."""
    rows = records.withWatermark("timestamp", delay).select("timestamp", F.explode(sketch.entries(hashed(records, key), weight(by))).alias("e"))
    return rows.groupBy(F.window("timestamp", window).alias("w"), F.col("e.r").alias("r"), F.col("e.c").alias("c")).agg(F.sum("e.v").cast("long").alias("v")).select(F.col("w.start").alias("start"), "r", "c", "v")


def windowed_changers(cells: DataFrame, sketch: CountMin, keys: DataFrame, before: str, after: str, key: str = "key") -> DataFrame:
    """Estimated |change| of keys between two windows of (batch) cells of a signed sketch."""
    t = lambda s: F.to_timestamp(F.lit(s))
    sign = F.when(F.col("start") == t(after), 1).otherwise(-1)
    diff = cells.where(F.col("start").isin(before, after)).groupBy("r", "c").agg(F.sum(F.col("v") * sign).cast("long").alias("v"))
    return sketch.query(diff, keys, key)


def stream_fold(records: DataFrame, columns: list[str], shards: int, make: Callable[[], object], schema: str, key: str = "key") -> DataFrame:
    """Updated rows of each shard's sketch after each micro-batch; the state survives between batches and restarts in the checkpoint."""
    dealt = records.select(shard_of(records, key, shards).alias("shard"), F.col("seq").alias("_seq"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(columns)])
    names = ["shard", *[c.split()[0] for c in schema.split(",")]]
    args = [f"_{i}" for i in range(len(columns))]

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sketch = pickle.loads(state.get[0]) if state.exists else make()
        rows = pd.concat(list(frames)).sort_values("_seq")
        for row in zip(*(rows[a].tolist() for a in args), strict=True):
            sketch.step(*row)
        state.update((pickle.dumps(sketch),))
        yield pd.DataFrame([(group[0], *r) for r in sketch.rows()], columns=names)

    return dealt.groupBy("shard").applyInPandasWithState(step, f"shard long, {schema}", "sketch binary", "update", GroupStateTimeout.NoTimeout)
