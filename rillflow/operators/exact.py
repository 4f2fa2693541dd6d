"""Exact flow analytics: per-flow totals, heavy hitters, heavy changers, lookups.

Records have the flow key in one or more columns, an order column ``seq``, and
(for ``by="length"``) a length.  A summary has the key columns, ``value``, and
``first_seen`` (the least seq), which orders ties.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Packet lengths outside this range are flagged, not dropped.
SPURIOUS = (1, 1500)


def weight(by: str) -> Column:
    """What a record adds: its length, or one."""
    if by not in ("length", "packets"):
        raise ValueError("by is 'length' or 'packets'")
    return F.col("length").cast("long") if by == "length" else F.lit(1).cast("long")


def flag_spurious(records: DataFrame) -> DataFrame:
    """Records with a column that says whether the length is unlikely; null lengths are not flagged."""
    return records.withColumn("spurious", F.coalesce(~F.col("length").between(*SPURIOUS), F.lit(False)))


def ground_truth(records: DataFrame, keys: list[str], by: str = "packets") -> DataFrame:
    """(keys, value, first_seen): one partial and one final aggregate around one shuffle.  Records without a key or weight are left out."""
    rows = records.withColumn("_w", weight(by)).where(F.col("_w").isNotNull())
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    return rows.groupBy(*keys).agg(F.sum("_w").cast("long").alias("value"), F.min("seq").alias("first_seen"))


def flag_overflow(truth: DataFrame, bits: int = 32) -> DataFrame:
    """A summary with a column that says whether a signed counter of so many bits would have overflowed; our own counters have 64, and a sum beyond those is an error."""
    return truth.withColumn("overflow", ~F.col("value").between(-(1 << bits - 1), (1 << bits - 1) - 1))


def totals(truth: DataFrame) -> DataFrame:
    """One row: number of flows, total, least and greatest value (null when empty)."""
    return truth.agg(F.count("*").alias("flows"), F.coalesce(F.sum("value"), F.lit(0)).cast("long").alias("total"), F.min("value").alias("least"), F.max("value").alias("most"))


def equal_range(truth: DataFrame, value: int) -> DataFrame:
    return truth.where(F.col("value") == value)


def lookup(truth: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Wanted keys with the value or null, and count (0 or 1)."""
    return wanted.join(truth.select(*keys, "value"), keys, "left").withColumn("count", F.col("value").isNotNull().cast("int"))


def value_of(truth: DataFrame, key: dict) -> int:
    """The value of one key; KeyError without it."""
    row = truth.where(reduce(Column.__and__, (F.col(k) == F.lit(v) for k, v in key.items()))).select("value").first()
    if row is None:
        raise KeyError(key)
    return row[0]


def upsert(estimates: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Estimates with updates added; a key that only updates have is inserted (an insert adds 0)."""
    return estimates.select(*keys, "est").unionByName(updates.select(*keys, "est")).groupBy(*keys).agg(F.sum("est").cast("long").alias("est"))


def _top(values: DataFrame, k: float, order: list[str]) -> DataFrame:
    if k < 1:
        raise ValueError("top-k needs a threshold of at least 1")
    return values.orderBy(F.desc("value"), *order).limit(int(k))


def _share(values: DataFrame, share: float) -> DataFrame:
    """Values over floor(share * total), strictly; the total comes from the same aggregate, one row wide."""
    if not 0 <= share <= 1:
        raise ValueError("a share lies between 0 and 1")
    cut = values.agg(F.floor(F.lit(float(share)) * F.sum("value").cast("double")).cast("long").alias("_cut"))
    return values.crossJoin(F.broadcast(cut)).where(F.col("value") > F.col("_cut")).drop("_cut")


def heavy_hitters(truth: DataFrame, threshold: float, method: str = "topk") -> DataFrame:
    """Flows by 'percentile' (share of the whole total) or, as for any other method, 'topk' (ties by first seen)."""
    return _share(truth, threshold) if method.lower() == "percentile" else _top(truth, threshold, ["first_seen"])


def differences(one: DataFrame, two: DataFrame, keys: list[str]) -> DataFrame:
    """|value in one - value in two| over the keys of both; zeros stay."""
    a, b = one.select(*keys, F.col("value").alias("_a")), two.select(*keys, F.col("value").alias("_b"))
    zero = F.lit(0).cast("long")
    return a.join(b, keys, "full").select(*keys, F.abs(F.coalesce("_a", zero) - F.coalesce("_b", zero)).cast("long").alias("value"))


def record_differences(one: DataFrame, two: DataFrame, keys: list[str], by: str = "packets") -> DataFrame:
    """The same from records: signed weights, one shuffle and no join.  Records without a key or weight are left out."""
    w = weight(by)
    signed = one.select(*keys, w.alias("_w")).unionByName(two.select(*keys, (-w).alias("_w"))).where(F.col("_w").isNotNull())
    for k in keys:
        signed = signed.where(F.col(k).isNotNull())
    return signed.groupBy(*keys).agg(F.abs(F.sum("_w")).cast("long").alias("value"))


def heavy_changers(diff: DataFrame, keys: list[str], threshold: float, method: str = "topk") -> DataFrame:
    """Flows by difference: 'percentile' (share of the sum of differences) or, as for any other method, 'topk' (ties by key)."""
    return _share(diff, threshold) if method.lower() == "percentile" else _top(diff, threshold, keys)


def prefix(records: DataFrame, share: float) -> DataFrame:
    """The first floor(share * rows) records by seq, which counts from 0; the number of rows is counted in the same query."""
    if not 0 < share <= 1:
        raise ValueError("a sample's share lies over 0 and up to 1")
    cut = records.agg(F.floor(F.lit(float(share)) * F.count("*")).cast("long").alias("_cut"))
    return records.crossJoin(F.broadcast(cut)).where(F.col("seq") < F.col("_cut")).drop("_cut")


def halves(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records under and from the middle of seq on, which counts from 0."""
    middle = records.agg(F.expr("(max(seq) + 1) div 2").alias("_cut"))
    whole = records.crossJoin(F.broadcast(middle))
    return whole.where(F.col("seq") < F.col("_cut")).drop("_cut"), whole.where(F.col("seq") >= F.col("_cut")).drop("_cut")


def between(records: DataFrame, begin: int, end: int) -> DataFrame:
    """Records from begin up to end, by seq."""
    return records.where((F.col("seq") >= begin) & (F.col("seq") < end))


def packet_cap(records: DataFrame, count: int) -> DataFrame:
    """The first count records by seq; -1 means all."""
    return records if count < 0 else records.orderBy("seq").limit(count)


def flow_cap(records: DataFrame, keys: list[str], count: int) -> DataFrame:
    """Records before the one that brings the count-th distinct flow, so count - 1 flows; -1 means all.

    The flows' first records are aggregated, and only the count least are ordered.
    """
    if count < 0:
        return records
    first = records.groupBy(*keys).agg(F.min("seq").alias("_f")).orderBy("_f").limit(count)
    stop = first.agg(F.when(F.count("*") == count, F.max("_f")).alias("_stop"))
    return records.crossJoin(F.broadcast(stop)).where(F.col("_stop").isNull() | (F.col("seq") < F.col("_stop"))).drop("_stop")
