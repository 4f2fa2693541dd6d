"""Record views of the driver's tables: seq, flow key columns, length, timestamp."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as an ordered stream: seq = event_id, key = user_id, second key event_type, length = floor(value) + 1."""
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    return t.select(F.col("event_id").alias("seq"), F.col("user_id").alias("key"), "event_type", (F.floor("value").cast("long") + 1).alias("length"), F.col("ts").alias("timestamp"))


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as an unordered stream: key = l_partkey, second key l_suppkey, length = quantity."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return t.select(F.lit(0).cast("long").alias("seq"), F.col("l_partkey").alias("key"), F.col("l_suppkey").alias("supp"), F.col("l_quantity").cast("long").alias("length"), F.col("l_shipdate").alias("timestamp"))
