"""Connected components of an edge table, wholly in DataFrame operations.

Rounds of contraction: each node points to the least of itself and its
neighbours by a fixed random order (hash, then id); edges are rewritten to what
their ends point to, loops go, and only distinct edges stay.  In a random order
each round leaves a fraction of the nodes, so the tables shrink geometrically
and the rounds are logarithmic; a star or clique of any size goes in two.
Nothing is collected but one count a round.  Each round's tables are written to
the shared folder.  Hot nodes: the minimum is aggregated before the shuffle;
the joins are plain equi-joins, which Spark splits where they are skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, materialize


def _order(c: str) -> F.Column:
    return F.struct(F.xxhash64(F.col(c)).alias("h"), F.col(c).alias("i"))


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of an edge that isn't a loop; the component is its least node.  Null ends are dropped.

    An empty edge table gives an empty result.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u != v")
    e = materialize(e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    steps: list[DataFrame] = []
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = both.groupBy("u").agg(F.min(_order("v")).alias("m")).select("u", F.when(F.col("m") < _order("u"), F.col("m.i")).otherwise(F.col("u")).alias("p"))
        up = materialize(up, "parents")
        steps.append(up)
        e = e.join(up.withColumnRenamed("p", "a"), "u").join(up.select(F.col("u").alias("v"), F.col("p").alias("b")), "v")
        e = e.where("a != b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
        e = materialize(e, "edges")
    if not steps:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    root = steps[0].select(F.col("u").alias("node"), F.col("p").alias("r"))
    for up in steps[1:]:
        root = root.join(few(up.select(F.col("u").alias("r"), "p")), "r", "left").select("node", F.coalesce("p", "r").alias("r"))
    root = materialize(root, "roots")
    least = few(materialize(root.groupBy("r").agg(F.min("node").alias("component")), "least"))
    return root.join(least, "r").select("node", "component")
