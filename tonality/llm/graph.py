"""Connected components on DataFrames."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonality.llm.common import saved


def _mins(both: DataFrame) -> DataFrame:
    return both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of ``edges(a, b)``; the component is its smallest node.

    Alternating large-star and small-star steps: every step is an aggregation and a join on
    the node, so no neighbourhood is gathered, and the number of rounds grows with the
    logarithm of the graph.  Each round is written to the shared folder."""
    now = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, mark = saved(now, "cc"), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_mins(both), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        m = _mins(large)  # in large every v is below its u
        small = large.join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            m.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()
        now = saved(small, "cc")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    leaves = now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    roots = leaves.select(F.col("component").alias("node"), "component").distinct()
    return leaves.unionByName(roots)
