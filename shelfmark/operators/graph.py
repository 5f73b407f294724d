"""Connected components of an edge table, by rounds of large and small stars.

A round is one combined minimum per vertex and one join that adaptive execution can split, so a vertex
with very many links is no single task.  The caller says how a round's lineage is cut.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F


def connected_components(edges: DataFrame, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(vertex, label) for every vertex of ``edges`` (u, v); label is the least vertex reachable.

    ``save`` cuts the lineage of a round (``DataFrame.checkpoint`` or a written table)."""
    now = save(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low.withColumnRenamed("u", "k"), F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = save(moved.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    roots = now.select(F.col("v").alias("vertex"), F.col("v").alias("label")).distinct()
    return now.select(F.col("u").alias("vertex"), F.col("v").alias("label")).unionByName(roots)
