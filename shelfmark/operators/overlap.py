"""Joins of word sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def similar_sets(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(left_set, right_set, likeness) of sets (left_set, left_words) and (right_set, right_words), words distinct, whose
    Jaccard likeness is ``least`` or more.

    Sets of a and b words that alike share k = least / (1 + least) * (a + b) words or more, so they meet in the a - k + 1
    rarest words of the one and the b - k + 1 of the other.  Words go by rarity, so common ones are hardly ever keys."""
    words = left.select(F.explode("left_words").alias("w")).unionByName(right.select(F.explode("right_words").alias("w"))).groupBy("w").agg(F.count(F.lit(1)).alias("df"))

    def keyed(df: DataFrame, own: str, other: str) -> DataFrame:
        by = df.select(f"{own}_set", F.explode(f"{own}_words").alias("w")).join(words, "w").groupBy(f"{own}_set").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "w"))), lambda x: x["w"]).alias("rare"))
        n = F.size("rare")
        sizes = F.sequence(F.ceil(n * least - 1e-9).cast("int"), F.floor(n / least + 1e-9).cast("int"))
        by = by.select(f"{own}_set", "rare", n.alias(f"{own}_n"), F.explode(sizes).alias(f"{other}_n"))
        shared = F.ceil(least / (1 + least) * (F.col(f"{own}_n") + F.col(f"{other}_n")) - 1e-9).cast("int")
        return by.select(f"{own}_set", f"{own}_n", f"{other}_n", F.explode(F.slice("rare", F.lit(1), F.greatest(F.col(f"{own}_n") - shared + 1, F.lit(0)))).alias("w"))

    met = keyed(left, "left", "right").join(keyed(right, "right", "left"), ["w", "left_n", "right_n"]).select("left_set", "right_set").distinct()
    both = met.join(left, "left_set").join(right, "right_set")
    shared = F.size(F.array_intersect("left_words", "right_words"))
    likeness = shared / (F.size("left_words") + F.size("right_words") - shared)
    return both.withColumn("likeness", likeness).where(F.col("likeness") >= least).select("left_set", "right_set", "likeness")
