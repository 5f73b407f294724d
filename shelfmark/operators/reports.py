"""Figures of a matching run's report: a fixed sample, and links by pair of suppliers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..session import saver

#: The sample's generator, in double arithmetic.
FACTOR, STEP, MODULUS = 1103515245, 12345, 2147483648
SEED, SAMPLE = 42, 50
#: Suppliers of a product that are paired with all others by one task.
BLOCK = 200


def generator(seed: int = SEED) -> tuple[list[float], int]:
    """The generator's numbers up to where they repeat, and where the circle begins.  Products are rounded to 53 bits,
    so it runs into a circle of some thousand numbers; any number of it is known from its place alone."""
    place, states, s = {}, [], float(seed)
    while s not in place:
        place[s] = len(states)
        states.append(s)
        s = math.fmod(s * FACTOR + STEP, float(MODULUS))
    return states, place[s]


def shuffled_places(spark: SparkSession, n: int, count: int, seed: int = SEED) -> list[int]:
    """Which of ``n`` places the first ``count`` of a shuffle come from: swaps of i with floor(random * (i + 1)), for i from
    n - 1 down to 1.  A place is followed back through the swaps: it moves at swap i = itself, and then at each later
    swap that draws it, about log(n) times.  Each round finds the next such swap of all places in one pass over the
    numbers i, of which no two have to be on one machine; the draws of a swap come from ``generator``."""
    states, begin = generator(seed)
    table = F.from_json(F.lit("[" + ",".join(map(repr, states)) + "]"), "array<double>")  # folded into one constant
    circle, tail = len(states) - begin, F.lit(begin)
    nth = F.lit(n) - F.col("i")
    state = F.get(table, F.when(nth < begin, nth).otherwise(tail + F.pmod(nth - begin, F.lit(circle))).cast("int"))
    draws = spark.range(1, n).withColumnRenamed("id", "i").withColumn("j", F.floor(state / F.lit(float(MODULUS)) * (F.col("i") + 1)).cast("long"))
    count = min(count, n)
    at = {p: p for p in range(count)}  # place in the result -> place before the swaps seen so far
    since = {p: p for p in range(count)}
    if count > 1:
        for r in draws.where(F.col("i") < count).collect():  # swap i = place itself
            at[r.i] = r.j
    while True:
        where = spark.createDataFrame([(p, at[p], since[p]) for p in at], "p long, j long, since long")
        moved = draws.join(F.broadcast(where), "j").where("i > since").groupBy("p").agg(F.min("i").alias("i")).collect()  # count rows at most
        if not moved:
            return [at[p] for p in range(count)]
        for r in moved:
            at[r.p] = since[r.p] = r.i


def at_places(df: DataFrame, order: list[Column], places: list[int], save) -> DataFrame:
    """The rows at ``places`` (from 0, few) of ``df`` in ``order``, with ``place``.  Rows are partitioned by range and numbered
    within their partitions; one row a partition is brought together."""
    parts = save(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = F.coalesce(F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    start = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).withColumn("start", before).select("_part", "start")
    numbered = parts.join(F.broadcast(start), "_part").withColumn("_place", F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1 + F.col("start"))
    wanted = df.sparkSession.createDataFrame([(p, k) for k, p in enumerate(places)], "_place long, place int")
    return numbered.join(F.broadcast(wanted), "_place").drop("_place", "_part", "start")


def sample(df: DataFrame, order: list[Column], count: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """AG19: the first ``count`` rows of a seeded shuffle of ``df`` in ``order``, with their ``place`` from 0."""
    spark = df.sparkSession
    return at_places(df, order, shuffled_places(spark, df.count(), count, seed), saver(spark))


def supplier_pairs(offers: DataFrame, block: int = BLOCK) -> DataFrame:
    """AG18: (supplier_a, supplier_b, n_products) of suppliers that offer the same products (product_id, supplier_id);
    at most as many rows as suppliers squared.  Products with one set of suppliers are counted once, and a set longer
    than ``block`` is paired in pieces, so no task makes all pairs of a large one.  A supplier and those behind it in a
    set are brought to its place before they are paired, so a task counts the pairs of its own suppliers only, and
    pairs are not shuffled."""
    rows = offers.where("supplier_id IS NOT NULL AND product_id IS NOT NULL").repartition("product_id")
    sets = rows.groupBy("product_id").agg(F.array_sort(F.collect_set("supplier_id")).alias("s")).where("size(s) >= 2").groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    pieces = sets.withColumn("piece", F.explode(F.expr(f"sequence(0, (size(s) - 1) DIV {block})"))).repartition("s", "piece")
    left = pieces.select("n", "s", F.posexplode(F.expr(f"slice(s, piece * {block} + 1, {block})")).alias("k", "supplier_a"), "piece")
    tails = left.select("n", "supplier_a", F.expr(f"slice(s, piece * {block} + k + 2, size(s))").alias("tail")).repartition("supplier_a")
    return tails.select("n", "supplier_a", F.explode("tail").alias("supplier_b")).groupBy("supplier_a", "supplier_b").agg(F.sum("n").alias("n_products"))


def ag18_supplier_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return supplier_pairs(li.select(F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("supplier_id")))


def ag19_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample of the parts in order of their key."""
    return sample(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey"), [F.col("p_partkey")])


QUERIES = {f.__name__: f for f in (ag18_supplier_pairs, ag19_sample)}
ORACLES = {
    "ag18_supplier_pairs": """
        WITH o AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
        SELECT a.l_suppkey AS supplier_a, b.l_suppkey AS supplier_b, count(*) AS n_products FROM o a JOIN o b ON b.l_partkey = a.l_partkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2""",
    "ag19_sample": f"""
        WITH RECURSIVE s(i, state, a) AS (
          SELECT count(*) - 1, {SEED}::DOUBLE, list(p_partkey ORDER BY p_partkey) FROM part
          UNION ALL
          SELECT i - 1, next, list_transform(a, lambda x, k: CASE WHEN k = i + 1 THEN a[j + 1] WHEN k = j + 1 THEN a[i + 1] ELSE x END)
          FROM (SELECT i, a, next, CAST(floor(next / {MODULUS}.0::DOUBLE * (i + 1)) AS BIGINT) AS j FROM (SELECT i, a, fmod(state * {FACTOR}::DOUBLE + {STEP}::DOUBLE, {MODULUS}::DOUBLE) AS next FROM s WHERE i > 0) p) q)
        SELECT unnest(a[1:{SAMPLE}]) AS p_partkey, CAST(unnest(range(0, {SAMPLE})) AS INTEGER) AS place FROM s WHERE i = 0""",
}
