"""Delivery, offers of a list line, layout changes and shipping ladders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions import codes as C


def arrival(order_day: Column, availability: Column, miles: Column, published_days: Column, same_day: Column) -> Column:
    """C17: backordered goods have no day; the distance gives ground days and one more, else the published
    days; handling takes a day unless it ships the same day."""
    days = F.coalesce(C.ground_days(miles) + 1, published_days)
    days = F.when(miles.isNull(), published_days).otherwise(days)
    return F.when(availability == "backordered", None).otherwise(C.add_business_days(order_day, (days + F.when(same_day, 0).otherwise(1)).cast("int")))


def best_offer(offers: DataFrame, preferred: list | None = None) -> DataFrame:
    """One offer a line: preferred suppliers where there are any, orderable ones first, no price counting
    as the highest."""
    liked = F.col("supplier_id").isin(preferred) if preferred else F.lit(True)
    any_liked = F.max(liked.cast("int")).over(W.partitionBy("line_id"))
    rows = offers.withColumn("_liked", liked).withColumn("_any", any_liked).where((F.col("_any") == 0) | F.col("_liked"))
    rank = F.row_number().over(W.partitionBy("line_id").orderBy(F.when(F.col("orderable"), 0).otherwise(1), F.when(F.col("price_cents") > 0, F.col("price_cents")).asc_nulls_last(), "offer_id"))
    return rows.withColumn("rn", rank).where("rn = 1").drop("rn", "_liked", "_any")


def ladder(tiers: Column) -> Column:
    """Tiers of cents to (min, flat) in dollars, by their minimum."""
    return F.array_sort(F.transform(tiers, lambda t: F.struct((t["min_subtotal_cents"] / 100).alias("min"), (t["flat_cents"] / 100).alias("flat"))))


def moved(now: DataFrame, saved: DataFrame) -> DataFrame:
    """Locations whose place differs from the saved one; a text that is no number is no place."""
    place = lambda df, p: df.select("location_id", F.col("x").try_cast("double").alias(f"{p}x"), F.col("y").try_cast("double").alias(f"{p}y"))
    both = place(now, "n").join(place(saved, "s"), "location_id", "left")
    return both.where(~F.col("nx").eqNullSafe(F.col("sx")) | ~F.col("ny").eqNullSafe(F.col("sy"))).select("location_id")


# --- queries

def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def c11_comparable(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = C.half_up(F.col("p_retailprice"))
    return _read(spark, sf_dir, "part").select("p_partkey", C.comparable_price(unit, F.lit(7).cast("long"), F.lit(12), F.col("p_size")).alias("cents"))


def c17_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    day = arrival(F.lit("1998-01-02").cast("date"), F.when(F.col("o_orderstatus") == "P", "backordered").otherwise("in_stock"), F.when(F.col("o_orderkey") % 2 == 0, F.lit(400.0)), F.lit(5), F.col("o_orderkey") % 3 == 0)
    return o.select("o_orderkey", day.alias("day"))


def c20_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    state = F.when(F.col("value") < 5, "expired").when(F.col("value") < 10, "expiring").otherwise("active")
    return e.select("event_id", C.attention_reason(F.col("event_id") % 4 > 0, state, F.col("event_id") % 3 > 0).alias("reason"))


def c21_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("location_id"), F.col("s_nationkey").cast("string").alias("x"), F.when(F.col("s_suppkey") % 5 == 0, "none").otherwise("1").alias("y"))
    return moved(s, s.withColumn("x", F.when(F.col("location_id") % 2 == 0, "-1").otherwise(F.col("x"))))


def c31_best_offer(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("line_id"), F.col("l_suppkey").alias("supplier_id"), (F.col("l_returnflag") != "R").alias("orderable"), F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("long").alias("price_cents"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("offer_id"))
    return best_offer(li, [1, 2, 3]).groupBy("line_id").agg(F.min("price_cents").alias("price_cents"))


QUERIES = {f.__name__: f for f in (c11_comparable, c17_arrival, c20_attention, c21_moved, c31_best_offer)}
ORACLES = {
    "c11_comparable": "SELECT p_partkey, CASE WHEN p_size <> 12 OR p_size IS NULL THEN CAST(floor(floor(p_retailprice + 0.5) * 12 + 0.5) AS BIGINT) ELSE 7 END AS cents FROM part",
    "c17_arrival": """
        SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(list_filter(list_transform(range(1, 30), i -> DATE '1998-01-02' + CAST(i AS INT)), d -> dayofweek(d) NOT IN (0, 6))[
          CASE WHEN o_orderkey % 2 = 0 THEN 3 ELSE 5 END + CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END] AS DATE) END AS day FROM orders""".replace("i -> ", "lambda i: ").replace("d -> ", "lambda d: "),
    "c20_attention": """
        SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'unidentified' WHEN value < 5 THEN 'expired' WHEN value < 10 THEN 'expiring' WHEN event_id % 3 = 0 THEN 'missing_trace' END AS reason FROM events""",
    "c21_moved": "SELECT s_suppkey AS location_id FROM supplier WHERE CASE WHEN s_suppkey % 2 = 0 THEN -1 ELSE s_nationkey END IS DISTINCT FROM s_nationkey",
    "c31_best_offer": """
        SELECT line_id, price_cents FROM (SELECT q.*, row_number() OVER (PARTITION BY line_id ORDER BY CASE WHEN orderable THEN 0 ELSE 1 END, CASE WHEN price_cents > 0 THEN price_cents END NULLS LAST, offer_id) AS rn FROM (
          SELECT l_partkey AS line_id, l_returnflag <> 'R' AS orderable, CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS price_cents, l_orderkey * 10 + l_linenumber AS offer_id, l_suppkey IN (1, 2, 3) AS liked,
                 bool_or(l_suppkey IN (1, 2, 3)) OVER (PARTITION BY l_partkey) AS any_liked FROM lineitem) q WHERE liked OR NOT any_liked) r WHERE rn = 1""",
}
