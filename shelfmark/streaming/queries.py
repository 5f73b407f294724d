"""Streaming operators over ``events`` and ``lineitem``, run to the end of the data."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import shared_folder
from . import sessions as P, state as S, store as B


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's file, or folder of files, as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/{name}.parquet*")


def _folded(spark: SparkSession, stream: DataFrame, merge: B.Merge) -> DataFrame:
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    table = B.StateTable(spark, f"{root}/table", merge)
    B.upsert_stream(stream, table, f"{root}/checkpoint").awaitTermination()
    found = table.read()
    return merge(None, spark.createDataFrame([], stream.schema)) if found is None else found


def st01_latest_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stream(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_suppkey", "l_partkey").alias("listing_id"), F.col("l_suppkey").alias("supplier_id"), F.col("l_partkey").alias("canonical_id"), F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("long").alias("price_cents"),
        F.col("l_shipdate").alias("captured_at"), F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"),
    )
    return _folded(spark, s, S.merge_latest_price).drop("supplier_id", "canonical_id")


def st02_catalog_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stream(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), "event_type")
    seen = _folded(spark, s, S.merge_first_row)
    existing = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), F.lit(None).cast("timestamp").alias("deleted_at"))
    return S.stale_rows(existing, seen).select("id")


def _scans(df: DataFrame) -> DataFrame:
    code = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    return df.select(
        code.alias("item_id"), F.col("event_type").alias("lot"), F.col("user_id").alias("location_id"), F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("quantity"),
        F.when(F.col("event_id") % 3 == 0, F.to_date("ts")).alias("expiration"), F.when(F.col("event_id") % 50 == 0, F.col("ts")).alias("pulled_at"), F.col("event_id").alias("seq"),
    )


def st03_scan_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.scan_view(_folded(spark, S.scan_state(_scans(_stream(spark, sf_dir, "events"))), S.merge_scans))


def st04_scan_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second scan is a plain barcode, without lot and date; the others are data matrices."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    two = F.col("event_id") % 2 == 0
    scans = e.select("ts", F.col("user_id").alias("location_id"), (F.regexp_extract("props", "([0-9]+)", 1).cast("long") % 10).alias("item_id"), F.col("event_id").alias("seq"), F.when(two, F.col("event_type")).alias("lot"), F.when(two, F.to_date("ts")).alias("expiration"))
    return P.pair_scans(scans, 6 * 3600)


def st05_list_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stream(spark, sf_dir, "events").select(
        F.col("user_id").alias("list_id"), F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("item_id"), F.col("ts").alias("updated_at"),
        (F.col("event_type") == "purchase").alias("deleted"), F.col("value").alias("payload"),
    )
    rows = _folded(spark, s, S.merge_lists)
    now = rows.agg(F.max("updated_at").alias("now"))  # one row
    return S.list_view(rows.join(F.broadcast(now)), F.col("now"), 3, 5).drop("now")


def st07_event_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stream(spark, sf_dir, "events").select("event_id", F.col("ts").alias("seq"), "event_type")
    return _folded(spark, s, S.merge_events)


def st08_stale_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.when(F.col("event_type") == "click", "running").otherwise("done").alias("status"), F.col("ts").alias("heartbeat_at"))
    return S.reap_stale_jobs(e, F.lit("2024-01-15 00:00:00").cast("timestamp"))


def st11_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.windowed_counts(spark.read.parquet(f"{sf_dir}/events.parquet"), "6 hours")


QUERIES = {f.__name__: f for f in (st01_latest_price, st02_catalog_reconcile, st03_scan_upsert, st04_scan_pairs, st05_list_merge, st07_event_ledger, st08_stale_jobs, st11_windowed_counts)}
ORACLES = {
    "st01_latest_price": """
        SELECT listing_id, price_cents, captured_at, order_id, line_no FROM (
          SELECT concat(l_suppkey, '-', l_partkey) AS listing_id, CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS price_cents, l_shipdate AS captured_at, l_orderkey AS order_id, l_linenumber AS line_no,
                 row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_shipdate DESC NULLS LAST, l_orderkey DESC, l_linenumber DESC) AS rn FROM lineitem) q WHERE rn = 1""",
    "st02_catalog_reconcile": "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)",
    "st03_scan_upsert": """
        SELECT item_id, lot, location_id, arg_max(quantity, seq) FILTER (WHERE quantity IS NOT NULL) AS quantity, arg_max(expiration, seq) FILTER (WHERE expiration IS NOT NULL) AS expiration,
               min(pulled_at) AS pulled_at, max(seq) AS seq FROM (
          SELECT CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS item_id, event_type AS lot, user_id AS location_id, CASE WHEN event_id % 2 = 0 THEN value END AS quantity,
                 CASE WHEN event_id % 3 = 0 THEN CAST(ts AS DATE) END AS expiration, CASE WHEN event_id % 50 = 0 THEN ts END AS pulled_at, event_id AS seq FROM events) q GROUP BY item_id, lot, location_id""",
    "st05_list_merge": """
        SELECT list_id, item_id, updated_at, deleted, payload FROM (SELECT r.*, row_number() OVER (PARTITION BY list_id, deleted ORDER BY updated_at DESC, item_id) AS place FROM (
          SELECT * FROM (SELECT q.*, row_number() OVER (PARTITION BY list_id, item_id ORDER BY updated_at DESC, deleted DESC, payload DESC) AS rn, max(updated_at) OVER () AS last_write FROM (
            SELECT user_id AS list_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS item_id, ts AS updated_at, event_type = 'purchase' AS deleted, value AS payload FROM events) q) w
          WHERE rn = 1 AND (NOT deleted OR updated_at >= last_write - INTERVAL 3 DAYS)) r) v WHERE NOT deleted OR place <= 5""",
    "st07_event_ledger": "SELECT event_id, min(ts) AS seq, arg_min(event_type, ts) AS event_type FROM events GROUP BY event_id",
    "st08_stale_jobs": """
        SELECT event_id, CASE WHEN event_type = 'click' AND ts < TIMESTAMP '2024-01-14 23:50:00' THEN 'queued' WHEN event_type = 'click' THEN 'running' ELSE 'done' END AS status, ts AS heartbeat_at FROM events""",
    "st11_windowed_counts": """
        SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS start, time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') + INTERVAL 6 HOURS AS "end", event_type, count(*) AS n, sum(value) AS total
        FROM events GROUP BY 1, 2, 3""",
}
