"""Order-insensitive state: latest prices, catalog reconcile, scans, list merge, event ledger.

Each operator is a rule on DataFrames (``merge_*``) that gives the same result whatever the batches
and their order; ``store.StateTable`` applies it to a table in the shared folder, batch by batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

def _newest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    rn = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rn).where("_rn = 1").drop("_rn")


def _with(old: DataFrame | None, new: DataFrame) -> DataFrame:
    return new if old is None else old.unionByName(new)


def merge_latest_price(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """ST01: the latest snapshot of each listing; equal times go to the larger order and line."""
    return _newest(_with(old, new), ["supplier_id", "canonical_id"], [F.desc_nulls_last("captured_at"), F.desc("order_id"), F.desc("line_no")])


def merge_first_row(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """ST02: the rows a reconcile has seen: the first row of an id wins across batches (``seq`` orders them)."""
    return _newest(_with(old, new), ["id"], [F.asc("seq")])


def stale_rows(existing: DataFrame, seen: DataFrame) -> DataFrame:
    """ST02, at the end: live rows that no batch has named."""
    return existing.where("deleted_at IS NULL").join(seen.select("id"), "id", "left_anti")


def scan_state(scans: DataFrame) -> DataFrame:
    """ST03: scans as state: each value with the number of the scan that said it."""
    said = lambda c: F.when(F.col(c).isNotNull(), F.struct("seq", F.col(c).alias("value"))).alias(c)
    return scans.select("item_id", "lot", "location_id", said("quantity"), said("expiration"), "pulled_at", "seq")


def merge_scans(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """ST03: one row of state per (item, lot, location); newer values fill or replace, a pulled row stays pulled."""
    rows = _with(old, new)
    return rows.groupBy("item_id", "lot", "location_id").agg(F.max("quantity").alias("quantity"), F.max("expiration").alias("expiration"), F.min("pulled_at").alias("pulled_at"), F.max("seq").alias("seq"))


def scan_view(rows: DataFrame) -> DataFrame:
    """ST03: the values themselves."""
    return rows.select("item_id", "lot", "location_id", F.col("quantity.value").alias("quantity"), F.col("expiration.value").alias("expiration"), "pulled_at", "seq")


def merge_lists(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """ST05, ST06: the newest write of an item wins, a deletion wins a tie.  Deletions stay in the state, so an old write
    that comes late revives nothing."""
    return _newest(_with(old, new), ["list_id", "item_id"], [F.desc("updated_at"), F.desc("deleted"), F.desc("payload")])


def expired_deletions(rows: DataFrame, as_of, days: int) -> DataFrame:
    """ST05: state without the deletions that are older than ``days`` days at ``as_of``: writes as old as that are no
    longer accepted (``accepted_writes``), so none can come that they would have to outlive."""
    return rows.where(~F.col("deleted") | (F.col("updated_at") >= as_of - F.expr(f"INTERVAL {days} DAYS")))


def accepted_writes(rows: DataFrame, as_of, days: int) -> DataFrame:
    """ST05: writes that are not older than ``days`` days at ``as_of``."""
    return rows.where(F.col("updated_at") >= as_of - F.expr(f"INTERVAL {days} DAYS"))


def list_view(rows: DataFrame, as_of, days: int = 30, most: int = 100) -> DataFrame:
    """ST05: the lists as they are handed out at ``as_of``: deletions of the last ``days`` days only, and of them the
    newest ``most`` of a list."""
    rank = F.row_number().over(W.partitionBy("list_id", "deleted").orderBy(F.desc("updated_at"), "item_id"))
    kept = rows.where(~F.col("deleted") | (F.col("updated_at") >= as_of - F.expr(f"INTERVAL {days} DAYS")))
    return kept.withColumn("_r", rank).where(~F.col("deleted") | (F.col("_r") <= most)).drop("_r")


def merge_events(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """ST07: each event once, whenever it comes again; the ledger has no horizon."""
    return _newest(_with(old, new), ["event_id"], [F.asc("seq")])


def reap_stale_jobs(jobs: DataFrame, now, minutes: int = 10) -> DataFrame:
    """ST08: running jobs without a sign of life for that long go back to the queue."""
    stale = (F.col("status") == "running") & (F.col("heartbeat_at") < now - F.expr(f"INTERVAL {minutes} MINUTES"))
    return jobs.withColumn("status", F.when(stale, "queued").otherwise(F.col("status")))


def windowed_counts(stream: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event type over tumbling or sliding windows; later events than ``late`` are dropped."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    agg = stream.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return agg.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")
