"""Scan sessions: a package's plain barcode and its data matrix become one line.

Scans of one item at one place belong to a session as long as each follows the one before within the gap.
In a session a scan goes to the newest line whose lot is the same or blank on either side, and fills what that
line lacks; it overwrites nothing.  Two lots stay two lines.

The stream keeps the scans of open sessions as state.  A session closes when the watermark passes its last
scan by the gap: later scans, which the watermark lets through, cannot belong to it any more.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

LINE = "location_id long, item_id long, lot string, expiration string, n_scans long, first_ts timestamp, last_ts timestamp"
#: A scan: microseconds, number, lot, expiration.
Scan = tuple[int, int, str | None, str | None]


def fold(scans: list[Scan]) -> list[list]:
    """Lines (lot, expiration, scans, first, last) of one session's scans, which are in order."""
    lines: list[list] = []
    for ts, _, lot, expiration in scans:
        for line in reversed(lines):
            if not lot or not line[0] or lot == line[0]:
                line[0], line[1], line[2], line[4] = line[0] or lot, line[1] or expiration, line[2] + 1, ts
                break
        else:
            lines.append([lot or None, expiration or None, 1, ts, ts])
    return lines


def sessions(scans: list[Scan], gap: int) -> list[list[Scan]]:
    out: list[list[Scan]] = []
    for s in sorted(scans, key=lambda s: s[:2]):
        if out and s[0] - out[-1][-1][0] <= gap:
            out[-1].append(s)
        else:
            out.append([s])
    return out


def _frame(key: tuple, lines: list[list]) -> pd.DataFrame:
    stamp = lambda i: pd.to_datetime([x[i] for x in lines], unit="us")
    return pd.DataFrame({"location_id": key[0], "item_id": key[1], "lot": [x[0] for x in lines], "expiration": [x[1] for x in lines], "n_scans": [x[2] for x in lines], "first_ts": stamp(3), "last_ts": stamp(4)})


def _scans(pdf: pd.DataFrame) -> list[Scan]:
    text = lambda c: [x if isinstance(x, str) else None for x in pdf[c]]
    return list(zip(pdf["us"].tolist(), pdf["seq"].tolist(), text("lot"), text("expiration"), strict=True))


def _inputs(scans: DataFrame) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return scans.select("location_id", "item_id", ts.alias("ts"), F.unix_micros(ts).alias("us"), "seq", "lot", F.col("expiration").cast("string").alias("expiration"))


def pair_scans(scans: DataFrame, gap_seconds: int) -> DataFrame:
    """ST04 over a table (location_id, item_id, ts, seq, lot, expiration): the lines of all sessions."""
    rows = _inputs(scans.where("ts IS NOT NULL"))
    order = W.partitionBy("location_id", "item_id").orderBy("ts", "seq")
    new = F.coalesce((F.col("us") - F.lag("us").over(order) > gap_seconds * 1_000_000).cast("int"), F.lit(1))
    rows = rows.withColumn("new", new).withColumn("session", F.sum("new").over(order)).drop("new")

    each = rows.groupBy("location_id", "item_id", "session").agg(F.array_sort(F.collect_list(F.struct("us", "seq", "lot", "expiration"))).alias("scans"))

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(place, item, *line) for place, item, scans in zip(pdf["location_id"], pdf["item_id"], pdf["scans"], strict=True) for line in fold([(x["us"], x["seq"], x["lot"], x["expiration"]) for x in scans])]
            out = pd.DataFrame(found, columns=["location_id", "item_id", "lot", "expiration", "n_scans", "first_ts", "last_ts"])
            yield out.assign(first_ts=pd.to_datetime(out["first_ts"], unit="us"), last_ts=pd.to_datetime(out["last_ts"], unit="us"))

    return each.select("location_id", "item_id", "scans").mapInPandas(lines, LINE).withColumn("expiration", F.col("expiration").cast("date"))


def scan_sessions(stream: DataFrame, gap_seconds: int, late: str = "10 minutes") -> DataFrame:
    """ST04 over a stream: the lines of each session, once, when it closes; scans later than ``late`` are dropped."""
    gap = gap_seconds * 1_000_000

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        pending, passed = [tuple(s) for s in json.loads(state.get[0])] if state.exists else [], state.getCurrentWatermarkMs() * 1000
        if not state.hasTimedOut:
            for pdf in frames:
                pending += [s for s in _scans(pdf) if s[0] > passed]
        still = []
        for s in sessions(pending, gap):
            if s[-1][0] + gap <= passed:
                yield _frame(key, fold(s))
            else:
                still.append(s)
        if still:
            state.update((json.dumps([x for s in still for x in s]),))
            state.setTimeoutTimestamp(max(passed // 1000, -(-(min(s[-1][0] for s in still) + gap) // 1000)) + 1)
        elif state.exists:
            state.remove()

    rows = _inputs(stream).withWatermark("ts", late)
    return rows.groupBy("location_id", "item_id").applyInPandasWithState(step, LINE, "scans string", "append", "EventTimeTimeout").withColumn("expiration", F.col("expiration").cast("date"))
