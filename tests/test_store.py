"""Published sets and state: empty tables, failures between tables, repeated and late batches."""

import random

import pytest
from pyspark.sql import functions as F

from shelfmark.sources import sinks as S
from shelfmark.streaming import state, store


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_an_empty_table_replaces_rows(spark, tmp_path):
    path, a = str(tmp_path / "t"), spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, v string")
    S.replace(a, path)
    began = S.current(spark, path)  # a reader that has begun
    S.replace(a.where("false"), path)
    assert S.current(spark, path).columns == ["k", "v"] and S.current(spark, path).count() == 0
    assert began.count() == 3
    S.replace(spark.createDataFrame([], "k long, v string"), path)
    assert S.current(spark, path).count() == 0
    with pytest.raises(FileExistsError):  # another writer was first
        store.Published(spark, path).publish(2, {})


def test_a_set_appears_at_once_or_not_at_all(spark, tmp_path):
    root, one = str(tmp_path / "set"), spark.createDataFrame([(1,)], "k long")
    models = lambda value, fails=False: {
        "total_model": (["base_model"], lambda s: s.sql("SELECT sum(k) AS total FROM base_model" if not fails else "SELECT raise_error('lost') AS total FROM base_model")),
        "base_model": ([], lambda s: one.select((F.col("k") * value).alias("k"))),
    }
    with pytest.raises(Exception, match="lost"):
        S.refresh(spark, models(1, fails=True), root)
    with pytest.raises(FileNotFoundError):
        S.current(spark, root, "base_model")
    assert not spark.catalog.tableExists("base_model")
    assert S.refresh(spark, models(5), root) == ["base_model", "total_model"]
    with pytest.raises(Exception, match="lost"):
        S.refresh(spark, models(9, fails=True), root)
    assert _rows(S.current(spark, root, "base_model")) == _rows(spark.table("base_model")) == [(5,)]
    assert _rows(S.current(spark, root, "total_model")) == [(5,)]
    S.refresh(spark, models(7), root)
    assert _rows(spark.table("total_model")) == _rows(S.current(spark, root, "base_model")) == [(7,)]
    S.publish(spark, {"base_model": one.where("false")}, root)  # the other table stays
    assert S.current(spark, root, "base_model").count() == 0 and _rows(S.current(spark, root, "total_model")) == [(7,)]
    assert len(list((tmp_path / "set/tables/base_model").iterdir())) == 2  # what a failure left is gone


def test_commit_resets_automatic_rows(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "run")
    match = lambda *rows: spark.createDataFrame([(a, b, "exact", 80) for a, b in rows], "listing_id string, canonical_id string, status string, confidence int")
    product = lambda *ids: spark.createDataFrame([(i, i.upper()) for i in ids], "canonical_id string, name string")
    read = lambda t, *c: _rows(S.current(spark, root, t).select(*c))
    S.commit_matches(spark, root, match(("l1", "p1"), ("l2", "p1"), ("l3", "p1"), ("l4", "p2")), product("p1", "p2"))
    assert read("match", "listing_id", "canonical_id", "origin") == [("l1", "p1", "auto"), ("l2", "p1", "auto"), ("l3", "p1", "auto"), ("l4", "p2", "auto")] and read("alias", "old_id") == []
    # someone sets l4 by hand, on a product made by hand
    S.publish(spark, {t: S.current(spark, root, t).withColumn("origin", F.when(F.col(k) == v, "manual").otherwise(F.col("origin"))) for t, k, v in (("match", "listing_id", "l4"), ("canonical", "canonical_id", "p2"))}, root)
    S.commit_matches(spark, root, match(("l1", "p3"), ("l2", "p3"), ("l3", "p4"), ("l4", "p4")), product("p3", "p4"))
    assert read("match", "listing_id", "canonical_id", "origin") == [("l1", "p3", "auto"), ("l2", "p3", "auto"), ("l3", "p4", "auto"), ("l4", "p2", "manual")]
    assert read("canonical", "canonical_id", "origin") == [("p2", "manual"), ("p3", "auto"), ("p4", "auto")] and read("alias", "old_id", "canonical_id") == [("p1", "p3")]
    S.commit_matches(spark, root, match(("l1", "p5"), ("l2", "p5")), product("p5"))
    assert read("alias", "old_id", "canonical_id") == [("p1", "p5"), ("p3", "p5")] and read("match", "listing_id") == [("l1",), ("l2",), ("l4",)]
    S.commit_matches(spark, root, match(("l1", "p1")), product("p1"))  # it is back, so it is no alias
    assert read("alias", "old_id", "canonical_id") == [("p3", "p1"), ("p5", "p1")]
    stage = store.Published.stage
    monkeypatch.setattr(store.Published, "stage", lambda self, df, table, number: stage(self, df, table, number) if table != "alias" else 1 / 0)
    with pytest.raises(ZeroDivisionError):
        S.commit_matches(spark, root, match(), product())
    assert read("match", "listing_id", "canonical_id") == [("l1", "p1"), ("l4", "p2")]


def test_state_takes_batches_in_proportion(spark, tmp_path):
    t = store.StateTable(spark, str(tmp_path / "v"), state.merge_events)
    batch = lambda ids: spark.createDataFrame([(i, "x", 5) for i in ids], "event_id long, event_type string, seq long").coalesce(1)
    t.apply(batch(range(20_000)), 0)
    written = []
    stage = t.store.stage
    t.store.stage = lambda df, table, number: written.append(stage(df, table, number)) or written[-1]
    for number in range(1, 17):
        t.apply(batch(range(20_000 + number * 10, 20_010 + number * 10)), number)
        if number % 5 == 0:
            t.apply(batch(range(20_000 + number * 10, 20_010 + number * 10)), number)  # again, after a failure
    t.apply(batch([]), 17)
    t.apply(batch([3, 20_010]), 18)
    assert sorted(r.event_id for r in t.read().collect()) == [*range(20_000), *range(20_010, 20_170)]
    large = t.runs()[0].bytes
    assert max(r.bytes for r in written) < large / 4  # no small batch rewrites the large run
    assert 2 <= len(t.runs()) <= 7 and len(t.store.numbers()) == 2
    assert len(list((tmp_path / "v/tables/state").iterdir())) <= 2 * len(t.runs()) + 1


def test_scans_are_the_same_in_any_order(spark):
    draw = random.Random(2)
    rows = [(draw.randrange(3), "a", draw.randrange(2), draw.choice([None, float(i)]), None, None, i) for i in range(60)]
    scans = state.scan_state(spark.createDataFrame(rows, "item_id long, lot string, location_id long, quantity double, expiration date, pulled_at timestamp, seq long"))
    whole = _rows(state.scan_view(state.merge_scans(None, scans)))
    for order in ((0, 1, 2), (2, 0, 1), (1, 2, 0)):
        folded = None
        for k in order:
            folded = state.merge_scans(folded, scans.where(f"seq % 3 = {k}"))
        assert _rows(state.scan_view(folded)) == whole
    latest = {}
    for item, lot, place, quantity, _, _, seq in rows:
        if quantity is not None:
            latest[item, lot, place] = quantity
    assert {r[:3]: r[3] for r in whole if r[3] is not None} == latest


def test_deletions_expire_with_the_oldest_run(spark, tmp_path):
    day = lambda d: F.lit(f"2024-01-{d:02d}").cast("timestamp")
    write = lambda *rows: spark.createDataFrame(list(rows), "list_id string, item_id long, at string, deleted boolean, payload double").select("list_id", "item_id", F.to_timestamp("at").alias("updated_at"), "deleted", "payload")
    t = store.StateTable(spark, str(tmp_path / "l"), state.merge_lists, lambda rows: state.expired_deletions(rows, day(20), 10))
    t.apply(write(("l", 1, "2024-01-02", True, 0.0), ("l", 2, "2024-01-15", True, 0.0), ("l", 3, "2024-01-03", False, 1.0)), 0)
    t.apply(state.accepted_writes(write(("l", 1, "2024-01-01", False, 9.0), ("l", 2, "2024-01-14", False, 9.0), ("l", 4, "2024-01-19", False, 2.0), ("l", 5, "2024-01-19", False, 2.0)), day(20), 10), 1)
    assert sorted((r.item_id, r.deleted) for r in t.read().collect())[:2] == [(1, True), (2, True)]  # the oldest run is as it was
    t.apply(write(*(("l", 100 + i, f"2024-01-19 00:00:{i:02d}", False, i / 7) for i in range(60))), 2)
    assert len(t.runs()) == 1 and sorted((r.item_id, r.deleted) for r in t.read().collect())[:4] == [(2, True), (3, False), (4, False), (5, False)]


def test_sessions_close_at_the_watermark(spark, tmp_path):
    """Batches with late rows: lines of closed sessions only, as a plain version has them."""
    from shelfmark.streaming import sessions

    draw, day, batches, seq = random.Random(3), 1_704_067_200, [], 0
    for b in range(6):
        rows = []
        for _ in range(40):
            lot = draw.choice([None, None, "A", "B"])
            rows.append((day + b * 900 + draw.randint(-1500, 900), draw.randrange(2), draw.randrange(3), seq, lot, "2027-01-01" if lot and draw.random() < 0.5 else None))
            seq += 1
        batches.append(rows)
    source, gap, late = tmp_path / "in", 120, 600
    schema = "at long, location_id long, item_id long, seq long, lot string, expiration string"
    for b, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source / f"b={b}"))
    stream = spark.readStream.schema(schema + ", b int").option("maxFilesPerTrigger", 1).parquet(str(source)).withColumn("ts", F.timestamp_seconds("at"))
    out = sessions.scan_sessions(stream.drop("at", "b"), gap, f"{late} seconds")
    query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = [(r.location_id, r.item_id, r.lot, str(r.expiration), r.n_scans, r.first, r.last) for r in spark.read.parquet(str(tmp_path / "out")).selectExpr("*", "unix_seconds(first_ts) AS first", "unix_seconds(last_ts) AS last").collect()]
    kept, mark = {}, 0
    for rows in batches:
        for at, place, item, n, lot, expiration in rows:
            if at > mark:
                kept.setdefault((place, item), []).append((at * 1_000_000, n, lot, expiration))
        mark = max([mark, *(r[0] - late for r in rows)])
    want, lost = [], 240 - sum(map(len, kept.values()))
    for key, scans in kept.items():
        for s in sessions.sessions(scans, gap * 1_000_000):
            if s[-1][0] // 1_000_000 + gap <= mark:
                want += [(*key, lot, str(expiration), n, first // 1_000_000, last // 1_000_000) for lot, expiration, n, first, last in sessions.fold(s)]
    assert sorted(got, key=str) == sorted(want, key=str) and lost > 5 and len(want) > 30
    # the table's version, over all scans
    table = spark.createDataFrame([r for b in batches for r in b], schema).withColumn("ts", F.timestamp_seconds("at"))
    got = [(r.location_id, r.item_id, r.lot, r.n_scans) for r in sessions.pair_scans(table, gap).collect()]
    every = {}
    for at, place, item, n, lot, expiration in (r for b in batches for r in b):
        every.setdefault((place, item), []).append((at * 1_000_000, n, lot, expiration))
    want = [(*key, x[0], x[2]) for key, scans in every.items() for s in sessions.sessions(scans, gap * 1_000_000) for x in sessions.fold(s)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_scans_of_one_package():
    from shelfmark.streaming.sessions import fold

    assert fold([(1, 1, None, None), (2, 2, "2640AB", "2026-02-12")]) == [["2640AB", "2026-02-12", 2, 1, 2]]
    assert fold([(1, 1, "L99", "2026-02-12"), (2, 2, None, None)]) == [["L99", "2026-02-12", 2, 1, 2]]
    assert fold([(1, 1, "AAA111", "2026-01-31"), (2, 2, "BBB222", "2027-01-31"), (3, 3, "AAA111", None), (4, 4, "", "2028-01-01")]) == [["AAA111", "2026-01-31", 2, 1, 3], ["BBB222", "2027-01-31", 2, 2, 4]]
