"""The append-mode watcher, the sync runs it drives, and the bucketed state."""

import glob
import os
import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetlens.sources import state as ST
from fleetlens.sources.buckets import BucketTable
from fleetlens.streaming import watcher as W
from fleetlens.streaming.sync import sync_handler, sync_state

T0 = datetime(2024, 1, 1)
EVENT = "project string, ts timestamp, path string"


def events(spark, rows):
    return spark.createDataFrame([(p, T0 + timedelta(seconds=s), f) for p, s, f in rows], EVENT).coalesce(1)


def folder():
    return tempfile.mkdtemp(prefix="fleetlens-watch-")


def arrive(spark, base, rows, gap=10, delay="20 seconds", **kw):
    """Event files arrive, a run of the watcher takes them; returns the query."""
    n = len(glob.glob(f"{base}/in/*"))
    events(spark, rows).write.parquet(f"{base}/in/{n}")
    stream = W.watch_source(spark, f"{base}/in", EVENT)
    q = W.watch(stream, f"{base}/out", gap, delay, f"{base}/ckpt", **kw)
    q.awaitTermination()
    assert q.exception() is None
    return q


def simple_batches(rows, gap):
    """[(project, start, end, {path: first})] of a sorted list of events"""
    out = []
    for p in sorted({r[0] for r in rows}):
        for _, s, f in sorted((r for r in rows if r[0] == p), key=lambda r: r[1]):
            if not out or out[-1][0] != p or s - out[-1][2] > gap:
                out.append([p, s, s, {}])
            out[-1][2] = s
            out[-1][3].setdefault(f, s)
    return out


def test_items_of_closed_batches_appear_once(spark):
    base = folder()
    parts = [[("a", 0, "src/x.ts"), ("a", 8, "src/y.ts"), ("a", 8, "lib/no.ts"), ("b", 3, "src/x.ts"), ("a", 40, "src/x.ts")],
             [("a", 45, "src/x.ts"), ("a", 55, "src/z.py"), ("b", 60, "src/dist/no.ts"), ("b", 90, "src/x.ts")],
             [("c", 500, "src/end.ts"), ("c", 560, "src/end.ts")]]
    for rows in parts:
        arrive(spark, base, rows)
    got = [(r.key, r.batch_start, r.batch_end, r.item, r.first_seen) for r in W.watched(spark, f"{base}/out").collect()]
    watched = [r for rows in parts for r in rows if r[2].startswith("src/") and "dist" not in r[2]]
    at = lambda s: T0 + timedelta(seconds=s)
    want = [(p, at(s), at(e), f, at(first)) for p, s, e, items in simple_batches(watched, 10) for f, first in items.items()
            if p != "c"]  # no complete cell lies behind it yet
    assert sorted(got) == sorted(want)
    counts = {(r.key, r.batch_start): r.n_events for r in W.watched(spark, f"{base}/out", "batches").collect()}
    assert counts[("a", at(40))] == 3


def test_a_key_that_is_never_quiet_has_bounded_state(spark):
    """An event every five seconds, each for another file: one batch for all
    of them, and the state holds only what the watermark keeps open."""
    base, held = folder(), []
    for part in range(5):
        rows = [("busy", 5 * i, f"src/f{i}.ts") for i in range(100 * part, 100 * part + 100)]
        q = arrive(spark, base, rows)
        held.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    spans = spark.read.parquet(f"{base}/out/spans")
    assert spans.groupBy("epoch").count().where("count > 1").count() == 0 and spans.where("done = 'true'").count() == 0
    assert max(held) <= (20 + 2 * 10) // 5 + 1 and W.watched(spark, f"{base}/out").count() == 0
    arrive(spark, base, [("other", 5000, "src/a.ts"), ("other", 5100, "src/a.ts")])
    items = W.watched(spark, f"{base}/out")
    assert items.count() == 500 and items.select("batch_start").distinct().count() == 1


def test_batch_twin_and_long_batches(spark):
    rows = [("p", s, f"src/{s % 7}.ts") for s in range(0, 3 * 86400, 50)] + [("p", 4 * 86400, "src/a.ts"), (None, 5, "src/a.ts")]
    ev = events(spark, rows)
    cells = W.item_cells(ev, 60, None)
    batches = W.batch_spans(cells, 60)
    got = {(r.key, r.item): (r.n_events, r.batch_end) for r in W.batch_items(batches, cells, 60).collect() if r.batch_start.day < 5}
    end = T0 + timedelta(seconds=max(s for _, s, _ in rows if s < 4 * 86400))
    assert got.pop((None, "src/a.ts"))[0] == 1
    assert len(got) == 7 and {e for _, e in got.values()} == {end}
    assert sum(n for n, _ in got.values()) == len(range(0, 3 * 86400, 50))


def test_a_replayed_micro_batch_changes_nothing(spark):
    base = folder()
    cells = [W.item_cells(events(spark, rows), 10, None) for rows in
             ([("a", 0, "x"), ("a", 5, "y")], [("a", 12, "x"), ("a", 400, "z")], [("a", 900, "w")])]
    for epoch, c in enumerate(cells):
        once = [sorted(map(tuple, df.collect())) for df in W.close_batches(c, epoch, base, 10)]
        again = [sorted(map(tuple, df.collect())) for df in W.close_batches(c, epoch, base, 10)]
        assert once == again
    assert sorted((r.item, r.n_events) for r in W.watched(spark, base).collect()) == [("x", 2), ("y", 1), ("z", 1)]


def test_start_position_skips_the_backlog(spark):
    base = folder()
    events(spark, [("a", 0, "src/old.ts")]).write.parquet(f"{base}/in/0")
    since = W.start_position(spark, f"{base}/in")
    os.utime(f"{base}/in/0")  # a folder's time does not matter
    events(spark, [("a", 9, "src/new.ts"), ("a", 9, "docs/new.md")]).write.parquet(f"{base}/in/1")
    stream = W.watch_source(spark, f"{base}/in", EVENT, since)
    q = stream.writeStream.format("memory").queryName("later").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.path for r in spark.table("later").collect()] == ["src/new.ts"]


def snapshot(spark, rows):
    return spark.createDataFrame(rows, "project string, path string, content_hash string")


def test_sync_reads_do_not_grow_with_epochs(spark, monkeypatch):
    old = snapshot(spark, [(f"p{i}", f"src/m{i}/a.ts", "h") for i in range(300)])
    new = snapshot(spark, [(f"p{i}", f"src/m{i}/a.ts", f"h{i}") for i in range(300)])
    state = spark.createDataFrame([(f"p{i}", f"m{i}", "h", T0, ["s.md"], []) for i in range(300)],
                                  "project string, key string, last_hash string, last_synced_at timestamp, "
                                  "mapped_specs array<string>, mapped_nodes array<string>")
    files, out = [], folder()
    monkeypatch.setattr(BucketTable, "read", lambda self, version=None, only=None, f=BucketTable.read:
                        (files.append(len(f(self, version, only).inputFiles())), f(self, version, only))[1])
    handle = sync_handler(old, new, state, out, buckets=32)
    for epoch in range(8):
        batch = spark.createDataFrame([("p7", T0, T0 + timedelta(hours=epoch), "src/m7/a.ts"),
                                       (f"p{epoch}", T0, T0 + timedelta(hours=epoch), f"src/m{epoch}/a.ts")],
                                      "project string, batch_start timestamp, batch_end timestamp, path string")
        handle(batch.distinct(), epoch)
    assert len(files) == 8 and max(files) <= 2
    got = {r.key: r for r in sync_state(state, out, buckets=32).collect()}
    assert len(got) == 300 and got["m7"].last_hash == "h7" and got["m7"].last_synced_at == T0 + timedelta(hours=7)
    assert got["m3"].last_synced_at == T0 + timedelta(hours=3) and got["m3"].mapped_specs == ["s.md"] and got["m200"].last_hash == "h"
    reports = spark.read.parquet(f"{out}/report")
    assert reports.where("epoch = 5").count() == 2 and reports.where("n_changes <> 1").count() == 0


def test_watcher_drives_sync_runs_and_keeps_failed_batches(spark):
    base = folder()
    old = snapshot(spark, [("p", "src/auth/login.ts", "a"), ("p", "src/db/query.ts", "b")])
    new = snapshot(spark, [("p", "src/auth/login.ts", "a2"), ("p", "src/api/x.ts", "x")])
    state = spark.createDataFrame([], "project string, key string, last_hash string, last_synced_at timestamp, "
                                      "mapped_specs array<string>, mapped_nodes array<string>")
    handle = sync_handler(old, new, state, f"{base}/sync")
    arrive(spark, base, [("p", 0, "src/auth/login.ts"), ("p", 5, "src/db/query.ts"), ("p", 60, "src/api/x.ts"), ("q", 60, "src/no.ts"),
                         ("z", 200, "src/z.ts"), ("p", 300, "src/auth/login.ts")], on_batches=handle)
    reports = {(r.project, r.batch_start): (r.n_changes, r.n_modules, r.impact_level)
               for r in spark.read.parquet(f"{base}/sync/report").collect()}
    assert reports == {("p", T0): (2, 2, "high"), ("p", T0 + timedelta(seconds=60)): (1, 1, "high"),
                       ("q", T0 + timedelta(seconds=60)): (0, 0, "low")}
    assert {(r.key, r.last_hash) for r in sync_state(state, f"{base}/sync").collect()} == {("auth", "a2"), ("api", "x")}

    def broken(items, epoch):
        raise ValueError("boom")
    arrive(spark, base, [("p", 900, "src/auth/login.ts")], on_batches=broken)
    kept = spark.read.parquet(f"{base}/ckpt-failures").collect()
    assert {(r.path, r.error) for r in kept} == {("src/z.ts", "ValueError: boom")}


def test_a_fleet_of_projects_is_as_many_files_as_buckets(spark):
    out = folder() + "/state"
    rows = spark.range(100_000).select(
        F.concat(F.lit("p"), "id").alias("project"), F.lit("k").alias("key"), F.lit("h").alias("last_hash"),
        F.lit(T0).alias("last_synced_at"), F.array(F.lit("a.md")).alias("mapped_specs"), F.array().cast("array<string>").alias("mapped_nodes"))
    assert len(ST.write_state(rows, out, buckets=16)) == 16
    files = lambda v: glob.glob(f"{out}/version={v}/bucket=*/*.parquet")
    assert len(files(0)) == 16
    few = rows.where("project IN ('p3', 'p77')")
    touched = ST.write_state(few.withColumn("last_hash", F.lit("h2")).withColumn("key", F.lit("other")), out, buckets=16)
    assert 1 <= len(touched) <= 2 and len(files(1)) == len(touched)
    now = ST.read_state_table(spark, out, buckets=16)
    assert now.count() == 100_000 and {(r.project, r.key) for r in now.where("last_hash = 'h2'").collect()} == {("p3", "other"), ("p77", "other")}


def test_bucket_table_versions(spark):
    path = folder() + "/t"
    df = lambda rows: spark.createDataFrame(rows, "project string, n int")
    t = BucketTable(spark, path, df([]).schema, buckets=4)
    assert t.latest() is None and t.latest(before=3) is None
    t.write(df([("a", 1), ("b", 1), (None, 1)]), 0)
    swap = lambda current, new: current.join(new, "project", "left_anti").unionByName(new)
    for _ in range(2):  # a version written again gives the same table
        t.merge(df([("a", 2)]), 1, swap)
    t.merge(df([("a", 3), ("c", 3)]), 2, swap)
    rows = lambda v=None: sorted(((r.project or "", r.n) for r in t.read(v).collect()))
    assert rows(0) == [("", 1), ("a", 1), ("b", 1)] and rows(1) == [("", 1), ("a", 2), ("b", 1)]
    assert rows() == [("", 1), ("a", 3), ("b", 1), ("c", 3)]
    t.merge(df([("a", 0), ("b", 0), ("c", 0), (None, 0)]), 3, lambda current, new: current.limit(0))
    assert rows() == [] and t.versions() == [0, 1, 2, 3]
    t.merge(df([("a", 9)]), 4, swap)
    assert rows() == [("a", 9)]
    t.vacuum(keep=1)
    assert rows() == [("a", 9)] and t.versions() == [4]
    with pytest.raises(ValueError):
        BucketTable(spark, path, df([]).schema, buckets=8).read()


def test_sync_stream_without_a_closed_batch(spark):
    """A project that is never quiet: no batch closes, so there is no report
    and the state is the one before."""
    from fleetlens.plans import inputs as I
    from fleetlens.plans.catalog import QUERIES
    d = folder()
    spark.range(40).selectExpr("id AS doc_id", "'en' AS lang", "'web' AS source", "concat('text ', id) AS text").write.parquet(f"{d}/documents.parquet")
    spark.range(400).selectExpr("id AS event_id", "timestamp_seconds(1704067200 + id * 60) AS ts").write.parquet(f"{d}/events.parquet")
    got = QUERIES["sync_stream"](spark, d).collect()
    want = I.module_state(I.old_files(spark, d), I.T_OLD).collect()
    assert {(r.kind, r.project, r.key, r.value, r.n_changes) for r in got} == {("state", r.project, r.key, r.last_hash, None) for r in want}
    assert len(got) == len(want) > 0
