"""Debounced batches (batch and stream), sessionize, state and doc I/O."""

import json
import os
import tempfile
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from fleetlens.sources import files as FS
from fleetlens.sources import state as ST
from fleetlens.streaming import debounce as D

T0 = datetime(2024, 1, 1, 0, 0, 0)


def _events(spark, rows):
    return spark.createDataFrame([("p", T0 + timedelta(milliseconds=ms), path, "change") for ms, path in rows],
                                 "project string, ts timestamp, path string, event string")


def test_source_filter(spark):
    ev = _events(spark, [(0, "src/a.ts"), (0, "node_modules/should-be-ignored.ts"), (0, "src/node_modules/x.ts"),
                         (0, "src/readme.md"), (0, "lib/a.ts"), (0, "src/deep/b.py")])
    assert sorted(r.path for r in D.file_events(ev).collect()) == ["src/a.ts", "src/deep/b.py"]


def test_debounce_batch(spark):
    ev = _events(spark, [(0, "src/a.ts"), (10, "src/b.ts"), (20, "src/c.ts"), (20, "src/a.ts")])
    b = D.debounced_batches(ev, gap="200 milliseconds").collect()
    assert len(b) == 1 and b[0].items == ["src/a.ts", "src/b.ts", "src/c.ts"] and b[0].n_events == 4
    ev2 = _events(spark, [(0, "src/x.ts"), (300, "src/y.ts")])
    assert sorted(r.items[0] for r in D.debounced_batches(ev2, gap="100 milliseconds").collect()) == ["src/x.ts", "src/y.ts"]
    # a gap equal to the quiet period still joins the batch
    ev3 = _events(spark, [(0, "src/x.ts"), (500, "src/y.ts")])
    assert D.debounced_batches(ev3).count() == 1


def test_stream_equals_batch(spark):
    rows = [(0, "src/a.ts"), (100, "src/b.ts"), (5000, "src/c.ts"), (5100, "src/a.ts"), (9000, "src/d.ts")]
    ev = _events(spark, rows)
    folder = tempfile.mkdtemp(prefix="fleetlens-ev-")
    ev.write.mode("overwrite").parquet(os.path.join(folder, "in"))
    stream = spark.readStream.schema(ev.schema).parquet(os.path.join(folder, "in"))
    batches = D.debounced_batches(stream, gap="1 second", watermark="1 second")
    path = D.stream_to_table(spark, batches, "t", output_mode="complete")
    got = sorted((r.n_events, tuple(r.items)) for r in spark.read.parquet(path).collect())
    want = sorted((r.n_events, tuple(r.items)) for r in D.debounced_batches(ev, gap="1 second").collect())
    assert got == want and len(got) == 3


def test_failed_batches_are_kept_and_replayed(spark):
    ev = _events(spark, [(0, "src/a.ts"), (5000, "src/b.ts")])
    folder = tempfile.mkdtemp(prefix="fleetlens-ev-")
    ev.write.parquet(os.path.join(folder, "in"))

    def handler(df, epoch):
        raise ValueError("boom")
    stream = spark.readStream.schema(ev.schema).parquet(os.path.join(folder, "in"))
    q = D.run_on_batches(D.debounced_batches(stream, gap="1 second", watermark="1 second"), handler,
                         os.path.join(folder, "ckpt"), output_mode="complete")
    q.awaitTermination()
    assert q.exception() is None
    failures = os.path.join(folder, "ckpt-failures")
    assert {r.error for r in spark.read.parquet(failures).collect()} == {"ValueError: boom"}
    seen = []
    assert D.replay_failed(spark, failures, lambda df, epoch: seen.extend(i for r in df.collect() for i in r["items"]))
    assert sorted(set(seen)) == ["src/a.ts", "src/b.ts"]


def test_engine_errors_fail_the_query(spark):
    ev = _events(spark, [(0, "src/a.ts")])
    folder = tempfile.mkdtemp(prefix="fleetlens-ev-")
    ev.write.parquet(os.path.join(folder, "in"))

    def handler(df, epoch):  # the job itself breaks
        df.select(F.raise_error(F.lit("disk gone"))).collect()
    stream = spark.readStream.schema(ev.schema).parquet(os.path.join(folder, "in"))
    q = D.run_on_batches(D.debounced_batches(stream, gap="1 second", watermark="1 second"), handler,
                         os.path.join(folder, "ckpt"), output_mode="complete")
    try:
        q.awaitTermination()
    except Exception as e:  # noqa: BLE001
        assert "disk gone" in str(e)
    assert q.exception() is not None


def test_sessionize_equals_session_window_at_a_fifth_of_a_second(spark):
    ev = _events(spark, [(0, "src/a.ts"), (200, "src/b.ts"), (401, "src/c.ts"), (601, "src/d.ts"), (900, "src/e.ts")])
    got = sorted(r.n_events for r in D.sessionize(ev, ["project"], "ts", 0.2).collect())
    want = sorted(r.n_events for r in D.debounced_batches(ev, gap="200 milliseconds").collect())
    assert got == want == [1, 2, 2]


def test_sessionize_matches_simple_rule(spark):
    import random
    rnd = random.Random(1)
    rows, t = [], 0.0
    for _ in range(300):
        t += rnd.choice([1, 5, 50, 200, 4000, 90000])
        rows.append(("u" + str(rnd.randrange(3)), T0 + timedelta(seconds=t)))
    df = spark.createDataFrame(rows, "user string, ts timestamp")
    got = sorted((r.user, r.session_start, r.n_events) for r in D.sessionize(df, ["user"], "ts", 600, bucket_seconds=3600).collect())
    want = []
    for u in sorted({r[0] for r in rows}):
        ts = sorted(x[1] for x in rows if x[0] == u)
        start, n, prev = ts[0], 0, ts[0]
        for x in ts:
            if (x - prev).total_seconds() > 600:
                want.append((u, start, n)); start, n = x, 0
            n += 1; prev = x
        want.append((u, start, n))
    assert got == sorted(want)


def test_state_roundtrip_and_docs(spark):
    root = tempfile.mkdtemp(prefix="fleetlens-state-")
    os.makedirs(os.path.join(root, "proj-a"))
    with open(os.path.join(root, "proj-a", "sync-state.json"), "w") as f:
        json.dump({"entries": {"auth": {"lastHash": "h", "lastSyncedAt": "2024-06-01T12:00:00.000Z",
                                        "mappedSpecs": ["auth.md"], "mappedObsidianNodes": []}}}, f)
    os.makedirs(os.path.join(root, "proj-b"))
    with open(os.path.join(root, "proj-b", "sync-state.json"), "w") as f:
        json.dump({"version": 1}, f)
    s = ST.read_state(spark, os.path.join(root, "*", "sync-state.json"))
    rows = s.collect()
    assert [(r.project, r.key, r.last_hash, r.mapped_specs) for r in rows] == [("proj-a", "auth", "h", ["auth.md"])]
    assert ST.read_state(spark, os.path.join(root, "missing", "x.json")).count() == 0
    out = os.path.join(root, "table")
    ST.write_state(s, out)
    assert spark.read.parquet(out).count() == 1
    docs = os.path.join(root, "docs")
    os.makedirs(docs)
    for n, t in [("a.md", "alpha"), ("b.md", "beta"), ("c.txt", "no")]:
        with open(os.path.join(docs, n), "w") as f:
            f.write(t)
    d = FS.read_docs(spark, docs, "spec", project="p", strip_extension=True)
    assert sorted((r.name, r.text) for r in d.collect()) == [("a", "alpha"), ("b", "beta")]
    assert FS.read_docs(spark, os.path.join(root, "nope"), "spec").count() == 0


def test_read_tree(spark):
    root = tempfile.mkdtemp(prefix="fleetlens-tree-")
    for rel, content in [("p1/src/a.ts", "A"), ("p1/src/x/b.ts", "B"), ("p2/lib/c.js", "C"), ("p2/docs/d.md", "D"),
                         ("README", "not in a project")]:
        os.makedirs(os.path.dirname(os.path.join(root, rel)), exist_ok=True)
        with open(os.path.join(root, rel), "w") as f:
            f.write(content)
    t = FS.read_tree(spark, root, ref="HEAD", roots=["src", "lib"])
    got = sorted((r.project, r.path, r.size) for r in t.collect())
    assert got == [("p1", "src/a.ts", 1), ("p1", "src/x/b.ts", 1), ("p2", "lib/c.js", 1)]
    import hashlib
    assert t.where(F.col("path") == "src/a.ts").first().content_hash == hashlib.sha256(b"A").hexdigest()


def test_stream_append_mode_closed_batches(spark):
    rows = [(0, "src/a.ts"), (100, "src/b.ts"), (5000, "src/c.ts"), (9000, "src/d.ts"), (60000, "src/e.ts")]
    ev = _events(spark, rows)
    folder = tempfile.mkdtemp(prefix="fleetlens-ev-")
    ev.write.mode("overwrite").parquet(os.path.join(folder, "in"))
    stream = spark.readStream.schema(ev.schema).parquet(os.path.join(folder, "in"))
    batches = D.debounced_batches(stream, gap="1 second", watermark="1 second")
    path = D.stream_to_table(spark, batches, "t", output_mode="append")
    got = sorted(tuple(r.items) for r in spark.read.parquet(path).collect())
    # append emits only batches closed by the watermark: the last one is still open
    assert got == [("src/a.ts", "src/b.ts"), ("src/c.ts",), ("src/d.ts",)]


def test_sync_per_batch(spark):
    from fleetlens.streaming.sync import sync_handler
    mk = lambda rows: spark.createDataFrame(rows, "project string, path string, content string") \
        .withColumn("content_hash", F.sha2("content", 256))
    old = mk([("p", "src/auth/login.ts", "a"), ("p", "src/db/query.ts", "b")])
    new = mk([("p", "src/auth/login.ts", "a2"), ("p", "src/db/query.ts", "b2"), ("p", "src/api/x.ts", "x")])
    state = spark.createDataFrame([("p", "auth", "h", T0, ["auth.md"], [])],
                                  "project string, key string, last_hash string, last_synced_at timestamp, "
                                  "mapped_specs array<string>, mapped_nodes array<string>")
    # the watcher saw only login.ts and x.ts change: query.ts is out of this batch
    ev = _events(spark, [(0, "src/auth/login.ts"), (100, "src/api/x.ts")])
    folder = tempfile.mkdtemp(prefix="fleetlens-sync-")
    ev.write.parquet(os.path.join(folder, "in"))
    stream = spark.readStream.schema(ev.schema).parquet(os.path.join(folder, "in"))
    out = os.path.join(folder, "out")
    q = D.run_on_batches(D.debounced_batches(stream, gap="1 second", watermark="1 second"),
                         sync_handler(old, new, state, out, "2024-06-01 12:00:00"),
                         os.path.join(folder, "ckpt"), output_mode="complete")
    q.awaitTermination()
    rep = spark.read.parquet(os.path.join(out, "report")).collect()
    assert [(r.project, r.n_changes, r.n_modules, r.impact_level) for r in rep] == [("p", 2, 2, "high")]
    from fleetlens.streaming.sync import sync_state
    st = {r.key: r for r in sync_state(state, out).collect()}
    assert set(st) == {"auth", "api"} and st["auth"].mapped_specs == ["auth.md"]


def test_sync_state_chains_across_batches(spark):
    from fleetlens.streaming.sync import sync_handler
    mk = lambda rows: spark.createDataFrame(rows, "project string, path string, content string") \
        .withColumn("content_hash", F.sha2("content", 256))
    old = mk([("p", "src/auth/login.ts", "a"), ("p", "src/db/query.ts", "b")])
    new = mk([("p", "src/auth/login.ts", "a2"), ("p", "src/db/query.ts", "b2")])
    state = spark.createDataFrame([], "project string, key string, last_hash string, last_synced_at timestamp, "
                                      "mapped_specs array<string>, mapped_nodes array<string>")
    out = tempfile.mkdtemp(prefix="fleetlens-chain-")
    from fleetlens.streaming.sync import sync_state
    batch = lambda path: spark.createDataFrame([("p", [path])], "project string, items array<string>")
    sync_handler(old, new, state, out, "2024-06-01 12:00:00")(batch("src/auth/login.ts"), 0)
    first = sync_state(state, out).collect()
    # a new handler, as after a restart, on a snapshot that has moved on
    newer = mk([("p", "src/auth/login.ts", "a2"), ("p", "src/db/query.ts", "b3")])
    moved = {"new": new}
    handle = sync_handler(old, lambda: moved["new"], state, out, "2024-06-01 13:00:00")
    moved["new"] = newer
    for _ in range(2):  # a replayed batch changes nothing
        handle(batch("src/db/query.ts"), 1)
    got = {r.key: r for r in sync_state(state, out).collect()}
    assert sorted(got) == ["auth", "db"] and [r.key for r in first] == ["auth"]
    assert got["db"].last_hash == newer.where("path = 'src/db/query.ts'").first().content_hash
    assert spark.read.parquet(os.path.join(out, "state", "epoch=1")).count() == 1  # only what the batch changed


def test_sinks(spark):
    import json as _json
    from fleetlens.operators import impact as imp
    from fleetlens.sources import sinks as SK
    root = tempfile.mkdtemp(prefix="fleetlens-sinks-")
    cands = spark.createDataFrame([("p", "auth.md", "new auth"), ("p", "manual.md", "new manual"), ("q", "x.md", "x")],
                                  "project string, name string, content string")
    existing = spark.createDataFrame([("p", "auth.md", "old " + imp.GENERATED_MARKER), ("p", "manual.md", "hand made")],
                                     "project string, name string, text string")
    out = os.path.join(root, "docs")
    SK.write_guarded(imp.guarded_overwrite(existing.withColumnRenamed("text", "content"), existing.limit(0)), out, 1)
    for version in (2, 2):  # repeating a version changes nothing
        rep = SK.write_guarded(imp.guarded_overwrite(cands, existing), out, version)
    assert {(r.name, r.action) for r in rep.collect()} == {("auth.md", "written"), ("manual.md", "skipped"),
                                                            ("x.md", "written")}
    table = spark.read.parquet(os.path.join(out, "documents"))
    now = {(r.project, r.name): r.content for r in SK.latest_documents(table).collect()}
    assert now == {("p", "auth.md"): "new auth", ("p", "manual.md"): "hand made", ("q", "x.md"): "x"}
    header = spark.createDataFrame([("p", "high", 2)], "project string, impact_level string, n_changes long")
    lines = spark.createDataFrame([("p", "A", "added", "- **A** (added): added file src/a.ts")],
                                  "project string, name string, type string, line string")
    for run in ("r1", "r2", "r2"):
        SK.write_reports(header, lines, os.path.join(root, "reports"), run)
    assert sorted((r.run, r.project) for r in spark.read.json(os.path.join(root, "reports", "lines")).collect()) == [
        ("r1", "p"), ("r2", "p")]
    js = SK.status_json(header).first().json
    assert _json.loads(js) == {"project": "p", "impact_level": "high", "n_changes": 2}
