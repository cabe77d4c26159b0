"""Snapshot diff, renames, state diff, upsert and stale entries."""

from datetime import datetime

from pyspark.sql import functions as F

from fleetlens.operators import impact as imp
from fleetlens.operators import snapshot as snap


def _files(spark, rows):
    return spark.createDataFrame(rows, "project string, path string, content string").withColumn(
        "content_hash", F.sha2("content", 256))


OLD = [("p", "src/index.ts", "import { helper }"), ("p", "src/utils/helper.ts", "export function helper"),
       ("p", "src/auth/login.ts", "export function login"), ("p", "src/db/query.ts", "export function query")]


def test_diff_added_modified(spark):
    new = OLD[:1] and [("p", "src/index.ts", "import { helper } // changed")] + OLD[1:] + [
        ("p", "src/api/handler.ts", "export function handler")]
    d = snap.diff_snapshots(_files(spark, OLD), _files(spark, new))
    got = sorted((r.path, r.status) for r in d.collect())
    assert got == [("src/api/handler.ts", "added"), ("src/index.ts", "modified")]


def test_diff_empty_and_mirror(spark):
    a = _files(spark, OLD)
    assert snap.diff_snapshots(a, a).count() == 0
    b = _files(spark, OLD[1:] + [("p", "src/new.ts", "x")])
    ab = {(r.path, r.status) for r in snap.diff_snapshots(a, b).collect()}
    ba = {(r.path, r.status) for r in snap.diff_snapshots(b, a).collect()}
    flip = {"added": "removed", "removed": "added", "modified": "modified"}
    assert ab == {(p, flip[s]) for p, s in ba}


def test_diff_path_filter(spark):
    new = [("p", "src/index.ts", "changed"), ("p", "src/auth/login.ts", "changed too")]
    d = snap.diff_snapshots(_files(spark, OLD), _files(spark, new), path_filter=["auth"])
    assert sorted((r.path, r.status) for r in d.collect()) == [("src/auth/login.ts", "modified")]


def test_renames(spark):
    old = _files(spark, [("p", "src/a.ts", "same"), ("p", "src/b.ts", "dup"), ("p", "src/c.ts", "dup")])
    new = _files(spark, [("p", "src/moved/a.ts", "same"), ("p", "src/d.ts", "dup")])
    r = snap.pair_renames(snap.diff_snapshots(old, new))
    got = sorted((x.path, x.status, x.previous_path) for x in r.collect())
    # 'dup' is not unique among the removed files, so no rename for it
    assert got == [("src/b.ts", "removed", None), ("src/c.ts", "removed", None),
                   ("src/d.ts", "added", None), ("src/moved/a.ts", "renamed", "src/a.ts")]


def _state(spark, rows):
    return spark.createDataFrame(
        rows, "project string, key string, last_hash string, last_synced_at timestamp, "
              "mapped_specs array<string>, mapped_nodes array<string>")


def test_state_diff(spark):
    t = datetime(2024, 1, 1)
    old = _state(spark, [("p", "keep.ts", "h", t, [], []), ("p", "modified.ts", "old", t, [], []),
                         ("p", "removed.ts", "r", t, [], []), ("p", "a.ts", "h1", t, ["x.md"], [])])
    new = _state(spark, [("p", "keep.ts", "h", t, [], []), ("p", "modified.ts", "new", t, [], []),
                         ("p", "added.ts", "f", t, [], []), ("p", "a.ts", "h1", t, ["y.md"], [])])
    got = sorted((r.key, r.status) for r in snap.diff_state(old, new).collect())
    assert got == [("added.ts", "added"), ("modified.ts", "modified"), ("removed.ts", "removed")]


def test_upsert_keeps_mappings_and_last_wins(spark):
    t = datetime(2024, 1, 1)
    state = _state(spark, [("p", "auth", "old", t, ["auth-spec.md"], ["node-1"]), ("p", "db", "d", t, [], [])])
    upd = spark.createDataFrame([("p", "auth", "h-a", "src/auth/a.ts"), ("p", "auth", "h-b", "src/auth/b.ts"),
                                 ("p", "new", "h-n", "src/new/x.ts")], "project string, key string, hash string, ordinal string")
    out = {r.key: r for r in snap.upsert_state(state, upd, "2024-06-01 12:00:00").collect()}
    assert out["auth"].last_hash == "h-b" and out["auth"].mapped_specs == ["auth-spec.md"]
    assert out["auth"].mapped_nodes == ["node-1"] and out["auth"].last_synced_at == datetime(2024, 6, 1, 12)
    assert out["db"].last_hash == "d" and out["db"].last_synced_at == t
    assert out["new"].mapped_specs == []
    # idempotent: applying the same updates again changes nothing but nothing breaks
    again = snap.upsert_state(snap.upsert_state(state, upd, "2024-06-01 12:00:00"), upd, "2024-06-01 12:00:00")
    assert {r.key: r.last_hash for r in again.collect()} == {k: v.last_hash for k, v in out.items()}


def test_stale(spark):
    t = datetime(2024, 1, 1)
    state = _state(spark, [("p", "src/gone.ts", "h", t, [], []), ("p", "src/here.ts", "h", t, [], [])])
    files = spark.createDataFrame([("p", "src/here.ts")], "project string, path string")
    assert [r.key for r in snap.stale_entries(state, files, present_key="path").collect()] == ["src/gone.ts"]


def test_infer_source_files(spark):
    files = spark.createDataFrame([("p", "src/auth/login.ts"), ("p", "src/auth/user-service.js"),
                                   ("p", "src/auth/login.js"), ("p", "src/index"), ("p", "src/auth/deep/x.ts")],
                                  "project string, path string")
    ch = spark.createDataFrame([("p", "src/auth/login.ts", "modified"), ("p", "src/auth/user-service.js", "added"),
                                ("p", "src/index", "modified"), ("p", "src/auth/deep/x.ts", "added"),
                                ("p", "lib/top.ts", "added")], "project string, path string, status string")
    sym = snap.symbols_from_changes(ch)
    got = {r.path: r.source_path for r in snap.infer_source_files(sym, files).collect()}
    assert got == {"src/auth/login.ts": "src/auth/login.ts", "src/auth/user-service.js": "src/auth/user-service.js",
                   "src/index": "src/index"}


def test_symbols_and_classes(spark):
    ch = spark.createDataFrame([("p", "src/b.ts", "added"), ("p", "src/a.ts", "added"), ("p", "src/c.ts", "removed")],
                               "project string, path string, status string")
    sym = snap.symbols_from_changes(ch)
    r = sym.where(F.col("path") == "src/c.ts").first()
    assert (r.name, r.type, r.module, r.summary) == ("C", "removed", "c", "removed file src/c.ts")
    c = imp.classify_changes(sym).first()
    assert (c.n_added, c.n_modified, c.n_removed, c.n_renamed) == (2, 0, 1, 0)


def test_bucketed_snapshots_diff_without_shuffle(spark):
    from fleetlens.sources.files import write_snapshot
    old = _files(spark, OLD).select("project", "path", "content_hash")
    new = _files(spark, OLD[1:] + [("p", "src/new.ts", "x")]).select("project", "path", "content_hash")
    write_snapshot(old, "snap_old_t", 4)
    write_snapshot(new, "snap_new_t", 4)
    d = snap.diff_snapshots(spark.table("snap_old_t"), spark.table("snap_new_t"))
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan, plan
    assert sorted((r.path, r.status) for r in d.collect()) == [("src/index.ts", "removed"), ("src/new.ts", "added")]


def test_filter_paths_pattern_table(spark):
    ch = spark.createDataFrame([("p", x, "added") for x in ["src/auth/login.ts", "src/db/q.ts", "src/Auth/x.ts",
                                                            "lib/a.ts"]] + [("q", "src/auth/z.ts", "added")],
                               "project string, path string, status string")
    pats = spark.createDataFrame([("p", "auth"), ("p", "lib/"), ("q", "db")], "project string, pattern string")
    got = sorted((r.project, r.path) for r in snap.filter_paths(ch, pats).collect())
    assert got == [("p", "lib/a.ts"), ("p", "src/auth/login.ts")]
