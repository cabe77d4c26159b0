"""init -> change -> sync -> status -> checks on a six-file project (two projects in one fleet)."""

from datetime import datetime

from pyspark.sql import functions as F

from fleetlens.operators import impact as imp
from fleetlens.operators import inventory as INV
from fleetlens.operators import quality as Q
from fleetlens.operators import snapshot as snap
from fleetlens.operators import structure as S

OLD = [("src/index.ts", "import { helper } from './utils/helper'"), ("src/utils/helper.ts", "export function helper() {}"),
       ("src/auth/login.ts", "export function login() {}"), ("src/db/query.ts", "export function query() {}"),
       ("package.json", '{"name": "demo"}'), ("tsconfig.json", "{}")]


def _snapshot(spark, files, projects=("a", "b")):
    rows = [(p, path, content) for p in projects for path, content in files]
    return spark.createDataFrame(rows, "project string, path string, content string") \
        .withColumn("content_hash", F.sha2("content", 256))


def test_fleet_sync_cycle(spark):
    old = _snapshot(spark, OLD)
    new_files = [(p, c + " // v2" if p == "src/auth/login.ts" else c) for p, c in OLD] + \
        [("src/api/handler.ts", "export function handler() {}")]
    new = _snapshot(spark, new_files, projects=("a",)).unionByName(_snapshot(spark, OLD, projects=("b",)))

    # init: modules, boundaries, languages
    mods = INV.modules_from_files(new.select("project", "path"))
    assert {r.name for r in mods.where("project = 'a'").collect()} == {"index", "utils", "auth", "db", "api"}
    langs = INV.detect_languages(spark, INV.root_entries(new.select("project", "path")))
    assert sorted(r.language for r in langs.where("project = 'a'").collect()) == ["javascript", "typescript"]
    b = {r.boundary: r.n_modules for r in S.boundaries(mods.where("project = 'a'")).collect()}
    assert b == {"root": 1, "utils": 1, "auth": 1, "db": 1, "api": 1}

    # sync: diff, symbols, impact, documents, conflicts
    changes = snap.pair_renames(snap.diff_snapshots(old, new))
    assert sorted((r.project, r.path, r.status) for r in changes.collect()) == [
        ("a", "src/api/handler.ts", "added"), ("a", "src/auth/login.ts", "modified")]
    sym = snap.symbols_from_changes(changes)
    docs = spark.createDataFrame([("a", "auth.md", "The AUTH module. " + imp.GENERATED_MARKER),
                                  ("a", "api.md", "hand-written notes on the api")],
                                 "project string, name string, text string")
    specs = imp.map_documents(sym, docs=docs)
    projects = spark.createDataFrame([("a",), ("b",)], "project string")
    rep = {r.project: r for r in imp.impact_report(sym, specs, projects).collect()}
    assert (rep["a"].impact_level, rep["a"].n_changes, rep["a"].n_modules, rep["a"].n_specs) == ("high", 2, 2, 2)
    assert rep["b"].summary == "No changes detected."
    conf = imp.detect_conflicts(specs, docs).collect()
    assert [(r.project, r.spec) for r in conf] == [("a", "api.md")]

    # state upsert from the changed files' new hashes, stale entries
    t0 = datetime(2024, 1, 1)
    state = spark.createDataFrame([("a", "auth", "old", t0, ["auth.md"], []), ("a", "gone", "x", t0, [], [])],
                                  "project string, key string, last_hash string, last_synced_at timestamp, "
                                  "mapped_specs array<string>, mapped_nodes array<string>")
    src = snap.infer_source_files(sym, new.select("project", "path"))
    upd = src.join(new.select("project", F.col("path").alias("source_path"), "content_hash"), ["project", "source_path"]) \
        .select("project", F.col("module").alias("key"), F.col("content_hash").alias("hash"), F.col("path").alias("ordinal"))
    st = {r.key: r for r in snap.upsert_state(state, upd, "2024-06-01 12:00:00").collect()}
    assert st["auth"].mapped_specs == ["auth.md"] and st["auth"].last_hash != "old"
    assert st["api"].last_synced_at == datetime(2024, 6, 1, 12) and st["gone"].last_hash == "x"
    present = mods.select("project", F.col("name").alias("key"))
    stale = snap.stale_entries(snap.upsert_state(state, upd, "2024-06-01 12:00:00"), present)
    assert [r.key for r in stale.collect()] == ["gone"]

    # status and checks
    s = Q.status_rollup(projects, [Q.count_by(changes, "active_changes"), Q.count_by(stale, "n_stale")],
                        ["active_changes", "n_stale"])
    checks = (Q.check_rows(s, "consistent", F.when(F.col("n_stale") == 0, "pass").otherwise("warn"))
              .unionByName(Q.check_rows(s, "synced", F.when(F.col("active_changes") == 0, "pass").otherwise("warn"))))
    tally = {r.project: (r.passed, r.warnings, r.failures) for r in Q.check_tally(checks).collect()}
    assert tally == {"a": (0, 2, 0), "b": (2, 0, 0)}
