"""Config validation, defaults, rollups, inventory rules."""

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.operators import inventory as INV
from fleetlens.operators import quality as Q

CFG = T.StructType([
    T.StructField("project", T.StructType([T.StructField("name", T.StringType()),
                                           T.StructField("languages", T.ArrayType(T.StringType())),
                                           T.StructField("rootDir", T.StringType()),
                                           T.StructField("srcDir", T.StringType())])),
    T.StructField("obsidian", T.StructType([T.StructField("strategy", T.StringType())])),
    T.StructField("sync", T.StructType([T.StructField("mode", T.StringType()), T.StructField("lastSyncRef", T.StringType()),
                                        T.StructField("lastSyncAt", T.StringType())])),
])


def test_validate_configs(spark):
    good = {"project": {"name": "x", "languages": ["ts"], "rootDir": "/r", "srcDir": "src"},
            "obsidian": {"strategy": "hybrid"}, "sync": {"mode": "manual"}}
    bad = {"project": {"name": "", "languages": [], "rootDir": "/r", "srcDir": "src"},
           "obsidian": {"strategy": "other"}, "sync": {"mode": "cron"}}
    df = spark.createDataFrame([("good", json.dumps(good)), ("bad", json.dumps(bad))], "project string, j string") \
        .select("project", F.from_json("j", CFG).alias("cfg"))
    r = {x.project: x.issues for x in Q.validate_rows(df, Q.config_rules()).collect()}
    assert r["good"] == []
    assert r["bad"] == ["project.name is required and must be a non-empty string",
                        "project.languages must be a non-empty array",
                        "obsidian.strategy must be one of: embedded, standalone, hybrid",
                        "sync.mode must be one of: manual, git-hook, watch"]


def test_defaults_merge(spark):
    t = T.StructType([T.StructField("a", T.LongType()),
                      T.StructField("n", T.StructType([T.StructField("x", T.StringType()), T.StructField("y", T.StringType())])),
                      T.StructField("arr", T.ArrayType(T.StringType()))])
    df = spark.createDataFrame([('{"n": {"x": "set"}, "arr": ["z"]}',), ('{}',)], "j string").select(F.from_json("j", t).alias("c"))
    out = [r.c for r in Q.with_defaults(df, "c", {"a": 1, "n": {"x": "dx", "y": "dy"}, "arr": ["d"]}, t).collect()]
    assert (out[0].a, out[0].n.x, out[0].n.y, out[0].arr) == (1, "set", "dy", ["z"])
    assert (out[1].a, out[1].n.x, out[1].n.y, out[1].arr) == (1, "dx", "dy", ["d"])


def test_last_sync_and_tally(spark):
    st = spark.createDataFrame([("p", "a", "2024-06-01 12:00:00"), ("p", "b", "2024-05-01 12:00:00")],
                               "project string, key string, t string").withColumn("last_synced_at", F.to_timestamp("t"))
    r = Q.last_sync(st).first()
    assert (r.last_ref, r.last_at) == ("(never)", "2024-06-01T12:00:00.000Z")
    checks = spark.createDataFrame([("p", "a", "pass"), ("p", "b", "warn"), ("p", "c", "fail"), ("p", "d", "pass")],
                                   "project string, check string, level string")
    t = Q.check_tally(checks).first()
    assert (t.passed, t.warnings, t.failures) == (2, 1, 1)


def test_modules_from_files(spark):
    files = spark.createDataFrame([("p", x) for x in ["src/auth/login.ts", "src/auth/deep/x.ts", "src/index.ts",
                                                      "src/readme.md", "lib/util.js", "docs/a.md", "app/web/page.tsx"]],
                                  "project string, path string")
    got = {(r.name, r.path, r.n_files) for r in INV.modules_from_files(files).collect()}
    assert got == {("auth", "src/auth", 2), ("index", "src/index.ts", 1), ("util", "lib/util.js", 1), ("web", "app/web", 1)}


def test_languages_tools_srcdir_name_entries(spark):
    roots = spark.createDataFrame([("js", "package.json"), ("ts", "package.json"), ("ts", "tsconfig.json"),
                                   ("k", "build.gradle.kts"), ("cs", "App.csproj"), ("c", "Makefile"), ("none", "README.md")],
                                  "project string, name string")
    langs = INV.detect_languages(spark, roots)
    got = {}
    for r in langs.collect():
        got.setdefault(r.project, []).append((r.position, r.language))
    got = {k: [l for _, l in sorted(v)] for k, v in got.items()}
    assert got == {"js": ["javascript"], "ts": ["javascript", "typescript"], "k": ["java", "kotlin"],
                   "cs": ["csharp"], "c": ["c", "cpp"]}
    tools = {r.language: r.linter for r in INV.language_tools(
        spark, spark.createDataFrame([("p", "python"), ("p", "cobol")], "project string, language string")).collect()}
    assert tools == {"python": "ruff", "cobol": "not available"}
    files = spark.createDataFrame([("a", "lib/x.ts"), ("a", "app/y.ts"), ("b", "main/z.go"), ("c", "x.ts")],
                                  "project string, path string")
    assert {r.project: r.src_dir for r in INV.source_dir(spark, files).collect()} == {"a": "lib", "b": "main", "c": "."}
    man = spark.createDataFrame([("a", "package.json", '{"name": "pkg-a"}'), ("b", "package.json", "{bad json"),
                                 ("b", "setup.py", "setup(name='py-b')"),
                                 ("c", "pyproject.toml", '[tool.x]\nname = "no"\n[project]\nversion = "1"\nname = "toml-c"\n')],
                                "project string, name string, text string")
    projects = spark.createDataFrame([("a", "dir-a"), ("b", "dir-b"), ("c", "dir-c"), ("d", "dir-d")], "project string, folder string")
    assert {r.project: r.name for r in INV.project_name(man, projects).collect()} == \
        {"a": "pkg-a", "b": "py-b", "c": "toml-c", "d": "dir-d"}
    ef = spark.createDataFrame([("p", x) for x in ["src/index.ts", "main.py", "lib/deep/index.ts", "source/app.js", "x/main.go"]],
                               "project string, path string")
    assert sorted(r.path for r in INV.entry_files(ef).collect()) == ["main.py", "source/app.js", "src/index.ts"]


def test_last_sync_is_utc_in_any_session_zone(spark):
    from datetime import datetime, timezone

    from fleetlens.operators import quality as Q
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        state = spark.createDataFrame([("p", datetime(2024, 6, 1, 12, 0, 0, tzinfo=timezone.utc))],
                                      "project string, last_synced_at timestamp")
        assert Q.last_sync(state).first().last_at == "2024-06-01T12:00:00.000Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_project_name_must_be_a_json_string(spark):
    from fleetlens.operators import inventory as INV
    manifests = spark.createDataFrame(
        [("a", "package.json", '{"name": 123}'), ("a", "setup.py", "setup(name='real')"),
         ("b", "package.json", '{"name": "pkg"}'), ("c", "package.json", "{broken"),
         ("d", "package.json", '{"name": "123"}'), ("e", "package.json", '{"name": null}')],
        "project string, name string, text string")
    projects = spark.createDataFrame([(p, f"folder-{p}") for p in "abcdef"], "project string, folder string")
    got = {r.project: r["name"] for r in INV.project_name(manifests, projects).collect()}
    assert got == {"a": "real", "b": "pkg", "c": "folder-c", "d": "123", "e": "folder-e", "f": "folder-f"}
