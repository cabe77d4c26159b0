"""Impact rating, document mapping, conflicts and guarded overwrite."""

from pyspark.sql import functions as F

from fleetlens.operators import impact as imp
from fleetlens.operators.mentions import contains_join

SYM = "project string, name string, type string, module string, summary string, " \
      "affected_apis array<string>, affected_modules array<string>"


def _sym(spark, rows):
    return spark.createDataFrame([(p, n, "modified", m, "", [], a) for p, n, m, a in rows], SYM)


def test_report_levels(spark):
    s = _sym(spark, [("hi", "TestSymbol", "auth", []), ("mix", "lower", "a", ["x"]), ("mix", "other", "b", []),
                     ("lo", "lower", "", [])])
    projects = spark.createDataFrame([("hi",), ("mix",), ("lo",), ("none",)], "project string")
    r = {x.project: x for x in imp.impact_report(s, projects=projects).collect()}
    assert r["hi"].impact_level == "high" and r["mix"].impact_level == "medium" and r["lo"].impact_level == "low"
    assert r["none"].impact_level == "low" and r["none"].summary == "No changes detected."
    assert r["lo"].n_modules == 0  # empty module names are left out
    assert sorted(x.module for x in imp.impact_modules(s).where("project = 'mix'").collect()) == ["a", "b"]
    assert r["hi"].summary == "High impact: 1 symbol change(s) across 1 module(s). 0 spec(s) potentially affected."
    rep = imp.change_report(imp.impact_report(s, projects=projects), s)
    got = {(x.section, x.item) for x in rep.where("project = 'lo'").collect()}
    assert ("modules", "(none)") in got and ("specs", "(none)") in got and ("level", "low") in got
    none = {(x.section, x.item) for x in rep.where("project = 'none'").collect()}
    assert ("changes", "(none)") in none and ("summary", "No changes detected.") in none


def test_map_documents_union_dedupe(spark):
    s = _sym(spark, [("p", "Login", "auth", []), ("p", "Other", "", [])])
    docs = spark.createDataFrame([("p", "auth-spec.md", "About AUTH flows"), ("p", "notes.txt", "auth here"),
                                  ("p", "z.md", "nothing")], "project string, name string, text string")
    state = spark.createDataFrame([("p", "auth", ["auth-spec.md", "extra.md"])],
                                  "project string, key string, mapped_specs array<string>")
    got = sorted((r.module, r.spec) for r in imp.map_documents(s, docs, state).collect())
    # the empty module is contained in every .md document
    assert got == [("", "auth-spec.md"), ("", "z.md"), ("auth", "auth-spec.md"), ("auth", "extra.md")]


def test_conflicts_and_guard(spark):
    specs = spark.createDataFrame([("p", "auth.md"), ("p", "manual.md"), ("p", "missing.md")], "project string, spec string")
    docs = spark.createDataFrame([("p", "auth.md", "x " + imp.GENERATED_MARKER), ("p", "manual.md", "hand written")],
                                 "project string, name string, text string")
    c = imp.detect_conflicts(specs, docs).collect()
    assert [(r.spec, r.reason) for r in c] == [("manual.md", 'Spec "manual.md" contains manual edits (not auto-generated)')]
    cands = spark.createDataFrame([("p", "auth.md"), ("p", "manual.md"), ("p", "new.md")], "project string, name string")
    g = {r.name: r.action for r in imp.guarded_overwrite(cands, docs).collect()}
    assert g == {"auth.md": "written", "manual.md": "skipped", "new.md": "written"}


def test_contains_join_matches_brute_force(spark):
    texts = ["The Quick brown fox", "jumps over the lazy dog", "ab", "", "ÉTÉ chaud", "xyz"]
    needles = ["quick", "the", "o", "ab", "", "été", "lazy dog!", "zz", "x"]
    t = spark.createDataFrame(list(enumerate(texts)), "tid int, text string")
    n = spark.createDataFrame(list(enumerate(needles)), "nid int, needle string")
    want = sorted((i, j) for i, x in enumerate(texts) for j, y in enumerate(needles) if y.lower() in x.lower())
    got = sorted((r.tid, r.nid) for r in contains_join(t, n, "text", "needle", text_keys=["tid"], needle_keys=["nid"]).collect())
    assert got == want
    none = n.where("needle <> ''")
    got = sorted((r.tid, r.nid) for r in contains_join(t, none, "text", "needle", text_keys=["tid"], needle_keys=["nid"]).collect())
    assert got == [(i, j) for i, j in want if needles[j]]


def test_contains_join_exchanges_texts_once(spark):
    t = spark.createDataFrame([("p", i, "some text %d" % i) for i in range(9)], "project string, tid int, text string")
    n = spark.createDataFrame([("p", i, "text %d" % i) for i in range(9)], "project string, nid int, needle string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = contains_join(t, n, "text", "needle", group=["project"], text_keys=["tid"], needle_keys=["nid"])
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        # the join that tests the text is the topmost: no other join stands above it, so the text is exchanged once
        joins = [x for x in plan.splitlines() if "Join" in x]
        assert "Contains(_text" in joins[0] and not any("_text" in x for x in joins[1:])
        assert out.count() == 9
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
