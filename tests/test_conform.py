"""Conformance checks on small inputs, compared with plain Python."""

from pyspark.sql import functions as F

from fleetlens.operators import conform as C


def test_documented_vs_actual(spark):
    d = spark.createDataFrame([("p", "m", "api", "a"), ("p", "m", "api", "b")], "project string, module string, kind string, name string")
    a = spark.createDataFrame([("p", "m", "api", "b"), ("p", "m", "api", "c")], "project string, module string, kind string, name string")
    got = {r.name: r.status for r in C.documented_vs_actual(d, a).collect()}
    assert got == {"a": "GAP", "b": "MATCH", "c": "DRIFT"}


def test_severity_and_verdict(spark):
    issues = spark.createDataFrame([("p", "cycle", "a"), ("q", "orphan", "x"), ("q", "god_module", "g")],
                                   "project string, rule string, subject string")
    f = C.with_severity(issues)
    assert {r.rule: r.severity for r in f.collect()} == {"cycle": "BLOCK", "orphan": "INFO", "god_module": "WARN"}
    projects = spark.createDataFrame([("p",), ("q",), ("r",)], "project string")
    v = {r.project: (r.n_block, r.n_warn, r.n_info, r.verdict) for r in C.verdict(f, projects).collect()}
    assert v == {"p": (1, 0, 0, "FAIL"), "q": (0, 1, 1, "PASS"), "r": (0, 0, 0, "PASS")}
    prev = spark.createDataFrame([("p", "cycle", "a")], "project string, rule string, subject string")
    assert [r.rule for r in C.new_findings(f, prev).orderBy("rule").collect()] == ["god_module", "orphan"]


def test_removed_exports(spark):
    old = spark.createDataFrame([("p", "m", "a"), ("p", "m", "b"), ("p", "m", "c")], "project string, module string, export string")
    new = spark.createDataFrame([("p", "m", "a")], "project string, module string, export string")
    dep = spark.createDataFrame([("p", "m", "c")], "project string, module string, export string")
    assert [r.export for r in C.removed_without_deprecation(old, new, dep).collect()] == ["b"]


def test_wiki_links(spark):
    notes = spark.createDataFrame([("p", "a", "see [[b]] and [[missing|alias]] and [[a]]"), ("p", "b", "no links")],
                                  "project string, name string, text string")
    links = C.extract_links(notes)
    assert sorted(r.target for r in C.broken_links(links, notes).collect()) == ["missing"]
    mods = spark.createDataFrame([("p", "a"), ("p", "c")], "project string, name string")
    assert [(r.subject, r.severity) for r in C.modules_without_note(mods, notes).collect()] == [("c", "INFO")]


TEXTS = {
    1: "x\n" + "\n".join(f"line{i}" for i in range(8)) + "\nend",
    2: "\n".join(f"line{i}" for i in range(2, 9)),
    3: "only\nfive\nlines\nhere\nnow",
    4: "password = \"hunter2hunter2\"\nq = \"SELECT * FROM t WHERE id=\" + id\nitems.push(x)\nfine",
}


def _docs(spark):
    return spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")


def test_copied_blocks_brute_force(spark):
    blocks = {}
    for d, t in TEXTS.items():
        ls = t.split("\n")
        for i in range(len(ls) - 5):
            blocks.setdefault("\n".join(ls[i:i + 6]), []).append(d)
    want = {b: (len(set(ds)), len(ds)) for b, ds in blocks.items() if len(set(ds)) >= 2}
    import hashlib
    want = {hashlib.sha256(b.encode()).hexdigest(): v for b, v in want.items()}
    got = {r.block_hash: (r.n_docs, r.n_places) for r in C.copied_blocks(_docs(spark), ["doc_id"]).collect()}
    assert got == want and len(got) == 1


def test_line_rules_and_sizes(spark):
    lines = C.text_lines(_docs(spark), ["doc_id"])
    f = sorted((r.doc_id, r.line_no, r.rule, r.action) for r in C.line_findings(lines, ["doc_id"]).collect())
    assert f == [(4, 1, "hardcoded_secret", "BLOCK"), (4, 2, "sql_concatenation", "BLOCK"), (4, 3, "mutation_call", "WARN")]
    assert [r.doc_id for r in C.long_texts(_docs(spark), ["doc_id"], max_lines=8).collect()] == [1]


def test_checklist_and_month_index(spark):
    docs = spark.createDataFrame([(1, "- [x] a\n- [ ] b"), (2, "- [x] a\n- [X] b\ntext")], "doc_id long, text string")
    c = {r.doc_id: (r.n_tasks, r.n_done, r.complete) for r in C.checklist_completion(C.text_lines(docs, ["doc_id"]), ["doc_id"]).collect()}
    assert c == {1: (2, 1, False), 2: (2, 2, True)}
    items = spark.createDataFrame([("a", "2026-05-01"), ("b", "2026-05-20"), ("c", "2026-06-02")], "name string, d string") \
        .withColumn("ts", F.to_timestamp("d"))
    m = {r.month: (r.n_items, r.first_item, r.last_item) for r in C.month_index(items, "ts", "name").collect()}
    assert m == {"2026-05": (2, "a", "b"), "2026-06": (1, "c", "c")}


def test_forbidden_crossings(spark):
    core = spark.createDataFrame([("p", "a → b", "auth", "db"), ("p", "a → c", "auth", "ui")],
                                 "project string, route string, source_boundary string, module string")
    zones = spark.createDataFrame([("auth", "core"), ("db", "core"), ("ui", "edge")], "boundary string, zone string")
    got = [(r.route, r.target_boundary, r.severity) for r in C.forbidden_crossings(core, zones).collect()]
    assert got == [("a → c", "ui", "BLOCK")]
