"""Stored runs, copied ranges, folder sizes, ordered output, variant defaults."""

import json
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import conform as C
from fleetlens.operators import inventory as INV
from fleetlens.operators import ordered as O
from fleetlens.operators import quality as Q
from fleetlens.operators.runs import RunStore, approaching, compare_runs, files_digest

FINDING = "project string, rule string, subject string, severity string"


def test_only_committed_runs_count(spark):
    store = RunStore(spark, tempfile.mkdtemp(prefix="fleetlens-runs-") + "/r")
    one = spark.createDataFrame([("p", "cycle", "a", "BLOCK")], FINDING)
    assert store.last() is None
    store.commit(0, {"findings": one})
    one.write.parquet(f"{store.path}/findings/run=1")  # a run that stopped before its marker
    assert store.last() == 0 and store.last(before=0) is None and not store.committed(1)
    with pytest.raises(ValueError):
        store.read("findings", 1)
    for _ in range(2):  # written again, it is replaced
        store.commit(1, {"findings": one.union(one).distinct()})
    assert store.last() == 1 and store.last(before=1) == 0 and store.read("findings", 1).count() == 1


def test_findings_between_runs(spark):
    before = spark.createDataFrame([("p", "cycle", "a", "BLOCK"), ("p", "orphan", "b", "INFO"), ("q", "cycle", "a", "BLOCK")], FINDING)
    now = spark.createDataFrame([("p", "cycle", "a", "WARN"), ("p", "cycle", "c", "BLOCK"), ("p", "cycle", "c", "BLOCK")], FINDING)
    got = {(r.project, r.rule, r.subject): (r.severity, r.state) for r in compare_runs(now, before).collect()}
    assert got == {("p", "cycle", "a"): ("WARN", "kept"), ("p", "cycle", "c"): ("BLOCK", "new"),
                   ("p", "orphan", "b"): ("INFO", "resolved"), ("q", "cycle", "a"): ("BLOCK", "resolved")}
    assert compare_runs(now.limit(0), now.limit(0)).count() == 0


def test_approaching_a_threshold(spark):
    m = lambda rows: spark.createDataFrame(rows, "project string, name string, n long")
    now = m([("p", "near", 45), ("p", "same", 45), ("p", "far", 39), ("p", "over", 51), ("p", "at", 50), ("p", "fresh", 41)])
    before = m([("p", "near", 44), ("p", "same", 45), ("p", "far", 1), ("p", "over", 20), ("p", "at", 49)])
    assert {(r.name, r.now, r.before) for r in approaching(now, before, "n", 50).collect()} == {
        ("near", 45, 44), ("at", 50, 49), ("fresh", 41, 0)}


def test_files_digest_follows_the_files(spark):
    root = tempfile.mkdtemp(prefix="fleetlens-digest-")
    spark.range(3).write.parquet(f"{root}/t")
    one = files_digest(spark, [f"{root}/t"])
    assert one == files_digest(spark, [f"{root}/t"])
    spark.range(3).write.mode("append").parquet(f"{root}/t")
    assert one != files_digest(spark, [f"{root}/t"])


def test_copied_ranges_match_brute_force(spark):
    rnd = random.Random(4)
    shared = [[f"shared {k} {i}" for i in range(n)] for k, n in enumerate((6, 9, 25))]
    texts = {}
    for d in range(30):
        lines = [f"own {d} {i}" for i in range(rnd.randrange(8))]
        for k in rnd.sample(range(3), rnd.randrange(4)):
            part = shared[k] if rnd.random() < 0.7 else shared[k][rnd.randrange(4):]
            lines += part + [f"sep {d} {k}"]
        texts[d] = "\n".join(lines)
    texts[40], texts[41], texts[42] = texts[3], "", None
    texts[43] = "\n".join(["same"] * 20)
    texts[44] = "\n".join(["same"] * 9)
    places = {}
    split = {d: t.split("\n") for d, t in texts.items() if t is not None}
    for d, ls in split.items():
        for i in range(len(ls) - 5):
            places.setdefault("\n".join(ls[i:i + 6]), []).append((d, i + 1))
    spots = set()
    for found in places.values():
        if len({d for d, _ in found}) > 1:
            rd, rl = min(found)
            spots |= {(d, rd, i, i - rl) for d, i in found if d != rd}
    want = set()
    for d, rd, i, diag in spots:
        if (d, rd, i - 1, diag) not in spots:
            j = i
            while (d, rd, j + 1, diag) in spots:
                j += 1
            want.add((d, rd, i, j + 5, i - diag))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = [(r.doc_id, r.representative, r.first_line, r.last_line, r.first_line_there) for r in C.copied_ranges(df, "doc_id").collect()]
    assert sorted(got) == sorted(want) and len(got) > 20
    for d, rd, a, b, there in got:  # the lines are the same
        assert split[d][a - 1:b] == split[rd][there - 1:there + b - a]


def test_folder_sizes_of_every_prefix(spark):
    rows = [("p", "a/b/c.ts", 1), ("p", "a/b/d.ts", 2), ("p", "a/e.ts", 4), ("p", "f.ts", 8), ("q", "a/b/c.ts", 16), ("p", "ab/x", 32)]
    df = spark.createDataFrame(rows, "project string, path string, size long")
    got = {(r.project, r.folder): (r.n_files, r.n_bytes) for r in INV.folder_sizes(df).collect()}
    assert got == {("p", ""): (5, 47), ("p", "a"): (3, 7), ("p", "a/b"): (2, 3), ("p", "ab"): (1, 32), ("q", ""): (1, 16),
                   ("q", "a"): (1, 16), ("q", "a/b"): (1, 16)}
    assert {(r.project, r.n_bytes) for r in INV.size_below(df, "a/").collect()} == {("p", 7), ("q", 16)}


def test_order_by_code_unit_and_locale(spark):
    names = ["é", "b", "C", "_x", "B", "a"]
    df = spark.createDataFrame([(g, n) for g in ("p", None) for n in names] + [("p", "b")], "project string, name string").repartition(3)

    def order(keys):
        rows = O.with_positions(df, keys).collect()
        out = [[r.name for r in sorted((r for r in rows if r.project == g), key=lambda r: r.position)] for g in ("p", None)]
        assert sorted(r.position for r in rows if r.project == "p") == list(range(1, 8))
        return out
    assert order(["name"]) == [["B", "C", "_x", "a", "b", "b", "é"], ["B", "C", "_x", "a", "b", "é"]]
    assert order([O.by_locale("name"), "name"]) == [["_x", "a", "b", "b", "B", "C", "é"], ["_x", "a", "b", "B", "C", "é"]]


def test_written_order_and_no_single_task_sort(spark):
    path = tempfile.mkdtemp(prefix="fleetlens-ordered-") + "/t"
    df = spark.range(5000).select(F.lit("hot").alias("project"), F.format_string("f%05d", (F.col("id") * 7919) % 5000).alias("name"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        O.write_ordered(df, path, ["name"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    back = spark.read.parquet(path)
    assert back.where("name <> format_string('f%05d', position - 1)").count() == 0 and back.count() == 5000
    assert back.select(F.input_file_name()).distinct().count() > 1


def merged(target, over):
    """The rule itself: objects are merged, all else is replaced."""
    out = dict(target)
    for k, v in over.items():
        out[k] = merged(target[k], v) if isinstance(v, dict) and isinstance(target.get(k), dict) else v
    return out


def test_variant_defaults_match_the_rule(spark):
    defaults = {"a": 1, "b": {"c": [1, 2], "d": {"e": "x", "f": None}}, "g": {}}
    given = [{}, {"a": None}, {"b": None}, {"b": 3}, {"b": {"c": []}}, {"b": {"d": {"e": 0, "n": {"o": 1}}, "z": True}}, {"g": {"h": 1}},
             {"new": {"deep": {"er": [None, {"x": 1}]}}}, {"a": {"obj": 1}, "b": {"d": []}}, {"b": {"d": {"f": {"now": "object"}}}}]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(given)] + [(99, None)], "i int, v string")
    got = {r.i: json.loads(r.m) for r in df.select("i", F.to_json(Q.merge_defaults(F.parse_json("v"), defaults)).alias("m")).collect()}
    assert got == {**{i: merged(defaults, v) for i, v in enumerate(given)}, 99: defaults}
