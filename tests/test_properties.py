"""Property checks on random small inputs (hypothesis)."""

from datetime import datetime

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetlens.operators import snapshot as snap
from fleetlens.operators.mentions import contains_join

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))

paths = st.sampled_from([f"src/m{i % 3}/f{i}.ts" for i in range(8)])
contents = st.sampled_from(["a", "b", "c", ""])
snapshots = st.dictionaries(paths, contents, max_size=6)


def _df(spark, snapshot):
    return spark.createDataFrame([("p", k, v) for k, v in snapshot.items()] or [("p", "x", "x")],
                                 "project string, path string, content string") \
        .where(F.lit(bool(snapshot))).withColumn("content_hash", F.sha2("content", 256))


@SETTINGS
@given(a=snapshots, b=snapshots)
def test_diff_properties(spark, a, b):
    da, db = _df(spark, a), _df(spark, b)
    assert snap.diff_snapshots(da, da).count() == 0
    ab = {(r.path, r.status) for r in snap.diff_snapshots(da, db).collect()}
    want = {(p, "added") for p in b if p not in a} | {(p, "removed") for p in a if p not in b} | \
        {(p, "modified") for p in a if p in b and a[p] != b[p]}
    assert ab == want
    flip = {"added": "removed", "removed": "added", "modified": "modified"}
    ba = {(r.path, r.status) for r in snap.diff_snapshots(db, da).collect()}
    assert ab == {(p, flip[s]) for p, s in ba}


@SETTINGS
@given(updates=st.lists(st.tuples(st.sampled_from(["k1", "k2", "k3"]), st.sampled_from(["h1", "h2"]),
                                   st.integers(0, 9)), max_size=6))
def test_upsert_idempotent(spark, updates):
    t = datetime(2024, 1, 1)
    state = spark.createDataFrame([("p", "k1", "h0", t, ["s.md"], [])],
                                  "project string, key string, last_hash string, last_synced_at timestamp, "
                                  "mapped_specs array<string>, mapped_nodes array<string>")
    upd = spark.createDataFrame([("p", k, h, o) for k, h, o in updates] or [("p", "k1", "h0", 0)],
                                "project string, key string, hash string, ordinal int").where(F.lit(bool(updates)))
    once = snap.upsert_state(state, upd, "2024-06-01 00:00:00")
    twice = snap.upsert_state(once, upd, "2024-06-01 00:00:00")
    rows = lambda df: sorted((r.key, r.last_hash, r.mapped_specs) for r in df.collect())
    assert rows(once) == rows(twice)
    assert {r.key for r in once.collect()} == {"k1"} | {k for k, _, _ in updates}


words = st.text(alphabet="abcAB -.", max_size=12)


@SETTINGS
@given(texts=st.lists(words, min_size=1, max_size=5), needles=st.lists(words, min_size=1, max_size=5))
def test_contains_join_random(spark, texts, needles):
    t = spark.createDataFrame(list(enumerate(texts)), "tid int, text string")
    n = spark.createDataFrame(list(enumerate(needles)), "nid int, needle string")
    got = sorted((r.tid, r.nid) for r in contains_join(t, n, "text", "needle", text_keys=["tid"],
                                                        needle_keys=["nid"]).collect())
    want = sorted((i, j) for i, x in enumerate(texts) for j, y in enumerate(needles) if y.lower() in x.lower())
    assert got == want
