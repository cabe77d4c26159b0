"""Operators 11 to 13: hard negatives, approximate neighbours, the manifest."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import hard_negatives as H
from fleetlens.llm import merkle as M
from fleetlens.llm import multi_index as I

CLASH = {"row": 1, "dim": 2, "v": 3, "codes": 4, "score": 0.5, "rank": 6, "query": 7, "anchor": 8, "slot": 9, "lowest": 10,
         "uppers": 11, "split": 12, "group": 13, "lead": 14, "part": 15, "found": 16, "vec": 17, "at": 18, "id": "x",
         "tree": 19, "pos": 20, "n": 21, "kids": 22, "digest": 23, "item": 24, "subroot": 25, "leaf": 26, "root": 27,
         "_at": 28, "_part": 29, "_tree": 30, "_group": 31, "changed": 32}


def clashing(df):
    return df.withColumns({c: F.lit(x) for c, x in CLASH.items()})


def vector_rows(n=240, dim=6, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=dim), 2)], int(rng.integers(0, 3))) for i in range(n)]
    rows += [(1000 + i, rows[0][1], 0) for i in range(40)]  # copies of an anchor and query
    rows += [(50, [0.5] * dim, 1), (50, [0.5] * dim, 1), (7, rows[7][1], rows[7][2])]  # repeated ids and rows
    rows += [(2000, None, 1), (2050, [], 1), (2100, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (2150, [float("nan")] * dim, 0),
             (2200, [float("inf")] + [0.0] * (dim - 1), 2), (2250, [0.0] * dim, 1), (None, [1.0] * dim, 1), (2300, [1.0] * dim, None),
             (2350, [3.0, 4.0], 1), (2351, [4.0, 3.0], 1), (2352, [4.0, 3.0], 0), (2400, [2.0], 1)]
    return rows


@pytest.fixture(scope="module")
def vectors(spark):
    return clashing(spark.createDataFrame(vector_rows(), "vec_id long, embedding array<float>, label int")).repartition(5)


def fine(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v)


# --- 11 -------------------------------------------------------------------

def brute_negatives(rows, k_pos, k_neg, low, high):
    took = [(n, i, np.floor(256 * np.float32(v).astype(np.float64)).astype(np.int64), lab)
            for n, (i, v, lab) in enumerate(rows) if i is not None and lab is not None and fine(v)]
    out = []
    for a, i, v, lab in took:
        if i % 50:
            continue
        near = [(-int(v @ w), j, n, other) for n, j, w, other in took if n != a and len(w) == len(v)]
        for ps, pid, *_ in sorted(x for x in near if x[3] == lab)[:k_pos]:
            window = sorted((s, j) for s, j, _, other in near if other != lab and low * -ps <= 100 * -s <= high * -ps)
            out += [(i, pid, rank + 1, j, -ps, -s) for rank, (s, j) in enumerate(window[:k_neg])]
    return sorted(out)


def mined(df, **kw):
    v = H.labelled_vectors(df, id_col="vec_id", vector_col="embedding", label=F.col("label"), scale=256)
    return sorted(tuple(r) for r in H.mine_hard_negatives(v, F.col("id") % 50 == 0, **kw).collect())


@pytest.mark.parametrize("kw", [{"positives": 5, "negatives": 3, "low": 50, "high": 95},
                                {"positives": 9, "negatives": 2, "low": 0, "high": 100},
                                {"positives": 3, "negatives": 400, "low": 10, "high": 60}])
def test_negatives_match_brute_force(vectors, monkeypatch, kw):
    for tile in (32 << 20, 8 * 6 * 50):  # one tile, many tiles
        monkeypatch.setattr(H, "TILE_BYTES", tile)
        monkeypatch.setattr(H, "CHUNK_ROWS", 64)
        got = mined(vectors, **kw)
        assert got == brute_negatives(vector_rows(), *kw.values()) and got


def test_slots_are_disjoint_and_merge_to_all_windows():
    rng = np.random.default_rng(1)
    scores = rng.integers(-50, 200, size=(1, 500))
    uppers, k = np.array([[150, 90, 40]]), 4
    slots = H.Slots(uppers, np.array([10]), k)
    ids = np.arange(500)
    for at in range(0, 500, 60):
        slots.add(scores[:, at:at + 60], ids[at:at + 60], np.ones((1, len(ids[at:at + 60])), bool))
    _, slot, score, got = slots.kept
    for j, upper in enumerate(uppers[0]):
        want = sorted((-s, i) for s, i in zip(scores[0], ids) if 10 <= s <= upper)[:k]
        assert sorted((-s, i) for s, i in zip(score[slot >= j], got[slot >= j]))[:k] == want


def test_negatives_stay_exact_for_large_components(spark):
    rows = [(i, [float(2**(21 - i % 2) + 7 * i), float(3 * i - 2**21)], i % 2) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = mined(df)
    exact = {i: [int(256 * x) for x in v] for i, v, _ in rows}
    want = []
    for i, _, lab in rows:
        if i % 50 == 0:
            near = [(-sum(a * b for a, b in zip(exact[i], exact[j])), j, other) for j, _, other in rows if j != i]
            for ps, pid, _ in sorted(x for x in near if x[2] == lab)[:5]:
                window = sorted((s, j) for s, j, other in near if other != lab and 50 * -ps <= 100 * -s <= 95 * -ps)
                want += [(i, pid, rank + 1, j, -ps, -s) for rank, (s, j) in enumerate(window[:3])]
    assert got == sorted(want) and any(abs(r[5]) > 1 << 53 for r in got)


def test_negatives_of_nothing(spark, vectors):
    assert mined(vectors.limit(0)) == []
    assert mined(vectors.where("label = 1")) == []  # no other label
    with pytest.raises(ValueError):
        mined(vectors, low=95, high=50)


# --- 12 -------------------------------------------------------------------

def brute_nearest(rows, k, every):
    took = [(n, i, np.array(v, np.float32).astype(np.float64)) for n, (i, v, _) in enumerate(rows)
            if i is not None and fine(v) and any(v)]
    out = {}
    for a, i, v in took:
        if i % every == 0:
            near = sorted((-round(float(v @ w / np.sqrt((v @ v) * (w @ w))), 12), j) for n, j, w in took
                          if n != a and len(w) == len(v))
            out.setdefault(i, []).append(near[:k])
    return out


def found_lists(df, k, every=50):
    got = {}
    for r in I.nearest(df, F.col("id") % every == 0, id_col="vec_id", vector_col="embedding", k=k).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return got


@pytest.mark.parametrize("region", [8192, 16])
def test_neighbours_and_edge_cases(vectors, monkeypatch, region):
    """Short codes: the radius covers them, so the lists are exact."""
    monkeypatch.setattr(I, "REGION_ROWS", region)
    monkeypatch.setattr(I, "QUERY_ROWS", 3)
    monkeypatch.setattr(I, "SAFETY", 6.0)
    got, want = found_lists(vectors, 5), brute_nearest(vector_rows(), 5, 50)
    assert set(got) == {i for i, lists in want.items() if any(lists)}
    for i, lists in want.items():
        mine = sorted(got.get(i, []))
        assert [x[0] for x in mine] == sorted(r + 1 for x in lists for r in range(len(x)))
        assert sorted((-round(s, 12), j) for _, j, s in mine) == sorted(x for near in lists for x in near)


def test_recall_of_isotropic_and_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(I, "REGION_ROWS", 512)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 48))
    sets = {"isotropic": rng.normal(size=(4000, 48)), "clustered": centres[rng.integers(0, 40, 4000)] + 0.15 * rng.normal(size=(4000, 48))}
    for name, x in sets.items():
        df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        got = found_lists(df, 5)
        unit = x / np.linalg.norm(x, axis=1)[:, None]
        hits = 0
        for q in range(0, 4000, 50):
            s = unit @ unit[q]
            s[q] = -9
            hits += sum(score >= np.sort(s)[-5] - 1e-9 for _, _, score in got[q])
            assert all(abs(s[j] - score) < 1e-9 for _, j, score in got[q])
        assert hits / 400 >= 0.95, (name, hits / 400)


def test_pigeonhole_finds_every_code_within_the_radius():
    rng = np.random.default_rng(2)
    model = I.fit(I.unit_vectors(rng.normal(size=(500, 40))))
    codes = model.encode(I.unit_vectors(rng.normal(size=(300, 40))))
    for r in (0, 1, 3, 7, 12, 20):
        share = (r - np.arange(model.tables)) // model.tables
        for q in codes[:20]:
            apart = I._COUNT[codes ^ q]
            assert ((apart <= share).any(axis=1) | (apart.sum(axis=1) > r)).all()


def test_router_names_all_regions_that_can_match():
    for lead in (0, 1, 4, 16):
        route = I._router(lead).func
        import pandas as pd
        got = set(route(pd.Series([np.array([0xABCD, 0x1234])]), pd.Series([5]))[0].tolist())
        for j, c in enumerate((0xABCD, 0x1234)):
            top = c >> (16 - lead)
            want = {(j << 16) | x for x in range(1 << lead) if (x ^ top).bit_count() <= (5 - j) // 2}
            assert {x for x in got if x >> 16 == j} == want


def test_cosines_of_extreme_lengths(spark):
    rows = [(0, [1e-200, 0.0]), (1, [1e200, 1e200]), (2, [-3e-300, 1e-300]), (3, [5e-324, 0.0])]
    got = found_lists(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 3)
    assert [j for _, j, _ in sorted(got[0])] == [3, 1, 2]
    assert abs(sorted(got[0])[1][2] - 0.5**0.5) < 1e-12


def test_neighbours_of_nothing(vectors):
    assert found_lists(vectors.limit(0), 5) == {}
    assert found_lists(vectors.where("vec_id = 100"), 5) == {}  # nobody else


# --- 13 -------------------------------------------------------------------

def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def record(*fields):
    return h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields])


def brute_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)"""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, record(*r), r))

    def climb(nodes):
        """levels of nodes, the last of one"""
        levels = [nodes]
        while len(levels[-1]) > 1:
            last = levels[-1]
            levels.append([h(*last[i:i + 16]) for i in range(0, len(last), 16)])
        return levels

    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in order}
    top = climb([trees[s][-1][0] for s in order])

    def way(levels, pos):
        for level in levels[:-1]:
            run = level[pos // 16 * 16:pos // 16 * 16 + 16]
            yield run, pos % 16
            pos //= 16

    out = []
    for s in order:
        for pos, (_, _, leaf, r) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            path = [*way(trees[s], pos), *way(top, order.index(s))]
            now = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                text = None if r[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
                now = record(*r[:4], text)
            for run, slot in path:
                now = h(*run[:slot], now, *run[slot + 1:])
            root = top[-1][0]
            out.append((r[0], leaf, trees[s][-1][0], root, h(*[x for run, slot in path for x in run[:slot] + run[slot + 1:]]),
                        now, now == root))
    return sorted(out, key=str)


def manifest_of(df):
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    bad = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, M.record_digest(*fields, low))
    m = M.build_manifest(df, group_col="source", order_col="doc_id", leaf=M.record_digest(*fields, F.col("text")), changed=bad,
                         keep=["doc_id"])
    return m, sorted((tuple(r) for r in M.verify_manifest(m).collect()), key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def manifest_rows():
    rows = [(i, "hot", "en", i, f"Text {i} ÄÖ \U0001f600") for i in range(600)]
    rows += [(i, f"s{i % 23}", None if i % 3 else "de", None, None if i % 5 == 0 else "") for i in range(700, 760)]
    rows += [(800, None, "en", 1, "Null source"), (None, "hot", "en", 1, "No id"), (None, None, None, None, None),
             (801, "one", "en", 5, "Alone"), (900, "twin", "en", 5, "Same Row"), (900, "twin", "en", 5, "Same Row"),
             (901, "twin", "en", 5, "A"), (901, "twin", "en", 5, "B"), (902, "", "en", 0, "X" * 200_000), (-3, "é", "x", -1, "Neg")]
    rows += [(950, "copies", "en", 3, "Copy")] * 40
    rows += [(i, "seventeen", "en", 3, "T") for i in range(2000, 2017)]
    return rows


def test_manifest_matches_hashlib(spark):
    rows = manifest_rows()
    df = clashing(spark.createDataFrame(rows, SCHEMA)).repartition(7)
    m, got = manifest_of(df)
    assert got == brute_manifest(rows)
    assert any(not r[-1] for r in got) and m.root == got[0][3]


@pytest.mark.parametrize("n", [1, 2, 16, 17, 257])
def test_small_trees(spark, n):
    rows = [(i, "s", "en", i, f"Row {i}") for i in range(n)]
    assert manifest_of(spark.createDataFrame(rows, SCHEMA).repartition(3))[1] == brute_manifest(rows)


def test_manifest_of_nothing(spark):
    m, got = manifest_of(spark.createDataFrame([], SCHEMA))
    assert m.root is None and got == []


def test_resumed_states_hash_right_siblings_only(monkeypatch):
    """A fold costs the child, its right siblings and the closing block."""
    rng = np.random.default_rng(0)
    nodes = rng.integers(0, 256, size=(16, 16, 32), dtype=np.uint8)
    kids = [x.tobytes() for x in nodes]
    import pandas as pd
    made = M._parent.func(pd.Series(kids))
    states = M._padded(list(made["states"]))
    slots, new = np.arange(16), rng.integers(0, 256, size=(16, 32), dtype=np.uint8)
    blocks = []
    monkeypatch.setattr(M, "compress", lambda s, b, f=M.compress: (blocks.append(b.shape[1]), f(s, b))[1])
    got = M.resume(states[slots, slots], nodes, slots, np.full(16, 16), new)
    for i in range(16):
        run = [x.tobytes().hex() for x in nodes[i]]
        assert made["digest"][i].hex() == h(*run)
        run[i] = new[i].tobytes().hex()
        assert got[i].tobytes().hex() == h(*run)
    assert sum(blocks) == sum(16 - s + 1 for s in slots)


def test_hot_group_is_no_single_task(spark):
    """Ranks come from counts per partition: a group that holds all rows is
    spread over partitions."""
    rows = spark.range(20_000).select(F.lit("hot").alias("g"), F.col("id"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = M._placed(rows, "g", ["id"], "test-place").withColumn("task", F.spark_partition_id())
        assert placed.where("pos <> id OR n <> 20000").count() == 0
        assert placed.select("task").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
