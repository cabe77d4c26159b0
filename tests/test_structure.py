"""Health scoring on the reference's structure cases, SCC and cycles."""

import itertools
import random

from pyspark.sql import functions as F

from fleetlens.operators import graph as G
from fleetlens.operators import structure as S


def _modules(spark, rows):
    return spark.createDataFrame(
        [("p", n, path, files, [f"e{i}" for i in range(nexp)]) for n, path, files, nexp in rows],
        "project string, name string, path string, files array<string>, exports array<string>")


def _edges(spark, pairs):
    return spark.createDataFrame([("p", a, b) for a, b in pairs] or [("p", "x", "x")],
                                 "project string, source string, target string").where(F.lit(bool(pairs)))


def _scores(spark, cases):
    """(score, number of issues) of each case, all as projects of one fleet."""
    mods = [(f"p{k}", *m) for k, (ms, _) in enumerate(cases) for m in ms]
    m = spark.createDataFrame([(p, n, path, files, [f"e{i}" for i in range(nexp)]) for p, n, path, files, nexp in mods],
                              "project string, name string, path string, files array<string>, exports array<string>")
    e = spark.createDataFrame([(f"p{k}", a, b) for k, (_, pairs) in enumerate(cases) for a, b in pairs],
                              "project string, source string, target string")
    files = m.select("project", "name", F.explode("files").alias("file"))
    counts = S.export_counts(m.select("project", "name", F.explode("exports").alias("export")))
    issues = S.issue_rows(cycles=G.witness_cycles(G.cyclic_components(e), e), gods=S.god_modules(counts),
                          orphan_mods=S.orphans(m, e), deep=S.deep_files(files)).persist()
    n = {r.project: r["count"] for r in issues.groupBy("project").count().collect()}
    h = {r.project: r.score for r in S.health(issues, m).collect()}
    issues.unpersist()
    return [(h[f"p{k}"], n.get(f"p{k}", 0)) for k in range(len(cases))]


def _mod(name, nexp=0, files=None):
    return (name, f"src/{name}", files or [f"src/{name}/index.ts"], nexp)


def test_health_cases(spark):
    mixed = [_mod("a", 51), _mod("b"), _mod("c"), _mod("d", 0, ["src/a/b/c/d/e/deep.ts"])]
    clamp = [_mod(x, 51) for x in "abcdefg"]
    cases = [
        ([_mod("a"), _mod("b")], [("a", "b"), ("b", "a")], (80, 1)),
        ([_mod("a"), _mod("b"), _mod("c")], [("a", "b"), ("b", "c"), ("c", "a")], (80, 1)),
        ([_mod(x) for x in "abcd"], [("a", "b"), ("b", "a"), ("c", "d"), ("d", "c")], (60, 2)),
        ([_mod("god", 51), _mod("normal")], [("god", "god"), ("normal", "normal")], (85, 1)),
        ([_mod("god", 50), _mod("normal")], [("god", "god"), ("normal", "normal")], (100, 0)),
        ([_mod("orphan"), _mod("connected")], [("connected", "connected")], (90, 1)),
        ([_mod("deep", 0, ["src/a/b/c/d/e/deep.ts"])], [("deep", "deep")], (95, 1)),
        ([_mod("deep", 0, ["src/a/b/c/d/deep.ts"])], [("deep", "deep")], (100, 0)),
        (mixed, [("a", "b"), ("b", "a"), ("d", "d")], (50, 4)),
        (clamp, [("a", "b"), ("b", "a"), ("c", "d"), ("d", "c")], (0, 12)),
    ]
    assert _scores(spark, [c[:2] for c in cases]) == [c[2] for c in cases]


def test_core_apis_and_boundaries(spark):
    m = _modules(spark, [("login", "src/auth/login.ts", [], 0), ("query", "src/db/query.ts", [], 0),
                         ("config", "src/config.ts", [], 0), ("main", "main.ts", [], 0)])
    e = _edges(spark, [("login", "query"), ("login", "nonexistent"), ("unknown", "login")])
    c = S.core_apis(m, e).collect()
    assert [(r.name, r.route, r.method, r.module) for r in c] == [("query", "login → query", "export", "db")]
    b = {r.boundary: (r.n_modules, r.first_module, r.last_module) for r in S.boundaries(m).collect()}
    assert b == {"auth": (1, "login", "login"), "db": (1, "query", "query"), "root": (2, "config", "main")}
    deps = S.module_dependencies(m, e).collect()
    assert sorted((r.name, r.dependency) for r in deps if r.dependency) == [("login", "nonexistent"), ("login", "query")]


def test_entry_points(spark):
    f = spark.createDataFrame([("p", x) for x in ["src/index.ts", "src/utils/main.py", "src/a/b/index.ts",
                                                  "index.js", "lib/app.ts", "src/indexer.ts"]],
                              "project string, file string")
    assert sorted(r.file for r in S.entry_points(f).collect()) == ["index.js", "lib/app.ts", "src/index.ts",
                                                                    "src/utils/main.py"]


def _tarjan_like(nodes, edges):
    reach = {n: {n} for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            new = reach[b] - reach[a]
            if new:
                reach[a] |= new
                changed = True
    comp = {}
    for n in nodes:
        members = frozenset(m for m in reach[n] if n in reach[m])
        if len(members) >= 2:
            comp[n] = (min(members), len(members))
    return comp


def test_scc_random_graphs_match_brute_force(spark):
    rnd = random.Random(7)
    rows, expect = [], {}
    for p in range(4):
        n = 12
        edges = {(rnd.randrange(n), rnd.randrange(n)) for _ in range(16)}
        rows += [(f"p{p}", a, b) for a, b in edges]
        for node, v in _tarjan_like(range(n), [(a, b) for a, b in edges if a != b]).items():
            expect[(f"p{p}", node)] = v
    e = spark.createDataFrame(rows, "project string, source long, target long")
    got = {(r.project, r.node): (r.component, r.component_size) for r in G.cyclic_components(e).collect()}
    assert got == expect
    # duplicated and shuffled edges give the same components
    e2 = spark.createDataFrame(rows[::-1] + rows, "project string, source long, target long")
    assert {(r.project, r.node): (r.component, r.component_size) for r in G.cyclic_components(e2).collect()} == expect


def test_bounded_cycles_brute_force(spark):
    rnd = random.Random(3)
    n = 9
    edges = sorted({(rnd.randrange(n), rnd.randrange(n)) for _ in range(30)})
    es = {(a, b) for a, b in edges if a != b}
    want = set()
    for k in (2, 3, 4):
        for perm in itertools.permutations(range(n), k):
            if perm[0] == min(perm) and all((perm[i], perm[(i + 1) % k]) in es for i in range(k)):
                want.add(" → ".join(map(str, perm + (perm[0],))))
    e = spark.createDataFrame([("p", a, b) for a, b in edges], "project string, source long, target long")
    got = {r.cycle for r in G.bounded_cycles(e, max_len=4).collect()}
    assert got == want
    comps = G.cyclic_components(e)
    assert {r.cycle for r in G.bounded_cycles(e, max_len=4, components=comps).collect()} == want


def test_long_chains_and_rings_take_few_steps(spark):
    n = 2000
    ring = [("ring", i, (i + 1) % n) for i in range(n)]
    chain = [("chain", i, i + 1) for i in range(n)]
    # a long way round between two nodes that also form a short cycle, and a ring with a tail in and a tail out
    loop = [("loop", 0, 1), ("loop", 1, 0)] + [("loop", k, k + 1) for k in range(1, 300)] + [("loop", 300, 0)]
    tails = [("tails", k, k + 1) for k in range(100)] + [("tails", 100, 50)] + [("tails", 100, 101), ("tails", 101, 102)]
    e = spark.createDataFrame(ring + chain + loop + tails, "project string, source long, target long")
    steps = G._Steps()
    got = {}
    for r in G.cyclic_components(e, steps).collect():
        got.setdefault((r.project, r.component, r.component_size), set()).add(r.node)
    assert got == {("ring", 0, n): set(range(n)), ("loop", 0, 301): set(range(301)), ("tails", 50, 51): set(range(50, 101))}
    assert steps.n < 60


def test_witness_cycles_of_any_length(spark):
    rows, want = [], {}
    for n in (2, 3, 5, 50):
        ids = [f"m{k:03d}" for k in range(n)]
        rows += [(f"ring{n}", ids[k], ids[(k + 1) % n]) for k in range(n)]
        want[f"ring{n}", "m000"] = " → ".join([*ids, ids[0]])
    # chords, a shorter way back, two components in one project, an edge out of a component
    rows += [("x", a, b) for a, b in ["ab", "bc", "cd", "da", "ca", "de", "ef", "fe", "pq", "qp"]]
    want |= {("x", "a"): "a → b → c → a", ("x", "e"): "e → f → e", ("x", "p"): "p → q → p"}
    e = spark.createDataFrame(rows, "project string, source string, target string")
    comps = G.cyclic_components(e)
    got = G.witness_cycles(comps, e).collect()
    assert {(r.project, r.component): r.path for r in got} == want and len(got) == len(want)
    assert all(r.length == r.path.count("→") for r in got)
    assert G.witness_cycles(comps.limit(0), e).count() == 0


def test_witness_cycles_brute_force(spark):
    rnd = random.Random(11)
    edges = sorted({(rnd.randrange(9), rnd.randrange(9)) for _ in range(17)})
    es = {(a, b) for a, b in edges if a != b}
    e = spark.createDataFrame([("p", a, b) for a, b in edges], "project string, source long, target long")
    comps = G.cyclic_components(e)
    for r in G.witness_cycles(comps, e).collect():
        nodes = [x.node for x in comps.where(F.col("component") == r.component).collect()]
        best = min((k, c) for k in range(2, len(nodes) + 1) for c in itertools.permutations(sorted(nodes), k)
                   if c[0] == r.component and all((c[i], c[(i + 1) % k]) in es for i in range(k)))
        assert r.path == " → ".join(map(str, [*best[1], r.component])) and r.length == best[0]


def test_call_edges(spark):
    e = _edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("d", "d")])
    syms = spark.createDataFrame([("p", "b"), ("p", "d")], "project string, name string")
    got = sorted((r.source, r.target, r.symbol) for r in S.call_edges(e, syms).collect())
    assert got == [("a", "b", "b"), ("b", "c", "b"), ("d", "d", "d")]


def test_cycle_issue_text(spark):
    e = _edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("y", "x"), ("y", "z"), ("z", "x")])
    texts = sorted(r.issue for r in S.issue_rows(cycles=G.witness_cycles(G.cyclic_components(e), e)).collect())
    assert texts == ["circular dependency: a → b → c → a", "circular dependency: x → y → x"]


def test_braided_chains_take_few_steps(spark):
    """Contraction and trimming cannot shorten these: every module leads to
    the next two. Without a cycle, with one around all, and with one inside;
    names in random order."""
    n = 2000
    name = list(range(n))
    random.Random(5).shuffle(name)
    braid = [(name[i], name[i + k]) for i in range(n) for k in (1, 2) if i + k < n]
    rows = [("open", a, b) for a, b in braid] + [("closed", a, b) for a, b in braid] + [("closed", name[-1], name[0])]
    rows += [("inside", a, b) for a, b in braid] + [("inside", name[1500], name[500])]
    e = spark.createDataFrame(rows, "project string, source long, target long")
    steps = G._Steps()
    got = {}
    for r in G.cyclic_components(e, steps).collect():
        got.setdefault((r.project, r.component, r.component_size), set()).add(r.node)
    inside = set(name[500:1501])
    assert got == {("closed", 0, n): set(name), ("inside", min(inside), 1001): inside}
    assert steps.n < 60, steps.n


def test_scc_of_larger_random_graphs(spark):
    rnd = random.Random(23)
    rows, expect = [], {}
    for p, (n, m) in enumerate([(60, 70), (60, 90), (60, 130), (200, 230), (40, 39)]):
        edges = {(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)}
        rows += [(f"p{p}", f"m{a:03}", f"m{b:03}") for a, b in edges]
        for node, (c, size) in _tarjan_like(range(n), [(a, b) for a, b in edges if a != b]).items():
            expect[(f"p{p}", f"m{node:03}")] = (f"m{c:03}", size)
    e = spark.createDataFrame(rows, "project string, source string, target string")
    got = {(r.project, r.node): (r.component, r.component_size) for r in G.cyclic_components(e).collect()}
    assert got == expect


def test_ring_of_2000_in_few_jobs(spark):
    n = 2000
    rows = [("ring", i, (i + 1) % n) for i in range(n)] + [("short", 0, 1), ("short", 1, 0)]
    rows += [("eight", a, b) for a, b in [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 2)]]
    e = spark.createDataFrame(rows, "project string, source long, target long")
    comps = G._ckpt(G.cyclic_components(e))
    steps = G._Steps()
    got = {}
    for r in G.cycle_modules(comps, e, steps).collect():
        got.setdefault(r.project, []).append((r.position, r.module))
    assert sorted(got["ring"]) == [(i, i) for i in range(n)]
    assert sorted(got["short"]) == [(0, 0), (1, 1)] and sorted(got["eight"]) == [(0, 0), (1, 1), (2, 2)]
    assert steps.n < 40, steps.n
    text = {r.project: r for r in G.witness_cycles(comps, e).collect()}
    assert text["ring"].length == n and text["ring"].path.startswith("0 → 1 → 2") and text["ring"].path.endswith("999 → … → 0")
    assert text["eight"].path == "0 → 1 → 2 → 0"


def test_small_graphs_give_what_large_ones_give(spark, monkeypatch):
    """Graphs of few edges take no part in the rounds; both ways agree."""
    rnd = random.Random(31)
    rows = [(f"p{p}", f"m{rnd.randrange(9)}", f"m{rnd.randrange(9)}") for p in range(40) for _ in range(12)]
    rows += [(None, "a", "b"), (None, "b", "a"), ("n", None, "b"), ("n", "b", None)]
    e = spark.createDataFrame(rows + rows[:50], "project string, source string, target string")

    def both(edges):
        c = G._ckpt(G.cyclic_components(edges))
        return sorted(map(tuple, c.collect())), sorted(map(tuple, G.cycle_modules(c, edges).collect()))
    steps = G._Steps()
    G.cycle_modules(G._ckpt(G.cyclic_components(e, steps)), e, steps)
    assert steps.n <= 4, steps.n
    small = both(e)
    assert len(small[0]) > 40 and len(small[1]) > 40
    monkeypatch.setattr(G, "SMALL", 10)
    assert both(e) == small  # some of each
    monkeypatch.setattr(G, "SMALL", 0)
    assert both(e) == small


def test_handoffs_and_modules_as_of_a_day(spark, tmp_path):
    from fleetlens.plans import inputs as I
    rnd = random.Random(3)
    d = lambda k: f"20{k % 3:02d}-06-0{1 + k % 9}"
    spark.createDataFrame([(o, o % 4, d(o) if o % 5 else None) for o in range(30)], "o_orderkey long, o_custkey long, d string").selectExpr(
        "o_orderkey", "o_custkey", "timestamp(d) AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(rnd.randrange(30), rnd.randrange(4), rnd.randrange(5), rnd.randrange(4), d(k), float(rnd.randrange(3)), 1.0)
                           for k in range(150)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_shipdate string, "
                          "l_extendedprice double, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, f"s{k}", 0) for k in range(4)], "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(0, "N")], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    day, at = "2001-01-01", str(tmp_path)
    rows = lambda df: sorted(map(tuple, df.collect()))
    e, m = I.dated_edges(spark, at, day), I.dated_modules(spark, at, day)
    assert rows(e.drop("early")) == rows(I.handoff_edges(spark, at))
    assert rows(e.where("early").drop("early")) == rows(I.handoff_edges(spark, at, day)) != rows(e.drop("early"))
    assert rows(m.drop("n_before", "early")) == rows(I.supplier_modules(spark, at))
    assert rows(m.where("early").select("project", "name", "path", "n_before")) == rows(I.supplier_modules(spark, at, day))


def test_partitions_of_lines_follow_the_input(spark, tmp_path, monkeypatch):
    from fleetlens.plans import catalog_projects as CP
    from fleetlens.plans import inputs as I
    spark.range(200).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey", "timestamp(if(id % 3 = 0, '1999-01-01', '2001-01-01')) AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(900).selectExpr("id % 200 AS l_orderkey", "id % 31 AS l_partkey", "id % 11 AS l_suppkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(11).selectExpr("id AS s_suppkey", "'s' AS s_name", "0 AS s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(0, "N")], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    at = str(tmp_path)
    few = I.pieces(spark, at, "lineitem", "orders")
    monkeypatch.setattr(I, "PIECE", 500)
    n = I.pieces(spark, at, "lineitem", "orders")
    now, noted = CP._names(spark, at)
    assert n > few and now.rdd.getNumPartitions() == noted.rdd.getNumPartitions() == n
    rows = lambda df: sorted(map(tuple, df.select("project", "name").collect()))
    assert rows(now) == rows(I.supplier_modules(spark, at)) and rows(noted) == rows(I.supplier_modules(spark, at, CP.BEFORE))


def _ring_tables(spark, at, n):
    """Tables in which the orders of one customer lead once through ``n``
    suppliers in mixed order; the ring, from its smallest supplier."""
    ring = list(range(n))
    random.Random(17).shuffle(ring)
    ring = [int(x) for x in ring[ring.index(0):] + ring[:ring.index(0)]]
    lines = [(k // 7, ring[(k + d) % n], k % 7 + d) for k in range(n) for d in ((0, 1) if k % 7 == 6 or k == n - 1 else (0,))]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_linenumber int").selectExpr(
        "*", "l_suppkey AS l_partkey", "1.0D AS l_quantity", "'N' AS l_returnflag", "'O' AS l_linestatus").write.parquet(f"{at}/lineitem.parquet")
    spark.range(n // 7 + 1).selectExpr("id AS o_orderkey", "5L AS o_custkey", "timestamp('2001-01-01') AS o_orderdate").write.parquet(f"{at}/orders.parquet")
    spark.range(n).selectExpr("id AS s_suppkey", "'s' AS s_name", "0 AS s_nationkey").write.parquet(f"{at}/supplier.parquet")
    spark.createDataFrame([(0, "N")], "n_nationkey int, n_name string").write.parquet(f"{at}/nation.parquet")
    return ring


def test_severity_findings_name_every_module_of_a_cycle(spark, tmp_path):
    from fleetlens.plans.catalog import QUERIES
    ring = _ring_tables(spark, tmp_path, 1100)
    got = QUERIES["severity_findings"](spark, str(tmp_path)).where("rule = 'cycle'").collect()
    assert [(r.project, r.subject, r.severity) for r in got] == [("customer-5", "0", "BLOCK")]
    assert got[0].issue == "circular dependency: " + " → ".join(map(str, [*ring, 0]))


def test_witness_cycles_query_names_every_module(spark, tmp_path):
    from fleetlens.plans.catalog import QUERIES
    ring = _ring_tables(spark, tmp_path, 1100)
    r, = QUERIES["witness_cycles"](spark, str(tmp_path)).collect()
    assert (r.project, r.component, r.component_size, r.length) == ("customer-5", 0, 1100, 1100)
    assert r.path == " → ".join(map(str, [*ring, 0]))


def test_cycle_text_is_joined_from_pieces(spark, monkeypatch):
    """Cycles of less than a piece, of one or more whole pieces, and beyond;
    whole and in the short form."""
    rows, want = [], {}
    for n in (2, 3, 4, 5, 6, 7, 13):
        rows += [(f"p{n}", k, (k + 1) % n) for k in range(n)]
        want[f"p{n}"] = [str(k) for k in range(n)]
    e = spark.createDataFrame(rows, "project string, source long, target long")
    comps = G._ckpt(G.cyclic_components(e))
    monkeypatch.setattr(G, "PIECE", 3)
    for most in (None, 4, 6):
        got = {r.project: (r.path, r.length, r.component_size) for r in G.witness_cycles(comps, e, most=most).collect()}
        short = {p: m if most is None or len(m) <= most else [*m[:most], "…"] for p, m in want.items()}
        assert got == {p: (" → ".join([*short[p], "0"]), len(m), len(m)) for p, m in want.items()}
