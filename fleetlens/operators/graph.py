"""Cycle structure of dependency graphs, for every project at once.

``cyclic_components`` finds strongly connected components with an iterative
DataFrame job (no GraphX, no driver-side graph):

1. contract: replace every path whose inner nodes have one in-edge and one
   out-edge by one edge, by pointer doubling, so a chain or ring of n nodes
   takes log n steps; its inner nodes follow from its two ends afterwards;
2. trim: drop nodes without an in-edge or without an out-edge inside the
   remaining graph (they cannot be on a cycle); 1 and 2 alternate as long as
   they remove a fair share of the edges;
3. colour: ``PIVOTS`` random orders of the nodes; for each, every node learns
   the first node that reaches it and the first that it reaches. Where the two
   are one node, that node's component is found. All others are divided by
   what they learned: a component never spans two classes, so edges between
   classes go. In expectation a logarithmic number of such rounds remains,
   also for graphs without any cycle;
4. shortcuts: while colours still travel, every node gets up to two edges to
   nodes twice as far ahead as the last ones. They follow from paths, so they
   change no reachability, and stay valid inside the classes; colours then
   travel a long way in a logarithmic number of steps.

A graph of at most ``SMALL`` edges takes no part in these rounds: its edges
meet in one bounded row by a shuffle, and a depth-first search of that row
gives its components. So what the rounds shuffle again and again is only the
edges of larger graphs, and a fleet of small ones is shuffled once.

Every key carries ``project``, so all graphs of the fleet run in the same
loop, which runs until nothing is left: there is no limit on its steps. The
driver only sees row counts that decide when a loop stops. Every step is
written to the reliable checkpoint folder (``spark.checkpoint.dir``), so
lineage stays short and a lost executor only recomputes its part of a step.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written

P = "project"


def _ckpt(df: DataFrame) -> DataFrame:
    """Write a step and read it back. A table rather than a checkpoint: a
    checkpoint carries what the planner inferred about its partitioning and
    order, which over a long loop grows until planning takes longer than the
    work."""
    return written(df, "graph-step")


def simple_edges(edges: DataFrame) -> DataFrame:
    """Distinct (project, src, dst) without self-loops."""
    return (edges.select(P, F.col("source").alias("src"), F.col("target").alias("dst"))
            .where(F.col("src") != F.col("dst")).distinct())


class _Steps:
    """Counts the steps of a loop. ``keep`` writes one and returns the number
    observed while writing it (``Observation``), so a step is one job."""

    def __init__(self):
        self.n = 0

    def keep(self, df: DataFrame, metric=None):
        self.n += 1
        if metric is None:
            return _ckpt(df), None
        obs = Observation()
        out = _ckpt(df.observe(obs, metric.alias("m")))
        return out, obs.get["m"]


def _rows():
    return F.count(F.lit(1))


def _degrees(e: DataFrame) -> DataFrame:
    """(project, node, o, i, succ, pred): out- and in-degree, and a neighbour
    on either side, from one aggregation."""
    none = F.lit(None).cast(e.schema["src"].dataType)
    ends = (e.select(P, F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"),
                     F.col("dst").alias("succ"), none.alias("pred"))
            .unionByName(e.select(P, F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"),
                                  none.alias("succ"), F.col("src").alias("pred"))))
    return ends.groupBy(P, "node").agg(F.sum("o").alias("o"), F.sum("i").alias("i"), F.max("succ").alias("succ"),
                                       F.max("pred").alias("pred"))


def _trim(e: DataFrame, steps: _Steps) -> tuple[DataFrame, int]:
    """Drop edges of nodes without an in- or an out-edge, one layer."""
    keep = _degrees(e).where((F.col("o") > 0) & (F.col("i") > 0)).select(P, "node")
    t = (e.join(keep.withColumnRenamed("node", "src"), [P, "src"], "left_semi")
         .join(keep.withColumnRenamed("node", "dst"), [P, "dst"], "left_semi"))
    return steps.keep(t, _rows())


def _contract(e: DataFrame, n: int, steps: _Steps):
    """Replace paths by edges. Returns the edges, their number, the inner
    nodes with the two ends of their path (project, node, p, u), and the nodes
    of rings that have no end (project, node, c = the ring's smallest node)."""
    inner, m = steps.keep(_degrees(e).where((F.col("o") == 1) & (F.col("i") == 1)).select(P, "node", "succ", "pred"),
                          _rows())
    if not m:
        return e, n, None, None
    jump = inner.select(P, "node", F.col("succ").alias("jump"), F.col("node").alias("low"), F.col("node").alias("last"))
    was = None
    while True:  # each round doubles how far a pointer reaches
        far = jump.select(P, F.col("node").alias("jump"), F.col("jump").alias("_j"), F.col("low").alias("_l"),
                          F.col("last").alias("_t"))
        nxt = (jump.join(far, [P, "jump"], "left")
               .select(P, "node", F.coalesce("_j", "jump").alias("jump"), F.least("low", "_l").alias("low"),
                       F.coalesce("_t", "last").alias("last"), F.col("_j").isNotNull().alias("_on"),
                       (F.col("_l") < F.col("low")).alias("_fell")))
        nxt, both = steps.keep(nxt, F.count(F.when(F.col("_on"), 1)) * F.lit(1 << 31) + F.count(F.when(F.col("_fell"), 1)))
        jump = nxt.drop("_on", "_fell")
        on, fell = divmod(both, 1 << 31)
        # on a path some pointers come to its end in every round; when none does, only rings are left, and their
        # smallest nodes are known once a round changes none
        if not on or (on == was and not fell):
            break
        was = on
    nodes = inner.select(P, "node")
    inside = nodes.withColumnRenamed("node", "jump")
    rings = jump.join(inside, [P, "jump"], "left_semi").select(P, "node", F.col("low").alias("c"))
    paths = jump.join(inside, [P, "jump"], "left_anti")  # the pointer has come to an end outside
    first = inner.join(nodes.withColumnRenamed("node", "pred"), [P, "pred"], "left_anti").select(P, "node", "pred")
    ends = (paths.join(first, [P, "node"]).select(P, "last", F.col("pred").alias("p"), F.col("jump").alias("u")))
    members = paths.select(P, "node", "last").join(ends, [P, "last"]).select(P, "node", "p", "u")
    rest = (e.join(nodes.withColumnRenamed("node", "src"), [P, "src"], "left_anti")
            .join(nodes.withColumnRenamed("node", "dst"), [P, "dst"], "left_anti")
            .unionByName(ends.where(F.col("p") != F.col("u")).select(P, F.col("p").alias("src"), F.col("u").alias("dst"))))
    rest, n = steps.keep(rest.distinct(), _rows())
    return rest, n, _ckpt(members), _ckpt(rings)


def _unfold(found: DataFrame, members: DataFrame) -> DataFrame:
    """Add the inner nodes of contracted paths whose ends are in one
    component, or are one node; such a node then is a component's, too."""
    for end in ("p", "u"):
        members = (members.join(found.select(P, F.col("node").alias(end), F.col("c").alias(f"_{end}")), [P, end], "left")
                   .withColumn(f"_{end}", F.coalesce(f"_{end}", end)))
    inside = members.where(F.col("_p") == F.col("_u"))
    more = inside.select(P, "node", F.col("_p").alias("c")).unionByName(inside.select(P, F.col("p").alias("node"), F.col("_p").alias("c")))
    return _ckpt(found.unionByName(more).distinct())


PIVOTS = 8
PATIENCE = 2  # steps along plain edges before shortcuts are added


def _ordered(c, *salt):
    """Place of a node in a random order; the node itself breaks ties."""
    return F.struct(F.xxhash64(c, *[F.lit(x) for x in salt]).alias("h"), c.alias("n"))


def _ahead(edges: DataFrame, level: int) -> DataFrame:
    """Up to two of the nodes that ``edges`` (project, src, dst) lead to from
    each node, chosen at random."""
    pick = _ordered(F.col("dst"), "ahead", level)
    two = edges.groupBy(P, "src").agg(F.min(pick).alias("a"), F.max(pick).alias("b"))
    return two.select(P, "src", F.explode(F.array_distinct(F.array("a.n", "b.n"))).alias("dst"))


class _Shortcuts:
    """Edges that follow from paths, each level twice as long as the last."""

    def __init__(self, steps: _Steps):
        self.steps, self.levels, self.last, self.n = steps, [], None, 0

    def grow(self, e: DataFrame) -> bool:
        """Add a level; False if there is nothing further ahead."""
        if self.n < 0:
            return False
        last = _ahead(e, 0) if self.last is None else self.last
        far = last.select(P, F.col("src").alias("_via"), F.col("dst").alias("_far"))
        on = (last.withColumnRenamed("dst", "_via").join(far, [P, "_via"])
              .where(F.col("src") != F.col("_far")).select(P, "src", F.col("_far").alias("dst")))
        self.last, n = self.steps.keep(_ahead(on, len(self.levels) + 1), _rows())
        if n:
            self.levels.append(self.last)
        self.n = n or -1
        return bool(n)

    def within(self, classes: DataFrame) -> None:
        """Keep those inside the classes; what has been dropped ends growth."""
        if self.levels:
            kept, n = self.steps.keep(_inside(reduce(DataFrame.unionByName, self.levels).distinct(), classes), _rows())
            self.levels, self.n = ([kept] if n else []), -1


def _inside(e: DataFrame, classes: DataFrame) -> DataFrame:
    """The edges both of whose ends are in one class (project, node, k)."""
    return (e.join(classes.select(P, F.col("node").alias("src"), F.col("k").alias("_ks")), [P, "src"])
            .join(classes.select(P, F.col("node").alias("dst"), F.col("k").alias("_kd")), [P, "dst"])
            .where(F.col("_ks") == F.col("_kd")).select(P, "src", "dst"))


def _colour(e: DataFrame, shortcuts: _Shortcuts, steps: _Steps, turn: int) -> DataFrame:
    """(project, node, f0, b0, f1, b1, ...): in each random order the last
    node that reaches the node, and the last that it reaches."""
    names = [f"{d}{i}" for i in range(PIVOTS) for d in "fb"]
    nodes = e.select(P, F.col("src").alias("node")).union(e.select(P, F.col("dst").alias("node"))).distinct()
    col, _ = steps.keep(nodes.select(P, "node", *[_ordered(F.col("node"), turn, int(c[1:])).alias(c) for c in names]))
    rounds = 0
    while True:
        ways = reduce(DataFrame.unionByName, [e, *shortcuts.levels])
        ways = (ways.select(P, F.col("src").alias("_at"), F.col("dst").alias("node"), F.lit("f").alias("_d"))
                .unionByName(ways.select(P, F.col("dst").alias("_at"), F.col("src").alias("node"), F.lit("b").alias("_d"))))
        told = ways.join(col.withColumnRenamed("node", "_at"), [P, "_at"]).select(
            P, "node", *[F.when(F.col("_d") == c[0], F.col(c)).alias(c) for c in names])
        own = col.withColumn("_own", F.struct(*names))
        # own colours and those that arrive meet in one aggregation (one shuffle)
        nxt = (own.unionByName(told, allowMissingColumns=True).groupBy(P, "node")
               .agg(*[F.max(c).alias(c) for c in names], F.max("_own").alias("_own"))
               .select(P, "node", *names, (F.struct(*names) != F.col("_own")).alias("_chg")))
        nxt, changed = steps.keep(nxt, F.count(F.when(F.col("_chg"), 1)))
        col, rounds = nxt.drop("_chg"), rounds + 1
        if not changed:
            return col
        if rounds >= PATIENCE:
            shortcuts.grow(e)


SMALL = 1000  # edges of a graph that is searched in one row


def _by_size(e: DataFrame, keys: list[str], steps: _Steps) -> tuple[DataFrame | None, DataFrame | None]:
    """The edges of the graphs (by ``keys``) of at most ``SMALL`` edges, and
    those of larger ones; None where there is none. Repeated edges count, and
    nodes are numbers or strings, which Python orders as Spark does."""
    if not isinstance(e.schema["src"].dataType, (T.IntegralType, T.StringType)) or e.schema["src"].dataType != e.schema["dst"].dataType:
        return None, e
    large, n = steps.keep(e.groupBy(*keys).agg(_rows().alias("n")).where(F.col("n") > SMALL).select(*keys), _rows())
    if not n:
        return e, None
    return e.join(large, keys, "left_anti"), e.join(large, keys, "left_semi")


def _ahead_of(sources: list, targets: list) -> dict:
    ahead: dict = {}
    for a, b in zip(sources, targets):
        ahead.setdefault(a, set()).add(b)
    return ahead


def _strong(sources, targets):
    """(node, smallest node, size) of the components of one small graph, by a
    depth-first search (Tarjan) without recursion."""
    ahead, seen, low, path, out = _ahead_of(sources, targets), {}, {}, [], []
    for start in ahead:
        todo = [] if start in seen else [(start, None, iter(ahead[start]))]
        while todo:
            node, above, rest = todo[-1]
            if node not in seen:
                seen[node] = low[node] = len(seen)
                path.append(node)
            for b in rest:
                if b in low:  # not in a component yet
                    low[node] = min(low[node], seen[b])
                elif b not in seen and b in ahead:
                    todo.append((b, node, iter(ahead[b])))
                    break
            else:
                todo.pop()
                reach = low[node]
                if reach == seen[node]:
                    members = path[path.index(node):] if path[-1] != node else [node]
                    del path[-len(members):]
                    for x in members:
                        del low[x]
                    if len(members) > 1:
                        out += [(x, min(members), len(members)) for x in members]
                elif above is not None:
                    low[above] = min(low[above], reach)
    return out


def _way_back(home, sources, targets):
    """The modules of the cycle of ``cycle_modules`` of one small component:
    distances to ``home`` against the edges, then from ``home`` to the
    smallest next module of those that are nearest."""
    ahead, behind = _ahead_of(sources, targets), _ahead_of(targets, sources)
    left, ring = {home: 0}, [home]
    while ring:
        ring = [a for b in ring for a in behind.get(b, ()) if a not in left and not left.update({a: left[b] + 1})]
    out, node = [], home
    while node != home or not out:
        out.append(node)
        near = min((left[x] for x in ahead.get(node, ()) if x in left), default=None)
        if near is None:  # not a component of these edges
            return []
        node = min(x for x in ahead[node] if left.get(x) == near)
    return out


def _arrays(e: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, s, t): the edges of each small graph in one row."""
    both = e.groupBy(*keys).agg(F.collect_list(F.struct("src", "dst")).alias("_e"))
    return both.select(*keys, F.col("_e.src").alias("s"), F.col("_e.dst").alias("t"))


def cyclic_components(edges: DataFrame, steps: _Steps | None = None) -> DataFrame:
    """Strongly connected components with at least two nodes.

    ``edges(project, source, target)``; self-loops do not make a cycle, and
    edges without a project none either. Returns (project, node, component,
    component_size) where ``component`` is the smallest node of the component.
    """
    steps = steps or _Steps()
    e, _ = steps.keep(edges.select(P, F.col("source").alias("src"), F.col("target").alias("dst"))
                      .where((F.col("src") != F.col("dst")) & F.col(P).isNotNull()))
    small, large = _by_size(e, [P], steps)
    found = [] if large is None else [_large_components(large.distinct(), steps)]
    if small is not None:
        node = e.schema["src"].dataType
        kind = T.ArrayType(T.StructType([T.StructField("node", node), T.StructField("component", node), T.StructField("component_size", T.LongType())]))
        members = _arrays(small, [P]).select(P, F.explode(F.udf(_strong, kind)("s", "t")).alias("m"))
        found.append(members.select(P, "m.node", "m.component", "m.component_size"))
    return reduce(DataFrame.unionByName, found)


def _large_components(simple: DataFrame, steps: _Steps) -> DataFrame:
    """The components of graphs of any size, from distinct edges (project,
    src, dst) without self-loops."""
    e, n = steps.keep(simple, _rows())
    found: list[DataFrame] = []
    folded: list[DataFrame] = []
    before = None
    while n and (before is None or n <= 0.75 * before):
        before = n
        e, n, members, rings = _contract(e, n, steps)
        if members is not None:
            folded.append(members)
            found.append(rings)
        if n:
            e, n = _trim(e, steps)
    shortcuts, turn = _Shortcuts(steps), 0
    while n:
        col = _colour(e, shortcuts, steps, turn)
        met = F.coalesce(*[F.when(F.col(f"f{i}") == F.col(f"b{i}"), F.col(f"f{i}.n")) for i in range(PIVOTS)])
        col = col.select(P, "node", met.alias("c"), F.struct(*col.columns[2:]).alias("k"))
        found.append(col.where(F.col("c").isNotNull()).select(P, "node", "c"))
        rest = col.where(F.col("c").isNull())
        e, n = steps.keep(_inside(e, rest), _rows())
        if n:
            shortcuts.within(rest)
        turn += 1
    if not found:
        schema = simple.select(P, F.col("src").alias("node")).schema
        return simple.sparkSession.createDataFrame([], schema).select(
            P, "node", F.col("node").alias("component"), F.lit(0).cast("long").alias("component_size"))
    allf = found[0]
    for f in found[1:]:
        allf = allf.unionByName(f)
    for members in reversed(folded):
        allf = _unfold(allf, members)
    comp = allf.groupBy(P, "c").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("component_size"))
    return (allf.join(comp, [P, "c"]).where(F.col("component_size") >= 2)
            .select(P, "node", "component", "component_size"))


def component_summary(components: DataFrame) -> DataFrame:
    """One row per component: (project, component, component_size)."""
    return components.groupBy(P, "component").agg(F.first("component_size").alias("component_size"))


def bounded_cycles(edges: DataFrame, max_len: int = 3, components: DataFrame | None = None,
                   sep: str = " → ") -> DataFrame:
    """Every simple cycle of 2..max_len nodes, once: it starts at its smallest
    node, the other nodes are larger and distinct. Self-loops are skipped.

    With ``components`` (from ``cyclic_components``) only edges inside a
    component are used, which removes every edge that cannot be on a cycle.
    Returns (project, length, cycle) with cycle 'a → b → c → a'.
    """
    e = simple_edges(edges)
    if components is not None:
        c = components.select(P, "node", "component")
        e = (e.join(c.withColumnRenamed("node", "src").withColumnRenamed("component", "_c1"), [P, "src"])
             .join(c.withColumnRenamed("node", "dst").withColumnRenamed("component", "_c2"), [P, "dst"])
             .where(F.col("_c1") == F.col("_c2")).select(P, "src", "dst"))
    # open paths start -> ... -> last, every node after start larger than start
    paths = e.where(F.col("dst") > F.col("src")).select(
        P, F.col("src").alias("start"), F.col("dst").alias("last"),
        F.array(F.col("src"), F.col("dst")).alias("nodes"))
    out = []
    for length in range(2, max_len + 1):
        closing = e.select(P, F.col("src").alias("last"), F.col("dst").alias("start"))
        cyc = paths.join(closing, [P, "last", "start"]).select(
            P, F.lit(length).alias("length"),
            F.array_join(F.transform(F.concat("nodes", F.array("start")), lambda x: x.cast("string")), sep)
            .alias("cycle"))
        out.append(cyc)
        if length == max_len:
            break
        ext = e.select(P, F.col("src").alias("last"), F.col("dst").alias("_next"))
        paths = (paths.join(ext, [P, "last"])
                 .where((F.col("_next") > F.col("start")) & ~F.array_contains("nodes", F.col("_next")))
                 .select(P, "start", F.col("_next").alias("last"),
                         F.concat("nodes", F.array("_next")).alias("nodes")))
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res


KEY = [P, "component"]


def _paths_to_edges(within: DataFrame, steps: _Steps) -> tuple[DataFrame, DataFrame | None]:
    """``within`` (project, component, src, dst) with paths whose inner nodes
    have no other edge replaced by one edge: (project, component, src, dst, w,
    first, last) with its length, first node behind ``src`` and, for a path,
    its last inner node; and the inner nodes (project, component, node, last,
    left) with the number of steps from each to the path's end. A component's
    smallest module is never inner, so every path ends."""
    none = F.lit(None).cast(within.schema["src"].dataType)
    ends = (within.select(*KEY, F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"), F.col("dst").alias("succ"), none.alias("pred"))
            .unionByName(within.select(*KEY, F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"), none.alias("succ"), F.col("src").alias("pred"))))
    inner = (ends.groupBy(*KEY, "node").agg(F.sum("o").alias("o"), F.sum("i").alias("i"), F.max("succ").alias("succ"), F.max("pred").alias("pred"))
             .where("o = 1 AND i = 1 AND node <> component").select(*KEY, "node", "succ", "pred"))
    inner, n = steps.keep(inner, _rows())
    plain = within.select(*KEY, "src", "dst", F.lit(1).cast("long").alias("w"), F.col("dst").alias("first"), none.alias("last"))
    if not n:
        return plain, None
    jump = inner.select(*KEY, "node", F.col("succ").alias("to"), F.lit(1).cast("long").alias("left"), F.col("node").alias("last"))
    while n:  # each round doubles how far a pointer reaches
        far = jump.select(*KEY, F.col("node").alias("to"), F.col("to").alias("_to"), F.col("left").alias("_left"), F.col("last").alias("_last"))
        jump = (jump.join(far, [*KEY, "to"], "left")
                .select(*KEY, "node", F.coalesce("_to", "to").alias("to"), (F.col("left") + F.coalesce("_left", F.lit(0))).alias("left"),
                        F.coalesce("_last", "last").alias("last"), F.col("_to").isNotNull().alias("_on")))
        jump, n = steps.keep(jump, F.count(F.when(F.col("_on"), 1)))
        jump = jump.drop("_on")
    nodes = inner.select(*KEY, "node")
    first = inner.join(nodes.withColumnRenamed("node", "pred"), [*KEY, "pred"], "left_anti").select(*KEY, "node", "pred")
    paths = first.join(jump, [*KEY, "node"]).select(
        *KEY, F.col("pred").alias("src"), F.col("to").alias("dst"), (F.col("left") + 1).alias("w"), F.col("node").alias("first"), "last")
    rest = (plain.join(nodes.withColumnRenamed("node", "src"), [*KEY, "src"], "left_anti")
            .join(nodes.withColumnRenamed("node", "dst"), [*KEY, "dst"], "left_anti"))
    return _ckpt(rest.unionByName(paths)), jump.select(*KEY, "node", "last", "left")


def _distances(e: DataFrame, steps: _Steps) -> tuple[DataFrame, int]:
    """(project, component, node, d): steps from every node to its component's
    smallest module, and the number of edges that a way may have. Only what
    changed is sent on."""
    dist, _ = steps.keep(e.select(*KEY, F.col("component").alias("node")).distinct()
                         .select(*KEY, "node", F.lit(0).cast("long").alias("d"), F.lit(True).alias("_new")))
    rounds = 0
    while True:
        told = (e.where("src <> component").join(dist.where("_new").select(*KEY, F.col("node").alias("dst"), "d"), [*KEY, "dst"])
                .select(*KEY, F.col("src").alias("node"), (F.col("w") + F.col("d")).alias("d"), F.lit(None).cast("long").alias("_own")))
        nxt = (dist.select(*KEY, "node", "d", F.col("d").alias("_own")).unionByName(told).groupBy(*KEY, "node")
               .agg(F.min("d").alias("d"), F.max("_own").alias("_own"))
               .select(*KEY, "node", "d", (F.col("_own").isNull() | (F.col("d") < F.col("_own"))).alias("_new")))
        dist, n = steps.keep(nxt, F.count(F.when(F.col("_new"), 1)))
        rounds += 1
        if not n:
            return dist.select(*KEY, "node", "d"), rounds


def cycle_modules(components: DataFrame, edges: DataFrame, steps: _Steps | None = None) -> DataFrame:
    """One cycle per component, as rows (project, component, position,
    module): the shortest that returns to the component's smallest module
    (position 0), among those the first by its modules. The cycle may have any
    length; only the cycles of components of at most ``SMALL`` edges are found
    in one row each, the others by ``_large_cycles``."""
    steps = steps or _Steps()
    c = components.select(P, "node", "component")
    within = (edges.select(P, F.col("source").alias("src"), F.col("target").alias("dst")).where(F.col("src") != F.col("dst"))
              .join(c.withColumnRenamed("node", "src"), [P, "src"])
              .join(c.withColumnRenamed("node", "dst").withColumnRenamed("component", "_other"), [P, "dst"])
              .where(F.col("component") == F.col("_other")).select(*KEY, "src", "dst"))
    within, n = steps.keep(within, _rows())
    if not n:
        return within.select(*KEY, F.lit(0).cast("long").alias("position"), F.col("src").alias("module"))
    small, large = _by_size(within, KEY, steps)
    found = [] if large is None else [_large_cycles(large.distinct(), steps)]
    if small is not None:
        way = F.udf(_way_back, T.ArrayType(within.schema["src"].dataType))("component", "s", "t")
        rows = _arrays(small, KEY).select(*KEY, F.posexplode(way).alias("position", "module"))
        found.append(rows.select(*KEY, F.col("position").cast("long").alias("position"), "module"))
    return reduce(DataFrame.unionByName, found)


def _large_cycles(within: DataFrame, steps: _Steps) -> DataFrame:
    """``cycle_modules`` of components of any size, from their distinct edges
    (project, component, src, dst). No path is ever held in one value.

    Paths without branches become edges by pointer doubling; the distance of
    every remaining module to the smallest one follows from rounds of messages
    along these edges, and its next module is the smallest of those that are
    nearer. These pointers are a tree towards the smallest module; which of
    them the cycle uses is found by list ranking: jumps of 1, 2, 4, ... edges,
    taken from the longest to the shortest. A module's position is the length
    of the cycle less its distance."""
    within, _ = steps.keep(within)
    e, inner = _paths_to_edges(within, steps)
    dist, rounds = _distances(e, steps)
    # each node's next edge: on a shortest way, with the smallest next module
    ahead = e.join(dist.select(*KEY, F.col("node").alias("dst"), "d"), [*KEY, "dst"])
    best = ahead.groupBy(*KEY, "src").agg(F.min(F.struct((F.col("w") + F.col("d")).alias("d"), "first", "dst", "last")).alias("b"))
    hop, _ = steps.keep(best.select(*KEY, "src", "b.d", "b.dst", "b.last"))
    home = F.col("src") == F.col("component")
    jumps = [hop.where(~home).select(*KEY, "src", "dst")]
    while 1 << len(jumps) <= rounds:
        last = jumps[-1]
        twice = (last.withColumnRenamed("dst", "_via")
                 .join(last.select(*KEY, F.col("src").alias("_via"), "dst"), [*KEY, "_via"]).select(*KEY, "src", "dst"))
        jumps.append(steps.keep(twice)[0])
    on = hop.where(home).select(*KEY, F.col("dst").alias("src"))
    for j in reversed(jumps):
        on = _ckpt(on.unionByName(on.join(j, [*KEY, "src"]).select(*KEY, F.col("dst").alias("src"))).distinct())
        steps.n += 1
    on = on.unionByName(hop.where(home).select(*KEY, "src")).distinct()
    used = hop.join(on, [*KEY, "src"])  # the cycle's edges
    length = hop.where(home).select(*KEY, F.col("d").alias("length"))
    rows = used.select(*KEY, F.when(home, F.lit(None)).otherwise(F.col("d")).alias("d"), F.col("src").alias("module"))
    if inner is not None:  # the inner nodes of the paths among them
        paths = used.where(F.col("last").isNotNull()).join(
            dist.select(*KEY, F.col("node").alias("dst"), F.col("d").alias("_end")), [*KEY, "dst"]).select(*KEY, "last", "_end")
        rows = rows.unionByName(inner.join(paths, [*KEY, "last"])
                                .select(*KEY, (F.col("left") + F.col("_end")).alias("d"), F.col("node").alias("module")))
    return (rows.join(length, KEY)
            .select(*KEY, F.when(F.col("d").isNull(), 0).otherwise(F.col("length") - F.col("d")).cast("long").alias("position"), "module"))


TEXT_MODULES = 1000
PIECE = 1000  # modules whose names are joined at once


def witness_cycles(components: DataFrame, edges: DataFrame, sep: str = " → ", steps: _Steps | None = None,
                   most: int | None = TEXT_MODULES) -> DataFrame:
    """(project, component, component_size, length, path): the cycle of
    ``cycle_modules`` as text, 'a → b → c → a'. With ``most`` None the text
    names every module of a cycle of any length; otherwise
    a short form that names the first ``most`` and then '…'.

    Names are joined in pieces of ``PIECE`` modules, wherever these are, and
    only pieces meet in the row of their cycle, which then takes memory by the
    bytes of its text, not an object per module."""
    named = F.lit(True) if most is None else F.col("position") < most
    rows = cycle_modules(components, edges, steps).withColumn("piece", F.floor(F.col("position") / PIECE))
    modules = F.array_sort(F.collect_list(F.when(named, F.struct("position", "module"))))
    names = F.array_join(F.transform("m", lambda x: x["module"].cast("string")), sep)
    pieces = (rows.groupBy(*KEY, "piece").agg(_rows().alias("n"), modules.alias("m"))
              .select(*KEY, "n", F.when(F.size("m") > 0, F.struct("piece", names.alias("text"))).alias("t")))
    # a component's size and its pieces meet in one aggregation, so no join holds texts
    sizes = component_summary(components).withColumn("n", F.lit(0).cast("long"))
    cycles = (pieces.unionByName(sizes, allowMissingColumns=True).groupBy(*KEY)
              .agg(F.max("component_size").alias("component_size"), F.sum("n").cast("int").alias("length"),
                   F.array_sort(F.collect_list("t")).alias("t")).where(F.col("length") > 0))
    none = F.array().cast("array<string>")
    cut = none if most is None else F.when(F.col("length") > most, F.array(F.lit("…"))).otherwise(none)
    text = F.array_join(F.concat("t.text", cut, F.array(F.col("component").cast("string"))), sep)
    return cycles.select(*KEY, "component_size", "length", text.alias("path"))
