"""Near-duplicate documents (operator 6): MinHash LSH forest.

A document's set of word shingles gives a MinHash signature and a digest.
Documents with equal digests form a class; one of them stands for it. A tree
of the forest is one sorted order: signature values in the tree's own
permutation, as a string of bytes. In a sorted order the neighbours of a
document are those that share the longest prefix with it, so the depth that
separates it from the rest adapts to its region: a few bytes among unlike
documents, many among thousands of near copies. Neighbours that share at
least ``MIN_DEPTH`` bytes are candidates, in all ``TREES`` orders. A group of
near copies often hangs together through a few central documents; so in every
region (documents with a common prefix of ``MIN_DEPTH`` bytes) the document
with the most neighbours above the threshold, by signature, is a candidate for
all others.

A candidate pair whose signatures agree in less than the threshold minus six
standard errors is let go; every other pair that can still join two
components is confirmed on the two full shingle sets. Connected components
follow from the confirmed links. These candidates are linear in the number of
documents; texts are not shuffled: sets are made a second time for the
documents in candidate pairs and in crowded regions only.

In a crowded region (more rows than neighbours can cover) a partner may be
pushed out by relatives below the threshold. So the documents of crowded
regions are also joined exactly, by the prefix filter: shingles in a global
order from rare to common, a pair at the threshold must share one of the first
few. Of a shingle's documents only those in different components are paired;
the pairs that pass the filters on lengths and positions are confirmed on
their sets, and the components follow from all links.

Outside crowded regions the forest is probabilistic; its recall against brute
force is measured in the tests and stated in the README.

Defined cases: documents without words have an empty set and are linked with
nothing; documents with fewer words than a shingle have their whole sequence
as one; rows that share an id are one document (the set with the smallest
digest counts) and give one row; rows without an id each stay, with a null
component; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TYPES, keeps_names, sized_broadcast, stage, struct_of, text_bytes
from .components import components

WORDS = 5
VALUES = 128  # values of a signature
TREES = 32
DEPTH = 24  # bytes of a tree's key
MIN_DEPTH = 5
NEIGHBOURS = 4  # on either side in each sorted order
HUB_LINKS = 2
BLOCK = 2_000  # documents of a shingle that one task pairs with the others
THRESHOLD = 85  # percent
SET_BYTES = 6  # of a shingle's hash in a stored set

_BASE = 0x9E3779B97F4A7C15 | 1
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^k and base^-k modulo 2^64, for k < n; grown as needed."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _powers = tuple(tables)
    return _powers


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    parts = text.lower().split()  # bytes: A-Z and ASCII blanks only
    if not parts:
        return np.empty(0, np.uint64)
    joined = np.frombuffer(b" ".join(parts), np.uint8)
    power, inverse = _power_tables(len(joined) + 1)
    prefix = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * power[:len(joined)], out=prefix[1:])
    blank = np.flatnonzero(joined == 32)
    start, end = np.concatenate(([0], blank + 1)), np.concatenate((blank, [len(joined)]))
    k = min(words, len(parts)) - 1
    start, end = start[:len(start) - k], end[k:]
    h = (prefix[end] - prefix[start]) * inverse[start]
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return np.unique(h ^ (h >> np.uint64(31)))


_rng = np.random.default_rng(6)
_FACTORS = (_rng.integers(1, 1 << 32, VALUES, dtype=np.uint32) | np.uint32(1))[:, None]
_SHIFTS = _rng.integers(0, 1 << 32, VALUES, dtype=np.uint32)[:, None]
_ORDERS = np.array([_rng.permutation(VALUES)[:DEPTH] for _ in range(TREES)])


def signature(shingles: np.ndarray) -> bytes:
    """One byte of each of VALUES minima."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)[None, :]
    least = np.min([(x[:, k:k + 4096] * _FACTORS + _SHIFTS).min(axis=1) for k in range(0, x.shape[1], 4096)], axis=0)
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


@F.pandas_udf(struct_of(n="long", digest="binary", sig="binary"))
def _sketch(body: pd.Series) -> pd.DataFrame:
    out = []
    for text in body:
        s = shingle_set(text)
        out.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), signature(s) if len(s) else b""))
    return pd.DataFrame(out, columns=["n", "digest", "sig"])


@F.pandas_udf(struct_of(digest="binary", members="binary"))
def _members(body: pd.Series) -> pd.DataFrame:
    """A shingle set as stored for confirmation: SET_BYTES of each hash."""
    out = []
    for text in body:
        s = shingle_set(text)
        out.append((xxhash.xxh3_128_digest(s.tobytes()), s.view(np.uint8).reshape(-1, 8)[:, 8 - SET_BYTES:].tobytes()))
    return pd.DataFrame(out, columns=["digest", "members"])


def _unpacked(members: bytes) -> np.ndarray:
    raw = np.frombuffer(members, np.uint8).reshape(-1, SET_BYTES)
    full = np.zeros((len(raw), 8), np.uint8)
    full[:, 8 - SET_BYTES:] = raw
    return full.view(np.uint64).ravel()


@F.pandas_udf(TYPES["int"])
def _agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(-1, VALUES) for s in (a, b))
    return pd.Series((x == y).sum(axis=1).astype(np.int32))


@F.pandas_udf(struct_of(common="long", united="long"))
def _overlap(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    out = []
    for x, y in zip(a, b):
        x, y = _unpacked(x), _unpacked(y)
        common = len(np.intersect1d(x, y, assume_unique=True))
        out.append((common, len(x) + len(y) - common))
    return pd.DataFrame(out, columns=["common", "united"])


# filters on their results must not make Spark evaluate them a second time
_members, _agreement, _overlap = (f.asNondeterministic() for f in (_members, _agreement, _overlap))


def forest(reps: DataFrame) -> DataFrame:
    """(tree, key, doc): every representative in each tree."""
    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            sig = np.frombuffer(b"".join(f["sig"]), np.uint8).reshape(-1, VALUES)
            doc = f["doc"].to_numpy()
            for t in range(TREES):
                keys = np.ascontiguousarray(sig[:, _ORDERS[t]])
                yield pd.DataFrame({"tree": np.full(len(doc), t, np.int32), "key": [k.tobytes() for k in keys], "doc": doc})

    return reps.select("doc", "sig").mapInPandas(rows, "tree int, key binary, doc long")


def neighbours(trees: DataFrame, threshold: int) -> DataFrame:
    """(a, b), a < b: documents that follow each other in a sorted order and
    share a long enough prefix. In crowded regions, which are joined exactly
    later, only the next row, and not where the keys agree in less than the
    threshold minus three standard errors. The orders are range-partitioned, so a dense region is
    spread over tasks like any other; the few neighbours on two sides of a
    partition's edge meet in other trees."""
    share, rest = threshold / 100, DEPTH - MIN_DEPTH
    least = MIN_DEPTH + rest * share - 3 * (rest * share * (1 - share)) ** 0.5

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail = None
        for f in frames:
            f = f if tail is None else pd.concat([tail, f], ignore_index=True)
            seen = 0 if tail is None else len(tail)
            key = np.frombuffer(b"".join(f["key"]), np.uint8).reshape(-1, DEPTH)
            tree, doc = f["tree"].to_numpy(), f["doc"].to_numpy()
            left, right = [], []
            begins = np.append(True, (tree[1:] != tree[:-1]) | (key[1:, :MIN_DEPTH] != key[:-1, :MIN_DEPTH]).any(axis=1))
            run = np.cumsum(begins) - 1
            few = np.bincount(run)[run] <= NEIGHBOURS + 1  # as far as seen: no more rows than in the region
            for step in range(1, min(NEIGHBOURS, len(f) - 1) + 1):
                same = key[step:] == key[:-step]
                near = (tree[step:] == tree[:-step]) & same[:, :MIN_DEPTH].all(axis=1)
                near &= few[step:] | ((step == 1) & (same.sum(axis=1) >= least))
                near[:max(0, seen - step)] = False  # both in the tail: seen before
                at = np.flatnonzero(near)
                left.append(doc[at])
                right.append(doc[at + step])
            tail = f.iloc[-NEIGHBOURS:]
            if left:
                x, y = np.concatenate(left), np.concatenate(right)
                yield pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)}).drop_duplicates()

    ordered = trees.repartitionByRange("tree", "key").sortWithinPartitions("tree", "key")
    return ordered.mapInPandas(rows, "a long, b long").distinct()


def _similar(pairs: DataFrame, reps: DataFrame, least: int) -> DataFrame:
    """Pairs whose signatures agree in at least ``least`` values."""
    a = reps.select(F.col("doc").alias("a"), F.col("sig").alias("sig_a"))
    b = reps.select(F.col("doc").alias("b"), F.col("sig").alias("sig_b"))
    return (pairs.join(a, "a").join(b, "b").select("a", "b", _agreement("sig_a", "sig_b").alias("agree"))
            .where(F.col("agree") >= least))


def candidates(reps: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """(a, b, agree): candidate pairs, each once; (doc): documents of regions
    with more rows than a document's neighbours can cover."""
    share = threshold / 100
    least = int(VALUES * (share - 6 * (share * (1 - share) / VALUES) ** 0.5))
    trees = stage(forest(reps), "forest")
    near = stage(_similar(neighbours(trees, threshold), reps, least), "neighbours")
    alike = near.where(F.col("agree") * 100 >= threshold * VALUES)
    ends = [alike.groupBy(F.col(end).alias("doc")).agg(F.count("*").alias("links")) for end in ("a", "b")]
    hubs = ends[0].unionByName(ends[1]).groupBy("doc").agg(F.sum("links").alias("links")).where(F.col("links") >= HUB_LINKS)
    region = trees.select("tree", F.expr(f"substring(key, 1, {MIN_DEPTH})").alias("region"), "doc")
    centre = (region.join(hubs, "doc").groupBy("tree", "region")
              .agg(F.max(F.struct("links", "doc"))["doc"].alias("hub")))
    around = (region.join(stage(centre, "hubs"), ["tree", "region"]).where("doc <> hub")
              .select(F.least("doc", "hub").alias("a"), F.greatest("doc", "hub").alias("b")).distinct())
    more = _similar(around.join(near, ["a", "b"], "left_anti"), reps, least)
    crowds = region.groupBy("tree", "region").count().where(F.col("count") > NEIGHBOURS + 1).drop("count")
    crowded = stage(region.join(crowds, ["tree", "region"]).select("doc").distinct(), "crowded")
    return stage(near.unionByName(more), "candidates"), crowded


def _shingles(sets: DataFrame) -> DataFrame:
    """(doc, n, h): every shingle of stored sets."""
    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k in range(0, len(f), 256):
                parts = [_unpacked(m).view(np.int64) for m in f["members"].iloc[k:k + 256]]
                n = np.array([len(x) for x in parts])
                yield pd.DataFrame({"doc": f["doc"].to_numpy()[k:k + 256].repeat(n), "n": n.repeat(n).astype(np.int32),
                                    "h": np.concatenate(parts)})

    return sets.select("doc", "members").mapInPandas(rows, "doc long, n int, h long")


def crowded_pairs(sets: DataFrame, roots: DataFrame, threshold: int) -> DataFrame:
    """(a, b): among the documents of ``sets``, at least all pairs at the
    threshold that ``roots`` has in different components.

    With shingles in any fixed order, x and y at the threshold t and
    |x| <= |y| have their first common shingle among the first
    |x| - ceil(2t/(1+t) |x|) + 1 of x and the first |y| - ceil(t |y|) + 1 of y,
    and behind it enough shingles of both for the overlap. A shingle of one
    document only takes a place and pairs nothing. Of a shingle's documents
    those of its largest component are not paired with each other, and its
    documents are dealt in blocks of BLOCK."""
    shingles = _shingles(sets)
    shared = shingles.groupBy("h").agg(F.count("*").alias("docs")).where("docs > 1")
    own = Window.partitionBy("doc")
    place = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("docs", "h")) - 1
    # at the threshold, of n shingles at least ceil(2tn / (1 + t)) are shared with one as long, ceil(tn) with any
    first = (shingles.join(stage(shared, "shared-shingles"), "h").withColumn("at", place.cast("int"))
             .where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * threshold / 100 - 1e-9)))
    first = (first.join(roots.select(F.col("node").alias("doc"), "root"), "doc", "left")
             .select("h", "doc", "n", "at", F.coalesce("root", "doc").alias("root"),
                     (F.col("at") <= F.col("n") - F.ceil(F.col("n") * (2 * threshold) / (100 + threshold) - 1e-9)).alias("short")))
    first = stage(first, "first-shingles")
    mixed = (first.groupBy("h", "root").agg(F.count("*").alias("docs"))
             .groupBy("h").agg(F.sum("docs").alias("docs"), F.max(F.struct("docs", "root")).alias("most"))
             .where(F.col("docs") > F.col("most.docs"))
             .select("h", F.col("most.root").alias("main"), F.ceil(F.col("docs") / BLOCK).cast("int").alias("blocks")))
    first = stage(first.join(stage(mixed, "mixed"), "h"), "mixed-shingles")
    x = first.where("short").select(
        "h", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int").alias("block"),
        (F.col("root") == F.col("main")).alias("x_main"), *[F.col(c).alias(f"x_{c}") for c in ("doc", "n", "at", "root")])
    y = first.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "h", "block", (F.col("root") == F.col("main")).alias("y_main"),
        *[F.col(c).alias(f"y_{c}") for c in ("doc", "n", "at", "root")])
    fits = F.expr(f"""x_root <> y_root AND (x_n < y_n OR x_n = y_n AND x_doc < y_doc) AND x_n * 100L >= y_n * {threshold}L
        AND least(x_n - x_at, y_n - y_at) * {100 + threshold}L >= (x_n + y_n) * {threshold}L""")
    some = x.where("NOT x_main").join(y, ["h", "block"]).where(fits)
    main = x.where("x_main").join(y.where("NOT y_main"), ["h", "block"]).where(fits)
    pairs = some.select("x_doc", "y_doc").unionByName(main.select("x_doc", "y_doc"))
    return pairs.select(F.least("x_doc", "y_doc").alias("a"), F.greatest("x_doc", "y_doc").alias("b")).distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) that are links on their full sets."""
    a = sets.select(F.col("doc").alias("a"), F.col("members").alias("set_a"))
    b = sets.select(F.col("doc").alias("b"), F.col("members").alias("set_b"))
    over = pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", _overlap("set_a", "set_b").alias("o"))
    return over.where(F.col("o.common") * 100 >= F.col("o.united") * threshold).select("a", "b")


def near_duplicates(docs: DataFrame, *, threshold: int = THRESHOLD, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc, n_shingles, component, kept) of every document: its component is
    the smallest id reachable over links, and only that document is kept."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    id_col, text_col = "id", "text"
    sketch = docs.select(F.col(id_col).alias("doc"), _sketch(text_bytes(text_col)).alias("s"))
    rows = stage(sketch.select("doc", "s.*"), "sketches")
    named = (rows.where(F.col("doc").isNotNull()).groupBy("doc")
             .agg(F.min(F.struct("digest", "n", "sig")).alias("s")).select("doc", "s.*"))
    reps = (named.where("n > 0").groupBy("digest").agg(F.min(F.struct("doc", "sig")).alias("r"))
            .select("digest", F.col("r.doc").alias("doc"), F.col("r.sig").alias("sig")))
    reps = stage(reps, "representatives")
    pairs, crowded = candidates(reps, threshold)

    ends = pairs.select(F.col("a").alias("doc")).distinct().unionByName(pairs.select(F.col("b").alias("doc")).distinct())
    ends = (ends.withColumn("crowded", F.lit(False)).unionByName(crowded.withColumn("crowded", F.lit(True)))
            .groupBy("doc").agg(F.max("crowded").alias("w_crowded")))
    wanted = stage(ends.join(reps.select("doc", "digest"), "doc")
                   .select(F.col("doc").alias("w_doc"), F.col("digest").alias("w_digest"), "w_crowded"), "wanted")
    sets = (docs.join(sized_broadcast(wanted, wanted.count()), F.col(id_col) == F.col("w_doc"))
            .select(F.col("w_doc").alias("doc"), "w_digest", "w_crowded", _members(text_bytes(text_col)).alias("m"))
            .where(F.col("m.digest") == F.col("w_digest"))
            .select("doc", F.col("w_crowded").alias("crowded"), F.col("m.members").alias("members")))
    sets = stage(sets.dropDuplicates(["doc"]), "sets")

    # first the most alike partner of every document, then whatever could still join two components
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "agree"))
    best = both.groupBy("a").agg(F.max(F.struct("agree", F.col("b").alias("x")))["x"].alias("x"))
    first = best.select(F.least("a", "x").alias("a"), F.greatest("a", "x").alias("b")).distinct()
    first = stage(first, "first-pairs")
    links = stage(confirmed(first, sets, threshold), "first-links")
    part = components(links)
    rest = pairs.select("a", "b").join(first, ["a", "b"], "left_anti")
    for end in ("a", "b"):
        rest = rest.join(part.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
    rest = rest.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    links = stage(links.unionByName(confirmed(rest, sets, threshold)), "links")
    roots = components(links)
    more = stage(crowded_pairs(sets.where("crowded"), roots, threshold), "crowded-pairs")
    more = stage(confirmed(more, sets, threshold), "crowded-links")
    if not more.isEmpty():
        roots = components(links.unionByName(more))

    own = reps.select("digest", F.col("doc").alias("rep")).join(
        roots.select(F.col("node").alias("rep"), "root"), "rep", "left")
    own = stage(own.select(F.col("digest").alias("r_digest"), F.coalesce("root", "rep").alias("root")), "roots")
    done = (named.join(own, F.col("digest") == F.col("r_digest"), "left")
            .select("doc", F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("doc")).alias("component")))
    done = done.withColumn("kept", F.col("doc") == F.col("component"))
    nameless = rows.where(F.col("doc").isNull()).select(
        "doc", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component"), F.lit(True).alias("kept"))
    return done.unionByName(nameless)


@keeps_names
def drop_near_duplicates(docs: DataFrame, *, threshold: int = THRESHOLD, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that are not kept."""
    gone = near_duplicates(docs, threshold=threshold, id_col=id_col, text_col=text_col).where("NOT kept")
    gone = stage(gone.select(F.col("doc").alias("_gone")), "dropped")
    return docs.join(sized_broadcast(gone, gone.count()), F.col(id_col).cast("long") == F.col("_gone"), "left_anti")
