"""Approximate nearest neighbours by cosine (operator 12): multi-index hashing.

Vectors become binary codes: centred, rotated by principal axes and by a
rotation that brings them nearest to the corners of a cube (iterative
quantisation, learned from a bounded sample), one bit per axis. A code is cut
into substrings of at most 16 bits and every substring has a table of its own.
Two codes that differ in at most r bits differ in at most floor((r - j) / m)
bits in some substring j of m (pigeonhole), so probing every table for
substrings within that distance retrieves every code within radius r. A code
is taken from the first table that retrieves it, its whole distance is
checked, and what is left is reranked by exact cosines, nearest codes first.

The radius is the query's own. It follows from a cosine that its kth
neighbour is known to reach: the angle gives an expected number of differing
bits and its spread, both fitted on the sample, and ``SAFETY`` spreads are
added. A first round probes substrings within one bit; what it finds, or the
sample if that is better, sets the radius of the second. There is no cap on
buckets, probes or candidates. The only loss is a neighbour whose code differs
by more than that many spreads; recall is measured in the tests.

At scale: a table is dealt into regions by the leading bits of the substring
values, as many bits as make regions of ``REGION_ROWS``; a query is sent to
the regions that can hold a substring near enough, and to no other. Crowded
regions are split by row number and regions that many queries meet by query,
from counts per region (at most 65,536 a table, the only thing broadcast
besides the model), so a tile - a cogroup of region and queries - is bounded
on both sides. Equal vectors are one entry with its smallest ids, and equal
queries are searched once.

Defined cases: rows whose id or vector is null, or whose vector is empty, zero
or holds a null or non-finite component, take no part; vectors meet only those
of their own length (one model a length); ties go to the smaller id; rows that
share an id are rows of their own; where there are fewer than k candidates all
are returned. Only the named columns are read, so others of any name do no
harm. Empty tables give an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage
from .hard_negatives import matrix, usable_vector

BITS = 64
SUBSTRING = 16  # bits of a table's key
SAMPLE = 4096  # vectors of a length that a model is fitted on
ITERATIONS = 30
SAFETY = 2.0
REGION_ROWS = 8192
QUERY_ROWS = 16384
_COUNT = np.array([i.bit_count() for i in range(1 << 16)], np.uint8)
_BY_WEIGHT = np.argsort(_COUNT, kind="stable").astype(np.uint16)  # all substrings, fewest bits first
_FOUND = "query long, score double, id long, row long"


# --- codes ----------------------------------------------------------------

@dataclass
class Model:
    """Codes of vectors of one length."""

    centre: np.ndarray
    axes: np.ndarray  # (dim, bits)
    slope: float  # bits that differ, in parts of what the angle would give
    spread: float
    sample: np.ndarray  # unit vectors

    @property
    def bits(self) -> int:
        return self.axes.shape[1]

    @property
    def tables(self) -> int:
        return -(-self.bits // SUBSTRING)

    def encode(self, unit: np.ndarray) -> np.ndarray:
        """(n, tables) substrings, each in the leading bits of 16."""
        on = (unit - self.centre) @ self.axes > 0
        parts = np.array_split(np.arange(self.bits), self.tables)
        return np.stack([(on[:, p] << np.arange(15, 15 - len(p), -1)).sum(axis=1) for p in parts], axis=1).astype(np.uint16)

    def radius(self, cosine: np.ndarray) -> np.ndarray:
        """Bits within which a code of at least that cosine is expected."""
        part = np.clip(self.slope * np.arccos(np.clip(cosine, -1, 1)) / np.pi, 0, 1)
        far = self.bits * part + SAFETY * self.spread * np.sqrt(self.bits * part * (1 - part))
        return np.where(cosine <= -1, self.bits, np.minimum(np.ceil(far), self.bits)).astype(np.int64)


def unit_vectors(v: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by powers of two first, which is exact, so
    that no square overflows or vanishes."""
    v = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, initial=0))[1][:, None])
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def fit(unit: np.ndarray) -> Model:
    """Iterative quantisation on a sample of unit vectors."""
    rng = np.random.default_rng(0)
    centre = unit.mean(axis=0)
    x = unit - centre
    bits = min(x.shape[1], BITS)
    main = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :bits]
    x = x @ main
    turn = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
    for _ in range(ITERATIONS):
        u, _, w = np.linalg.svd(x.T @ np.where(x @ turn > 0, 1.0, -1.0))
        turn = u @ w
    model = Model(centre, main @ turn, 1.0, 1.0, unit)
    codes, some = model.encode(unit), np.arange(min(len(unit), 1024))
    cosines = unit[some] @ unit.T
    cosines[some, some] = -1
    near = np.argsort(-cosines, axis=1)[:, :8]
    near = near[:, :max(0, len(unit) - 1)]
    if near.size >= 64:  # how many bits near pairs differ in
        angle = np.arccos(np.clip(np.take_along_axis(cosines, near, 1), -1, 1)) / np.pi * bits
        differ = _COUNT[codes[some, None] ^ codes[near]].sum(axis=2)
        model.slope = float(np.clip(differ.sum() / max(angle.sum(), 1e-9), 0.5, 1.5))
        part = np.clip(model.slope * angle / bits, 0.5 / bits, 1 - 0.5 / bits)
        model.spread = float(max(1.0, ((differ - model.slope * angle) / np.sqrt(bits * part * (1 - part))).std()))
    return model


def fit_models(vectors: DataFrame) -> dict[int, Model]:
    """A model for each length of ``vectors``, on at most ``SAMPLE`` of them."""
    first = Window.partitionBy("dim").orderBy(F.xxhash64("v"), "vec")
    rows = (vectors.select("dim", "v", "vec").withColumn("n", F.row_number().over(first)).where(F.col("n") <= SAMPLE)
            .select("dim", "v").toArrow())
    dims = rows["dim"].to_numpy()
    return {int(d): fit(unit_vectors(matrix(rows["v"].filter(pa.array(dims == d)), int(d), float))) for d in np.unique(dims)}


# --- the index ------------------------------------------------------------

def distinct_vectors(df: DataFrame, *, id_col: str, vector_col: str, keep: int) -> tuple[DataFrame, DataFrame]:
    """(rows, vectors): the rows that take part, (row, id, v), and their
    distinct vectors, (vec, dim, v, ids), with their first ``keep`` rows."""
    v = F.col(vector_col)
    fine = F.col(id_col).isNotNull() & usable_vector(v) & F.exists(v, lambda x: x != 0)
    rows = stage(df.where(fine).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"),
                                       F.transform(v, lambda x: x + F.lit(0).cast("float")).alias("v")), "rows")  # no -0.0
    first = Window.partitionBy("v").orderBy("id", "row")
    some = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= keep)
    vectors = some.groupBy("v").agg(F.min("row").alias("vec"), F.sort_array(F.collect_list(F.struct("id", "row"))).alias("ids"))
    return rows, stage(vectors.select("vec", F.size("v").alias("dim"), "v", "ids"), "vectors")


def _per_dim(v: pd.Series, models: dict[int, Model]):
    """(positions, model, unit vectors) of the vectors of each length."""
    sizes = v.map(len).to_numpy()
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        yield at, models[int(dim)], unit_vectors(np.stack(v.iloc[at].to_list()).astype(np.float64))


def _encoder(models: dict[int, Model]):
    @F.pandas_udf("array<int>")
    def encode(v: pd.Series) -> pd.Series:
        out = [None] * len(v)
        for at, model, unit in _per_dim(v, models):
            for i, code in zip(at, model.encode(unit).astype(np.int32)):
                out[i] = code
        return pd.Series(out)
    return encode.asNondeterministic()


def _sample_floor(models: dict[int, Model], k: int):
    """A cosine that the kth vector other than the query itself reaches, from
    the sample."""
    @F.pandas_udf("double")
    def floor(v: pd.Series) -> pd.Series:
        out = np.full(len(v), -1.0)
        for at, model, unit in _per_dim(v, models):
            if len(model.sample) > k:
                out[at] = np.partition(unit @ model.sample.T, -k - 1, axis=1)[:, -k - 1] - 1e-9
        return pd.Series(out)
    return floor


def _router(lead: int):
    """The regions (table << 16 | leading bits) that can hold a substring
    within the radius' share of each table."""
    masks = (_BY_WEIGHT[_BY_WEIGHT < 1 << lead]).astype(np.int32)
    upto = np.cumsum(np.bincount(_COUNT[masks], minlength=SUBSTRING + 1))

    @F.pandas_udf("array<int>")
    def route(codes: pd.Series, radius: pd.Series) -> pd.Series:
        out = []
        for code, r in zip(codes, radius):
            m = len(code)
            share = [(int(r) - j) // m for j in range(m)]
            out.append(np.concatenate([(j << 16) | ((int(c) >> (SUBSTRING - lead)) ^ masks[:upto[min(s, SUBSTRING)]])
                                       for j, (c, s) in enumerate(zip(code, share)) if s >= 0]))
        return pd.Series(out)
    return route.asNondeterministic()


# --- a tile ---------------------------------------------------------------

class Best:
    """The first rows of one query: scores and the ids that share them, until
    ``k`` rows are held."""

    def __init__(self, k: int, floor: float):
        self.k, self.floor = k, floor
        self.at, self.scores = np.empty(0, np.int64), np.empty(0)

    def add(self, at: np.ndarray, scores: np.ndarray, counts: np.ndarray, least: np.ndarray) -> None:
        on = scores >= self.floor
        at, scores = np.concatenate((self.at, at[on])), np.concatenate((self.scores, scores[on]))
        order = np.lexsort((least[at], -scores))
        at, scores = at[order], scores[order]
        full = np.flatnonzero(np.cumsum(counts[at]) >= self.k)
        if len(full):
            self.floor = max(self.floor, scores[full[0]])
            at, scores = at[scores >= self.floor], scores[scores >= self.floor]
        self.at, self.scores = at, scores


def _tile(models: dict[int, Model], k: int):
    def run(key: tuple, index: pa.Table, queries: pa.Table) -> pa.Table:
        dim, table = key[0].as_py(), key[1].as_py()
        out: dict[str, list] = {"query": [], "score": [], "id": [], "row": []}
        if len(index) and len(queries):
            model = models[dim]
            units, asked = unit_vectors(matrix(index["v"], dim, float)), unit_vectors(matrix(queries["v"], dim, float))
            codes = matrix(index["codes"], model.tables).astype(np.uint16)
            order = np.argsort(codes[:, table], kind="stable")
            units, codes = units[order], codes[order]
            ids = index["ids"].combine_chunks().take(pa.array(order))
            counts = np.diff(ids.offsets.to_numpy())
            flat = ids.flatten()
            all_ids, all_rows = (flat.field(c).to_numpy() for c in ("id", "row"))
            starts = np.concatenate(([0], np.cumsum(counts)))
            least = all_ids[starts[:-1]]
            values, sizes = np.unique(codes[:, table], return_counts=True)  # the table's buckets
            asked_codes = matrix(queries["codes"], model.tables).astype(np.uint16)
            for q, query, code, floor, r in zip(queries["query"].to_numpy(), asked, asked_codes,
                                                queries["floor"].to_numpy(), queries["radius"].to_numpy()):
                share = (int(r) - np.arange(model.tables)) // model.tables
                at = np.flatnonzero(np.repeat(_COUNT[values ^ code[table]] <= share[table], sizes))
                apart = _COUNT[codes[at] ^ code]
                far = apart.sum(axis=1, dtype=np.int64)
                # not those that an earlier table retrieves
                new = (far <= r) & ~(apart[:, :table] <= share[:table]).any(axis=1)
                at, far = at[new], far[new]
                best, done, size = Best(k, floor), 0, 64
                at, far = (x[np.argsort(far, kind="stable")] for x in (at, far))
                while done < len(at):  # nearest codes first; what they reach narrows the radius
                    some = at[done:done + size]
                    best.add(some, (units[some] * query).sum(axis=1), counts, least)
                    done, size = done + size, 4 * size
                    end = np.searchsorted(far, model.radius(np.array([best.floor]))[0], side="right")
                    at, far = at[:end], far[:end]
                for a, score in zip(best.at, best.scores):
                    rows = slice(starts[a], starts[a + 1])
                    out["query"].append(np.full(counts[a], q))
                    out["score"].append(np.full(counts[a], min(1.0, score)))
                    out["id"].append(all_ids[rows])
                    out["row"].append(all_rows[rows])
        kinds = {"query": "i8", "score": "f8", "id": "i8", "row": "i8"}
        return pa.table({c: np.concatenate(x) if x else np.empty(0, kinds[c]) for c, x in out.items()})
    return run


def _probe(index: DataFrame, queries: DataFrame, models: dict[int, Model], n: int, k: int) -> DataFrame:
    """(query, score, id, row, rank): the first ``k`` rows that the tables
    retrieve within each query's radius."""
    lead = min(SUBSTRING, max(0, math.ceil(math.log2(max(1, n / REGION_ROWS)))))
    keys = ["dim", "part", "lead"]
    entries = (index.select("vec", "dim", "v", "ids", "codes", F.posexplode("codes").alias("part", "value"))
               .withColumn("lead", F.shiftright("value", SUBSTRING - lead)).drop("value"))
    routed = stage(queries.withColumn("to", F.explode(_router(lead)("codes", "radius")))
                   .withColumns({"part": F.shiftright("to", 16), "lead": F.col("to").bitwiseAND(0xFFFF)}).drop("to"), "routed")
    # at most 2^lead rows a table and length, on either side
    crowd = entries.groupBy(*keys).agg(F.ceil(F.count("*") / REGION_ROWS).cast("int").alias("splits"))
    asked = routed.groupBy(*keys).agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("groups"))
    regions = F.broadcast(stage(crowd.join(asked, keys), "regions"))

    def part(row: str, parts: str) -> Column:
        return F.pmod(F.xxhash64(row), F.col(parts)).cast("int")

    def all_of(parts: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(parts) - 1))

    left = entries.join(regions, keys).withColumn("split", part("vec", "splits")).withColumn("group", all_of("groups"))
    right = routed.join(regions, keys).withColumn("group", part("query", "groups")).withColumn("split", all_of("splits"))
    tile = [*keys, "split", "group"]
    found = (left.select(*[F.col(c).alias(c) for c in (*tile, "v", "ids", "codes")]).groupBy(*tile)
             .cogroup(right.select(*[F.col(c).alias(c) for c in (*tile, "query", "v", "codes", "floor", "radius")]).groupBy(*tile))
             .applyInArrow(_tile(models, k), _FOUND))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


# --- the operator ---------------------------------------------------------

def nearest(df: DataFrame, is_query: Column, *, id_col: str, vector_col: str, k: int) -> DataFrame:
    """For every row of ``df`` that ``is_query`` (a condition on ``id``, the
    id as long) its ``k`` nearest other rows found: (query_id, rank, vec_id,
    score)."""
    spark = df.sparkSession
    most = k + 1  # a query finds itself
    rows, vectors = distinct_vectors(df, id_col=id_col, vector_col=vector_col, keep=most)
    n = vectors.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    models = fit_models(vectors)
    index = stage(vectors.withColumn("codes", _encoder(models)("v")), "codes")

    asking = rows.where(is_query)
    queries = asking.groupBy("v").agg(F.min("row").alias("query")).withColumn("dim", F.size("v"))
    queries = stage(queries.withColumns({"codes": _encoder(models)("v"), "floor": _sample_floor(models, most)("v")}), "queries")
    close = queries.withColumn("radius", 2 * F.size("codes") - 1).withColumn("floor", F.lit(-1.0))  # one bit a substring
    reached = (_probe(index, close, models, n, most).where(F.col("rank") == most)
               .select("query", (F.col("score") - 1e-9).alias("reached")))

    @F.pandas_udf("int")
    def radius(dim: pd.Series, floor: pd.Series) -> pd.Series:
        out = np.zeros(len(dim), np.int32)
        for d in dim.unique():
            out[dim == d] = models[int(d)].radius(floor[dim == d].to_numpy())
        return pd.Series(out)

    queries = stage(queries.join(reached, "query", "left")
                    .withColumn("floor", F.greatest("floor", F.coalesce("reached", "floor"))).drop("reached")
                    .withColumn("radius", radius("dim", "floor")), "radii")
    found = _probe(index, queries, models, n, most)
    found = found.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "row", "score"))).alias("found"))
    answers = queries.select("query", "v").join(found, "query").select("v", "found")
    others = F.slice(F.filter("found", lambda x: x["row"] != F.col("row")), 1, k)
    return (asking.join(answers, "v").select("id", F.posexplode(others).alias("at", "hit"))
            .select(F.col("id").alias("query_id"), (F.col("at") + 1).cast("int").alias("rank"),
                    F.col("hit.id").alias("vec_id"), F.col("hit.score").alias("score")))
