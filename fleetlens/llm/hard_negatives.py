"""Hard-negative mining (operator 11): slot-decomposed selection.

An anchor's positives are its best rows of the same label. Each positive asks
for the best rows of another label whose score lies in a window that follows
from the positive's own score; the windows of one anchor overlap. Their upper
limits, in descending order, cut the scores into disjoint slots: slot j holds
what is at most the j-th limit and above the next. A row belongs to one slot
only, so one pass over all rows, keeping the first k of every slot, serves all
windows: window j is answered by the first k of slots j, j + 1, ... together,
merged from the last slot to the first, and its lower limit cuts the end of
that list.

Vectors are integers, scores exact inner products. Anchors meet vectors in
tiles: a bounded number of anchors against a bounded number of vectors, dealt
by row number, so no label, id or copy makes a tile larger. A tile is a cogroup;
its two sides are all it holds. Within a tile a combiner keeps the first k per
anchor and slot, and its kth score is the floor below which later rows of the
tile are not looked at. What tiles found is merged by rank per anchor and
slot. Both passes, for positives and for negatives, run the same tiles.

Defined cases: rows whose id, label or vector is null, or whose vector is
empty or holds a null or non-finite component, take no part; vectors meet only
those of their own length; ties go to the smaller id; rows that share an id
are rows of their own (an anchor's copy under the same id is another row), so
an anchor id held by two rows is answered for both; a positive with a negative
score has an empty window; anchors without positives or positives without
negatives give no rows. Scores must fit a long. Only the named columns are
read, so others of any name do no harm. Empty tables give an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

TILE_BYTES = 32 << 20  # of either side of a tile, as 8-byte components
LEAST_ROWS = 1024  # of vectors in a tile, unless there are fewer
ANCHOR_ROWS = 512  # anchors that are scored at once
CHUNK_ROWS = 8192  # vectors that are scored at once
LEAST = np.iinfo(np.int64).min
_FOUND = "anchor long, slot int, id long, score long"


def usable_vector(vector: Column) -> Column:
    """True for vectors that are not empty and hold finite components only."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & finite


def labelled_vectors(df: DataFrame, *, id_col: str, vector_col: str, label: Column, scale: int) -> DataFrame:
    """(row, id, label, dim, v), a written table of the rows that take part:
    row numbers, and vectors as the integers floor(scale * x) in the shortest
    type that holds them all."""
    v = F.transform(F.col(vector_col), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    rows = stage(df.where(F.col(id_col).isNotNull() & label.isNotNull() & usable_vector(F.col(vector_col)))
                 .select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"),
                         label.cast("string").alias("label"), F.size(vector_col).alias("dim"), v.alias("v")), "labelled")
    reach = rows.agg(F.max(F.greatest(F.array_max("v"), -F.array_min("v") - 1))).first()[0] or 0
    kind = "short" if reach < 1 << 15 else "int" if reach < 1 << 31 else "long"
    return rows.withColumn("v", F.col("v").cast(f"array<{kind}>"))


# --- a tile ---------------------------------------------------------------

def matrix(column: pa.ChunkedArray, dim: int, kind=np.int64) -> np.ndarray:
    """The lists of a column, all of length ``dim``, as rows."""
    parts = [c.flatten().to_numpy(zero_copy_only=False).astype(kind) for c in column.chunks if len(c)]
    return np.concatenate([np.empty(0, kind), *parts]).reshape(-1, dim)


def _codes(*columns: pa.ChunkedArray) -> list[np.ndarray]:
    """Numbers that are equal where the values of the columns are."""
    joined = pa.chunked_array([c for x in columns for c in x.chunks if len(c)], columns[0].type)
    coded = joined.dictionary_encode().unify_dictionaries()
    codes = np.concatenate([np.empty(0, np.int64), *(c.indices.to_numpy(zero_copy_only=False) for c in coded.chunks)])
    return np.split(codes, np.cumsum([len(x) for x in columns])[:-1])


class Slots:
    """Combiner: the first k rows, by score and id, per anchor and slot.
    ``uppers`` (n, slots), descending, are the slots' upper limits; the last
    slot ends at ``lowest``."""

    def __init__(self, uppers: np.ndarray, lowest: np.ndarray, k: int):
        self.uppers, self.k = uppers, k
        below = np.concatenate((uppers[:, 1:] + 1, lowest[:, None]), axis=1)
        self.floors = np.maximum(below, lowest[:, None])
        self.kept = np.empty((4, 0), np.int64)  # anchor, slot, score, id

    def add(self, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        new = [self.kept]
        for slot in range(self.uppers.shape[1]):
            low, high = self.floors[:, slot, None], self.uppers[:, slot, None]
            at, col = np.nonzero((scores >= low) & (scores <= high) & allowed)
            new.append(np.stack((at, np.full(len(at), slot), scores[at, col], ids[col])))
        found = np.concatenate(new, axis=1)
        if found.shape[1] == self.kept.shape[1]:
            return
        found = found[:, np.lexsort((found[3], -found[2], found[1], found[0]))]
        starts = np.flatnonzero(np.concatenate(([True], (found[:2, 1:] != found[:2, :-1]).any(axis=0))))
        rank = np.arange(found.shape[1]) - np.repeat(starts, np.diff(np.append(starts, found.shape[1])))
        self.kept = found[:, rank < self.k]
        anchor, slot, score, _ = found[:, rank == self.k - 1]
        self.floors[anchor, slot] = np.maximum(self.floors[anchor, slot], score)


def _tile(same: bool, k: int):
    def run(key: tuple, vectors: pa.Table, anchors: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        points, asked = matrix(vectors["v"], dim), matrix(anchors["v"], dim)
        reach = int(np.abs(points).max(initial=0)) * int(np.abs(asked).max(initial=0)) * dim
        kind = np.float64 if reach < 1 << 52 else np.int64  # exact either way
        points, asked = points.astype(kind), asked.astype(kind)
        ids, rows = vectors["id"].to_numpy(), vectors["row"].to_numpy()
        a_rows, lowest = anchors["row"].to_numpy(), anchors["lowest"].to_numpy()
        labels, a_labels = _codes(vectors["label"], anchors["label"])
        limits = anchors["uppers"].to_pylist()
        uppers = np.full((len(limits), max(map(len, limits), default=0)), LEAST)
        for i, x in enumerate(limits):
            uppers[i, :len(x)] = x
        out = []
        for a in range(0, len(a_rows), ANCHOR_ROWS):
            part = slice(a, a + ANCHOR_ROWS)
            slots, at, size = Slots(uppers[part], lowest[part], k), 0, min(256, CHUNK_ROWS)
            while at < len(ids):  # small chunks first: they raise the floors
                some = slice(at, at + size)
                scores = (asked[part] @ points[some].T).astype(np.int64)
                alike = a_labels[part, None] == labels[None, some]
                slots.add(scores, ids[some], alike & (a_rows[part, None] != rows[None, some]) if same else ~alike)
                at, size = at + size, min(2 * size, CHUNK_ROWS)
            anchor, slot, score, got = slots.kept
            out.append((a_rows[part][anchor], slot.astype(np.int32), got, score))
        cols = [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, t) for t in ("i8", "i4", "i8", "i8")]
        return pa.table(dict(zip(("anchor", "slot", "id", "score"), cols)))
    return run


def _search(vectors: DataFrame, anchors: DataFrame, n: int, n_anchors: int, dim: int, *, same: bool, k: int) -> DataFrame:
    """(anchor, slot, id, score, rank): the first k rows of every anchor and
    slot. ``anchors`` are rows with their limits ``uppers`` and ``lowest``."""
    most = max(1, TILE_BYTES // (8 * dim))
    spread = min(math.ceil(n / LEAST_ROWS), vectors.sparkSession.sparkContext.defaultParallelism)
    across, down = max(math.ceil(n / most), spread, 1), max(math.ceil(n_anchors / most), 1)

    def dealt(rows: DataFrame, own: str, parts: int, other: str, others: int) -> DataFrame:
        rows = rows.select(*[F.col(c).alias(c) for c in rows.columns])  # both sides are read from one table
        return (rows.withColumn(own, F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))))

    keys = ["dim", "across", "down"]
    left = dealt(vectors, "across", across, "down", down).groupBy(*keys)
    right = dealt(anchors, "down", down, "across", across).groupBy(*keys)
    found = left.cogroup(right).applyInArrow(_tile(same, k), _FOUND)
    best = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


# --- the operator ---------------------------------------------------------

def mine_hard_negatives(vectors: DataFrame, is_anchor: Column, *, positives: int = 5, negatives: int = 3, low: int = 50,
                        high: int = 95) -> DataFrame:
    """For every anchor among ``vectors`` (as ``labelled_vectors`` gives them)
    and each of its first ``positives`` rows of its label, the first
    ``negatives`` rows of other labels that score from ``low`` to ``high``
    percent of the positive: (anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score)."""
    if not 0 <= low < high:
        raise ValueError("limits must satisfy 0 <= low < high")
    anchors = vectors.where(is_anchor)
    count = vectors.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(1)), F.count(F.when(is_anchor, 1))).first()
    n, dim, n_anchors = count
    sizes = {"n": n, "n_anchors": n_anchors, "dim": dim}

    every = anchors.withColumns({"uppers": F.array(F.lit(2**63 - 1)), "lowest": F.lit(int(LEAST) + 1)})
    best = _search(vectors, every, same=True, k=positives, **sizes).where("score >= 0")
    whole, rest = "score div 100", "score % 100"  # floor and ceiling of the shares, without a product that overflows
    upper = F.expr(f"{high} * ({whole}) + ({high} * ({rest})) div 100")
    lower = F.expr(f"{low} * ({whole}) + ({low} * ({rest}) + 99) div 100")
    best = best.select("anchor", F.struct("rank", "id", "score", upper.alias("upper"), lower.alias("lower")).alias("p"))
    asked = best.groupBy("anchor").agg(F.sort_array(F.collect_list("p")).alias("positives"))
    uppers = F.sort_array(F.array_distinct("positives.upper"), asc=False)
    asked = stage(asked.withColumns({"uppers": uppers, "lowest": F.array_min("positives.lower")}), "positives")

    limits = asked.select(F.col("anchor").alias("row"), "uppers", "lowest")
    found = _search(vectors, anchors.join(limits, "row"), same=False, k=negatives, **sizes)
    found = found.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("slot", "rank", "id", "score"))).alias("found"))

    # descending merges: the first of slot s and of the slots below it
    nothing = F.slice("found", 1, 0)
    suffixes = F.aggregate(
        F.reverse(F.sequence(F.lit(0), F.size("uppers") - 1)), F.slice(F.array("found"), 1, 0),
        lambda lists, s: F.concat(F.array(F.slice(F.concat(F.filter("found", lambda x: x["slot"] == s),
                                                           F.coalesce(F.get(lists, F.lit(0)), nothing)), 1, negatives)), lists))
    merged = (asked.join(found, "anchor").withColumn("suffixes", suffixes)
              .select("anchor", "uppers", "suffixes", F.explode("positives").alias("p")))
    first = (F.array_position("uppers", F.col("p.upper")) - 1).cast("int")
    within = F.filter(F.get("suffixes", first), lambda x: x["score"] >= F.col("p.lower"))
    answers = merged.select("anchor", "p", F.posexplode(within).alias("at", "neg"))
    names = anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return answers.join(names, "anchor").select(
        "anchor_id", F.col("p.id").alias("positive_id"), (F.col("at") + 1).cast("int").alias("rank"),
        F.col("neg.id").alias("negative_id"), F.col("p.score").alias("positive_score"),
        F.col("neg.score").alias("negative_score"))
