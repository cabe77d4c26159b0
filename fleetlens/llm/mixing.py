"""Mixing sources to target weights (operator 3): Efraimidis-Spirakis
sampling.

Every document gets an exponential key, -ln(u) / w, from a hash u of its id
and its quality weight w; small keys go first, which draws without
replacement in proportion to the weights. A source whose target reaches its
size gives complete epochs; the rest of its target is the shortest run of
documents in key order whose words come nearest to it.

The prefix sums are taken in two steps, so that a source holding a third of
all rows is never sorted in one task: words are summed per source and key
bucket, the sums of the buckets are accumulated, and only the documents of the
one bucket in which the target falls are ordered. Buckets are quantiles of the
keys at weight 1; where light weights crowd a source's keys into its last
ones, the bucket of the target is cut again by key until it is small or holds
one key only. What a source takes is then
one row of a small plan (complete epochs, last key), and each document decides
for itself by comparing its key: texts are never shuffled.

Defined cases: null and empty texts have size 0 and take nothing; a null
source is a source of its own, the last in order; documents without an id are
keyed by their text; rows that share an id share a key and are taken
together; a source without words has target 0; an empty table gives an empty
table. Extra columns are carried as they are. Sources are counted and
planned on the driver: ``MAX_SOURCES`` bounds them.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keeps_names, sized_broadcast, stage, struct_of, text_bytes

SOURCE_WEIGHTS = (5, 2, 1)
SHARE = 1.5  # all targets together, times all sizes
CEILING = 2  # a target, times its source's size
MAX_SOURCES = 1_000_000
SEED = 17
LEAST_WEIGHT = 0.05
EDGE_ROWS = 50_000  # rows of a bucket that are ordered in one task
CUTS = 1024  # parts a larger bucket is cut into

_LETTERS = bytes(b for b in range(256) if chr(b).isascii() and chr(b).isalpha() or b >= 0x80)
_PLAN = "source string, source_size long, target double, epochs int, rest double"


@F.pandas_udf(struct_of(size="long", weight="double"))
def _measure(body: pd.Series) -> pd.DataFrame:
    """Words of a text and its quality weight: the share of letters."""
    out = []
    for text in body:
        dense = sum(map(len, words := text.split()))  # blanks do not count
        letters = len(text) - len(text.translate(None, _LETTERS))
        out.append((len(words), max(LEAST_WEIGHT, letters / dense) if dense else 1.0))
    return pd.DataFrame(out, columns=["size", "weight"])


_measure = _measure.asNondeterministic()  # a filter on what follows from it must not evaluate it again


def source_targets(sizes: dict[str | None, int]) -> dict[str | None, float]:
    """Words each source shall give: shares by weight, none above CEILING
    times its size, the excess shared out again."""
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: SOURCE_WEIGHTS[k % len(SOURCE_WEIGHTS)] for k, s in enumerate(order)}
    target: dict[str | None, float] = {}
    left, open_ = SHARE * sum(sizes.values()), list(order)
    while open_:
        per = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if per * weight[s] > CEILING * sizes[s]]
        if not full:
            return target | {s: per * weight[s] for s in open_}
        for s in full:
            target[s] = float(CEILING * sizes[s])
            left -= target[s]
        open_ = [s for s in open_ if s not in target]
    return target


def keyed(docs: DataFrame, *, id_col: str, text_col: str, weight_col: str | None) -> DataFrame:
    """``docs`` with the struct ``_mix``: size, key, tie, part (the key's
    quantile under weight 1, from 0 to 1)."""
    rows = docs.withColumn("_size", _measure(text_bytes(text_col)))
    weight = F.greatest(F.col(weight_col).cast("double"), F.lit(LEAST_WEIGHT)) if weight_col else F.col("_size.weight")
    of = [F.col(id_col), F.when(F.col(id_col).isNull(), F.col(text_col))]
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *of), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    key = -F.log(u) / F.coalesce(weight, F.lit(1.0))
    return rows.withColumn("_mix", F.struct(F.col("_size.size").alias("size"), key.alias("key"),
                                            F.xxhash64(F.lit(SEED + 1), *of).alias("tie"),
                                            (1 - F.exp(-key)).alias("part"))).drop("_size")


def _edges(rows: DataFrame, rest: DataFrame, n: int) -> DataFrame:
    """Of (source, size, key, bucket), per source the bucket in which its
    rest falls, as its first and last key, its rows, and the words before it."""
    per = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.count("*").alias("p_n"),
                                               F.min("key").alias("p_low"), F.max("key").alias("p_high"))
    over = Window.partitionBy("source").orderBy("bucket")  # a bounded number of buckets
    sums = per.withColumn("upto", F.sum("words").over(over))
    few = sized_broadcast(rest, n)
    upto = F.col("p_before") + F.col("upto")
    return (sums.join(few, F.col("source").eqNullSafe(F.col("p_source")))
            .where((upto >= F.col("rest")) & (upto - F.col("words") < F.col("rest")))
            .select("p_source", (upto - F.col("words")).alias("p_before"), "rest", "p_n", "p_low", "p_high"))


def _in_range(base: DataFrame, edge: DataFrame, n: int) -> DataFrame:
    """The rows whose keys lie in the range of their source."""
    return base.join(sized_broadcast(edge, n), F.col("source").eqNullSafe(F.col("p_source"))
                     & (F.col("key") >= F.col("p_low")) & (F.col("key") <= F.col("p_high")))


def plan_mix(base: DataFrame) -> tuple[DataFrame, int]:
    """From (source, size, key, tie, part): one row per source with its
    size, target, complete epochs and last key, and the number of sources."""
    spark = base.sparkSession
    found = base.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    found = found.limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sizes = {r["source"]: r["size"] or 0 for r in found}
    targets = source_targets(sizes)
    rows = []
    for s, size in sizes.items():
        epochs = min(CEILING, int(targets[s] // size)) if size else 0
        rows.append((s, size, targets[s], epochs, max(0.0, targets[s] - epochs * size)))
    plan = spark.createDataFrame(rows, _PLAN)

    # a power of two, so that a bucket's first quantile is exact
    buckets = 1 << min(20, max(10, math.ceil(math.log2(max(1, sum(r["n"] for r in found) / 50_000)))))
    bucket = F.least(F.floor(F.col("part") * buckets), F.lit(buckets - 1)).cast("int")
    rest = plan.select(F.col("source").alias("p_source"), F.lit(0).cast("long").alias("p_before"), "rest")
    edge = stage(_edges(base.withColumn("bucket", bucket), rest, len(rows)), "mix-edge")
    # from here on a bucket is the range of keys between its first and its last
    while True:
        wide = edge.where((F.col("p_n") > EDGE_ROWS) & (F.col("p_low") < F.col("p_high")))
        if wide.isEmpty():
            break
        inside = _in_range(base, wide, len(rows))
        at = F.floor((F.col("key") - F.col("p_low")) / (F.col("p_high") - F.col("p_low")) * CUTS)
        finer = _edges(inside.select("source", "size", "key", F.least(at, F.lit(CUTS - 1)).cast("int").alias("bucket")),
                       wide.select("p_source", "p_before", "rest"), len(rows))
        narrow = edge.where((F.col("p_n") <= EDGE_ROWS) | (F.col("p_low") >= F.col("p_high")))
        edge = stage(narrow.unionByName(finer), "mix-edge")
    inside = _in_range(base, edge, len(rows))
    run = Window.partitionBy("source").orderBy("key", "tie")
    inside = inside.withColumn("upto", F.col("p_before") + F.sum("size").over(run))
    # a document is taken if the words up to its end come nearer to the target than those before it
    taken = inside.where(F.col("upto") - F.col("rest") <= F.col("rest") - (F.col("upto") - F.col("size")))
    last = (taken.groupBy(F.col("source").alias("t_source"))
            .agg(F.max(F.struct("key", "tie")).alias("last")))
    edges = edge.select(F.col("p_source").alias("e_source"), "p_low")
    plan = (plan.join(edges, F.col("source").eqNullSafe(F.col("e_source")), "left")
            .join(last, F.col("source").eqNullSafe(F.col("t_source")), "left")
            .select("source", "source_size", "target", "epochs",
                    # everything before the edge bucket is taken, whatever is taken inside it
                    F.coalesce("p_low", F.lit(0.0)).alias("from_key"),
                    F.col("last.key").alias("last_key"), F.col("last.tie").alias("last_tie"),
                    F.col("p_low").isNotNull().alias("partial")))
    rows = plan.collect()  # one row per source
    return spark.createDataFrame(rows, plan.schema), len(rows)


def _copies():
    """How often a document is taken: complete epochs, and once more if its
    key is among those of the partial epoch."""
    before = F.col("partial") & (F.col("key") < F.col("from_key"))
    inside = F.col("last_key").isNotNull() & (
        (F.col("key") < F.col("last_key")) | ((F.col("key") == F.col("last_key")) & (F.col("tie") <= F.col("last_tie"))))
    return F.when(F.col("size") > 0, F.col("epochs") + F.when(before | inside, 1).otherwise(0)).otherwise(0).cast("int")


def _with_plan(base: DataFrame, plan: DataFrame, n: int) -> DataFrame:
    few = plan.withColumnRenamed("source", "plan_source")
    return (base.join(sized_broadcast(few, n), F.col("source").eqNullSafe(F.col("plan_source")), "left")
            .withColumn("copies", _copies()))


def _base(docs: DataFrame, id_col: str, text_col: str, source_col: str, weight_col: str | None) -> DataFrame:
    """The small table that is planned on: no texts."""
    rows = keyed(docs, id_col=id_col, text_col=text_col, weight_col=weight_col)
    return stage(rows.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), "_mix.*"), "mix")


def mix_table(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
              weight_col: str | None = None) -> DataFrame:
    """(id, size, source_size, target, copies, taken) of every document."""
    base = _base(docs, id_col, text_col, source_col, weight_col)
    return (_with_plan(base, *plan_mix(base))
            .select("id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")))


@keeps_names
def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weight_col: str | None = None) -> DataFrame:
    """The mixed corpus: rows of ``docs``, each as often as it is taken."""
    plan, n = plan_mix(_base(docs, id_col, text_col, source_col, weight_col))
    rows = keyed(docs, id_col=id_col, text_col=text_col, weight_col=weight_col)
    rows = rows.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                       F.col(source_col).alias("source"), "_mix.*")
    chosen = _with_plan(rows, plan, n).where("copies > 0")
    return chosen.withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies"))).select("_row.*")
